"""Published generators as Column expressions: a text hash of 32 bits, a linear congruential sequence, and shuffles by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the hash (FNV-1a, 32 bits), multiplier and step of the sequence.
OFFSET, PRIME, MULTIPLIER, STEP = 2166136261, 16777619, 1103515245, 12345
WORD = 2**32


def hash32(text: Column) -> Column:
    """Unsigned hash over the characters of a text (of the basic plane)."""
    start = F.lit(OFFSET).cast("long")
    code = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(code, start, lambda h, c: F.pmod(h.bitwiseXOR(c) * PRIME, F.lit(WORD)))


def step(state: Column) -> Column:
    return F.pmod(state * MULTIPLIER + STEP, F.lit(WORD))


def shuffled(items: Column, seed: Column) -> Column:
    """Items of an array swapped from the end, each with one at or before it that the sequence names. The array is a bounded
    document's: each swap passes over it."""
    n = F.size(items)
    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    first = F.struct(F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long").alias("s"), items.alias("a"))

    def swap(acc: Column, i: Column) -> Column:
        s = step(acc["s"])
        j = F.floor(s / WORD * (i + 1)).cast("int")
        a = F.transform(acc["a"], lambda x, k: F.when(k == i, F.get(acc["a"], j)).when(k == j, F.get(acc["a"], i)).otherwise(x))
        return F.struct(s.alias("s"), a.alias("a"))

    return F.aggregate(places, first, swap, lambda acc: acc["a"])


def jump(n: int) -> tuple[int, int]:
    """(multiplier, step) by which the sequence goes n places at once."""
    m, a = 1, 0
    for _ in range(n):
        m, a = m * MULTIPLIER % WORD, (a * MULTIPLIER + STEP) % WORD
    return m, a


def leap(state: Column, multiplier: Column, step_: Column) -> Column:
    """The state after such a jump; the multiplier is taken in two halves, so that no product leaves 64 bits."""
    high, low = F.floor(multiplier / 65536).cast("long"), F.pmod(multiplier, F.lit(65536).cast("long"))
    return F.pmod(F.pmod(high * state, F.lit(65536).cast("long")) * 65536 + low * state + step_, F.lit(WORD))


def first_state(seed: Column) -> Column:
    return F.when(seed == 0, F.lit(1).cast("long")).otherwise(seed)
