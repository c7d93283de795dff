"""Best-fit decreasing packing of token pieces into sequences of a fixed length, exact over the whole corpus.

The result of best-fit decreasing depends only on how many pieces there are of each length, and lengths run from 1 to the
capacity. So the pieces are counted by length (a small table whatever the size of the corpus), the packing is worked out on
those counts with a segment tree over the remaining capacities, and every piece then looks up its place by its length and its
rank among the pieces of that length. Bins alike in what they still hold are kept as runs of bin numbers; the tree finds the
tightest capacity that has an open bin in logarithmic time. The plan's size depends on the capacity, not on the corpus.

Ranks within a length are dealt over cells by hash, so a length that most pieces have does not land in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import tokens
from terrane.llm.staging import Staged

CAPACITY = 2048
END_ID = 0
ROWS_PER_CELL = 1_000_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Segment tree over capacities 0..top: which of them some open bin has left."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, bins, pieces per bin, first bin, offset): best-fit decreasing over all pieces."""
    free, runs, out, opened = OpenBins(capacity), {}, {}, 0

    def leave(first: int, bins: int, left: int) -> None:
        if left:
            runs.setdefault(left, []).append((first, bins))
            free.set(left, True)

    for size in sorted(counts, reverse=True):
        n, rank, rows = counts[size], 0, []
        while n:
            left = free.tightest(size)
            if left is None:
                left, first, bins = capacity, opened, -(-n // (capacity // size))
                opened += bins
            else:
                first, bins = runs[left].pop()
                if not runs[left]:
                    free.set(left, False)
            each = left // size
            whole = min(bins, n // each)
            if whole:
                rows.append((rank, whole, each, first, capacity - left))
                leave(first, whole, left - each * size)
                rank, n, first, bins = rank + whole * each, n - whole * each, first + whole, bins - whole
            if bins and 0 < n < each:
                rows.append((rank, 1, n, first, capacity - left))
                leave(first, 1, left - n * size)
                rank, n, first, bins = rank + n, 0, first + 1, bins - 1
            if bins:
                leave(first, bins, left)
        out[size] = np.array(rows, dtype=np.int64)
    return out


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of every whole text (null: empty) with END_ID at its end: PIECE_SCHEMA."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        end = np.array([END_ID], encode.dtype).tobytes()
        for batch in rows:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in tokens.batches(texts):
                cols: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(doc_ids[a:b], encode.encode(texts[a:b])):
                    whole = np.frombuffer(ids + end, encode.dtype).astype("<u4")
                    for k, begin in enumerate(range(0, len(whole), capacity)):
                        part = whole[begin : begin + capacity]
                        for col, x in zip(cols, (doc_id, k, begin, len(part), zlib.crc32(part.tobytes()))):
                            col.append(x)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column `length` from 1 to capacity) and their sequence_id and offset.

    `pieces` is read three times and should be a written table. Repeated rows are pieces of their own; any columns stay, but
    columns named sequence_id or offset are replaced and names that begin with `bf_` are for internal use. An empty table
    gives an empty result.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    total = pieces.count()
    cells = max(16, -(-total // ROWS_PER_CELL))
    keyed = pieces.withColumn("bf_cell", F.pmod(F.xxhash64(*[c for c in names if c != "bf_cell"]), F.lit(cells)).cast("int"))
    by_cell = keyed.groupBy("length", "bf_cell").agg(F.count("*").alias("bf_n"))
    ahead = Window.partitionBy("length").orderBy("bf_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = by_cell.withColumn("bf_before", F.coalesce(F.sum("bf_n").over(ahead), F.lit(0))).drop("bf_n")
    if cells <= 64:  # at most capacity * 64 rows of three numbers
        before = F.broadcast(before)
    own = Window.partitionBy("length", "bf_cell").orderBy(*[c for c in names if c != "length"])
    ranked = keyed.join(before, ["length", "bf_cell"]).withColumn("bf_rank", F.col("bf_before") + F.row_number().over(own) - 1)
    counts = {int(x["length"]): x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    shared = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, edges) if len(order) else ():
            size = int(length[part[0]])
            rows = shared.value[size]
            row = rows[np.searchsorted(rows[:, 0], rank[part], side="right") - 1]
            k = rank[part] - row[:, 0]
            seq[part] = row[:, 3] + k // row[:, 2]
            off[part] = row[:, 4] + k % row[:, 2] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("bf_at", place("length", "bf_rank")).select(*names, F.col("bf_at.sequence_id").alias("sequence_id"), F.col("bf_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(Staged(token_pieces(docs, vocabulary, capacity), "pieces").df, capacity)


def sequential_best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """What is left in each bin after plain best-fit decreasing, piece by piece: the measure for plan() in tests."""
    left: list[int] = []  # kept in order
    for size in sorted(lengths, reverse=True):
        at = bisect_right(left, size - 1)
        rest = (left.pop(at) if at < len(left) else capacity) - size
        left.insert(bisect_right(left, rest), rest)
    return left
