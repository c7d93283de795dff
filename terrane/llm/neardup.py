"""Near-duplicate documents by SetSketch registers, bands and a likelihood estimate, confirmed on full shingle sets.

1. Every text becomes its set of five-word shingles (64-bit hashes) and a sketch of M registers. Register i holds the largest
   floor(1 - log_B(h)) over the set, where h is exponential with rate A and drawn by (register, shingle): exponentially spaced,
   truncated minima. Sketches of parts merge by maximum, and equal registers are likely in proportion to the overlap.
2. Texts with equal sets form one class, kept as one node; copies take no further part until the end.
3. Groups of registers are band keys, in bands by which a pair at the threshold is missed with a chance below MISS. Nodes with
   a common key are candidates. In every bucket all members are first compared with one pivot, which is linear in the bucket:
   what the estimate does not rule out is counted on the full sets, with the pivot's set sent once for PIVOT_ROWS members.
4. These links give components. Buckets that still hold several components are searched on sketches: every pair across
   components is judged in its first common band, and nodes with a partner that the estimate does not rule out stay open. Only
   they are compared on full sets, all pairs of a bucket at once inside a task, by counts over their common shingles. A task
   gives the links that join two components in its view, fewer than it has nodes, and never a list of pairs.
5. The estimate maximises the joint likelihood of (registers greater, less, equal) for the known set sizes and is used with a
   margin of MARGIN standard errors; only counts on full sets make a link.

A bucket beyond CHUNK nodes (or VOLUME shingles) is dealt in parts, and a task takes two of them, so memory is bounded and no
pair is left out. Only members outside the bucket's largest component are compared with all, so a group whose members mostly
reach each other costs little; one whose members mostly do not costs its square within the tasks, though not in rows.

Components come from large-star and small-star steps on the links. Sets are built only for nodes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.staging import Staged, scratch

WORDS = 5
PERCENT = 85
M = 180
MISS = 1e-6
B, A, Q = 1.1, 20.0, 254
MARGIN = 5.0
CHUNK = 1024  # nodes of a part
VOLUME = 1 << 20  # shingles of a part, or one node's
PIVOT_ROWS = 512
DENSE = 8  # a shingle of more nodes is counted by matrices
BROADCAST_NODES = 500_000  # of three numbers
_MUL = np.random.default_rng(20240517).integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(71).integers(0, 2**63, M, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
NODE = "uid long, doc_id long, text_key long, n long, sig binary, sketch binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; fewer words: the whole sequence as one; none: empty."""
    from xxhash import xxh3_64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and ASCII letters only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def sketch(found: np.ndarray) -> np.ndarray:
    """M one-byte registers of a set of hashes; of an empty set all 0."""
    if not len(found):
        return np.zeros(M, np.uint8)
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, ((found[i : i + 512, None] ^ _ADD) * _MUL).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Most likely overlap (intersection by union) of pairs, given set sizes and the registers in which a is above or below b."""
    same = M - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    value = lambda j: more * np.log(p(u - v * j) + 1e-12) + less * np.log(p(v - u * j) + 1e-12) + same * np.log(1 - p(u - v * j) - p(v - u * j) + 1e-12)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(18):  # the likelihood is concave
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        up = value(c) < value(d)
        lo, hi = np.where(up, c, lo), np.where(up, hi, d)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Limit:
    """What follows from the least overlap of a link, in per cent."""

    percent: int

    def miss(self, rows: int) -> float:
        """Chance that a pair at the threshold has no common band of so many registers, for the set sizes that make it largest."""
        same = 1 + float(np.log1p(-(1 - self.percent / 100) * (B - 1) / B) / np.log(B))
        return (1 - same**rows) ** (M // rows)

    @cached_property
    def rows(self) -> int:
        """Registers in a band: the most by which few enough pairs are missed."""
        return max((r for r in range(1, M + 1) if M % r == 0 and self.miss(r) < MISS), default=1)

    @property
    def bands(self) -> int:
        return M // self.rows

    @cached_property
    def least(self) -> float:
        """The least estimate that does not rule a link out."""
        j = self.percent / 100
        return j - MARGIN * float(np.sqrt(j * (1 - j) / M))

    @cached_property
    def least_same(self) -> int:
        """No pair with fewer equal registers has an estimate of `least`, for any set sizes; counting them is cheaper than the
        estimate. Searched over all registers and a grid of sizes, and lowered by a twentieth for the sizes between."""
        sizes = np.linspace(self.percent / 100, 1, 11)
        for same in range(M, 0, -1):
            more, n = np.repeat(np.arange(M - same + 1), len(sizes)), np.tile(sizes, M - same + 1)
            if estimate(np.ones_like(n), n, more, M - same - more).max() < self.least:
                return int(0.95 * (same + 1))
        return 0

    def sizes(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether set sizes allow a link."""
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


def likely(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, limit: Limit) -> np.ndarray:
    """Estimates of pairs; -1 where set sizes rule a link out."""
    out = np.full(len(na), -1.0)
    fit = np.flatnonzero(limit.sizes(na, nb) & (np.minimum(na, nb) > 0))
    if len(fit):
        out[fit] = estimate(na[fit].astype(float), nb[fit].astype(float), (sa[fit] > sb[fit]).sum(1), (sa[fit] < sb[fit]).sum(1))
    return out


def _nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n, sig, regs = [], [], []
            for text in part.column(3).to_pylist():
                found = shingles(text)
                n.append(len(found))
                sig.append(len(found).to_bytes(8, "little") + found.sum(dtype=np.uint64).tobytes() + _mix(found + _STEP).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(_mix(found ^ _STEP)).tobytes() if len(found) else b"")
                regs.append(sketch(found).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(regs, pa.binary())], ["uid", "doc_id", "text_key", "n", "sig", "sketch"])


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], ["node", "set"])


def _grid(column: pa.Array) -> np.ndarray:
    """The sketches of a column as rows of registers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), M)


def _screen(rows: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, salt, na, nb, sa, sb) that the estimate does not rule out."""
    for batch in rows:
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        keep = likely(na, nb, _grid(batch.column(5)), _grid(batch.column(6)), limit) >= limit.least
        yield batch.select(["a", "b", "salt"]).filter(pa.array(keep))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable."""
    edges = Staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = edges.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.df.union(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))  # down: u > v, so these are the neighbours below
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        after = Staged(small.distinct(), "edges")
        edges.drop()
        edges = after
    roots = edges.df.groupBy("u").agg(F.min("v").alias("root"))
    return Staged(roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct()), "components").df


class _Search:
    """The nodes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, text: str, key: str, percent: int):
        self.limit = Limit(percent)
        self.docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
        numbered = self.docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text_key", "text")
        self.rows = Staged(numbered.mapInArrow(_nodes, NODE), "nodes").df
        self.repeats = not self.rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        first = F.min_by(F.struct("uid", "doc_id", "text_key", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
        classes = self.rows.filter("n > 0").groupBy("sig").agg(first.alias("f"), F.first("n").alias("n"))
        self.nodes = Staged(classes.select("sig", F.col("f.uid").alias("node"), "f.doc_id", "f.text_key", "f.sketch", "n"), "classes").df
        keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sketch", 1 + self.limit.rows * i, self.limit.rows)).alias("key")) for i in range(self.limit.bands)])
        banded = self.nodes.select("node", F.explode(keys).alias("k")).select("node", "k.band", "k.key")
        shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("size > 1")
        self.members = Staged(banded.join(shared, "key").select("key", "band", "size", "pivot", "node"), "members").df

    def sets(self, need: DataFrame) -> Staged:
        """(node, set) of the nodes named in need."""
        wanted = Staged(self.nodes.join(need.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key"), "wanted")
        own = wanted.df
        if own.count() <= BROADCAST_NODES:  # else both sides are dealt by key, and all texts move once
            own = F.broadcast(own)
        texts = self.docs.join(own, self.docs.doc_id.eqNullSafe(own.doc_id) & (self.docs.text_key == own.text_key)).select("node", "text")
        made = texts.mapInArrow(_sets, "node long, set array<long>")
        made = Staged(made.dropDuplicates(["node"]) if self.repeats else made, "sets")
        wanted.drop()
        return made

    def pivot_links(self) -> Staged:
        """Links of all nodes with the pivots of their buckets."""
        limit = self.limit
        pairs = self.members.filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("size").alias("size"))
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PIVOT_ROWS)).cast("int").alias("salt"))
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
        wide = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "salt", "na", "nb", "sa", "sb")
        near = Staged(wide.mapInArrow(lambda rows: _screen(rows, limit), "a long, b long, salt int"), "pairs")
        sets = self.sets(near.df.select(F.explode(F.array("a", "b")).alias("node")))
        others = near.df.join(sets.df.withColumnRenamed("node", "b"), "b").select("a", "salt", F.col("b").alias("node"), "set")
        pivots = near.df.select("a", "salt").distinct().join(sets.df.withColumnRenamed("node", "a"), "a").select("a", "salt", F.col("a").alias("node"), "set")
        groups = others.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"))
        links = Staged(groups.mapInArrow(lambda rows: _stars(rows, limit), "a long, b long"), "links")
        near.drop()
        sets.drop()
        return links

    def open_nodes(self, roots: DataFrame) -> Staged:
        """(key, node, root, main): members of buckets with several components that have a likely partner in another one."""
        limit = self.limit
        marked = self.members.filter("size > 2").join(roots, "node", "left").select("key", "band", "pivot", "node", F.coalesce("root", "node").alias("root"))
        sizes = marked.groupBy("key", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most")).filter("roots > 1")
        mixed = mixed.select("key", "main", "size", F.ceil((F.col("size") - F.col("most")) / CHUNK).cast("int").alias("parts"), F.ceil(F.col("most") / CHUNK).cast("int").alias("blocks"))
        own = marked.join(mixed, "key").join(self.nodes.select("node", F.col("n").alias("count"), "sketch"), "node")
        columns = ["key", "band", "pivot", "node", "root", "main", "count", "sketch"]
        whole = own.filter(F.col("size") <= CHUNK).select(*columns).repartition("key").sortWithinPartitions("key")
        found = whole.mapInArrow(lambda rows: _open_buckets(rows, limit), OPEN)
        spread = _dealt(own.filter(F.col("size") > CHUNK), columns)
        blocks = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda rows: _open_blocks(rows, limit), OPEN)
        return Staged(found.unionByName(blocks).distinct(), "open")

    def open_links(self, found: Staged) -> Staged:
        """Links between open nodes of one bucket that join two components in a task's view."""
        limit = self.limit
        sets = self.sets(found.df)
        counted = found.df.join(self.nodes.select("node", F.col("n").alias("count")), "node")
        main = F.col("root") == F.col("main")
        parts = lambda mine: F.greatest(F.ceil(F.count_if(mine) / CHUNK), F.ceil(F.sum(F.when(mine, F.col("count")).otherwise(0)) / VOLUME)).cast("int")
        sizes = counted.groupBy("key").agg(parts(~main).alias("parts"), parts(main).alias("blocks"))
        spread = _dealt(found.df.join(sizes, "key"), ["key", "node", "root"])
        groups = spread.join(sets.df, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        links = Staged(groups.select("key", "i", "j", "side", "node", "root", "set").mapInArrow(lambda rows: _joins(rows, limit), "a long, b long").distinct(), "links")
        sets.drop()
        return links

    def run(self) -> DataFrame:
        """(node, root) of all nodes that have a link."""
        near = self.pivot_links()
        roots = components(near.df)
        found = self.open_nodes(roots)
        more = self.open_links(found)
        if more.df.isEmpty():
            return roots
        stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(stars.unionByName(more.df))


OPEN = "key long, node long, root long, main long"


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of buckets (key, root, main, parts, blocks) in groups (key, i, j): a part of the members outside the main component
    with itself (side 0), with another part or with a block of the main component (sides 1 and 2)."""
    rows = rows.withColumn("other", F.col("root") != F.col("main"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("other"), F.col("parts")).otherwise(F.col("blocks")), F.lit(1))).cast("int"))
    upto = lambda first, last: F.when(F.col(last) > 0, F.sequence(F.lit(first), F.col(last) - (1 - first))).otherwise(F.array().cast("array<int>"))
    ways = F.when(F.col("other"), F.concat(
        F.transform(upto(0, "parts"), lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j"), F.when(k == F.col("at"), 0).when(F.col("at") < k, 1).otherwise(2).alias("side"))),
        F.transform(upto(1, "blocks"), lambda k: F.struct(F.col("at").alias("i"), (-k).alias("j"), F.lit(1).alias("side"))),
    )).otherwise(F.transform(upto(0, "parts"), lambda k: F.struct(k.alias("i"), (-F.col("at") - 1).alias("j"), F.lit(2).alias("side"))))
    return rows.select(*columns, F.explode(ways).alias("w")).select(*columns, "w.i", "w.j", "w.side")


def _groups(rows: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        edges = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            own = tuple(k[:, a].tolist())
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _set_rows(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [s.values.to_numpy(zero_copy_only=False) for chunk in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) for s in chunk]


def _stars(rows: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """Links of members with the pivot, whose set comes before theirs."""
    key, pivot = None, None
    for batch in rows:
        a, salt, node = (batch.column(i).to_numpy() for i in range(3))
        near: list[list[int]] = [[], []]
        for k, own in enumerate(_set_rows(batch.column(3))):
            if (a[k], salt[k]) != key:
                key, pivot = (a[k], salt[k]), None
            if node[k] == a[k]:
                pivot = np.sort(own)
            elif pivot is not None:
                at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                both = int((pivot[at] == own).sum())
                if 100 * both >= limit.percent * (len(own) + len(pivot) - both):
                    near[0].append(int(a[k]))
                    near[1].append(int(node[k]))
        yield _links(*near)


def _open_pairs(one: np.ndarray, two: np.ndarray, t: dict[str, np.ndarray], limit: Limit, open_: np.ndarray) -> None:
    """Marks the rows of pairs that the estimate does not rule out; a pair is judged in its first common band alone."""
    for k in range(0, len(one), 1 << 15):
        i, j = one[k : k + (1 << 15)], two[k : k + (1 << 15)]
        new = ~(open_[i] & open_[j])
        i, j = i[new], j[new]
        same = t["regs"][i] == t["regs"][j]
        near = np.flatnonzero(same.sum(1) >= limit.least_same)
        first = same[near].reshape(-1, limit.bands, limit.rows).all(2).argmax(1)
        near = near[first == t["band"][i[near]]]
        i, j = i[near], j[near]
        good = likely(t["count"][i], t["count"][j], t["regs"][i], t["regs"][j], limit) >= limit.least
        open_[i[good]] = open_[j[good]] = True


def _fits(i: np.ndarray, j: np.ndarray, t: dict[str, np.ndarray], limit: Limit) -> np.ndarray:
    """Pairs of different components, of sizes that allow a link, and without the bucket's pivot, which has been compared with all."""
    n, m = t["count"][i], t["count"][j]
    free = (t["node"][i] != t["pivot"][i]) & (t["node"][j] != t["pivot"][j])
    return free & (t["root"][i] != t["root"][j]) & limit.sizes(n, m)


def _columns(group: pa.Table) -> dict[str, np.ndarray]:
    t = {c: group.column(c).to_numpy() for c in ("key", "band", "node", "root", "main", "count", "pivot")}
    return t | {"regs": _grid(group.column("sketch").combine_chunks())}


def _opened(t: dict[str, np.ndarray], open_: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t[c][open_], pa.int64()) for c in ("key", "node", "root", "main")], ["key", "node", "root", "main"])


def _open_buckets(rows: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """Open rows of whole buckets, which come sorted by key: all buckets of a batch at once, by the distance of their rows."""

    def judged(part: pa.Table) -> pa.RecordBatch:
        t = _columns(part)
        open_, d = np.zeros(part.num_rows, bool), 1
        while d < part.num_rows and len(i := np.flatnonzero(t["key"][d:] == t["key"][:-d])):
            i = i[_fits(i, i + d, t, limit)]
            _open_pairs(i, i + d, t, limit, open_)
            d += 1
        return _opened(t, open_)

    held: pa.Table | None = None
    for batch in rows:
        part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = part.column("key").to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
        if last:
            yield judged(part.slice(0, last))
        held = part.slice(last)
    if held is not None and held.num_rows:
        yield judged(held)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with which rows; whether these are the same."""
    if (side == 0).any():
        every = np.arange(len(side))
        return every, every, True
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2), False


def _open_blocks(rows: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    for group in _groups(rows, ["key", "i", "j"]):
        t = _columns(group)
        left, right, alike = _sides(group.column("side").to_numpy())
        open_ = np.zeros(group.num_rows, bool)
        for k, i in enumerate(left):
            j = right[k + 1 :] if alike else right
            j = j[~(open_[i] & open_[j])]
            j = j[_fits(np.full(len(j), i), j, t, limit)]
            _open_pairs(np.full(len(j), i), j, t, limit, open_)
        yield _opened(t, open_)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets. Shingles of many sets are counted by matrices, the others pair by pair."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(values)))
    out = np.zeros(len(left) * len(right))
    at = [np.full(len(sets), -1), np.full(len(sets), -1)]
    at[0][left], at[1][right] = np.arange(len(left)), np.arange(len(right))
    held = np.repeat(times, times)
    few = np.flatnonzero((held > 1) & (held <= DENSE))
    v, o = values[few], owner[few]
    for d in range(1, DENSE):
        i = np.flatnonzero(v[d:] == v[:-d]) if len(v) > d else np.zeros(0, np.int64)
        for x, y in ((o[i], o[i + d]), (o[i + d], o[i])):
            x, y = at[0][x], at[1][y]
            fit = (x >= 0) & (y >= 0)
            if fit.any():
                np.add.at(out, x[fit] * len(right) + y[fit], 1)
    many = np.flatnonzero(times > DENSE)
    out = out.reshape(len(left), len(right))
    for k in range(0, len(many), 2048):
        some = many[k : k + 2048]
        dense = np.zeros((len(sets), len(some)), np.float32)
        for c, (a, n) in enumerate(zip(begin[some], times[some])):
            dense[owner[a : a + n], c] = 1
        out += dense[left] @ dense[right].T
    return out


def _joins(rows: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    """Of the links in a group those that join two components there: fewer than it has rows."""
    for group in _groups(rows, ["key", "i", "j"]):
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        left, right, alike = _sides(group.column("side").to_numpy())
        if not len(left) or not len(right) or len(node) < 2:
            continue
        sets = _set_rows(group.column("set"))
        n = np.array([len(s) for s in sets])
        both = common_counts(sets, left, right)
        linked = 100 * both >= limit.percent * (n[left][:, None] + n[right] - both)
        i, j = np.nonzero(linked)
        i, j = left[i], right[j]
        across = (root[i] != root[j]) & ((i < j) | (not alike))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = x = up.get(above, above)
            return x

        near: list[list[int]] = [[], []]
        for x, y in zip(i[across].tolist(), j[across].tolist()):
            p, q = top(int(root[x])), top(int(root[y]))
            if p != q:
                up[p] = q
                near[0].append(int(node[x]))
                near[1].append(int(node[y]))
        yield _links(*near)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, text_key (hash of the text), n_shingles, component_id, kept.

    Texts whose shingle sets overlap by `percent` or more (intersection by union) are linked.

    component_id is the smallest doc_id reachable over links, the row's own where it has none; null only where no row of the
    component has an id. kept: doc_id = component_id (nulls equal). Null, empty and blank texts have no shingles and are
    linked with nothing. Rows with equal ids are rows of their own, so several may be kept. Other columns are not read. An
    empty table gives an empty one.
    """
    with scratch():
        search = _Search(docs, text, key, percent)
        roots = search.run()
        named = search.nodes.join(roots, "node", "left").select("sig", "doc_id", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_sig = named.join(least, "root").select("sig", "component_id")
        out = search.rows.drop("sketch").join(by_sig, "sig", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        out = out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
        return Staged(out, "near-duplicates").keep().df
