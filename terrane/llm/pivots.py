"""Near-duplicate vectors of one label by a pivot-permutation index.

1. Reference points: means of close vectors of a bounded sample, at least SEPARATE apart, about twice the square root of the table,
   at most POINTS. Every vector is described by its NEAREST ones, in order.
2. Inverted lists, one for each (label, reference point), hold the vectors described by it. Two vectors that share SHARED points
   also share one of the first NEAREST - SHARED + 1 of each by number, so only these lists are written. Inside a list the
   points that two vectors share are counted, pairs with SHARED or more are candidates, and a candidate is verified by the
   cosine of the whole vectors, in the list of the smallest point that both share and in no other.
3. A group of very close vectors needs no pairs: reference points more than four half angles of a link apart have a core, the
   vectors within half the angle. All vectors of a core are linked with each other (the angle obeys the triangle inequality),
   vectors of two cores never are, and only the vectors of the shell around a core (within one and a half angles) are
   compared with its members. Links within a core are counted by its size.
4. A list beyond CHUNK vectors is dealt in parts, and a task compares two of them. A task gives each vector's number of links and
   one link to the first vector of its component in the task's view, never pairs; components are made of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.neardup import components
from terrane.llm.staging import Staged, scratch

COSINE = 0.98
SAMPLE = 20_000
POINTS = 4_096
NEAREST = 6
SHARED = 2
CHUNK = 4_096
BESIDE = 1_024  # rows of a block of cosines
SALTS = 16
EDGE = 1e-7  # of an angle; what is nearer to a bound is compared
FREE, SHELL, CORE = 0, 1, 2


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


class References:
    """Reference points of a sample of unit vectors; `cored` marks those that have a core."""

    def __init__(self, x: np.ndarray, count: int, angle: float, seed: int = 3):
        self.angle = angle
        left, points = np.ones(len(x), bool), np.zeros((0, x.shape[1]))
        for i in np.random.default_rng(seed).permutation(len(x)):
            if len(points) == count:
                break
            if not left[i]:
                continue
            near = x @ x[i] >= np.cos(angle)
            mean = units(x[near].mean(0, keepdims=True))
            left[i] = False
            if not len(points) or angles(mean, points).min() > angle / 2:
                points = np.concatenate([points, mean])
                left &= x @ mean[0] < np.cos(angle / 2)
        self.points = points
        dense = np.array([(x @ p >= np.cos(angle / 2)).sum() for p in points])
        self.cored = np.zeros(len(points), bool)
        for i in np.argsort(-dense, kind="stable"):
            self.cored[i] = not self.cored.any() or angles(points[i : i + 1], points[self.cored]).min() > 2 * angle + EDGE

    def describe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: nearest reference points in order, the core (-1: none), and which shells they stand in."""
        a = angles(x, self.points)
        near = np.argsort(a, axis=1, kind="stable")[:, :NEAREST]
        held = np.where(self.cored, a, np.inf)
        core = np.where(held.min(1) <= self.angle / 2 - EDGE, held.argmin(1), -1)
        return near, core, (held <= 1.5 * self.angle + EDGE) & (core < 0)[:, None]


def _vectors(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)


def _describe(rows: Iterator[pa.RecordBatch], refs: References, dtype: str) -> Iterator[pa.RecordBatch]:
    """(uid, label, point, kind, near, v): a row for each list in which a vector stands."""
    for batch in rows:
        for at in range(0, batch.num_rows, BESIDE):
            part = batch.slice(at, BESIDE)
            flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.float64).reshape(part.num_rows, -1)
            near, core, shell = refs.describe(units(x))
            low = np.sort(near, axis=1)
            lists = low[:, : max(1, low.shape[1] - SHARED + 1)]
            free = np.flatnonzero(core < 0)
            in_core, (ring, ring_point) = np.flatnonzero(core >= 0), np.nonzero(shell)
            row = np.concatenate([np.repeat(free, lists.shape[1]), ring, in_core])
            point = np.concatenate([lists[free].ravel(), ring_point, core[in_core]])
            kind = np.repeat([FREE, SHELL, CORE], [lists.shape[1] * len(free), len(ring), len(in_core)])
            raw = [v.tobytes() for v in flat.astype(dtype).reshape(part.num_rows, -1)]
            desc = [v.tobytes() for v in low.astype("<i2")]
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(point, pa.int32()), pa.array(kind, pa.int32()),
                pa.array([desc[r] if k == FREE else b"" for r, k in zip(row, kind)], pa.binary()), pa.array([raw[r] for r in row], pa.binary()),
            ], ["uid", "label", "point", "kind", "near", "v"])


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points that the descriptions (rows of sorted point numbers) of a and b share."""
    names, at = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    marks = np.zeros((len(a) + len(b), len(names)), np.float32)
    np.put_along_axis(marks, at.reshape(len(a) + len(b), -1), 1, axis=1)
    return marks[: len(a)] @ marks[len(a) :].T


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest point that the descriptions of pairs (row by row) share."""
    same = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(same, a, np.iinfo(a.dtype).max).min(1)


class _Found:
    """Links of a group's rows: numbers by row and components."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, 1)
        np.add.at(self.count, j, 1)
        while len(i):  # the larger root takes the smaller one's name
            a, b = self.up[i], self.up[j]
            while (self.up[a] != a).any() or (self.up[b] != b).any():
                a, b = self.up[a], self.up[b]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def _links(group: pa.Table, least: float, dtype: str) -> pa.Table:
    """(uid, n, root) of the rows of a group (two parts of a list, or one with itself) that have links there."""
    group = group.combine_chunks()
    uid, side, kind = (group.column(c).to_numpy() for c in ("uid", "side", "kind"))
    x, point = units(_vectors(group.column("v"), dtype)), int(group.column("point")[0].as_py())
    alike = bool((side == 0).any())
    left, right = (np.arange(len(uid)),) * 2 if alike else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    free = bool(len(kind)) and (kind == FREE).all()
    near = np.frombuffer(b"".join(group.column("near").to_pylist()), "<i2").reshape(len(uid), -1) if free else None
    found = _Found(len(uid))
    for p in range(0, len(left), BESIDE):
        i = left[p : p + BESIDE]
        for q in range(p if alike else 0, len(right), BESIDE):
            j = right[q : q + BESIDE]
            fit = np.ones((len(i), len(j)), bool) if near is None else shared_counts(near[i], near[j]) >= min(SHARED, near.shape[1])
            fit &= x[i] @ x[j].T >= least
            a, b = np.nonzero(fit)
            a, b = i[a], j[b]
            if alike:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 16):
                s, t = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                if near is not None:
                    own = first_shared(near[s], near[t]) == point
                    s, t = s[own], t[own]
                found.add(s, t)
    has = np.flatnonzero(found.count)
    return pa.table([pa.array(uid[has]), pa.array(found.count[has]), pa.array(uid[found.roots()[has]])], ["uid", "n", "root"])


def _dealt(lists: DataFrame) -> DataFrame:
    """Rows of the lists in groups (label, point, i, j) of at most two parts: free ones with free ones, shells with cores. Lists
    without a pair to compare are left out before any vector moves."""
    count = lambda k: F.count_if(F.col("kind") == k)
    parts = lambda k: F.ceil(count(k) / CHUNK).cast("int")
    sizes = lists.groupBy("label", "point").agg(count(FREE).alias("free"), count(SHELL).alias("ring"), count(CORE).alias("inside"), *[parts(k).alias(f"p{k}") for k in (FREE, SHELL, CORE)])
    sizes = Staged(sizes.filter("free > 1 OR (ring > 0 AND inside > 0)"), "lists").df
    wide = sizes.select("label", "point", "free", "ring", "inside", "p0", "p1", "p2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("uid", "kind"), F.lit(SALTS)).cast("int"))
    rows = salted.join(wide, ["label", "point", "salt"])
    rows = rows.filter(F.when(F.col("kind") == FREE, F.col("free") > 1).otherwise((F.col("ring") > 0) & (F.col("inside") > 0)))
    own = F.when(F.col("kind") == FREE, F.col("p0")).when(F.col("kind") == SHELL, F.col("p1")).otherwise(F.col("p2"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("uid"), own).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1)
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    at = F.col("at")
    free = F.transform(upto("p0"), lambda k: group(F.least(at, k), F.greatest(at, k), F.when(k == at, 0).when(at < k, 1).otherwise(2)))
    shell = F.transform(upto("p2"), lambda k: group(at, -k - 1, 1))
    core = F.transform(upto("p1"), lambda k: group(k, -at - 1, 2))
    ways = F.when(F.col("kind") == FREE, free).when(F.col("kind") == SHELL, shell).otherwise(core)
    return rows.select("uid", "label", "point", "kind", "near", "v", F.explode(ways).alias("w")).select("uid", "label", "point", "kind", "near", "v", "w.i", "w.j", "w.side")


def near_duplicate_vectors(vectors: DataFrame, least: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row of vectors: vec_id, n_links (other vectors of its label with a cosine of `least` or more), component_id, kept.

    component_id is the smallest vec_id reachable over links, the row's own where it has none; null only where no row of the component
    has an id. kept: vec_id = component_id (nulls equal), so rows with equal ids may all be kept. Rows that are repeated are vectors
    of their own, linked with each other. Vectors that are null or zero or hold null or non-finite components, and rows
    without a label, link with nothing; nor do vectors whose length is not the most frequent one (the shortest of such). Other columns
    are not read. An empty table gives an empty one. Ids are whole numbers.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    dtype, held = ("<f4", "array<float>") if kind == "float" else ("<f8", "array<double>")
    v = F.col(embedding).cast(held)
    fine = F.coalesce(F.col(label).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    with scratch():
        rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(fine, v).alias("v"))
        rows = Staged(rows, "vectors").df
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        lengths = rows.filter("v IS NOT NULL").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
        if lengths is None:
            return Staged(alone, "near-vectors").keep().df
        dim, n = lengths
        usable = rows.filter(F.size("v") == dim).select("uid", "label", "v")
        drawn = F.xxhash64("uid")
        share = min(1.0, 1.2 * SAMPLE / n)  # so the rows that are sorted for the sample do not grow with the table
        sample = usable.filter(F.shiftrightunsigned(drawn, 11) < int(share * 2**53)).orderBy(drawn).limit(SAMPLE).select("v").toArrow()
        x = units(sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        refs = spark.sparkContext.broadcast(References(x, int(min(POINTS, max(16, 2 * np.sqrt(n)))), float(np.arccos(least))))
        lists = usable.mapInArrow(lambda b: _describe(b, refs.value, dtype), "uid long, label string, point int, kind int, near binary, v binary")
        lists = Staged(lists, "pivot-lists").df
        found = _dealt(lists).groupBy("label", "point", "i", "j").applyInArrow(lambda t: _links(t, least, dtype), "uid long, n long, root long")
        found = Staged(found, "vector-links").df
        cores = lists.filter(F.col("kind") == CORE).groupBy("label", "point").agg(F.count("*").alias("inside"), F.min("uid").alias("root")).filter("inside > 1")
        cores = cores.select("label", "point", "inside", "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        inner = lists.filter(F.col("kind") == CORE).select("uid", "label", "point", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt")).join(cores, ["label", "point", "salt"])
        links = Staged(found.unionByName(inner.select("uid", (F.col("inside") - 1).alias("n"), "root")), "vector-links").df
        counts = links.groupBy("uid").agg(F.sum("n").alias("n_links"))
        roots = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
        named = rows.select("uid", "vec_id").join(roots, "uid", "left").join(counts, "uid", "left")
        named = named.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
        least_id = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component_id"))
        least_id = least_id.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        out = named.join(least_id, ["root", "salt"], "left")
        component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return Staged(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near-vectors").keep().df


SQL = """
WITH RECURSIVE r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
