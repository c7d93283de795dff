"""Approximate nearest neighbours with balanced posting lists, a centroid graph and distance-ratio pruning.

Fit: a sample of about SAMPLE vectors, or SAMPLE_A_LIST for each list (those with the smallest hashes of vec_id), gives centroids
by k-means, about as many as the square root of the table, at most LISTS: beyond LISTS^2 vectors lists grow longer, and they are
chunked. Clusters above BALANCE times the mean that this number asks for are split until none is left but copies of one vector.
Centroids are linked to their nearest neighbours, and this graph is sent to all tasks.

The graph is searched for a batch of vectors at once: from a few entries on, all centroids found so far within the asked ratio
of the nearest are expanded, until none is left unexpanded.

Index: every vector goes to its nearest centroid's list, and boundary vectors also to the lists of centroids nearly as near
(within REPLICATE), up to REPLICAS lists in all. A centroid is skipped if it lies close to one already chosen, within APART of
its distance to the vector, as their lists would serve the same queries. Lists are stored in chunks of bounded size, so a list
that a very common vector fills is spread over tasks.

Search: a query visits the lists whose centroid is within a ratio of its nearest centroid. The ratio is fitted to the sample:
the least by which TARGET of the k nearest sampled vectors of CALIBRATE of them are found in lists. In clustered data these
lists are few; in unstructured data, where all distances are alike, they are many. Where they do not surely hold k other vectors
(a query on or next to the centroid of few), the bound is taken from the distance at which lists do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

SAMPLE = 20_000
SAMPLE_A_LIST = 8
LISTS = 16_000
NEIGHBOURS = 16
BALANCE = 2.0
REPLICATE = 0.05
REPLICAS = 2
APART = 0.5
TARGET = 0.97
CALIBRATE = 512
BATCH = 256
CHUNK = 4_096
QUERY_CHUNK = 1_024
LEAST_VISITS = 8


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])


def _means(x: np.ndarray, near: np.ndarray, c: np.ndarray) -> np.ndarray:
    size, sums = np.bincount(near, minlength=len(c)), np.zeros_like(c)
    np.add.at(sums, near, x)
    return np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means centroids; a cluster above BALANCE * len(x) / lists becomes two, until none is left that holds different vectors."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(rounds):
        c = _means(x, _nearest(x, c), c)
    while True:
        near = _nearest(x, c)
        size, more = np.bincount(near, minlength=len(c)), []
        for k in np.flatnonzero(size > max(1, BALANCE * len(x) / lists)):
            own = x[near == k]
            pair = own[[0, _distances(own, own[:1])[:, 0].argmax()]]
            if (pair[0] == pair[1]).all():
                continue
            for _ in range(3):
                pair = _means(own, _nearest(own, pair), pair)
            c[k] = pair[0]
            more.append(pair[1])
        if not more:
            return c
        c = np.concatenate([c, more])


class CentroidGraph:
    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS):
        self.c = centroids
        k = min(neighbours, max(0, len(centroids) - 1))
        near: list[set[int]] = [set() for _ in centroids]
        for i in range(0, len(centroids), 1024):
            d = _distances(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            for r, row in enumerate(np.argpartition(d, k - 1, axis=1)[:, :k] if k else []):
                for j in row.tolist():  # both ways, so that no centroid is out of reach of its neighbours
                    near[i + r].add(j)
                    near[j].add(i + r)
        self.first = np.cumsum([0, *map(len, near)])
        self.near = np.array([j for s in near for j in sorted(s)], np.int64)
        self.entries = np.unique(np.linspace(0, max(0, len(centroids) - 1), max(1, int(np.sqrt(len(centroids))))).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of vectors (rows) to the centroids found within (1 + ratio) of their nearest; infinite for the others."""
        dist = np.full((len(x), len(self.c)), np.inf)
        dist[:, self.entries] = _distances(x, self.c[self.entries])
        done = np.zeros(dist.shape, bool)
        while True:
            bound = dist.min(1, keepdims=True) * (1 + ratio)
            least = np.sort(np.partition(dist, min(LEAST_VISITS, dist.shape[1]) - 1, axis=1)[:, :LEAST_VISITS], axis=1)[:, -1:]
            row, at = np.nonzero(~done & (dist <= np.maximum(bound, least)) & np.isfinite(dist))
            if not len(row):
                return np.where(dist <= bound, dist, np.inf)
            done[row, at] = True
            n = self.first[at + 1] - self.first[at]
            to = self.near[np.repeat(self.first[at + 1] - np.cumsum(n), n) + np.arange(n.sum())]
            row = np.repeat(row, n)
            new = np.isinf(dist[row, to])
            pairs = np.unique(row[new] * len(self.c) + to[new])
            for i in range(0, len(pairs), 1 << 14):
                row, to = np.divmod(pairs[i : i + (1 << 14)], len(self.c))
                dist[row, to] = np.sqrt(((x[row] - self.c[to]) ** 2).sum(1))

    def visits(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that queries read: those within (1 + ratio) of the nearest centroid; where they hold fewer than
        `least` vectors, within (1 + ratio) of the centroid with which the nearest lists hold so many; all if they never do."""
        found = np.isfinite(self.search(x, ratio))
        for r in np.flatnonzero(found @ sizes < least):
            d = np.sqrt(((self.c - x[r]) ** 2).sum(1))
            order = np.argsort(d, kind="stable")
            last = int(np.searchsorted(np.cumsum(sizes[order]), least))
            found[r] = d <= (np.inf if last >= len(order) else d[order[last]] * (1 + ratio))
        return np.nonzero(found)

    def stores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is the nearest) of the lists that store vectors."""
        dist = self.search(x, REPLICATE)
        ranks = min(4 * REPLICAS, len(self.c))
        near = np.argsort(dist, axis=1, kind="stable")[:, :ranks]
        d = np.take_along_axis(dist, near, 1)
        taken = np.zeros(d.shape, bool)
        taken[:, 0] = True
        for r in range(1, ranks):
            fit = np.isfinite(d[:, r]) & (taken.sum(1) < REPLICAS)
            for s in range(r):
                rows = np.flatnonzero(fit & taken[:, s])
                gap = np.sqrt(((self.c[near[rows, s]] - self.c[near[rows, r]]) ** 2).sum(1))
                fit[rows[gap <= APART * d[rows, r]]] = False
            taken[:, r] = fit
        row, rank = np.nonzero(taken)
        return row, near[row, rank], rank == 0


def fitted_ratio(graph: CentroidGraph, x: np.ndarray, k: int) -> float:
    """The ratio by which TARGET of the k nearest others of the first vectors of a sample stand in lists that these visit."""
    need = []
    for at in range(0, min(CALIBRATE, len(x)), BATCH):
        q = x[at : min(at + BATCH, CALIBRATE)]
        d = _distances(q, x)
        d[np.arange(len(q)), at + np.arange(len(q))] = np.inf
        most = min(k, len(x) - 1)
        if not most:
            return 0.0
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        far = _distances(q, graph.c)
        far = far / np.maximum(far.min(1, keepdims=True), 1e-12) - 1
        for r, own in enumerate(near):
            row, lists, _ = graph.stores(x[own])
            least = np.full(len(own), np.inf)
            np.minimum.at(least, row, far[r, lists])
            need.append(least)
    # a query on a centroid has no ratio; it is served by the size of its lists
    found = np.concatenate(need)
    return float(min(np.quantile(found, TARGET), 10.0)) + 1e-9


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v as doubles) of rows that take part: id and vector not null, not zero, all components finite."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assign(rows: Iterator[pa.RecordBatch], graph: CentroidGraph, sizes: np.ndarray | None = None, least: int = 0, ratio: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Rows by list: those that store them, the nearest as `own`, or with sizes (ids of own rows by list) those that a query visits."""
    dim = graph.c.shape[1]
    for batch in rows:
        every, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
        for at in range(0, len(every), BATCH):
            x = every[at : at + BATCH]
            if sizes is None:
                row, lists, own = graph.stores(x)
            else:
                row, lists = graph.visits(x, ratio, sizes, least)
                own = np.zeros(len(row), bool)
            for i in range(0, len(row), 4096):
                r = row[i : i + 4096]
                v = pa.array([v.tobytes() for v in x[r]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lists[i : i + 4096].astype(np.int32)), pa.array(ids[at + r]), v, pa.array(own[i : i + 4096])], ["list", "vec_id", "v", "own"])


def nearest_in(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, exact distances) of the k nearest other vectors; ties to the smaller id, and of rows with one id the nearest."""
    for i in range(0, len(q), 64):
        rough = _distances(q[i : i + 64], x)
        for r, row in enumerate(rough):
            row[ids == q_ids[i + r]] = np.inf
            rows = k
            while True:
                top = np.partition(row, rows - 1)[rows - 1] if len(row) > rows else np.inf
                at = np.flatnonzero((row <= top + 1e-6 * (1 + abs(top))) & np.isfinite(row)) if np.isfinite(top) else np.flatnonzero(np.isfinite(row))
                exact = np.sqrt(((x[at] - q[i + r]) ** 2).sum(1))
                order = np.lexsort((ids[at], exact))
                best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
                if len(best) == k or rows >= len(row):
                    break
                rows *= 2  # an id stood on several of these rows
            yield int(q_ids[i + r]), ids[at][best], exact[best]


def _probe(queries: pa.Table, members: pa.Table, dim: int, k: int) -> pa.Table:
    cols: list[list] = [[], [], []]
    if queries.num_rows and members.num_rows:
        get = lambda t: (np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, dim), t.column("vec_id").to_numpy())
        for q, ids, d in nearest_in(*get(queries), *get(members), k):
            cols[0] += [q] * len(ids)
            cols[1] += ids.tolist()
            cols[2] += d.tolist()
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows found for every row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision, ties to the smaller id. Rows with equal ids are one vector to each
    other: a query is never its own neighbour, and of neighbours with one id the nearest counts. Vectors that are null or
    zero or hold null or non-finite components take no part, nor do those whose length is not the most frequent one (the
    shortest of such). No usable vector or query: an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = usable(vectors, vec_id, embedding)
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    if lengths is None:
        return empty
    dim, n = lengths
    rows = Staged(fine.filter(F.size("v") == dim), "vectors").df
    count = int(min(LISTS, max(1, n // SAMPLE_A_LIST), max(8, np.sqrt(n))))
    most = max(SAMPLE, SAMPLE_A_LIST * count)
    drawn = F.xxhash64("vec_id")
    share = min(1.0, 1.2 * most / n)  # so the rows that are sorted for the sample do not grow with the table
    some = rows.filter(F.shiftrightunsigned(drawn, 11) < int(share * 2**53)).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = some.orderBy(drawn, "vec_id").limit(most).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks(), dim)
    built = CentroidGraph(balanced_centroids(x, count))
    ratio, graph = fitted_ratio(built, x, k), spark.sparkContext.broadcast(built)
    placed = "list int, vec_id long, v binary, own boolean"
    lists = Staged(rows.mapInArrow(lambda b: _assign(b, graph.value), placed), "postings").df
    holds = np.zeros(len(graph.value.c), np.int64)
    for r in lists.filter("own").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().toLocalIterator():  # a row per list
        holds[r["list"]] = r["count"]
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    probes = Staged(asked.mapInArrow(lambda b: _assign(b, graph.value, holds, k + 1, ratio), placed), "probes").df
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row per list
    asks = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("asks"))
    both = F.broadcast(sizes.join(asks, "list"))
    spread = lambda column, own: (F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(column))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = lists.join(both, "list").select("list", spread("chunk", "chunks"), upto("asks").alias("ask"), "vec_id", "v")
    wanted = probes.join(both, "list").select("list", upto("chunks").alias("chunk"), spread("ask", "asks"), "vec_id", "v")
    keys = ["list", "chunk", "ask"]
    found = wanted.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(lambda q, m: _probe(q, m, dim, k), "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # replicas
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return single.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
