"""Sharding by histogram sort: splitters found by exact counts below candidate keys, then one exchange.

Documents are ordered by (hash of the text, hash of the id), so equal texts stand together and a shard is a random sample of
the corpus. For every splitter wanted, candidate keys (probes) are spread over the interval that is known to hold it; one pass
over the narrow table of keys and sizes counts the exact bytes below every probe, each partition adding up its own; the
intervals shrink to the neighbours of the targets, and passes go on until every splitter is within the tolerance or stands
beside a single document. Only probe counts, of a fixed number, come to the driver. Between shard splitters lie further ones,
of which less is asked, so that the sort within a shard is spread over several tasks.

Equal texts share a shard unless a whole group does not fit within the tolerance; then it is cut by the hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

TOLERANCE = 0.002  # of a shard
CELLS = 16  # parts of a shard that are sorted on their own, at least
CELL_BYTES = 128 << 20  # of a part, in large shards
MOST_CELLS = 32_768
PROBES = 1 << 14  # candidate keys a pass
TOP = 1 << 63


def _keys(df: DataFrame, text: str, key: str) -> DataFrame:
    first, second = F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))), F.xxhash64(F.col(key))
    return df.withColumns({"hs_k1": F.shiftrightunsigned(first, 1), "hs_k2": F.shiftrightunsigned(second, 1)})


def below(probes1: np.ndarray, probes2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """How many probes (in order) are at or below each key."""
    lo, hi = np.searchsorted(probes1, k1, "left"), np.searchsorted(probes1, k1, "right")
    rank = lo.copy()
    for at in np.flatnonzero(lo < hi) if (hi > lo).sum() < 64 else ():
        rank[at] = lo[at] + np.searchsorted(probes2[lo[at] : hi[at]], k2[at], "right")
    if (hi > lo).sum() >= 64:  # many rows with few first keys
        rows = np.flatnonzero(lo < hi)
        for a in np.unique(lo[rows]):
            own = rows[lo[rows] == a]
            rank[own] = a + np.searchsorted(probes2[a : hi[own[0]]], k2[own], "right")
    return rank


def _count(rows: Iterator[pa.RecordBatch], p1: np.ndarray, p2: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums, counts = np.zeros(len(p1) + 1, np.int64), np.zeros(len(p1) + 1, np.int64)
    for batch in rows:
        k1, k2, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        rank = below(p1, p2, k1, k2)
        np.add.at(sums, rank, size)
        counts += np.bincount(rank, minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at]), pa.array(counts[at])], ["at", "size", "n"])


def exact_below(narrow: DataFrame, probes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""
    shared = narrow.sparkSession.sparkContext.broadcast((np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)))
    parts = narrow.mapInArrow(lambda rows: _count(rows, *shared.value), "at long, size long, n long")
    sums, counts = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for at, size, n in parts.groupBy("at").agg(F.sum("size"), F.sum("n")).collect():  # a row per probe at most
        sums[at], counts[at] = size, n
    out, s, n = {}, 0, 0
    for i, p in enumerate(probes):
        s, n = s + sums[i], n + counts[i]
        out[p] = (s, n)
    return out


def splitters(narrow: DataFrame, total: tuple[int, int], targets: list[float], tolerances: list[float]) -> list[tuple]:
    """For each target in bytes, ((k1, k2), bytes below, rows below) of a splitter near it."""
    start, end = (0, 0), (TOP - 1, TOP - 1)
    state = [[(start, 0, 0), (end, *total)] for _ in targets]
    found: list[tuple | None] = [None] * len(targets)
    while any(f is None for f in found):
        open_ = [i for i, f in enumerate(found) if f is None]
        spans = {(state[i][0][0], state[i][1][0]) for i in open_}
        each = max(2, PROBES // len(spans))
        probes = set()
        for (a1, a2), (b1, b2) in spans:
            if b1 - a1 > 1 or (b1 > a1 and b2 > 0):
                step = max(1, (b1 - a1) // each)
                probes.update((k, 0) for k in range(a1 + step, b1 + 1, step))
                if b1 - a1 <= each:
                    probes.update((k, 0) for k in range(a1 + 1, b1 + 1))
            else:  # within the copies of one text
                top = b2 if b1 == a1 else TOP - 1
                step = max(1, (top - a2) // each)
                probes.update((a1, k) for k in range(a2 + step, top + 1, step))
        got = sorted((p, *v) for p, v in exact_below(narrow, sorted(probes)).items()) if probes else []
        for i in open_:
            lo, hi = state[i]
            inside = [g for g in got if lo[0] < g[0] < hi[0]]
            near = min([lo, hi, *inside], key=lambda g: abs(g[1] - targets[i]))
            lower = max([g for g in inside if g[1] <= targets[i]], default=lo)
            upper = min([g for g in inside if g[1] > targets[i]], default=hi)
            if abs(near[1] - targets[i]) <= tolerances[i] or upper[2] - lower[2] <= 1 or (lower, upper) == (lo, hi):
                found[i] = near
            state[i] = [lower, upper]
    return found


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size (bytes of the text plus 1), shard (from 0) and slot (place in the shard, gapless from 0).

    Shards have nearly equal sums of size: within `tolerance` of a shard or one document. Null texts count as empty ones; rows
    equal in text and key stay together, in any order; an empty table gives an empty one. Columns size, shard and slot are
    replaced, and names that begin with `hs_` are for internal use.
    """
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    keyed = _keys(docs.select(*names, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")), text, key)
    narrow = Staged(keyed.select("hs_k1", "hs_k2", "size"), "keys").df
    total = tuple(narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).head())
    cells = max(CELLS, min(-(-total[0] // shards // CELL_BYTES), MOST_CELLS // shards))
    n = shards * cells
    targets = [total[0] * i / n for i in range(1, n)]
    tolerances = [total[0] / shards * (tolerance if i % cells == 0 else 0.25 / cells) for i in range(1, n)]
    cuts = [((0, 0), 0, 0), *splitters(narrow, total, targets, tolerances)]
    order = sorted(range(n), key=lambda i: (cuts[i][0], i))
    if order != list(range(n)):  # splitters of tiny tables may meet
        cuts = [max(cuts[: i + 1]) for i in range(n)]
    p1, p2 = (np.array([c[0][j] for c in cuts], np.int64) for j in (0, 1))
    begin = np.array([cuts[i][2] - cuts[i // cells * cells][2] for i in range(n)], np.int64)

    @F.pandas_udf("struct<cell int, begin long>")
    def cell(k1, k2):
        import pandas as pd

        at = below(p1, p2, k1.to_numpy(), k2.to_numpy()) - 1
        return pd.DataFrame({"cell": at.astype(np.int32), "begin": begin[at]})

    dealt = keyed.withColumn("hs_at", cell("hs_k1", "hs_k2")).withColumn("hs_cell", F.col("hs_at.cell"))
    place = F.row_number().over(Window.partitionBy("hs_cell").orderBy("hs_k1", "hs_k2", "size"))
    return dealt.select(*names, "size", F.floor(F.col("hs_cell") / cells).cast("int").alias("shard"), (F.col("hs_at.begin") + place - 1).alias("slot"))
