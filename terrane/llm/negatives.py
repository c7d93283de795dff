"""Hard negatives by a full sort of every anchor's scores.

Vectors are whole numbers, so scores are exact whatever the order of addition. Rows are dealt to blocks of at most BLOCK by a hash
of their id; a task holds one block and takes all anchors through it, a few at a time. Every anchor's scores of a block are
sorted whole, by score and then by id. Twice: first for its positives, of which the best of each block are merged; then, for
each positive's score, a binary search gives the first row at or below the upper limit among the rows of other labels, and the
next few down to the lower limit are read off; the best of each block are merged again.

A row stands in one block alone; what is copied are anchors, once for each block, so memory is bounded by a block and no label
or score decides where a row goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.staging import Staged, scratch

BLOCK = 65_536
LEAST_BLOCK = 1_024
TOGETHER = 64  # anchors scored at once


def whole_vectors(vectors: DataFrame, label: Column, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows that take part, with components floor(scale * x); of several rows with one id the one with the least
    label, then vector. Rows with a null id, label or vector, or any null or non-finite component take no part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(scale * x)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _packed(rows: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        v = batch.column(2)
        size = len(v[0]) if batch.num_rows else 0
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, size)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in flat], pa.binary())], ["vec_id", "label", "q"])


def _matrix(column: pa.Array, dtype: str, work: type) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1).astype(work)


def ordered(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of rows, higher scores first, ties to the smaller id."""
    return np.lexsort((ids, -scores))


def within(sorted_scores: np.ndarray, positive: int, k: int) -> slice:
    """Of falling scores the first k from the positive's upper limit (95 %) down that are not below its lower one (50 %)."""
    first = int(np.searchsorted(-100 * sorted_scores, -95 * positive, side="left"))
    last = int(np.searchsorted(-100 * sorted_scores, -50 * positive, side="right"))
    return slice(first, max(first, min(last, first + k)))


def _blocks(rows: Iterator[pa.RecordBatch], dtype: str, work: type) -> Iterator[tuple]:
    """(members' labels, ids, matrix; anchors; anchors' scores) of each block, for a few anchors at a time: members come first."""
    block, held, ready = None, [], None
    for batch in rows:
        number, anchor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "anchor"))
        at = 0
        while at < batch.num_rows:
            other = np.flatnonzero((number[at:] != number[at]) | (anchor[at:] != anchor[at]))
            to = at + int(other[0]) if len(other) else batch.num_rows
            if number[at] != block:
                block, held, ready = number[at], [], None
            part = batch.slice(at, to - at)
            if not anchor[at]:
                held.append(part.select(["label", "vec_id", "q"]))
            elif held or ready:
                if ready is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    held = []
                    q = np.concatenate([_matrix(c, dtype, work) for c in t.column("q").chunks])
                    ready = t.column("label").to_numpy(), t.column("vec_id").to_numpy(), q
                for k in range(0, part.num_rows, TOGETHER):
                    some = part.slice(k, TOGETHER)
                    yield *ready[:2], some, (_matrix(some.column(some.schema.get_field_index("q")), dtype, work) @ ready[2].T).astype(np.int64)
            at = to


def _positives(rows: Iterator[pa.RecordBatch], dtype: str, work: type, k: int) -> Iterator[pa.RecordBatch]:
    for label, ids, some, scores in _blocks(rows, dtype, work):
        out: list[list] = [[], [], []]
        for own, kind, s in zip(some.column("vec_id").to_pylist(), some.column("label").to_pylist(), scores):
            order = ordered(s, ids)
            best = order[(label[order] == kind) & (ids[order] != own)][:k]
            out[0] += [own] * len(best)
            out[1] += ids[best].tolist()
            out[2] += s[best].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "positive_score"])


def _negatives(rows: Iterator[pa.RecordBatch], dtype: str, work: type, k: int) -> Iterator[pa.RecordBatch]:
    for label, ids, some, scores in _blocks(rows, dtype, work):
        out: list[list] = [[], [], [], [], []]
        for own, kind, near, s in zip(some.column("vec_id").to_pylist(), some.column("label").to_pylist(), some.column("near").to_pylist(), scores):
            order = ordered(s, ids)
            order = order[label[order] != kind]
            falling = s[order]
            for p in near:
                found = order[within(falling, p["positive_score"], k)]
                out[0] += [own] * len(found)
                out[1] += [p["positive_id"]] * len(found)
                out[2] += ids[found].tolist()
                out[3] += [p["positive_score"]] * len(found)
                out[4] += s[found].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _first(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """df with rank, the k best of each key."""
    own = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """Hard negatives of the anchors (ids divisible by `every`): anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.

    rows: (vec_id, label, v) of whole_vectors(), unique by vec_id; other columns are not read. A score is the inner product with the
    anchor; higher ones come first, ties by the smaller id. An anchor's positives are the first `positives` other rows of its
    label (all, if fewer); for each of them come the first `negatives` rows of other labels whose score is from 50 % to 95 % of
    the positive's (all, if fewer; none for a positive's score below 0). Vectors whose length is not the most frequent one (the
    shortest of such) take no part. Scores that may not fit 64 bits are an error. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with scratch():
        kept = Staged(rows.select("vec_id", "label", "v"), "whole-vectors").df
        high = F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0))
        sizes = kept.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), high.alias("high")).orderBy(F.desc("n"), "dim").head()
        if sizes is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        dim, n, high = sizes
        if 200 * dim * high * high >= 2**63:
            raise ValueError(f"scores of vectors with components up to {high} may not fit 64 bits")
        dtype = "<i2" if high < 2**15 else "<i8"
        work = np.float32 if dim * high * high < 2**24 else np.float64 if dim * high * high < 2**53 else np.int64  # all exact
        packed = Staged(kept.filter(F.size("v") == dim).mapInArrow(lambda b: _packed(b, dtype), "vec_id long, label long, q binary"), "packed-vectors").df
        blocks = max(-(-n // BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_BLOCK)))
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        members = packed.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("anchor"), "vec_id", "label", "q")

        def dealt(df: DataFrame) -> DataFrame:
            return df.repartition("block").sortWithinPartitions("block", "anchor", "vec_id")

        anchors = packed.filter(F.col("vec_id") % every == 0)
        asked = anchors.select(each, F.lit(True).alias("anchor"), "vec_id", "label", "q")
        found = dealt(members.unionByName(asked)).mapInArrow(lambda b: _positives(b, dtype, work, positives), "anchor_id long, positive_id long, positive_score long")
        best = _first(found, ["anchor_id"], "positive_score", "positive_id", positives).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("near"))
        best = Staged(best, "positives").df
        near = best.schema["near"].dataType
        asked = anchors.join(best, anchors.vec_id == best.anchor_id).select(each, F.lit(True).alias("anchor"), "vec_id", "label", "q", "near")
        both = members.withColumn("near", F.lit(None).cast(near)).unionByName(asked)
        schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
        found = dealt(both).mapInArrow(lambda b: _negatives(b, dtype, work, negatives), schema)
        return Staged(_first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(*out), "hard-negatives").keep().df


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
c AS (SELECT anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 3
"""
