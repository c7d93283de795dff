"""What filters do to each other: every order of five filters, per source, from one scan of the texts.

1. Texts are scanned in the buffers that Arrow delivers. A table of byte classes (white space, capital, symbol, first byte of a
   code point) marks every byte of a window of documents, prefix sums of the marks taken at document borders give words, capitals,
   symbols and code points, and a digest of each text is taken from the same buffer.
2. Distinct words: a 64-bit hash of every word is sorted within its document, neighbours with equal hashes are compared byte by
   byte, and a document in which two different words share a hash is counted exactly. A window is cut only between words.
3. A document fails a set of filters, one bit each. Copies of a text are told by its digest, so the bit of repetition needs the
   smallest id by digest alone.
4. Masks reduce: documents are counted by (part, mask), 32 masks at most, and from the numbers kept by each set of filters
   follow all figures of all orders. Nothing after the scan holds a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.staging import Staged, scratch

LETTERS = "ABCDE"
FEW_WORDS = 200
WINDOW = 1 << 20  # bytes that are looked at together; a longer word makes a longer window
SALTS = 16
COPY = 1 << LETTERS.index("E")

_BYTE = np.arange(256)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
CAPITAL = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
SYMBOL = np.isin(_BYTE, np.frombuffer(b"#$%&*|", np.uint8))
FIRST = (_BYTE & 0xC0) != 0x80  # of a code point in UTF-8
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _between(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks within each of the stretches between edges, by prefix sums."""
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[edges])


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words; a word ends at an edge even without white space."""
    blank = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes' table values weighted by powers of a constant, summed within the word."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(size.max()), _FACTOR))])
    return np.add.reduceat(_TABLE[data[np.repeat(begin, size) + inner]] * power[inner], first) ^ (size.astype(np.uint64) * _FACTOR)


def equal_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of `size` (one or more) bytes that begin at a and b are equal, byte by byte."""
    out = np.zeros(len(a), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WINDOW, side="right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        out[at:to] = np.logical_and.reduceat(data[np.repeat(a[at:to], n) + inner] == data[np.repeat(b[at:to], n) + inner], first)
        at = to
    return out


def distinct_words(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """Distinct words of each document 0 .. docs - 1."""
    order = np.lexsort((hashes, doc))
    doc, begin, end, hashes = doc[order], begin[order], end[order], hashes[order]
    near = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    same = (end[near] - begin[near]) == (end[near + 1] - begin[near + 1])
    pairs = near[same]
    same[same] = equal_words(data, begin[pairs], begin[pairs + 1], end[pairs] - begin[pairs])
    out = np.bincount(doc, minlength=docs) - np.bincount(doc[near], minlength=docs)
    for k in np.unique(doc[near[~same]]).tolist():  # two words with one hash
        own = np.flatnonzero(doc == k)
        out[k] = len({data[a:b].tobytes() for a, b in zip(begin[own], end[own])})
    return out


def _cuts(data: np.ndarray, low: int, high: int) -> list[int]:
    """Edges of windows of a long text, each after white space."""
    edges, at = [low], low
    while high - at > WINDOW:
        back = np.flatnonzero(SPACE[data[at : at + WINDOW]])
        to = at + int(back[-1]) + 1 if len(back) else at + WINDOW
        while not len(back) and to < high:  # inside a word longer than a window
            ahead = np.flatnonzero(SPACE[data[to : to + WINDOW]])
            to, back = (to + int(ahead[0]) + 1, ahead) if len(ahead) else (min(high, to + WINDOW), back)
        edges.append(to)
        at = to
    return [*edges, high] if edges[-1] < high or high == low else edges


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and points of the documents between offsets of a buffer of UTF-8."""
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in ("words", "distinct", "capitals", "symbols", "points")}
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW, side="right")) - 1)
        edges = offsets[at : to + 1].astype(np.int64) if to > at + 1 else np.array(_cuts(data, int(offsets[at]), int(offsets[to])), np.int64)
        whole = to > at + 1
        spans: list[tuple] = []
        for low, high in [(0, len(edges) - 1)] if whole else [(k, k + 1) for k in range(len(edges) - 1)]:
            base = int(edges[low])
            part, inner = data[base : int(edges[high])], edges[low : high + 1] - base
            doc = slice(at, to)
            for name, table in (("capitals", CAPITAL), ("symbols", SYMBOL), ("points", FIRST)):
                out[name][doc] += _between(table[part], inner)
            begin, end = word_spans(part, inner)
            marks = np.zeros(len(part), bool)
            marks[begin] = True
            out["words"][doc] += _between(marks, inner)
            owner = np.searchsorted(inner, begin, side="right") - 1 if whole else np.zeros(len(begin), np.int64)
            spans.append((owner, begin + base, end + base, word_hashes(part, begin, end)))
        out["distinct"][at:to] = distinct_words(data, *(np.concatenate(x) for x in zip(*spans)), to - at)
        at = to
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the filters A to D that documents fail."""
    fails = [m["words"] < FEW_WORDS, 100 * m["distinct"] < 50 * m["words"], 100 * m["capitals"] > 2 * m["points"], m["symbols"] > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        data, offsets = _buffers(batch.column(2))
        mask = failures(measure(data, offsets)) if batch.num_rows else np.zeros(0, np.int32)
        view, edges = memoryview(data), offsets.tolist()
        digest = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])


def _without(bits: int, count: str) -> Column:
    """Of a part: `count` of documents that fail none of the filters in bits."""
    return F.sum(F.when(F.col("mask").bitwiseAND(F.lit(bits)) == 0, F.col(count)).otherwise(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the set of filters that they fail."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    scanned = docs.select("doc_id", part, F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema)
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality"), flag("toxic")).filter("quality OR toxic")
    own = Staged(scanned.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks").df  # read twice
    spread = own.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int"))
    named = spread.join(known.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("quality", "toxic")})
    has_id = F.col("doc_id").isNotNull()
    first = F.min(F.when(has_id, F.struct("doc_id", "n")))
    texts = named.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("without"), first.alias("first"))
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("part", "quality", "toxic"), F.lit(SALTS)).cast("int"))
    shared = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1 AND least IS NOT NULL")
    shared = shared.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    least = texts.join(shared, ["digest", "salt"], "left")
    leads = F.when(F.col("first").isNotNull() & (F.col("least").isNull() | (F.col("first.doc_id") == F.col("least"))), F.col("first.n")).otherwise(0)
    split = least.withColumn("fresh", F.col("without") + leads).select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )).alias("c"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are not read. Filters fail documents of under 200
    words (A), with fewer distinct words than half of all (B), with more than 2 % capitals among the code points (C), with one
    of #$%&*| (D), or with the text of a document of smaller doc_id anywhere in the table (E).

    Null texts are empty, and all empty texts are equal; an empty text fails A. Null sources are the part ''. A document without
    an id never fails E and is no smaller one; rows with equal ids and texts are not smaller than each other, so E takes none
    of the first id's. Rows count as often as they come. A document is good or toxic if any label of its id is 1. Texts of any
    length are scanned whole. An empty table gives an empty one.
    """
    with scratch():
        masks = Staged(failure_masks(docs, labels), "mask-counts").keep().df
    full, names = 1 << len(LETTERS), ("n", "good", "toxic")
    kept = masks.groupBy("part").agg(*[F.array(*[_without(s, c) for s in range(full)]).alias(c) for c in names])
    weight = {s: factorial(s.bit_count()) * factorial(len(LETTERS) - 1 - s.bit_count()) for s in range(full - 1)}
    share = lambda f: sum((weight[s] * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | f))) for s in range(full) if not s & f), F.lit(0))
    kept = kept.withColumn("shares", F.array(*[share(1 << i) for i in range(len(LETTERS))]))
    orders = F.lit(["".join(p) for p in permutations(LETTERS)])
    each = kept.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    place = lambda k: F.ascii(F.substr("filter_order", F.lit(k) if isinstance(k, int) else k, F.lit(1))) - ord(LETTERS[0])
    ahead = sum((F.when(F.col("step") > k, F.pow(F.lit(2), place(k))).otherwise(0) for k in range(1, len(LETTERS))), F.lit(0)).cast("int")
    each = each.withColumns({"at": place(F.col("step")), "ahead": ahead}).withColumn("bit", F.pow(F.lit(2), F.col("at")).cast("int"))
    left = lambda c, bits: F.get(c, bits)
    after = F.col("ahead") + F.col("bit")
    gone = lambda c: left(c, F.col("ahead")) - left(c, after)
    return each.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), left("n", after).alias("kept"), gone("n").alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("bit")) - gone("n")).alias("redundant"),
        (left("n", F.lit(full - 1) - F.col("bit")) - left("n", F.lit(full - 1))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", F.col("at")).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part,
      CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
      + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr(64 + i) AS c FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, CAST(pow(2, ascii(substr(filter_order, step, 1)) - 65) AS INT) AS bit,
          coalesce(list_sum([CAST(pow(2, ascii(substr(filter_order, k, 1)) - 65) AS INT) FOR k IN range(1, step)]), 0)::INT AS ahead
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
      coalesce(sum(n) FILTER (mask & (ahead | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & ahead = 0 AND mask & bit <> 0), 0) AS removed,
      coalesce(sum(n) FILTER (mask & ahead <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
      coalesce(sum(good) FILTER (mask & ahead = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & ahead = 0 AND mask & bit <> 0), 0) AS toxic_lost
      FROM cell, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
