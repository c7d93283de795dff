"""Line deduplication by site-relative frequency, in DataFrame functions only.

A line that stands on a large share of a site's pages is boilerplate there: the pages of a host that hold it are counted, the
count is divided by the host's pages, and lines above `ratio` are dropped from that host's pages. Lines are compared without
white space at their ends, by a 64-bit hash within their host; a page counts once for a line, however often it repeats it.

Only (host, hash) pairs are shuffled, partly summed before; texts never are, unless the boilerplate table is too large to
broadcast. A host has less than (lines per page) / ratio boilerplate lines, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

RATIO = 0.02  # repeated lines stand on more, chance repeats of one word on less (README)
LEAST_PAGES = 3  # two copies of a page alone make no boilerplate
BROADCAST_LINES = 200_000  # of 8 bytes each
SALTS = 64
BLANK = " \t\r\u000b\f"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANK)))


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float, least_pages: int) -> DataFrame:
    """One row per host with boilerplate: ld_none (host is null), ld_host, ld_lines (hashes of its lines)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    own = [F.col(host).isNull().alias("ld_none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("ld_host")]
    totals = pages.select(*own).groupBy("ld_none", "ld_host").agg(F.count("*").alias("ld_pages"))
    each = pages.select(*own, F.explode(F.array_distinct(F.transform(lines, line_key))).alias("ld_line"))
    held = each.groupBy("ld_none", "ld_host", "ld_line").agg(F.count("*").alias("ld_n")).filter(F.col("ld_n") >= least_pages)
    common = held.join(totals, ["ld_none", "ld_host"]).filter(F.col("ld_n") > ratio * F.col("ld_pages"))
    return common.groupBy("ld_none", "ld_host").agg(F.sort_array(F.collect_list("ld_line")).alias("ld_lines"))


def drop_boilerplate_lines(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages with boilerplate lines taken out of `text`, and the count lines_dropped.

    A line goes if more than `ratio` of its host's pages hold it, and at least `least_pages` of them. Blank lines and the order
    of lines stay. Null texts stay null with lines_dropped 0; a text that is all boilerplate becomes empty; pages without a
    host form a host of their own; repeated rows count as pages each. Other columns pass through; a column named
    lines_dropped is replaced, and names that begin with `ld_` are for internal use. An empty table gives an empty table.
    """
    names = [c for c in pages.columns if c != "lines_dropped"]
    found = Staged(boilerplate(pages, text, host, ratio, least_pages), "boilerplate").df
    lines = found.agg(F.coalesce(F.sum(F.size("ld_lines")), F.lit(0))).head()[0]
    keyed = pages.select(*names, F.col(host).isNull().alias("ld_none"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("ld_host"))
    keys = ["ld_none", "ld_host"]
    if lines <= BROADCAST_LINES:
        found = F.broadcast(found)
    else:  # a host may have a third of all pages, so its pages are spread
        keys.append("ld_salt")
        keyed = keyed.withColumn("ld_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        found = found.withColumn("ld_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains(F.col("ld_lines"), line_key(x)) | (F.trim(x, F.lit(BLANK)) == ""))
    out = keyed.join(found, keys, "left").withColumn("ld_kept", F.when(F.col("ld_lines").isNotNull() & F.col(text).isNotNull(), kept))
    changed = F.col("ld_kept").isNotNull()
    return out.select(
        *[F.when(changed, F.array_join("ld_kept", "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in names],
        F.when(changed, F.size(parts) - F.size("ld_kept")).otherwise(0).cast("long").alias("lines_dropped"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
blank AS (SELECT ' ' || chr(9) || chr(13) || chr(11) || chr(12) AS b),
e AS (SELECT DISTINCT rid, coalesce(source, '') AS h, source IS NULL AS hn, trim(u.l, b) AS k
      FROM (SELECT rid, source, unnest(ls) AS l FROM d) u, blank WHERE trim(u.l, b) <> ''),
t AS (SELECT coalesce(source, '') AS h, source IS NULL AS hn, count(*) AS n FROM d GROUP BY ALL),
bad AS (SELECT e.h, e.hn, e.k FROM e JOIN t ON e.h = t.h AND e.hn = t.hn GROUP BY ALL
        HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * min(t.n)),
g AS (SELECT h, hn, list(k) AS ks FROM bad GROUP BY ALL),
r AS (SELECT doc_id, text, ls, CASE WHEN ks IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(ks, trim(x, b))) END AS kept
      FROM d LEFT JOIN g ON coalesce(d.source, '') = g.h AND (d.source IS NULL) = g.hn, blank)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS lines_dropped FROM r
"""
