"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text by the base patterns (assign, access, hex) and by forms of known issuers (vendor).
The hash of each candidate's value is counted over the corpus: in how many repositories and by how many owners does it stand?
A value that COPIED_OWNERS owners show, or that stands in COPIED_REPOSITORIES repositories of whatever owners, is a widely copied
example; one that few repositories of one owner or two show looks live. Base spans are all reported; vendor spans are added
where they look live, so sample keys in copied manuals add nothing.

Positions come from the lengths of the pieces between matches, added up in a window over the (few) matches, so a text costs
one pass per kind and a second one only where there is a match. Counts are taken by (value, owner, repository), then by
(value, owner), then by value, each partly summed before its shuffle: an example in a third of all rows stays spread. Only the
hashes of copied values are joined back: sent to all tasks up to BROADCAST_VALUES, else over SALTS salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

#: The base patterns in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Keys whose form names their issuer, signed web tokens, private key heads and addresses with a password.
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+-]{6,64}@"
)
#: kind: pattern as run, place in the order of kinds. HEX is run with its least length, which finds the same matches.
KINDS = {"assign": (ASSIGN, 0), "access": (ACCESS, 1), "hex": (r"[0-9a-f]{24,}", 2), "vendor": (VENDOR, 3)}
#: Owners from which on a value counts as widely copied.
COPIED_OWNERS = 3
#: Repositories from which on a value counts as widely copied, even by one owner.
COPIED_REPOSITORIES = 20
BROADCAST_VALUES = 200_000  # of 32 characters and two numbers
SALTS = 64


def _hits(text: Column, pattern: str) -> Column:
    """Array of (match, length of the text before it since the last match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    with_gaps = F.transform(F.array(gaps), lambda g: F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(g, i).alias("gap"))))[0]
    return F.when(F.size(found) > 0, with_gaps).otherwise(F.array().cast("array<struct<m:string,gap:int>>"))


def candidates(docs: DataFrame, text: str, repo: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(one row per document with ss_id, one row per candidate), both written tables."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("ss_id"),
        F.col(repo).alias("ss_doc"),
        F.col(repo).cast("string").alias("ss_repo"),
        F.col(owner).cast("string").alias("ss_owner"),
        *[_hits(t, pattern).alias(f"ss_{kind}") for kind, (pattern, _) in KINDS.items()],
    )
    found = Staged(found, "secret-hits").df
    each = None
    for kind, (_, order) in KINDS.items():
        own = found.select("ss_id", "ss_repo", "ss_owner", F.lit(kind).alias("kind"), F.lit(order).alias("ss_order"), F.posexplode(f"ss_{kind}").alias("ss_k", "ss_hit"))
        each = own if each is None else each.unionByName(own)
    line = Window.partitionBy("ss_id", "ss_order").orderBy("ss_k").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("ss_hit.m")
    ended = F.sum(F.col("ss_hit.gap") + F.length(match)).over(line)
    value = F.when(F.col("kind") == "assign", F.regexp_extract(match, ASSIGN, 1)).otherwise(match)
    each = each.withColumns({"end": ended.cast("long"), "value": value}).withColumn("start", F.col("end") - F.length(match))
    least = F.when(F.col("kind") == "assign", 6).when(F.col("kind") == "access", 20).when(F.col("kind") == "hex", 24).otherwise(1)
    each = each.filter(F.length("value") >= least).select("ss_id", "ss_repo", "ss_owner", "kind", "ss_order", "start", "end", F.md5("value").alias("value_hash"))
    return found.select("ss_id", "ss_doc"), Staged(each, "secret-candidates").df


def ownership(each: DataFrame) -> DataFrame:
    """value_hash, owners, repositories (an owner's repository counts once), copied. Null owners and repositories count as one."""
    by_repo = each.select("value_hash", "ss_owner", "ss_repo").distinct()
    by_owner = by_repo.groupBy("value_hash", "ss_owner").agg(F.count("*").alias("repos"))
    by_value = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))
    return by_value.withColumn("copied", (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES))


def _judged(each: DataFrame, worth: str) -> DataFrame:
    """Candidates with owners, repositories and copied of those values for which `worth` holds."""
    copied = Staged(ownership(each).filter(worth), "secret-ownership").df
    keys = ["value_hash"]
    if copied.count() <= BROADCAST_VALUES:
        copied = F.broadcast(copied)
    else:  # a value may be a third of all candidates
        keys.append("ss_salt")
        each = each.withColumn("ss_salt", F.pmod(F.xxhash64("ss_id", "start"), F.lit(SALTS)).cast("int"))
        copied = copied.withColumn("ss_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.join(copied, keys, "left").withColumn("copied", F.coalesce("copied", F.lit(False))).drop("ss_salt")


def find_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per candidate with its verdict: ss_id (of the row), kind, start, end (code points), value_hash, owners, repositories, copied."""
    _, each = candidates(docs, text, repo, owner)
    one = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    return _judged(each, "repositories > 1").withColumns({c: one(c) for c in ("owners", "repositories")})


def scan_documents(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of docs: the repo column, counts n_assign, n_access, n_hex, base_sha256, spans, and n_live and n_copied candidates.

    Null and empty texts have no spans; rows without an owner belong to one nameless owner; repeated rows are reported each;
    an empty table gives an empty one. Columns of docs other than the three named are not read.
    """
    rows, each = candidates(docs, text, repo, owner)
    judged = _judged(each, "copied")
    base = F.col("ss_order") < 3
    span = F.struct("start", "ss_order", F.concat_ws(":", "kind", "start", "end").alias("text"))
    per = judged.groupBy("ss_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sort_array(F.collect_list(F.when(base, span))).alias("ss_base"),
        F.sort_array(F.collect_list(F.when(base | ~F.col("copied"), span))).alias("ss_all"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if(F.col("copied")).alias("n_copied"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["text"]), ","), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(per, "ss_id", "left").select(
        F.col("ss_doc").alias(repo), zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(joined("ss_base").cast("binary"), 256).alias("base_sha256"), joined("ss_all").alias("spans"), zero("n_live"), zero("n_copied"),
    )


def _sql_kind(kind: str, pattern: str, order: int, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT rid, doc_id, source, '{kind}' AS kind, {order} AS o, m, end_ - length(m) AS start_, end_,
       regexp_extract(m, '{quoted}', {group}) AS value
FROM (SELECT rid, doc_id, source, m, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING) AS end_
      FROM (SELECT rid, doc_id, source, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS k
            FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS gaps FROM d) WHERE len(ms) > 0))
WHERE length(value) >= {least}"""


SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),\nc AS ("
    + "\nUNION ALL ".join(
        _sql_kind(kind, pattern.replace(r"\x20", " "), order, int(kind == "assign"), {"assign": 6, "access": 20, "hex": 24}.get(kind, 1)) for kind, (pattern, order) in KINDS.items()
    )
    + f"""),
v AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) >= {COPIED_OWNERS}
      OR count(DISTINCT (coalesce(source, chr(1)), coalesce(CAST(doc_id AS VARCHAR), chr(1)))) >= {COPIED_REPOSITORIES} AS copied FROM c GROUP BY value),
s AS (SELECT c.*, v.copied, kind || ':' || start_ || ':' || end_ AS span FROM c JOIN v ON c.value = v.value),
p AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
      string_agg(span, ',' ORDER BY start_, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY start_, o) FILTER (o < 3 OR NOT copied) AS spans,
      count(*) FILTER (NOT copied) AS live, count(*) FILTER (copied) AS cop FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(cop, 0) AS n_copied FROM d LEFT JOIN p ON d.rid = p.rid
"""
)
