"""Quality rules: fixed limits, then robust multivariate outliers per language and source. DataFrame functions only.

Every text gives a vector of five transformed statistics: log of its words, mean word length, log of its symbols per word, share
of repeated lines, root of the share of words in repeated three-word windows. Per language and source the minimum covariance
determinant is estimated: concentration steps choose the three quarters of the documents that are nearest by Mahalanobis
distance and take mean and covariance from these alone, from two starts (quartiles; plain moments), of which the one with the
smaller determinant stays. Documents beyond LIMIT by that distance are rejected. A variance floor keeps a statistic that hardly
varies in a group from rejecting the first document that differs a little.

A step is one aggregation by group and distance bucket (a hundredth wide), so no group is sorted or held in one task, and the
nearest documents are the same in every run. Groups of fewer than LEAST documents share an estimate within their language; a
pool that is still smaller than POOL_LEAST rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from terrane.llm.staging import Staged

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
NEAREST = 0.75
#: NEAREST / P(chi2 with 7 degrees < chi2 quantile NEAREST with 5): makes the covariance right for normal data.
CONSISTENCY = 1.41
FLOORS = (0.5, 0.25, 0.3, 0.1, 0.12)
LIMIT = 40.0
STEPS = 5
LEAST = 100
POOL_LEAST = 20
BROADCAST_GROUPS = 20_000  # rows of some 25 numbers
SALTS = 64
N = len(FLOORS)
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; of a null text: none."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def repeated_words(own: Column) -> Column:
    """Words in three-word windows that come twice or more. Windows are told apart by a 64-bit hash."""

    def count(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def places(line: Column) -> Column:
            twin = F.filter(line, lambda x, k: (F.get(line, k - 1)["h"] == x["h"]) | (F.get(line, k + 1)["h"] == x["h"]))
            at = F.sort_array(F.transform(twin, lambda x: x["i"].cast("long")))
            zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                at,
                zero,
                lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(marked), places))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(own) < 4, F.lit(0).cast("long")).otherwise(let(windows(own), count))


def statistics(text: str = "text") -> dict[str, Column]:
    """Columns qs_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column (null: empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, SPACES, " " * len(SPACES))) != "")
    pair = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own")))
    rep = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    return {
        "qs_l": pair,
        "qs_w": rep,
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    }


def measured(docs: DataFrame, text: str, lang: str, source: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the base columns, the vector qs_x0.. and the group keys qs_lang, qs_group."""
    gone = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    names = [c for c in docs.columns if c not in gone or c in (text, lang, source)]
    out = docs.select(*names).withColumns(statistics(text)).withColumns({
        "n_words": F.col("qs_w.n").cast("long"),
        "n_dup_lines": (F.col("qs_l.n") - F.col("qs_l.own")).cast("long"),
        "n_repeat_words": F.col("qs_w.rep").cast("long"),
        "qs_lines": F.col("qs_l.n"),
        "qs_lang": F.coalesce(F.col(lang).cast("string"), F.lit("\u0001")),
        "qs_group": F.coalesce(F.col(source).cast("string"), F.lit("\u0001")),
    }).drop("qs_l", "qs_w")
    per = F.greatest(F.col("n_words"), F.lit(1))
    vector = [
        F.log1p("n_words"),
        F.col("word_chars") / per,
        F.log1p(100 * F.col("n_symbols") / per),
        F.col("n_dup_lines") / F.greatest(F.col("qs_lines"), F.lit(1)),
        F.sqrt(F.col("n_repeat_words") / per),
    ]
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({f"qs_x{i}": x for i, x in enumerate(vector)} | {"base_failed": failed})


def with_groups(df: DataFrame, small: DataFrame, groups: int, keys: list[str]) -> DataFrame:
    """df joined with a table of groups: sent to all tasks while it is small, else by salted keys, as one group may be a third of df."""
    if groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(small), keys, "left")
    salted = small.withColumn("qs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("qs_salt", F.pmod(F.xxhash64("qs_x0", "qs_x1", "qs_x2"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "qs_salt"], "left").drop("qs_salt")


def _inverse(moments: DataFrame) -> DataFrame:
    """From columns n, m_i (means) and s_i_j (covariances): qs_p_i_j, the inverse, and qs_det, the log of the determinant."""
    df = moments
    for j in range(N):
        under = [F.col(f"l_{j}_{k}") for k in range(j)]
        left = F.col(f"s_{j}_{j}") - sum((x * x for x in under), F.lit(0.0))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        df = df.withColumns({
            f"l_{i}_{j}": (F.col(f"s_{j}_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}")
            for i in range(j + 1, N)
        })
    for j in range(N):
        df = df.withColumn(f"v_{j}_{j}", 1 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, N):
            df = df.withColumn(f"v_{i}_{j}", -sum((F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}"))
    inverse = {f"qs_p_{i}_{j}": sum((F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}") for k in range(j, N)), F.lit(0.0)) for i, j in PAIRS}
    det = 2 * sum((F.log(f"l_{j}_{j}") for j in range(N)), F.lit(0.0))
    return df.withColumns(inverse | {"qs_det": det})


def _model(df: DataFrame, keys: list[str]) -> DataFrame:
    return _inverse(df).select(*keys, "qs_det", *[F.col(f"m_{i}").alias(f"qs_m_{i}") for i in range(N)], *[f"qs_p_{i}_{j}" for i, j in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance of qs_x to the model in the same row."""
    d = [F.col(f"qs_x{i}") - F.col(f"qs_m_{i}") for i in range(N)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(f"qs_p_{i}_{j}") for i, j in PAIRS), F.lit(0.0))


def _starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    xs = [F.col(f"qs_x{i}") for i in range(N)]
    quartile = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, x in enumerate(xs)]
    plain = [F.avg(x).alias(f"a_{i}") for i, x in enumerate(xs)] + [F.covar_pop(xs[i], xs[j]).alias(f"c_{i}_{j}") for i, j in PAIRS]
    both = Staged(vectors.groupBy(*keys).agg(*quartile, *plain), "quality-starts").df
    spread = lambda i: F.pow((F.get(F.col(f"q_{i}"), F.lit(2)) - F.get(F.col(f"q_{i}"), F.lit(0))) / 1.349, 2) + FLOORS[i] ** 2
    robust = both.select(*keys, F.lit(0).alias("qs_start"), *[F.get(F.col(f"q_{i}"), F.lit(1)).alias(f"m_{i}") for i in range(N)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in PAIRS])
    moments = both.select(*keys, F.lit(1).alias("qs_start"), *[F.col(f"a_{i}").alias(f"m_{i}") for i in range(N)], *[(F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}") for i, j in PAIRS])
    return _model(robust.unionByName(moments), [*keys, "qs_start"])


def _step(vectors: DataFrame, model: DataFrame, groups: int, keys: list[str]) -> DataFrame:
    """One concentration step for every group and start: moments of the nearest documents, by distance buckets."""
    own = [*keys, "qs_start"]
    near = with_groups(vectors, model, groups, keys)
    near = near.withColumn("qs_b", F.floor(64 * F.log2(distance() + 1e-9)).cast("int"))
    d = [F.col(f"qs_x{i}") - F.col(f"qs_m_{i}") for i in range(N)]
    sums = [F.sum(d[i]).alias(f"t_{i}") for i in range(N)] + [F.sum(d[i] * d[j]).alias(f"u_{i}_{j}") for i, j in PAIRS]
    by = near.groupBy(*own, "qs_b").agg(F.count("*").alias("n"), *sums, *[F.first(f"qs_m_{i}").alias(f"o_{i}") for i in range(N)])
    before = Window.partitionBy(*own).orderBy("qs_b").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_all", F.sum("n").over(Window.partitionBy(*own)))
    kept = by.filter(F.col("n_before") < NEAREST * F.col("n_all"))
    total = kept.groupBy(*own).agg(F.sum("n").alias("n"), *[F.first(f"o_{i}").alias(f"o_{i}") for i in range(N)], *[F.sum(f"t_{i}").alias(f"t_{i}") for i in range(N)], *[F.sum(f"u_{i}_{j}").alias(f"u_{i}_{j}") for i, j in PAIRS])
    means = {f"m_{i}": F.col(f"o_{i}") + F.col(f"t_{i}") / F.col("n") for i in range(N)}
    covs = {
        f"s_{i}_{j}": CONSISTENCY * (F.col(f"u_{i}_{j}") / F.col("n") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n") / F.col("n")) + (FLOORS[i] ** 2 if i == j else 0.0)
        for i, j in PAIRS
    }
    return _model(total.withColumns(means | covs), own)


class Rules:
    """The fitted estimates; judge() applies them to documents that have been measured."""

    def __init__(self, stats: DataFrame):
        """stats: a written table with the columns of measured(); rows that fail the fixed limits take no part."""
        keys = ["qs_lang", "qs_group"]
        fit = stats.filter(~F.col("base_failed")).select(*keys, *[f"qs_x{i}" for i in range(N)])
        sizes = fit.groupBy(*keys).agg(F.count("*").alias("qs_n")).filter(F.col("qs_n") >= LEAST)
        self.large = Staged(sizes.select(*keys, F.lit(True).alias("qs_large")), "quality-groups").df
        self.count = self.large.count()
        vectors = Staged(self._pooled(fit), "quality-vectors").df
        enough = vectors.groupBy(*keys).agg(F.count("*").alias("qs_n")).filter(F.col("qs_n") >= POOL_LEAST).select(*keys)
        starts = Staged(_starts(vectors, keys), "quality-model")
        self.groups = starts.df.count()
        for _ in range(STEPS):
            after = Staged(_step(vectors, starts.df, self.groups, keys), "quality-model")
            starts.drop()
            starts = after
        best = starts.df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in starts.df.columns if c not in keys]), F.struct("qs_det", "qs_start")).alias("best"))
        self.model = Staged(best.join(enough, keys, "left_semi").select(*keys, "best.*"), "quality-model").df

    def _pooled(self, df: DataFrame) -> DataFrame:
        """df with the sources that are too small put together in their language."""
        found = with_groups(df, self.large, self.count, ["qs_lang", "qs_group"])
        return found.withColumn("qs_group", F.when(F.col("qs_large"), F.col("qs_group")).otherwise("\u0002")).drop("qs_large")

    def judge(self, stats: DataFrame) -> DataFrame:
        """stats with distance (null where there is no estimate or the fixed limits fail) and kept."""
        far = with_groups(self._pooled(stats), self.model, self.groups, ["qs_lang", "qs_group"])
        far = far.withColumn("distance", F.when(~F.col("base_failed"), distance()))
        far = far.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= LIMIT)))
        return far.drop(*[c for c in far.columns if c.startswith("qs_")])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def fit_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> tuple[Rules, DataFrame]:
    """The rules of a corpus, and its statistics (with the columns named in keep) as a written table."""
    stats = measured(docs, text, lang, source)
    stats = Staged(stats.select(*keep, *BASE, *[c for c in stats.columns if c.startswith("qs_")]), "quality-stats").df
    return Rules(stats), stats


def judge_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the base statistics, base_failed, distance and kept.

    Texts of fewer than `least_words` words fail, so null and empty ones do unless it is 0. Null languages and sources are values
    of their own. Repeated rows count as often as they come. Columns named like a result are replaced, and names that begin
    with `qs_` are for internal use. An empty table gives an empty one. Texts are measured once and written with their figures;
    no text moves between executors.
    """
    stats = Staged(measured(docs, text, lang, source, least_words), "quality-stats").df
    return Rules(stats).judge(stats)
