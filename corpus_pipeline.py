"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() applies
them to the documents of a folder and writes each stage's rows to the shared folder before the next one reads them; what a
stage wrote for itself goes when its rows are written.

Of every stage: columns other than those of documents (COLUMNS) are dropped, whatever they are called; rows are only merged by
the near-duplicate stage, so repeated rows and rows with equal or null ids stay apart elsewhere; a null language or source is
a value of its own; texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import lines, mixing, neardup, packing, quality, tokens
from terrane.llm.staging import Staged, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_PERCENT = 80  # op8 has a contract of its own
LEAST_WORDS = 1  # op9 has a contract of its own; here a short document is judged by its statistics, as many are clean


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers in their language and source.

    Null, empty and blank texts have fewer than LEAST_WORDS words and go. Documents of groups too small for an estimate pass by
    the fixed limits alone. Nothing of a kept document changes.
    """
    return quality.judge_documents(docs.select(*COLUMNS), least_words=LEAST_WORDS).filter("kept").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a large share of their source repeats; n_chars follows where lines went.

    Null texts stay null, a text that is all boilerplate becomes empty, and blank lines stay.
    """
    cleaned = lines.drop_boilerplate_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates (overlap of five-word shingles NEAR_PERCENT or more), the one with the
    smallest doc_id; rows equal in doc_id and text count once.

    Null, empty and blank texts are linked with nothing and stay. A component without any id keeps its rows without one.
    """
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")).alias("nd_key")
    kept = neardup.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept").select(key, "text_key")
    keyed = docs.select(*COLUMNS, key, F.xxhash64("text").alias("text_key"))
    return keyed.join(kept, ["nd_key", "text_key"], "left_semi").dropDuplicates(["nd_key", "text_key"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole ones once a round, and at a source's cut the first words of one, joined by blanks.

    Documents without words (null, empty and blank texts) have nothing to take and go, and so do those beyond a source's budget.
    """
    sized = Staged(docs.select(*COLUMNS, mixing.word_count("text").alias("size")), "sized").df
    taken = mixing.mix_sources(sized).filter("taken > 0")
    rest = F.col("taken") % F.col("size")
    parts = F.concat(F.array_repeat("size", F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = taken.withColumn("part", F.explode(parts))
    whole = F.col("part") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(quality.words(F.col("text")), 1, F.col("part").cast("int")), " "))
    each = each.withColumn("text", text).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return each.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their place in a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, of the end id alone; each row is packed on its own.
    """
    return packing.pack_documents(docs, tokens.default_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("line dedup", drop_boilerplate),
    ("near-duplicate removal", drop_near_duplicates),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Robust distances and token ids are beyond SQL; tests hold the operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            after = Staged(stage(spark, docs, sf_dir), name.replace(" ", "-")).keep()
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
