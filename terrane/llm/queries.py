"""The queries of this subpackage, op1_ to op13_, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import ann, audit, lines, mixing, neardup, negatives, packing, pii, pivots, quality, records, secrets, sharding, tokens
from terrane.llm.staging import Staged, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are boilerplate in their source."""
    return lines.drop_boilerplate_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    docs = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as records of token ids and gives what the files hold."""
    files = records.write_records(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
    return records.read_files(spark, files)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of 150 % takes from each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix_sources(Staged(docs, "sizes").df)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"))


def op7_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a document is a repository and its source the owner."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op8_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents."""
    rules, stats = quality.fit_rules(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return rules.judge(stats)


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of a hundredth of the embeddings, in all of them."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters take from all documents, in every order, by source."""
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings of a label."""
    return pivots.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of a fiftieth of the embeddings, in all of them; every seventh label is moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_histogram_shards, op3_weak_supervision_pii, op4_length_delimited_records, op5_source_mix, op6_best_fit_packing,
        op7_ownership_secrets, op8_setsketch_neardup, op9_robust_outliers, op10_posting_lists,
        op11_filter_audit, op12_pivot_neardup, op13_hard_negatives,
    )
}
ORACLE: dict[str, str] = {"op1_line_dedup": lines.SQL, "op5_source_mix": mixing.SQL, "op7_ownership_secrets": secrets.SQL, "op11_filter_audit": audit.SQL, "op12_pivot_neardup": pivots.SQL, "op13_hard_negatives": negatives.SQL}
