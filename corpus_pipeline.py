"""Quality rules, near-dedup, suffix-array dedup and packing over documents, each stage on what the one before kept.

Stages take (spark, docs, sf_dir) and give a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and reads them again as the next stage's docs. All but the last give the columns of documents.

SQL can't express the stages after the first (SimHash classes, byte spans, packing by tokens), so ORACLE_SQL is None
and the tests hold run() against a brute-force version.

Edge cases: null and empty texts are rejected by the first stage. A later stage that is given such rows keeps one of
them (near-dedup), leaves them as they are (suffixes), and packs them as an end id alone. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import near_texts, packing, quality, suffix_dedup
from casegraph.llm.workspace import Workspace

#: Words that a packing worker keeps: executors hold the memory of three other stages by then.
KEPT_WORDS = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_cascade(docs, rejected_by="_rejected_by").where(F.col("_rejected_by").isNull()).drop("_rejected_by")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity of 0.8 or more)."""
    return near_texts.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of long strings that also start elsewhere; n_chars is that of the text that is left."""
    left = suffix_dedup.cut(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence, and its token ids."""
    return packing.packed_documents(docs, with_ids=True, kept_words=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
