"""Research of a case's issues: their questions, the nodes found for all of them, the log and the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, jsonx


def questions(issues: DataFrame, keys: list[str]) -> DataFrame:
    """issues (keys, legal_question, targeted_questions_json, issue_title, issue_description) as rows keys, place, question_id, question: the
    legal question and the targeted ones, distinct and in order, or title and description where there is none."""
    legal = F.trim(F.coalesce("legal_question", F.lit("")))
    asked = F.concat(F.when(legal != "", F.array(legal)).otherwise(F.array().cast("array<string>")), F.filter(jsonx.text_list(F.col("targeted_questions_json")), lambda q: F.trim(q) != ""))
    whole = F.concat(F.coalesce("issue_title", F.lit("")), F.lit(": "), F.coalesce("issue_description", F.lit("")))
    rows = issues.select(*keys, F.posexplode(F.array_distinct(F.when(F.size(asked) > 0, asked).otherwise(F.array(whole)))).alias("_at", "question"))
    return rows.select(*keys, (F.col("_at") + 1).alias("place"), F.concat(F.lit("Q"), F.col("_at") + 1).alias("question_id"), "question")


def log_entries(found: DataFrame, nodes: DataFrame, run: str, keys: list[str], order: list[str]) -> DataFrame:
    """A row for each node that a question led to (keys, node_id, label, score, method): its rank and what is known of the node.

    The id depends on run, keys and node alone, so writing twice gives the same rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = found.withColumn("retrieval_rank", F.row_number().over(w)).join(nodes, "node_id", "left")
    entry = ids.stable_id("LOG", F.lit(run), *[F.col(k) for k in keys], F.col("node_id"))
    return ranked.withColumns({"research_run_id": F.lit(run), "log_id": entry, "retrieval_score": F.coalesce("score", F.lit(0.0)), "retrieval_method": F.coalesce("method", F.lit("graph_expansion")), "expansion_type": F.coalesce("label", F.lit("retrieved"))}).drop("score", "method", "label")


def packages(found: DataFrame, asked: DataFrame, nodes: DataFrame, case: str, order: list[str]) -> DataFrame:
    """One row a case: its questions, the nodes of all of them (in the order in which they first appear) and whether one is Arabic."""
    o = F.struct(*order)
    first = found.groupBy(case, "node_id").agg(F.min(o).alias("_first")).join(nodes.select("node_id", "language"), "node_id", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_first", "node_id"))), lambda x: x["node_id"])
    of_nodes = first.groupBy(case).agg(F.to_json(listed).alias("authority_node_ids_json"), F.bool_or(F.lower(F.coalesce("language", F.lit(""))) == "ar").alias("arabic_source_available"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("issue_id", "place", "question"))), lambda x: x["question"])
    return asked.groupBy(case).agg(F.to_json(said).alias("targeted_questions_json")).join(of_nodes, case, "left").withColumn("arabic_source_available", F.coalesce("arabic_source_available", F.lit(False)))
