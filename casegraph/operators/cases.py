"""Cases as a list: workflow types, cards, messages, search over all kinds, versions, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

# Names of the two workflows, severities in order, roles that are shown.
WORKFLOWS = {"litigation": "litigation", "litigation_case": "litigation", "litigation case": "litigation", "case": "litigation", "agreement": "agreement_review", "agreement_review": "agreement_review", "agreement review": "agreement_review", "contract": "agreement_review", "contract_review": "agreement_review", "contract review": "agreement_review"}
SEVERITY = ["critical", "high", "medium", "low"]
ROLES = ["user", "assistant"]


def workflow_type(x: Column, aliases: dict[str, str] = WORKFLOWS) -> Column:
    """The workflow that a name stands for (litigation if there is none); a name that aliases doesn't have fails the query."""
    names = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    said = F.lower(F.trim(F.coalesce(F.nullif(x, F.lit("")), F.lit("litigation"))))
    return F.coalesce(F.try_element_at(names, said), F.raise_error(F.concat(F.lit("unknown workflow type: "), said)).cast("string"))


def of_workflow(cases: DataFrame, wanted: str) -> DataFrame:
    """Cases of a workflow; those without a type are litigation, and so is a table without the column."""
    if "workflow_type" not in cases.columns:
        return cases if wanted == "litigation" else cases.where(F.lit(False))
    said = F.lower(F.trim(F.coalesce("workflow_type", F.lit(""))))
    return cases.where(said.isin("", "litigation") if wanted == "litigation" else said == "agreement_review")


def latest_cases(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """The row that was stored last of each case (ingested_at, ingest_seq: append() gives them)."""
    from .relational import latest_by_key

    return latest_by_key(rows, [key], ["ingested_at", "ingest_seq"])


def cards(cases: DataFrame) -> DataFrame:
    """What a list shows of a case; card_order() sorts them."""
    first = lambda *names: F.coalesce(text.first_filled(*[F.col(n).cast("string") for n in names if n in cases.columns]), F.lit("")) if set(names) & set(cases.columns) else F.lit("")
    activity = F.coalesce(F.nullif(first("updated_at", "created_at"), F.lit("")), F.lit("—"))
    shown = F.when(activity.contains("T"), F.substring(F.replace(activity, F.lit("T"), F.lit(" ")), 1, 16)).otherwise(activity)
    return cases.select("case_id", ids.short_reference(F.col("case_id")).alias("reference"), first("case_name", "client_name", "customer_name").alias("title"), first("matter_type").alias("matter"), first("responsible_attorney", "created_by").alias("attorney"), shown.alias("activity"), first("workflow_status", "case_status").alias("status"))


def card_order() -> list[Column]:
    """Cards with the last activity first; those without any come last, ids break ties."""
    return [(F.col("activity") == "—").asc(), F.col("activity").desc(), F.col("case_id").asc()]


def selected_pages(pages: DataFrame, documents: DataFrame, page_id: str = "page_id", document: str = "case_document_id") -> DataFrame:
    """Ids of the pages of chosen documents."""
    return pages.where(F.col(page_id).isNotNull()).join(documents.select(document), document, "left_semi").select(page_id)


def conversation(messages: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Messages of users and assistants, numbered in time."""
    w = Window.partitionBy(*keys).orderBy(at)
    return messages.where(F.col("role").isin(ROLES)).withColumn("place", F.row_number().over(w))


def distinct_uploads(files: DataFrame, order: str = "ord") -> DataFrame:
    """The first of files of equal name, size and time."""
    from .relational import first_wins_merge

    rest = [c for c in files.columns if c not in ("name", "size", "modified", order)]
    return first_wins_merge(files, ["name", "size", "modified"], order, rest).drop("merged_count")


def search_all(query: str, sources: dict[str, tuple[DataFrame, list[str]]], by: list[str], order: str, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(hits, totals) of a search over several kinds of records: of each key the first hits, kinds in order, and how many there are.
    sources: kind -> (rows, columns that are searched)."""
    found = [df.where(text.contains_any(F.lit(query), [F.col(c) for c in columns])).select(*by, F.lit(n).alias("kind_order"), F.lit(kind).alias("kind"), F.col(order).alias("ord")) for n, (kind, (df, columns)) in enumerate(sources.items())]
    hits = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy(*by).orderBy("kind_order", "ord")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("kind_order"), hits.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def open_items(sources: dict[str, DataFrame], resolved: Column) -> DataFrame:
    """Records of several kinds that are not settled, with their kind."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(kind)).where(~F.coalesce(resolved, F.lit(False))) for kind, df in sources.items()])


def severity_rank(x: Column) -> Column:
    """0 for critical to 3 for low; unknown ones after them."""
    said = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.coalesce(*[F.when(said == s, n) for n, s in enumerate(SEVERITY)], F.lit(len(SEVERITY)))


def with_versions(drafts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Drafts as versions 1, 2, ... A draft with restores (a version's number) is a copy of that one, and says so in note."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = drafts.withColumn("version", F.row_number().over(w))
    older = numbered.select(*keys, F.col("version").alias("restores"), F.col("draft").alias("_older"))
    restored = numbered.join(older, [*keys, "restores"], "left")
    again = F.col("restores").isNotNull()
    return restored.withColumns({"draft": F.when(again, F.col("_older")).otherwise(F.col("draft")), "note": F.when(again, F.concat(F.lit("restored:"), F.col("restores"))).otherwise(F.col("note"))}).drop("_older")


def gate_passed(has_summary: Column, approved: Column, dirty: Column, strict: bool = False) -> Column:
    """Whether work may go on: there is a summary and, if strict, it is approved and the case has not changed since."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(has_summary) & yes(approved) & ~yes(dirty) if strict else yes(has_summary)


def accounting_flags(status: Column, line_items: Column, classifications: Column, pending: Column, evaluations: Column, discrepancies: Column, dirty: Column) -> Column:
    """struct of what the accounting has come to; the counts may be null."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return F.struct(
        F.coalesce(F.nullif(F.lower(F.trim(status)), F.lit("")), F.lit("not_started")).alias("status"), F.coalesce(dirty, F.lit(False)).alias("dirty"), some(classifications).alias("has_classifications"), some(line_items).alias("has_line_items"),
        some(pending).alias("has_pending_review"), F.coalesce(pending, F.lit(0)).alias("pending_count"), (some(evaluations) | some(discrepancies)).alias("has_forensic_output"),
    )


def invalidated(cases: DataFrame, changed: DataFrame, reason: str, key: str = "case_id") -> DataFrame:
    """Cases with case_dirty, accounting_dirty and the reason for those that something has changed in."""
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    dirty = F.coalesce("_hit", F.lit(False))
    return cases.join(hit, key, "left").withColumns({"case_dirty": dirty, "accounting_dirty": dirty, "dirty_reason": F.when(dirty, F.lit(reason)).otherwise(F.lit(""))}).drop("_hit")
