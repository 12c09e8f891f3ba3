"""A case's state from its log, and the status of its six stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in order, and what each depends on.
STAGES = ["documents", "review", "accounting", "analysis", "pleading", "discussion"]
DEPENDENCIES = {"documents": [], "review": ["documents"], "accounting": ["documents"], "analysis": ["review"], "pleading": ["analysis", "accounting"], "discussion": ["documents"]}
ACCOUNTING_DONE = ["complete", "completed", "complete_no_transactions"]
ENDED = ["completed", "ready", "waiting_for_user"]
INTERRUPTED = "The step was interrupted before it finished."


def latest_valid_json(log: DataFrame, keys: list[str], order: list[str], json: str) -> DataFrame:
    """Of each key the last row whose text is a JSON object."""
    from .relational import latest_by_key

    return latest_by_key(log.where(F.try_parse_json(json).isNotNull() & F.trim(json).startswith("{")), keys, order)


def latest_states(log: DataFrame, keys: list[str], order: list[str], json: str) -> DataFrame:
    """The last row of each key; what is no JSON object counts as an empty one."""
    from .relational import latest_by_key

    good = F.try_parse_json(json).isNotNull() & F.trim(json).startswith("{")
    return latest_by_key(log, keys, order).withColumn(json, F.when(good, F.col(json)).otherwise(F.lit("{}")))


def merge_stage_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """events: keys, stage, status, error, job_id, at (later rows patch earlier ones, null fields patch nothing).

    One record a key and stage: the last status; started_at of the last run; finished_at of the last end (kept while
    running); the error only while nothing has begun or ended since; job_id only while running.
    """
    o = F.struct(*order)
    begun, ended = F.col("status") == "running", F.col("status").isin(ENDED)
    out = events.groupBy(*keys, "stage").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), o)).alias("status"),
        F.max_by("at", F.when(begun, o)).alias("started_at"),
        F.max_by("at", F.when(ended, o)).alias("finished_at"),
        F.max_by("at", o).alias("updated_at"),
        F.max_by(F.struct(F.when(begun | ended, F.lit("")).otherwise(F.col("error")).alias("e")), F.when(begun | ended | F.col("error").isNotNull(), o)).alias("_error"),
        F.max_by("job_id", F.when(F.col("job_id").isNotNull(), o)).alias("_job"),
    )
    return out.withColumns({"error": F.coalesce("_error.e", F.lit("")), "job_id": F.when(F.col("status") == "running", F.col("_job"))}).drop("_error", "_job")


def derived_status(stage: Column, f: dict[str, Column]) -> Column:
    """The status that stored outputs alone give. f: has_documents, has_summary, gate_passed, case_dirty, has_analysis, has_memo,
    accounting_status, pending_count, has_line_items, accounting_dirty."""
    yes = lambda name: F.coalesce(f[name], F.lit(False))
    accounted = F.coalesce(f["accounting_status"].isin(ACCOUNTING_DONE), F.lit(False))
    pending = F.coalesce(f["pending_count"], F.lit(0)) > 0
    dirty_or_done = lambda dirty: F.when(dirty, "stale").otherwise("completed")
    inputs_missing = ~yes("has_analysis") | ~accounted | pending
    return (
        F.when(stage == "documents", F.when(yes("has_documents"), "completed").otherwise("not_started"))
        .when(stage.isin("review", "accounting", "discussion") & ~yes("has_documents"), "blocked")
        .when(stage == "review", F.when(~yes("has_summary"), "not_started").when(yes("gate_passed"), dirty_or_done(yes("case_dirty"))).otherwise("waiting_for_user"))
        .when(stage == "accounting", F.when(pending, "waiting_for_user").when(accounted, dirty_or_done(yes("accounting_dirty"))).when((f["accounting_status"] == "ready_for_synthesis") | yes("has_line_items"), "ready").otherwise("not_started"))
        .when(stage == "analysis", F.when(~yes("gate_passed"), "blocked").when(yes("has_analysis"), dirty_or_done(yes("case_dirty"))).otherwise("not_started"))
        .when(stage == "pleading", F.when(yes("has_memo"), F.when(inputs_missing, "stale").otherwise("completed")).when(inputs_missing, "blocked").otherwise("not_started"))
        .when(stage == "discussion", "ready")
        .otherwise("not_started")
    )


def overview(stages: DataFrame, key: str) -> DataFrame:
    """stages: key, stage, derived (status), record_status, finished_at, error, live (a job runs), used_fingerprint,
    fingerprint. Adds status, stale_because and state (complete, current, upcoming). A case's rows come together once; what a stage
    depends on is looked up among them, so nothing is joined."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    w = Window.partitionBy(key)
    upstream = {d: F.max(F.when(F.col("stage") == d, F.col("finished_at"))).over(w).alias(f"_at_{d}") for d in dict.fromkeys(d for ds in DEPENDENCIES.values() for d in ds)}
    finished = F.nullif(F.col("finished_at"), F.lit(""))
    later = [F.when((F.col("stage") == s) & F.col(key).isNotNull() & (F.col(f"_at_{d}") > finished), F.lit(d)) for s, ds in DEPENDENCIES.items() for d in ds]
    joined = stages.select("*", *upstream.values()).withColumn("_dependency", F.coalesce(*later)).drop(*[f"_at_{d}" for d in upstream])
    other_documents = (F.col("used_fingerprint") != "") & (F.col("fingerprint") != "") & (F.col("used_fingerprint") != F.col("fingerprint"))
    stale = F.when(F.col("derived") == "completed", F.when(F.coalesce(other_documents, F.lit(False)), "documents").otherwise(F.col("_dependency")))
    status = (
        F.when(F.coalesce("live", F.lit(False)), "running")
        .when(F.col("record_status").isin("running", "error"), "error")
        .when(stale.isNotNull(), "stale")
        .otherwise(F.col("derived"))
    )
    message = F.when(status == "error", F.when(F.col("record_status") == "running", F.lit(INTERRUPTED)).otherwise(F.coalesce("error", F.lit("")))).otherwise(F.lit(""))
    out = joined.withColumns({"status": status, "stale_because": F.when(status == "stale", stale), "error": message, "place": place}).drop("_dependency")
    first_open = F.min(F.when(F.col("status") != "completed", F.col("place"))).over(w)
    return out.withColumn("state", F.when(F.col("status") == "completed", "complete").when(F.col("place") == first_open, "current").otherwise("upcoming"))


def next_stage(stages: DataFrame, key: str) -> DataFrame:
    """Of an overview: the first stage that waits, else that failed, else that is open (but discussion), else discussion."""
    at = lambda hit: F.min_by("stage", F.when(hit, F.col("place")))
    s = F.col("status")
    return stages.groupBy(key).agg(F.coalesce(at(s == "waiting_for_user"), at(s == "error"), at(s.isin("not_started", "ready", "stale") & (F.col("stage") != "discussion")), F.lit("discussion")).alias("next_stage"))


def accounting_status(pending: Column, line_items: Column, current: Column) -> Column:
    """What the accounting becomes after an extraction or a decision."""
    done = current.isin(ACCOUNTING_DONE)
    return F.when(pending > 0, "needs_review").when(line_items == 0, "complete_no_transactions").when(F.coalesce(done, F.lit(False)), current).otherwise("ready_for_synthesis")


def stale_summaries(cases: DataFrame, uploads: DataFrame, key: str, approved_at: str, uploaded_at: str) -> DataFrame:
    """Cases with an upload after the approval, or with an approval that can't be read. Of a case's uploads only the last is joined."""
    last = uploads.groupBy(F.col(key).alias("_key")).agg(F.max(uploaded_at).alias("_up"))
    joined = cases.join(last, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col(approved_at).isNull() | (F.col("_up") > F.col(approved_at))).select(*cases.columns)


# What a case's state holds, and what a blank one is: JSON texts, plain texts and flags.
STATE_JSON = {"attorney_summary": None, "research": None, "analysis": None, "strategy": None, "memo": None, "pleading_versions": "[]", "stages": "{}"}
STATE_TEXTS = {"summary_approved_by": "", "accounting_status": "not_started", "accounting_dirty_reason": "", "accounting_instructions": "", "pleading_status": "draft", "pleading_finalised_by": "", "dirty_reason": ""}
STATE_FLAGS = {"summary_approved": False, "accounting_dirty": False, "case_dirty": False}
STATE_ENTITY, SUMMARY_ENTITY, STATE_KEEPER = "case_workflow", "case_summary", "UI_STATE_MANAGER"


def restored_state(cases: DataFrame, audits: DataFrame, approvals: DataFrame, key: str) -> DataFrame:
    """Each case's state: key, source (0 to 2, null for a blank state) and a column for each name of STATE_*.

    From the first of three sources that has a JSON object for the case, its last one: audit rows of the workflow (key, entity_type, new_value_json,
    event_at, actor), the older state records among approvals (key, approved_by, summary_json, timestamp), or a summary alone from the audits,
    which counts as approved, by the actor of its last row. Only known names are taken over (a null too), the others
    are blank; a strategy of true is none, stages that are no object and versions that are no list are empty. event_at and timestamp are
    unique within a case.
    """
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("{}"))
    usable = lambda c: F.try_parse_json(said(c)).isNotNull() & F.trim(said(c)).startswith("{")

    def last(rows: DataFrame, value: str, order: str, source: int, by: Column) -> DataFrame:
        own = rows.groupBy(key).agg(F.max_by(said(value), F.when(usable(value), F.col(order))).alias("_payload"), F.max_by(by, order).alias("_by"))
        return own.where(F.col("_payload").isNotNull()).select(key, F.lit(source).alias("source"), "_payload", "_by")

    nobody = F.lit(None).cast("string")
    found = (
        last(audits.where(F.col("entity_type") == STATE_ENTITY), "new_value_json", "event_at", 0, nobody)
        .unionByName(last(approvals.where(F.col("approved_by") == STATE_KEEPER), "summary_json", "timestamp", 1, nobody))
        .unionByName(last(audits.where(F.col("entity_type") == SUMMARY_ENTITY), "new_value_json", "event_at", 2, F.coalesce("actor", F.lit(""))))
    )
    first = found.groupBy(key).agg(F.min_by(F.struct("source", "_payload", "_by"), "source").alias("_s"))
    rows = cases.select(key).distinct().join(first, key, "left").select(key, "_s.source", "_s._payload", "_s._by")
    whole = F.coalesce(F.col("source") < 2, F.lit(False))
    names = F.json_object_keys("_payload")
    given = lambda n: whole & F.coalesce(F.array_contains(names, n), F.lit(False))
    value = lambda n: F.get_json_object("_payload", f"$.{n}")
    out = {n: F.when(given(n), value(n)).otherwise(F.lit(blank).cast("string")) for n, blank in {**STATE_JSON, **STATE_TEXTS}.items()}
    out |= {n: F.when(given(n), F.coalesce(value(n) == "true", F.lit(False))).otherwise(F.lit(blank)) for n, blank in STATE_FLAGS.items()}
    summary = F.coalesce(F.col("source") == 2, F.lit(False))
    out["attorney_summary"] = F.when(summary, F.col("_payload")).otherwise(out["attorney_summary"])
    out["summary_approved"] = summary | out["summary_approved"]
    out["summary_approved_by"] = F.when(summary, F.col("_by")).otherwise(out["summary_approved_by"])
    out["strategy"] = F.when(out["strategy"] != "true", out["strategy"])
    out["stages"] = F.when(F.coalesce(out["stages"].startswith("{"), F.lit(False)), out["stages"]).otherwise(F.lit("{}"))
    out["pleading_versions"] = F.when(F.coalesce(out["pleading_versions"].startswith("["), F.lit(False)), out["pleading_versions"]).otherwise(F.lit("[]"))
    return rows.select(key, "source", *[c.alias(n) for n, c in out.items()])
