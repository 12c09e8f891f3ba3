"""Queries of restored states, evidence to ask for, evidence groups of claims and all data of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, review, workflow
from ..sources import tables
from .registry import query, table

_AUDITS = """SELECT user_id, CASE event_type WHEN 'click' THEN 'case_workflow' WHEN 'view' THEN 'case_summary' ELSE 'other' END AS entity_type, event_id AS event_at, event_type || user_id AS actor,
  CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN '[1]' ELSE '{"s":' || event_id || '}' END
    WHEN event_id % 4 = 0 THEN 'broken' WHEN event_id % 4 = 1 THEN '{"analysis":{"k":[' || event_id || ']},"summary_approved":true,"strategy":true,"accounting_status":"ready","unknown":1}'
    WHEN event_id % 4 = 2 THEN '{"stages":[],"pleading_versions":[{"v":1}],"memo":null,"summary_approved_by":"x","strategy":{"a":1}}' END AS new_value_json FROM events"""
_APPROVALS = """SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'UI_STATE_MANAGER' ELSE 'someone' END AS approved_by, '{"research":"r' || o_orderkey || '","case_dirty":true,"stages":{"review":{}}}' AS summary_json, o_orderkey AS timestamp FROM orders"""


@query(f"""WITH a AS ({_AUDITS}), p AS ({_APPROVALS}),
w AS (SELECT user_id AS k, arg_max(coalesce(new_value_json, '{{}}'), event_at) AS j FROM a WHERE entity_type = 'case_workflow' AND coalesce(new_value_json, '{{}}') <> 'broken' GROUP BY 1),
u AS (SELECT o_custkey AS k, arg_max(summary_json, timestamp) AS j FROM p WHERE approved_by = 'UI_STATE_MANAGER' GROUP BY 1),
s AS (SELECT user_id AS k, arg_max(new_value_json, event_at) FILTER (WHERE new_value_json <> '[1]') AS j, arg_max(actor, event_at) AS actor FROM a WHERE entity_type = 'case_summary' GROUP BY 1 HAVING j IS NOT NULL),
c AS (SELECT c_custkey AS k, CASE WHEN w.k IS NOT NULL THEN 0 WHEN u.k IS NOT NULL THEN 1 WHEN s.k IS NOT NULL THEN 2 END AS source, coalesce(w.j, u.j, s.j) AS j, s.actor FROM customer LEFT JOIN w ON w.k = c_custkey LEFT JOIN u ON u.k = c_custkey LEFT JOIN s ON s.k = c_custkey)
SELECT k AS c_custkey, source, CASE WHEN source = 2 THEN j END AS attorney_summary, coalesce(source = 2 OR contains(j, '"summary_approved":true'), false) AS summary_approved,
  CASE WHEN source = 2 THEN actor WHEN source = 0 AND contains(j, '"memo"') THEN 'x' ELSE '' END AS summary_approved_by, CASE WHEN contains(j, '"ready"') THEN 'ready' ELSE 'not_started' END AS accounting_status,
  CASE WHEN contains(j, '"strategy":{{') THEN '{{"a":1}}' END AS strategy, CASE WHEN source = 0 AND contains(j, '"analysis"') THEN json_extract_string(j, '$.analysis') END AS analysis,
  CASE WHEN source = 1 THEN '{{"review":{{}}}}' ELSE '{{}}' END AS stages, CASE WHEN contains(j, '"pleading_versions"') THEN '[{{"v":1}}]' ELSE '[]' END AS pleading_versions,
  CASE WHEN source = 1 THEN json_extract_string(j, '$.research') END AS research, coalesce(source = 1, false) AS case_dirty FROM c""")
def q160_restored_state(spark: SparkSession, sf: str) -> DataFrame:
    """States from the workflow's log, from older state records and from summaries alone."""
    e, k, t = table(spark, sf, "events"), F.col("event_id"), F.col("event_type")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    state = F.when(k % 4 == 0, "broken").when(k % 4 == 1, said('{"analysis":{"k":[', k, ']},"summary_approved":true,"strategy":true,"accounting_status":"ready","unknown":1}')).when(k % 4 == 2, '{"stages":[],"pleading_versions":[{"v":1}],"memo":null,"summary_approved_by":"x","strategy":{"a":1}}')
    value = F.when(t == "view", F.when(k % 5 == 0, "[1]").otherwise(said('{"s":', k, "}"))).otherwise(state)
    audits = e.select(F.col("user_id").alias("c_custkey"), F.when(t == "click", "case_workflow").when(t == "view", "case_summary").otherwise("other").alias("entity_type"), value.alias("new_value_json"), k.alias("event_at"), F.concat(t, F.col("user_id")).alias("actor"))
    o = table(spark, sf, "orders")
    keeper = F.when(F.col("o_orderpriority") == "1-URGENT", "UI_STATE_MANAGER").otherwise("someone")
    approvals = o.select(F.col("o_custkey").alias("c_custkey"), keeper.alias("approved_by"), said('{"research":"r', F.col("o_orderkey"), '","case_dirty":true,"stages":{"review":{}}}').alias("summary_json"), F.col("o_orderkey").alias("timestamp"))
    found = workflow.restored_state(table(spark, sf, "customer"), audits, approvals, "c_custkey")
    return found.select("c_custkey", "source", "attorney_summary", "summary_approved", "summary_approved_by", "accounting_status", "strategy", "analysis", "stages", "pleading_versions", "research", "case_dirty")


@query(r"""WITH a AS (SELECT user_id, event_id, 'Type  ' || event_id % 3 || ' ' AS kind, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 > 1 THEN ' Doc  ' || event_id % 5 END AS said, CASE WHEN event_id % 2 = 0 THEN 'page 1 ' END AS referenced, CASE WHEN event_id % 7 < 3 THEN 'why' END AS reason FROM events WHERE event_type IN ('click', 'purchase')),
d AS (SELECT user_id, event_id, trim(kind) AS evidence_type, concat_ws(chr(10), nullif(trim(coalesce(said, '')), ''), 'Referenced in document: ' || trim(referenced) || '.', 'Purpose: ' || reason) AS description FROM a),
s AS (SELECT *, regexp_replace(lower(evidence_type), '\s+', ' ', 'g') AS k, regexp_replace(lower(trim(description)), '\s+', ' ', 'g') AS v FROM d)
SELECT user_id, event_id, evidence_type AS evidence_title, evidence_type, description, 'not_received' AS authenticity_status, 'not_received' AS completeness_status, 'requested' AS relevance_status, 'not_assessed' AS reliability_status, 'requested' AS review_status
FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, k, v ORDER BY event_id) = 1) WHERE NOT (k = 'type 0' AND v = 'doc 2 referenced in document: page 1.' AND user_id IN (SELECT c_custkey FROM customer))""")
def q161_follow_up_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence that reviews ask for and that no case has or asks for already."""
    k = F.col("event_id")
    actions = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "purchase"), "request_evidence").otherwise("ask_question").alias("action_type"), F.concat(F.lit("Type  "), k % 3, F.lit(" ")).alias("evidence_type"),
        F.when(k % 4 == 0, "").when(k % 4 > 1, F.concat(F.lit(" Doc  "), k % 5)).alias("evidence_description"), F.when(k % 2 == 0, "page 1 ").alias("referenced_in_document"), F.when(k % 7 < 3, "why").alias("reason"),
    )
    existing = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("TYPE 0").alias("evidence_type"), F.lit("doc 2 \n Referenced in  document: page 1.").alias("description"))
    return review.follow_up_evidence(actions, existing, ["user_id"], "event_id")


@query("""WITH o AS (SELECT o_orderkey, 'C' || o_orderkey AS claim_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 4 AS r FROM orders)
SELECT claim_id, 'supporting_evidence' AS kind, 0 AS ord, '' AS said, id AS ids FROM o WHERE r = 0 OR r = 1 UNION ALL SELECT claim_id, 'supporting_evidence', 2, 'text', '' FROM o WHERE r = 0 UNION ALL SELECT claim_id, 'contradicting_evidence', 0, 'bad', id FROM o WHERE r = 2
UNION ALL SELECT claim_id, 'unverified', 0, '', CASE r WHEN 0 THEN 'X,Y' WHEN 1 THEN 'Z' ELSE 'Q' END FROM o WHERE r < 3""")
def q162_evidence_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, older lists and unknown records of an evaluation a claim, against the orders."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("r"), F.col("o_orderkey").cast("string").alias("id"))
    no = lambda kind: F.lit(None).cast(kind)
    entry = lambda ids=None, one=None, why=None, what=None: F.struct((no("array<string>") if ids is None else ids).alias("record_ids"), (no("string") if one is None else one).alias("record_id"), (no("string") if why is None else F.lit(why)).alias("explanation"), (no("string") if what is None else F.lit(what)).alias("description"))
    rows = o.select(
        F.concat(F.lit("C"), "id").alias("claim_id"),
        F.when(F.col("r") == 0, F.array(entry(F.array(F.col("id"), F.lit("X"), F.col("id"))), entry(F.array(F.lit("Y")), why="gone"), entry(why=" text "))).alias("supporting_evidence"),
        no(f"array<{claims.ENTRY}>").alias("partially_supporting_evidence"),
        F.when(F.col("r") == 2, F.array(entry(F.array(F.lit("Q")), why="gone"))).alias("contradicting_evidence"),
        F.when(F.col("r") == 3, F.array(entry(why=" "))).alias("unresolved_evidence"),
        F.when(F.col("r") == 1, F.array(F.col("id"), F.lit("Z"), F.lit(" "))).when(F.col("r") == 0, F.array("id")).alias("evidence_record_ids"),
        F.when(F.col("r") == 1, F.array(entry(one=F.col("id")))).alias("financial_evidence_found"),
        F.when(F.col("r") == 2, F.array(entry(one=F.col("id"), what="bad"))).alias("contradictions"),
    )
    entries, unverified = claims.grouped_evidence(rows, o.select(F.col("id").alias("row_id")))
    joined = lambda c: F.array_join(c, ",").alias("ids")
    return entries.select("claim_id", "kind", "ord", F.col("text").alias("said"), joined("ids")).union(unverified.select("claim_id", F.lit("unverified"), F.lit(0), F.lit(""), joined("unverified")))


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey < 5)
SELECT c_custkey AS case_id, 'customer' AS collection, 1 AS n, c_name AS first FROM customer WHERE c_nationkey < 5
UNION ALL SELECT o_custkey, 'orders', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders JOIN c ON c_custkey = o_custkey GROUP BY 1
UNION ALL SELECT user_id, 'events', count(*), min(event_type) FROM events JOIN c ON c_custkey = user_id GROUP BY 1""")
def q163_case_data(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is stored on the customers of some nations."""
    of = lambda name, key: table(spark, sf, name).withColumnRenamed(key, "case_id")
    cases = of("customer", "c_custkey")
    found = tables.case_data({"customer": cases, "orders": of("orders", "o_custkey"), "events": of("events", "user_id")}, "case_id", cases.where("c_nationkey < 5"))
    shown = F.coalesce(*[F.get_json_object("record", f"$.{c}") for c in ("c_name", "o_orderkey", "event_type")])
    return found.groupBy("case_id", "collection").agg(F.count(F.lit(1)).alias("n"), F.min(shown).alias("first"))
