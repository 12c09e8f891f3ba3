"""Queries: the register and what it is made of, case lists, messages, versions, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, register, relational, workflow
from .records import LINES, lines
from .registry import query, table


def _json_pages(*ids: Column) -> Column:
    return F.to_json(F.array(*ids))


def _labels(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """Pages prefix0 ... of one file."""
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("page_id"), F.concat(F.lit("file — page "), F.col("id")).alias("label"))


def _party_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 5 == 0, "Plaintiff").when(k % 5 == 1, "first defendant").when(k % 5 == 2, "BANK").when(k % 5 == 3, "").otherwise("witness")
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("case_id"), k.alias("ord"), k.alias("party_id"), F.concat(F.lit("Segment "), "c_mktsegment").alias("party_name"), role.alias("role_in_case"), _json_pages(F.concat(F.lit("P"), k % 7)).alias("source_page_ids_json")
    )


@query("""WITH r AS (SELECT c_nationkey AS case_id, c_custkey AS o, 'Segment ' || c_mktsegment AS name, CASE c_custkey % 5 WHEN 0 THEN 'Plaintiff' WHEN 1 THEN 'first defendant' WHEN 2 THEN 'BANK' WHEN 3 THEN '' ELSE 'witness' END AS role, c_custkey % 7 AS page FROM customer),
l AS (SELECT case_id, name, string_agg(CASE WHEN page < 5 THEN 'file — page ' || page ELSE 'Page P' || page END, '|' ORDER BY f) AS labels FROM (SELECT case_id, name, page, min(o) AS f FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
m AS (SELECT case_id, name, CAST(min(o) AS VARCHAR) AS party_id, arg_min(role, o) FILTER (WHERE role <> '') AS role, count(*) AS merged_count FROM r GROUP BY 1, 2)
SELECT m.*, CAST(CASE role WHEN 'Plaintiff' THEN 0 WHEN 'first defendant' THEN 1 WHEN 'BANK' THEN 3 ELSE 99 END AS BIGINT) AS role_rank, labels FROM m JOIN l USING (case_id, name)""")
def q90_parties(spark: SparkSession, sf: str) -> DataFrame:
    found = register.labelled(register.parties(_party_rows(spark, sf)), ["case_id", "merge_key"], _labels(spark, "P", 5))
    return found.select("case_id", "name", "party_id", "role", "merged_count", F.col("role_rank").cast("long").alias("role_rank"), F.array_join("page_labels", "|").alias("labels"))


@query("""SELECT o_custkey AS case_id, 'in ' || strftime(o_orderdate, '%Y') AS date, o_orderpriority AS description, CAST(min(o_orderkey) AS VARCHAR) AS event_id, arg_min(o_orderstatus, o_orderkey) AS event_type, strftime(o_orderdate, '%Y') || '-99-99' AS iso, count(*) AS merged_count FROM orders GROUP BY 1, 2, 3, 6""")
def q91_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("event_id"), F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy")).alias("event_date"), F.col("o_orderpriority").alias("event_description"), F.col("o_orderstatus").alias("event_type"))
    return register.events(rows).select("case_id", "date", "description", "event_id", "event_type", F.col("event_order.iso").alias("iso"), "merged_count")


def _balance(spark: SparkSession, sf: str, name: str, prefix: str, word: str, status: Column) -> DataFrame:
    key = F.col(f"{prefix}_{'supp' if prefix == 's' else 'cust'}key")
    bucket = F.floor((F.col(f"{prefix}_acctbal") + 1000) / 1000)
    return table(spark, sf, name).select(F.col(f"{prefix}_nationkey").alias("case_id"), key.alias("ord"), F.concat(F.lit(word), bucket).alias("fact_text"), status.alias("status"), key.alias("fact_id"))


_FACTS = """u AS (SELECT s_nationkey AS case_id, 0 AS src, s_suppkey AS o, floor((s_acctbal + 1000) / 1000)::BIGINT AS b, 'stated' AS status FROM supplier
 UNION ALL SELECT c_nationkey, 1, c_custkey, floor((c_acctbal + 1000) / 1000)::BIGINT, CASE WHEN c_custkey % 3 = 0 THEN 'alleged' ELSE 'unclassified' END FROM customer)"""


def _fact_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey") % 3
    return _balance(spark, sf, "supplier", "s", "Balance ", F.lit("")), _balance(spark, sf, "customer", "c", "balance, ", F.when(k == 0, "Alleged").when(k == 1, "Pending"))


@query(f"""WITH {_FACTS} SELECT case_id, 'balance ' || b AS merge_key, arg_min(status, src * 1000000000000 + o) AS status, CASE WHEN min(src) = 0 THEN 'yes' END AS approved, count(*) AS merged_count FROM u GROUP BY case_id, b""")
def q92_register_facts(spark: SparkSession, sf: str) -> DataFrame:
    return register.facts(*_fact_rows(spark, sf)).select("case_id", "merge_key", "status", "approved", "merged_count")


@query(f"""WITH {_FACTS}, f AS (SELECT case_id, b, arg_min(status, src * 1000000000000 + o) AS status FROM u GROUP BY 1, 2) SELECT case_id, count(*) AS n FROM f WHERE status = 'alleged' GROUP BY 1""")
def q93_allegations(spark: SparkSession, sf: str) -> DataFrame:
    return register.allegations(register.facts(*_fact_rows(spark, sf))).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def _issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("issue_title"), F.when(k == 0, "High").when(k == 1, "low").when(k == 2, "critical").alias("priority"), "o_orderstatus")


@query("""WITH u AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS src, o_orderkey AS o, o_orderpriority AS title, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'critical' ELSE 'medium' END AS priority FROM orders),
m AS (SELECT case_id, title, arg_min(priority, src * 1000000000000 + o) AS priority, min(src) AS later, count(*) AS merged_count FROM u GROUP BY 1, 2)
SELECT case_id, title, priority, CAST(later AS BIGINT) AS later, CAST(CASE priority WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 0 END AS BIGINT) AS rank, merged_count FROM m""")
def q94_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = _issue_rows(spark, sf)
    found = register.issues(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"))
    return found.select("case_id", "title", "priority", F.col("issue_order.later").cast("long").alias("later"), F.col("issue_order.rank").cast("long").alias("rank"), "merged_count")


@query("""WITH c AS (SELECT c_nationkey AS k, floor((c_acctbal + 1000) / 1000)::BIGINT AS b, * FROM customer), s AS (SELECT s_nationkey AS k, floor((s_acctbal + 1000) / 1000)::BIGINT AS b, * FROM supplier),
f AS (SELECT k, b FROM c UNION SELECT k, b FROM s), a AS (SELECT k, b, arg_min(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, c_custkey) AS alleged FROM c WHERE (k, b) NOT IN (SELECT (k, b) FROM s) GROUP BY 1, 2)
SELECT k AS case_id, (SELECT count(DISTINCT c_mktsegment) FROM c WHERE c.k = n.k) AS parties, (SELECT count(*) FROM s WHERE s.k = n.k) AS events, (SELECT count(*) FROM f WHERE f.k = n.k) AS facts,
 (SELECT coalesce(sum(alleged), 0)::BIGINT FROM a WHERE a.k = n.k) AS allegations, (SELECT count(DISTINCT c_mktsegment) FROM c WHERE c.k = n.k) AS issues, (SELECT count(DISTINCT b) FROM c WHERE c.k = n.k) AS evidence_requests, (SELECT count(DISTINCT b) FROM s WHERE s.k = n.k) AS contradictions
FROM (SELECT k FROM c UNION SELECT k FROM s) n""")
def q95_register_totals(spark: SparkSession, sf: str) -> DataFrame:
    approved, candidates = _fact_rows(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("issue_title"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("ord"), F.lit("1999").alias("event_date"), F.col("s_name").alias("event_description"))
    said = lambda df: df.select("case_id", "ord", F.col("fact_text").alias("description"))
    sources = {"parties": _party_rows(spark, sf), "events": s, "facts": approved, "fact_candidates": candidates, "issues": c.where("ord % 2 = 0"), "issue_candidates": c.where("ord % 2 = 1"), "evidence": said(candidates), "contradictions": said(approved)}
    _, totals = register.assembled(sources, _labels(spark, "P", 5))
    return totals.select("case_id", *[F.col(f"n_{k}").alias(k) for k in ("parties", "events", "facts", "allegations", "issues", "evidence_requests", "contradictions")])


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS undated, CASE WHEN o_orderkey % 5 = 0 THEN '9999-99-99' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'inferred_sequence' ELSE 'dated_source' END AS basis, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_pages FROM orders WHERE o_orderstatus <> 'P'""")
def q96_chronology(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy/MM/dd")).alias("event_date"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("event_description"), F.when(k % 3 == 0, "[broken").otherwise('["a","b"]').alias("source_id")
    )
    return register.chronology(rows).select("o_orderkey", F.col("shown_order.undated").cast("long").alias("undated"), F.col("shown_order.day").alias("day"), F.col("chronology_basis").alias("basis"), F.size("source_page_ids").cast("long").alias("n_pages"))


@query(f"""WITH l AS ({LINES}), f AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'X1' WHEN l_linestatus = 'F' THEN 'PG' || l_orderkey || '-' || line END AS page FROM l)
SELECT l_orderkey, CAST(line AS BIGINT) AS line, coalesce(page, '') AS pages, CASE WHEN page IS NULL THEN '' WHEN page = 'X1' THEN 'Page X1' ELSE 'file — page ' || line END AS labels FROM f""")
def q97_facts_register(spark: SparkSession, sf: str) -> DataFrame:
    li = lines(spark, sf).withColumns({"case_document_id": F.col("l_orderkey"), "page_number": F.col("line")})
    facts = li.select("l_orderkey", "line", "case_document_id", "page_number", F.concat_ws("-", "l_orderkey", "line").alias("fact_id"), F.lit("said").alias("fact_text"), F.when(F.col("l_partkey") % 3 == 0, '["X1"]').otherwise("[]").alias("source_page_ids_json"))
    pages = li.where("l_linestatus = 'F'").select("case_document_id", "page_number", F.concat(F.lit("PG"), "l_orderkey", F.lit("-"), "line").alias("page_id"), F.lit(1).alias("ord"), F.concat(F.lit("file — page "), "line").alias("label"))
    found = register.facts_register(facts, pages, pages)
    return found.select("l_orderkey", F.col("line").cast("long").alias("line"), F.array_join("page_ids", "|").alias("pages"), F.array_join("page_labels", "|").alias("labels"))


@query("""SELECT conv_id AS case_id, CAST(count(*) AS BIGINT) AS pages, count_if(role <> 'system' AND trim(text) <> '') AS usable_pages, CAST(count(DISTINCT role) AS BIGINT) AS documents FROM conversations GROUP BY 1""")
def q98_page_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("case_id", F.col("conv_id"))
    pages = c.select("case_id", F.when(F.col("role") == "system", "failed").alias("processing_status"), F.col("text").alias("page_text"))
    return register.page_sources(c.select("case_id", "role").distinct(), pages).select("case_id", "pages", "usable_pages", "documents")


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, 3 * (l_linenumber % 3) + l_partkey % 2 + 1 AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY 3 * (l_linenumber % 3) + l_partkey % 2 + 1 DESC, line) AS place FROM l""")
def q99_pages_for_summary(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda n: F.to_json(F.array_repeat(F.lit("x"), n.cast("int")))
    pages = lines(spark, sf).select("l_orderkey", "line", some(F.col("l_linenumber") % 3).alias("claims_json"), some(F.col("l_partkey") % 2).alias("facts_json"), F.lit('["p"]').alias("parties_json"))
    ranked = relational.ranked(register.pages_for_summary(pages), ["l_orderkey"], [F.col("weight").desc(), F.col("line")], "place")
    return ranked.select("l_orderkey", F.col("line").cast("long").alias("line"), F.col("weight").cast("long").alias("weight"), F.col("place").cast("long").alias("place"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "litigation").when(k % 4 == 1, "").when(k % 4 == 2, "agreement_review")
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("CS-"), F.lpad(k.cast("string"), 8, "0")).alias("case_id"), F.col("c_name").alias("client_name"), kind.alias("workflow_type"), F.when(k % 3 != 0, "2024-01-02T03:04:05Z").alias("updated_at"), F.lit("2023-05-06 07:08").alias("created_at"))


@query("""SELECT 'CASE-' || right(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 6) AS reference, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '2023-05-06 07:08' ELSE '2024-01-02 03:04' END AS activity FROM customer WHERE c_custkey % 4 <> 2""")
def q100_case_cards(spark: SparkSession, sf: str) -> DataFrame:
    return cases.cards(cases.of_workflow(_cases(spark, sf), "litigation")).select("reference", "title", "activity")


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'agreement_review' ELSE 'litigation' END AS workflow, count(*) AS n FROM customer GROUP BY 1""")
def q101_workflow_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    return table(spark, sf, "customer").select(cases.workflow_type(F.when(k == 0, " Contract Review").when(k == 1, "dispute"), {**cases.WORKFLOWS, "dispute": "litigation"}).alias("workflow")).groupBy("workflow").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role IN ('user', 'assistant')""")
def q102_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return cases.conversation(table(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("""WITH h AS (SELECT c_nationkey AS nation, 0 AS n, 'customer' AS kind, c_custkey AS o FROM customer WHERE contains(lower(c_name), '#00000') OR contains(lower(c_mktsegment), '#00000') UNION ALL SELECT s_nationkey, 1, 'supplier', s_suppkey FROM supplier WHERE contains(lower(s_name), '#00000')),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n, o) AS place, count(*) OVER (PARTITION BY nation) AS total FROM h) SELECT nation, kind, o AS ord, place, total FROM r WHERE place <= 25""")
def q103_search_all(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("ord"), "c_name", "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("ord"), "s_name")
    hits, totals = cases.search_all("#00000", {"customer": (c, ["c_name", "c_mktsegment"]), "supplier": (s, ["s_name"])}, ["nation"], "ord")
    return hits.join(totals, "nation").select("nation", "kind", "ord", F.col("place").cast("long").alias("place"), "total")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'issue' ELSE 'risk' END AS kind, CAST(CASE substring(o_orderpriority, 3) WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS BIGINT) AS rank, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2""")
def q104_open_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("severity", F.expr("substring(o_orderpriority, 3)"))
    found = cases.open_items({"issue": o.where("o_orderstatus = 'F'"), "risk": o.where("o_orderstatus <> 'F'")}, F.col("o_orderkey") % 2 == 0)
    return found.groupBy("kind", cases.severity_rank(F.col("severity")).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type FROM events), f AS (SELECT user_id, event_id AS first FROM d WHERE version = 1)
SELECT d.user_id, version, CASE WHEN event_type = 'error' THEN first ELSE event_id END AS draft, CASE WHEN event_type = 'error' THEN 'restored:1' ELSE event_type END AS note FROM d JOIN f USING (user_id)""")
def q105_versions(spark: SparkSession, sf: str) -> DataFrame:
    drafts = table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("draft"), F.col("event_type").alias("note"), F.when(F.col("event_type") == "error", 1).alias("restores"))
    # a user whose first event is an error restores itself
    return cases.with_versions(drafts, ["user_id"], "event_id").select("user_id", F.col("version").cast("long").alias("version"), "draft", "note")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'needs_review' WHEN c_custkey % 4 = 0 THEN 'complete_no_transactions' WHEN c_custkey % 5 = 0 THEN 'completed' ELSE 'ready_for_synthesis' END AS next_status, c_custkey % 3 = 0 AS waits, c_custkey % 4 <> 0 AS has_lines, c_custkey % 7 = 0 AS dirty, c_custkey % 2 = 0 AS gate, c_custkey % 6 = 0 AND c_custkey % 7 <> 0 AS strict_gate FROM customer""")
def q106_accounting_flags(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer").withColumn("case_id", F.col("c_custkey")), F.col("c_custkey")
    marked = cases.invalidated(c, c.where(k % 7 == 0), "documents changed")
    pending, items = F.when(k % 3 == 0, 2).otherwise(0), F.when(k % 4 == 0, 0).otherwise(5)
    flags = cases.accounting_flags(F.lit(" Completed"), items, F.lit(None).cast("int"), pending, F.lit(0), F.lit(None).cast("int"), F.col("accounting_dirty"))
    gate = lambda strict: cases.gate_passed(k % 2 == 0, F.when(k % 6 == 0, True), F.col("case_dirty"), strict)
    return marked.select(
        "c_custkey", workflow.accounting_status(pending, items, F.when(k % 5 == 0, "completed")).alias("next_status"), flags["has_pending_review"].alias("waits"), flags["has_line_items"].alias("has_lines"), flags["dirty"].alias("dirty"), gate(False).alias("gate"), gate(True).alias("strict_gate")
    )


@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_type AS modified, min(event_id) AS first FROM events GROUP BY 1, 2""")
def q107_distinct_uploads(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("name"), F.lit(10).alias("size"), F.col("event_type").alias("modified"), F.col("event_id").alias("ord"))
    return cases.distinct_uploads(files).select("name", "modified", F.col("ord").alias("first"))


@query("""SELECT DISTINCT l_partkey AS page FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' AND l_partkey % 5 <> 0""")
def q108_selected_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_document_id"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("page_id"))
    chosen = table(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("case_document_id"))
    return cases.selected_pages(pages, chosen).distinct().select(F.col("page_id").alias("page"))


@query("""SELECT c_custkey AS case_id, arg_max(o_orderkey, o_orderkey) AS stored FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q109_latest_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("stored"), F.lit(0).alias("ingested_at"), F.col("o_orderkey").alias("ingest_seq"))
    return cases.latest_cases(rows).select("case_id", "stored")
