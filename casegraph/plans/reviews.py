"""Queries: compact records, reviews, page summaries, research, claims, agreements, statement rows, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic, ids, money, text
from ..operators import agreements, claims, extraction, graph, ledger, projections, relational, research, retrieval, review, statement_rows
from .pipelines import _TOTALS, _reviewed, _tree
from .records import LINES, lines
from .registry import query, table


@query("""SELECT CAST(doc_id AS VARCHAR) AS message_id, lang AS role, CASE WHEN length(trim(text)) <= 700 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 700)) || '…' END AS message_text FROM documents""")
def q110_compact_records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("message_id"), F.col("lang").alias("role"), F.lit(None).cast("string").alias("message_text"), F.col("text").alias("content"))
    return projections.compact(d, projections.CHAT["message"]).select("message_id", "role", "message_text")


@query("""SELECT CAST(doc_id AS VARCHAR) AS fact_id, substring(trim(text), 1, 400) AS fact_text, source AS status FROM documents""")
def q111_analysis_facts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("fact_candidate_id"), F.col("text").alias("fact_text"), F.col("source").alias("status"))
    return projections.compact(d, projections.ANALYSIS["fact"], mark="")


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'c' || turn || '; f' WHEN length(trim(text)) <= 2000 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 2000)) || '…' END AS summary FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, summary FROM p WHERE summary <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def q112_compact_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    pages = c.select(
        "conv_id", F.col("conv_id").alias("case_document_id"), F.col("turn").alias("page_number"), F.col("turn").alias("page_id"), F.when(F.col("role") == "system", "failed").otherwise(" Completed").alias("processing_status"),
        F.when(F.col("turn") % 3 != 0, F.col("text")).alias("page_summary"), F.to_json(F.array(F.concat(F.lit("c"), "turn"))).alias("claims_json"), F.lit('["f"]').alias("facts_json"),
    )
    return projections.compact_pages(pages, "conv_id", 3).select("conv_id", F.col("page_number").alias("turn"), F.col("page_summary").alias("summary"))


@query("""SELECT event_id, '{"a":1,"n":{"b":2},"props":' || props || '}' AS state FROM events""")
def q113_without_keys(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit('{"a":1,"page_text":"x \\"q\\", y","n":{"RAW_CONTENT":[1,2],"b":2},"props":'), "props", F.lit(',"full_text":null}'))
    return projections.without_keys(table(spark, sf, "events").select("event_id", said.alias("state")), ["event_id"], "state")


@query("""SELECT o_orderkey, '{"record_id":"' || o_orderkey || '","description":"' || o_orderpriority || '"' || CASE WHEN o_orderstatus <> 'F' THEN ',"currency":"' || o_orderstatus || '"' ELSE '' END || ',"reviewer_note":"seen"}' AS record FROM orders""")
def q114_ledger_record(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderpriority").alias("description"), F.lit("").alias("date"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("currency"), F.lit("seen").alias("user_note"))
    return e.select("o_orderkey", projections.ledger_record(e).alias("record"))


@query(f"""WITH l AS ({LINES}), n AS (SELECT l_suppkey AS case_id, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + line) AS place FROM l)
SELECT case_id, 'facts' AS collection, place, '{{"l_partkey":"' || l_partkey || '"}}' AS record FROM n WHERE place <= 24 UNION ALL SELECT case_id, 'issues', place, '{{"l_partkey":"' || l_partkey || '"}}' FROM n WHERE place <= 12""")
def q115_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select(F.col("l_suppkey").alias("case_id"), (F.col("l_orderkey") * 100 + F.col("line")).alias("ord"), "l_partkey")
    return projections.heads({"facts": rows, "issues": rows}, "case_id", "ord").withColumn("place", F.col("place").cast("long"))


@query("""WITH o AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 + 1 AS chunk_no FROM orders)
SELECT o_custkey AS case_id, 'facts' AS section, chunk_no, count(*) AS n FROM o GROUP BY 1, 3 UNION ALL SELECT c_custkey, 'case', 1, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q116_review_batches(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), "o_orderpriority")
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    found = review.section_batches({"facts": facts}, ["case_id"], "ord", base, most=4)
    return found.select("case_id", "section", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("items").cast("long").alias("n"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY 1)
SELECT c.conv_id, min(length(c.text))::BIGINT AS score, bool_and(length(c.text) > 20) AS is_ready, any_value(s.roles) AS roles FROM conversations c JOIN s USING (conv_id) GROUP BY c.conv_id""")
def q117_merge_tree(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("score"), F.lit(True).alias("is_complete"), (F.char_length("text") > 20).alias("is_ready"), F.array("role").alias("roles"), F.lit("").alias("summary"))
    merged = review.merge_tree(parts, ["conv_id"], "turn", ["roles"], chars=220)
    return merged.select("conv_id", "score", "is_ready", F.array_join("roles", ",").alias("roles"))


@query("""SELECT event_id, CAST(CASE event_type WHEN 'click' THEN least(floor(value), 100) WHEN 'view' THEN 100 ELSE 0 END AS BIGINT) AS score, event_type IN ('click', 'view') AS is_complete, CASE WHEN event_id % 2 = 0 THEN 'why' ELSE 'a' END AS next_question, CASE WHEN event_id % 2 = 0 THEN 'why,a,b' ELSE 'a,b' END AS questions FROM events""")
def q118_normalised_reviews(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    reviews = table(spark, sf, "events").select(
        "event_id", F.when(kind == "click", F.col("value").cast("string")).when(kind == "view", "150").otherwise("good").alias("completeness_score"), F.when(kind == "click", "Yes").when(kind == "view", "true").otherwise("0").alias("is_complete"), F.lit(None).cast("string").alias("ready_for_analysis"),
        F.lit(" s ").alias("summary"), F.when(F.col("event_id") % 2 == 0, " why ").alias("next_question"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("questions"),
    )
    found = review.for_merge(review.normalised(reviews))
    return found.select("event_id", F.col("completeness_score").cast("long").alias("score"), "is_complete", "next_question", F.array_join("questions", ",").alias("questions"))


def _page_text() -> Column:
    dated = F.date_format("o_orderdate", "dd/MM/yyyy")
    return F.concat(F.lit("Customer Name |  C"), "o_custkey", F.lit("\nPlease deny  this claim\nreference: R-"), "o_orderkey", F.lit("/1995 dated "), dated, F.lit(", again "), dated, F.lit(" for 1,500 SAR\n"))


@query("""SELECT o_orderkey, 'C' || o_custkey AS parties, strftime(o_orderdate, '%d/%m/%Y') AS dates, '1,500 SAR' AS amounts, 'R-' || o_orderkey || '/1995' AS case_numbers, 'Please deny this claim' AS claims, 'page|table' AS evidence FROM orders""")
def q119_page_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").withColumn("page_text", _page_text())
    f = extraction.page_fields(F.col("page_text"))
    return found.select("o_orderkey", *[F.array_join(f[c], "|").alias(c) for c in ("parties", "dates", "amounts", "case_numbers", "claims")], F.array_join(f["evidence_items"], "|").alias("evidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'fallback_deterministic' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'told' ELSE 'Customer Name | C' || o_custkey || ' Please deny this claim reference: R-' || o_orderkey || '/1995 dated ' || strftime(o_orderdate, '%d/%m/%Y') || ', again ' || strftime(o_orderdate, '%d/%m/%Y') || ' for 1,500 SAR' END AS summary,
 CASE WHEN o_orderkey % 2 = 0 THEN 'k' END AS facts, CASE WHEN o_orderkey % 2 = 0 THEN 'May 1|' ELSE '' END || strftime(o_orderdate, '%d/%m/%Y') AS dates FROM orders""")
def q120_page_summaries(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.struct(F.lit(" told ").alias("summary"), F.array(F.lit("k"), F.lit("K ")).alias("key_facts"), F.array(F.lit("May  1")).alias("dates"))
    pages = table(spark, sf, "orders").withColumns({"page_text": _page_text(), "answer": F.when(F.col("o_orderkey") % 2 == 0, answer)})
    found = extraction.page_summaries(pages)
    return found.select("o_orderkey", F.col("summary_status").alias("status"), F.col("page_summary").alias("summary"), F.when(F.col("answer").isNotNull(), F.array_join("facts", "|")).alias("facts"), F.array_join("dates", "|").alias("dates"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'failed' WHEN turn % 2 = 0 THEN 'completed' ELSE 'completed_review_required' END AS status, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'slow' ELSE 'slow' || chr(10) || 'summary:none' END AS warning, CAST(CASE WHEN role = 'system' THEN 0 ELSE length(trim(text)) END AS BIGINT) AS n FROM conversations""")
def q121_page_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).otherwise("  ").alias("page_text"), F.when(t % 2 == 1, " Completed_Review_Required").alias("processing_status"), F.when(t % 3 != 0, "slow").alias("extraction_warning"), F.when(t % 3 == 2, "none").alias("summary_warning"))
    return extraction.page_rows(pages).select("conv_id", "turn", F.col("processing_status").alias("status"), F.col("extraction_warning").alias("warning"), F.col("text_character_count").cast("long").alias("n"))


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, CASE l_partkey % 3 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) END AS amount, CASE WHEN l_partkey % 3 = 0 THEN 'debit' ELSE '' END AS direction, CASE WHEN l_partkey % 3 = 1 THEN 'R' || l_suppkey ELSE '' END AS reference FROM l WHERE l_partkey % 3 < 2""")
def q122_table_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    header = F.when(k == 0, words("Value Date", "Debit", "Credit", "Balance")).when(k == 1, words("التاريخ", "Amount", "Ref. no", "amount due")).otherwise(words("Date", "Description"))
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    cells = F.when(k == 0, F.array(F.lit("1/1"), F.concat(F.lit(" "), supplier), F.lit(""), F.lit("9"))).when(k == 1, F.array(F.lit("x"), part, F.concat(F.lit("R"), supplier))).otherwise(F.array(F.lit("1/1"), F.lit("y")))
    found = extraction.table_candidates(lines(spark, sf).select("l_orderkey", "line", header.alias("header"), cells.alias("cells")))
    return found.select("l_orderkey", F.col("line").cast("long").alias("line"), F.col("amount_exact_text").alias("amount"), F.col("debit_or_credit").alias("direction"), F.col("reference_number").alias("reference"))


@query("""WITH q AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN ['is it', 'a', 'b'] WHEN c_custkey % 2 = 0 THEN ['is it'] WHEN c_custkey % 3 = 0 THEN ['a', 'b'] ELSE ['T: D'] END AS qs FROM customer)
SELECT case_id, 'Q' || unnest(generate_series(1, len(qs))) AS question_id, unnest(qs) AS question FROM q""")
def q123_research_questions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    issues = table(spark, sf, "customer").select(k.alias("case_id"), F.when(k % 2 == 0, " is it").alias("legal_question"), F.when(k % 3 == 0, '["a","b"," ","a"]').otherwise("none").alias("targeted_questions_json"), F.lit("T").alias("issue_title"), F.lit("D").alias("issue_description"))
    return research.questions(issues, ["case_id"]).drop("place")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rank FROM d)
SELECT 'LOG_' || upper(substring(sha256('RUN|' || l_orderkey || '|' || CASE WHEN l_partkey = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END), 1, 20)) AS log_id, CAST(rank AS BIGINT) AS rank, CASE WHEN l_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score, CASE WHEN l_partkey % 2 = 0 THEN 'similarity' ELSE 'graph_expansion' END AS method, p_brand AS node_type FROM r LEFT JOIN part ON p_partkey = l_partkey""")
def q124_research_log(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("l_partkey") % 2 == 0
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("question"), F.col("l_partkey").alias("node_id"), F.when(hit, F.lit(0.5)).alias("score"), F.when(hit, "similarity").alias("method"), F.lit("retrieved").alias("label")).distinct()
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("node_type"))
    # ids as texts: a number that is zero would count as empty
    log = research.log_entries(found, nodes, "RUN", ["question"], ["node_id"])
    return log.select("log_id", F.col("retrieval_rank").cast("long").alias("rank"), F.col("retrieval_score").alias("score"), F.col("retrieval_method").alias("method"), "node_type")


@query("""WITH f AS (SELECT o_custkey, l_partkey, min((l_orderkey, l_partkey)) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT o_custkey, '[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY first) || ']' AS nodes, coalesce(bool_or(p_size % 5 = 0), false) AS arabic FROM f LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1),
q AS (SELECT o_custkey, '["' || string_agg(o_orderpriority, '","' ORDER BY o_orderkey) || '"]' AS questions FROM orders GROUP BY 1)
SELECT o_custkey AS case_id, questions, nodes, coalesce(arabic, false) AS arabic FROM q LEFT JOIN n USING (o_custkey)""")
def q125_research_package(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), "o_orderpriority")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("node_id"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") % 5 == 0, "AR").alias("language"))
    asked = o.select("case_id", F.col("o_orderkey").alias("issue_id"), F.lit(1).alias("place"), F.col("o_orderpriority").alias("question"))
    found = research.packages(li.join(o, "o_orderkey"), asked, nodes, "case_id", ["o_orderkey", "node_id"])
    return found.select("case_id", F.col("targeted_questions_json").alias("questions"), F.col("authority_node_ids_json").alias("nodes"), F.col("arabic_source_available").alias("arabic"))


@query("""SELECT c_custkey AS case_id, 0::BIGINT AS part, 'primary' AS theory_type, c_name AS said, '["F1"]' AS facts, '' AS priority FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 0, 'alternative', 'other', '[]', '' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 1, '', c_mktsegment, '[]', CASE WHEN c_custkey % 5 = 0 THEN 'high' ELSE 'medium' END FROM customer""")
def q126_strategy_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, theory = F.col("c_custkey"), "struct<description:string,fact_ids:array<string>>"
    c = table(spark, sf, "customer").select(
        k.alias("case_id"), F.when(k % 2 == 0, F.struct(F.col("c_name"), F.array(F.lit("F1")))).cast(theory).alias("primary"), F.when(k % 3 == 0, F.array(F.struct(F.lit("other"), F.lit(None)), F.lit(None))).cast(f"array<{theory}>").alias("alternatives"),
        F.array(F.struct(F.lit("do").alias("action_type"), F.col("c_mktsegment").alias("description"), F.when(k % 5 == 0, "high").alias("priority"))).alias("actions"),
    )
    rows = claims.strategy_rows(c, "case_id")
    return rows.select("case_id", F.col("part").cast("long").alias("part"), "theory_type", F.concat("theory_description", "action_description").alias("said"), F.col("facts_supporting_json").alias("facts"), "priority")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'C' || event_id ELSE 'CLM_' || lpad(CAST(event_id % 10 + 1 AS VARCHAR), 3, '0') END AS claim_id, CASE event_type WHEN 'click' THEN 'SUPPORTED' WHEN 'view' THEN 'CONTRADICTED' ELSE 'NOT_VERIFIABLE' END AS result, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'Maybe' END AS raw,
 CASE event_type WHEN 'click' THEN '1,200.00' WHEN 'view' THEN '' ELSE 'about ten' END AS amount, 'a|b' AS missing, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM events""")
def q127_claim_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id")
    by = lambda a, b, c: F.when(kind == "click", a).when(kind == "view", b).otherwise(c)
    rows = table(spark, sf, "events").select(
        "event_id", (k % 10).alias("claim_index"), F.when(k % 2 == 0, F.concat(F.lit("C"), k)).alias("claim_id"), by("supported", "Contradicted ", "Maybe").alias("result"), by("SAR 1200", "n/a", "about ten").alias("claimed_amount"),
        F.array(F.lit(" a"), F.lit("None"), F.lit("b"), F.lit("-"), F.lit(None)).alias("missing_evidence"), F.lit("x").alias("claim"), F.array(F.lit("r1")).alias("evidence_record_ids"),
    )
    found = claims.evaluations(rows)
    return found.select("event_id", "claim_id", "result", F.col("result_raw").alias("raw"), F.col("claimed_amount").alias("amount"), F.array_join("missing_evidence", "|").alias("missing"), claims.result_order(F.col("result")).cast("long").alias("rank"))


@query("""SELECT c_custkey, 'register' AS source FROM customer""")
def q128_claims_source(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    return claims.claims_source(c.where("c_custkey < 0"), c)


@query(f"""WITH {_TOTALS} SELECT o_orderkey, 'order ' || o_orderkey AS page_label, 'as printed on the page' AS excerpt FROM r WHERE status = 'UNCERTAIN'""")
def q129_review_items(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    pages = table(spark, sf, "orders").select(key.alias("page_id"), F.concat(F.lit("order "), key).alias("label"), F.lit("as printed on the page").alias("page_text"))
    found = ledger.review_items(_reviewed(spark, sf), pages)
    return found.select(F.col("page_id").cast("long").alias("o_orderkey"), "page_label", F.col("page_excerpt").alias("excerpt"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS place, 'TIMELINE_' || upper(substring(sha256(o_custkey || '|' || o_orderkey), 1, 20)) AS timeline_id FROM orders""")
def q130_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return ledger.timeline(e, "case_id").select("o_orderkey", F.col("place").cast("long").alias("place"), "timeline_id")


@query("""SELECT event_id, 'r' || event_id AS row_id, '{"fields":{"amount":"' || CAST(floor(value) AS BIGINT) || '.00"},"explanation":"seen"}' AS payload FROM events WHERE event_type = 'click'""")
def q131_decisions(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(F.lit("amount"), F.floor("value").cast("string"), F.lit("bogus"), F.lit("1"))
    made = ledger.decision(F.concat(F.lit("r"), "event_id"), F.lit("correct"), fields, F.lit("seen"), F.lit("user"), F.col("ts"))
    return table(spark, sf, "events").where("event_type = 'click'").select("event_id", made["row_id"].alias("row_id"), made["payload"].alias("payload"))


@query("""WITH d AS (SELECT doc_id // 10 AS a, doc_id % 10 AS i, lower(text) AS t FROM documents), w AS (SELECT unnest(['the', 'under', 'tion']) AS term)
SELECT a AS agreement_id, 'CL_' || lpad(CAST(i AS VARCHAR), 4, '0') AS clause_id, coalesce((SELECT string_agg('CL_000' || x.i, ',' ORDER BY x.i) FROM d x WHERE x.a = d.a AND abs(x.i - d.i) = 1), '') AS related,
 coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM w WHERE contains(d.t, term)), '') AS terms, CASE WHEN i IN (3, 7) THEN 'see CL_0003 and CL_0007' ELSE '' END AS missing FROM d""")
def q132_clause_units(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id") % 10
    named = lambda c: F.concat(F.lit("CL_"), F.lpad(c.cast("string"), 4, "0"))
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("agreement_id"), named(i).alias("clause_id"), "text", i.alias("i"))
    following = d.select("agreement_id", (F.col("i") - 1).alias("i"), F.col("clause_id").alias("target_id"))
    edges = d.join(following, ["agreement_id", "i"]).select("agreement_id", F.col("clause_id").alias("source_id"), "target_id")
    some = d.select("agreement_id").distinct()
    words = some.select("agreement_id", F.explode(F.array(F.lit("the"), F.lit("under"), F.lit("tion"))).alias("term"))
    found = agreements.units(d.drop("i"), edges, words, some.withColumn("point", F.lit("see CL_0003 and CL_0007")))
    return found.select("agreement_id", "clause_id", *[F.array_join(c, ",").alias(c) for c in ("related", "terms", "missing")])


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 2 = 0 THEN 'd0' ELSE 'd1' END, turn) AS place FROM conversations WHERE turn % 5 <> 4""")
def q133_pages_in_order(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    pages = table(spark, sf, "conversations").select("conv_id", F.when(t % 5 != 4, t.cast("string")).alias("page_id"), F.concat(F.lit("d"), t % 2).alias("document_id"), t.cast("string").alias("page_number"), F.col("text").alias("page_text"))
    found = agreements.pages_in_order(pages, "conv_id")
    return found.select("conv_id", F.col("page_number").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("""SELECT DISTINCT user_id, unnest(['P' || event_id % 50, '7']) AS id FROM events""")
def q134_harvested_ids(spark: SparkSession, sf: str) -> DataFrame:
    json = F.concat(F.lit('{"x":{"Page_ID":"P'), F.col("event_id") % 50, F.lit('"},"list":[{"fact_id": 7},{"other":"no"},{"node_id":" "}]}'))
    return agreements.harvested_ids(table(spark, sf, "events").select("user_id", json.alias("json")), ["user_id"], "json")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no answer' ELSE lang END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'r1' ELSE '' END AS cited, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'x,r1' END AS unverified, doc_id % 4 = 0 AS insufficient FROM documents""")
def q135_answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    answers = table(spark, sf, "documents").select("doc_id", F.when(k % 4 != 0, F.col("lang")).otherwise(" ").alias("answer"), F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("r3"), F.lit("r3"))).otherwise(F.array(F.lit("x"), F.lit("r1"))).alias("source_ids"), F.lit(None).cast("boolean").alias("insufficient_support"))
    found = agreements.answered(answers, spark.createDataFrame([("r3",)], "id string"), ["doc_id"], otherwise="no answer")
    shown = lambda c: F.replace(F.array_join(c, ","), F.lit("r3"), F.lit("r1"))
    return found.select("doc_id", "answer", shown("source_ids").alias("cited"), shown("unverified").alias("unverified"), F.col("insufficient_support").alias("insufficient"))


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS kept, -CAST(round(o_totalprice * 100) AS BIGINT) AS matched, CASE o_orderkey % 3 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' ELSE 'unclear' END AS direction, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'SAR' ELSE 'XYZ' END AS currency FROM orders""")
def q136_older_amounts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    us = F.format_number("o_totalprice", 2)
    swapped = F.translate(us, ",.", ".,")
    kept = money.normalise_amount(F.when(k == 0, us).otherwise(swapped))
    matched = money.amount_for_matching(F.concat(F.lit("("), F.translate(swapped, ".,", "٬٫"), F.lit(")")))
    cents = lambda c: (c.cast("decimal(20,2)") * 100).cast("long")
    direction = money.direction(F.when(k == 0, " Debit"), F.when(k == 1, "monthly credit").otherwise("note"))
    currency = money.loose_currency(F.when(k == 0, "$").when(k == 2, "xyz"), F.when(k == 1, "in ريال"))
    return table(spark, sf, "orders").select("o_orderkey", cents(F.replace(kept, F.lit(","), F.lit(""))).alias("kept"), cents(matched).alias("matched"), direction.alias("direction"), currency.alias("currency"))


def _statement(spark: SparkSession, sf: str) -> DataFrame:
    flag, amount = F.col("l_returnflag"), F.format_number("l_extendedprice", 2)
    cell = lambda value, certain=True: F.struct(value.alias("value"), (certain if isinstance(certain, Column) else F.lit(certain)).alias("certain"), F.lit(None).cast("string").alias("reason"))
    cells = F.create_map(
        F.lit("transaction_date"), cell(F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit("debit"), cell(F.when(flag == "A", amount).otherwise("0.00")), F.lit("credit"), cell(F.when(flag == "R", amount).otherwise("-")),
        F.lit("currency"), cell(F.lit("riyal ر.س"), F.col("l_linestatus") == "F"), F.lit("narrative"), cell(F.concat(F.lit("a|b  "), "l_returnflag")),
    )
    rows = lines(spark, sf).select(F.col("l_orderkey").cast("string").alias("page_id"), F.lit(1).alias("page_number"), F.col("line").alias("row_index"), "l_orderkey", "line", "l_linenumber", cells.alias("cells"))
    return statement_rows.build(statement_rows.canonical(rows))


def _statement_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The rows' ids come from their keys: no need to make the rows twice."""
    row_id = ids.stable_id("FLI", F.col("l_orderkey").cast("string"), F.concat_ws("_", F.lit("ROW"), F.lit(1), F.col("line")))
    return lines(spark, sf).select(row_id.alias("row_id"), "l_orderkey", "line", "l_linenumber")


def _corrected(spark: SparkSession, sf: str) -> DataFrame:
    rows = _statement(spark, sf)
    log = _statement_keys(spark, sf).where("l_linenumber = 1").select("row_id", F.lit("currency").alias("field_name"), F.lit("SAR").alias("corrected_value"), F.lit("2024").alias("corrected_at"), F.lit(1).alias("ord"))
    return statement_rows.corrected(rows, statement_rows.corrections(log))


_STATEMENT = f"""s AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN ['amount'] ELSE [] END || CASE WHEN l_linestatus <> 'F' THEN ['currency'] ELSE [] END || CASE WHEN l_returnflag = 'N' THEN ['debit_or_credit'] ELSE [] END AS pending FROM ({LINES}))"""


@query(f"""WITH {_STATEMENT} SELECT l_orderkey, CAST(line AS BIGINT) AS line, array_to_string(pending, ',') AS pending, CASE WHEN len(pending) > 0 THEN 'needs_review' ELSE 'verified' END AS status FROM s""")
def q137_statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    return statement_rows.without_zero_lines(_statement(spark, sf)).select("l_orderkey", F.col("line").cast("long").alias("line"), F.array_join("pending", ",").alias("pending"), F.col("row_status").alias("status"))


@query(f"""WITH {_STATEMENT} SELECT l_orderkey, CAST(line AS BIGINT) AS line, unnest(CASE WHEN l_linenumber = 1 THEN list_filter(pending, lambda x: x <> 'currency') ELSE pending END) AS field, unnest(list_transform(CASE WHEN l_linenumber = 1 THEN list_filter(pending, lambda x: x <> 'currency') ELSE pending END, lambda x: CASE WHEN x = 'currency' THEN 'uncertain' ELSE 'missing' END)) AS issue FROM s""")
def q138_statement_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corrected(spark, sf)
    items = statement_rows.review_items(rows).join(_statement_keys(spark, sf).select("row_id", "l_orderkey", "line"), "row_id")
    return items.select("l_orderkey", F.col("line").cast("long").alias("line"), F.col("field_name").alias("field"), "issue")


@query(f"""WITH {_STATEMENT} SELECT l_orderkey, CAST(line AS BIGINT) AS line, strftime(l_shipdate, '%Y-%m-%d') AS date, CASE l_returnflag WHEN 'A' THEN 'debit' ELSE 'credit' END AS direction, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, 'SAR' AS currency, 'a b ' || l_returnflag AS description, CASE WHEN l_linenumber = 1 THEN 'verified_with_corrections' ELSE 'verified' END AS status
FROM s WHERE l_returnflag <> 'N' AND (l_linestatus = 'F' OR l_linenumber = 1)""")
def q139_statement_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corrected(spark, sf)
    entries = statement_rows.ledger(rows).join(_statement_keys(spark, sf).select("row_id", "l_orderkey", "line"), "row_id")
    cents = (F.replace(F.col("amount"), F.lit(","), F.lit("")).cast("decimal(20,2)") * 100).cast("long")
    return entries.select("l_orderkey", F.col("line").cast("long").alias("line"), "date", F.col("debit_or_credit").alias("direction"), cents.alias("cents"), "currency", "description", F.col("row_status").alias("status"))


@query(f"""WITH {_STATEMENT} SELECT l_orderkey, CAST(line AS BIGINT) AS line, CASE WHEN l_returnflag <> 'N' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents, l_returnflag = 'A' AS is_debit, CASE WHEN len(pending) > 0 THEN 'UNCERTAIN' ELSE 'EXTRACTED' END AS status FROM s""")
def q140_statement_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _statement(spark, sf).withColumn("corrected", F.create_map().cast("map<string,string>"))
    facts = ledger.as_facts(rows).join(_statement_keys(spark, sf).select("row_id", "l_orderkey", "line"), "row_id")
    cents = (money.parse_amount(F.col("fact.amount")) * 100).cast("long")
    return facts.select("l_orderkey", F.col("line").cast("long").alias("line"), cents.alias("cents"), F.col("fact.debit").isNotNull().alias("is_debit"), "status")


@query("""SELECT p_partkey, 'مبلغ التحويل ' || p_partkey || ' SAR' AS shown FROM part""")
def q141_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.col("p_partkey").cast("string"), F.lit(" SAR"))
    drawn = F.concat(number, F.lit(" "), F.reverse(F.lit("مبلغ التحويل")))
    said = F.when(F.col("p_partkey") % 2 == 0, drawn).otherwise(F.concat(F.lit("مبلغ التحويل "), number))
    return table(spark, sf, "part").select("p_partkey", arabic.reading_order(said).alias("shown"))


@query("""SELECT 'N' || n_nationkey AS node_id, 'C' || c_custkey AS other, 'child' AS kind FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'N' || a.n_nationkey, 'N' || b.n_nationkey, 'sibling' FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def q142_children_siblings(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _tree(spark, sf)
    seeds = nodes.where(F.col("node_id").startswith("N"))
    down = graph.children(seeds, nodes).select("node_id", F.col("child_id").alias("other"), F.lit("child").alias("kind"))
    return down.union(graph.siblings(seeds, nodes).select("node_id", F.col("sibling_id").alias("other"), F.lit("sibling").alias("kind")))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT query_id, node_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) SELECT query_id, node_id, 'retrieved' AS label, score, 'similarity' AS method FROM r WHERE rank <= 12 AND node_id % 2 = 0""")
def q143_research(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    kind = e.schema["vec_id"].dataType
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    nodes = e.select(F.col("vec_id").alias("node_id"), F.lit(None).cast(kind).alias("parent_id"), F.when(F.col("vec_id") % 2 == 0, "en").otherwise("ar").alias("language"))
    edges = spark.createDataFrame([], f"source_id {kind.simpleString()}, target_id {kind.simpleString()}, type string")
    return retrieval.research(queries, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), nodes, edges, retrieval.Applicability(language="en"))


@query(f"""WITH b AS (SELECT l_orderkey, line, CASE WHEN line = 1 OR line = 4 THEN 20.0 ELSE 10.0 END AS size FROM ({LINES}) WHERE NOT (l_orderkey % 2 = 0 AND line = 2)), m AS (SELECT l_orderkey, median(size) AS body FROM b GROUP BY 1),
v AS (SELECT b.*, CASE WHEN size / body >= 1.5 THEN 1 WHEN size / body >= 1.2 THEN 2 ELSE 0 END AS level FROM b JOIN m USING (l_orderkey))
SELECT l_orderkey, CAST(line AS BIGINT) AS line, CAST(level AS BIGINT) AS level, last_value(CASE WHEN level = 1 THEN 'heading no ' || line END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM v""")
def q144_sections(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line").cast("double")
    blocks = lines(spark, sf).select("l_orderkey", "line", F.lit(0.0).alias("x0"), F.lit(10.0).alias("x1"), (line * 10).alias("y0"), (line * 10 + 8).alias("y1"), F.when(F.col("line").isin(1, 4), 20.0).otherwise(10.0).alias("size"), F.concat(F.lit("heading no "), F.col("line")).alias("text"))
    tables = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0.0).alias("x0"), F.lit(6.0).alias("x1"), F.lit(19.0).alias("y0"), F.lit(29.0).alias("y1"))
    found = extraction.sections(extraction.outside_tables(blocks, tables, "l_orderkey"), ["l_orderkey"], ["l_orderkey"])
    return found.select("l_orderkey", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "section")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS similarity, 'total|' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'differ' END AS reasons FROM orders""")
def q145_consensus(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("o_orderkey") % 2 == 0, "Total paid  today").otherwise("total paid later again")
    c = extraction.consensus(F.when(F.col("o_orderkey") % 2 == 0, "total paid today").otherwise("total paid"), other)
    return table(spark, sf, "orders").select("o_orderkey", F.round(c["similarity"], 6).alias("similarity"), F.concat(F.lit("total|"), F.when(F.size(c["reasons"]) > 0, "differ").otherwise("")).alias("reasons"))


@query("""WITH d AS (SELECT doc_id // 10 AS a, doc_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS n FROM documents) SELECT a AS agreement_id, doc_id AS clause_id FROM d WHERE n <= 3""")
def q146_clause_summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("agreement_id"), F.col("doc_id").alias("clause_id"), F.lit("x" * 500).alias("text"))
    # {"clause_id":n,"excerpt":"..."} with 400 letters and an id of 1 to 7 digits
    return agreements.summaries(d, chars=3 * (400 + 30 + 7)).select("agreement_id", "clause_id")
