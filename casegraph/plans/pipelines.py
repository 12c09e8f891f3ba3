"""Queries: printed values, the reviewed ledger, the graph, bounded batches, workflow states, streams as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, money, text
from ..operators import claims, extraction, graph, ledger, relational, review, workflow
from ..streaming import events as streams
from .records import LINES, lines
from .registry import query, table


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def printed(amount: Column, style: Column) -> Column:
    """An amount in one of six ways of printing it; the third and fifth are negative."""
    us, plain = F.format_number(amount, 2), amount.cast("decimal(18,2)").cast("string")
    return (
        F.when(style == 0, us)
        .when(style == 1, F.translate(us, ",.", ".,"))
        .when(style == 2, F.concat(F.lit("("), us, F.lit(")")))
        .when(style == 3, F.concat(F.lit("SAR "), us))
        .when(style == 4, F.concat(plain, F.lit("-")))
        .otherwise(F.translate(us, "0123456789,.", "٠١٢٣٤٥٦٧٨٩٬٫"))
    )


@query("""SELECT o_orderpriority AS currency, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total_cents, count(*) AS entries FROM orders GROUP BY 1""")
def q20_totals_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("currency"), money.parse_amount(F.format_number("o_totalprice", 2)).alias("value"))
    totals = ledger.totals_by_currency(o.union(o))  # rows that are cited twice count once
    return totals.select("currency", (F.col("total") * 100).cast("long").alias("total_cents"), "entries")


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, CASE WHEN line % 6 IN (2, 4) THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS parsed_cents FROM l""")
def q50_parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    li = lines(spark, sf).withColumn("printed", printed(F.col("l_extendedprice"), F.col("line") % 6))
    return li.select("l_orderkey", F.col("line").cast("long").alias("line"), (money.parse_amount(F.col("printed")) * 100).cast("long").alias("parsed_cents"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END AS sure, CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y') || '-99-99' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sort_key FROM orders""")
def q51_dates(spark: SparkSession, sf: str) -> DataFrame:
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, form("yyyy/M/d")).when(k == 1, form("dd-MM-yyyy")).when(k == 2, form("d MMM yyyy")).otherwise(form("yyyy-MM-dd"))
    dated = F.when(F.col("o_orderkey") % 5 == 4, F.concat(F.lit("in "), form("yyyy"))).otherwise(form("d/M/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.normalise_date(shown).alias("day"), dates.date_for_matching(form("d.M.yyyy")).alias("sure"), dates.date_key(dated)["iso"].alias("sort_key"))


@query(r"""SELECT doc_id, trim(regexp_replace(translate(replace(lower(text), 'ß', 'ss'), 'ςµſ', 'σμs'), '[^\p{L}\p{N}]+', ' ', 'g')) AS normal FROM documents""")
def q52_normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalise(F.col("text")).alias("normal"))


@query("""SELECT o_orderkey, 'FACT_' || upper(substring(sha256(CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END || '|' || o_orderstatus || '|' || CASE WHEN o_orderkey = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END), 1, 20)) AS id FROM orders""")
def q53_stable_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", ids.stable_id("FACT", F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("id"))


@query("""WITH p AS (SELECT doc_id, text, length(text) AS n, position('keit' IN lower(text)) AS a, position('tion ' IN lower(text)) AS b FROM documents),
h AS (SELECT *, CASE WHEN a > 0 THEN a ELSE b END AS hit, CASE WHEN a > 0 THEN 4 ELSE 5 END AS size FROM p)
SELECT doc_id, CASE WHEN hit = 0 THEN substring(text, 1, 520) ELSE CASE WHEN hit - 260 > 1 THEN '…' ELSE '' END || trim(substring(text, greatest(hit - 260, 1), least(hit + size + 260, n + 1) - greatest(hit - 260, 1))) || CASE WHEN hit + size + 260 <= n THEN '…' ELSE '' END END AS shown FROM h""")
def q55_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), [F.lit("no"), F.lit("Keit"), F.lit("tion ")]).alias("shown"))


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents)
SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS likeness FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def q56_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    following = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return w.join(following, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("w2")), 6).alias("likeness"))


CURRENCY = ["riyal", "US$", "€"]


def _fact(df: DataFrame, key: Column, amount: Column, status: str, calculation: Column | None = None) -> DataFrame:
    empty = F.lit(None).cast("string")
    given = {"fact_type": F.lit("Payment"), "amount": amount, "currency": F.element_at(F.array(*[F.lit(c) for c in CURRENCY]), (F.col("c_nationkey") % 3 + 1).cast("int"))}
    kind = "struct<operation:string,inputs:array<string>,result_field:string>"
    return df.select(
        F.col("o_orderkey").cast("string").alias("page_id"), F.col("o_custkey").alias("case_document_id"), F.lit(1).alias("page_number"), F.col("ord"), key.alias("fact_key"), F.lit(status).alias("status"),
        *[given.get(f, empty).alias(f) for f in ledger.FACT_FIELDS], (F.lit(None) if calculation is None else calculation).cast(kind).alias("calculation"),
    )


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """A page an order: each line a fact as printed, and the order's total as their sum."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "c_nationkey")
    li = lines(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), "line", "l_extendedprice")
    stated = _fact(li.join(orders, "o_orderkey").withColumn("ord", F.col("line")), F.concat(F.lit("L"), F.col("line")), printed(F.col("l_extendedprice"), F.lit(0)), "stated")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    inputs = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat(F.lit("L"), i))).otherwise(F.array().cast("array<string>"))
    total = orders.join(n, "o_orderkey", "left").withColumn("ord", F.lit(1_000_000))
    sums = F.struct(F.lit("sum").alias("operation"), F.coalesce(inputs, F.array().cast("array<string>")).alias("inputs"), F.lit("amount").alias("result_field"))
    return stated.unionByName(_fact(total, F.lit("TOTAL"), printed(F.col("o_totalprice"), F.lit(0)), "COMPUTED", sums))


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows with the decisions of the log: a user's last decision holds for the totals of the customer of that number."""
    rows = ledger.fact_rows(ledger.check_calculations(ledger.normalise(_facts(spark, sf))))
    action = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "ignore").when(F.col("event_type") == "signup", "correct").when(F.col("event_type") == "view", "proposal").otherwise("other")
    payload = F.to_json(F.struct(F.struct(F.format_number("value", 2).alias("amount")).alias("fields"), F.lit("seen").alias("explanation")))
    log = table(spark, sf, "events").select("user_id", action.alias("action"), payload.alias("payload"), F.col("event_id").alias("ord"))
    latest = ledger.latest_decisions(log, "user_id")
    # the ids of the totals' rows come from their keys: no need to make the rows twice
    row_id = ids.stable_id("FACT", F.col("o_orderkey").cast("string"), F.lit("1_TOTAL"))
    totals = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), row_id.alias("row_id"))
    return ledger.with_decisions(rows, totals.join(latest, "user_id").drop("user_id"))


#: Totals of orders with their check and the last decision, in SQL.
_TOTALS = """t AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS stated, s.expected, CASE c_nationkey % 3 WHEN 0 THEN 'SAR' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS expected FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey),
d AS (SELECT user_id, arg_max(event_type, event_id) AS action, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS given FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1),
r AS (SELECT t.*, coalesce(abs(expected - stated) <= 1, false) AS ok, d.given, CASE d.action WHEN 'purchase' THEN 'USER_CONFIRMED' WHEN 'error' THEN 'IGNORED' WHEN 'signup' THEN 'USER_CORRECTED' ELSE CASE WHEN coalesce(abs(expected - stated) <= 1, false) THEN 'CALCULATED' ELSE 'UNCERTAIN' END END AS status
  FROM t LEFT JOIN d ON d.user_id = o_custkey)"""


@query(f"""WITH {_TOTALS}, e AS (SELECT currency, CASE WHEN status = 'USER_CORRECTED' THEN given ELSE stated END AS c FROM r WHERE status NOT IN ('UNCERTAIN', 'IGNORED')
  UNION ALL SELECT currency, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem JOIN t ON l_orderkey = o_orderkey)
SELECT currency, sum(c)::BIGINT AS total_cents, count(*) AS entries FROM e GROUP BY 1""")
def q60_ledger(spark: SparkSession, sf: str) -> DataFrame:
    totals = ledger.totals_by_currency(ledger.ledger(_reviewed(spark, sf)))
    return totals.select("currency", (F.col("total") * 100).cast("long").alias("total_cents"), "entries")


@query(f"""WITH {_TOTALS} SELECT status, count(*) AS n FROM (SELECT status FROM r UNION ALL SELECT 'EXTRACTED' FROM lineitem JOIN t ON l_orderkey = o_orderkey) GROUP BY 1""")
def q61_ledger_split(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf).groupBy(F.col("effective_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TOTALS} SELECT o_orderkey, expected, stated, ok FROM r""")
def q62_calc_check(spark: SparkSession, sf: str) -> DataFrame:
    checked = ledger.check_calculations(ledger.normalise(_facts(spark, sf))).where(F.col("fact_key") == "TOTAL")
    back = lambda c: (money.parse_amount(F.col(c)) * 100).cast("long")
    # an order without lines has nothing to recompute: no expected value
    return checked.select(F.col("page_id").cast("long").alias("o_orderkey"), F.when(F.size("calculation.inputs") > 0, back("check.expected")).alias("expected"), back("check.stated").alias("stated"), F.col("check.ok").alias("ok"))


@query("""SELECT 'CLM_' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS claim_id, substring(o_orderpriority, 1, 1) AS currency, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total_cents, count(*) AS entries FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def q63_claim_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("row_id", F.col("o_orderkey").cast("string"))
    known = o.where("o_orderstatus <> 'P'").select("row_id", F.substring("o_orderpriority", 1, 1).alias("currency"), money.parse_amount(F.format_number("o_totalprice", 2)).alias("value"))
    claim = F.format_string("CLM_%06d", F.col("o_custkey"))
    entry = o.groupBy(claim.alias("claim_id")).agg(F.collect_list("row_id").alias("ids"))
    groups = entry.select("claim_id", F.explode(F.array(F.lit("supporting"), F.lit("contradicting"))).alias("kind"), F.lit(1).alias("ord"), F.lit("cited").alias("text"), "ids")
    entries, _ = claims.evidence(groups, known)
    totals = claims.claim_totals(claims.with_ledger(entries, known))
    return totals.select("claim_id", "currency", (F.col("total") * 100).cast("long").alias("total_cents"), "entries")


@query("""SELECT result, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'SUPPORTED' WHEN 'view' THEN 'PARTIALLY_SUPPORTED' WHEN 'error' THEN 'CONTRADICTED' ELSE 'NOT_VERIFIABLE' END AS result FROM events) GROUP BY 1""")
def q64_claim_results(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", " supported").when(F.col("event_type") == "view", "partially-supported").when(F.col("event_type") == "error", "CONTRADICTED").when(F.col("event_type") == "signup", "probably true")
    return table(spark, sf, "events").select(claims.result(said).alias("result")).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers and orders as one tree of text ids."""
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return (
        table(spark, sf, "region").select(node("R", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
        .union(table(spark, sf, "nation").select(node("N", "n_nationkey"), node("R", "n_regionkey")))
        .union(table(spark, sf, "customer").select(node("C", "c_custkey"), node("N", "c_nationkey")))
        .union(table(spark, sf, "orders").select(node("O", "o_orderkey"), node("C", "o_custkey")))
    )


@query("""SELECT 'O' || o_orderkey AS node_id, a.ancestor_id, a.depth FROM (SELECT o_orderkey, 'C' || o_custkey AS c, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
LATERAL (SELECT c AS ancestor_id, 1::BIGINT AS depth UNION ALL SELECT n, 2 UNION ALL SELECT r, 3) a""")
def q65_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _tree(spark, sf)
    return graph.ancestors(nodes.where(F.col("node_id").startswith("O")), nodes, max_depth=4).select("node_id", "ancestor_id", F.col("depth").cast("long").alias("depth"))


@query("""WITH h AS (SELECT o_custkey AS q, 'O' || o_orderkey AS seed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seed_ord, 'C' || o_custkey AS c, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT DISTINCT l_orderkey, 'P' || l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 'References' ELSE 'amends' END AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND p_size > 25),
s AS (SELECT l_orderkey, p, t, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, p) AS pos FROM e),
x AS (SELECT q, seed_ord, seed AS node_id, 'retrieved' AS label, 0 AS kind, 0 AS pos FROM h UNION ALL SELECT q, seed_ord, c, 'parent', 1, 1 FROM h UNION ALL SELECT q, seed_ord, n, 'ancestor', 2, 2 FROM h UNION ALL SELECT q, seed_ord, r, 'ancestor', 2, 3 FROM h
  UNION ALL SELECT q, seed_ord, p, t, 4, pos FROM h JOIN s ON l_orderkey = o_orderkey),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY q, node_id ORDER BY seed_ord, kind, pos, label) = 1),
b AS (SELECT q, seed_ord, coalesce(sum(count(*)) OVER (PARTITION BY q ORDER BY seed_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f GROUP BY 1, 2)
SELECT f.q AS query_id, f.node_id, f.label, CAST(f.seed_ord AS BIGINT) AS seed_ord FROM f JOIN b ON f.q = b.q AND f.seed_ord = b.seed_ord WHERE b.before < 12""")
def q66_expand_hits(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("O"), F.col("l_orderkey")).alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey")).alias("target_id"), F.when(F.col("l_returnflag") == "A", "References").when(F.col("l_returnflag") == "R", "cites").otherwise("amends").alias("type")
    )
    hits = relational.ranked(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], "seed_ord").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("node_id"), "seed_ord")
    found = graph.expand_hits(hits, _tree(spark, sf).unionByName(parts), edges, 12, max_depth=4, group=["query_id"])
    return found.select("query_id", "node_id", "label", F.col("seed_ord").cast("long").alias("seed_ord"))


@query("""SELECT DISTINCT 'O' || l_orderkey AS node_id, 'P' || l_partkey AS related_id, 'Amends' AS type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' AND p_size > 25""")
def q67_related(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("node_id"))
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey")).alias("source_id"), F.concat(F.lit("P"), F.col("l_partkey")).alias("target_id"), F.when(F.col("l_returnflag") == "N", "Amends").otherwise("cites").alias("type")).distinct()
    seeds = edges.select(F.col("source_id").alias("node_id")).distinct()
    return graph.related(seeds, edges, nodes)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sum(CAST(round(o_totalprice) AS BIGINT)) OVER w AS running, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, CAST(running AS BIGINT) AS running_cost FROM r WHERE n = 1 OR running <= 700000""")
def q70_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    return relational.budget_prefix(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("cost"), 700_000).select("o_custkey", "o_orderkey", "running_cost")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderkey, n, 1::BIGINT AS chunk, CASE WHEN c >= 450000 THEN 2::BIGINT ELSE 1::BIGINT END AS next, CASE WHEN c >= 450000 THEN 0::BIGINT ELSE c END AS used, CASE WHEN c >= 450000 THEN false ELSE true END AS some FROM o WHERE n = 1
 UNION ALL SELECT x.o_custkey, x.o_orderkey, x.n, x.chunk, CASE WHEN x.total >= 450000 THEN x.chunk + 1 ELSE x.chunk END, CASE WHEN x.total >= 450000 THEN 0 ELSE x.total END, x.total < 450000
 FROM (SELECT o.o_custkey, o.o_orderkey, o.n, CASE WHEN f.some AND f.used + o.c > 400000 THEN f.next + 1 ELSE f.next END AS chunk, CASE WHEN f.some AND f.used + o.c > 400000 THEN o.c ELSE f.used + o.c END AS total FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1) x)
SELECT o_custkey, o_orderkey, chunk AS chunk_no FROM f""")
def q71_char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    return relational.chunk_by_cost(o, ["o_custkey"], "o_orderkey", "cost", 400_000, 450_000).select("o_custkey", "o_orderkey", F.col("chunk_no").cast("long").alias("chunk_no"))


@query("""WITH m AS (SELECT conv_id, turn, text, turn % 3 <> 0 AS fwd, turn % 2 = 0 AS back FROM conversations), j AS (SELECT *, CASE WHEN back AND lag(fwd) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM m),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS clause_no FROM j)
SELECT conv_id, clause_no, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS parts, 'CL_' || lpad(CAST(any_value(clause_no) AS VARCHAR), 4, '0') AS clause_id FROM i GROUP BY 1, 2""")
def q72_stitch(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_no"), F.lit(1).alias("pos"), "text", (F.col("turn") % 3 != 0).alias("into_next"), (F.col("turn") % 2 == 0).alias("from_previous"))
    return review.clauses(parts, ["conv_id"])


@query("""WITH e AS (SELECT user_id, 'S' || (event_id % 3) AS stage, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ready' END AS status, CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_id, ts FROM events)
SELECT user_id, stage, arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, max(event_id) FILTER (WHERE status = 'running') AS started, max(event_id) FILTER (WHERE status IN ('completed', 'ready')) AS finished,
 CASE arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) WHEN 'error' THEN 'failed' ELSE '' END AS error FROM e GROUP BY 1, 2""")
def q75_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "ready")
    log = e.select("user_id", F.concat(F.lit("S"), F.col("event_id") % 3).alias("stage"), status.alias("status"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("event_type").alias("job_id"), F.col("event_id").alias("at"))
    return workflow.merge_stage_events(log, ["user_id"], ["at"]).select("user_id", "stage", "status", F.col("started_at").alias("started"), F.col("finished_at").alias("finished"), "error")


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS docs, c_custkey % 5 <> 0 AS summary, c_custkey % 3 <> 0 AS gate, c_custkey % 11 = 0 AS dirty, c_custkey % 2 = 0 AS analysis, c_custkey % 4 = 0 AS memo,
 CASE c_custkey % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'ready_for_synthesis' WHEN 2 THEN 'complete' END AS acc, c_custkey % 13 = 0 AS pending FROM customer),
m AS (SELECT *, coalesce(NOT analysis OR NOT coalesce(acc = 'complete', false) OR pending, true) AS missing FROM f),
s AS (SELECT k, unnest(['documents', 'review', 'accounting', 'analysis', 'pleading', 'discussion']) AS stage, unnest([1, 2, 3, 4, 5, 6]) AS place, * EXCLUDE (k) FROM m),
d AS (SELECT k, stage, place, CASE WHEN stage = 'documents' THEN CASE WHEN docs THEN 'completed' ELSE 'not_started' END
 WHEN stage IN ('review', 'accounting', 'discussion') AND NOT docs THEN 'blocked'
 WHEN stage = 'review' THEN CASE WHEN NOT summary THEN 'not_started' WHEN gate THEN CASE WHEN dirty THEN 'stale' ELSE 'completed' END ELSE 'waiting_for_user' END
 WHEN stage = 'accounting' THEN CASE WHEN pending THEN 'waiting_for_user' WHEN acc = 'complete' THEN 'completed' WHEN acc = 'ready_for_synthesis' THEN 'ready' ELSE 'not_started' END
 WHEN stage = 'analysis' THEN CASE WHEN NOT gate THEN 'blocked' WHEN analysis THEN CASE WHEN dirty THEN 'stale' ELSE 'completed' END ELSE 'not_started' END
 WHEN stage = 'pleading' THEN CASE WHEN memo THEN CASE WHEN missing THEN 'stale' ELSE 'completed' END WHEN missing THEN 'blocked' ELSE 'not_started' END ELSE 'ready' END AS derived,
 CASE WHEN (k + place) % 17 = 0 THEN 'running' WHEN (k + place) % 19 = 0 THEN 'error' END AS rec, lpad(CAST((k * 7 + place * 31) % 50 AS VARCHAR), 2, '0') AS fin FROM s),
g AS (SELECT * FROM (VALUES ('review', 'documents', 0), ('accounting', 'documents', 0), ('analysis', 'review', 0), ('pleading', 'analysis', 0), ('pleading', 'accounting', 1), ('discussion', 'documents', 0)) g(stage, dep, pos)),
u AS (SELECT d.k, d.stage, arg_min(g.dep, g.pos) AS dep FROM d JOIN g ON d.stage = g.stage JOIN d p ON p.k = d.k AND p.stage = g.dep WHERE p.fin > d.fin GROUP BY 1, 2),
o AS (SELECT d.k, d.stage, d.place, CASE WHEN rec IS NOT NULL THEN 'error' WHEN derived = 'completed' AND u.dep IS NOT NULL THEN 'stale' ELSE derived END AS status, CASE WHEN rec IS NULL AND derived = 'completed' THEN u.dep END AS because FROM d LEFT JOIN u ON d.k = u.k AND d.stage = u.stage),
n AS (SELECT *, min(CASE WHEN status <> 'completed' THEN place END) OVER (PARTITION BY k) AS cur FROM o)
SELECT n.k AS c_custkey, stage, status, because AS stale_because, CASE WHEN status = 'completed' THEN 'complete' WHEN place = cur THEN 'current' ELSE 'upcoming' END AS state, x.next_stage FROM n JOIN
(SELECT k, coalesce(arg_min(stage, place) FILTER (WHERE status = 'waiting_for_user'), arg_min(stage, place) FILTER (WHERE status = 'error'), arg_min(stage, place) FILTER (WHERE status IN ('not_started', 'ready', 'stale') AND stage <> 'discussion'), 'discussion') AS next_stage FROM o GROUP BY 1) x ON x.k = n.k""")
def q76_stage_overview(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    acc = F.when(k % 6 == 0, "complete").when(k % 6 == 1, "ready_for_synthesis").when(k % 6 == 2, "complete")
    f = {"has_documents": k % 7 != 0, "has_summary": k % 5 != 0, "gate_passed": k % 3 != 0, "case_dirty": k % 11 == 0, "has_analysis": k % 2 == 0, "has_memo": k % 4 == 0, "accounting_status": acc, "pending_count": (k % 13 == 0).cast("int"), "has_line_items": F.lit(False), "accounting_dirty": F.lit(False)}
    names = F.array(*[F.lit(s) for s in workflow.STAGES])
    rows = table(spark, sf, "customer").select("c_custkey", F.posexplode(names).alias("i", "stage"))
    place = F.col("i") + 1
    record = F.when((k + place) % 17 == 0, "running").when((k + place) % 19 == 0, "error")
    stages = rows.select("c_custkey", "stage", workflow.derived_status(F.col("stage"), f).alias("derived"), record.alias("record_status"), F.lpad(((k * 7 + place * 31) % 50).cast("string"), 2, "0").alias("finished_at"), F.lit("x").alias("error"), F.lit(False).alias("live"), F.lit("").alias("used_fingerprint"), F.lit("").alias("fingerprint"))
    seen = workflow.overview(stages, "c_custkey")
    return seen.join(workflow.next_stage(seen, "c_custkey"), "c_custkey").select("c_custkey", "stage", "status", "stale_because", "state", "next_stage")


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, strftime(l_shipdate, '%d/%m/%Y') AS date_text, CASE WHEN l_returnflag = 'A' THEN 'debit' WHEN l_returnflag = 'R' THEN 'credit' ELSE '' END AS direction, 'TRX-' || (l_partkey + 10000) AS reference, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents FROM l WHERE l_linestatus = 'F'""")
def q80_line_candidates(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("l_returnflag") == "A", "debit").when(F.col("l_returnflag") == "R", "credit").otherwise("note")
    said = F.concat(F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit("  Transfer   "), F.format_number(F.col("l_extendedprice") + 1000000, 2), F.lit(" SAR   "), word, F.lit(" ref: TRX-"), F.col("l_partkey") + 10000)
    pages = lines(spark, sf).withColumn("_text", F.when(F.col("l_linestatus") == "F", said).otherwise(F.lit("unrelated line")))
    pages = pages.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_text"))), lambda x: x["_text"]), "\n").alias("page_text"))
    found = extraction.line_candidates(pages)
    value = (money.parse_amount(F.col("amount_exact_text")) - 1000000) * 100
    return found.select("l_orderkey", (F.col("line_index") + 1).cast("long").alias("line"), F.col("date_exact_text").alias("date_text"), F.col("debit_or_credit").alias("direction"), F.col("reference_number").alias("reference"), value.cast("long").alias("amount_cents"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS value_cents FROM events GROUP BY 1, 2""")
def q85_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value_cents")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM i GROUP BY user_id, k""")
def q86_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT event_type, count(*) - count(DISTINCT (user_id, props)) AS dropped, count(DISTINCT (user_id, props)) AS kept FROM events GROUP BY 1""")
def q87_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = streams.distinct_events(e, ["user_id", "event_type", "props"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(kept, "event_type").select("event_type", (F.col("n") - F.col("kept")).alias("dropped"), "kept")
