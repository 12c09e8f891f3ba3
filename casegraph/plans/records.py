"""Queries: slices, filters, joins, aggregates, windows, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, jsonx, text
from ..operators import extraction, graph, register, relational, retrieval, review, workflow
from .registry import query, table

#: Order of a line within its order: line numbers repeat in the data.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS line FROM lineitem"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return relational.ranked(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "line")


@query("""SELECT o_custkey, o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS undated, strftime(o_orderdate, '%Y-%m-%d') AS day,
       row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS place FROM orders""")
def q01_case_order(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).cast("long").alias("undated"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return relational.ranked(keyed, ["o_custkey"], [F.col("undated"), F.col("day"), F.col("o_orderkey")], "place").withColumn("place", F.col("place").cast("long"))


@query("""SELECT c_custkey, 'CASE-' || upper(right(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 6)) AS reference FROM customer
       WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') OR contains(lower('CASE-' || upper(right(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 6))), 'build')""")
def q02_case_search(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "customer").withColumn("reference", ids.short_reference(F.col("c_name")))
    return named.where(text.contains_any(F.lit(" Build"), [F.col("c_name"), F.col("c_mktsegment"), F.col("reference")])).select("c_custkey", "reference")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND (o_orderpriority LIKE '3%' OR o_orderpriority LIKE '1%')
       AND CAST(o_orderdate AS DATE) <= DATE '1998-06-01' AND (o_orderstatus <> 'F' OR CAST(o_orderdate AS DATE) + 365 >= DATE '1998-06-01')""")
def q03_applicability(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    nodes = o.select(
        "o_orderkey",
        F.lit("ar").alias("language"),
        F.when(F.col("o_orderstatus") == "O", "No").when(F.col("o_orderstatus") == "F", "true").alias("is_current"),
        F.when(F.col("o_orderpriority").startswith("1"), "not json").when(F.col("o_orderpriority").startswith("3"), '["retail"]').otherwise('["corporate"]').alias("customer_types_json"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 365), "yyyy-MM-dd")).alias("expiry_date"),
    )
    f = retrieval.Applicability(language="ar", current_only=True, matter_date="1998-06-01", allowed={"customer_types_json": "retail"})
    return nodes.where(retrieval.applicable(f)).select("o_orderkey")


@query("""WITH l AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS n FROM labels)
SELECT d.doc_id, d.source FROM documents d JOIN l ON d.doc_id = l.doc_id AND l.n = 1 WHERE l.quality = 1 AND l.toxic = 0""")
def q04_page_scope(spark: SparkSession, sf: str) -> DataFrame:
    latest = relational.latest_by_key(table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])
    return table(spark, sf, "documents").select("doc_id", "source").join(latest.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id"), "doc_id", "left_semi")


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(substring(text, 1, 120)) || '…' END AS shown FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def q05_usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(register.usable_page(F.lit(None).cast("string"), F.col("text"))).select("doc_id", text.truncate(F.col("text"), 120).alias("shown"))


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, l_partkey, p_name FROM l JOIN part ON l_partkey = p_partkey WHERE line <= 3 AND p_size > 25""")
def q10_limit_before_filter(spark: SparkSession, sf: str) -> DataFrame:
    head = relational.head_per_group(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], 3)
    placed = relational.ranked(head, ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "line")
    parts = table(spark, sf, "part").where("p_size > 25").select("p_partkey", "p_name")
    return placed.join(parts, placed.l_partkey == parts.p_partkey).select("l_orderkey", F.col("line").cast("long").alias("line"), "l_partkey", "p_name")


@query(f"""WITH l AS ({LINES}) SELECT l.l_orderkey, CAST(l.line AS BIGINT) AS line, coalesce(c.c_name, 'Document') || ' — page ' || l.line AS label FROM l
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0""")
def q11_page_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("original_filename"))
    documents = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey").select(F.col("o_orderkey").alias("case_document_id"), "original_filename")
    pages = lines(spark, sf).select(F.col("l_orderkey").alias("case_document_id"), F.col("line").alias("page_number"))
    return register.page_labels(pages, documents).select(F.col("case_document_id").alias("l_orderkey"), F.col("page_number").cast("long").alias("line"), "label")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def q12_anti_new(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return relational.only_new(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query(f"""WITH l AS ({LINES}), k AS (SELECT l_orderkey, line, l_partkey, p_partkey FROM l LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25),
u AS (SELECT l_orderkey, l_partkey, min(line) AS line, bool_or(p_partkey IS NOT NULL) AS known FROM k GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY line) FILTER (WHERE known), '') AS cited,
       coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY line) FILTER (WHERE NOT known), '') AS unverified FROM u GROUP BY 1""")
def q13_known_ids(spark: SparkSession, sf: str) -> DataFrame:
    cited = lines(spark, sf).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "l_partkey"))), lambda x: x["l_partkey"]).alias("cited"))
    found = relational.known_ids(cited, ["l_orderkey"], "cited", table(spark, sf, "part").where("p_size > 25"), "p_partkey")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("l_orderkey", joined(F.col("cited")).alias("cited"), joined(F.col("unverified")).alias("unverified"))


@query(f"""WITH l AS (SELECT * FROM ({LINES}) WHERE l_returnflag = 'R'), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY line) = 1)
SELECT o_orderkey, f.l_partkey FROM orders LEFT JOIN f ON o_orderkey = f.l_orderkey""")
def q14_first_match(spark: SparkSession, sf: str) -> DataFrame:
    first = relational.head_per_group(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], 1)
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(first.select("l_orderkey", "l_partkey"), o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "l_partkey")


@query("""WITH e AS (SELECT l_partkey AS a, 1000000000 + l_suppkey AS b FROM lineitem), u AS (SELECT a AS node, b AS neighbour FROM e UNION SELECT b, a FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY neighbour) AS n FROM u)
SELECT node, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY neighbour) AS neighbours FROM r WHERE n <= 12 GROUP BY node""")
def q15_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    return graph.neighbours(edges, "a", "b").select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("""WITH d AS (SELECT doc_id // 10 AS a, doc_id, lower(text) AS t FROM documents), t AS (SELECT p_partkey // 20 AS a, lower(p_name) AS term FROM part UNION SELECT DISTINCT doc_id // 10, unnest(['the', 'under', 'tion']) FROM documents)
SELECT d.doc_id, t.term FROM d JOIN t ON d.a = t.a WHERE contains(d.t, t.term)""")
def q16_terms_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Ten documents make an agreement, which defines the names of twenty parts and three words."""
    group = lambda c, n: F.floor(F.col(c) / n)
    d = table(spark, sf, "documents").select(group("doc_id", 10).alias("agreement_id"), F.col("doc_id").alias("clause_id"), "text")
    words = d.select("agreement_id", F.explode(F.array(F.lit("the"), F.lit("under"), F.lit("tion"))).alias("term"))
    names = table(spark, sf, "part").select(group("p_partkey", 20).alias("agreement_id"), F.lower("p_name").alias("term")).union(words).distinct()
    return review.clause_terms(d, names).select(F.col("clause_id").alias("doc_id"), "term")


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9800 GROUP BY 1)
SELECT CAST(coalesce(s.k, c.k) AS BIGINT) AS nation, CASE WHEN s.k IS NULL THEN 'customers only' WHEN c.k IS NULL THEN 'suppliers only' ELSE 'agreed' END AS side FROM s FULL JOIN c ON s.k = c.k""")
def q17_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.lit(True).alias("s"))
    c = table(spark, sf, "customer").where("c_acctbal > 9800").groupBy(F.col("c_nationkey").alias("k")).agg(F.lit(True).alias("c"))
    side = F.when(F.col("s").isNull(), "customers only").when(F.col("c").isNull(), "suppliers only").otherwise("agreed")
    return s.join(c, "k", "full").select(F.col("k").cast("long").alias("nation"), side.alias("side"))


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate > TIMESTAMP '1998-01-01' + INTERVAL (c.c_nationkey * 40) DAY)""")
def q18_stale_exists(spark: SparkSession, sf: str) -> DataFrame:
    approved = F.expr("timestamp_ntz '1998-01-01 00:00:00' + make_dt_interval(c_nationkey * 40)")
    cases = table(spark, sf, "customer").select("c_custkey", approved.alias("approved_at"))
    uploads = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return workflow.stale_summaries(cases, uploads, "c_custkey", "approved_at", "o_orderdate").select("c_custkey")


@query("""SELECT event_type, count(*) AS n, count_if(value > 50) AS n_high, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, bool_or(value > 99) AS any_top, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1""")
def q21_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.bool_or(F.col("value") > 99).alias("any_top"), F.bool_and(F.col("value") >= 0).alias("all_positive")
    )


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY 1)
SELECT c.conv_id, min(length(c.text))::BIGINT AS score, bool_and(c.role <> 'system') AS is_complete, bool_and(length(c.text) > 20) AS is_ready, any_value(s.roles) AS roles FROM conversations c JOIN s USING (conv_id) GROUP BY c.conv_id""")
def q22_review_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.char_length("text").cast("long").alias("score"), (F.col("role") != "system").alias("is_complete"), (F.char_length("text") > 20).alias("is_ready"), F.array("role").alias("roles"), F.lit("").alias("summary")
    )
    merged = review.merge_reviews(parts, ["conv_id"], "turn", ["roles"])
    return merged.select("conv_id", "score", "is_complete", "is_ready", F.array_join("roles", ",").alias("roles"))


@query(r"""WITH d AS (SELECT doc_id, lang, source, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k FROM documents), u AS (SELECT k, source, min(doc_id) AS f FROM d GROUP BY 1, 2)
SELECT d.k AS merge_key, min(d.doc_id) AS doc_id, arg_min(d.lang, d.doc_id) FILTER (WHERE d.lang <> '') AS lang, any_value(s.sources) AS sources, count(*) AS merged_count
FROM d JOIN (SELECT k, string_agg(source, ',' ORDER BY f) AS sources FROM u GROUP BY 1) s ON d.k = s.k GROUP BY d.k""")
def q23_first_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 256)
    d = table(spark, sf, "documents").select(key.alias("merge_key"), "doc_id", "lang", F.array("source").alias("sources"))
    return relational.first_wins_merge(d, ["merge_key"], "doc_id", ["lang"], ["sources"]).select("merge_key", "doc_id", "lang", F.array_join("sources", ",").alias("sources"), "merged_count")


@query(r"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS stored, sha256('document|' || trim(lower(regexp_replace(text, '\s+', ' ', 'g')))) AS signature FROM documents)
SELECT signature, min(doc_id) AS doc_id FROM d GROUP BY 1 HAVING NOT bool_or(stored)""")
def q24_signature_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with odd ids arrive; those with even ids are stored already."""
    d = table(spark, sf, "documents").select("doc_id", ids.signature("document", F.col("text")).alias("signature"))
    return relational.new_by_signature(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), ["signature"], ["doc_id"]).select("signature", "doc_id")


@query("""WITH f AS (SELECT conv_id, lower(role) AS k, min(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(k, '>' ORDER BY t) AS roles FROM f GROUP BY 1""")
def q25_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return roles.select("conv_id", F.lower(F.array_join(text.ordered_distinct(F.col("roles")), ">")).alias("roles"))


@query("""WITH e AS (SELECT p_brand, CAST(l.l_quantity AS DOUBLE) AS v, unnest(generate_series(1, l_linenumber)) FROM lineitem l JOIN part ON l_partkey = p_partkey)
SELECT p_brand, median(v) AS median_quantity FROM e GROUP BY 1""")
def q26_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand")
    weighted = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", "l_quantity").agg(F.sum("l_linenumber").alias("w"))
    return weighted.groupBy("p_brand").agg(F.percentile("l_quantity", F.lit(0.5), F.col("w")).alias("median_quantity"))


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
SELECT doc_id, arg_max(w, length(w) * 1000000 - i) AS longest FROM t GROUP BY 1""")
def q27_longest_token(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.longest_first(F.split("text", " ")).alias("longest"))


@query("""SELECT o_custkey, substring(sha256(count(*) || ':' || sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substring(h, 16, 15) AS BIGINT))), 1, 16) AS fingerprint
FROM (SELECT o_custkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM orders) GROUP BY 1""")
def q28_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return relational.fingerprint(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q30_latest(spark: SparkSession, sf: str) -> DataFrame:
    return relational.latest_by_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH f AS (SELECT user_id, max(event_id) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) AS final_id, max(event_id) FILTER (WHERE event_type = 'view') AS proposal_id FROM events GROUP BY 1)
SELECT user_id, final_id, CASE WHEN final_id IS NULL OR proposal_id > final_id THEN proposal_id END AS proposal_id FROM f""")
def q31_resolution_fold(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ledger

    action = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "ignore").when(F.col("event_type") == "signup", "correct").when(F.col("event_type") == "view", "proposal").otherwise("bogus")
    events = table(spark, sf, "events").select(F.col("user_id").alias("row_id"), action.alias("action"), F.col("event_id").cast("string").alias("payload"), F.col("event_id").alias("ord"))
    folded = ledger.latest_decisions(events)
    return folded.select(F.col("row_id").alias("user_id"), F.col("final.payload").cast("long").alias("final_id"), F.col("proposal.payload").cast("long").alias("proposal_id"))


@query("""WITH j AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'broken ' || props ELSE props END AS p FROM events)
SELECT user_id, event_id, p AS props FROM j WHERE p LIKE '{%' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q32_last_valid_json(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), "props")).otherwise(F.col("props")).alias("props"))
    return workflow.latest_valid_json(log, ["user_id"], ["ts", "event_id"], "props").select("user_id", "event_id", "props")


@query("""WITH j AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS state FROM events)
SELECT user_id, event_type, state FROM j QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q33_state_pivot(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_type") == "error", F.lit("no json")).otherwise(F.col("props")).alias("state"))
    states = workflow.latest_states(log, ["user_id", "event_type"], ["ts", "event_id"], "state")
    pivot = states.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "state"))).alias("m"))
    return pivot.select("user_id", F.explode("m").alias("event_type", "state"))


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, l_partkey, CAST(line AS BIGINT) AS line, 'CL_' || lpad(CAST(line AS VARCHAR), 4, '0') AS clause_id FROM l""")
def q34_rank_ids(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("l_orderkey", "l_partkey", F.col("line").cast("long").alias("line"), ids.ordinal_id("CL_%04d", F.col("line")).alias("clause_id"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""")
def q35_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return relational.carry_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "last_user").select("conv_id", "turn", "last_user")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
f AS (SELECT *, min(CASE WHEN NOT done THEN place END) OVER (PARTITION BY o_custkey) AS cur FROM o)
SELECT o_orderkey, CASE WHEN done THEN 'complete' WHEN place = cur THEN 'current' ELSE 'upcoming' END AS state FROM f""")
def q36_first_not_done(spark: SparkSession, sf: str) -> DataFrame:
    o = relational.ranked(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "place").withColumn("done", F.col("o_orderstatus") == "F")
    cur = F.min(F.when(~F.col("done"), F.col("place"))).over(Window.partitionBy("o_custkey"))
    return o.withColumn("_cur", cur).select("o_orderkey", F.when(F.col("done"), "complete").when(F.col("place") == F.col("_cur"), "current").otherwise("upcoming").alias("state"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT query_id, node_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) SELECT query_id, node_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 12""")
def q40_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = retrieval.nearest(queries, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS BIGINT) AS later, CAST(CASE substring(o_orderpriority, 3) WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 2 ELSE 1 END AS BIGINT) AS rank,
       row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE substring(o_orderpriority, 3) WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 0 WHEN 'LOW' THEN 2 ELSE 1 END, o_orderkey) AS place FROM orders""")
def q41_rank_map_sort(spark: SparkSession, sf: str) -> DataFrame:
    word = F.lower(F.expr("substring(o_orderpriority, 3)"))
    k = register.priority_rank(F.when(word == "urgent", "critical").otherwise(word), F.col("o_orderstatus") == "F")
    o = relational.ranked(table(spark, sf, "orders").withColumn("k", k), ["o_custkey"], [F.col("k.later"), F.col("k.rank"), F.col("o_orderkey")], "place")
    return o.select("o_orderkey", F.col("k.later").cast("long").alias("later"), F.col("k.rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT l_suppkey AS document, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS t FROM lineitem)
SELECT document, l_orderkey, CAST(i AS BIGINT) AS place FROM n WHERE t <= 80 OR i < 30 OR i >= t - 20 OR ((i - 30) % greatest(1, (t - 50) // 30) = 0 AND (i - 30) // greatest(1, (t - 50) // 30) < 30)""")
def q42_systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's lines are the pages of a document."""
    pages = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    sample = relational.systematic_sample(pages, ["document"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])
    return sample.select("document", "l_orderkey", F.col("place").cast("long").alias("place"))


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey, CAST(line AS BIGINT) AS line, l_partkey FROM l WHERE line <= 3""")
def q43_head_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where("line <= 3").select("l_orderkey", F.col("line").cast("long").alias("line"), "l_partkey")


@query("""WITH u AS (SELECT 0 AS src, s_suppkey AS pos, s_nationkey AS nation, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_nationkey, c_name FROM customer)
SELECT 'nation ' || nation AS merge_key, arg_min(name, src * 1000000000000 + pos) AS name, CASE WHEN min(src) = 0 THEN 'yes' END AS approved, count(*) AS merged_count FROM u GROUP BY nation""")
def q45_union_precedence(spark: SparkSession, sf: str) -> DataFrame:
    shape = lambda t, k, n, name: table(spark, sf, t).select(F.concat(F.lit("Nation "), F.col(n).cast("string")).alias("text"), F.col(name).alias("name"), F.array(F.col(k).cast("string")).alias("source_page_ids"), F.col(k).alias("ord"))
    merged = register.with_precedence(shape("supplier", "s_suppkey", "s_nationkey", "s_name"), shape("customer", "c_custkey", "c_nationkey", "c_name"), "fact", ["name"])
    return merged.select("merge_key", "name", "approved", "merged_count")


@query("""SELECT doc_id, 'labels' AS src FROM labels WHERE quality > 5 UNION ALL SELECT doc_id, 'documents' FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality > 5)""")
def q46_fallback_table(spark: SparkSession, sf: str) -> DataFrame:
    preferred = table(spark, sf, "labels").where("quality > 5").select("doc_id", F.lit("labels").alias("src"))
    return relational.fallback_table(preferred, table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("src")))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 80 THEN 'high' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 'review' ELSE 'low' END AS bucket FROM events""")
def q54_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.withColumn("bucket", jsonx.confidence_bucket(F.col("k") / 100, F.lit(False), F.lit(False)))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, 'https?://[^\s"''<>]+') AS urls, regexp_extract_all(html, '[0-9]+') AS nums FROM pages)
SELECT page_id, coalesce((SELECT string_agg(u, ' ' ORDER BY f) FROM (SELECT u, min(i) AS f FROM (SELECT unnest(urls) AS u, generate_subscripts(urls, 1) AS i) GROUP BY u ORDER BY f LIMIT 30)), '') AS urls,
       coalesce((SELECT string_agg(u, ' ' ORDER BY f) FROM (SELECT u, min(i) AS f FROM (SELECT unnest(nums) AS u, generate_subscripts(nums, 1) AS i) GROUP BY u ORDER BY f LIMIT 30)), '') AS numbers FROM h""")
def q81_harvest(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.array_join(extraction.harvest(F.col("html"), extraction.URL), " ").alias("urls"), F.array_join(extraction.harvest(F.col("html"), extraction.NUMBER), " ").alias("numbers"))
