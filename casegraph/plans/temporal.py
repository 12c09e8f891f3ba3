"""Queries of joins in time, rollups, sketches and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, temporal, versions
from ..streaming import folds
from .registry import query, table


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, o_custkey, CAST(l_shipdate AS DATE) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS ordered, max(o_orderkey) AS last_order, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, shipped, last_order, priority, ordered FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.shipped >= r.ordered""")
def q152_asof_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The customer's last order when a line was shipped."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"), F.col("o_orderkey").alias("last_order"), F.col("o_orderpriority").alias("priority"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    left = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return temporal.asof_join(left, o, ["o_custkey"], "shipped", "ordered", ["last_order", "priority", "ordered"], ties=["o_orderkey"]).drop("o_custkey")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY event_id DESC) AS n FROM events),
b AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view' AND n = 1)
SELECT b.event_id, CASE WHEN epoch_us(b.ts) - epoch_us(v.ts) <= 86400000000 THEN v.event_id END AS seen FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts > v.ts""")
def q153_asof_views(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase and the user's last view before it, of the last day only."""
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("seen"))
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return temporal.asof_join(bought, views, ["user_id"], "ts", "viewed", ["seen"], ties=["seen"], strict=True, within=86_400_000_000).select("event_id", "seen")


@query("""WITH l AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber = 7 THEN 400 ELSE CAST(l_quantity AS INTEGER) % 9 END AS e FROM lineitem)
SELECT a.l_partkey, a.id AS first_line, b.id AS second_line FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.id < b.id AND a.s < b.e AND b.s < a.e WHERE a.s < a.e AND b.s < b.e""")
def q154_overlapping_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of lines of one part that were on their way at the same time."""
    lines = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), F.when(F.col("l_linenumber") == 7, 400).otherwise(F.col("l_quantity").cast("int") % 9)).alias("e"))
    first = lines.select("l_partkey", F.col("id").alias("first_line"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    second = lines.select("l_partkey", F.col("id").alias("second_line"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return temporal.overlapping(first, second, ["l_partkey"], "s1", "e1", "s2", "e2").where("first_line < second_line").select("l_partkey", "first_line", "second_line")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def q155_clicks_followed(spark: SparkSession, sf: str) -> DataFrame:
    """The join of two streams, over tables."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    return folds.followed(clicks, bought, ["user_id"], "clicked", "bought", "6 HOURS", "1 hour").select("click", "purchase")


@query("""WITH o AS (SELECT o_orderpriority AS priority, c_nationkey AS nation, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT priority, nation, month, CAST(GROUPING_ID(priority, nation, month) AS BIGINT) AS grouping_id, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM o GROUP BY CUBE (priority, nation, month)""")
def q156_totals_cube(spark: SparkSession, sf: str) -> DataFrame:
    dims = ["priority", "nation", "month"]
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    rows = o.select(F.col("o_orderpriority").alias("priority"), "nation", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_custkey")
    return rollups.totals(rollups.grain(rows, dims, ["cents"], "o_custkey"), dims, rollups.cube_sets(dims), ["cents"], "customers").withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query("""SELECT o_orderstatus AS status, extract(year FROM CAST(o_orderdate AS DATE)) AS year, CAST(GROUPING_ID(o_orderstatus, extract(year FROM CAST(o_orderdate AS DATE))) AS BIGINT) AS grouping_id, CAST(sum(o_orderkey % 7) AS BIGINT) AS total, count(*) AS n
FROM orders GROUP BY ROLLUP (o_orderstatus, extract(year FROM CAST(o_orderdate AS DATE)))""")
def q157_totals_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.year(F.col("o_orderdate").cast("date")).cast("long").alias("year"), (F.col("o_orderkey") % 7).cast("long").alias("total"))
    dims = ["status", "year"]
    return rollups.totals(rollups.grain(rows, dims, ["total"]), dims, rollups.rollup_sets(dims), ["total"]).withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS hll_holds, TRUE AS theta_holds, TRUE AS median_holds FROM events GROUP BY 1""")
def q158_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sketches, merged over the days; estimates are held against the exact numbers, at five standard errors and the sketch's rank error."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    found = rollups.estimates(rollups.merged(rollups.sketched(e, ["event_type", "day"], "user_id", "value"), ["event_type"]), ["event_type"])
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    place = e.join(found.select("event_type", "q50"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("q50")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q50")).cast("double")).alias("up_to"))
    near = lambda c: F.abs(F.col(c) - F.col("users")) <= 5 * 0.0163 * F.col("users") + 0.5
    held = (F.col("below") <= 0.5 + 0.03) & (F.col("up_to") >= 0.5 - 0.03)
    return found.join(exact, "event_type").join(place, "event_type").select("event_type", "n", "users", near("members").alias("hll_holds"), near("members_theta").alias("theta_holds"), held.alias("median_holds"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(text), '[\t\n\x0b\f\r ]+')) AS word, generate_subscripts(string_split_regex(trim(text), '[\t\n\x0b\f\r ]+'), 1) AS place FROM documents WHERE trim(text) <> '')
SELECT doc_id, coalesce(string_agg(word, '|' ORDER BY place) FILTER (WHERE place % 11 = 5), '') AS deleted, coalesce(string_agg('§' || place, '|' ORDER BY place) FILTER (WHERE place % 11 = 5), '') AS inserted,
  CAST(2 * count(*) FILTER (WHERE place % 11 = 5) + count(*) FILTER (WHERE place % 11 = 5) + CASE WHEN count(*) = 1 OR max(place) % 11 <> 5 THEN 1 ELSE 0 END AS BIGINT) AS runs FROM w GROUP BY doc_id""")
def q159_word_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents against versions in which each eleventh word was replaced."""
    words = F.split(F.trim("text"), "[\\t\\n\\x0b\\f\\r ]+")
    docs = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", F.array_join(words, " ").alias("old"), F.array_join(F.transform(words, lambda w, i: F.when((i + 1) % 11 == 5, F.concat(F.lit("§"), i + 1)).otherwise(w)), " ").alias("new"))
    runs = versions.word_changes(docs, ["doc_id"], "old", "new")
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "text")))), lambda r: r["text"]), "|")
    return runs.groupBy("doc_id").agg(of("deleted").alias("deleted"), of("inserted").alias("inserted"), F.count(F.lit(1)).alias("runs"))
