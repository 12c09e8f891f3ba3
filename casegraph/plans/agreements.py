"""Queries of reviewed agreements, of the pages that extractions, classifications and case maps read, and of review items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreements, projections, register
from ..sources import tables
from .registry import query, table

_LISTS = ", ".join(f"'{c}': {v}" for c, v in {"parties": "no", "dates": "dates", "amounts": "no", "case_numbers": "no", "claims": "claims", "key_facts": "facts", "legal_references": "no", "evidence": "no", "signatures_or_stamps": "no"}.items())
_CUT = ", ".join(f"'{c}': {v}" for c, v in {"parties": "no", "dates": "dates[1:8]", "amounts": "no", "case_numbers": "no", "claims": "claims[1:5]", "key_facts": "facts[1:5]", "legal_references": "no", "evidence": "no", "signatures_or_stamps": "no"}.items())
_KNOWN = "'page_id': page_id, 'page_number': page_number, 'document_type': kind"


@query(f"""WITH p AS (SELECT doc_id // 50 AS case_id, doc_id, CAST(doc_id AS VARCHAR) AS page_id, doc_id % 50 AS page_number, coalesce(source, '') AS kind, coalesce(lang, '') AS lang, text AS summary, CAST([] AS VARCHAR[]) AS no, [coalesce(lang, ''), coalesce(source, '')] AS dates, string_split(text, '. ') AS claims, string_split(text, chr(10)) AS facts FROM documents WHERE regexp_matches(text, '\\S')),
f AS (SELECT *, CAST(to_json({{{_KNOWN}, 'document_language': lang, 'summary': summary, {_LISTS}}}) AS VARCHAR) AS one, CAST(to_json({{{_KNOWN}, 'document_language': lang, 'summary': substring(summary, 1, 900), {_CUT}}}) AS VARCHAR) AS two, CAST(to_json({{{_KNOWN}, 'summary': substring(summary, 1, 700), 'key_facts': facts[1:4]}}) AS VARCHAR) AS three FROM p),
r AS (SELECT case_id, doc_id, CASE WHEN length(one) <= 2000 THEN 1 WHEN length(two) <= 2000 THEN 2 ELSE 3 END AS form, CASE WHEN length(one) <= 2000 THEN one WHEN length(two) <= 2000 THEN two ELSE three END AS record FROM f)
SELECT case_id, doc_id, form, record FROM r QUALIFY sum(length(record)) OVER (PARTITION BY case_id ORDER BY doc_id) <= 42000""")
def q164_map_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents are the pages of a case: cut in two stages, then as many as the map's budget holds."""
    d = table(spark, sf, "documents")
    pages = d.select(
        F.floor(F.col("doc_id") / 50).alias("case_id"), "doc_id", F.col("doc_id").alias("page_id"), (F.col("doc_id") % 50).alias("page_number"), F.col("source").alias("document_type"), F.col("lang").alias("document_language"),
        F.col("text").alias("summary"), F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("dates"), F.split("text", r"\. ").alias("claims"), F.split("text", "\n").alias("key_facts"),
    )
    return projections.map_pages(pages, "case_id", "doc_id")


@query("""WITH p AS (SELECT doc_id // 40 AS case_id, CAST(doc_id AS VARCHAR) AS page_id, 'D' || doc_id % 4 AS document_id, doc_id % 10 AS page_number, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS page_text, CASE WHEN doc_id % 3 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM documents)
SELECT case_id, page_id, document_id AS case_document_id, CAST(page_number AS INTEGER) AS page_number, page_text, mime AS page_image_mime_type, CAST(row_number() OVER (PARTITION BY case_id ORDER BY document_id, page_number, page_id) AS INTEGER) AS place FROM p WHERE page_text <> '' AND document_id IN ('D1', 'D3')""")
def q165_page_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with text of two documents of each case, numbered in order."""
    k = F.col("doc_id")
    pages = table(spark, sf, "documents").select(F.floor(k / 40).alias("case_id"), k.cast("string").alias("page_id"), F.concat(F.lit("D"), k % 4).alias("case_document_id"), (k % 10).alias("page_number"), F.col("text").alias("page_text"), F.when(k % 3 == 0, "image/jpeg").when(k % 3 == 1, "").alias("page_image_mime_type"))
    return tables.page_sources(pages, "case_id", ["D1", "D3"]).drop("page_image_path")


@query("""WITH c AS (SELECT o_orderkey, unnest(['P' || o_orderkey % 7, 'P' || o_orderkey % 5, 'P' || o_orderkey % 7, '']) AS id, unnest([0, 1, 2, 3]) AS pos FROM orders),
g AS (SELECT o_orderkey, id, min(pos) AS pos FROM c WHERE (o_orderkey, id) IN (SELECT l_orderkey, 'P' || l_partkey % 10 FROM lineitem) GROUP BY 1, 2),
a AS (SELECT o_orderkey, string_agg(id, ',' ORDER BY pos) AS ids FROM g GROUP BY 1)
SELECT o_orderkey AS clause_id, CASE WHEN o_orderkey % 3 = 0 THEN 'partial' WHEN ids IS NULL THEN 'unsupported' ELSE 'supported' END AS support_status, CASE WHEN o_orderkey % 3 <> 0 AND ids IS NULL THEN 'none' ELSE o_orderpriority END AS finding, coalesce(ids, '') AS ids FROM orders LEFT JOIN a USING (o_orderkey)""")
def q166_grounded_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews that cite parts, cut to the parts of their own order."""
    k = F.col("o_orderkey")
    node = lambda x: F.concat(F.lit("P"), x)
    reviews = table(spark, sf, "orders").select(k.alias("clause_id"), F.when(k % 3 == 0, "partial").otherwise("supported").alias("support_status"), F.col("o_orderpriority").alias("finding"), F.array(F.concat(F.lit(" "), node(k % 7)), node(k % 5), node(k % 7), F.lit(" "), F.lit(None)).alias("authority_ids"))
    offered = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clause_id"), node(F.col("l_partkey") % 10).alias("node_id"))
    return agreements.grounded_reviews(reviews, offered, ["clause_id"], "none").withColumn("ids", F.array_join("authority_ids", ",")).drop("authority_ids")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(to_json({'clause_id': 'C' || o_orderkey, 'finding': o_orderpriority}) AS VARCHAR) AS j, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
w AS (SELECT o_custkey, n, CAST(1 AS BIGINT) AS group_no, length(j) AS used FROM o WHERE n = 1
  UNION ALL SELECT o.o_custkey, o.n, group_no + CASE WHEN used + length(j) > 150 THEN 1 ELSE 0 END, CASE WHEN used + length(j) > 150 THEN length(j) ELSE used + length(j) END FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.n = w.n + 1)
SELECT o_custkey, group_no, count(*) AS clauses, string_agg(j, ' ' ORDER BY n) AS reviews FROM w JOIN o USING (o_custkey, n) GROUP BY 1, 2""")
def q167_synthesis_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as reviewed clauses, three or so to a group."""
    reviews = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("C"), "o_orderkey").alias("clause_id"), F.col("o_orderpriority").alias("finding"))
    found = agreements.synthesis_groups(reviews, "o_custkey", "o_orderkey", 150, 200)
    return found.select("o_custkey", F.col("group_no").cast("long").alias("group_no"), "clauses", F.array_join("reviews", " ").alias("reviews"))


@query("""WITH p AS (SELECT doc_id // 200 AS agreement, CAST(doc_id AS VARCHAR) AS page_id, trim(coalesce(source, '')) AS document_id, doc_id % 200 AS page_number, trim(coalesce(text, '')) AS page_text, CASE WHEN doc_id % 2 = 1 THEN 'Summary ' || doc_id ELSE '' END AS page_summary FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY agreement ORDER BY document_id, page_number, page_id) - 1 AS pos, count(*) OVER (PARTITION BY agreement) AS total FROM p), s AS (SELECT *, greatest(1, (total - 50) // 30) AS step FROM n)
SELECT agreement, page_id, document_id, CAST(page_number AS INTEGER) AS page_number, substring(CASE WHEN page_summary <> '' THEN page_summary ELSE page_text END, 1, 3500) AS text FROM s WHERE total <= 80 OR pos < 30 OR pos >= total - 20 OR ((pos - 30) % step = 0 AND (pos - 30) // step < 30)""")
def q168_classification_material(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred documents are the pages of an agreement: the ones that a classification reads."""
    k = F.col("doc_id")
    pages = table(spark, sf, "documents").select(F.floor(k / 200).alias("agreement"), k.alias("case_document_page_id"), F.col("source").alias("case_document_id"), (k % 200).alias("page_number"), F.col("text").alias("page_text"), F.when(k % 2 == 1, F.concat(F.lit("Summary "), k)).alias("page_summary"))
    return agreements.classification_material(pages, "agreement")


_CAPPED = "CASE WHEN length(trim(coalesce({0}, ''))) <= {1} THEN trim(coalesce({0}, '')) ELSE rtrim(substring(trim({0}), 1, {1})) || '…' END"


@query(f"""SELECT doc_id, {_CAPPED.format("text", 1200)} AS page_summary, {_CAPPED.format("text", 250)} AS title, lang, array_to_string(string_split(text, ' ')[1:25], '|') AS words FROM documents""")
def q169_review_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items of a review: whole texts go, other texts and lists are cut."""
    items = table(spark, sf, "documents").select("doc_id", F.col("text").alias("page_summary"), F.col("text").alias("title"), F.col("text").alias("full_text"), "lang", F.split("text", " ").alias("words"))
    return projections.review_items(items, ["doc_id"]).withColumn("words", F.array_join("words", "|"))


@query("""SELECT o_custkey, 'N' || l_partkey % 10 AS node_id, list(l_returnflag || l_suppkey ORDER BY l_orderkey * 8 + l_linenumber DESC, l_returnflag || l_suppkey DESC)[1] AS text, min(l_orderkey * 8 + l_linenumber) AS first_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 > 0 GROUP BY 1, 2""")
def q170_package_authorities(spark: SparkSession, sf: str) -> DataFrame:
    """What a customer's orders found, each once: its last text at its first place."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    found = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    node = F.when(F.col("l_partkey") % 10 > 0, F.concat(F.lit(" N"), F.col("l_partkey") % 10))
    return agreements.package_authorities(found.select("o_custkey", node.alias("node_id"), at.alias("at"), F.concat("l_returnflag", "l_suppkey").alias("text")), "o_custkey", "at")


@query("""SELECT c_custkey, trim(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'nation ' || c_nationkey ELSE c_mktsegment END AS role FROM customer WHERE c_custkey % 5 > 0""")
def q171_party_list(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a name, by their role, or by what they are where none is known."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 5 > 0, F.concat(F.lit(" "), "c_name")).otherwise(" ").alias("party_name"), F.when(k % 3 == 0, F.concat(F.lit("nation "), "c_nationkey")).when(k % 3 == 1, " ").alias("role_in_case"), F.col("c_mktsegment").alias("party_type"))
    return register.party_list(rows).select("c_custkey", "name", "role")
