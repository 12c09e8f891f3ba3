"""Queries over nested JSON: members dropped at any depth, ids of several sections, texts put into reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic
from ..operators import agreements, jsontree, projections
from .registry import query, table


@query(r"""SELECT event_id, '{"a":1, "n":{"b": 2},"list":[{"props":' || props || '},"page_text",{}],"note":"says \"page_text\": {","long":"'
  || CASE WHEN event_id % 20 <= 10 THEN repeat('é', CAST(1490 + event_id % 20 AS INTEGER)) ELSE repeat('é', 1500) || '…' END || '","id":' || event_id || '}' AS state FROM events""")
def q147_nested_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Forbidden members that hold objects, lists of objects and lists of lists; text that only mentions such a name stays."""
    parts = [
        '{"page_text":{"x":[1,{"y":"}\\\\"}]},"a":1, "n":{"Page_Text":[{"k":{"full_text":1}},[]],"b": 2 , "raw_content":[[1],2,{"z":"]"}]},"list":[{"props":', F.col("props"),
        ',"document_text":"x"},"page_text",{"transcription":-1.5e3}],"note":"says \\"page_text\\": {","conversation_history":[{"role":"user","text":"hi, \\"}],"},{"role":"x"}],"long":"', F.repeat(F.lit("é"), (1490 + F.col("event_id") % 20).cast("int")),
        '","id":', F.col("event_id").cast("string"), ',"image_base64":null}',
    ]
    said = F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return projections.without_keys(table(spark, sf, "events").select("event_id", said.alias("state")), ["event_id"], "state")


@query(r"""WITH o AS (SELECT o_custkey AS c, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s FROM orders), c AS (SELECT c_custkey AS c, CAST(c_nationkey AS VARCHAR) AS n FROM customer)
SELECT DISTINCT c AS c_custkey, id FROM (SELECT c, k AS id FROM o WHERE k <> '0' UNION ALL SELECT c, s || '"A' FROM o UNION ALL SELECT c, 'N' || n FROM c UNION ALL SELECT c, 'D' || c FROM c UNION ALL SELECT c, '-1.5' FROM c)""")
def q148_ids_of_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of nested lists of orders, of a summary, a case and an analysis, with escapes and names in any case."""
    o = table(spark, sf, "orders")
    items = F.struct(F.array(F.struct(F.col("o_orderkey").alias("fact_id"), F.lit('"page_id": "no"').alias("note"))).alias("nested"), F.concat(F.col("o_orderstatus"), F.lit('"A ')).alias("Page_ID"))
    material = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(items).alias("items"))).alias("material"))
    c = table(spark, sf, "customer").join(material, F.col("c_custkey") == F.col("o_custkey"), "left")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    sections = c.select(
        "c_custkey", "material",
        said('{"source":[[{"NODE_ID":" \\u004e', F.col("c_nationkey"), '"},{"evidence_id":""}],{"issue_id":null,"event_id":0}]}').alias("summary"),
        said('{"case_id":"C","document_id":"D', F.col("c_custkey"), '","party_id":{"name":"x"}}').alias("case"),
        said('{"finding_id" : -1.5,"timeline_id":true}').alias("analysis"),
    )
    return agreements.harvested_ids(sections, ["c_custkey"], ["material", "summary", "case", "analysis"])


@query("""SELECT p_partkey, '{"question":"مبلغ التحويل ' || p_partkey || ' SAR","alternatives":[{"text": "مبلغ التحويل ' || p_partkey || ' SAR"},["plain",' || p_partkey || ']],"مبلغ":null}' AS review FROM part""")
def q149_nested_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.col("p_partkey").cast("string"), F.lit(" SAR"))
    drawn = F.concat(number, F.lit(" "), F.reverse(F.lit("مبلغ التحويل")))
    said = F.concat(F.lit('{"question":"'), drawn, F.lit('","alternatives":[{"text": "'), drawn, F.lit('"},["plain",'), F.col("p_partkey").cast("string"), F.lit(']],"مبلغ":null}'))
    return jsontree.rewritten(table(spark, sf, "part").select("p_partkey", said.alias("review")), ["p_partkey"], "review", fix=arabic.reading_order)
