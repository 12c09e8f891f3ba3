"""Queries of diverse and of hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from .registry import query, table

_NEAR = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT query_id, node_id, b, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS score FROM q, v),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 50)"""


@query(f"""WITH RECURSIVE {_NEAR},
c AS MATERIALIZED (SELECT x.query_id, x.rank, x.node_id, x.score, list(round(list_dot_product(x.b, y.b) / sqrt(list_dot_product(x.b, x.b) * list_dot_product(y.b, y.b)), 6) ORDER BY y.rank) AS likes FROM near x JOIN near y USING (query_id) GROUP BY ALL),
r AS (SELECT query_id, 0 AS step, CAST([] AS BIGINT[]) AS chosen FROM q UNION ALL
  SELECT query_id, step + 1, list_append(any_value(chosen), arg_max(c.rank, {{'w': 0.5 * c.score - 0.5 * CASE WHEN step = 0 THEN 0 ELSE list_max(list_transform(chosen, lambda i: likes[i])) END, 'r': -c.rank}})) FROM r JOIN c USING (query_id)
  WHERE step < 12 AND NOT list_contains(chosen, c.rank) GROUP BY query_id, step),
f AS (SELECT query_id, unnest(chosen) AS at, generate_subscripts(chosen, 1) AS rank FROM r WHERE step = 12)
SELECT f.query_id, c.node_id, c.score, CAST(f.rank AS INTEGER) AS rank FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.at""")
def q150_diverse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.lit("asked").alias("question"), F.col("embedding").alias("query_vector")).where("query_id % 100 = 0")
    return retrieval.searched(queries, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), search_type="MMR").select("query_id", "node_id", "score", "rank")


@query(rf"""WITH {_NEAR},
w AS MATERIALIZED (SELECT doc_id AS node_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
st AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS DOUBLE) / count(*) AS mean FROM w),
p AS MATERIALIZED (SELECT node_id, len(ws) AS length, term, count(*) AS tf FROM (SELECT node_id, ws, unnest(ws) AS term FROM w) GROUP BY ALL),
a AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM conversations JOIN q ON query_id = conv_id WHERE turn = 0),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT query_id, node_id, sum(CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) * 1000000 + 0.5) AS BIGINT)) AS score FROM a JOIN p USING (term) JOIN d USING (term), st GROUP BY 1, 2),
l AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM m QUALIFY rank <= 50
  UNION ALL SELECT query_id, node_id, rank FROM near WHERE query_id IN (SELECT conv_id FROM conversations WHERE turn = 0)),
f AS (SELECT query_id, node_id, sum(CAST(floor(1000000000 / (60 + rank) + 0.5) AS BIGINT)) / 1000000000 AS score FROM l GROUP BY 1, 2)
SELECT query_id, node_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 12""")
def q151_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """First turns of conversations, with vectors, against all documents."""
    e = table(spark, sf, "embeddings")
    turns = table(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    questions = turns.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id").where("query_id % 100 = 0")
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return retrieval.searched(questions, e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), search_type="HYBRID", nodes=nodes)
