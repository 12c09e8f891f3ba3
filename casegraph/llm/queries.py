"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, fingerprints, hard_negatives, lm_scores, mixing, packing, paragraph_dedup, quality, simhash, suffix_dedup, token_counts, token_files
from .workspace import Workspace, documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.digest(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("fingerprint").cast("long").alias("n_chosen"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    m = {k: F.col(f"measures.{part}.{k}") for k, part in (("n_words", "w"), ("word_chars", "w"), ("n_symbols", "s"), ("n_dup_lines", "l"), ("n_repeat_words", "w"))}
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return quality.quality_report(docs).select(
        "doc_id", *(c.alias(k) for k, c in m.items()), base.alias("base_failed"), (~base & F.col("rejected_by").isNull()).alias("kept")
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir).select("doc_id", "text"), end_id=2, capacity=1024)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", bpe.round_trip(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(documents(spark, sf_dir).select("doc_id", "text"), digests_only=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.scores(documents(spark, sf_dir).select("doc_id", "text"), order=3)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.duplicate_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "token-files").root
    token_files.write(documents(spark, sf_dir).select("doc_id", "text"), folder, end_id=0)
    return token_files.read(spark, folder, checksums=True).withColumnRenamed("key", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("code")).alias("fingerprint"), "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(documents(spark, sf_dir, "embeddings"), "vec_id", "embedding").drop("centroid")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(documents(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_paragraph_dedup": op8_paragraph_dedup,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
}

_INTEGERS = """SELECT row_number() OVER () AS rid, *, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    nearest = """(SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (
      SELECT q.rid, q.vec_id, q.v, c.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS BIGINT) AS d FROM q, {c} c) GROUP BY rid)"""
    steps = [f"""q AS MATERIALIZED (SELECT * FROM ({_INTEGERS}) WHERE len(v) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM q ORDER BY h LIMIT {k}))"""]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED {nearest.format(c=f"c{r}")},
s{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
  SELECT m.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s.v, o.v) AS v FROM c{r} o LEFT JOIN s{r} s USING (c))""")
    return f"""WITH {", ".join(steps)},
a AS MATERIALIZED {nearest.format(c=f"c{rounds}")}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.c = a.m.c"""


SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_hard_negatives": f"""
WITH e AS MATERIALIZED (SELECT rid, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_INTEGERS}) WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.rid,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (arid) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op13_source_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols FROM d),
k AS MATERIALIZED (SELECT rid, doc_id, source, size,
    -ln((CAST('0x' || substr(md5('13:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN size > 0 THEN CAST(size AS DOUBLE) / (size + 10 * symbols) ELSE 1.0 END AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM k GROUP BY source),
-- full sources are those of the least size a unit of weight; the level is that of the first number of them at which the next isn't full
o AS (SELECT *, row_number() OVER r AS place, coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
    sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight, sum(source_size) OVER () AS total
  FROM s WINDOW r AS (ORDER BY CAST(source_size AS DOUBLE) / weight, weight, source)),
l AS (SELECT CAST(total - 3 * full_size AS DOUBLE) / left_weight AS level FROM o
  WHERE CAST(total - 3 * full_size AS DOUBLE) / left_weight * weight <= 3 * source_size ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs
  FROM (SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target FROM s, l)),
m AS (SELECT k.doc_id, k.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size, k.rid ROWS UNBOUNDED PRECEDING) AS running
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN 2 * running - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m
""",
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM h) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
        AND NOT (2 * n_dup_lines > n_lines)) AS kept
FROM b
""",
}
