"""Nested JSON against Python's own walk; diverse and hybrid search against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.operators import agreements, jsontree, projections, retrieval

NAMES = ["page_text", "a", "b", "Full_Text", "list", "n", "fact_id", "PAGE_ID", "x y", 'q"', "é", ""]


def nested(rng, depth=0):
    kind = rng.random()
    if depth > 5 or kind < 0.35:
        return rng.choice([1, -2.5, 0, True, None, "", "plain", 'say "page_text": {', "back\\slash", "é\n\t]}", "x" * 40, "7 "])
    if kind < 0.65:
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(NAMES): nested(rng, depth + 1) for _ in range(rng.randint(0, 5))}


def without(value, names):
    if isinstance(value, dict):
        return {k: without(v, names) for k, v in value.items() if k.lower() not in names}
    if isinstance(value, list):
        return [without(v, names) for v in value]
    return value[:30].rstrip() + "…" if isinstance(value, str) and len(value) > 30 else value


def ids(value, names):
    found = set()
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        if isinstance(k, str) and k.lower() in names and not isinstance(v, (dict, list, bool)) and str(v or "").strip():
            found.add(str(v).strip())
        found |= ids(v, names)
    return found


def test_members_go_at_any_depth(spark):
    rng = random.Random(4)
    values = [nested(rng) for _ in range(300)]
    deep = {"page_text": 1, "k": 1}
    for _ in range(40):
        deep = {"n": [deep], "page_text": [{"a": 1}]}
    values += [deep, {"page_text": {}}, {"page_text": 1, "full_text": [], "a": {"page_text": 2}}, "page_text", ["page_text", {"page_text": [{}]}, 1]]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)]
    odd = [(9000, None), (9001, "not json"), (9002, '{"a":'), (9003, ""), (9004, rows[3][1]), (9004, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd], "id long, state string").withColumn("pos", F.lit(1))
    got = projections.without_keys(df, ["id"], "state", ["page_text", "full_text"], 30).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r["id"]: r["state"] for r in got}
    for i, v in enumerate(values):
        assert json.loads(found[i]) == without(v, {"page_text", "full_text"}), rows[i]
    assert [found[k] for k in (9000, 9001, 9002, 9003)] == [None] * 4
    assert json.loads(found[9004]) == without(values[3], {"page_text", "full_text"})


def test_strings_are_kept_as_written(spark):
    said = '{ "a" : "\\u00e9\\/", "b":[1.50, 2E3 ,true] , "long": "' + "y" * 200_000 + '"}'
    df = spark.createDataFrame([(1, said)], "id long, state string")
    assert jsontree.rewritten(df, ["id"], "state", ["z"]).first()["state"] == said


def test_ids_of_sections(spark):
    rng = random.Random(8)
    values = [(i, json.dumps(nested(rng)), json.dumps(nested(rng), ensure_ascii=False), None if i % 3 else "{") for i in range(200)]
    df = spark.createDataFrame(values, "k long, a string, b string, c string")
    got = {(r["k"], r["id"]) for r in agreements.harvested_ids(df, ["k"], ["a", "b", "c"]).collect()}
    names = {n.lower() for n in agreements.ID_KEYS}
    assert got == {(k, x) for k, a, b, _ in values for x in ids(json.loads(a), names) | ids(json.loads(b), names)}
    assert len(got) > 20


def vectors(spark, n=200, width=8):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (n - 20, width)), np.zeros((1, width)), np.tile(rng.normal(0, 1, width), (19, 1))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, vector array<double>")


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_diverse(spark, share):
    x, df = vectors(spark)
    queries = df.where("node_id % 50 = 0 OR node_id = 190").select(F.col("node_id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for r in retrieval.diverse(queries, df, 6, 30, share).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    for q in (0, 50, 100, 150, 190):
        score = {i: round(float(unit[q] @ unit[i]), 6) for i in range(len(x)) if x[i].any()}
        left, chosen = sorted(score, key=lambda i: (-score[i], i))[:30], []
        while len(chosen) < 6:
            like = lambda i: max((round(float(unit[i] @ unit[j]), 6) for j in chosen), default=0.0)
            best = max(left, key=lambda i: share * score[i] - (1 - share) * like(i))  # the first of equal ones
            chosen.append(best)
            left.remove(best)
        assert got[q] == chosen
    with pytest.raises(ValueError):
        retrieval.diverse(queries, df, 6, 30, 1.5)


def test_words_and_fusion(spark):
    texts = ["the cat sat on the mat", "The dog. The dog!", "a cat and a dog", "", None, "mat", "الخصم والدائن 2024", "cat " * 50]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, text string")
    questions = spark.createDataFrame([(1, "cat mat?"), (2, "nothing-here"), (3, "والدائن THE"), (4, " ")], "query_id long, question string")
    import math
    import re

    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(q, ws):
        total = 0
        for t in set(re.findall(r"\w+", q.lower())):
            df = sum(t in w for w in words)
            tf = ws.count(t)
            if tf:
                total += math.floor(1e6 * math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) + 0.5)
        return total / 1e6

    got = {(r["query_id"], r["node_id"]): (r["score"], r["rank"]) for r in retrieval.matched(questions, retrieval.inverted_index(nodes), len(texts), 3).collect()}
    for q, said in ((1, "cat mat?"), (2, "nothing-here"), (3, "والدائن THE"), (4, " ")):
        best = sorted((-score(said, w), i) for i, w in enumerate(words) if score(said, w))[:3]
        assert [(i, -s, n) for n, (s, i) in enumerate(best, 1)] == sorted(((i, s, n) for (k, i), (s, n) in got.items() if k == q), key=lambda x: x[2])
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, node_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, node_id long, rank int")
    assert [r["node_id"] for r in retrieval.fused([a, b], 2).orderBy("rank").collect()] == [11, 10]
    empty = nodes.limit(0)
    assert retrieval.matched(questions, retrieval.inverted_index(empty), 0).count() == 0


def test_texts_are_scored_where_they_lie(spark, monkeypatch):
    import random

    random.seed(3)
    texts = [" ".join(random.choice("abcdefgh") * random.randint(1, 2) for _ in range(random.randint(0, 9))) for _ in range(300)] + [None]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, text string").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(random.sample("abcdefgh", 3)) + " aa") for q in range(7)], "query_id long, question string")
    monkeypatch.setattr(retrieval, "TEXTS", 16)  # many parts a task: what is left out must not be among the best
    rows = lambda df: sorted(df.select("query_id", "node_id", "score", "rank").collect())
    want = rows(retrieval.matched(questions, retrieval.inverted_index(nodes), len(texts), 10))
    assert len(want) == 70 and rows(retrieval.matched_texts(questions, nodes, 10, block=2)) == want
    full = retrieval.matched_texts(questions, nodes, len(texts))
    assert rows(full.where("rank <= 10")) == want
    plan = retrieval.matched_texts(questions, nodes, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # no row for a pair of a question and a text that share a word


def test_search_types(spark):
    _, df = vectors(spark, 60)
    questions = df.where("node_id < 2").select(F.col("node_id").alias("query_id"), F.when(F.col("node_id") == 0, "word").otherwise(" ").alias("question"), F.col("vector").alias("query_vector"))
    nodes = df.select("node_id", F.lit("a word").alias("text"))
    for kind in retrieval.SEARCH_TYPES:
        found = retrieval.searched(questions, df, 5, 0.0 if "THRESHOLD" in kind else None, kind.lower(), nodes).collect()
        assert {r["query_id"] for r in found} == {0} and sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5], kind
    for kind, more in (("OTHER", {}), ("HYBRID", {}), ("SIMILARITY_THRESHOLD", {})):
        with pytest.raises(ValueError):
            retrieval.searched(questions, df, 5, search_type=kind, **more)


def test_members_go_without_a_shuffle(spark):
    said = ['{"a":1,"X":{"y":[1,{"x":2}]},"b":[{"x":1},{"c":"x","x":[[]]}]}', '{"\\u0078":1}', "no json", None, "[]", '{"z":{"x":1}, "x":2,"k":"é"}', '"x"']
    df = spark.createDataFrame(list(enumerate(said)), "k int, j string").coalesce(1)
    out = jsontree.rewritten(df, ["k"], "j", ["x"], lambda c: F.upper(c))
    assert [r.j for r in out.orderBy("k").collect()] == ['{"a":1,"b":[{},{"c":"X"}]}', "{}", None, None, "[]", '{"z":{},"k":"É"}', '"X"']
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
