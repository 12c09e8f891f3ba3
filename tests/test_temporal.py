"""Joins in time, versions, rollups and sketches against brute force."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegraph.operators import rollups, temporal, versions


def moments(n, seed, hot=0.4):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else 1 if rng.random() < hot else rng.randint(2, 12), None if rng.random() < 0.05 else rng.randint(0, 300)) for i in range(n)]


@pytest.mark.parametrize(("strict", "within", "ranges"), [(False, None, 64), (True, None, 5), (False, 7, 1), (True, 7, 64)])
def test_asof(spark, strict, within, ranges):
    left, right = moments(300, 1), moments(400, 2)
    l_ = spark.createDataFrame(left, "id long, k long, t long").repartition(3)
    r = spark.createDataFrame(right, "rid long, k long, rt long").repartition(5)
    got = temporal.asof_join(l_, r, ["k"], "t", "rt", ["rid", "rt"], ["rid"], strict, within, ranges)
    assert got.columns == ["id", "k", "t", "rid", "rt"]

    def match(k, t):
        rows = [(rt, rid) for rid, k2, rt in right if k is not None and t is not None and k2 == k and rt is not None and (rt < t if strict else rt <= t)]
        best = max(rows, default=None)
        return (None, None) if best is None or within is not None and t - best[0] > within else best[::-1]

    assert Counter(map(tuple, got.collect())) == Counter((i, k, t, *match(k, t)) for i, k, t in left)


def test_asof_of_nothing_and_of_dates(spark):
    l_ = spark.createDataFrame([(1, datetime.date(2024, 1, 5))], "k long, d date")
    r = spark.createDataFrame([(1, datetime.date(2024, 1, 1), None), (1, datetime.date(2024, 1, 5), "b")], "k long, d2 date, v string")
    assert [x["v"] for x in temporal.asof_join(l_, r, ["k"], "d", "d2", ["v"]).collect()] == ["b"]
    # the last row counts, though its value is null
    assert [x["v"] for x in temporal.asof_join(l_, r, ["k"], "d", "d2", ["v"], strict=True).collect()] == [None]
    assert temporal.asof_join(l_.limit(0), r, ["k"], "d", "d2", ["v"]).count() == 0
    assert [x["v"] for x in temporal.asof_join(l_, r.limit(0), ["k"], "d", "d2", ["v"]).collect()] == [None]
    with pytest.raises(TypeError):
        temporal.asof_join(l_.withColumn("d", F.lit("x")), r, ["k"], "d", "d2", ["v"])


def intervals(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(-200, 200)
        out.append((i, rng.choice([1, 1, 2, None]), s, None if rng.random() < 0.05 else s + rng.choice([0, -3, 1, 2, 3, 5, 8, 64, 1000])))
    return out


def test_intervals(spark):
    a, b = intervals(150, 3), intervals(150, 4)
    left = spark.createDataFrame(a, "ai long, k long, s1 long, e1 long").repartition(2)
    right = spark.createDataFrame(b, "bi long, k long, s2 long, e2 long").repartition(3)
    got = Counter((r["ai"], r["bi"]) for r in temporal.overlapping(left, right, ["k"], "s1", "e1", "s2", "e2").collect())
    full = lambda s, e: e is not None and s < e
    assert got == Counter((i, j) for i, k, s, e in a for j, k2, s2, e2 in b if k is not None and k == k2 and full(s, e) and full(s2, e2) and s < e2 and s2 < e)
    found = temporal.within_intervals(left.select("ai", "s1"), right.select("bi", "s2", "e2"), [], "s1", "s2", "e2")
    assert Counter((r["ai"], r["bi"]) for r in found.collect()) == Counter((i, j) for i, _, s, _ in a for j, _, s2, e2 in b if full(s2, e2) and s2 <= s < e2)
    assert temporal.within_intervals(left.select("k", "ai", "s1"), right.limit(0), ["k"], "s1", "s2", "e2").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def dynamic_script(a, b):
    """The longest common subsequence by its whole table."""
    n, m = len(a), len(b)
    lcs = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            lcs[i][j] = lcs[i + 1][j + 1] + 1 if a[i] == b[j] else max(lcs[i + 1][j], lcs[i][j + 1])
    runs, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            step = ("same", a[i])
            i, j = i + 1, j + 1
        elif i < n and (j == m or lcs[i + 1][j] >= lcs[i][j + 1]):
            step = ("deleted", a[i])
            i += 1
        else:
            step = ("inserted", b[j])
            j += 1
        if runs and runs[-1][0] == step[0]:
            runs[-1] = (step[0], runs[-1][1] + step[1])
        else:
            runs.append(step)
    return runs


@given(st.lists(st.sampled_from("abc "), max_size=14), st.lists(st.sampled_from("abcd "), max_size=14))
@settings(max_examples=400, deadline=None)
def test_edit_script(a, b):
    assert versions.edit_script(a, b) == dynamic_script(a, b)


def test_edit_script_over_many_layers(monkeypatch):
    monkeypatch.setattr(versions, "STEP", 7)
    monkeypatch.setattr(versions, "FEW", 9)
    rng = random.Random(1)
    for n, m in ((60, 80), (90, 0), (0, 40), (70, 70)):
        a, b = ([rng.choice("abcdefgh ") for _ in range(k)] for k in (n, m))
        assert versions.edit_script(a, b) == dynamic_script(a, b)


def test_word_changes(spark):
    rows = [(1, "the cat  sat\non the mat", "the dog sat\non a mat today"), (2, None, "new"), (3, "gone", None), (4, None, None), (5, "", ""), (6, "same", "same"), (7, " lead", "lead "), (8, "w " * 5000, "w " * 5000 + "end"), (1, "repeated key", "repeated key!")]
    got = defaultdict(list)
    for r in versions.word_changes(spark.createDataFrame(rows, "id long, a string, b string").withColumn("kind", F.lit(1)), ["id"], "a", "b").orderBy("id", "place").collect():
        got[r["id"]].append((r["kind"], r["text"]))
    for i, a, b in rows[1:-1]:
        assert "".join(t for k, t in got[i] if k != "inserted") == (a or "")
        assert "".join(t for k, t in got[i] if k != "deleted") == (b or "")
    assert got[2] == [("inserted", "new")] and got[4] == [] and got[6] == [("same", "same")]
    assert [k for k, _ in got[8]] == ["same", "inserted"]


def test_totals(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 3), rng.randint(0, 100_000) if i % 9 else None, rng.choice([1, 2, None])) for i in range(800)]
    df = spark.createDataFrame(rows, "x string, y long, member long, v long").repartition(4)
    dims = ["x", "y"]
    got = rollups.totals(rollups.grain(df, dims, ["v"], "member"), dims, rollups.cube_sets(dims), ["v"], "seen").collect()
    want = {}
    for bits in range(4):
        by = defaultdict(list)
        for x, y, m, v in rows:
            by[(None if bits & 2 else x, None if bits & 1 else y, bits)].append((m, v))
        for k, r in by.items():
            vs = [v for _, v in r if v is not None]
            want[k] = (sum(vs) if vs else None, len(r), len({m for m, _ in r if m is not None}))
    assert {(r["x"], r["y"], r["grouping_id"]): (r["v"], r["n"], r["seen"]) for r in got} == want
    assert len(got) == len(want)
    assert rollups.rollup_sets(dims) == [["x", "y"], ["x"], []]


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("member"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"), ((F.col("id") * 7919) % 10_007).alias("v"))
    days = rollups.sketched(df, ["side", "day"], "member", "v")
    all_ = rollups.estimates(rollups.merged(days.withColumn("all", F.lit(1)), ["all"]), ["all"], (0.1, 0.5)).first()
    assert all_["n"] == 40_000
    assert abs(all_["members"] - 20_000) < 5 * 0.0163 * 20_000 and abs(all_["members_theta"] - 20_000) < 5 * 0.0163 * 20_000
    values = sorted((i * 7919) % 10_007 for i in range(40_000))
    for share, q in ((0.1, all_["q10"]), (0.5, all_["q50"])):
        assert abs(sum(v <= q for v in values) / 40_000 - share) < 0.03
    both = rollups.in_both(days, [], "side", "a", "b").first()["both"]
    assert both == 0  # even and odd members
    shared = rollups.in_both(days.withColumn("half", F.when(F.col("day") < 4, "first").otherwise("last")), ["side"], "half", "first", "last").collect()
    exact = df.groupBy("side", "member").agg(F.max(F.col("day") < 4).alias("f"), F.max(F.col("day") >= 4).alias("l")).where("f AND l").groupBy("side").count().collect()
    want = {r["side"]: r["count"] for r in exact}
    assert all(abs(r["both"] - want[r["side"]]) < 0.1 * 20_000 for r in shared) and len(shared) == 2


def test_members_of_any_kind_are_counted(spark):
    df = spark.createDataFrame([("a", "m1", 1), ("a", "m2", 1), ("b", "m1", 1), ("b", None, 1)], "x string, member string, v long")
    got = rollups.totals(rollups.grain(df, ["x"], ["v"], "member"), ["x"], rollups.cube_sets(["x"]), ["v"], "seen").collect()
    assert {(r["x"], r["v"], r["n"], r["seen"]) for r in got} == {("a", 2, 2, 2), ("b", 2, 2, 1), (None, 4, 4, 2)}


def test_few_lengths_of_cells(spark):
    points = spark.createDataFrame([(1, 5)], "a long, t long")
    held = spark.createDataFrame([(i, 3, 3 + i) for i in (1, 2, 3, 4, 8, 400)], "i long, s long, e long")
    found = temporal.within_intervals(points, held, [], "t", "s", "e")
    assert "[0,3,9]" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["i"] for r in found.collect()) == [3, 4, 8, 400]
    far = spark.createDataFrame([(1, -(2**62) + 1, 2**62 - 2)], "i long, s long, e long")
    assert temporal.within_intervals(points, far, [], "t", "s", "e").count() == 1


def test_lone_tokens_are_not_searched(monkeypatch):
    layers = []
    kept = versions._small_layer
    monkeypatch.setattr(versions, "_small_layer", lambda *given: layers.append(1) or kept(*given))
    a = [str(i % 7) for i in range(200)]
    b = [f"§{i}" if i % 11 == 5 else t for i, t in enumerate(a)]
    lone = sum(t.startswith("§") for t in b)
    assert versions.edit_script(a, b) == dynamic_script(a, b)
    assert len(layers) <= 2 * lone  # the search and what is read back; twice the differences before


def test_lone_tokens_at_random():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 12))] for letters in ("abxy", "abuv"))
        assert versions.edit_script(a, b) == dynamic_script(a, b)
