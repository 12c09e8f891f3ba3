"""Centroid clustering, hard negatives and mixing against brute force, on odd rows, ties and hot groups."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import centroids, hard_negatives, mixing, queries, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(n=400, seed=5, width=64, coarse=True):
    """Rows in a few clumps, with coarse components (so that there are ties), hot copies, and every odd kind of row."""
    rng = random.Random(seed)
    heads = [[rng.randint(-3, 3) / 8 for _ in range(width)] for _ in range(12)]
    out = []
    for i in range(n):
        v = [x + (rng.choice([0, 0, 0, 1, -1]) / 64 if coarse else rng.gauss(0, 0.1)) for x in rng.choice(heads)]
        out.append((i, v if i % 3 else heads[0], rng.randrange(4) if i % 5 else 1))
    odd = [(1000, None, 1), (1001, [0.1] * 63, 1), (1002, [0.1] * 63 + [None], 2), (1003, [float("nan")] * width, 1), (1004, [float("inf")] * width, 1), (1005, [], 1), (1006, [0.2] * width, None), (1007, [3e38] + [0.1] * (width - 1), 2), (None, [0.2] * width, 1), (None, None, None)]
    return [*out, *odd, out[0], out[0], out[100], (200, [0.3] * width, 1)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, VECTORS).repartition(parts).withColumns({c: F.lit("x") for c in ("values", "cluster", "row", "key", "score", "_hash", "source", "number")})


def whole(rows, width=None):
    found = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v) and (width is None or len(v) == width):
            found.append((i, [int(min(max(math.floor(256 * float(np.float32(x))), -vectors.MOST), vectors.MOST)) for x in v], label))
    return found


def brute_clusters(rows, k, rounds):
    kept = [(i, np.array(v, dtype=object)) for i, v, _ in whole(rows, 64)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    heads = [np.array(v, dtype=object) for _, v in named[:k]]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(heads))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        heads = [sum(by[j]) // len(by[j]) if by[j] else heads[j] for j in range(len(heads))]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return [(i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, heads[c])).encode()).hexdigest()) for i, c, d in found]


@pytest.mark.parametrize(("k", "rounds", "coarse"), [(40, 5, True), (25, 7, False), (1, 2, True)])
def test_clusters(spark, k, rounds, coarse):
    rows = [r for r in rows_of(coarse=coarse) if r[0] != 1007 or k == 1]
    got = centroids.clusters(table(spark, rows), "vec_id", "embedding", k, 64, rounds).drop("centroid")
    assert Counter(map(tuple, got.collect())) == Counter(brute_clusters(rows, k, rounds))


def test_clusters_of_few_rows(spark):
    assert centroids.clusters(table(spark, []), "vec_id", "embedding").count() == 0
    assert centroids.clusters(table(spark, [(1, None, 1), (2, [1.0], 1)]), "vec_id", "embedding").count() == 0
    three = [(i, [float(i)] * 64, 1) for i in range(3)]
    got = centroids.clusters(table(spark, three), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert len({r["cluster"] for r in got}) == 3


def test_filters_skip_distances_and_lose_no_centroid():
    rng = np.random.default_rng(1)
    heads = rng.integers(-900, 900, (40, 16))
    x = np.concatenate([h + rng.integers(-9, 9, (50, 16)) for h in heads])
    now = x[rng.permutation(len(x))[:40]]
    groups = centroids.groups_of(now, 4)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40))
    state, looked = centroids.first_look(x, now, groups), 0
    for _ in range(6):
        moved = np.stack([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else now[c] for c in range(40)])
        drift, now = np.sqrt(((moved - now) ** 2).sum(1).astype(float)), moved
        *state, n = centroids.next_look(x, *state, now, groups, drift)
        looked += n
        d = ((x[:, None, :] - now[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        root[np.arange(len(x)), state[0]] = np.inf
        assert all((state[2][:, g] <= root[:, m].min(1) * (1 + 1e-9)).all() for g, m in enumerate(groups))
    assert looked < 0.25 * 6 * d.size


def brute_negatives(rows, k=5, least=80):
    kept = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in whole(rows) if label is not None]
    found = []
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), (j is None, j or 0), j, other, m) for m, (j, w, other) in enumerate(kept) if m != n and len(w) == len(v)]
        scored.sort(key=lambda x: (x[0], x[1]))
        for p in [x for x in scored if x[3] == label][:k]:
            inside = [x for x in scored if x[3] != label and least * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            found += [(i, p[2], rank, x[2], -p[0], -x[0]) for rank, x in enumerate(inside[:k], 1)]
    return found


def test_hard_negatives(spark, tmp_path):
    rows = rows_of(700, seed=9)
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_hard_negatives(spark, str(tmp_path))
    want = brute_negatives(rows)
    assert len(want) > 100
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_hard_negatives_small_blocks_and_trees(spark):
    rows = rows_of(700, seed=2, coarse=False)
    df = table(spark, rows, 2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0, block=2)
    assert Counter(map(tuple, got.collect())) == Counter(brute_negatives(rows))
    assert hard_negatives.hard_negatives(df.limit(0), "vec_id", "embedding", label, F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, "vec_id", "embedding", label, F.lit(None).cast("boolean")).count() == 0
    none = hard_negatives.hard_negatives(df.withColumn("label", F.lit(None)), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0)
    assert none.count() == 0


def test_walk_opens_few_leaves():
    rng = np.random.default_rng(3)
    heads = rng.normal(0, 1, (20, 64))
    x = np.floor(256 * (heads[rng.integers(0, 20, 4000)] + rng.normal(0, 0.05, (4000, 64)))).astype(np.int64)
    tree = hard_negatives.Tree(x, 64)
    assert sorted(tree.order.tolist()) == list(range(4000))
    keys, leaves, opened = np.arange(4000), sum(c is None for c in tree.children), 0
    for a in range(0, 4000, 400):
        score = x @ x[a]
        high = int(np.sort(score)[-50])
        wanted = [hard_negatives.Wanted(5, 0.8 * high, high), hard_negatives.Wanted(3, high + 1)]
        to = {i: int(score[tree.vantage[i]]) for i in tree.inner}
        opened += hard_negatives.walk(tree, x[a], to, keys != a, keys, keys, wanted)
        for w in wanted:
            want = sorted((-int(s), int(k)) for s, k in zip(score, keys, strict=True) if w.low <= s <= w.high and k != a)[: w.k]
            assert [b[:2] for b in w.best] == want
    assert opened < 0.5 * 10 * leaves


DOCS = "doc_id long, text string, source string"


def documents(seed=1, n=600):
    rng = random.Random(seed)
    size = lambda: 3000 if rng.random() < 0.01 else rng.randint(0, 60)
    rows = [(i, " ".join(["w#"] * size()), "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "𝄞", "z", "", None, "tiny"][: 7 + (i == 5)])) for i in range(n)]
    return [*rows, (None, None, None), (None, "a b c", "a"), (7, "only here", "one"), (7, "only here", "one"), (3, "", "empty"), (4, None, "none"), rows[0], rows[0]]


def targets(sizes, most=3):
    """Exact water filling, in the order of code points, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - most * sum(sizes[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full) if len(full) < len(order) else 0
        above = {s for s in order if s not in full and level * weight[s] > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= above


@pytest.mark.parametrize(("fan", "few"), [(1024, 256), (4, 8)])
def test_mix(spark, monkeypatch, fan, few):
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "FEW", few)
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "weight", "n", "rest", "range", "before", "_key", "target")})
    got = mixing.mixed(df.repartition(3)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most, count = Counter(), Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
        most[source] = max(most[source], words(text))
        count[source] += 1
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] in (r["epochs"] * r["size"], (r["epochs"] + 1) * r["size"]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    # another partitioning gives the same mix, another seed does not
    again = mixing.mixed(df.repartition(7, "doc_id")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert Counter(map(tuple, mixing.mixed(df, seed=14).collect())) != Counter(map(tuple, got))


def test_mix_prefers_quality_and_takes_plans_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mixed(df, quality=F.when(F.col("doc_id") % 4 < 2, 9.0).otherwise(1.0), weights=(1, 3))
    r = got.where("source = 'a'").groupBy((F.col("doc_id") % 4 < 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    good, bad = next(x["t"] for x in r if x["good"]), next(x["t"] for x in r if not x["good"])
    assert good + bad == 10_000 and good > 4 * bad


def test_mix_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
