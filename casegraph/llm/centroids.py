"""Centroid clustering (k-means) of integer vectors, with the filters of Yinyang (Ding et al., ICML 2015).

The first centroids are put into groups once. A row carries its cluster, an upper bound of the distance to its centroid, and
for each group a lower bound of the distance to the group's other centroids. After a round the bounds move by how far the
centroids went. A row whose upper bound lies below all lower bounds keeps its cluster unseen (global filter); else only groups
whose bound it reaches are looked at, and in those only centroids that may be near enough, whose distances are then exact.

Distances are integers; bounds are square roots with a slack, so that rounding never hides a centroid, ties included.

A round maps over the rows (no shuffle), and is written to the shared folder with its bounds: that is where a lost executor's work
starts again. Sums of clusters are gathered a task, then added up; the driver sees k times width numbers, whatever the input.

Edge cases: rows without a usable vector have no row in the result (see vectors.integers). Repeated rows count as often as they
stand there. Null keys are clustered too, but are the last to be chosen as first centroids. With fewer rows than k there are that
many centroids; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integers, matrix, products
from .workspace import Workspace

#: Centroids that a group has on average.
GROUP = 10
#: Relative slack of bounds, far above the error of doubles.
SLACK = 1e-9


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c."""
    return (x * x).sum(1)[:, None] - 2 * products(x, c) + (c * c).sum(1)[None, :]


def _paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to its row of c (or to the one row c)."""
    d = x - c
    return (d * d).sum(1)


def groups_of(centroids: np.ndarray, number: int, rounds: int = 5) -> list[np.ndarray]:
    """Which centroids stand together: a few rounds of plain clustering among the centroids themselves."""
    number = max(1, min(number, len(centroids)))
    heads = centroids[:number].astype(np.float64)
    for _ in range(rounds):
        d = ((centroids[:, None, :] - heads[None]) ** 2).sum(2)
        own = d.argmin(1)
        heads = np.array([centroids[own == g].mean(0) if (own == g).any() else heads[g] for g in range(number)])
    return [m for g in range(number) if len(m := np.flatnonzero(own == g))]


def first_look(x: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower bounds of rows that have none: all distances are computed."""
    d = _squared(x, centroids)
    cluster = d.argmin(1)  # the first of equal ones
    root = np.sqrt(d.astype(np.float64))
    upper = root[np.arange(len(x)), cluster]
    root[np.arange(len(x)), cluster] = np.inf
    return cluster, upper, np.stack([root[:, m].min(1) for m in groups], 1)


def next_look(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray], drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids have moved by drift, and how many distances were computed."""
    reach = lambda bound: bound * (1 + SLACK) + SLACK
    cluster, before = cluster.copy(), lower
    upper = upper + drift[cluster]
    lower = before - np.array([drift[m].max() for m in groups])
    open_ = np.flatnonzero(reach(upper) >= lower.min(1))
    own = _paired(x[open_], centroids[cluster[open_]])
    looked = len(open_)
    upper[open_] = np.sqrt(own.astype(np.float64))
    still = reach(upper[open_]) >= lower[open_].min(1)
    rows, own = open_[still], own[still]
    old, best, least = cluster[rows], cluster[rows], own.copy()
    scanned = []
    for g, members in enumerate(groups):
        s = np.flatnonzero(reach(np.sqrt(least.astype(np.float64))) >= lower[rows, g])
        bound = before[rows[s], g][:, None] - drift[members][None, :]
        for j, m in enumerate(members):
            near = np.flatnonzero((reach(np.sqrt(least[s].astype(np.float64))) >= bound[:, j]) | (old[s] == m))
            d = _paired(x[rows[s[near]]], centroids[m])
            looked += len(near)
            bound[near, j] = np.sqrt(d.astype(np.float64))
            at = s[near]
            better = (d < least[at]) | ((d == least[at]) & (m < best[at]))
            best[at[better]], least[at[better]] = m, d[better]
        scanned.append((s, bound))
    new = lower[rows]
    for g, members in enumerate(groups):
        left = np.isin(old, members) & (old != best)  # the centroid that a row has left counts for its group from now on
        new[left, g] = np.minimum(new[left, g], np.sqrt(own[left].astype(np.float64)))
        s, bound = scanned[g]
        bound[members[None, :] == best[s][:, None]] = np.inf
        new[s, g] = bound.min(1) if len(s) else new[s, g]
    cluster[rows], upper[rows], lower[rows] = best, np.sqrt(least.astype(np.float64)), new
    return cluster, upper, lower, looked


STATE = "values array<int>, cluster int, upper double, lower array<double>, distance long"


def _round(rows: DataFrame, key: str, centroids: np.ndarray, groups: list[np.ndarray], drift: np.ndarray | None) -> DataFrame:
    width, n_groups = centroids.shape[1], len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            if drift is None:
                cluster, upper, lower = first_look(x, centroids, groups)
            else:
                lower = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_groups)
                cluster, upper, lower, _ = next_look(x, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), lower, centroids, groups, drift)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_groups)
            listed = pa.ListArray.from_arrays(offsets, pa.array(lower.ravel()))
            found = [pa.array(cluster.astype(np.int32)), pa.array(upper), listed, pa.array(_paired(x, centroids[cluster]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], [key, "values", "cluster", "upper", "lower", "distance"])

    read = [key, "values"] if drift is None else [key, "values", "cluster", "upper", "lower"]
    return rows.select(*read).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {STATE}")


def _sums(rows: DataFrame, k: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> number of rows and componentwise sums: k rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x, cluster = matrix(batch.column(1), width), batch.column(0).to_numpy()
            order = np.argsort(cluster, kind="stable")
            there, at, n = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(there):
                total[there] += np.add.reduceat(x[order], at, axis=0)
                count[there] += n
        some = np.flatnonzero(count)
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()))], ["cluster", "n", "total"])

    parts = rows.select("cluster", "values").mapInArrow(run, "cluster int, n long, total array<long>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "at").collect():
        found.setdefault(r["cluster"], (r["n"], []))[1].append(r["v"])
    return found


def clusters(df: DataFrame, key: str, vector: str, k: int = 40, width: int = 64, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """key, cluster int, distance long (squared), cluster_inertia and inertia long, centroid (array<long>), centroid_sha256.

    Centroids start as the k rows with the least sha256 of "seed:key". A round assigns each row to the nearest one (ties: the smaller
    number) and moves those that have rows to floor(sum / count); after the rounds rows are assigned once more.
    """
    if k < 1 or rounds < 0 or width < 1:
        raise ValueError("k and width are at least 1, rounds at least 0")
    spark, work = df.sparkSession, Workspace(df.sparkSession, "centroids")
    kind = df.schema[key].dataType.simpleString()
    rows = work.table(integers(df, [key], vector, scale, width), "rows")
    named = rows.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    start = named.orderBy(F.col("_hash").asc_nulls_last(), "values").limit(k).collect()
    if not start:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    now = np.array([r["values"] for r in start], np.int64)
    groups, drift = groups_of(now, len(now) // GROUP), None
    for _ in range(rounds):
        assigned = work.table(_round(rows, key, now, groups, drift), "rows")
        work.drop(rows)
        rows, moved = assigned, now.copy()
        for c, (n, total) in _sums(rows, len(now), width).items():
            moved[c] = [v // n for v in total]
        drift, now = np.sqrt(_paired(moved, now).astype(np.float64)), moved
    last = work.table(_round(rows, key, now, groups, drift).select(key, "cluster", "distance"), "result")
    work.drop(rows)
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = [(c, sums[c], sum(sums.values()), now[c].tolist(), digest(now[c].tolist())) for c in sorted(sums)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return last.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")  # k rows
