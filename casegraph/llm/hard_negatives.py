"""Hard negatives: for each anchor and positive, the best rows of other labels whose scores lie in a window below the positive's.

Scores are inner products. A row x of a chunk gets one more component, sqrt(M - |x|^2) with M the largest |x|^2 of the chunk, an anchor
a gets 0: then the squared distance of a and x is |a|^2 + M - 2 score, and a window of scores is an annulus around the anchor. Each task
builds a vantage-point tree over each chunk of its rows, and walks it from the nearest node outward: nodes wholly inside the
annulus' hole or outside it are not opened, and the walk ends when every window has its rows. What a task has found in earlier chunks narrows
the windows of later ones. Scores are exact integers; bounds have a slack, so rounding hides no row.

Rows are never shuffled: each task keeps k rows an anchor (and window), and those meet in a shuffle by anchor. Anchors go to the tasks
in blocks of BLOCK rows, a matrix of bounded size; each block's results are written, and more anchors mean more scans of the rows.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different widths
have no score. Repeated rows are rows of their own: an anchor's copy is another row. A null key is never an anchor, and stands
last among ties. An anchor without positives, a positive without negatives, an empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import integers, matrix, products
from .workspace import Workspace

#: Anchors of a block: with 64 components their matrix has two megabytes.
BLOCK = 4096
#: Rows of a tree, and of a leaf.
CHUNK, LEAF = 8192, 128
#: Share of the largest score that bounds give way.
SLACK = 1e-9
NO_KEY = (1 << 63) - 1


class Tree:
    """A vantage-point tree over rows of integers. Node i has rows order[start:end]; an inner node has a vantage row, two children,
    and the least and greatest distances of each child's rows to the vantage row."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        norms = (x * x).sum(1)
        self.most = int(norms.max()) if len(x) else 0
        more = np.sqrt((self.most - norms).astype(np.float64))
        wide = np.concatenate([x.astype(np.float64), more[:, None]], 1)
        self.order = np.arange(len(x))
        self.start, self.end, self.vantage, self.children, self.ranges = [], [], [], [], []
        todo = [(0, len(x))] if len(x) else []
        while todo:  # level by level
            next_, base = [], len(self.start) + len(todo)
            for a, b in todo:
                self.start.append(a)
                self.end.append(b)
                if b - a <= leaf:
                    self.vantage.append(-1)
                    self.children.append(None)
                    self.ranges.append(None)
                    continue
                rows = self.order[a:b]
                d = np.sqrt(((wide[rows] - wide[rows[0]]) ** 2).sum(1))
                half = (b - a) // 2
                by = np.argpartition(d, half)
                self.vantage.append(int(rows[0]))
                self.order[a:b], d = rows[by], d[by]
                self.children.append((base + len(next_), base + len(next_) + 1))
                self.ranges.append((float(d[:half].min()), float(d[:half].max()), float(d[half:].min()), float(d[half:].max())))
                next_ += [(a, a + half), (a + half, b)]
            todo = next_
        self.inner = [i for i, v in enumerate(self.vantage) if v >= 0]


class Wanted:
    """The best rows of an anchor within a window of scores: (-score, key, row) ascending, k at most."""

    __slots__ = ("best", "high", "k", "low")

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.best: list[tuple] = []
        self.k, self.low, self.high = k, low, high

    def floor(self) -> float:
        """Scores below this are of no use."""
        if self.low > self.high:
            return np.inf
        return max(self.low, -self.best[-1][0]) if len(self.best) == self.k else self.low

    def add(self, item: tuple) -> None:
        if len(self.best) < self.k or item < self.best[-1]:
            bisect.insort(self.best, item)
            del self.best[self.k :]


def walk(tree: Tree, anchor: np.ndarray, to_vantage: dict[int, int], usable: np.ndarray, keys: np.ndarray, rows: np.ndarray, wanted: list[Wanted]) -> int:
    """Rows of the tree in order of falling scores (then keys) into all windows that they fall in, as long as any window needs some.
    to_vantage: scores of the vantage rows. usable: rows that count at all. Gives how many leaves were opened."""
    own = int((anchor * anchor).sum())
    whole = own + tree.most
    slack = SLACK * (whole + 1)
    # nodes: (-highest score, 0, node, nearest, farthest); rows: (-score, 1, key, row)
    heap: list[tuple] = [(-np.inf, 0, 0, 0.0, np.inf)] if tree.start else []
    opened = 0
    while heap:
        item = heapq.heappop(heap)
        floor = min(w.floor() for w in wanted)
        if -item[0] < floor:
            break
        if item[1]:  # no node that is left holds a better row
            for w in wanted:
                if w.low <= -item[0] <= w.high:
                    w.add((item[0], item[2], item[3]))
            continue
        node, near, far = item[2:]
        if tree.children[node] is None:
            opened += 1
            at = tree.order[tree.start[node] : tree.end[node]]
            at = at[usable[at]]
            score = products(anchor[None, :], tree.x[at])[0]
            there = np.zeros(len(at), bool)
            for w in wanted:
                there |= (score >= w.floor()) & (score <= w.high)
            for j in np.flatnonzero(there):
                heapq.heappush(heap, (-int(score[j]), 1, int(keys[at[j]]), int(rows[at[j]])))
            continue
        q = max(0.0, whole - 2 * to_vantage[node]) ** 0.5
        lo0, hi0, lo1, hi1 = tree.ranges[node]
        for child, lo, hi in zip(tree.children[node], (lo0, lo1), (hi0, hi1), strict=True):
            nearest, farthest = max(near, q - hi, lo - q), min(far, q + hi)
            highest, lowest = (whole - nearest * nearest) / 2 + slack, (whole - farthest * farthest) / 2 - slack
            if any(highest >= w.floor() and lowest <= w.high for w in wanted):
                heapq.heappush(heap, (-highest, 0, child, nearest, farthest))
    return opened


def _mine(anchors: pa.Table, same: bool, k: int):
    """A task's best rows: (number, slot, row, key, score). anchors: number, row, label, values and windows (lows, highs)."""
    number, own_row, label = (anchors.column(c).to_numpy() for c in ("number", "row", "label"))
    widths = pc.list_value_length(anchors.column("values")).to_numpy()
    lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
    by_width = {w: np.flatnonzero(widths == w) for w in sorted(set(widths.tolist()))}
    vectors = {w: matrix(anchors.column("values").take(pa.array(at)).combine_chunks(), w) if w else np.zeros((len(at), 0), np.int64) for w, at in by_width.items()}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(at, CHUNK))
                n += held[-1].num_rows
                if n >= CHUNK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [[Wanted(k, *w) for w in zip(a, b, strict=True)] for a, b in zip(lows, highs, strict=True)]
        for chunk in chunks(batches):
            chunk_widths = pc.list_value_length(chunk.column("values")).to_numpy()
            for width, at in by_width.items():
                there = np.flatnonzero(chunk_widths == width)
                if not len(there):
                    continue
                part = chunk.take(pa.array(there))
                x = matrix(part.column("values").combine_chunks(), width) if width else np.zeros((len(there), 0), np.int64)
                keys, rows, labels = pc.fill_null(part.column("key"), NO_KEY).to_numpy(), part.column("row").to_numpy(), part.column("label").to_numpy()
                tree = Tree(x)
                scores = products(vectors[width], x[[tree.vantage[i] for i in tree.inner]]) if tree.inner else np.zeros((len(at), 0), np.int64)
                for j, a in enumerate(at):
                    if wanted[a]:
                        usable = ((labels == label[a]) & (rows != own_row[a])) if same else labels != label[a]
                        walk(tree, vectors[width][j], dict(zip(tree.inner, scores[j].tolist(), strict=True)), usable, keys, rows, wanted[a])
        found = [(number[a], slot, row, key, -score) for a, slots in enumerate(wanted) for slot, w in enumerate(slots) for score, key, row in w.best]
        columns = list(zip(*found, strict=True)) or [()] * 5
        key = pa.array([None if v == NO_KEY else v for v in columns[3]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), key, pa.array(columns[4], pa.int64())], ["number", "slot", "row", "key", "score"])

    return run


FOUND = "number long, slot int, row long, key long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number", "slot").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (RESULT).

    anchor: a condition on df. An anchor's positives are the best other rows of its label; the negatives of both are the best rows of other
    labels with least_percent * positive_score <= 100 * negative_score <= 100 * positive_score. Higher scores first, ties by smaller key.
    """
    if min(positives, negatives, block) < 1:
        raise ValueError("positives, negatives and block are at least 1")
    spark, work = df.sparkSession, Workspace(df.sparkSession, "hard-negatives")
    chosen = df.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))
    numbered = integers(chosen.where("label IS NOT NULL"), ["key", "label", "anchor"], "vector", scale).withColumn("row", F.monotonically_increasing_id())
    rows = work.table(numbered, "rows")
    anchors = rows.where("anchor AND key IS NOT NULL")
    parts = -(-anchors.count() // block)
    if not parts:
        return spark.createDataFrame([], RESULT)
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    dealt = anchors.repartition(parts).withColumns({"part": F.shiftright(at, 33), "block": F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / block)})
    dealt = work.table(dealt.select("part", "block", "key", "row", "label", "values"), "anchors")
    results = None
    for b in dealt.select("part", "block").distinct().orderBy("part", "block").toLocalIterator():
        mine = dealt.where((F.col("part") == b["part"]) & (F.col("block") == b["block"])).select("key", "row", "label", "values").toArrow()
        # first the positives: one window without ends
        table = mine.append_column("number", mine.column("row")).append_column("lows", pa.array([[-np.inf]] * len(mine))).append_column("highs", pa.array([[np.inf]] * len(mine)))
        pairs = _best(rows.select("key", "row", "label", "values").mapInArrow(_mine(table, True, positives), FOUND), positives)
        pairs = pairs.select("number", F.col("rank").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")).toArrow()
        # then, for each anchor, a window a positive: block times positives rows at most
        by: dict[int, list] = {}
        for p in sorted(pairs.to_pylist(), key=lambda p: (p["number"], p["slot"])):
            by.setdefault(p["number"], []).append(p)
        of = mine.column("row").to_pylist()
        lows = [[-(-p["positive_score"] * least_percent // 100) for p in by.get(n, [])] for n in of]
        highs = [[p["positive_score"] for p in by.get(n, [])] for n in of]
        table = mine.append_column("number", mine.column("row")).append_column("lows", pa.array(lows, pa.list_(pa.int64()))).append_column("highs", pa.array(highs, pa.list_(pa.int64())))
        told = [(n, slot, k, p["positive_id"], p["positive_score"]) for n, k in zip(of, mine.column("key").to_pylist(), strict=True) for slot, p in enumerate(by.get(n, []))]
        if not told:
            continue
        about = spark.createDataFrame(told, "number long, slot int, anchor_id long, positive_id long, positive_score long")
        found = _best(rows.select("key", "row", "label", "values").mapInArrow(_mine(table, False, negatives), FOUND), negatives)
        out = found.join(F.broadcast(about), ["number", "slot"]).select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results = f"{work.root}/results"
        out.write.mode("append").parquet(results)
    return spark.read.schema(RESULT).parquet(results) if results else spark.createDataFrame([], RESULT)
