"""One text of each group of near copies: SimHash links first, an exact prefix join for what they leave, all verified.

Texts are linked if their sets of word shingles have a Jaccard index of the threshold or more, and every such pair is
found or lies within a component. Copies are one from the start. SimHashes of the shingles within the radius (BK-trees
over shards, see simhash) give the first links, each verified by the exact index; in large groups of near copies they
reach nearly all. At 0.8 the SimHashes of two texts are some ten bits apart, too far for shards. So texts of different
components that have one of their least shingles in common, as all pairs at the threshold have, are compared as well.

Edge cases: null and wordless texts are equal texts, and one of them stays; so does one of repeated rows. An empty table
gives an empty result. Columns of any name are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .workspace import Workspace

RADIUS = 4
#: Members of a shingle's group, or of a chunk of a larger one, that a task compares at once.
CHUNK = 2048
#: Groups of up to so many members are compared without counts by range in every row.
SMALL = 64
#: Partners that a text is paired with at a shingle in the first turn.
FEW = 4
#: Ranges of a text's counts of shingles. One in SAMPLE texts tells which shingles are frequent; at most FREQUENT are.
BINS, SAMPLE, FREQUENT = 256, 16, 100_000


def shingle_set(hashed: np.ndarray) -> np.ndarray:
    """Distinct hashes, ascending. Wordless texts have one of their own in common."""
    return np.unique(hashed) if len(hashed) else np.zeros(1, np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most: what Python holds of one is several times as large."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _least_common(a, b, threshold: float):
    """So many of a and of b shingles two texts have in common at least at that index (a float that is never too high)."""
    return threshold / (1 + threshold) * (a + b) - 1e-6


def _frequent(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(simhash.shingle_hashes(text.as_py(), words)).view(np.int64))], ["token"])

    return run


def _sketches(threshold: float, words: int, frequent: np.ndarray):
    """(n, id, key, text) -> n, id, key, code, size, the least shingles in the order of (frequent, hash), how many of these are rare, counts by BINS ranges.

    Of two sets at the threshold each has at least threshold * size shingles in common with the other, so the first of
    those is among the size - ceil(threshold * size) + 1 least ones of both, in whatever order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 256):
            codes, sizes, least, rare, bins = [], [], [], [], []
            for text in batch.column(3):
                hashed = simhash.shingle_hashes(text.as_py(), words)
                code = simhash.code_of(hashed)
                codes.append(code - (1 << 64) if code >> 63 else code)
                found = shingle_set(hashed)
                common = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found if len(frequent) else np.zeros(len(found), bool)
                sizes.append(len(found))
                keep = len(found) - math.ceil(threshold * len(found) - 1e-6) + 1
                least.append(np.concatenate((found[~common], found[common]))[:keep].view(np.int64))
                rare.append(min(keep, int((~common).sum())))
                bins.append(np.minimum(np.bincount((found & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in least])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(least)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(rare, pa.int32()), pa.array(bins, pa.binary())], ["n", "id", "key", "code", "size", "least", "rare", "bins"]
            )

    return run


def _can_reach(one: np.ndarray, two: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Counts by range: two sets have no more in common than the lesser counts' sum. A count of 255 stands for more."""
    lesser = np.minimum(one, two)
    return (lesser == 255).any(axis=1) | (lesser.sum(axis=1, dtype=np.int64) >= needed)


def _meeting(threshold: float, most: int | None):
    """Pairs of a shingle's few members that can reach the threshold and are not yet in one component; all groups of a batch at once. With
    most, each member only with so many that stand after it.

    At the first shingle that two texts have in common, all others that they have in common come after it in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            members = lists.flatten()
            n, size, left, component = (members.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            group = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            x = np.arange(len(n))
            for step in range(1, len(n) if most is None else min(len(n), most + 1)):
                x = x[x + step < len(n)]
                x = x[group[x] == group[x + step]]  # members of a group stand side by side
                if not len(x):
                    break
                y = x + step
                can = (component[x] != component[y]) & (np.minimum(left[x], left[y]) >= _least_common(size[x], size[y], threshold))
                a.append(np.minimum(n[x], n[y])[can])
                b.append(np.maximum(n[x], n[y])[can])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _crowd(threshold: float, most: int | None):
    """The same for the two chunks of a large group that each row holds; counts by range are looked at as well. With most, each member
    of the first chunk with so many of the second (others for each member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, second = (c.slice(i, 1).flatten() for c in batch.columns)
                (n, size, left, component), (m, sizes, lefts, parts) = ([x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)] for x in (first, second))
                mine, theirs = (np.frombuffer(b"".join(x.field(4).to_pylist()), np.uint8).reshape(-1, BINS) for x in (first, second))
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in range(len(n)):
                    needed = _least_common(sizes, size[x], threshold)
                    can = np.flatnonzero((parts != component[x]) & (np.minimum(lefts, left[x]) >= needed))
                    if len(can):
                        can = can[_can_reach(theirs[can], mine[x], needed[can])]
                    if most is not None and len(can) > most:
                        can = can[(np.searchsorted(can, x) + np.arange(most)) % len(can)]
                    a.append(np.minimum(m[can], n[x]))
                    b.append(np.maximum(m[can], n[x]))
                pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _can_meet(threshold: float):
    """Pairs whose counts by range allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1024):
            a, b, size_a, size_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
            can = _can_reach(one, two, _least_common(size_a.astype(np.int64), size_b, threshold))
            yield pa.RecordBatch.from_arrays([pa.array(a[can], pa.int64()), pa.array(b[can], pa.int64())], ["a", "b"])

    return run


def _verified(threshold: float, words: int):
    """Pairs of texts (a, b, text_a, text_b) at the threshold; texts are taken one by one, however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=8)(lambda text: shingle_set(simhash.shingle_hashes(text, words)))  # a text comes with many others in a row
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = of(batch.column(2)[i].as_py()), of(batch.column(3)[i].as_py())
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= threshold * (len(x) + len(y) - both):
                        keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int, work: Workspace) -> DataFrame:
    """Of pairs (a, b) those whose texts (n, text) are at the threshold."""
    ends = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    bodies = work.table(texts.join(ends, "n", "left_semi").groupBy("n").agg(F.min("text").alias("text")), "bodies")
    body = lambda end: bodies.select(F.col("n").alias(end), F.col("text").alias(f"text_{end}"))
    compared = pairs.join(body("b"), "b").join(body("a"), "a").select("a", "b", "text_a", "text_b")
    found = work.table(compared.mapInArrow(_verified(threshold, words), "a bigint, b bigint"), "verified")
    work.drop(bodies)
    return found


def simhash_pairs(sketches: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """Pairs (a, b) of texts that span every component of SimHashes (column code) within the radius."""
    heads = work.table(sketches.groupBy("code").agg(F.min("n").alias("head")), "heads")
    near = simhash.links(heads.select("code"), radius, work)
    same = sketches.select("code", "n").join(heads, "code").where("n <> head").select(F.col("head").alias("a"), F.col("n").alias("b"))
    head_of = lambda end: heads.select(F.col("code").alias(end), F.col("head").alias(f"head_{end}"))
    across = near.join(head_of("a"), "a").join(head_of("b"), "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    return work.table(same.union(across), "simhash-pairs")


def meeting_pairs(sketches: DataFrame, known: DataFrame, threshold: float, work: Workspace, chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """Pairs (a, b) that can reach the threshold and that known (node, component) does not put together; none is lost. With most,
    only so many a text and shingle: enough to join up large groups, before those that they leave apart are compared without it."""
    placed = sketches.select("n", "size", "least", "rare", "bins").join(known.withColumnRenamed("node", "n"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    place = (F.col("size") - F.col("place")).alias("left")
    rare = placed.select("n", "component", "size", F.posexplode(F.slice("least", F.lit(1), F.col("rare"))).alias("place", "token")).select("token", "n", "component", "size", place)
    often = placed.where("rare < size(least)").select("n", "component", "size", "bins", "rare", F.posexplode(F.slice("least", F.col("rare") + 1, F.size("least"))).alias("after", "token"))
    often = often.withColumn("place", F.col("rare") + F.col("after")).select("token", "n", "component", "size", place, "bins")
    # most rare shingles have one text; a count beside the rows tells so in one shuffle
    counted = rare.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("token")))
    shared = work.table(counted.where("members > 1"), "shared")
    member: Column = F.struct("n", "size", "left", "component")
    small = min(SMALL, chunk)
    few = shared.where(F.col("members") <= small).groupBy("token").agg(F.collect_list(member).alias("first"))
    many = shared.where(F.col("members") > small).join(sketches.select("n", "bins"), "n").select("token", "n", "component", "size", "left", "bins").union(often)
    crowds = simhash.rest_and_all(many, ["token"], F.struct("n", "size", "left", "component", "bins"), "n", chunk)
    met_few = few.select("first").mapInArrow(_meeting(threshold, most), "a bigint, b bigint").distinct()
    sketch = lambda end: sketches.select(F.col("n").alias(end), F.col("size").alias(f"size_{end}"), F.col("bins").alias(f"bins_{end}"))
    both = met_few.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "size_a", "size_b", "bins_a", "bins_b")
    likely = both.mapInArrow(_can_meet(threshold), "a bigint, b bigint").union(crowds.mapInArrow(_crowd(threshold, most), "a bigint, b bigint"))
    return work.table(likely.distinct(), "likely")


def _star(known: DataFrame) -> DataFrame:
    """The fewest links that make the same components."""
    return known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _some_of_each(pairs: DataFrame) -> DataFrame:
    """For each end of pairs at most four of its pairs."""
    ends = pairs.select(F.col("a").alias("n"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("n"), F.col("a").alias("other")))
    picks = [F.min_by("other", F.xxhash64("other", F.lit(i))).alias(f"p{i}") for i in range(4)]
    few = ends.groupBy("n").agg(*picks).select("n", F.explode(F.array(*[f"p{i}" for i in range(4)])).alias("other"))
    return few.select(F.least("n", "other").alias("a"), F.greatest("n", "other").alias("b")).distinct()


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """docs without copies and near copies: of each group the row of the least key (null keys last) stays, whole."""
    work = Workspace(docs.sparkSession, "near-texts")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.xxhash64(whole)
    texts = docs.select(number.alias("n"), whole.alias("text"))
    # frequent shingles come last in the order, so few texts meet at them; which are taken for frequent changes no result
    some = texts.where(F.pmod(F.xxhash64("n"), F.lit(SAMPLE)) == 0).select("text").distinct().mapInArrow(_frequent(words), "token bigint")
    tokens = some.groupBy("token").count().where("count > 3").orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toPandas()["token"]
    frequent = np.sort(tokens.to_numpy(np.int64).view(np.uint64))
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(number.alias("n"), F.md5(whole).alias("id"), F.col(f"`{key}`").alias("key"), whole.alias("text")).mapInArrow(
        _sketches(threshold, words, frequent), f"n bigint, id string, key {kind}, code bigint, size int, least array<bigint>, rare int, bins binary"
    )
    least_key = F.min(F.struct(F.col("key").isNull().alias("missing"), F.col("key").alias("key"))).alias("least_key")
    one = [F.first(c).alias(c) for c in ("id", "code", "size", "least", "rare", "bins")]
    sketches = work.table(made.groupBy("n").agg(least_key, *one), "sketches")
    linked = verified(simhash_pairs(sketches, radius, work), texts, threshold, words, work)
    known = components(linked, work)
    # most pairs that meet are links, and a few of each text join up a large group: then only texts that are still apart are paired
    few = meeting_pairs(sketches, known, threshold, work, chunk, most=FEW)
    known = components(_star(known).union(verified(_some_of_each(few), texts, threshold, words, work)), work)
    found = verified(meeting_pairs(sketches, known, threshold, work, chunk), texts, threshold, words, work)
    classes = components(_star(known).union(found), work).withColumnRenamed("node", "n")
    named = sketches.select("n", "id", "least_key").join(classes, "n", "left").withColumn("component", F.coalesce("component", "n"))
    stay = named.groupBy("component").agg(F.min_by("id", F.struct("least_key", "id")).alias("id")).select("id")
    # of a text's copies the first row stays: whole rows are compared, before the shuffle and after it
    mine = [c for c in docs.columns]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(mine)])
    order = F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").alias("k"))
    kept = docs.select(F.md5(whole).alias("id"), row.alias("row"), order.alias("order")).join(stay, "id", "left_semi").groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(mine)])
