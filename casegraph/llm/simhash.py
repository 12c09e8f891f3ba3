"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over shards of them, components of the links.

Two fingerprints within the radius differ in few bits, so of radius + k blocks of bits they agree in at least k: every
choice of k blocks is a sharding, and a shard holds the fingerprints that agree in those blocks. A BK-tree over a shard
(children keyed by their Hamming distance to the parent) is searched along the edges that the radius allows. A tree for
all fingerprints would have to be broadcast whole and prunes little at random distances; shards go to tasks by a
shuffle. k grows with the number of fingerprints, so that unrelated ones seldom meet. A shard gives a spanning forest
of its links, not all of them: components are the same.

A shard of more than SHARD members waits until the small ones have been joined up. Most of its members are then of one
component and need no comparison among themselves; the rest are compared with all, in chunks.

Only distinct fingerprints are compared; copies join their fingerprint's component at the end.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, and is linked like any other; a
null key keeps its row, and a component is named after its least key that is not null (null if all are). Repeated rows
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace

SEED = 42
#: Members of a shard, or of a chunk of a larger one, that one tree holds.
SHARD = 1024


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's word shingles (A-Z lowered), repeats included; a shorter text is one shingle, one without words has none."""
    found = (text or "").encode().lower().split()  # of bytes: only A-Z are lowered, only ASCII white space splits
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def code_of(hashed: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        octets = hashed[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    return code_of(shingle_hashes(text, words))


def simhash(text: Column, words: int = 4) -> Column:
    """fingerprint() as a column of signed longs."""

    @F.pandas_udf("bigint")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of_texts(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, code: int) -> None:
        if self.root is None:
            self.root = (code, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ code).bit_count()
            if not distance:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (code, {})
                return
            node = child

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Codes at most radius bits away. By the triangle inequality only edges from d - radius to d + radius lead to any."""
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            distance = (at ^ code).bit_count()
            if distance <= radius:
                yield at
            if children:
                low, high = distance - radius, distance + radius
                stack += [child for edge, child in children.items() if low <= edge <= high]


def forest(codes: Iterable[int], others: Iterable[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius: among codes, or between codes and others; no link that closes a ring."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # members in ascending order, links from the lesser end: shards with the same members give the same links
    tree, links = BKTree(), []
    for code in sorted(codes) if others is not None else ():
        tree.add(code)
    for code in sorted(codes if others is None else others):
        for near in sorted(tree.within(code, radius)):
            a, b = top(near), top(code)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((min(near, code), max(near, code)))
        if others is None:
            tree.add(code)
    return links


def _linked(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    unsigned = lambda xs: [x & 0xFFFFFFFFFFFFFFFF for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for one, two in zip(*batch.columns, strict=True):  # a group at a time: as Python's numbers codes take five times the room
                codes, others = one.as_py(), two.as_py()
                for x, y in forest(unsigned(codes), None if others is None else unsigned(others), radius):
                    a.append(signed(x))
                    b.append(signed(y))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def shard_keys(code: Column, radius: int, agree: int) -> Column:
    """For each choice of agree out of radius + agree blocks of bits: the choice's number and those blocks, as one string."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:], strict=False)]
    width = [high - low for low, high in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), agree)):
        value = F.lit(number).cast("long")
        for i in chosen:
            value = F.shiftleft(value, width[i]).bitwiseOR(block[i])
        keys.append(value)
    return F.array(*keys)


def agreeing(n: int, radius: int) -> int:
    """How many blocks the members of a shard agree in: so many that of n unrelated codes one in 32 meets another by chance in a shard."""
    return next((k for k in (2, 3, 4, 5) if n <= 1 << (64 * k // (radius + k) - 5)), 6)


def rest_and_all(rows: DataFrame, keys: list[str], member: Column, spread: str, chunk: int) -> DataFrame:
    """Groups (by keys) of rows with a column "component": first, second, so that every pair of different components is in a row.

    Members of a group's largest component stand in second only; the rest stand in first and in second. Both are dealt
    in chunks, so what a row holds is bounded, and a group of one component gives no row.
    """
    each = rows.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    size = each.groupBy(*keys).agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    placed = rows.join(size.where("members > most"), keys)
    all_chunks, rest_chunks = F.ceil(F.col("members") / chunk).cast("int"), F.ceil((F.col("members") - F.col("most")) / chunk).cast("int")
    own = lambda chunks: F.pmod(F.xxhash64(spread), chunks).cast("int")
    seconds = placed.select(*keys, F.explode(F.sequence(F.lit(0), rest_chunks - 1)).alias("i"), own(all_chunks).alias("j"), F.lit(None).alias("first"), member.alias("second"))
    firsts = placed.where("component <> largest").select(*keys, own(rest_chunks).alias("i"), F.explode(F.sequence(F.lit(0), all_chunks - 1)).alias("j"), member.alias("first"), F.lit(None).alias("second"))
    return seconds.union(firsts).groupBy(*keys, "i", "j").agg(F.collect_list("first").alias("first"), F.collect_list("second").alias("second")).select("first", "second")


def links(codes: DataFrame, radius: int, work: Workspace, shard: int = SHARD) -> DataFrame:
    """codes: distinct rows of code (long). Links (a, b) within the radius that span every component."""
    rows = codes.select(F.explode(shard_keys(F.col("code"), radius, agreeing(codes.count(), radius))).alias("key"), "code")
    # most shards of unrelated codes have one member; those of two need no join back to their members
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("code").alias("low"), F.max("code").alias("high"))
    sizes = work.table(counted.where("members > 1"), "sizes")
    none = F.lit(None).cast("array<bigint>")
    near = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius
    pairs = sizes.where((F.col("members") == 2) & near).select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b"))
    shared = work.table(rows.join(sizes.where("members > 2").select("key", "members"), "key"), "shards")
    small = shared.where(F.col("members") <= shard).groupBy("key").agg(F.collect_list("code").alias("codes")).select("codes", none.alias("others"))
    found = lambda groups: groups.repartition(F.xxhash64("codes", "others")).mapInArrow(_linked(radius), "a bigint, b bigint")
    near = work.table(pairs.union(found(small)).distinct(), "near")
    large = shared.where(F.col("members") > shard)
    if large.isEmpty():
        return near
    known = components(near, work).withColumnRenamed("node", "code")
    placed = large.select("key", "code").join(known, "code", "left").withColumn("component", F.coalesce("component", "code"))
    groups = rest_and_all(placed, ["key"], F.col("code"), "code", shard).select(F.col("first").alias("codes"), F.col("second").alias("others"))
    return near.union(work.table(found(groups).distinct(), "near"))


def classes(coded: DataFrame, radius: int, work: Workspace) -> DataFrame:
    """coded has columns "code" and "key" (repeats allowed); gives code, component_id (the least key of its component), a row a distinct code."""
    codes = work.table(coded.groupBy("code").agg(F.min("key").alias("least")), "codes")
    joined = components(links(codes.select("code"), radius, work), work)
    named = codes.join(joined.withColumnRenamed("node", "code"), "code", "left").select("code", "least", F.coalesce("component", "code").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(heads, "component").select("code", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """key, code (the fingerprint, a signed long), component_id (the least key of the component)."""
    work = Workspace(docs.sparkSession, "simhash")
    coded = work.table(docs.select(F.col(key).alias("key"), simhash(F.col(text), words).alias("code")), "coded")
    return coded.join(classes(coded, radius, work), "code").select(F.col("key").alias(key), "code", "component_id")
