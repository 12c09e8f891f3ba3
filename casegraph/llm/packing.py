"""Best-fit packing of pieces into sequences of a fixed capacity.

How many pieces there are of each length decides the packing, so it is planned on those counts: at most as many numbers
as the capacity, however large the table. From the longest length down, a sequence's gap is looked up among the sums
of single lengths, pairs and triples that are still available, and as many sequences as the counts allow take such an
exactly filling combination. What is left goes best fit, longest first. The plan gives each length ranges of ranks
(slots); a piece finds its sequence and offset by its rank among the pieces of its length.

Edge cases: pieces of length 0 (or of null length) take no room: null sequence, offset 0. An empty table gives an empty plan. Equal lengths are ranked by key, so the result is repeatable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, in_batches
from .words import WORDS, library_encoder, release
from .workspace import Workspace

CAPACITY = 1024
#: Shorter pieces, and this share of the pieces of every length, fill no gap in pairs and triples: they stay for best fit.
SHORT, KEPT = 64, 0.5


@dataclass(frozen=True)
class Slot:
    """Pieces of this length with ranks from first to first + count - 1 go to sequences sequence, sequence + 1, ... at offset."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class _Sums:
    """Which sums the lengths that may fill gaps make: how many pairs of them make each sum, kept up as lengths run out."""

    def __init__(self, left: np.ndarray, short: int, kept: float):
        self.left, self.capacity = left, len(left) - 1
        self.least = np.ceil(kept * left).astype(np.int64)
        self.alive = left > self.least
        self.alive[:short] = False
        self.of_pairs = np.zeros(self.capacity + 1, np.int64)
        there = np.flatnonzero(self.alive)
        for x in there:
            at = x + there[(there <= x) & (there + x <= self.capacity)]
            self.of_pairs[at] += 1

    def free(self, x: int) -> int:
        return max(0, int(self.left[x] - self.least[x])) if self.alive[x] else 0

    def taken(self, x: int) -> None:
        """Takes a length that has run out from all sums."""
        if self.alive[x] and self.left[x] <= self.least[x]:
            there = np.flatnonzero(self.alive[: self.capacity - x + 1])
            self.of_pairs[there + x] -= 1
            self.alive[x] = False

    def pairs(self, total: int, most: int) -> list[tuple[int, int]]:
        """Pairs (a, b), most >= a >= b, that make total; largest a first."""
        if total < 2 or not self.of_pairs[total]:
            return []
        a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        a = a[self.alive[a] & self.alive[total - a]][::-1]
        return list(zip(a.tolist(), (total - a).tolist(), strict=True))

    def firsts(self, total: int, most: int) -> list[int]:
        """The largest members of triples that may make total, largest first."""
        a = np.flatnonzero(self.alive[: min(total - 1, most + 1)])
        a = a[3 * a >= total]
        return a[self.of_pairs[total - a] > 0][::-1].tolist()


def plan(counts: dict[int, int], capacity: int = CAPACITY, short: int = SHORT, kept: float = KEPT) -> list[Slot]:
    """counts: number of pieces of each length, 1 to capacity. Exact-complement filling, then best fit of what is left.

    From the longest length down, a sequence's gap is filled by a single length, else by a pair, else by a triple of the
    available ones, largest first, as often as the counts allow. Pairs and triples leave pieces under short alone, and the
    share kept of every other length: what fills a gap exactly now is missed by the residuals later.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    groups: list[tuple[tuple[int, ...], int]] = []  # (lengths in order, how many sequences)
    sums = _Sums(left, short, kept)

    def take(lengths: tuple[int, ...], n: int) -> None:
        groups.append((lengths, n))
        for x in lengths:
            left[x] -= n
        for x in set(lengths):
            sums.taken(x)

    def fill(longest: int, others: tuple[int, ...]) -> None:
        """As many sequences of longest and others as the counts allow."""
        lengths = (longest, *others)
        n = min(*(int(left[x]) // lengths.count(x) for x in set(lengths)), *(sums.free(x) // others.count(x) for x in set(others)))
        if n > 0:
            take(lengths, n)

    for longest in range(capacity, 0, -1):
        gap = capacity - longest
        if not gap and left[longest]:
            take((longest,), int(left[longest]))
        if 0 < gap <= longest and left[longest] and (n := min(int(left[longest]), int(left[gap])) if gap < longest else int(left[gap]) // 2):
            take((longest, gap), n)
        if left[longest]:
            for pair in sums.pairs(gap, longest):
                fill(longest, pair)
                if not left[longest]:
                    break
        if left[longest]:
            for first in sums.firsts(gap, longest):
                for pair in sums.pairs(gap - first, first):
                    fill(longest, (first, *pair))
                    if not left[longest]:
                        break
                if not left[longest]:
                    break
    # residuals, longest first, into the open sequence with the least sufficient gap
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity) if open_.get(g)), None)
            if gap is None:
                each = capacity // length
                full, last = divmod(n, each)
                for k, m in ((each, full), (last, 1)):
                    if k and m:
                        open_.setdefault(capacity - k * length, []).append(((length,) * k, m))
                n = 0
            else:
                lengths, m = open_[gap].pop()
                used = min(m, n)
                if m > used:
                    open_[gap].append((lengths, m - used))
                open_.setdefault(gap - length, []).append(((*lengths, length), used))
                n -= used
    groups += [g for found in open_.values() for g in found]
    slots, ranks, sequence = [], {}, 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            slots.append(Slot(x, ranks.get(x, 0), n, sequence, offset))
            ranks[x] = ranks.get(x, 0) + n
            offset += x
        sequence += n
    return slots


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (longs). keys make a piece unique; lengths are at most capacity.

    Ranks within a length are counted in two steps, by shard and within shards, so a length that most pieces have is
    not one task's. pieces is read twice: give a table.
    """
    spark = pieces.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumns({"_length": F.coalesce(F.col(length), F.lit(0)).cast("int"), "_shard": F.pmod(F.xxhash64(*keys), F.lit(shards))})
    sizes = dealt.groupBy("_length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity lengths a shard: both tables below are bounded by the capacity and the number of shards
    counts = {r["_length"]: r["n"] for r in sizes.groupBy("_length").agg(F.sum("_n").alias("n")).collect() if r["_length"] > 0}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    rows = [(s.length, s.first, s.count, s.sequence, s.offset) for s in plan(counts, capacity)]
    # pieces of length 0 fit anywhere: no sequence
    slots = spark.createDataFrame([*rows, (0, 0, 1 << 62, None, 0)], "_slot_length int, _first long, _count long, _sequence long, _offset long")
    before = Window.partitionBy("_length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_length", "_shard").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # the plan has a few slots a length (at least one count runs out with each): its size is bounded by the capacity
    hit = (F.col("_length") == F.col("_slot_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    return (
        ranked.join(F.broadcast(slots), hit)
        .withColumns({"sequence_id": F.col("_sequence") + F.col("_rank") - F.col("_first"), "offset": F.col("_offset")})
        .drop("_length", "_slot_length", "_shard", "_rank", "_before", "_first", "_count", "_sequence", "_offset")
    )


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of capacity but, if need be, a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, (first or capacity) if s == 0 else capacity)) for s in starts]


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column as they are needed: a batch as Python's strings takes several times its room."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int = WORDS) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids, array<int>) of every piece of every document; a null text is empty. A worker
    keeps the ids of kept_words words: fewer take more time and less memory."""
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = library_encoder(path, kept_words)
        for batch in batches:
            at = 0
            for texts in in_batches(_texts(batch.column(1)), 1_000_000):
                rows: list[list] = [[], [], [], [], [], []]
                for i, octets in enumerate(encoder.encode(texts), at):
                    octets += end
                    for k, (start, n) in enumerate(cut(len(octets) // 4, capacity)):
                        ids = octets[4 * start : 4 * (start + n)]
                        for column, value in zip(rows, (i, k, start, n, zlib.crc32(ids), np.frombuffer(ids, "<i4") if with_ids else None), strict=True):
                            column.append(value)
                at += len(texts)
                arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(rows[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}")


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int = WORDS) -> DataFrame:
    """token_pieces() with sequence_id and offset."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.table(token_pieces(docs, key, text, path, end_id, capacity, with_ids, kept_words), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], capacity=capacity)
