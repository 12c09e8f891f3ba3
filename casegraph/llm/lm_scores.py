"""Stupid-backoff scores of documents under n-gram counts of the whole corpus, relationally.

1. Documents are read into blocks of some megabytes. A block is a row: its documents as numbers of words in the block's
   own word list (compressed), so texts are read once and never shuffled. Blocks are bucketed by their id, and so is all
   that is learnt of them: the joins below move no block.
2. Order by order, each block's distinct n-grams (64-bit hashes) with their counts are exploded into rows by range of
   hash, sorted and compressed. Partitioned by that range they make the order's count table; each row is answered with the
   corpus counts of its n-grams. An n-gram comes once a block, however frequent it is, so no range is hot. An n-gram that
   begins or ends with a shorter one found once in the corpus is found once itself, so it is not sent: its count without
   its own document is 0. This leaves out nothing that a score needs. An order's answers are written before the next is
   begun, so its shuffle can be freed.
3. Answers are joined to their blocks, and every document's scores are summed there.

A document is scored by what the others say: its own n-grams are subtracted from all counts. For a word w after a
context v of order - 1 words (fewer at a document's start) the score is count(v w) / count(v) if count(v w) > 0, else
ALPHA times the score after v without its first word; without context it is count(w) / N, or (a word found nowhere else)
1 / N, with N the other documents' words, at least 1.

Words are runs without white space, A-Z lowered. Edge cases: a null or wordless text has 0 words and score 0. Copies of
a text count for one another. An empty table gives an empty result. Null keys are kept.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_batches
from .workspace import Workspace

ALPHA = 0.4
#: Characters of a block's texts, about; what a task holds of a block is some ten times as much.
BLOCK_CHARS = 4_000_000
#: Words of the corpus for each range of hashes: about so many n-grams of an order come together in a task (8 bytes each).
RANGE_WORDS = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant: products with it spread over all 64 bits


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two words' hashes, in order."""
    x = (first * _MIX) ^ (second + np.uint64(0x632BE59BD9B4E019) + (first << np.uint64(6)))
    x ^= x >> np.uint64(31)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _press(values: np.ndarray) -> bytes:
    """Ascending uint64 as compressed differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpress(raw: bytes) -> np.ndarray:
    octets = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(octets.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Counts, compressed by byte planes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _counts(raw: bytes) -> np.ndarray:
    octets = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(octets.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class _Level:
    """N-grams of one order in a block: the places where one ends that may come elsewhere too, the distinct hashes
    (ascending), each place's number among them, and how often each comes in the block."""

    def __init__(self, ends: np.ndarray, distinct: np.ndarray, place: np.ndarray, counts: np.ndarray):
        self.ends, self.distinct, self.place, self.counts = ends, distinct, place, counts


class _Block:
    """Words of documents as numbers in the list of the block's words (hashes, ascending)."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray, lengths: np.ndarray):
        self.words, self.numbers, self.lengths = words, numbers, lengths
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.within = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def first(self) -> _Level:
        return _Level(np.arange(len(self.numbers)), self.words, self.numbers, np.bincount(self.numbers, minlength=len(self.words)))

    def longer(self, n: int, level: _Level, total: np.ndarray) -> _Level:
        """N-grams of order n from those of the order below and their corpus counts, where both that it contains come again."""
        hashed, again = np.zeros(len(self.numbers), np.uint64), np.zeros(len(self.numbers), bool)
        hashed[level.ends] = level.distinct[level.place]
        again[level.ends] = total[level.place] > 1
        ends = np.flatnonzero(again[1:] & again[:-1] & (self.within[1:] >= n - 1)) + 1
        return _Level(ends, *np.unique(_pair(hashed[ends - 1], self.words[self.numbers[ends]]), return_inverse=True, return_counts=True))

    @classmethod
    def of_texts(cls, texts: list[str]) -> _Block:
        split = [t.encode().lower().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        known: dict[bytes, int] = {}
        numbers = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(lengths.sum()))
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        words, place = np.unique(hashed, return_inverse=True)
        return cls(words, place[numbers].astype(np.int64) if len(numbers) else numbers, lengths)

    def bytes(self) -> bytes:
        return zlib.compress(self.numbers.astype("<u4").tobytes(), 1)


def _own(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each occurrence of an n-gram (its number in the block), how often its document has it."""
    _, at, sizes = np.unique(doc * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
    return sizes[at]


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, order: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key, n_words, log_score (natural logarithms summed over the text's words), n_backed_off."""
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    kind = docs.schema[key].dataType.simpleString()

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_batches(batch.column(1).to_pylist(), block_chars):
                b = _Block.of_texts(texts)
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), keys), pa.array([b.lengths.tolist()], pa.list_(pa.int64())), pa.array([_press(b.words)], pa.binary()), pa.array([b.bytes()], pa.binary())],
                    ["block", "keys", "lengths", "words", "numbers"],
                )

    def load(row: dict, known: int) -> tuple[_Block, list[_Level], list[np.ndarray]]:
        """A block, its n-grams of orders up to known + 1 (at most order), and the corpus counts of those up to known."""
        b = _Block(_unpress(row["words"]), np.frombuffer(zlib.decompress(row["numbers"]), "<u4").astype(np.int64), np.array(row["lengths"], np.int64))
        levels, totals = [b.first()], []
        for n in range(1, known + 1):
            others = [_counts(a["totals"]) for a in sorted(row[f"found_{n}"] or [], key=lambda a: a["part"])]
            totals.append(np.concatenate([np.zeros(0, np.int64), *others]) + levels[-1].counts)
            if n < order:
                levels.append(b.longer(n + 1, levels[-1], totals[-1]))
        return b, levels, totals

    def exploded(n: int):
        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts_at = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    level = load(row, n - 1)[1][n - 1]
                    columns: list[list] = [[], [], [], []]
                    cuts = [0, *np.searchsorted(level.distinct, cuts_at).tolist(), len(level.distinct)]
                    for part, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a < z:
                            for column, value in zip(columns, (row["block"], part, _press(level.distinct[a:z]), _small(level.counts[a:z])), strict=True):
                                column.append(value)
                    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", "grams", "counts"])

        return explode

    def answer(key_row: tuple, table: pa.Table) -> pa.Table:
        """All rows of a range: the corpus counts of each row's n-grams."""
        asked = [_unpress(x) for x in table.column("grams").to_pylist()]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([_counts(x) for x in table.column("counts").to_pylist()]), minlength=len(distinct)).astype(np.int64)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        # what a block has not counted itself: mostly nothing, which takes next to no room
        found = [_small(total[p] - _counts(own)) for p, own in zip(np.split(place, cuts), table.column("counts").to_pylist(), strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(found, pa.binary())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, levels, totals = load(batch.slice(i, 1).to_pylist()[0], order)
                n = len(b.lengths)
                others = np.maximum(total_words - b.lengths, 1)[b.doc].astype(float)
                context = totals[0][b.numbers] - _own(b.doc, b.numbers)
                value, backed = np.log(np.maximum(context, 1) / others), np.zeros(len(b.numbers), np.int64)
                for size, (level, total) in enumerate(zip(levels[1:], totals[1:], strict=True), 2):
                    both = np.zeros(len(b.numbers), np.int64)
                    both[level.ends] = total[level.place] - _own(b.doc[level.ends], level.place)
                    ends = np.flatnonzero(b.within >= size - 1)
                    hit = both[ends] > 0
                    value[ends] = np.where(hit, np.log(np.maximum(both[ends], 1) / np.maximum(context[ends - 1], 1)), np.log(alpha) + value[ends])
                    backed[ends] = ~hit
                    context = both
                sums = np.bincount(b.doc, weights=value, minlength=n)
                backs = np.bincount(b.doc, weights=backed, minlength=n).astype(np.int64)
                keys = batch.column(batch.schema.get_field_index("keys")).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([keys, pa.array(b.lengths, pa.int64()), pa.array(sums, pa.float64()), pa.array(backs, pa.int64())], [key, "n_words", "log_score", "n_backed_off"])

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = docs.select(key, text).mapInArrow(to_blocks, f"block string, keys array<{kind}>, lengths array<bigint>, words binary, numbers binary")
    blocks = work.bucketed(made, "blocks", "block", buckets)
    total_words = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    # a range holds a bounded number of n-grams (copies aside, total_words of each order), so their number grows with the corpus
    ranges = max(2, buckets, math.ceil(total_words / RANGE_WORDS))
    for n in range(1, order + 1):
        rows = blocks.drop("keys").mapInArrow(exploded(n), "block string, part int, grams binary, counts binary")
        answers = rows.groupBy("part").applyInArrow(answer, "block string, part int, totals binary")
        by_block = answers.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias(f"found_{n}"))
        blocks = blocks.join(work.bucketed(by_block, f"found_{n}", "block", buckets), "block", "left")
    return blocks.mapInArrow(score, f"`{key}` {kind}, n_words bigint, log_score double, n_backed_off bigint")
