"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another.

1. Texts are read into blocks (rows of compressed texts). In each block every window of LENGTH bytes chooses an anchor:
   the GRAM bytes of least hash in it (the rightmost of equal ones). That depends on the window's bytes alone, so equal
   windows have equal anchors at equal places. Consecutive windows with one anchor make a segment.
2. Blocks ask, by range of the anchor's hash, how often each of their distinct segments (128-bit hash) and anchors come.
   A segment whose anchor comes once in all texts has nothing equal; one that comes twice has equal windows throughout.
   The others share an anchor with different segments and go on to the index, one copy of each.
3. The index is built in tasks by anchor. The suffixes that start at anchors are kept in sorted arrays (suffix arrays
   of sampled suffixes): each new batch is sorted, merge-scanned against every level for suffixes that share enough
   bytes, and put in as a level of its own; levels of equal size are merged, so there are logarithmically many.
   Where two suffixes share r bytes from the anchor and l bytes before it, all windows in that stretch are equal.
4. An anchor with more than CROWD different segments (a passage a little shorter than LENGTH within many texts) would
   make pairs without end; its windows are counted by 128-bit hash instead, in the way of step 2, which is exact too.
5. Blocks take the answers and cut their texts.

Edge cases: a null text counts as empty. A text shorter than LENGTH keeps all its bytes. Equal texts of LENGTH bytes or
more lose all of them. Kept text is what remains of the bytes; a character that a cut leaves in part is dropped from the
text, not from the digest. Null keys, other columns of any name and repeated rows are carried along. An empty table
gives an empty result. A text larger than BLOCK_CHARS is a block alone, held by one task.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_batches
from .workspace import Workspace

LENGTH = 200
GRAM = 64
CROWD = 64
BLOCK_CHARS = 500_000
#: Segments that make a batch of the index.
BATCH = 512

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: What becomes of a distinct segment.
LONE, TWICE, INDEX, INDEX_TWICE, CROWDED, CROWDED_TWICE = range(6)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Block:
    """Bytes of some texts in a row, their segments, and the distinct ones among these in order of (g, s)."""

    def __init__(self, octets: bytes, lengths: list[int], length: int = LENGTH, gram: int = GRAM):
        self.octets, self.lengths, self.length = octets, np.array(lengths, np.int64), length
        self.text = np.frombuffer(octets, np.uint8)
        n = len(octets)
        self.ends = np.cumsum(self.lengths)
        none = np.zeros(0, np.int64)
        self.p0 = self.p1 = self.q = none
        if n >= length:
            self.up, down = (x[: n + 1] for x in _powers(1 << max(20, (n + 1).bit_length())))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_letters()[self.text] * down[:n], dtype=np.uint64, out=self.sums[1:])
            self._cut(n, gram)
        # anchors have the least hashes of their windows: mixed anew, they spread over all ranges
        g = _mix(self._hash(self.q, gram) + _U(_BASE)) if len(self.q) else np.zeros(0, np.uint64)
        s = _mix(self._hash(self.p0, self.p1 + length - self.p0) + (self.q - self.p0).astype(np.uint64) * _U(_BASE)) if len(self.q) else g
        order = np.lexsort((s, g))
        g, s = g[order], s[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))) if len(g) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.g, self.s, self.one = g[first], s[first], order[first]  # one: a segment of each distinct kind
        self.count = np.diff(np.append(first, len(g)))
        self.kind = np.empty(len(g), np.int64)  # of each segment
        self.kind[order] = np.cumsum(new) - 1

    def _hash(self, at: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.up[at])

    def _cut(self, n: int, gram: int) -> None:
        starts = np.arange(n - gram + 1)
        span, wide = self.length - gram + 1, 1
        least = (self._hash(starts, gram) & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - starts.astype(np.uint64))
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        rest = span - wide
        least = np.minimum(least[: len(least) - rest], least[rest:])
        valid = np.ones(len(least), bool)
        for end in self.ends.tolist():  # windows that reach over a text's end
            valid[max(0, end - self.length + 1) : end] = False
        at = np.flatnonzero(valid)
        if not len(at):
            return
        anchor = (_U(0xFFFFFFFF) - (least[at] & _U(0xFFFFFFFF))).astype(np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.p0, self.p1, self.q = at[first], at[last], anchor[first]

    def crowded(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts of one segment of each crowded kind that this block supplies, with both hashes."""
        chosen = self.one[(status == CROWDED) | (status == CROWDED_TWICE)]
        runs = (self.p1 - self.p0 + 1)[chosen]
        at = np.repeat(self.p0[chosen], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        half = self.length // 2
        a, b = self._hash(at, half), self._hash(at + half, self.length - half)
        return at, _mix(a + b * _U(_BASE)), _mix(b ^ (a * _U(0xD6E8FEB86659FD93)))


def _unique(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, their summed weights, and the place of each given pair among them."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(place, weights=weight, minlength=int(new.sum())).astype(np.int64), place


def _asks(block: str, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple]:
    """(block, part, a, b, n) for each range of a, which ascends."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = [0, *np.searchsorted(a, edges).tolist(), len(a)]
    for part, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if x < y:
            yield block, part, a[x:y].tobytes(), b[x:y].tobytes(), np.minimum(n[x:y], 0xFFFF).astype("<u2").tobytes()


_ASK = "block string, part int, a binary, b binary, n binary"
_ASK_KINDS = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER = "block string, part int, found binary"


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    a, b, n = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("a", "<u8"), ("b", "<u8"), ("n", "<u2")))
    return a, b, n, np.cumsum([len(x) // 2 for x in table.column("n").to_pylist()]).tolist()


def _reply(table: pa.Table, found: np.ndarray, ends: list[int]) -> pa.Table:
    found = found.astype(np.uint8)
    parts = [found[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "found": pa.array(parts, pa.binary())})


def _segments_answer(crowd: int):
    def answer(table: pa.Table) -> pa.Table:
        a, b, n, ends = _gathered(table)
        g, _, total, place = _unique(a, b, n)
        new = np.concatenate(([True], g[1:] != g[:-1]))
        group = np.cumsum(new) - 1
        different = np.bincount(group)[group]
        status = np.select([different > crowd, different > 1], [CROWDED, INDEX], LONE) + (total > 1)
        found = status[place]
        supplier = np.zeros(len(place), bool)  # one block gives the bytes of a segment
        supplier[np.unique(place, return_index=True)[1]] = True
        found = np.where((found >= INDEX) & ~supplier, TWICE, found)
        return _reply(table, found, ends)

    return answer


def _windows_answer(table: pa.Table) -> pa.Table:
    a, b, n, ends = _gathered(table)
    _, _, total, place = _unique(a, b, n)
    return _reply(table, total[place] > 1, ends)


class Levels:
    """A family of sorted arrays of suffixes that doubles in size from level to level."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[list[bytes], list[int]]] = []  # (suffixes, segments), sorted by suffix
        self.right: list[bytes] = []
        self.left: list[bytes] = []
        self.equal: list[list[tuple[int, int]]] = []

    def add(self, segments: list[tuple[bytes, bytes]]) -> None:
        """segments: (bytes before the anchor, bytes from it on)."""
        first = len(self.right)
        self.left += [s[0] for s in segments]
        self.right += [s[1] for s in segments]
        self.equal += [[] for _ in segments]
        order = sorted(range(first, len(self.right)), key=self.right.__getitem__)
        new = ([self.right[i] for i in order], order)
        for level in self.levels:
            self._scan(new, level, False)
        self._scan(new, new, True)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            a, b = self.levels.pop(), self.levels.pop()
            merged = sorted(b[1] + a[1], key=self.right.__getitem__)  # two sorted runs: a merge
            self.levels.append(([self.right[i] for i in merged], merged))

    def _scan(self, new: tuple[list[bytes], list[int]], level: tuple[list[bytes], list[int]], itself: bool) -> None:
        suffixes, members = level
        start = 0
        for at, (suffix, x) in enumerate(zip(*new, strict=True)):
            least = self.length - len(self.left[x])  # fewer equal bytes from the anchor on can't make a window
            prefix = suffix[:least]
            if itself:
                j = at + 1
            else:
                start = bisect_left(suffixes, prefix, start if start and suffixes[start - 1] < prefix else 0)
                j = start
            while j < len(suffixes) and suffixes[j].startswith(prefix):
                self._compare(x, members[j])
                j += 1
            if itself:
                # a longer need than a neighbour's: what sorts before x may share enough as well
                j = at - 1
                while j >= 0 and suffixes[j].startswith(prefix):
                    if self.length - len(self.left[members[j]]) > least:
                        self._compare(x, members[j])
                    j -= 1

    def _compare(self, x: int, y: int) -> None:
        l, r = _common(self.left[x][::-1], self.left[y][::-1]), _common(self.right[x], self.right[y])
        if l + r >= self.length:
            self.equal[x].append((self.length - r, l))
            self.equal[y].append((self.length - r, l))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


def cut(docs: DataFrame, text: str = "text", length: int = LENGTH, digests_only: bool = False, gram: int = GRAM, crowd: int = CROWD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of docs but text, then n_bytes, n_removed, n_spans, kept_sha256 and, unless digests_only, text as kept."""
    spark = docs.sparkSession
    work = Workspace(spark, "suffixes")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(None).cast("int").alias("c0"))
    source = docs.select(rest.alias("rest"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["rest"].dataType.simpleString()

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            at = 0
            for texts in in_batches(batch.column(1).to_pylist(), block_chars):
                octets = [t.encode() for t in texts]
                rows = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows), pa.array([list(map(len, octets))], pa.list_(pa.int64())), pa.array([press.compress(b"".join(octets))], pa.binary())],
                    ["block", "rests", "lengths", "octets"],
                )

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, Block]]:
        for i in range(batch.num_rows):
            row = batch.select([c for c in batch.schema.names if c != "rests"]).slice(i, 1).to_pylist()[0]
            yield i, row, Block(zstandard.ZstdDecompressor().decompress(row["octets"]) if sum(row["lengths"]) else b"", row["lengths"], length, gram)

    def status_of(row: dict) -> np.ndarray:
        found = sorted(row["status"], key=lambda x: x["part"])
        return np.frombuffer(b"".join(x["found"] for x in found), np.uint8)

    def ask_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, b in rows_of(batch):
                columns = list(zip(*_asks(row["block"], b.g, b.s, b.count, parts), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ASK_KINDS, strict=True)], ["block", "part", "a", "b", "n"])

    def supply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "g", "s", "lone", "before", "after"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            for _, row, b in rows_of(batch):
                status = status_of(row)
                chosen = np.flatnonzero((status == INDEX) | (status == INDEX_TWICE))
                at = b.one[chosen]
                q = b.q[at].tolist()
                before = [b.octets[x:y] for x, y in zip(b.p0[at].tolist(), q, strict=True)]
                after = [b.octets[x:y] for x, y in zip(q, (b.p1[at] + length).tolist(), strict=True)]
                values = [[row["block"]] * len(q), b.g[chosen].view(np.int64), b.s[chosen].view(np.int64), status[chosen] == INDEX, before, after]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, b in rows_of(batch):
                status = status_of(row)
                _, h1, h2 = b.crowded(status)
                chosen = (status == CROWDED) | (status == CROWDED_TWICE)
                weight = np.repeat(np.where(status[chosen] == CROWDED, 1, 2), (b.p1 - b.p0 + 1)[b.one[chosen]])
                a, c, n, _ = _unique(h1, h2, weight)
                columns = list(zip(*_asks(row["block"], a, c, n, parts), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _ASK_KINDS, strict=True)], ["block", "part", "a", "b", "n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's segments, batch by batch. What equals later ones is known at the end."""
        levels, names = Levels(length), []
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), BATCH):
                levels.add([(r["before"], r["after"]) for r in rows[i : i + BATCH]])
                names += [(r["block"], r["g"], r["s"], r["lone"]) for r in rows[i : i + BATCH]]
        found = [(*n[:3], sorted(set(e))) for n, e in zip(names, levels.equal, strict=True) if n[3] and e]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        values = [[x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [[y[0] for y in x[3]] for x in found], [[y[1] for y in x[3]] for x in found]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "g", "s", "low", "high"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row, b in rows_of(batch):
                n = len(b.octets)
                equal = np.zeros(n + 1, bool)  # of each window start
                status = status_of(row)
                step = np.zeros(n + 1, np.int64)
                of_segment = status[b.kind] if len(b.kind) else np.zeros(0, np.uint8)
                whole = np.isin(of_segment, (TWICE, INDEX_TWICE, CROWDED_TWICE))
                np.add.at(step, b.p0[whole], 1)
                np.add.at(step, b.p1[whole] + 1, -1)
                equal |= np.cumsum(step) > 0
                places = {(int(g), int(s)): k for k, (g, s) in enumerate(zip(b.g.view(np.int64), b.s.view(np.int64), strict=True)) if status[k] == INDEX} if row["shared"] else {}
                for x in row["shared"]:
                    q = int(b.q[b.one[places[x["g"], x["s"]]]])
                    for low, high in zip(x["low"], x["high"], strict=True):
                        equal[q - high : q - low + 1] = True
                at, h1, h2 = b.crowded(status)
                if len(at):
                    _, _, _, place = _unique(h1, h2, np.ones(len(at)))
                    found = np.frombuffer(b"".join(x["found"] for x in sorted(row["windows"], key=lambda x: x["part"])), np.uint8)
                    equal[at[found[place] > 0]] = True
                ahead = np.cumsum(equal)
                gone = ahead[:n].copy()
                gone[length:] -= ahead[: n - length] if n > length else 0
                gone = gone > 0
                keys = batch.column(batch.schema.get_field_index("rests")).slice(i, 1).flatten()
                starts = b.ends - b.lengths
                sizes, spans, digests, kept = [], [], [], []
                for x, y in zip(starts.tolist(), b.ends.tolist(), strict=True):
                    g = gone[x:y]
                    sizes.append(int(g.sum()))
                    spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                    left = b.text[x:y][~g].tobytes() if sizes[-1] else b.octets[x:y]
                    digests.append(hashlib.sha256(left).hexdigest())
                    if not digests_only:
                        kept.append(left.decode("utf-8", "ignore"))
                arrays = [keys, pa.array(b.lengths, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *([] if digests_only else [pa.array(kept, pa.string())])], ["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digests_only else ["text"])])

    blocks = work.table(source.mapInArrow(to_blocks, f"block string, rests array<{kind}>, lengths array<bigint>, octets binary"), "blocks")
    thin = blocks.select("block", "lengths", "octets")

    def by_block(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias(name))

    def filled(df: DataFrame, name: str, of: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(F.col(name), F.array().cast(of)))

    found = "array<struct<part:int,found:binary>>"
    answer = _segments_answer(crowd)
    statuses = work.table(by_block(thin.mapInArrow(ask_segments, _ASK).groupBy("part").applyInArrow(lambda t: answer(t), _ANSWER), "status"), "statuses")
    known = filled(thin.join(statuses, "block", "left"), "status", found)
    supplied = known.mapInArrow(supply, "block string, g bigint, s bigint, lone boolean, before binary, after binary")
    pairs = supplied.repartition("g").mapInArrow(index, "block string, g bigint, s bigint, low array<int>, high array<int>")
    shared = work.table(pairs.groupBy("block").agg(F.collect_list(F.struct("g", "s", "low", "high")).alias("shared")), "shared")
    windows = work.table(by_block(known.mapInArrow(ask_windows, _ASK).groupBy("part").applyInArrow(lambda t: _windows_answer(t), _ANSWER), "windows"), "windows")
    whole = blocks.join(statuses.join(shared, "block", "full").join(windows, "block", "full"), "block", "left")
    whole = filled(filled(filled(whole, "status", found), "windows", found), "shared", "array<struct<g:bigint,s:bigint,low:array<int>,high:array<int>>>")
    last = "" if digests_only else ", text string"
    out = whole.select("rests", "lengths", "octets", "status", "shared", "windows").mapInArrow(finish, f"rest {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{last}")
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)], "n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digests_only else [F.col("text").alias(text)]))
