"""Near-duplicate paragraphs by MinHash bands, exact Jaccard and components; equal passages anywhere in the text.

A paragraph is a line of at least LEAST words; its shingles are the sets of its five-word runs (A-Z lowered, white space
folded). Equal paragraphs are one from the start. Bands of MinHash values are tuned so that a pair at the threshold
collides with at least RECALL; colliding paragraphs are compared by exact Jaccard index; links make components. In each
component the first paragraph (by document, then place) stays, all others are marked removed.

A passage in the middle of a longer paragraph, or over line breaks, makes no paragraph like another. So runs of WINDOW
words are compared as well, for equality: of every SPAN consecutive runs the one of least hash is taken, so two texts
that share WINDOW + SPAN - 1 words in a row (50) have an equal run, whatever stands around them.

A band's group of more than CHUNK paragraphs is compared with its first one; then those that are not of the group's
largest component are compared with all, in chunks. A group gives a spanning forest of its links, not all of them:
components are the same and none is left out.

Edge cases: a null text has no paragraph. Shorter lines (empty ones too) are never removed by themselves. Repeated rows
and null keys count like others; rows of equal key and place are all kept or removed alike only if they are not the
first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_batches
from .components import components
from .simhash import rest_and_all
from .workspace import Workspace

WORDS = 5
#: Shorter lines are headings, list items and stock phrases, which many clean texts share.
LEAST = 20
#: Words of a run, and of how many consecutive runs one is taken.
WINDOW, SPAN = 25, 26
THRESHOLD = 0.8
RECALL = 0.99
#: At most this share of pairs with a Jaccard index of 0.2 may collide.
FALSE_AT = (0.2, 0.25)
CHUNK = 256
#: Words whose hashes a worker keeps.
KNOWN = 200_000
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd, so that their powers have inverses


def tune(threshold: float = THRESHOLD, recall: float = RECALL, false_at: tuple[float, float] = FALSE_AT) -> tuple[int, int]:
    """(bands, rows): the fewest bands with the recall at the threshold and few collisions of unlike pairs."""
    hit = lambda s, b, r: 1 - (1 - s**r) ** b
    options = [(b, r) for r in range(1, 9) for b in range(1, 65) if hit(threshold, b, r) >= recall and hit(false_at[0], b, r) <= false_at[1]]
    if not options:
        raise ValueError("no banding has that recall with so few false collisions")
    return min(options)


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def paragraphs(text: str, least: int = LEAST) -> Iterator[tuple[int, list[bytes]]]:
    """(place, words) of the lines of at least so many words."""
    for place, line in enumerate(text.split("\n")):
        words = line.encode().lower().split()
        if len(words) >= least:
            yield place, words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))))[:n]


class _Hashes:
    """128-bit hashes of words, as two lanes of 64 bits; each distinct word is hashed once."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.digests = bytearray()

    def of(self, words: list[bytes]) -> np.ndarray:
        """(2, n) hashes of single words."""
        if len(self.known) > KNOWN:
            self.known, self.digests = {}, bytearray()
        known = self.known
        at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        self.digests += b"".join(map(xxhash.xxh3_128_digest, islice(known, len(self.digests) // 16, None)))
        return np.frombuffer(bytes(self.digests), "<u8").reshape(-1, 2).T[:, at]


def _runs(words: np.ndarray, lane: int, n: int) -> np.ndarray:
    """Hashes of all runs of n words: sums of word hashes times powers of the base, so a run's hash is a difference of sums."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    powers = _powers(len(words), _BASE[lane])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)))
    inverse = np.uint64(pow(int(_BASE[lane]), -1, 1 << 64))
    return _mixed((sums[n:] - sums[:-n]) * _powers(len(words) - n + 1, inverse))


def _keys(lanes: list[np.ndarray]) -> pa.Array:
    """Two lanes of 64 bits as 16 bytes each."""
    data = np.stack(lanes, axis=1).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(lanes[0]), [None, pa.py_buffer(np.arange(0, len(data) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def _line_keys(lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The two hashes of each line of words that stand one after the other."""
    if not len(starts):
        return [np.zeros(0, np.uint64)] * 2
    at = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    powers = [_powers(int(sizes.max()), b) for b in _BASE]
    return [_mixed(np.add.reduceat(lanes[k] * powers[k][at], starts) + sizes.astype(np.uint64)) for k in range(2)]


def _chosen(hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of runs whose hash is the least of SPAN consecutive ones of a text, the last of equal ones; owner is the text of each word."""
    n = len(hashed)
    if n < SPAN:
        return np.zeros(0, np.int64)
    order = np.lexsort((-np.arange(n), hashed))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # blocks of SPAN: the least of a span is that of the rest of one block or of the beginning of the next
    padded = np.concatenate((rank, np.full(-n % SPAN, n))).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - SPAN + 1], ahead[SPAN - 1 : n])
    within = owner[: n - SPAN + 1] == owner[WINDOW + SPAN - 2 :]
    return np.unique(order[least[within]])


def _units(bands: int, rows: int, least: int):
    """From rows (doc, text): every paragraph (doc, place, key, n_words, bands) and every chosen run (with its first word's number in the text as at)."""
    draw = np.random.default_rng(11)
    a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    names = ["doc", "place", "at", "key", "n_words", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            done = 0
            for texts in in_batches(batch.column(1).to_pylist(), 1_000_000):
                words, owner, place, sizes = [], [], [], []
                for i, text in enumerate(texts, done):
                    for p, line in enumerate(text.split("\n")):
                        found = line.encode().lower().split()
                        if found:
                            words += found
                            owner.append(i)
                            place.append(p)
                            sizes.append(len(found))
                done += len(texts)
                lanes = hashes.of(words)
                owner, place, sizes = np.array(owner, np.int64), np.array(place, np.int64), np.array(sizes, np.int64)
                starts = np.cumsum(sizes) - sizes
                docs = batch.column(0)
                # paragraphs
                long = np.flatnonzero(sizes >= least)
                keys = _line_keys(lanes, starts, sizes)
                five = _runs(lanes[0], 0, WORDS)
                count = sizes[long] - WORDS + 1
                first = np.cumsum(count) - count
                h = five[np.repeat(starts[long] - first, count) + np.arange(int(count.sum()))] if len(long) else np.zeros(0, np.uint64)
                values = np.zeros((len(long), bands), np.uint64)
                for k in range(bands * rows if len(long) else 0):
                    mixed = h * a[k] + b[k]
                    mixed ^= mixed >> np.uint64(32)
                    values[:, k // rows] = values[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1) * bands, pa.int32()), pa.array(values.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(owner[long])), pa.array(place[long], pa.int32()), pa.nulls(len(long), pa.int32()), _keys([k[long] for k in keys]), pa.array(sizes[long], pa.int32()), lists], names
                )
                # chosen runs
                of_word = np.repeat(owner, sizes)
                runs = [_runs(lanes[k], k, WINDOW) for k in range(2)]
                spot = _chosen(runs[0], of_word)
                base = np.searchsorted(of_word, of_word[spot])
                line = np.searchsorted(starts, spot, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(owner[line])), pa.array(place[line], pa.int32()), pa.array(spot - base, pa.int32()), _keys([r[spot] for r in runs]), pa.array(np.full(len(spot), WINDOW), pa.int32()), pa.nulls(len(spot), lists.type)], names
                )

    return run


def _lines(least: int):
    """Rows (key, line) of every paragraph, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for texts in in_batches(batch.column(0).to_pylist(), 1_000_000):
                found = list({b" ".join(words): words for text in texts for _, words in paragraphs(text, least)}.items())
                sizes = np.array([len(w) for _, w in found], np.int64)
                keys = _line_keys(hashes.of([w for _, ws in found for w in ws]), np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([_keys(keys), pa.array([line.decode() for line, _ in found], pa.string())], ["key", "line"])

    return run


def _verified(threshold: float):
    """Rows (first, second) of members (key, line): links at the threshold among first, or between first and second if it is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                left, right = (c[i].as_py() for c in batch.columns)
                sets = {m["key"]: frozenset(shingles(m["line"].encode().split())) for m in [*left, *(right or [])]}
                parent = {k: k for k in sets}

                def top(x: bytes, parent: dict = parent) -> bytes:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                keys = sorted(m["key"] for m in left)
                others = keys if right is None else sorted(m["key"] for m in right)
                for j, x in enumerate(keys):
                    one = sets[x]
                    for y in others[j + 1 :] if right is None else others:
                        two = sets[y]
                        if x == y or min(len(one), len(two)) < threshold * max(len(one), len(two)):
                            continue
                        p, q = top(x), top(y)
                        if p != q:
                            both = len(one & two)
                            if both >= threshold * (len(one) + len(two) - both):
                                parent[max(p, q)] = min(p, q)
                                a.append(min(x, y))
                                b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def links(marked: DataFrame, docs: DataFrame, text: str, threshold: float, least: int, work: Workspace, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between keys of different paragraphs that span each component at the threshold."""
    each = marked.groupBy("key").agg(F.first("bands").alias("bands"))
    placed = work.table(each.select("key", F.posexplode("bands").alias("band", "value")), "bands")
    sizes = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("head")).where("members > 1")
    shared = work.table(placed.join(sizes, ["band", "value"]), "shared")
    wanted = shared.select("key").distinct()
    lines = work.table(docs.select(text).mapInArrow(_lines(least), "key binary, line string").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("line").alias("line")), "lines")
    member = F.struct("key", "line")
    checked = lambda groups, name: work.table(groups.mapInArrow(_verified(threshold), "a binary, b binary").distinct(), name)
    none = F.lit(None).cast("array<struct<key:binary,line:string>>")
    small = shared.where(F.col("members") <= chunk).join(lines, "key").groupBy("band", "value").agg(F.collect_list(member).alias("first")).select("first", none.alias("second"))
    near = checked(small, "near")
    large = shared.where(F.col("members") > chunk)
    if large.isEmpty():
        return near
    heads = lines.select(F.col("key").alias("head"), F.array(member).alias("second"))
    star = large.where("key <> head").select("key", "head").distinct().join(lines, "key").join(heads, "head").select(F.array(member).alias("first"), "second")
    near = near.union(checked(star, "star"))
    known = components(near, work).withColumnRenamed("node", "key")
    placed = large.select("band", "value", "key").join(known, "key", "left").withColumn("component", F.coalesce("component", "key")).join(lines, "key")
    return near.union(checked(rest_and_all(placed, ["band", "value"], member, "key", chunk), "crowds"))


def duplicate_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """Every paragraph with an equal or near-duplicate one, and every chosen run of words with an equal one: key, paragraph (line
    number from 0; that of a run's first word), passage (the number of its first word in the text; null for a whole
    paragraph), n_words, first_<key>, first_paragraph, removed."""
    if least < WORDS:
        raise ValueError(f"a paragraph has {WORDS} words at least")
    work = Workspace(docs.sparkSession, "paragraphs")
    kind = docs.schema[key].dataType.simpleString()
    bands, rows = tune(threshold)
    source = docs.select(F.col(key).alias("doc"), text)
    units = work.table(source.mapInArrow(_units(bands, rows, least), f"doc {kind}, place int, at int, key binary, n_words int, bands array<bigint>"), "units")
    marked, runs = units.where("at IS NULL"), units.where("at IS NOT NULL")
    found = components(links(marked, docs, text, threshold, least, work), work)
    keys = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("first"))
    named = keys.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    whole = named.groupBy("component").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    classes = named.select("key", "component").join(whole, "component").select("key", "first")
    places = marked.select("doc", "place", "at", "key", "n_words").join(classes, "key")
    each = runs.select("doc", "place", "at", "key", "n_words")
    again = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place", "at")).alias("first")).where("n > 1").select("key", "first")
    out = lambda df, *own: df.select(
        F.col("doc").alias(key), F.col("place").alias("paragraph"), F.col("at").alias("passage"), "n_words", F.col("first.doc").alias(f"first_{key}"), F.col("first.place").alias("first_paragraph"), (~F.struct(*own).eqNullSafe(F.col("first"))).alias("removed")
    )
    return out(places, "doc", "place").unionByName(out(each.join(again, "key"), "doc", "place", "at"))
