"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every neighbouring pair of symbols in the sorted keys
of the merge table (binary search), finds each word's pair of lowest rank, and merges all its places, leftmost first
where they overlap. Words without a pair left drop out, so later rounds handle few symbols. A long word would have a round
for each of its thousands of ranks; such words are merged rank by rank, and a round only looks where that rank's pairs are.

Edge cases: an empty table gives an empty result, null keys and other columns are the caller's, carried along untouched. A
null or empty text has no ids and decodes to an empty text. Strings of special tokens are their ids, as
in the tokenizers library. Ids that end inside a character decode to U+FFFD, as there. Repeated texts repeat their ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import WordEncoder, read_model


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, nxt = [], 256
    for b in range(256):
        if b in printable:
            letters.append(chr(b))
        else:
            letters.append(chr(nxt))
            nxt += 1
    return letters


#: Words of more bytes (text without blanks) are merged rank by rank.
LONG = 256


class MergeRounds(WordEncoder):
    def __init__(self, path: str):
        super().__init__(path)
        model = read_model(path)
        vocab = model["vocab"]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.start = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made, self.made_of_rank = keys[order], order.astype(np.int64), made[order], made
        of_letter = {c: b for b, c in enumerate(letters)}
        self.octets: dict[int, bytes] = {i: bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode() for t, i in vocab.items()}
        self.octets |= {i: t.encode() for t, i in model["special"].items()}

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has. Words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        none = len(self.keys)
        while len(symbols):
            inner = np.empty(len(symbols), bool)  # a place whose right neighbour is of the same word
            inner[:-1] = owner[:-1] == owner[1:]
            inner[-1] = False
            at = np.flatnonzero(inner)
            pair = symbols[at] * self.size + symbols[at + 1]
            slot = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            hit = self.keys[slot] == pair
            at, slot = at[hit], slot[hit]
            rank = np.full(len(symbols), none, np.int64)
            rank[at] = self.rank[slot]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(first, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ended = best == none
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
            chosen = rank[at] == best[at]
            at, slot = at[chosen], slot[chosen]
            if len(at):
                # where chosen places follow one another they overlap: every second one stays, from the left
                starts = np.concatenate(([True], at[1:] != at[:-1] + 1))
                place = np.arange(len(at))
                even = (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0
                at, slot = at[even], slot[even]
                symbols[at] = self.made[slot]
                ended[at + 1] = True
            keep = ~ended
            symbols, owner = symbols[keep], owner[keep]
        ids, owners = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(words))

    def ranks_at(self, symbols: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; len(self.keys) where it is no merge."""
        pair = symbols[at] * self.size + symbols[after]
        slot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[slot] == pair, self.rank[slot], len(self.keys))

    def merge_long(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() for long words: a round takes one rank, and looks only at the places where such a pair is or was made.

        Neighbours are links, since the symbols stay where they are. All words share the rounds; words do not touch.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        n, none = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths) - 1
        after[ends], before[ends - lengths + 1] = -1, -1
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks_at(symbols, at, after[at])
            at, rank = at[rank < none], rank[rank < none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for places, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist() if len(rank) else (), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[self.ranks_at(symbols, at, after[at]) == r]  # some have been merged into others since
            if not len(at):
                continue
            starts = np.concatenate(([True], after[at[:-1]] != at[1:]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]  # as in merge(): from the left
            gone = after[at]
            symbols[at] = self.made_of_rank[r]
            alive[gone] = False
            further = after[gone]
            after[at] = further
            before[further[further >= 0]] = at[further >= 0]
            touched = np.concatenate((at, before[at]))
            put(np.unique(touched[touched >= 0]))
        return symbols[alive], np.bincount(owner[alive], minlength=len(words))

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        octets = [w.encode() for w in words]
        found: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(octets) if len(w) <= LONG]
        long = [i for i, w in enumerate(octets) if len(w) > LONG]
        parts = [(self.merge, short[at : at + 50_000]) for at in range(0, len(short), 50_000)] + [(self.merge_long, long)] * bool(long)
        for merge, numbers in parts:
            ids, counts = merge([octets[i] for i in numbers])
            flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(numbers, [0, *ends[:-1]], ends, strict=True):
                found[i] = flat[a:b]
        return found

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.octets.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merge_rounds(path: str) -> MergeRounds:
    """One encoder a worker process."""
    return MergeRounds(path)


#: Texts that are encoded together; their symbols and ids are held at once.
BATCH_CHARS = 4_000_000


def in_batches(texts: Sequence[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    batch: list[str] = []
    held = 0
    for t in texts:
        batch.append(t or "")
        held += len(batch[-1])
        if held >= chars:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def encode(text: Column, path: str | None = None) -> Column:
    """array<int> of a text's ids."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        model = merge_rounds(path)
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for batch in in_batches(texts) for x in model.encode(batch)], dtype=object)

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an array<int> of ids; null for null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        model = merge_rounds(path)
        return pd.Series([None if x is None else model.decode(list(x)) for x in lists], dtype=object)

    return text(ids)


def round_trip(text: Column, path: str | None = None) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encoded, then decoded from the ids, in one pass over the texts."""
    import hashlib

    path = path or default_path()

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        model = merge_rounds(path)
        decimal = {i: str(i).encode() for i in model.octets}
        rows = []
        for batch in in_batches(texts):
            for octets in model.encode(batch):
                ids = np.frombuffer(octets, "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
