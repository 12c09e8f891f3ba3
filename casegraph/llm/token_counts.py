"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct words.

A word (a run without white space, with the vocabulary's word mark before it) is cut into the pieces whose log scores
add up to the most. Words are inserted in a trie; a node stands for a prefix and holds the prefix's best (forward)
score and how many pieces give it, computed once from the nodes above it however many words share it. A word's terminal
node then holds the word's count. Documents add up the counts of their words.

A worker keeps its trie over all texts that it sees (NODES at most; then it starts anew, which only costs time). A word of
over LONG bytes gets its score without nodes.

Edge cases: an empty table gives an empty result; null keys are kept, other columns (of any name) are left out. A null or wordless text has no tokens. Of equal scores the one with fewer pieces counts. Characters that no
piece covers cost a byte piece for each of their UTF-8 bytes. Repeated rows are counted alike.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_batches

NODES = 1_500_000
#: Words whose counts a worker keeps, and the longest (bytes) that goes into the trie.
KNOWN, LONG = 1_000_000, 1000
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(n: int) -> np.ndarray:
    """Log scores of pieces by rank: the share of rank r falls as 1 / (r + 10)."""
    shares = 1.0 / (np.arange(n) + 10.0)
    return np.log(shares / shares.sum())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file with their scores, in the order of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return dict(zip(pieces, zipf_scores(len(pieces)).tolist(), strict=True))


class Trie:
    """A node is [score, pieces, children]; the root is the empty prefix."""

    def __init__(self, scores: dict[str, float], most: int = NODES):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.clear()
        self.known: dict[bytes, int] = {}
        self.pieces, self.totals, self.filled = np.zeros(0, np.int64), np.zeros(0, np.float64), 0

    def clear(self) -> None:
        self.root: list = [0.0, 0, {}]
        self.nodes = 0

    def insert(self, word: str) -> tuple[int, float]:
        """Pieces and score of a word."""
        node, path = self.root, [self.root]
        scores = self.scores
        for end, letter in enumerate(word, 1):
            child = node[2].get(letter)
            if child is None:
                octets = len(letter.encode("utf-8", "replace"))
                best, pieces = node[0] + octets * self.byte, node[1] + octets
                for start in range(max(0, end - self.longest), end):
                    own = scores.get(word[start:end])
                    if own is not None:
                        before = path[start]
                        total = before[0] + own
                        if total > best or (total == best and before[1] + 1 < pieces):
                            best, pieces = total, before[1] + 1
                child = node[2][letter] = [best, pieces, {}]
                self.nodes += 1
            node = child
            path.append(node)
        return node[1], node[0]

    def along(self, word: str) -> tuple[int, float]:
        """insert() for a long word, which shares no prefix with others: only the last scores are held, no node is made."""
        scores, longest = self.scores, self.longest
        path: list[tuple[float, int]] = [(0.0, 0)]  # of the last `longest` places
        for end, letter in enumerate(word, 1):
            octets = len(letter.encode("utf-8", "replace"))
            best, pieces = path[-1][0] + octets * self.byte, path[-1][1] + octets
            first = max(0, end - longest)
            for start in range(first, end):
                own = scores.get(word[start:end])
                if own is not None:
                    score, n = path[start - end]
                    total = score + own
                    if total > best or (total == best and n + 1 < pieces):
                        best, pieces = total, n + 1
            path.append((best, pieces))
            if len(path) > longest:
                del path[0]
        return path[-1][1], path[-1][0]

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(words, tokens, score) of each text."""
        if len(self.known) > KNOWN:
            self.known, self.filled = {}, 0
        split = [t.encode().split() for t in texts]
        known = self.known
        fresh = sorted({w for words in split for w in words if w not in known})  # in order, so that prefixes are met together
        if self.filled + len(fresh) > len(self.pieces):
            room = 2 * (self.filled + len(fresh))
            self.pieces, self.totals = (np.concatenate((x[: self.filled], np.zeros(room - self.filled, x.dtype))) for x in (self.pieces, self.totals))
        for word in fresh:
            if self.nodes > self.most:
                self.clear()
            known[word] = at = self.filled
            self.pieces[at], self.totals[at] = self.insert(MARK + word.decode()) if len(word) <= LONG else self.along(MARK + word.decode())
            self.filled += 1
        rows = []
        for words in split:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            rows.append((len(words), int(self.pieces[at].sum()), float(self.totals[at].sum())))
        return rows


@lru_cache(maxsize=2)
def worker_trie(path: str) -> Trie:
    return Trie(vocabulary(path))


def count(text: Column, path: str | None = None) -> Column:
    """struct<n_words, n_tokens, log_score>."""
    path = path or default_path()

    @F.pandas_udf("n_words bigint, n_tokens bigint, log_score double")
    def counts(texts: pd.Series) -> pd.DataFrame:
        trie = worker_trie(path)
        return pd.DataFrame([row for batch in in_batches(texts) for row in trie.count(batch)], columns=["n_words", "n_tokens", "log_score"])

    return counts(text)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_words, n_tokens, log_score of every document."""
    return docs.select(F.col(key), count(F.col(text), path).alias("_c")).select(key, "_c.n_words", "_c.n_tokens", "_c.log_score")
