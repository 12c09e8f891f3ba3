"""Byte-level BPE by words: texts are cut at special tokens and into pre-tokens, and each distinct word is encoded once.

Used inside tasks. A worker keeps the words that it has met (WORDS at most; then it starts anew), so the vocabulary of
a stream of texts is encoded once, not once a text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex

#: Words that a worker keeps; with their ids they take about 200 bytes each.
WORDS = 700_000
#: The pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without characters that Python's own re classes differently (it is faster).
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Only such texts need the larger engine.
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]")
_ANY = regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    if text.isascii():  # known without a scan; the four separators are found by fast ones
        plain = not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    else:
        plain = not _NOT_PLAIN.search(text)
    return (_PLAIN if plain else _ANY).findall(text)


@lru_cache(maxsize=4)
def read_model(path: str) -> dict:
    """vocab (token -> id), merges [(left, right)], special {content: id} of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    return {"vocab": whole["model"]["vocab"], "merges": pairs, "special": {t["content"]: t["id"] for t in whole["added_tokens"]}}


def release() -> None:
    """Gives back what earlier stages have freed in this worker but the allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. Subclasses encode lists of words."""

    def __init__(self, path: str, words: int = WORDS):
        self.path, self.most = path, words
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in read_model(path)["special"].items()}
        self.cut = re.compile("(" + "|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        raise NotImplementedError

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order."""
        if not any(k in text for k in self.special):
            return pre_tokens(text)
        parts: list[str] = []
        for piece in self.cut.split(text):
            parts += [piece] if piece in self.special else pre_tokens(piece)
        return parts

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {}
        split = [self._parts(t) if t else [] for t in texts]
        known = self.known
        new = dict.fromkeys(chain.from_iterable(filterfalse(known.__contains__, parts) for parts in split))
        fresh = [w for w in new if w not in self.special]
        known.update(zip(fresh, self.encode_words(fresh), strict=True))
        known.update({w: self.special[w] for w in new if w in self.special})
        at = known.__getitem__
        return [b"".join(map(at, parts)) for parts in split]


class LibraryEncoder(WordEncoder):
    """Words are encoded by the tokenizers library itself."""

    def __init__(self, path: str, words: int = WORDS):
        super().__init__(path, words)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        found: list[bytes] = []
        for at in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
            ends = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
            flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
            found += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return found


@lru_cache(maxsize=2)
def library_encoder(path: str, words: int = WORDS) -> LibraryEncoder:
    """One encoder a worker process, which keeps so many words."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LibraryEncoder(path, words)
