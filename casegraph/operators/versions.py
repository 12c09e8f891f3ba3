"""Word-level differences between two versions of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and the white space between them, as a browser splits them.
SPACE = re.compile("([\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+)")


#: Layers of the search that are kept: the first STEP, then each STEP-th, and one block that is made again from the layer before it.
STEP = 256
#: Layers of fewer diagonals are made one by one, larger ones by whole arrays.
FEW = 64


def _small_layer(before: list[int], x: list[int], y: list[int]) -> list[int]:
    """_next_layer for few diagonals."""
    n, m, d = len(x), len(y), len(before)
    nowhere, now = n + 1, []
    for t in range(d + 1):
        shift = n - m - d + 2 * t
        i = nowhere
        if t < d and 0 < before[t] <= n and 0 <= before[t] - 1 - shift <= m:
            i = before[t] - 1
        if t and before[t - 1] < i and 0 <= before[t - 1] - shift <= m:
            i = before[t - 1]
        if i <= n:
            j = i - shift
            while i > 0 and j > 0 and x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
        now.append(i)
    return now


def _next_layer(before: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From where on, on each diagonal, the rest takes one edit more than in the layer before; len(x) + 1 for nowhere."""
    n, d = len(x), len(before)
    nowhere = n + 1
    k = np.arange(-d, d + 1, 2)
    # a deletion leads to (i + 1, j), one diagonal up; an insertion to (i, j + 1), one down
    deleted, inserted = np.append(before, nowhere), np.append(nowhere, before)
    deleted = np.where(deleted <= n, deleted - 1, nowhere)
    shift = n - len(y) + k
    for ways in (deleted, inserted):
        ways[(ways < 0) | (ways - shift < 0) | (ways - shift > len(y))] = nowhere
    i = np.minimum(deleted, inserted)
    at = np.flatnonzero(i <= n)
    while len(at):  # on each diagonal back over equal tokens
        at = at[(i[at] > 0) & (i[at] > shift[at])]
        at = at[x[i[at] - 1] == y[i[at] - shift[at] - 1]]
        i[at] -= 1
    return i


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(kind, text) runs of a shortest edit script from a to b: same, deleted, inserted. Of equally short ones, equal tokens are matched at
    once and deletions come before insertions.

    Tokens that the other side lacks are in no match: the search goes over the others, the way through them over all.
    Myers' O(ND) search from the ends backwards: layer d tells, for each diagonal i - j, from where on the rest takes d edits
    at most. Time follows the number of differences, not the product of the lengths; so does memory, of which the
    layers between every STEP-th are made again when the way through them is read.
    """
    in_a, in_b = {*a}, {*b}
    alone_a, alone_b = [t not in in_b for t in a], [t not in in_a for t in b]
    known: dict[str, int] = {}
    x, y = (np.array([known.setdefault(t, len(known)) for t, alone in zip(tokens, all_, strict=True) if not alone], np.int64) for tokens, all_ in ((a, alone_a), (b, alone_b)))
    n, m = len(x), len(y)
    shorter = min(n, m)
    differ = np.flatnonzero(x[n - shorter :][::-1] != y[m - shorter :][::-1])
    layer = [n - (int(differ[0]) if len(differ) else shorter)]
    saved, d = {0: layer}, 0
    small = x.tolist(), y.tolist()
    following = lambda before: _small_layer(before, *small) if len(before) < FEW else _next_layer(np.asarray(before), x, y)
    while abs(m - n) > d or (m - n + d) % 2 or layer[(m - n + d) // 2] != 0:
        layer, d = following(layer), d + 1
        if d < STEP or d % STEP == 0:
            saved[d] = layer
    block: dict = {}

    def reach(d: int, k: int) -> int:
        if abs(k) > d:
            return n + 1
        if d in saved:
            return int(saved[d][(k + d) // 2])
        if d not in block:
            block.clear()
            first = d - d % STEP
            block[first] = saved[first]
            for e in range(first + 1, d + 1):
                block[e] = following(block[e - 1])
        return int(block[d][(k + d) // 2])

    runs: list[tuple[str, list[str]]] = []

    def put(kind: str, token: str) -> None:
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append(token)

    # i and j are places among the tokens searched, p and q among all
    i, j, p, q, left = 0, 0, 0, 0, d
    while p < len(a) or q < len(b):
        if p < len(a) and alone_a[p]:
            put("deleted", a[p])
            p += 1
            continue
        if p < len(a) and q < len(b) and a[p] == b[q]:
            put("same", a[p])
            i, j, p, q = i + 1, j + 1, p + 1, q + 1
            continue
        if i < n and (j == m or reach(left - 1, i + 1 - j - (n - m)) <= i + 1):
            put("deleted", a[p])
            i, p, left = i + 1, p + 1, left - 1
        elif alone_b[q]:
            put("inserted", b[q])
            q += 1
        else:
            put("inserted", b[q])
            j, q, left = j + 1, q + 1, left - 1
    return [(kind, "".join(tokens)) for kind, tokens in runs]


def word_changes(df: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """keys, place (from 1), kind (same, deleted, inserted), text: runs that make both versions. Null counts as empty; two
    empty versions have no run. Rows are compared where they lie, without a shuffle; long rows cost by their differences."""
    fields = [df.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, kinds, texts = [], [], [], []
            for row, (x, y) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                # split() gives an empty text where white space stands at an end
                runs = [r for r in edit_script([t for t in SPACE.split(x or "") if t], [t for t in SPACE.split(y or "") if t]) if r[1]]
                at += [row] * len(runs)
                places += range(1, len(runs) + 1)
                kinds += [k for k, _ in runs]
                texts += [t for _, t in runs]
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], [*keys, "place", "kind", "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "place int, kind string, text string"])
    return df.select(*keys, F.col(old).cast("string"), F.col(new).cast("string")).mapInArrow(run, schema)
