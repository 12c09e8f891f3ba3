"""Nested JSON texts as lists of tokens: members dropped at any depth, texts in them changed, values found by name.

A text is cut into tokens (with the white space before them); depth is a running sum of brackets, so any nesting takes no
shuffle and no recursion. What is kept stays as it was written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import let

#: A string (escapes inside), a bracket, colon or comma, or a bare word. Possessive, so long strings need no stack.
TOKEN = r'\s*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]++)'


def tokens(json: Column) -> Column:
    """array<string>; null for what is not JSON."""
    return F.when(F.try_parse_json(json).isNotNull(), F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0)))


def bare_token(token: Column) -> Column:
    """Without the white space before it."""
    return F.ltrim(token, F.lit(" \t\r\n"))


def plain(token: Column) -> Column:
    """The text of a string token without quotes and escapes; other tokens as they are."""
    bare = bare_token(token)
    inner = F.substring(bare, F.lit(2), F.char_length(bare) - 2)
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")
    return F.when(~bare.startswith('"'), bare).when(F.contains(bare, F.lit("\\")), decoded).otherwise(inner)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.char_length(whole) - 6)


def named_values(json: Column, names: Sequence[str], fold: bool = True) -> Column:
    """array<struct<name, value>> of the texts and numbers (but 0) that stand under one of names anywhere, in order. No shuffle."""
    wanted = [n.lower() if fold else n for n in names]
    key = lambda t: F.lower(plain(t)) if fold else plain(t)

    def found(all_tokens: Column) -> Column:
        def member(t: Column, i: Column) -> Column:
            value = bare_token(F.get(all_tokens, i + 2))
            scalar = ~F.substring(value, 1, 1).isin("{", "[") & ~value.isin("null", "true", "false") & (value.startswith('"') | (value.try_cast("double") != 0))
            hit = bare_token(t).startswith('"') & (bare_token(F.get(all_tokens, i + 1)) == ":") & scalar
            return F.when(hit, F.when(key(t).isin(wanted), F.struct(key(t).alias("name"), plain(value).alias("value"))))

        return F.filter(F.transform(all_tokens, member), lambda m: m.isNotNull())

    return let(tokens(json), found)


def _kept(forbidden: Sequence[str], fold: bool, schema: pa.Schema):
    """Of batches (keys, _tokens) the tokens that stay, and whether each is a member's name. A batch's tokens lie end to end in arrays, and
    all rows are worked on at once."""
    gone_names = {n.lower() if fold else n for n in forbidden}

    def is_gone(name: str) -> bool:
        try:
            said = json.loads(name, strict=False) if "\\" in name else name[1:-1]
        except ValueError:
            return False
        return (said.lower() if fold else said) in gone_names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            flat, row = listed.flatten(), np.repeat(np.arange(batch.num_rows), size)
            bare, at = pc.utf8_ltrim(flat, characters=" \t\r\n"), np.arange(len(flat))
            one_of = lambda *t: pc.is_in(bare, value_set=pa.array(t)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            opens, closes, comma = one_of("{", "["), one_of("}", "]"), one_of(",")
            follows = np.append(row[1:] == row[:-1], False)[: len(row)]  # the next token is of the same row
            named = pc.starts_with(bare, '"').to_numpy(zero_copy_only=False) & np.append(one_of(":")[1:], False)[: len(row)] & follows
            keep = np.ones(len(flat), bool)
            names = bare.filter(pa.array(named)).dictionary_encode()
            hit = np.array([is_gone(n) for n in names.dictionary.to_pylist()], bool)
            drop = np.flatnonzero(named)[hit[names.indices.to_numpy()]] if len(names) else at[:0]
            if len(drop):
                step = opens.astype(np.int64) - closes
                total = np.cumsum(step)
                first = (np.cumsum(size) - size)[row]
                # a bracket belongs to the container around it when it opens, to its own when it closes
                depth = total - (total - step)[first] - opens + closes
                place = (row * (depth.max() - min(depth.min(), 0) + 1) + depth - min(depth.min(), 0)) * len(flat) + at
                ends = np.sort(place[comma | closes])
                found = np.searchsorted(ends, place[drop], "right")
                end = ends[np.minimum(found, len(ends) - 1)]
                same = (found < len(ends)) & (end // len(flat) == place[drop] // len(flat))
                stop = np.full(len(flat), -1)
                stop[drop[same]] = end[same] % len(flat)
                before = np.append(stop[1:], -1)
                stop = np.where((stop < 0) & comma & follows, before, stop)
                keep = np.maximum.accumulate(stop) <= at
                left = np.flatnonzero(keep)
                # the comma after a first member that has gone
                lone = comma[left[1:]] & opens[left[:-1]] & (row[left[1:]] == row[left[:-1]])
                keep[left[1:][lone]] = False
            offsets = np.append(0, np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), v) for v in (flat.filter(pa.array(keep)), pa.array(named[keep]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], schema=schema)

    return run


def rewritten(df: DataFrame, keys: list[str], json: str, forbidden: Sequence[str] = (), fix: Callable[[Column], Column] | None = None, fold: bool = True) -> DataFrame:
    """keys and json: without the members that have a forbidden name, whatever they hold and however deep they stand; the texts that
    are left (not names) go through fix. Null, and whatever is no JSON, becomes null. Every row of df has a row here.

    fold: names are compared without case. Rows are worked on where they lie, without a shuffle.
    """
    rows = df.select(*[F.col(k) for k in keys], tokens(F.col(json)).alias("_tokens"))
    shape = T.StructType([*rows.schema.fields[:-1], T.StructField("_tokens", T.ArrayType(T.StringType())), T.StructField("_named", T.ArrayType(T.BooleanType()))])
    kept = rows.mapInArrow(_kept(list(forbidden), fold, to_arrow_schema(shape)), shape)

    def shown(token: Column, i: Column) -> Column:
        bare = bare_token(token)
        space = F.substring(token, F.lit(1), F.char_length(token) - F.char_length(bare))
        fixed = let(plain(bare), lambda value: let(fix(value), lambda new: F.when(~new.eqNullSafe(value), F.concat(space, quoted(new))).otherwise(token)))
        return F.when(bare.startswith('"') & ~F.get("_named", i), fixed).otherwise(token)

    whole = F.col("_tokens") if fix is None else F.transform("_tokens", shown)
    return kept.select(*keys, F.when(F.size("_tokens") > 0, F.array_join(whole, "")).alias(json))
