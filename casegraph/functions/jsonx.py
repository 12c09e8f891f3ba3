"""JSON that models and people write: lists, fenced objects, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_list(x: Column, keep_plain: bool = False, most: int | None = None) -> Column:
    """array<string> of a JSON list; an empty array for anything else, or with keep_plain a list of the plain text."""
    valid = F.trim(x).startswith("[") & F.try_parse_json(x).isNotNull()
    listed = F.when(x == "[]", F.array().cast("array<string>")).when(valid, F.from_json(x, "array<string>"))
    plain = F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.array(x)) if keep_plain else F.lit(None).cast("array<string>")
    found = F.coalesce(listed, plain, F.array().cast("array<string>"))
    return F.slice(found, 1, most) if most else found


def object_text(x: Column) -> Column:
    """The JSON object in a model's answer: thoughts and code fences are taken off, else the outermost braces; null if none parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"(?im)^\s*```(?:json)?\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(good(bare), good(inner))


def serialised_chars(x: Column) -> Column:
    """Characters of a struct, array or map as compact JSON."""
    return F.char_length(F.to_json(x))


def finite(x: Column) -> Column:
    """null for NaN and infinities, which JSON can't hold."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bounded_score(x: Column, low: int = 0, high: int = 100) -> Column:
    """A whole number between low and high; null if it is no number."""
    value = finite(x.try_cast("double"))
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value.cast("int"))))


def truth(x: Column) -> Column:
    """true/false of the words that models write for them; null otherwise."""
    said = F.lower(F.trim(x.cast("string")))
    return F.when(said.isin("true", "yes", "1"), F.lit(True)).when(said.isin("false", "no", "0"), F.lit(False))


def confidence_bucket(value: Column, verified: Column, flagged: Column) -> Column:
    """verified and flagged first, then high from 0.8, review from 0.5, else low; unverified without a number."""
    n = value.try_cast("double")
    return (
        F.when(F.coalesce(verified, F.lit(False)), "verified").when(F.coalesce(flagged, F.lit(False)), "flagged").when(n.isNull() | F.isnan(n), "unverified").when(n >= 0.8, "high").when(n >= 0.5, "review").otherwise("low")
    )
