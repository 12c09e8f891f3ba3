"""Identifiers that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 20 upper-case hex digits of the parts' SHA-256; null parts, empty texts, false and numbers that are zero
    count as empty. The text "0" is no number: it stays (typeof is folded when the query is planned)."""

    def shown(p: Column) -> Column:
        said = p.cast("string")
        nothing = (F.typeof(p) != "string") & said.rlike(r"^(-?0(\.0*)?(E-?[0-9]+)?|false)$")
        return F.coalesce(F.when(~nothing, said), F.lit(""))

    return F.concat(F.lit(f"{prefix}_"), F.upper(F.substring(F.sha2(F.concat_ws("|", *map(shown, parts)), 256), 1, 20)))


def signature(kind: str, *parts: Column) -> Column:
    """SHA-256 of a record's kind and its texts, white space and case folded."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[squeeze(p.cast("string")) for p in parts]), 256)


def short_reference(x: Column) -> Column:
    """CASE- and the last six ASCII letters or digits, in upper case."""
    return F.concat(F.lit("CASE-"), F.upper(F.right(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[^A-Za-z0-9]", ""), F.lit(6))))


def ordinal_id(form: str, rank: Column) -> Column:
    """form is a printf format such as CL_%04d."""
    return F.format_string(form, rank)
