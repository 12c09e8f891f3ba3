"""Text as columns: null tokens, folding, truncation, excerpts. Every function maps Column to Column; null stays null unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for "no value".
NULL_TOKENS = ["", "null", "none", "n/a", "na", "-", "—", "nan", "unknown"]
ASCII_DIGITS = "0123456789"
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def made_once(df: DataFrame, columns: dict[str, Column], most: int = 4) -> DataFrame:
    """df with columns, each evaluated once a row, in compiled code and before any later filter: the optimiser neither copies them to
    where they are used nor moves them, since they come out of generators of one row. A generator makes at most so many of
    them, since the compiler leaves long methods alone."""
    named = [c.alias(n) for n, c in columns.items()]
    for at in range(0, len(named), most):
        df = df.select("*", F.inline(F.array(F.struct(*named[at : at + most]))))
    return df


def ascii_digits(x: Column) -> Column:
    return F.translate(x, EASTERN_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def clean(x: Column) -> Column:
    """Trimmed text; null for texts that stand for no value."""
    # most texts have nothing to trim
    bare = x.rlike(r"(?s)\A\S(?:.*[^\s\u0085\u2028\u2029])?\z") & ~x.rlike(r"[\u0085\u2028\u2029]\z")
    token = lambda t: F.lower(t).isin(NULL_TOKENS)
    trimmed = F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(bare, F.when(~token(x), x)).when(x.isNotNull(), let(trimmed, lambda t: F.when(~token(t), t)))


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null, blank nor "nan"."""
    usable = [F.when(~F.lower(F.trim(c)).isin("", "nan"), c) for c in columns]
    return F.coalesce(*usable)


def snake(x: Column) -> Column:
    """Lower-case Latin letters and digits joined by single underscores; null if there are none."""
    found = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(clean(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(""))
    # one word needs no more than lower case
    return F.when(x.rlike(r"\A[A-Za-z0-9]+\z"), F.when(~F.lower(x).isin(NULL_TOKENS), F.lower(x))).otherwise(found)


def casefold(x: Column) -> Column:
    """lower() plus the common letters whose full case folding differs."""
    return F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), "ςµſ", "σμs")


def normalise(x: Column) -> Column:
    """A key for equality of names and sentences: folded case, one alef, no marks, words of letters and digits."""
    folded = F.translate(casefold(F.coalesce(x, F.lit(""))), "أإآٱ", "اااا")
    unmarked = F.regexp_replace(folded, "[ؐ-ًؚ-ٰٟۖ-ۭـ]", "")
    return F.trim(F.regexp_replace(unmarked, r"[^\p{L}\p{N}]+", " "))


def squeeze(x: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))


def truncate(x: Column, most: int, mark: str = "…", inside: bool = False) -> Column:
    """At most `most` characters, then mark; with inside, mark counts as one of them."""
    keep = most - len(mark) if inside else most
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, keep)), F.lit(mark)))


def excerpt(x: Column, needles: list[Column], around: int = 260, otherwise: int = 520) -> Column:
    """The text around the first needle (of 3 characters at least) that it contains, with ellipses; else its start."""
    lowered = F.lower(x)
    places = [_place(lowered, n) for n in needles]
    hit = F.coalesce(*[F.when(p.isNotNull(), F.struct(p.alias("at"), F.char_length(n).alias("size"))) for p, n in zip(places, needles, strict=True)])
    start = F.greatest(hit["at"] - around, F.lit(1))
    stop = F.least(hit["at"] + hit["size"] + around, F.char_length(x) + 1)
    body = F.trim(F.substring(x, start, stop - start))
    framed = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), body, F.when(stop <= F.char_length(x), F.lit("…")).otherwise(F.lit("")))
    return F.when(hit.isNotNull(), framed).otherwise(F.substring(x, 1, otherwise))


def _place(lowered: Column, needle: Column) -> Column:
    return F.when(F.char_length(needle) >= 3, F.nullif(F.position(F.lower(needle), lowered), F.lit(0)))


def contains_any(query: Column, columns: list[Column]) -> Column:
    """Case-insensitive literal search over several columns; a blank query matches all rows."""
    wanted = casefold(F.trim(F.coalesce(query, F.lit(""))))
    hits = [F.contains(casefold(F.coalesce(c.cast("string"), F.lit(""))), wanted) for c in columns]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return (wanted == "") | found


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; two empty ones are alike with 1.0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def ordered_distinct(items: Column, fold: bool = True, most: int | None = None) -> Column:
    """Distinct elements in order of first appearance; with fold, case does not count. Blank ones are left out."""
    kept = F.filter(items, lambda x: F.trim(x) != "")
    if fold:
        firsts = lambda all_, keys: F.filter(all_, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        found = let(kept, lambda all_: F.when(F.size(all_) < 2, all_).otherwise(let(F.transform(all_, lambda x: casefold(F.trim(x))), lambda keys: firsts(all_, keys))))
    else:
        found = F.array_distinct(kept)
    return F.slice(found, 1, most) if most else found


def longest_first(items: Column) -> Column:
    """The longest element, the first of equally long ones; null for an empty array."""
    return F.reduce(items, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.char_length(x) > F.char_length(best)), x).otherwise(best))
