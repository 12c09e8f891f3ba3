"""Winnowing fingerprints of documents, in DataFrame functions alone.

Words (runs without white space, cut after every 16 characters) are hashed once each; a k-gram's 33-bit hash is the polynomial
of its words' hashes that a rolling hash has. Spark has no running fold over an array that is linear in its length, so the
polynomials are not rolled from the left: those of two words give those of four, and further words are added one by one.
Of every window of w neighbouring k-grams the least hash is chosen, the rightmost of equal ones, with its position.
Two texts that share a run of k + w - 1 words so share at least one chosen hash (the match guarantee).

Edge cases: a null text counts as empty; a text without words has no k-gram and an empty fingerprint; one with fewer
than k words has one k-gram of all its words. Two empty fingerprints are alike with 1.0. Equal texts have equal
fingerprints. Texts of a gigabyte at most (2**30 words) keep their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_following
from .workspace import let

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
GRAM, WINDOW = 5, 4
PLACE_BITS = 30
#: A prime below 2**33. Products with BASE, or its square, stay below 2**63: nothing overflows.
MODULUS = (1 << 33) - 9
BASE = 31_337
PLACE_MASK = (1 << PLACE_BITS) - 1


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint: array<long>, ascending positions; each is a hash's 33 bits above the complement of its position.

    window must be a power of two: the minimum over it is built by doubling.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def spans(each: Column, found: Column, span: int) -> Column:
        """From polynomials over span words at every place those over gram words."""
        if span == gram:
            return found
        step = span if span <= 2 and 2 * span <= gram else 1
        tail = found if step == span else each
        longer = F.transform(F.sequence(F.lit(0), F.size(each) - (span + step)), lambda i: (F.get(found, i) * F.lit(BASE**step) + F.get(tail, i + span)) % F.lit(MODULUS))
        return let(longer, lambda f: spans(each, f, span + step))

    def grams(words: Column) -> Column:
        # a word's hash is never 0, which stands for the words that a short text lacks
        hashed = F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 31) % F.lit(MODULUS - 1) + 1)
        padded = F.concat(hashed, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(gram) - F.size(words), F.lit(0))))
        place = lambda i: F.lit(PLACE_MASK) - i.cast("long")  # noqa: E731  a later place is the smaller number
        return F.transform(let(padded, lambda h: spans(h, h, 1)), lambda s, i: F.shiftleft(s, PLACE_BITS).bitwiseOR(place(i)))

    def minima(packed: Column, span: int) -> Column:
        if span == window:
            return F.array_distinct(packed)
        # the minimum over 2 * span places: that over span, and that over the span after it
        pairs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(packed) - span - 1, F.lit(0))),
            lambda i: F.least(F.get(packed, i), F.get(packed, i + span)),
        )
        return let(pairs, lambda p: minima(p, 2 * span))

    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            let(grams(w), lambda p: F.when(F.size(p) <= window, F.array(F.array_min(p))).otherwise(minima(p, 1)))
        ),
    )


def positions(fingerprint: Column) -> Column:
    """array<struct<position, hash>> of a fingerprint: the word at which each chosen k-gram starts, from 0."""
    return F.transform(
        fingerprint,
        lambda p: F.struct((F.lit(PLACE_MASK) - p.bitwiseAND(F.lit(PLACE_MASK))).alias("position"), F.shiftrightunsigned(p, PLACE_BITS).alias("hash")),
    )


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda p: F.shiftrightunsigned(p, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints' hashes, 0 to 1."""
    return let(
        F.struct(hashes(a).alias("a"), hashes(b).alias("b")),
        lambda s: let(
            F.size(F.array_intersect(s["a"], s["b"])),
            lambda both: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), F.lit(1.0)).otherwise(
                both / (F.size(s["a"]) + F.size(s["b"]) - both)
            ),
        ),
    )


def digest(fingerprint: Column) -> Column:
    """A short string of a whole fingerprint, positions included."""
    return F.sha2(F.array_join(F.transform(fingerprint, lambda p: p.cast("string")), ","), 256)


def edited_text(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of following."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, fingerprint, edited, edited_fingerprint, and the likeness of the fingerprint to the edited text's and the next document's.

    The next document is the next one in descending key (after the last: the first). Other columns are left out.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = with_following(rows, key, {"fingerprint": winnow(F.col("text"))}, ["text", "fingerprint"])
    return (
        near.withColumn("edited", edited_text(F.col("text"), F.col("following.text")))
        .withColumn("edited_fingerprint", winnow(F.col("edited")))
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("following.fingerprint")))
        .drop("following")
    )
