"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule rejects a text or lets it pass. All rules need a text's words, which are split once. On a sample each rule's further
cost (seconds a row) and selectivity (the share that it rejects) are measured; rules then stand by rejection per cost, so that cheap rules that reject much run first and a
text that one of them rejects never reaches the expensive ones. The verdict does not depend on the order.

Edge cases: a null text counts as empty and has no words, lines or symbols. An empty table gives an empty result.
Repeated rows are judged alike, each by itself. Other columns, of any name, are carried along.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Of a packed window: its place among the text's windows; the bits above are those of its hash.
PLACE_BITS = 24
#: At most so many rows are timed; the sample only orders rules, verdicts cover all rows.
SAMPLE_ROWS = 1000
#: How often the sample is judged in a timed job.
TIMES = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more in the text; the first one counts too.

    Windows are hashed (64 bits) and sorted as longs of hash bits and place. A text in which two different windows
    share those hash bits is sorted by whole hash and place instead. All-different windows need no sort.
    """

    def covered(places: Column) -> Column:
        # places: ascending starts of repeated windows; each covers 3 words, less what the next one covers
        last = F.size(places) - 1
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.lit(0).cast("long"),
            lambda total, j: total + F.when(j == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(places, j + 1) - F.get(places, j))),
        )

    def twins(sorted_items: Column, hash_at: Callable, place_at: Callable) -> Column:
        # places whose hash equals that of a neighbour in sorted order
        same = lambda j, k: F.coalesce(hash_at(F.get(sorted_items, j)) == hash_at(F.get(sorted_items, k)), F.lit(False))
        return F.array_sort(
            F.filter(
                F.transform(sorted_items, lambda v, j: F.when(same(j, j - 1) | same(j, j + 1), place_at(v))),
                lambda v: v.isNotNull(),
            )
        )

    def by_hash(hashes: Column) -> Column:
        mask = (1 << PLACE_BITS) - 1
        place = lambda v: v.bitwiseAND(F.lit(mask)).cast("int")
        packed = F.array_sort(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

        def from_packed(p: Column) -> Column:
            # two neighbours with equal hash bits and different hashes: their order says nothing
            mixed = F.exists(
                F.sequence(F.lit(1), F.size(p) - 1),
                lambda j: (F.get(p, j).bitwiseAND(F.lit(~mask)) == F.get(p, j - 1).bitwiseAND(F.lit(~mask)))
                & (F.get(hashes, place(F.get(p, j))) != F.get(hashes, place(F.get(p, j - 1)))),
            )
            whole = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(
                (F.size(hashes) > mask) | mixed,
                let(whole, lambda s: let(twins(s, lambda v: v["h"], lambda v: v["i"]), covered)),
            ).otherwise(let(twins(p, lambda v: F.get(hashes, place(v)), place), covered))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(packed, from_packed))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows(words), by_hash))


def windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows of three words or more; each word is hashed once."""
    of = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def mostly_repeated(words: Column) -> Column:
    """Whether over half the words stand in repeated windows. Of n windows with d different ones at most 2 (n - d) are
    repeated, and each covers 3 words: most texts need no exact count."""
    many = let(windows(words), lambda h: 12 * (F.size(h) - F.size(F.array_distinct(h))) > F.size(words))
    return F.when(F.size(words) < 4, F.lit(False)).when(many, 100 * repeated_words(words) > 50 * F.size(words)).otherwise(F.lit(False))


def line_counts(text: Column) -> Column:
    """struct<n_lines, n_dup_lines> of the lines with a word."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines")))


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """Each measure of a text that is not null, given its words; computed only where it is asked for."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "lines": line_counts(text),
        "n_repeat_words": repeated_words(words),
        "mostly_repeated": mostly_repeated(words),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column "measures" of all measures; words are split once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    m = lambda w: metrics(whole, w)
    of_words = let(words_of(whole), lambda w: F.struct(*[m(w)[k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words")]))
    symbols = F.struct(F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    return docs.withColumn("measures", F.struct(of_words.alias("w"), line_counts(whole).alias("l"), symbols.alias("s")))


@dataclass(frozen=True)
class Rule:
    """reject: from a text's measures to the condition under which the text goes."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


#: Thresholds are shares of words or lines, so they hold at any length of text.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_phrases", lambda m: m["mostly_repeated"]),
    Rule("many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("odd_word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", lambda m: let(m["lines"], lambda c: 2 * c["n_dup_lines"] > c["n_lines"])),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, times: int = TIMES) -> list[Estimate]:
    """Time what each rule costs beyond the splitting of words, which rules share, and count what it rejects.

    Over sample_rows rows at most, each taken so many times, after a first untimed run (code generation) and less what the
    same job takes without a rule (start-up).
    """
    total = docs.count()
    if not total:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    share = min(1.0, 2.0 * sample_rows / total)
    whole = F.coalesce(F.col(text), F.lit(""))
    sample = docs.select(whole.alias("text")).sample(fraction=share, seed=7).limit(sample_rows).select("text", words_of(F.col("text")).alias("words")).cache()
    found = []
    try:
        n = max(sample.count() * times, 1)
        again = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("time"))

        def run(hit: Column) -> tuple[int, float]:
            job = again.where(F.coalesce(hit, F.lit(False))).agg(F.count(F.lit(1)))
            job.first()
            began = time.perf_counter()
            return job.first()[0], time.perf_counter() - began

        # a condition that reads the rows and is never optimised away
        _, idle = run(F.size("words") + F.col("time") < 0)
        for rule in rules:
            hits, seconds = run(rule.reject(metrics(F.col("text"), F.col("words"))))
            found.append(Estimate(rule.name, max(seconds - idle, 1e-6) / n, hits / n))
    finally:
        sample.unpersist()
    return found


def in_order(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: -worth[r.name])


def first_rejection(rules: Sequence[Rule], m: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated for that row."""
    chain = None
    for rule in rules:
        hit = F.coalesce(rule.reject(m), F.lit(False))
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, rejected_by: str = "rejected_by") -> DataFrame:
    """docs with the name of the rule that rejects each row (null: kept). Words are split once; all else is evaluated for the
    rows that no earlier rule has rejected."""
    order = in_order(rules, estimate(docs, rules, text, sample_rows))
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(rejected_by, let(words_of(whole), lambda w: first_rejection(order, metrics(whole, w))))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with all measures (struct "measures") and "rejected_by": the cascade over measures that are needed anyway."""
    order = in_order(rules, estimate(docs, rules, text, sample_rows))
    m = {k: F.col(f"measures.{part}.{k}") for part, names in (("w", ("n_words", "word_chars", "n_repeat_words")), ("s", ("n_symbols",))) for k in names}
    m |= {"lines": F.col("measures.l"), "mostly_repeated": 100 * m["n_repeat_words"] > 50 * m["n_words"]}
    return measured(docs, text).withColumn("rejected_by", first_rejection(order, m))
