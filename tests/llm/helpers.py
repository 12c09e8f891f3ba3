"""Small tables with the odd cases that every operator has to take."""

import random
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(60, 200)) for _ in range(12)]
    passage = prose(70)
    near = base[0].split()
    near[30] = "changed"
    out = [*base, base[0], base[0], base[1], " ".join(near), prose(30) + " " + passage + " " + prose(20), prose(50) + "\n" + passage + "\n" + prose(10), None, "", " \n\t ", "word", "a b c d", "x" * 300, "same line here for all\n" * 9, prose(6000), "MiXed Case WORDS", "emoji 😀 漢字 <|endoftext|> end", "### $$$ %%% " * 40]
    return out


def odd_rows():
    """Documents with nulls in any column, repeated rows and ids out of order."""
    found = [(7 * i % 101, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    return [*found, found[3], found[3], (None, "no id at all, but a text", None, None, None), (None, None, None, None, None)]


def odd_documents(spark, parts=3):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(parts)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """More columns, with names that operators use inside."""
    return docs.withColumns({c: F.lit(1) for c in ("key", "code", "block", "length", "piece", "rejected_by", "component", "row", "id", "part", "words", "rest", "measures", "a", "b")})


def same(rows, want):
    assert Counter(map(repr, rows)) == Counter(map(repr, want))
