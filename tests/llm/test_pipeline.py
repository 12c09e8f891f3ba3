"""The pipeline and the registered queries against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from casegraph.llm import bpe, near_texts, packing
from pyspark.sql import functions as F

from .helpers import clashing, no_documents, odd_documents, odd_rows, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_rules(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    n, chars = len(w), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    return not (n < 50 or 2 * len(covered) > n or 10 * symbols > n or not 2 * n <= chars <= 15 * n or 2 * (len(lines) - len(set(lines))) > len(lines))


def one_of_each(rows, key=lambda r: r[0]):
    """Rows (doc_id, text, ...) of which near copies (five-word shingles, 0.8) leave the one of least id."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def without_repeats(rows, length=200):
    octets = [(r[1] or "").encode() for r in rows]
    starts = Counter(b[p : p + length] for b in octets for p in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, octets, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], left.decode("utf-8", "ignore"), *r[2:]))
    return out


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = without_repeats(one_of_each([r for r in docs if kept_by_rules(r[1])]))
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for k, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want += [(k, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    found = corpus_pipeline.run(spark, sf).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_on_odd_rows(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_documents(spark)
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    same([(r.doc_id, r.text) for r in kept.collect()], [r[:2] for r in odd_rows() if kept_by_rules(r[1])])
    alone = corpus_pipeline.near_dedup(spark, docs, sf)
    # a null and an empty text are equal, as are all that have no words
    assert sorted(r.text or "" for r in alone.collect()) == sorted(r[1] or "" for r in one_of_each([(r[0], r[1] or "") for r in odd_rows()]))
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, sf)
    same([(r.doc_id, r.text, r.source, r.n_chars) for r in cut.collect()], [(r[0], r[1], r[3], len(r[1])) for r in without_repeats(odd_rows())])
    for df in (kept, alone, cut):
        assert df.columns == columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents(spark), sf).count() == 0
        stage(spark, clashing(docs), sf).write.format("noop").mode("overwrite").save()


def test_near_copies_in_chunks(spark):
    """One large group of near copies, cut into chunks, still leaves one row; texts below 0.8 stay."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"changed{i}"] + base[i + 1 :])) for i in range(40)]
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(60))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (4, 512):
        assert sorted(r.doc_id for r in near_texts.one_of_each(df, chunk=chunk).collect()) == [0, *range(100, 110)]


def test_appended_and_truncated_near_copies(spark):
    """Pairs at 0.8 or more whose word sets differ much: every one is found, and none just below 0.8."""
    rng, rows, n = np.random.default_rng(5), [], 0
    words = lambda k, tag: [f"{tag}{w}" for w in np.minimum(rng.zipf(1.3, k), 3000)]
    for size, more in ((300, 0.24), (300, 0.15), (1000, 0.24), (1000, 0.11), (300, 0.3)):
        for i in range(6):
            base = words(size, f"t{n}x")
            extra = words(int(size * more), f"u{n}x")
            rows += [(n, " ".join(base)), (n + 1, " ".join(base + extra if i % 2 else extra + base))]
            n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [r[0] for r in one_of_each(rows)]
    assert len(rows) * 0.5 < len(want) < len(rows) * 0.7
    assert sorted(r.doc_id for r in near_texts.one_of_each(df, chunk=4).collect()) == sorted(want)


def test_op_queries(spark, sf):
    """Every numbered query is there, covers every document and has the columns of its contract."""
    columns = {
        1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        2: "doc_id piece start length ids_crc32 sequence_id offset",
        3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        4: "doc_id n_tokens ids_sha256 decoded_sha256",
        5: "doc_id n_bytes n_removed n_spans kept_sha256",
        6: "doc_id n_words n_tokens log_score",
        7: "doc_id n_words log_score n_backed_off",
        8: "doc_id paragraph passage first_doc_id first_paragraph removed",
        9: "doc_id start n_tokens ids_crc32",
        10: "doc_id fingerprint component_id",
    }
    queries = entry.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, names in columns.items():
        (name,) = [q for q in queries if q.startswith(f"op{n}_")]
        df = queries[name](spark, sf)
        assert set(names.split()) <= set(df.columns), name
        if n != 8:
            assert df.select("doc_id").distinct().count() == docs.count(), name
    assert "pipeline" in queries
    shares = queries["op1_fingerprints"](spark, sf).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()[0]
    assert shares > 0.9
