"""Operators on odd rows against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casegraph.llm import bpe, fingerprints, lm_scores, packing, paragraph_dedup, quality, simhash, suffix_dedup, token_counts, token_files
from casegraph.llm.components import components
from casegraph.llm.order import bounds_of, bucket_of
from casegraph.llm.workspace import Workspace

from .helpers import clashing, no_documents, odd_documents, odd_rows, same, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_order_and_next(spark):
    df = spark.createDataFrame([(i,) for i in (5, 9, -3, 70, 12, 12, 40)], "k long")
    bounds = bounds_of(df, "k", 3)
    assert bounds[-1] == 70
    assert {r.k: r.b for r in df.select("k", bucket_of(F.col("k"), bounds).alias("b")).collect()} == {k: sum(b < k for b in bounds) for k in (5, 9, -3, 70, 12, 40)}


def test_fingerprints(spark):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    known = [r for r in rows if r[0] is not None]
    found = fingerprints.edited_fingerprints(clashing(odd_documents(spark))).collect()
    assert len(found) == len(rows)
    want = Counter()
    for i, (k, t) in enumerate(known[:-1]):  # what follows a null key depends on a hash
        half = len(t) // 2
        want[k, t[: len(t) - half] + known[i + 1][1][:half]] += 1
    got = Counter((r.doc_id, r.edited) for r in found if r.doc_id is not None and r.doc_id != known[-1][0])
    assert got == want
    by_text = defaultdict(set)
    for r in found:
        by_text[r.text].add(tuple(r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert fingerprints.edited_fingerprints(no_documents(spark)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited == "a b c d a b c"[:8] + "a b c d " [:7]


def winnowed(text, gram=5, window=4):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    if not words:
        return []
    grams = [tuple(words[i : i + gram]) for i in range(max(1, len(words) - gram + 1))]
    return grams


def brute_winnow(text, gram=5, window=4):
    """(hash, position) pairs of a text, by definition: every k-gram's polynomial, every window's least, rightmost of ties."""
    words = [m.encode() for m in re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")]
    each = [(xxhash.xxh64_intdigest(w, seed=42) >> 31) % (fingerprints.MODULUS - 1) + 1 for w in words]
    each += [0] * (gram - len(each)) if words else []
    found = [sum(h * fingerprints.BASE ** (gram - 1 - j) for j, h in enumerate(each[i : i + gram])) % fingerprints.MODULUS for i in range(len(each) - gram + 1)]
    chosen = set()
    for i in range(max(1, len(found) - window + 1) if found else 0):
        near = list(enumerate(found[i : i + window], i))
        least = min(h for _, h in near)
        chosen.add((least, max(p for p, h in near if h == least)))
    return chosen


@pytest.mark.parametrize("gram", [1, 3, 5, 8])
def test_fingerprints_by_definition(spark, gram):
    """Hashes, positions and rightmost ties, also of texts whose k-grams come again within a window."""
    rng = random.Random(5)
    again = [" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 40, 200)] + ["a " * 50, "a b " * 30, "a b c", "a b d", "b a c"]
    df = spark.createDataFrame(list(enumerate([*texts(), *again])), "id long, text string")
    shown = fingerprints.positions(fingerprints.winnow(F.col("text"), gram=gram))
    found = {r.id: [(x.hash, x.position) for x in r.p] for r in df.select("id", shown.alias("p")).collect()}
    for i, t in enumerate([*texts(), *again]):
        want = brute_winnow(t, gram)
        assert set(found[i]) == want and len(found[i]) == len(want), t


def test_likeness_by_definition(spark):
    """The edited text, its likeness and that of the next document, against sets of hashes."""
    rows = [(7 * i % 101, t) for i, t in enumerate(texts())]
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    ordered = sorted(((k, t or "") for k, t in rows), reverse=True)
    hashes = lambda t: {h for h, _ in brute_winnow(t)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (k, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert found[k].edited == edited
        assert abs(found[k].near_edited - like(hashes(t), hashes(edited))) < 1e-12
        assert abs(found[k].near_next - like(hashes(t), hashes(following))) < 1e-12


def test_match_guarantee(spark):
    """Texts that share gram + window - 1 words in a row share a chosen hash; chosen positions are minima of their windows."""
    shared = " ".join(f"shared{i}" for i in range(8))
    df = spark.createDataFrame([(1, "one two three " + shared + " four"), (2, "x y " + shared + " z q r s t u v w")], "doc_id long, text string")
    a, b = (set(r.h) for r in df.orderBy("doc_id").select(fingerprints.hashes(fingerprints.winnow(F.col("text"))).alias("h")).collect())
    assert a & b
    rows = df.orderBy("doc_id").select("text", fingerprints.positions(fingerprints.winnow(F.col("text"))).alias("p"), fingerprints.positions(fingerprints.winnow(F.col("text"), window=1)).alias("each")).collect()
    for r in rows:
        grams = winnowed(r.text)
        every = {x.position: x.hash for x in r.each}
        assert len(every) == len(grams)
        chosen = set()
        for i in range(len(grams) - 3):
            least = min(every[j] for j in range(i, i + 4))
            chosen.add(max(j for j in range(i, i + 4) if every[j] == least))
        assert {x.position for x in r.p} == chosen
    with pytest.raises(ValueError):
        fingerprints.winnow(F.col("text"), window=3)


def test_quality(spark):
    def measures(t):
        t = t or ""
        w = WORD.findall(t)
        ls = [x for x in t.split("\n") if WORD.search(x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov), len(ls)

    found = quality.quality_report(clashing(odd_documents(spark)).drop("measures", "rejected_by")).collect()
    same([(r.doc_id, r.measures.w.n_words, r.measures.w.word_chars, r.measures.s.n_symbols, r.measures.l.n_dup_lines, r.measures.w.n_repeat_words, r.measures.l.n_lines) for r in found], [(r[0], *measures(r[1])) for r in odd_rows()])
    lazily = quality.quality_cascade(odd_documents(spark), rejected_by="why")
    kept = lambda n, wc, sy, du, re_, nl: not (n < 50 or 100 * re_ > 50 * n or 10 * sy > n or wc < 2 * n or wc > 15 * n or 2 * du > nl)
    same([(r.doc_id, r.text, r.why is None) for r in lazily.collect()], [(r[0], r[1], kept(*measures(r[1]))) for r in odd_rows()])
    assert quality.quality_cascade(no_documents(spark)).count() == 0
    estimates = [quality.Estimate("slow", 2.0, 0.9), quality.Estimate("fast", 0.1, 0.5), quality.Estimate("idle", 0.1, 0.0)]
    rules = [quality.Rule(n, lambda m: F.lit(True)) for n in ("slow", "idle", "fast")]
    assert [r.name for r in quality.in_order(rules, estimates)] == ["fast", "slow", "idle"]


def test_bpe_round_trip(spark, library):
    found = clashing(odd_documents(spark)).select("doc_id", "text", bpe.encode(F.col("text")).alias("ids"), bpe.round_trip(F.col("text")).alias("r")).withColumn("back", bpe.decode(F.col("ids"))).collect()
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.r.n_tokens == len(ids)
        assert r.r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.back == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert no_documents(spark).select(bpe.round_trip(F.col("text"))).count() == 0
    model = bpe.merge_rounds(bpe.default_path())
    assert model.decode(model.start[list("é".encode())][:1].tolist()) == "�"


def test_packing(spark, library):
    docs = odd_documents(spark)
    found = packing.packed_documents(clashing(docs), capacity=128, with_ids=True).collect()
    want = []
    for k, t, *_ in odd_rows():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for i, (start, n) in enumerate(packing.cut(len(ids), 128)):
            want.append((k, i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], want)
    rows = defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length
        rows[r.sequence_id].append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 128
    assert len(rows) <= -(-sum(w[3] for w in want) // 128) + 1
    assert packing.packed_documents(no_documents(spark)).count() == 0
    zero = packing.pack(spark.createDataFrame([(1, 0), (2, None), (3, 5)], "k long, length long"), ["k"], capacity=8).orderBy("k").collect()
    assert [(r.sequence_id, r.offset) for r in zero] == [(None, 0), (None, 0), (0, 0)]


def test_plan_fills_exactly():
    slots = packing.plan({600: 3, 424: 3, 500: 2, 300: 2, 224: 2, 1024: 5, 700: 1, 200: 1, 100: 1, 24: 1}, 1024)
    assert max(s.sequence + s.count for s in slots) == 3 + 2 + 5 + 1
    assert packing.plan({}, 1024) == [] and packing.cut(0) == [(0, 0)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_suffix_dedup(spark):
    rows = odd_rows()
    octets = [(r[1] or "").encode() for r in rows]
    for length in (40, 200):
        starts = Counter(b[p : p + length] for b in octets for p in range(len(b) - length + 1))
        want = []
        for r, b in zip(rows, octets, strict=True):
            gone = [False] * len(b)
            for p in range(len(b) - length + 1):
                if starts[b[p : p + length]] > 1:
                    gone[p : p + length] = [True] * length
            left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            want.append((r[0], r[3], len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        for crowd in (64, 1):
            found = suffix_dedup.cut(clashing(odd_documents(spark)), length=length, gram=min(64, length // 2), crowd=crowd, block_chars=3000)
            assert "rest" in found.columns and "block" in found.columns
            same([(r.doc_id, r.source, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in found.collect()], want)
    assert suffix_dedup.cut(no_documents(spark)).count() == 0


def test_levels_double():
    levels = suffix_dedup.Levels(20)
    for i in range(9):
        levels.add([(b"", f"{i:03d}".encode() * 7)])
    sizes = [len(x[1]) for x in levels.levels]
    assert sum(sizes) == 9 and len(sizes) <= 4 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert all(x[0] == sorted(x[0]) for x in levels.levels)


def test_token_counts(spark):
    scores = token_counts.vocabulary(token_counts.default_path())
    longest, byte = max(map(len, scores)), min(scores.values()) - 10

    def best(word):
        table = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(table[-1][0] + n * byte, -table[-1][1] - n)]
            options += [(table[s][0] + scores[word[s:end]], -table[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            score, pieces = max(options)
            table.append((score, -pieces))
        return table[-1]

    for r in token_counts.token_counts(clashing(odd_documents(spark))).join(odd_documents(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        words = WORD.findall(r.text or "")
        found = [best("▁" + w) for w in words]
        if sum(x[0] == r.doc_id for x in odd_rows()) == 1:
            assert r.n_words == len(words) and r.n_tokens == sum(n for _, n in found) and math.isclose(r.log_score, sum(s for s, _ in found), abs_tol=1e-6)
    assert token_counts.token_counts(no_documents(spark)).count() == 0
    trie = token_counts.Trie({"a": -1.0, "b": -1.0, "ab": -1.5, "abb": -2.5})
    assert trie.insert("ab") == (1, -1.5) and trie.nodes == 2
    assert trie.insert("abb") == (1, -2.5) and trie.nodes == 3  # of equal scores the one with fewer pieces; one new node
    rng = np.random.default_rng(6)
    full = token_counts.Trie(scores)
    for n in (1, 5, 40, 3000):
        word = "".join(rng.choice(list("etaoinsé漢")) for _ in range(n))
        assert full.along(word) == full.insert(word) == best(word)[::-1]
    small = token_counts.Trie(scores, most=50)  # starts anew again and again, with the same results
    texts = ["".join(rng.choice(list("etaoin")) for _ in range(9)) + " again and again" for _ in range(60)] + ["x" * 5000]
    assert small.count(texts) == token_counts.Trie(scores).count(texts) and small.nodes < 200


def test_long_words(spark, library):
    """Words of thousands of letters, which are merged rank by rank, among short ones."""
    rng = np.random.default_rng(8)
    model = bpe.merge_rounds(bpe.default_path())
    texts = ["".join(rng.choice(list("abcdefthe漢é")) for _ in range(n)) for n in (257, 400, 3000)] + ["a" * 1001, "ab" * 700 + " short words too", "ha" * 600 + "h " + "x" * 300]
    found = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [model.decode(x) for x in found] == texts


def test_plan_uses_pairs_and_triples():
    """Gaps are filled by pairs and triples where there are enough of them, and no plan is worse than best fit alone."""
    counts = {700: 40, 200: 100, 124: 100, 108: 300, 624: 30, 100: 200, 300: 30}
    by = defaultdict(list)
    for s in packing.plan(counts, 1024):
        by[s.sequence].append((s.length, s.count))
    kinds = Counter()
    for group in by.values():
        if sum(n for n, _ in group) == 1024:
            kinds[len(group)] += group[0][1]
    assert kinds[3] and kinds[4]
    assert sum(g[0][1] for g in by.values()) <= max(s.sequence + s.count for s in packing.plan(counts, 1024, kept=1.0))


def test_lm_scores(spark):
    rows = odd_rows()
    split = [(r[1] or "").encode().lower().split() for r in rows]
    one, two = Counter(w for s in split for w in s), Counter(p for s in split for p in zip(s, s[1:], strict=False))
    total = sum(one.values())
    want = []
    for r, words in zip(rows, split, strict=True):
        mine, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
        n, score, backed = max(1, total - len(words)), 0.0, 0
        for i, w in enumerate(words):
            alone = math.log(max(1, one[w] - mine[w]) / n)
            both = two[words[i - 1], w] - pairs[words[i - 1], w] if i else 0
            if not i:
                score += alone
            elif both > 0:
                score += math.log(both / max(1, one[words[i - 1]] - mine[words[i - 1]]))
            else:
                score += math.log(0.4) + alone
                backed += 1
        want.append((r[0], len(words), round(score, 6), backed))
    found = lm_scores.scores(clashing(odd_documents(spark)), block_chars=2000).collect()
    same([(r.doc_id, r.n_words, round(r.log_score, 6), r.n_backed_off) for r in found], want)
    assert lm_scores.scores(no_documents(spark)).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_scores_of_orders(spark, order):
    """Backoff takes one step an order; the registered query counts trigrams. N-grams with a part found once are not sent."""
    rows = odd_rows()
    split = [(r[1] or "").encode().lower().split() for r in rows]
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    mine = [grams(ws) for ws in split]
    everyone, total, want = sum(mine, Counter()), sum(map(len, split)), []
    for r, ws, own in zip(rows, split, mine, strict=True):
        others = lambda g, own=own: everyone[g] - own[g]
        score = backed = 0
        for i in range(len(ws)):
            top = n = min(order, i + 1)
            while n > 1 and not others(tuple(ws[i - n + 1 : i + 1])):
                n -= 1
            count = max(1, others(tuple(ws[i - n + 1 : i + 1])))
            score += (top - n) * math.log(0.4) + math.log(count / max(1, others(tuple(ws[i - n + 1 : i])) if n > 1 else total - len(ws)))
            backed += n < top
        want.append((r[0], len(ws), round(score, 6), backed))
    found = lm_scores.scores(odd_documents(spark), order=order, block_chars=2000).collect()
    same([(r.doc_id, r.n_words, round(r.log_score, 6) + 0.0, r.n_backed_off) for r in found], [(k, n, x + 0.0, b) for k, n, x, b in want])


def test_lm_scores_send_what_comes_again():
    """An n-gram is counted unless it begins or ends with a shorter one that the corpus has once."""
    block = lm_scores._Block.of_texts(["a b c d a b c e", "x a b c x"])
    words, texts = block.first(), [b"a b c d a b c e".split(), b"x a b c x".split()]
    pairs = block.longer(2, words, words.counts)
    assert pairs.counts.sum() == sum(1 for ws in texts for p in zip(ws, ws[1:], strict=False) if not {b"d", b"e"} & set(p))
    threes = block.longer(3, pairs, pairs.counts)
    assert len(threes.distinct) == 1 and threes.counts.tolist() == [3]


def test_lm_scores_move_no_blocks(spark):
    """Blocks and answers are bucketed alike: scoring joins them without a shuffle."""
    found = lm_scores.scores(odd_documents(spark), order=3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


def brute_runs(rows):
    """(key, first word, run) of every run of 25 words; those of equal runs that stand in 50 equal words have to be found."""
    out = defaultdict(list)
    for k, t in rows:
        words = [(p, w) for p, line in enumerate((t or "").split("\n")) for w in line.encode().lower().split()]
        for i in range(len(words) - 24):
            out[b" ".join(w for _, w in words[i : i + 25])].append((k, i, words[i][0]))
    return out


def test_paragraphs(spark):
    found = paragraph_dedup.duplicate_paragraphs(clashing(odd_documents(spark)), least=5)
    by = defaultdict(list)
    for k, t, *_ in odd_rows():
        for place, words in paragraph_dedup.paragraphs(t or "", 5):
            by[b" ".join(words)].append((k, place))
    keys = list(by)
    sets = [frozenset(paragraph_dedup.shingles(k.split())) for k in keys]
    group = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = defaultdict(list)
    for g, k in zip(group, keys, strict=True):
        members[g] += by[k]
    want = [o for m in members.values() if len(m) > 1 for o in m]
    rows = found.collect()
    same([(r.doc_id, r.paragraph) for r in rows if r.passage is None], want)
    for r in rows:
        if r.passage is None:
            assert r.removed == ((r.doc_id, r.paragraph) != (r.first_doc_id, r.first_paragraph))
    # every run that is found has an equal one, and every text with one in 50 equal words has a row
    runs = brute_runs([r[:2] for r in odd_rows()])
    again = {(k, i, p) for places in runs.values() if len(places) > 1 for k, i, p in places}
    got = {(r.doc_id, r.passage, r.paragraph) for r in rows if r.passage is not None}
    assert got and got <= again
    assert {r.doc_id for r in rows if r.passage is not None} >= {k for k, *_ in again} - {r[0] for r in odd_rows() if len((r[1] or "").split()) < 50}
    assert paragraph_dedup.duplicate_paragraphs(no_documents(spark)).count() == 0
    bands, per = paragraph_dedup.tune()
    assert 1 - (1 - 0.8**per) ** bands >= 0.99
    with pytest.raises(ValueError):
        paragraph_dedup.tune(0.3, 0.999, (0.29, 0.001))


def test_chosen_runs():
    """The least hash of every span, the last of equal ones, and none over the border of two texts."""
    rng = np.random.default_rng(2)
    owner = np.repeat(np.arange(4), (30, 50, 200, 400))
    hashed = rng.integers(0, 20, len(owner) - paragraph_dedup.WINDOW + 1).astype(np.uint64)
    want = set()
    for start in range(len(hashed) - 25):
        if owner[start] == owner[start + 49]:
            span = hashed[start : start + 26]
            want.add(start + max(i for i in range(26) if span[i] == span.min()))
    assert paragraph_dedup._chosen(hashed, owner).tolist() == sorted(want)


def test_passage_within_paragraphs(spark):
    """50 words in a row that two texts share are found wherever they stand, over line breaks too."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows, pairs = [], 0
    for i in range(20):
        passage = word(50)
        rows += [(10 * i, f"{word(i)} {passage} {word(40)}"), (10 * i + 1, f"{word(3)}\n{word(2 * i)} {passage.replace(' ', chr(10), 3)} end")]
        pairs += 1
    rows += [(1000 + i, word(300)) for i in range(20)]
    found = paragraph_dedup.duplicate_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows if r[0] < 1000} and all(r.passage is not None for r in found)
    assert {r.doc_id for r in found if r.removed} == {r[0] for r in rows if r[0] < 1000 and r[0] % 10}


def test_large_groups_of_paragraphs(spark):
    """A band's group beyond a chunk: compared with its first paragraph, then the rest with all."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)] + [(100 + i, " ".join(f"q{i}x{j}" for j in range(30))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    work = Workspace(spark, "test")
    bands, per = paragraph_dedup.tune()
    units = work.table(df.select(F.col("doc_id").alias("doc"), "text").mapInArrow(paragraph_dedup._units(bands, per, 20), "doc bigint, place int, at int, key binary, n_words int, bands array<bigint>"), "units").where("at IS NULL")
    for chunk in (4, 256):
        near = paragraph_dedup.links(units, df, "text", 0.8, 20, work, chunk)
        parts = components(near, work).groupBy("component").count().collect()
        assert [r["count"] for r in parts] == [30]


def test_token_files(spark, library, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write(clashing(odd_documents(spark)), folder)
    rows = token_files.read(spark, folder).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    same([(r.key, list(r.ids)) for r in rows], [(r[0], ids(r[1])) for r in odd_rows()])
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    keys = [r.key for r in sorted(rows, key=lambda r: r.start)]
    assert [k for k in keys if k is not None] == sorted(k for k in keys if k is not None) and keys[-2:] == [None, None]
    alone = [r for r in odd_rows() if sum(x[0] == r[0] for x in odd_rows()) == 1][:3]
    assert token_files.fetch(spark, folder, [r[0] for r in alone]) == {r[0]: ids(r[1]) for r in alone}
    empty = str(tmp_path / "none")
    token_files.write(no_documents(spark), empty)
    assert token_files.read(spark, empty, checksums=True).count() == 0


def brute_fingerprint(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_simhash(spark):
    rows = odd_rows()
    codes = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    found = simhash.near_duplicates(clashing(odd_documents(spark))).select("doc_id", simhash.as_hex(F.col("code")).alias("hex"), "component_id").collect()
    same([tuple(r) for r in found], [(r[0], f"{c:016x}", least[g]) for r, c, g in zip(rows, codes, group, strict=True)])
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_bk_tree_and_large_shards(spark):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    codes += [c ^ (1 << int(b)) for c in codes[:50] for b in rng.integers(0, 64, 3)]
    tree = simhash.BKTree()
    for c in codes:
        tree.add(c)
    for q in codes[::37]:
        assert set(tree.within(q, 4)) == {c for c in codes if (c ^ q).bit_count() <= 4}
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in set(codes)], "code long")

    def parts(shard):
        links = [(r.a, r.b) for r in simhash.links(df, 4, Workspace(spark, "test"), shard).collect()]
        name = {r.code: r.code for r in df.collect()}
        for a, b in links:
            x, y = name[a], name[b]
            name = {k: (x if v == y else v) for k, v in name.items()}
        return Counter(Counter(name.values()).values())

    assert parts(1024) == parts(4)  # shards cut into chunks give the same components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(5, 5), (None, 3), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0
