"""Reviewed agreements, the pages of a case map, review items and page sources on odd rows."""

import json

from casegraph.operators import agreements, projections, relational
from casegraph.sources import tables

REVIEW = "agreement_id string, clause_id string, support_status string, finding string, authority_ids array<string>"


def test_reviews_cite_what_their_own_clause_was_offered(spark):
    reviews = [
        ("a", "1", "supported", "f", [" N2 ", "N1", "N2", "N9", None, ""]),
        ("a", "2", "supported", "f", ["N1"]),  # offered to clause 1 alone
        ("b", "1", "supported", None, None),
        ("b", "2", "partial", "f", []),
        ("b", "3", None, "f", ["N3"]),
    ]
    offered = [("a", "1", "N1"), ("a", "1", "N2 "), ("a", "1", "N2"), ("b", "3", "N3"), ("b", "3", None), ("b", "3", " ")]
    rows = agreements.grounded_reviews(spark.createDataFrame(reviews, REVIEW), spark.createDataFrame(offered, "agreement_id string, clause_id string, node_id string"), ["agreement_id", "clause_id"], "none")
    got = {(r.agreement_id, r.clause_id): (r.support_status, r.finding, r.authority_ids) for r in rows.collect()}
    assert got == {
        ("a", "1"): ("supported", "f", ["N2", "N1"]), ("a", "2"): ("unsupported", "none", []), ("b", "1"): ("unsupported", "none", []),
        ("b", "2"): ("partial", "f", []), ("b", "3"): (None, "f", ["N3"]),
    }
    assert rows.count() == len(reviews)


def test_synthesis_groups_take_every_review_once_in_order(spark):
    rows = [("a", i, "x" * (40 * i)) for i in range(1, 7)] + [("b", 1, "y" * 900)]
    found = agreements.synthesis_groups(spark.createDataFrame(rows, "agreement_id string, ord int, finding string"), "agreement_id", "ord", 300, 400).collect()
    by = {(r.agreement_id, r.group_no): [json.loads(x)["finding"] for x in r.reviews] for r in found}
    assert [x for k in sorted(by) for x in by[k]] == [r[2] for r in rows]
    assert all(len(v) == 1 or sum(len(x) + len('{"finding":""}') for x in v) <= 300 for v in by.values())
    assert len(by["a", 1]) > 1 and by["b", 1] == ["y" * 900]


def test_keep_last_holds_the_first_place(spark):
    rows = [("k", 3, "c", "z"), ("k", 1, "a", "x"), ("k", 3, "d", "y"), (None, 5, None, None), ("j", 2, "b", None)]
    found = relational.keep_last(spark.createDataFrame(rows, "k string, at int, v string, w string"), ["k"], "at")
    assert {tuple(r) for r in found.select("k", "v", "w", "first_at").collect()} == {("k", "d", "y", 1), (None, None, None, 5), ("j", "b", None, 2)}


def brute_map(pages, most, total):
    """The records of a case in order, by reading one page after another."""
    kept, used = [], 0
    lists = projections.MAP_LISTS
    for p in pages:
        p = {k: ([] if k in lists else "") if v is None and k != "page_number" else v for k, v in p.items()}
        if not p["summary"].strip():
            continue
        size = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
        record, form = {k: p.get(k, []) for k in ("page_id", "page_number", "document_type", "document_language", "summary", *lists)}, 1
        if size(record) > most:
            record, form = {**record, "summary": p["summary"][:900], **{k: record[k][:n] for k, n in lists.items()}}, 2
        if size(record) > most:
            record, form = {"page_id": p["page_id"], "page_number": p["page_number"], "document_type": p["document_type"], "summary": p["summary"][:700], "key_facts": record["key_facts"][:4]}, 3
        if used + size(record) > total:
            break
        used += size(record)
        kept.append((form, record))
    return kept


def test_map_pages_shrink_in_two_stages_and_stop_at_the_budget(spark):
    facts = [f"fact {i} “é😀" for i in range(9)]
    page = lambda i, summary, claims=None, key_facts=None: {"page_id": f"p{i}", "page_number": i, "document_type": None if i == 2 else "letter", "document_language": "ar", "summary": summary, "claims": claims, "key_facts": key_facts}
    pages = [page(1, "short", ["c"], facts), page(2, "s" * 2500, ["c"] * 9, facts), page(3, None), page(4, " \n\t"), page(5, "t" * 2500, ["c" * 400] * 9, ["f" * 100] * 9), page(6, "quote \" and \\ back", [], facts), page(7, "u" * 9000, [], ["g" * 9000]), page(8, "after the budget", [], [])]
    schema = "case_id string, page_id string, page_number int, document_type string, document_language string, summary string, claims array<string>, key_facts array<string>"
    rows = [(c, *p.values()) for c in ("a", "b") for p in (pages if c == "a" else pages[::-1])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + schema)
    found = projections.map_pages(df, "case_id", "ord", 2000, 8000).orderBy("ord").collect()
    for case, ordered in (("a", pages), ("b", pages[::-1])):
        want = brute_map(ordered, 2000, 8000)
        assert [(r.form, json.loads(r.record)) for r in found if r.case_id == case] == want
    assert {r.form for r in found} == {1, 2, 3} and len([r for r in found if r.case_id == "a"]) == 4
    assert projections.map_pages(df.limit(0), "case_id", "ord").count() == 0


def test_review_items_cut_texts_and_lists(spark):
    rows = [(1, " " + "a" * 300, "b" * 3000, list(range(40)), "kept"), (2, None, None, None, None)]
    items = spark.createDataFrame(rows, "id int, title string, full_text string, numbers array<int>, other string")
    one, two = projections.review_items(items, ["id"]).orderBy("id").collect()
    assert one.asDict() == {"id": 1, "title": "a" * 250 + "…", "numbers": list(range(25)), "other": "kept"}
    assert two.asDict() == {"id": 2, "title": "", "numbers": None, "other": None}


def test_page_sources_are_read_in_order(spark):
    rows = [("c", "p3", "D2", "2", " \n text\t"), ("c", "p1", "D2", "x", "y"), ("c", "p2", "D1", "9", "z"), ("c", "p4", "D1", "1", " "), ("c", "p5", "D1", "1", None), ("d", "p6", None, None, "w")]
    pages = spark.createDataFrame(rows, "case_id string, page_id string, case_document_id string, page_number string, page_text string")
    shown = lambda df: [(r.page_id, r.page_number, r.page_text, r.place, r.page_image_mime_type) for r in df.orderBy("case_id", "place").collect()]
    assert shown(tables.page_sources(pages, "case_id")) == [("p2", 9, "z", 1, "image/png"), ("p1", 0, "y", 2, "image/png"), ("p3", 2, "text", 3, "image/png"), ("p6", 0, "w", 1, "image/png")]
    assert shown(tables.page_sources(pages, "case_id", ["D2"])) == [("p1", 0, "y", 1, "image/png"), ("p3", 2, "text", 2, "image/png")]
    assert shown(tables.page_sources(pages, "case_id", [])) == []


def test_classification_reads_both_ends_and_a_stride(spark):
    rows = [("long", f"{i:04}", "D", i, f"text {i}" * 1000, "sum" if i % 2 else " ") for i in range(400)] + [("short", "q", None, 1, "t", None)]
    pages = spark.createDataFrame(rows, "agreement_id string, page_id string, document_id string, page_number int, page_text string, page_summary string")
    found = agreements.classification_material(pages, "agreement_id").collect()
    step = (400 - 50) // 30
    want = sorted({*range(30), *range(380, 400), *list(range(30, 380, step))[:30]})
    assert sorted(r.page_number for r in found if r.agreement_id == "long") == want
    assert all(r.text == ("sum" if r.page_number % 2 else (f"text {r.page_number}" * 1000)[:3500]) for r in found if r.agreement_id == "long")
    assert [r.text for r in found if r.agreement_id == "short"] == ["t"]
