"""Restored states, evidence to ask for, evidence groups, case data and hot keys on odd rows."""

import json

from pyspark.sql import functions as F

from casegraph.operators import cases, claims, relational, review, workflow
from casegraph.sources import tables

AUDITS = "case_id string, entity_type string, new_value_json string, event_at string, actor string"
APPROVALS = "case_id string, approved_by string, summary_json string, timestamp string"


def test_restored_state(spark):
    known = spark.createDataFrame([(c,) for c in ("a", "b", "c", "d", "e", "a")], "case_id string")
    audits = [
        ("a", "case_workflow", '{"memo":{"x":1},"strategy":true,"stages":7}', "1", "u"),
        ("a", "case_workflow", '{"memo":"text","accounting_status":null,"summary_approved":true,"other":1}', "2", "u"),
        ("a", "case_workflow", "broken", "3", "u"),
        ("a", "case_summary", '{"s":1}', "9", "u"),
        ("b", "case_summary", '{"s":2}', "1", "first"),
        ("b", "case_summary", "[]", "2", "last"),
        ("c", "case_summary", '{"s":3}', "1", "u"),
        ("d", "case_workflow", None, "1", "u"),
        ("x", "case_workflow", "{}", "1", "u"),
    ]
    approvals = [("c", "UI_STATE_MANAGER", '{"pleading_versions":[1],"stages":{"review":{}}}', "1"), ("b", "someone", '{"memo":1}', "1"), ("a", "UI_STATE_MANAGER", '{"memo":2}', "1")]
    found = {r["case_id"]: r for r in workflow.restored_state(known, spark.createDataFrame(audits, AUDITS), spark.createDataFrame(approvals, APPROVALS), "case_id").collect()}
    assert set(found) == set("abcde")
    a, b, c, d, e = (found[k] for k in "abcde")
    assert (a["source"], a["memo"], a["accounting_status"], a["summary_approved"], a["strategy"], a["stages"]) == (0, "text", None, True, None, "{}")
    assert (b["source"], b["attorney_summary"], b["summary_approved"], b["summary_approved_by"], b["memo"]) == (2, '{"s":2}', True, "last", None)
    assert (c["source"], json.loads(c["pleading_versions"]), json.loads(c["stages"]), c["summary_approved"]) == (1, [1], {"review": {}}, False)
    blank = (None, False, "", "not_started", "[]", "{}", "draft")
    shown = lambda r: (r["attorney_summary"], r["summary_approved"], r["summary_approved_by"], r["accounting_status"], r["pleading_versions"], r["stages"], r["pleading_status"])
    assert shown(d) == blank and d["source"] == 0 and shown(e) == blank and e["source"] is None
    none = workflow.restored_state(known.limit(0), spark.createDataFrame([], AUDITS), spark.createDataFrame([], APPROVALS), "case_id")
    assert none.count() == 0


def test_follow_up_evidence(spark):
    shape = "case_id string, ord int, action_type string, evidence_type string, evidence_description string, referenced_in_document string, reason string"
    actions = [("a", 1, "request_evidence", " Bank  letter", "Of May", "p. 3", None), ("a", 2, "request_evidence", "bank letter ", "of  may", " p. 3 ", ""), ("a", 3, "ask_question", "x", "y", None, None), ("a", 4, "request_evidence", None, None, None, "to prove"), ("b", 1, "request_evidence", "Bank letter", "Of May", "p. 3", None), ("c", 1, None, "x", None, None, None), (None, 1, "request_evidence", "t", "d", None, None)]
    existing = [("b", "BANK LETTER", "of may\nreferenced in document: P. 3."), ("b", None, None)]
    got = review.follow_up_evidence(spark.createDataFrame(actions, shape), spark.createDataFrame(existing, "case_id string, evidence_type string, description string"), ["case_id"], "ord").collect()
    assert sorted((r["case_id"] or "", r["ord"], r["evidence_title"], r["description"]) for r in got) == [("", 1, "t", "d"), ("a", 1, "Bank  letter", "Of May\nReferenced in document: p. 3."), ("a", 4, "Requested evidence", "Purpose: to prove")]


def test_evidence_groups(spark):
    e = claims.ENTRY
    shape = "claim_id string, " + ", ".join(f"{g} array<{e}>" for g in claims.GROUPS) + f", evidence_record_ids array<string>, financial_evidence_found array<{e}>, contradictions array<{e}>"
    row = lambda c, *groups, ids=None, found=None, against=None: (c, *[*groups, *[None] * (4 - len(groups))], ids, found, against)
    entry = lambda ids=None, one=None, why=None, what=None: (ids, one, why, what)
    rows = [
        row("new", [entry(["1", "no", "1"], "2", "why"), entry(["no"], None, "lost"), entry(None, None, None, " said ")], ids=["3"]),
        row("older", [entry(["no"])], ids=["3", " ", "3", "zz"], found=[entry(one="4"), entry()], against=[entry(["1"], None, None, "bad"), entry(what="words")]),
        row("partly", None, [entry(["1"])], [entry(["2"])], ids=["3"], against=[entry(["1"])]),
        row("nothing", [entry(), entry(None, "", " ", None)]),
    ]
    known = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4, 4)], "row_id string")
    entries, loose = claims.grouped_evidence(spark.createDataFrame(rows, shape), known)
    assert sorted((r["claim_id"], r["kind"], r["ord"], r["text"], r["ids"]) for r in entries.collect()) == [
        ("new", "supporting_evidence", 0, "why", ["1", "2"]), ("new", "supporting_evidence", 2, "said", []), ("older", "contradicting_evidence", 0, "bad", ["1"]), ("older", "contradicting_evidence", 1, "words", []),
        ("older", "supporting_evidence", 0, "", ["3", "4"]), ("partly", "contradicting_evidence", 0, "", ["2"]), ("partly", "partially_supporting_evidence", 0, "", ["1"]),
    ]
    assert {r["claim_id"]: r["unverified"] for r in loose.collect()} == {"new": ["no"], "older": ["no", "zz"]}


def test_case_data_and_card_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "case_id long, v string")
    b = spark.createDataFrame([(1, 5), (1, 5)], "case_id long, n int")
    got = tables.case_data({"a": a, "b": b}, "case_id", a.where("case_id = 1")).collect()
    assert sorted((r["case_id"], r["collection"], r["record"]) for r in got) == [(1, "a", '{"v":"x"}'), (1, "b", '{"n":5}'), (1, "b", '{"n":5}')]
    assert tables.case_data({"a": a, "b": b}, "case_id").count() == 5
    rows = spark.createDataFrame([("c1", "2024-01-01T00:00:00Z"), ("c2", None), ("c3", "2025-01-01 00:00"), ("c0", None)], "case_id string, updated_at string")
    assert [r["case_id"] for r in cases.cards(rows).orderBy(*cases.card_order()).collect()] == ["c3", "c1", "c0", "c2"]


def test_merge_of_a_hot_key(spark):
    rows = [(None if i % 3 == 0 else "k", i, ["p1", None, f"p{i % 4}"] if i % 5 else None, "" if i < 10 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ord int, pages array<string>, v string").repartition(4)
    found = {r["k"]: r for r in relational.first_wins_merge(df, ["k"], "ord", ["v"], ["pages"]).collect()}
    for key in (None, "k"):
        own = [r for r in rows if r[0] == key]
        want = list(dict.fromkeys(p for r in own for p in r[2] or []))
        assert (found[key]["ord"], found[key]["v"], found[key]["pages"], found[key]["merged_count"]) == (own[0][1], next(r[3] for r in own if r[3]), want, len(own))


def test_fingerprint_is_of_the_multiset(spark):
    one = lambda rows: relational.fingerprint(spark.createDataFrame(rows, "k int, v string").repartition(3), ["k"], ["v"]).first()["fingerprint"]
    rows = [(1, "a"), (1, "b"), (1, None)]
    assert one(rows) == one(rows[::-1]) != one([*rows, rows[0]])
    assert one([(1, "a"), (1, "a")]) != one([(1, "b"), (1, "b")]) and len(one(rows)) == 16
    assert one([(1, None)]) == one([(1, "")])
    assert relational.fingerprint(spark.createDataFrame([], "k int, v string"), ["k"], ["v"]).count() == 0
    assert relational.fingerprint(spark.createDataFrame(rows, "k int, v string").select(F.lit(1).alias("k"), "v"), [], ["v"]).count() == 1


def test_pages_shrink_to_fit(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 150), (3, "y" * 900)], "id int, body string")
    forms = [F.struct("id", "body"), F.struct("id", F.substring("body", 1, 50).alias("body")), F.struct("id")]
    got = {r["id"]: json.loads(r["j"]) for r in df.select("id", review.shrunk(*forms, most=100).alias("j")).collect()}
    assert got == {1: {"id": 1, "body": "short"}, 2: {"id": 2, "body": "x" * 50}, 3: {"id": 3, "body": "y" * 50}}
    assert json.loads(df.where("id = 3").select(review.shrunk(*forms, most=20).alias("j")).first()["j"]) == {"id": 3}


def test_merge_groups_keep_within_characters(spark):
    rows = [("a", i, "t" * n) for i, n in enumerate((40, 40, 10, 200, 5, 5))] + [("b", 0, "z")]
    got = review.merge_groups(spark.createDataFrame(rows, "case_id string, ord int, summary string"), ["case_id"], "ord", 120).collect()
    chunks = {(r["case_id"], r["ord"]): r["chunk_no"] for r in got}
    # {"summary":""} are 14 characters
    assert [chunks["a", i] for i in range(6)] == [1, 1, 2, 3, 4, 4] and chunks["b", 0] == 1


def test_grounded_answers(spark):
    answers = spark.createDataFrame([(1, True, ["r1", "no", "r1"]), (2, True, ["no"]), (3, False, ["r2"]), (4, True, []), (5, True, None)], "id int, supported boolean, cited array<string>")
    known = spark.createDataFrame([("r1",), ("r2",), ("r2",)], "row_id string")
    got = {r["id"]: (r["supported"], r["cited"], r["unverified"]) for r in review.grounded(answers, known, ["id"], "cited", "row_id").collect()}
    assert got[1] == (True, ["r1"], ["no"]) and got[2] == (False, [], ["no"]) and got[3] == (False, ["r2"], []) and got[4] == (False, [], [])
    assert got[5][0] is False
