"""Stored slices, ids, model calls, the register and reviews on small tables."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from casegraph.functions import ids
from casegraph.operators import agreements, cases, projections, register, review
from casegraph.sources import tables


def test_replaced_slice_keeps_all_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("A", "1", "x", 5), ("A", "2", "y", 6), ("B", "3", "z", 7)], "case_id string, id string, note string, n int").write.partitionBy("case_id").parquet(path)
    tables.replace_slice(spark, path, "A", spark.createDataFrame([("A", "2", "new")], "case_id string, id string, note string"), F.col("id") == "2")
    rows = {(r.case_id, r.id): (r.note, r.n) for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert rows == {("A", "1"): ("x", 5), ("A", "2"): ("new", None), ("B", "3"): ("z", 7)}


def test_unreadable_table_is_not_empty(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.replace_slice(spark, str(broken), "A", spark.createDataFrame([("A", 1)], "case_id string, a int"))
    with pytest.raises(AnalysisException):
        tables.read_table(spark, str(tmp_path / "none"))


def test_ids_of_zero(spark):
    df = spark.createDataFrame([("0", 0, False, 0.0, "")], "t string, n int, b boolean, d double, e string")
    r = df.select(*[ids.stable_id("X", F.col(c)).alias(c) for c in df.columns]).first()
    assert r.n == r.b == r.d == r.e != r.t  # the text "0" is no number


class Picky:
    def complete(self, prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]


def test_one_bad_prompt_costs_one_answer(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    rows = {r.p: (r.answer, r.answer_error is None) for r in review.call_model(df, "p", Picky()).collect()}
    assert rows == {"a": ("A", True), "bad": (None, False), "c": ("C", True)}


def test_register_fingerprint_is_of_content(spark):
    schema = "case_id string, ord int, party_name string, role_in_case string, source_page_ids_json string"
    rows = [("k", 1, "Bank One", "bank", '["p1"]'), ("k", 2, "bank one", "", '["p2"]'), ("k", 3, "Other", "Plaintiff", "[]")]
    none = spark.createDataFrame([], "case_id string, ord int, event_description string, fact_text string, issue_title string, title string, description string")
    labels = spark.createDataFrame([("p1", "file — page 1")], "page_id string, label string")

    def totals(parties):
        sources = dict.fromkeys(("events", "facts", "fact_candidates", "issues", "issue_candidates", "evidence", "contradictions"), none) | {"parties": spark.createDataFrame(parties, schema)}
        kinds, all_ = register.assembled(sources, labels)
        return {r.name: r.page_labels for r in kinds["parties"].collect()}, all_.first()

    found, one = totals(rows)
    assert found == {"Bank One": ["file — page 1", "Page p2"], "Other": []} and one.n_parties == 2 and one.n_facts == 0
    assert totals([(*r[:1], i, *r[2:]) for i, r in enumerate([rows[2], rows[0], rows[1]])])[1].fingerprint == one.fingerprint
    assert totals(rows[:2])[1].fingerprint != one.fingerprint


def test_reviews(spark):
    state = spark.createDataFrame([("c", "secret", ["f"], [])], "case_id string, page_text string, facts array<string>, events array<string>")
    r = projections.whitelisted(state).first()
    assert r.asDict() == {"case_id": "c", "facts": ["f"], "events": None}
    actions = "array<struct<action_type:string,question:string,evidence_type:string,evidence_description:string>>"
    asked = [("ask_question", f"why {i}", None, None) for i in range(5)] + [("request_evidence", None, "contract", "signed"), ("confirm_fact", "is it so", None, None)]
    df = spark.createDataFrame([(asked, "thanks"), ([], "")], f"a {actions}, t string")
    one, two = (r.x for r in df.select(review.reply(F.col("a"), F.col("t")).alias("x")).collect())
    assert one == "thanks\n\n### Evidence\n1. contract: signed\n\n### Questions\n1. why 0\n2. why 1\n3. why 2\n\n### To confirm\n- is it so" and two == "Nothing more is needed."
    big = spark.createDataFrame([("k", 1, "x" * 50)], "case_id string, ord int, t string")
    with pytest.raises(Exception, match="passes 20"):
        review.section_batches({"facts": big}, ["case_id"], "ord", big, chars=20).collect()


def test_names(spark):
    df = spark.createDataFrame([("Non Disclosure",), ("odd",), (None,)], "x string")
    assert [r[0] for r in df.select(agreements.classified(F.col("x"), ["non_disclosure", "loan"], "other")).collect()] == ["non_disclosure", "other", "other"]
    with pytest.raises(Exception, match="unknown workflow"):
        df.select(cases.workflow_type(F.col("x"))).collect()
