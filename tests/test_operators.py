"""Operators against golden values."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casegraph.operators import claims, extraction, graph, ledger, register, relational, retrieval, review, workflow
from casegraph.sources import tables
from casegraph.streaming import events as streams

FACT = ", ".join(f"{f} string" for f in ledger.FACT_FIELDS)
SCHEMA = f"page_id string, case_document_id string, page_number int, ord int, fact_key string, status string, calculation struct<operation:string,inputs:array<string>,result_field:string>, {FACT}"


def fact(ord_, key, status, calculation=None, **fields):
    return ("P1", "D1", 1, ord_, key, status, calculation, *[fields.get(f) for f in ledger.FACT_FIELDS])


FACTS = [
    fact(1, "F1", "EXTRACTED", fact_type="financing_amount", amount="1,000,000", currency="ريال"),
    fact(2, "F2", "EXTRACTED", fact_type="payment", paid_amount="300,000"),
    fact(3, "F3", "CALCULATED", ("subtract", ["F1", "F2"], "remaining_amount"), fact_type="remaining_balance", remaining_amount="700,000"),
    fact(4, "F4", "CALCULATED", ("subtract", ["F1", "F2"], "remaining_amount"), fact_type="remaining_balance", remaining_amount="650,000"),
    fact(5, "F5", "UNCERTAIN", fact_type="payment", amount="250,000"),
    fact(6, "F6", "MISSING", fact_type="payment", description="last installment"),
    fact(7, "F7", "EXTRACTED", amount="5,000"),
    fact(8, "F8", "EXTRACTED", fact_type="fee", amount="one hundred"),
    fact(9, "F9", "PROBABLY", fact_type="fee", amount="50"),
    fact(10, "F10", "EXTRACTED", fact_type="fee"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return ledger.fact_rows(ledger.check_calculations(ledger.normalise(spark.createDataFrame(FACTS, SCHEMA)))).cache()


def test_fact_rows(rows):
    found = {r.fact_key: r for r in rows.collect()}
    assert {k: r.row_status for k, r in found.items()} == {"F1": "EXTRACTED", "F2": "EXTRACTED", "F3": "CALCULATED", "F4": "UNCERTAIN", "F5": "UNCERTAIN", "F6": "MISSING", "F7": "UNCERTAIN", "F8": "UNCERTAIN", "F9": "UNCERTAIN"}
    assert found["F1"].fact.currency == "SAR" and found["F1"].fact.amount == "1,000,000.00" and found["F1"].raw == {"amount": "1,000,000"}
    assert found["F3"].check.ok and "700,000.00" in found["F4"].reason and "unreadable_amount:amount=one hundred" in found["F8"].reason
    assert not found["F6"].has_conflict and found["F1"].row_id.startswith("FACT_") and "F10" not in found


def test_ledger_and_decisions(spark, rows):
    none = spark.createDataFrame([], "row_id string, action string, payload string, ord int")
    before = ledger.with_decisions(rows, ledger.latest_decisions(none))
    assert ledger.ledger(before).count() == 4 and ledger.withheld(before).count() == 5
    key = {r.fact_key: r.row_id for r in rows.collect()}
    log = [(key["F4"], "confirm", "{}", 1), (key["F5"], "proposal", '{"fields":{"amount":"1"}}', 2), (key["F7"], "ignore", "{}", 3), (key["F8"], "correct", '{"fields":{"amount":"100.00"},"explanation":"read again"}', 4)]
    events = spark.createDataFrame(log, none.schema)
    after = ledger.with_decisions(rows, ledger.latest_decisions(events)).cache()
    entries = {r.fact_key: r for r in ledger.ledger(after).collect()}
    assert set(entries) == {"F1", "F2", "F3", "F4", "F6", "F8"} and ledger.withheld(after).count() == 2
    assert entries["F4"].effective_status == "USER_CONFIRMED" and entries["F8"].effective_status == "USER_CORRECTED" and entries["F8"].corrected_fields == ["amount"] and entries["F8"].user_note == "read again"
    assert entries["F2"].value_field == "paid_amount" and entries["F2"].amount == "300,000.00" and entries["F8"].value == Decimal("100.000000")
    assert {r.fact_key for r in ledger.withheld(after).collect() if r.open_proposal} == {"F5"}
    totals = {r.currency: r.total for r in ledger.totals_by_currency(ledger.ledger(after)).collect()}
    assert totals["SAR"] == 1000000 and totals["—"] == 300000 + 700000 + 650000 + 100
    assert [r.fact_key for r in ledger.ledger(after).orderBy(*ledger.ledger_order()).collect()]


def test_latest_decisions(spark):
    log = [("r1", "proposal", "p1", 1), ("r1", "confirm", "c", 2), ("r1", "proposal", "p2", 3), ("r2", "proposal", "p", 1), ("r2", "correct", "x", 2), ("r3", "bogus", "b", 1)]
    found = {r.row_id: r for r in ledger.latest_decisions(spark.createDataFrame(log, "row_id string, action string, payload string, ord int")).collect()}
    assert found["r1"].final.payload == "c" and found["r1"].proposal.payload == "p2"
    assert found["r2"].final.payload == "x" and found["r2"].proposal is None and found["r3"].final is None and found["r3"].proposal is None


def test_validate_fields(spark):
    df = spark.createDataFrame([({"amount": "12,500", "fact_type": "Third Installment", "currency": "riyal", "bogus": "1"},), ({"amount": "abc"},)], "m map<string,string>")
    a, b = (r.v for r in df.select(ledger.validate_fields(F.col("m")).alias("v")).collect())
    assert a.clean == {"amount": "12,500.00", "fact_type": "third_installment", "currency": "SAR"} and a.errors == []
    assert b.clean == {} and len(b.errors) == 1


def test_recompute(spark):
    df = spark.createDataFrame([("sum",), ("difference",), ("product",), ("divide",), ("power",)], "op string").withColumn("v", F.array(F.lit("6").cast("decimal(38,6)"), F.lit("4").cast("decimal(38,6)")))
    assert [r.x for r in df.select(ledger.recompute(F.col("op"), F.col("v")).alias("x")).collect()] == [Decimal(10), Decimal(2), Decimal(24), Decimal("1.5"), None]


NODES = [("A", None), ("B", "A"), ("C", "B"), ("D", "B"), ("E", "Z"), ("F", "G"), ("G", "F")]
EDGES = [("C", "E", "references"), ("C", "X", "amends"), ("C", "A", "Defines"), ("C", "D", "cites")]


def test_graph(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, parent_id string")
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, type string")
    seeds = spark.createDataFrame([("C",), ("E",), ("F",)], "node_id string")
    up = [(r.node_id, r.ancestor_id) for r in graph.ancestors(seeds, nodes).orderBy("node_id", "depth").collect()]
    assert up == [("C", "B"), ("C", "A"), ("F", "G"), ("F", "F")]
    assert [(r.node_id, r.sibling_id) for r in graph.siblings(seeds, nodes).collect()] == [("C", "D")]
    assert {(r.related_id, r.type) for r in graph.related(seeds, edges, nodes).collect()} == {("E", "references"), ("A", "Defines")}
    hits = spark.createDataFrame([("C", 1), ("B", 2)], "node_id string, seed_ord int")
    found = {r.node_id: r.label for r in graph.expand_hits(hits.where("node_id = 'C'"), nodes, edges, 40).collect()}
    assert found == {"C": "retrieved", "B": "parent", "A": "ancestor", "E": "references"}
    assert graph.expand_hits(hits, nodes, edges, 2).count() == 4  # the cap is looked at between hits only
    assert {r.node_id for r in graph.expand_hits(hits, nodes, edges, 40).collect()} == {"A", "B", "C", "D", "E"}


def test_expansion_of_lists(spark):
    """Lists apart, hits and edges that repeat, hits under one parent, a cycle, hits that are no nodes; what is reached is brought together once."""
    nodes = spark.createDataFrame([*NODES, ("H", "B"), ("I", "D")], "node_id string, parent_id string")
    edges = spark.createDataFrame([*EDGES, *EDGES, ("C", "E", "amends"), ("X", "A", "amends"), ("H", "E", "amends")], "source_id string, target_id string, type string")
    hits = spark.createDataFrame([(1, "X", 0), (1, "C", 1), (1, "H", 2), (1, "C", 3), (1, "F", 4), (2, "B", 1), (2, "H", 2), (2, "G", 3)], "q long, node_id string, seed_ord int")
    found = graph.expand_hits(hits, nodes, edges, 7, max_children=2, group=["q"])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert re.findall(r"Exchange hashpartitioning\(q#\d+L, (\w+)#", plan) == ["parent_id"] and plan.count("REPARTITION_BY_COL") == 1
    assert {(r.q, r.node_id, r.label, r.seed_ord) for r in found.collect()} == {
        (1, "C", "retrieved", 1), (1, "B", "parent", 1), (1, "A", "ancestor", 1), (1, "E", "amends", 1),
        (1, "H", "retrieved", 2), (1, "F", "retrieved", 4), (1, "G", "parent", 4),
        (2, "B", "retrieved", 1), (2, "A", "parent", 1), (2, "C", "child", 1), (2, "D", "child", 1),
        (2, "H", "retrieved", 2), (2, "E", "amends", 2), (2, "G", "retrieved", 3), (2, "F", "parent", 3),
    }
    assert {r.node_id for r in graph.expand_hits(hits.where("q = 2").drop("q"), nodes, edges, 4).collect()} == {"A", "B", "C", "D", "H"}


def test_neighbours_of_repeated_edges(spark):
    """Copies of an edge take one place, and the edges are shuffled once, after each task has kept a node's first ones."""
    edges = spark.createDataFrame([(1, b) for b in range(120, 100, -1) for _ in range(15)] + [(None, 105), (2, 105), (105, 2)], "a long, b long")
    found = graph.neighbours(edges, "a", "b", 12)
    plan = edges.sparkSession._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and " HashAggregate" not in plan and "12, Partial" in plan
    got = {r.node: r.neighbours for r in found.collect()}
    assert got[1] == list(range(101, 113)) and got[105] == [1, 2] and got[2] == [105] and got[120] == [1]


def test_applicability(spark):
    data = [("n1", "ar", "true", '["retail"]', "2024-01-01", None), ("n2", "ar", "0", None, None, None), ("n3", "en", "true", None, None, None), ("n4", "ar", None, None, None, None), ("n5", "ar", "true", '["corporate"]', None, None), ("n6", "ar", "true", "not json", None, None), ("n7", "ar", "true", None, "2024-07-01", None), ("n8", "ar", "true", None, None, "2024-05-31"), ("n9", "ar", "true", None, None, "2024-06-01"), ("n10", "ar", "true", None, None, "bad")]
    nodes = spark.createDataFrame(data, "node_id string, language string, is_current string, customer_types_json string, effective_date string, expiry_date string")
    f = retrieval.Applicability("ar", True, "2024-06-01", {"customer_types_json": "retail"})
    assert {r.node_id for r in nodes.where(retrieval.applicable(f)).collect()} == {"n1", "n4", "n6", "n9", "n10"}


def test_research(spark):
    vectors = spark.createDataFrame([("C", [1.0, 0.0]), ("E", [0.9, 0.1]), ("A", [0.0, 1.0]), ("Q", [0.0, 0.0])], "node_id string, vector array<double>")
    nodes = spark.createDataFrame(NODES, "node_id string, parent_id string").withColumn("language", F.when(F.col("node_id") == "E", "en").otherwise("ar"))
    edges = spark.createDataFrame(EDGES, "source_id string, target_id string, type string")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert [(r.node_id, r["rank"]) for r in retrieval.nearest(queries, vectors, 2).orderBy("rank").collect()] == [("C", 1), ("E", 2)]
    found = {r.node_id: (r.label, r.method) for r in retrieval.research(queries, vectors, nodes, edges, retrieval.Applicability("ar"), k=2).collect()}
    assert found == {"C": ("retrieved", "similarity"), "B": ("parent", "graph_expansion"), "A": ("ancestor", "graph_expansion"), "E": ("references", "graph_expansion")}


def sized(spark, sizes):
    return spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "k string, ord int, cost int")


@pytest.mark.parametrize(("sizes", "kept"), [([4, 5, 6], 2), ([4, 6], 2), ([4, 20, 1], 1), ([12, 1], 1)])
def test_budget(spark, sizes, kept):
    assert [r.ord for r in relational.budget_prefix(sized(spark, sizes), ["k"], ["ord"], F.col("cost"), 10).orderBy("ord").collect()] == list(range(kept))


def test_chunks(spark):
    chunked = relational.chunk_by_cost(sized(spark, [4, 5, 6, 20, 3]), ["k"], "ord", "cost", 10, 15)
    assert [r.chunk_no for r in chunked.orderBy("ord").collect()] == [1, 1, 2, 3, 4]
    few = relational.chunk_by_cost(sized(spark, [1, 1, 1, 0, 1]), ["k"], "ord", "cost", 10, 15, most_items=2)
    assert [r.chunk_no for r in few.orderBy("ord").collect()] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize(("back", "want"), [(True, ["a", "b\nc\nd", "e"]), (False, ["a", "b", "c\nd", "e"])])
def test_stitch(spark, back, want):
    parts = [("x", 1, 1, "a", False, False), ("x", 1, 2, "b", True, False), ("x", 2, 1, "c", True, back), ("x", 3, 1, "d", False, True), ("x", 3, 2, "e", False, False)]
    df = spark.createDataFrame(parts, "agreement_id string, chunk_no int, pos int, text string, into_next boolean, from_previous boolean")
    found = review.clauses(df, ["agreement_id"]).orderBy("clause_no").collect()
    assert [r.text for r in found] == want and found[1].clause_id == "CL_0002"


def test_first_wins(spark):
    df = spark.createDataFrame([("k", 1, "X", "", ["P1"]), ("k", 2, "Y", "R", ["P1", "P2"])], "k string, ord int, name string, role string, pages array<string>")
    r = relational.first_wins_merge(df, ["k"], "ord", ["name", "role"], ["pages"]).first()
    assert (r.name, r.role, r.pages, r.merged_count) == ("X", "R", ["P1", "P2"], 2)


def test_review_merge(spark):
    df = spark.createDataFrame([(1, 1, 80, True, True, ["a", "b"], "s1"), (1, 2, 40, True, True, ["b", "c"], "s1"), (1, 3, 95, False, True, [], "s2")], "case_id int, ord int, score int, is_complete boolean, is_ready boolean, gaps array<string>, summary string")
    r = review.merge_reviews(df, ["case_id"], "ord", ["gaps"]).first()
    assert (r.score, r.is_complete, r.is_ready, r.gaps, r.summary) == (40, False, True, ["a", "b", "c"], "s1\ns2")


def test_latest_and_signatures(spark):
    df = spark.createDataFrame([("p1", "completed", 1), ("p2", "completed", 1), ("p2", "failed", 2), ("p3", "failed", 1), ("p3", "completed", 2)], "page string, status string, at int")
    done = relational.latest_by_key(df, ["page"], ["at"]).where("status = 'completed'")
    pages = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "page string")
    assert {r.page for r in relational.only_new(pages, done, ["page"]).collect()} == {"p2", "p4"}
    batch = spark.createDataFrame([("c", "s1", 1), ("c", "s1", 2), ("c", "s2", 3)], "case_id string, signature string, ord int")
    known = spark.createDataFrame([("c", "s2")], "case_id string, signature string")
    new, counts = register.persist(batch, known)
    assert [(r.signature, r.ord) for r in new.collect()] == [("s1", 1)] and tuple(counts.first()) == ("c", 1, 2)


def test_register(spark):
    parties = spark.createDataFrame([(1, "The Bank.", "bank", ["P1"]), (2, "the BANK", "", ["P2"]), (3, "Ali", "Claimant", ["P3"]), (4, "  ", "x", [])], "ord int, name string, role string, source_page_ids array<string>")
    found = register.merged(parties, "party", ["name", "role"]).withColumn("rank", register.role_rank(F.col("role"))).orderBy("rank").collect()
    assert [(r.name, r.source_page_ids) for r in found] == [("Ali", ["P3"]), ("The Bank.", ["P1", "P2"])]
    approved = spark.createDataFrame([(1, "Paid in May", ["P1"])], "ord int, text string, source_page_ids array<string>")
    candidates = spark.createDataFrame([(1, "paid in may!", ["P2"]), (2, "Other", ["P3"])], "ord int, text string, source_page_ids array<string>")
    merged = {r.text: r for r in register.with_precedence(approved, candidates, "fact", ["text"]).collect()}
    assert merged["Paid in May"].source_page_ids == ["P1", "P2"] and merged["Paid in May"].approved == "yes" and merged["Other"].approved is None
    one = register.register_fingerprint(parties, [], ["name"]).first()[0]
    assert one == register.register_fingerprint(parties.orderBy(F.desc("ord")), [], ["name"]).first()[0] != register.register_fingerprint(parties.where("ord < 3"), [], ["name"]).first()[0]


def test_claims(spark):
    groups = spark.createDataFrame([("c1", "supporting", 1, "t", ["R1", "R2", "INVENTED"]), ("c1", "supporting", 2, "gone", ["FAKE"]), ("c1", "missing", 1, "no ids", [])], "claim_id string, kind string, ord int, text string, ids array<string>")
    known = spark.createDataFrame([("R1",), ("R2",)], "row_id string")
    entries, loose = claims.evidence(groups, known)
    assert {(r.text, tuple(r.ids)) for r in entries.collect()} == {("t", ("R1", "R2")), ("no ids", ())} and loose.first().unverified == ["FAKE", "INVENTED"]
    df = spark.createDataFrame([("partially supported", None, 0), ("probably true", "X", 4)], "r string, id string, i int")
    assert [tuple(r) for r in df.select(claims.result(F.col("r")), claims.claim_id(F.col("id"), F.col("i"))).collect()] == [("PARTIALLY_SUPPORTED", "CLM_001"), ("NOT_VERIFIABLE", "X")]


def test_workflow(spark):
    log = [("c", "review", "running", None, "j1", 1), ("c", "review", "error", "broke", None, 2), ("c", "review", "running", None, "j2", 3), ("c", "accounting", "running", None, "j", 1), ("c", "accounting", "completed", None, None, 2)]
    found = {r.stage: r for r in workflow.merge_stage_events(spark.createDataFrame(log, "case_id string, stage string, status string, error string, job_id string, at int"), ["case_id"], ["at"]).collect()}
    assert (found["review"].status, found["review"].error, found["review"].job_id, found["review"].started_at, found["review"].finished_at) == ("running", "", "j2", 3, None)
    assert (found["accounting"].finished_at, found["accounting"].job_id) == (2, None)
    stages = [("c", s, "completed", r, f, "", False, u, "fp2") for s, r, f, u in [("documents", None, "2", "fp2"), ("review", None, "1", "fp2"), ("accounting", "running", "3", ""), ("analysis", None, "4", "fp1"), ("pleading", None, "5", ""), ("discussion", None, "6", "")]]
    view = workflow.overview(spark.createDataFrame(stages, "k string, stage string, derived string, record_status string, finished_at string, error string, live boolean, used_fingerprint string, fingerprint string"), "k").cache()
    seen = {r.stage: (r.status, r.stale_because, r.state) for r in view.collect()}
    assert seen == {"documents": ("completed", None, "complete"), "review": ("stale", "documents", "current"), "accounting": ("error", None, "upcoming"), "analysis": ("stale", "documents", "upcoming"), "pleading": ("completed", None, "complete"), "discussion": ("completed", None, "complete")}
    assert workflow.next_stage(view, "k").first().next_stage == "accounting"
    json = spark.createDataFrame([("c", 1, '{"a":1}'), ("c", 2, "[1]"), ("c", 3, "bad")], "k string, at int, j string")
    assert workflow.latest_valid_json(json, ["k"], ["at"], "j").first().at == 1 and workflow.latest_states(json, ["k"], ["at"], "j").first().j == "{}"


def test_extraction(spark):
    page = "Statement of account\n25/03/2024  Transfer to ABC Trading   12,450.00 SAR   debit\n26/03/2024  Deposit from customer      5,000.00 SAR   credit  ref: TRX-99871\nunrelated line with no financial data\n"
    found = extraction.line_candidates(spark.createDataFrame([("P1", page)], "page_id string, page_text string")).orderBy("line_index").collect()
    assert len(found) == 2 and "12,450.00" in found[0].amount_exact_text and found[0].debit_or_credit == "debit"
    assert found[1].debit_or_credit == "credit" and found[1].reference_number == "TRX-99871"
    blocks = spark.createDataFrame([("d", 1, 0.0, 0.0, 9.0, 1.0, 20.0, "Title"), ("d", 1, 0.0, 2.0, 9.0, 3.0, 10.0, "x" * 50), ("d", 2, 0.0, 0.0, 9.0, 1.0, 10.0, "body text")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert [r.section for r in extraction.sections(blocks, ["doc", "page"], ["doc"]).orderBy("page", "y0").collect()] == ["Title"] * 3
    boxes = spark.createDataFrame([(1, 0.0, 1.9, 9.0, 3.1)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.text[:5] for r in extraction.outside_tables(blocks, boxes, "page").collect()} == {"Title", "body "}
    r = spark.createDataFrame([("", "b", "c"), ("a", None, None), (None, " ", None)], "x string, y string, z string").select(extraction.cascade(F.col("x"), F.col("y"), F.col("z")).alias("c")).collect()
    assert [x.c.status for x in r] == ["completed_review_required", "completed", "failed"]
    c = spark.createDataFrame([("paid 1,500.00 SAR today", "paid 1,500.00 SAR and 20 SAR today")], "a string, b string").select(extraction.consensus(F.col("a"), F.col("b")).alias("c")).first().c
    assert c.agreed == [Decimal("1500.000000")] and c.only_secondary == [Decimal("20.000000")] and "amounts differ" in c.reasons


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "case_id string, row string"
    assert tables.read_table(spark, path, spark.createDataFrame([], schema).schema).count() == 0
    spark.createDataFrame([("c1", "r1"), ("c1", "r2"), ("c2", "r3")], schema).write.partitionBy("case_id").parquet(path)
    new = spark.createDataFrame([("c1", "r9")], schema)
    tables.replace_slice(spark, path, "c1", new, F.col("row") == "r1")
    assert {tuple(r) for r in spark.read.parquet(path).select("case_id", "row").collect()} == {("c1", "r2"), ("c1", "r9"), ("c2", "r3")}
    tables.append(new, str(tmp_path / "log"))
    assert {"ingest_seq", "ingest_id"} <= set(spark.read.parquet(str(tmp_path / "log")).columns)
    df = spark.createDataFrame([("a/b c?.pdf", float("nan"))], "f string, x double")
    assert df.select(tables.safe_name(F.col("f"))).first()[0] == "b_c_.pdf" and tables.as_json(df).first().json == '{"f":"a/b c?.pdf"}'
    (tmp_path / "f.bin").write_bytes(b"x")
    assert tables.files(spark, str(tmp_path / "*.bin")).first().size == 1
    assert tables.case_slice(df, "c1").count() == 0 and tables.as_text(spark.createDataFrame([(None,)], "f string")).first().f == ""
    text = tables.markdown(spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a")], "k int, o int, t string, b string"), ["k"], "o", "t", "b").first().markdown
    assert text == "## A\n\na\n\n## B\n\nb"


def test_model_calls(spark):
    class Stub:
        def complete(self, prompts):
            if "fail" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "fail")], "id int, p string").repartition(2, "id").sortWithinPartitions("id")
    found = {r.id: (r.answer, r.answer_error) for r in review.call_model(df, "p", Stub()).collect()}
    assert found[1][0] in ("A", None) and found[2][0] is None and "down" in found[2][1]


def test_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = batch.agg((F.max("ts") - F.expr("interval 1 hour")).alias("m")).first().m
    stream = streams.event_stream(spark, sf)
    got = streams.run_available(streams.tumbling(stream), "tumbling_test", str(tmp_path / "a"))
    want = streams.tumbling(batch).where(F.col("window_end") <= F.lit(closed))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and want.count() > 0
    sessions = streams.run_available(streams.sessions(streams.event_stream(spark, sf)), "sessions_test", str(tmp_path / "b"))
    assert {tuple(r) for r in sessions.collect()} <= {tuple(r) for r in streams.sessions(batch).collect()} and sessions.count() > 0
    query = streams.upsert_latest(streams.event_stream(spark, sf), str(tmp_path / "latest"), ["user_id"], ["ts", "event_id"], str(tmp_path / "c"))
    query.awaitTermination()
    latest = streams.read_latest(spark, str(tmp_path / "latest"), ["user_id"], ["ts", "event_id"])
    assert {(r.user_id, r.event_id) for r in latest.collect()} == {(r.user_id, r.event_id) for r in relational.latest_by_key(batch, ["user_id"], ["ts", "event_id"]).collect()}
    once = streams.run_available(streams.distinct_events(streams.event_stream(spark, sf), ["event_id"]), "distinct_test", str(tmp_path / "d"))
    assert once.count() == batch.count()


def test_only_columns_asked_for_are_shuffled(spark):
    """A page's facts are shuffled as rows, so those that nothing reads stay behind; results do not depend on them."""
    checked = ledger.check_calculations(ledger.normalise(spark.createDataFrame(FACTS, SCHEMA)))
    plan = checked.select("page_id", "check.ok")._jdf.queryExecution().optimizedPlan().toString()
    assert "counterparty" not in plan.split("Window")[0] and "collect_list" in plan and "Aggregate" not in plan
    assert {r.fact_key: r.check.ok for r in checked.where("check IS NOT NULL").collect()}["F3"]


def test_overview_joins_nothing(spark):
    rows = [("c", s, "completed", None, f, "", False, "", "") for s, f in [("documents", "2"), ("review", "1"), ("analysis", "")]] + [(None, "documents", "completed", None, "2", "", False, "", ""), (None, "review", "completed", None, "1", "", False, "", "")]
    view = workflow.overview(spark.createDataFrame(rows, "k string, stage string, derived string, record_status string, finished_at string, error string, live boolean, used_fingerprint string, fingerprint string"), "k")
    assert "Join" not in view._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.stage): r.stale_because for r in view.collect()} == {("c", "documents"): None, ("c", "review"): "documents", ("c", "analysis"): None, (None, "documents"): None, (None, "review"): None}


def test_items_are_tidied_once(spark):
    df = spark.createDataFrame([(["a  b", "A b", " ", "-c-", None],)], "x array<string>").select(extraction.tidy(F.col("x")).alias("x"))
    assert df.first().x == ["a b", "c"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_lists_of_pages_are_read_once(spark):
    from casegraph.operators import register

    facts = spark.createDataFrame([(i, "t", j, "d", i) for i, j in enumerate(['["p1", "p2"]', "[]", " []", "x", None])], "fact_id int, fact_text string, source_page_ids_json string, case_document_id string, page_number int")
    pages = spark.createDataFrame([("d", 1, "q1", 1, "L1"), ("d", 3, "q3", 1, "L3")], "case_document_id string, page_number int, page_id string, ord int, label string")
    found = register.facts_register(facts, pages, pages)
    assert {r.fact_id: (r.page_ids, r.page_labels) for r in found.collect()} == {0: (["p1", "p2"], ["Page p1", "Page p2"]), 1: (["q1"], ["L1"]), 2: ([], []), 3: (["q3"], ["L3"]), 4: ([], [])}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3


def test_texts_are_folded_once_a_clause(spark):
    from casegraph.operators import review

    found = review.clause_terms(spark.createDataFrame([(1, 1, "The ẞ Term")], "agreement_id int, clause_id int, text string"), spark.createDataFrame([(1, "TERM"), (1, "other")], "agreement_id int, term string"))
    assert [tuple(r) for r in found.collect()] == [(1, 1, "TERM")]
    assert all("lower" not in line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)
