"""The case register: one merged view of parties, events, facts, issues, evidence and contradictions, with precedence.

Stored rows -> shaped() (a kind's own fields) -> merged() (one row a case and key) -> order columns; assembled() does so for
all kinds and adds labels of pages, counts and a fingerprint a case. A case is a column, so all cases are assembled at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, jsonx, text
from .relational import first_wins_merge, fingerprint, new_by_signature

# What makes two records of a kind the same, and the words of a party's role in order of rank.
KEYS = {"party": ["name"], "event": ["date", "description"], "fact": ["text"], "issue": ["title"], "evidence": ["title", "description"], "contradiction": ["description"]}
ROLE_RANKS = [["claimant", "plaintiff", "applicant", "complainant", "مدعي", "طالب", "مشتكي"], ["defendant", "respondent", "مدعى عليه", "مدعى عليها"], ["appellant", "مستأنف"], ["bank", "بنك", "مصرف"]]
PRIORITY = {"critical": 0, "high": 0, "medium": 1, "low": 2}


def merge_key(kind: str) -> Column:
    return F.concat_ws("|", *[text.normalise(F.col(c).cast("string")) for c in KEYS[kind]])


# Where the fields of a kind are stored (the first filled column counts), the columns of page ids, defaults.
STORED = {
    "party": {"party_id": ["party_id"], "name": ["party_name", "name"], "party_type": ["party_type"], "role": ["role_in_case", "role"], "review_status": ["review_status"]},
    "event": {"event_id": ["event_id"], "date": ["event_date", "date"], "event_type": ["event_type"], "description": ["event_description", "description", "event"], "review_status": ["review_status"]},
    "fact": {"fact_id": ["fact_id", "fact_candidate_id"], "text": ["fact_text", "fact", "statement"], "fact_date": ["fact_date"], "party": ["party"], "fact_type": ["fact_type"], "status": ["status", "fact_status", "candidate_status"], "evidence_quote": ["evidence_quote"], "source_type": ["source_type"]},
    "issue": {"issue_id": ["issue_id", "issue_candidate_id"], "title": ["issue_title", "title", "issue_text"], "description": ["issue_description", "description"], "priority": ["priority"]},
    "evidence": {"evidence_id": ["evidence_id"], "title": ["evidence_title", "title", "evidence_type"], "evidence_type": ["evidence_type"], "description": ["description"], "purpose": ["purpose"], "priority": ["priority"], "status": ["review_status", "status"]},
    "contradiction": {"contradiction_id": ["contradiction_id"], "description": ["description"], "clarification_required": ["clarification_required"]},
}
PAGE_COLUMNS = {"party": ["source_page_ids_json", "source_page_ids"], "event": ["source_id", "source_page_ids_json"], "fact": ["source_page_ids_json", "source_page_ids"], "issue": ["supporting_fact_ids_json", "source_page_ids_json"], "evidence": ["source_page_ids_json", "page_ids"], "contradiction": ["source_page_ids_json"]}
DEFAULTS = {"review_status": "candidate", "priority": "medium", "source_type": "document"}


def shaped(rows: DataFrame, kind: str, case: str = "case_id") -> DataFrame:
    """Stored rows (case, ord and any of the columns that a kind is stored in) as the kind's fields and source_page_ids."""
    there = set(rows.columns)
    none = F.lit("")
    read = lambda names: F.coalesce(F.trim(text.first_filled(*[F.col(n).cast("string") for n in names if n in there])), none) if there & set(names) else none
    fields = {f: read(names) for f, names in STORED[kind].items()}
    for f, default in DEFAULTS.items():
        if f in fields:
            fields[f] = F.coalesce(F.nullif(fields[f], none), F.lit(default))
    if "priority" in fields:
        fields["priority"] = F.lower(fields["priority"])
    if kind == "evidence":
        fields["status"] = F.coalesce(F.nullif(fields["status"], none), F.lit("requested"))
    lists = [jsonx.text_list(F.col(c), keep_plain=True) for c in PAGE_COLUMNS[kind] if c in there]
    pages = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
    kept = {"source_page_ids": F.filter(F.transform(pages, lambda p: F.trim(p)), lambda p: p != "")}
    if kind == "event":
        kept["parties"] = jsonx.text_list(F.col("party_ids_json")) if "party_ids_json" in there else F.array().cast("array<string>")
    if kind == "issue":
        kept["targeted_questions"] = jsonx.text_list(F.col("targeted_questions_json")) if "targeted_questions_json" in there else F.array().cast("array<string>")
    return rows.select(case, "ord", *[c.alias(f) for f, c in {**fields, **kept}.items()])


def merged(records: DataFrame, kind: str, fields: list[str], lists: list[str] = ("source_page_ids",), order: str = "ord", by: list[str] = ()) -> DataFrame:
    """Records of a kind, one a key (and case): first values win, gaps are filled from later ones, pages are united."""
    keyed = records.withColumn("merge_key", merge_key(kind)).where(F.replace(F.col("merge_key"), F.lit("|"), F.lit("")) != "")
    return first_wins_merge(keyed, [*by, "merge_key"], order, fields, list(lists))


def with_precedence(approved: DataFrame, candidates: DataFrame, kind: str, fields: list[str], lists: list[str] = ("source_page_ids",), by: list[str] = ()) -> DataFrame:
    """Approved records first, then candidates; a candidate equal to an approved one only adds to it."""
    tag = lambda df, n: df.withColumn("ord", F.struct(F.lit(n).alias("source"), F.col("ord").cast("long").alias("at"))).withColumn("approved", F.lit("yes" if n == 0 else ""))
    return merged(tag(approved, 0).unionByName(tag(candidates, 1), allowMissingColumns=True), kind, [*fields, "approved"], lists, by=by)


def _one_source(rows: DataFrame, kind: str, case: str) -> DataFrame:
    lists = ["source_page_ids", "parties"] if kind == "event" else ["source_page_ids"]
    return merged(shaped(rows, kind, case), kind, list(STORED[kind]), lists, by=[case])


def parties(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """One row a case and name; sort by role_rank and name_order."""
    return _one_source(rows, "party", case).withColumns({"role_rank": role_rank(F.col("role")), "name_order": F.lower("name")})


def events(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """One row a case, date and description; sort by event_order, then ord."""
    described = shaped(rows, "event", case).where("description <> ''")
    out = merged(described, "event", list(STORED["event"]), ["source_page_ids", "parties"], by=[case])
    return out.withColumn("event_order", event_order(F.col("date")))


def facts(approved: DataFrame, candidates: DataFrame, case: str = "case_id") -> DataFrame:
    """Approved facts, then candidates; one without a decided status is stated if it is approved, else unclassified."""

    def told(rows: DataFrame, otherwise: str) -> DataFrame:
        said = F.lower("status")
        return shaped(rows, "fact", case).withColumn("status", F.when(said.isin("", "pending", "candidate"), F.lit(otherwise)).otherwise(said))

    return with_precedence(told(approved, "stated"), told(candidates, "unclassified"), "fact", list(STORED["fact"]), by=[case])


def allegations(facts_: DataFrame) -> DataFrame:
    return facts_.where("status = 'alleged'")


def issues(approved: DataFrame, candidates: DataFrame, case: str = "case_id") -> DataFrame:
    """Approved issues, then candidates; sort by issue_order, then ord."""
    lists = ["source_page_ids", "targeted_questions"]
    out = with_precedence(shaped(approved, "issue", case), shaped(candidates, "issue", case), "issue", list(STORED["issue"]), lists, by=[case])
    return out.withColumn("issue_order", priority_rank(F.col("priority"), F.col("approved") == "yes"))


def evidence_requests(rows: DataFrame, case: str = "case_id") -> DataFrame:
    return _one_source(rows, "evidence", case)


def contradictions(rows: DataFrame, case: str = "case_id") -> DataFrame:
    return _one_source(rows, "contradiction", case)


def labelled(items: DataFrame, keys: list[str], labels: DataFrame, distinct: bool = False, ids: str = "source_page_ids") -> DataFrame:
    """items with page_labels: the labels (page_id, label) of their page ids in order; "Page " and six characters of an id that has none."""
    long = items.select(*keys, F.posexplode(ids).alias("_at", "page_id"))
    named = long.join(labels.select("page_id", "label"), "page_id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Page "), F.substring("page_id", 1, 6))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_at", "label"))), lambda x: x["label"])
    gathered = named.groupBy(*keys).agg((F.array_distinct(in_order) if distinct else in_order).alias("page_labels"))
    return items.join(gathered, keys, "left").withColumn("page_labels", F.coalesce("page_labels", F.array().cast("array<string>")))


def assembled(sources: dict[str, DataFrame], labels: DataFrame, case: str = "case_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """(kinds, totals). sources: parties, events, facts, fact_candidates, issues, issue_candidates, evidence, contradictions (stored
    rows). kinds have page_labels and, as allegations, the alleged facts; totals has a row a case: its counts by kind and a
    fingerprint that depends on the content of all items and not on their order."""
    kinds = {
        "parties": parties(sources["parties"], case), "events": events(sources["events"], case), "facts": facts(sources["facts"], sources["fact_candidates"], case),
        "issues": issues(sources["issues"], sources["issue_candidates"], case), "evidence_requests": evidence_requests(sources["evidence"], case), "contradictions": contradictions(sources["contradictions"], case),
    }
    kinds = {k: labelled(df, [case, "merge_key"], labels) for k, df in kinds.items()}
    item = lambda df: text.normalise(F.to_json(F.struct(*sorted(c for c in df.columns if c not in (case, "ord")))))
    rows = reduce(DataFrame.unionByName, [df.select(case, F.lit(k).alias("kind"), item(df).alias("item"), F.lit(1).alias("n")) for k, df in kinds.items()])
    kinds["allegations"] = allegations(kinds["facts"])
    counted = rows.groupBy(case).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds if k != "allegations"])
    alleged = kinds["allegations"].groupBy(case).agg(F.count(F.lit(1)).alias("n_allegations"))
    totals = counted.join(alleged, case, "left").withColumn("n_allegations", F.coalesce("n_allegations", F.lit(0).cast("long")))
    return kinds, totals.join(fingerprint(rows, [case], ["kind", "item"]), case)


def page_sources(documents: DataFrame, pages: DataFrame, case: str = "case_id") -> DataFrame:
    """A row a case: documents, pages and pages whose text can be used."""
    ok = usable_page(F.col("processing_status"), F.col("page_text"))
    counted = pages.groupBy(case).agg(F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("usable_pages"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return documents.groupBy(case).agg(F.count(F.lit(1)).alias("documents")).join(counted, case, "full").select(case, *[zero(c) for c in ("documents", "pages", "usable_pages")])


def pages_for_summary(pages: DataFrame) -> DataFrame:
    """pages (claims_json, facts_json, parties_json) with weight; sort by weight descending, document, page."""
    n = lambda c: jsonx.text_list(F.col(c))
    return pages.withColumn("weight", page_weight(n("claims_json"), n("facts_json"), n("parties_json")))


def party_list(rows: DataFrame) -> DataFrame:
    """name and role (or type) of the parties that have a name."""
    role = F.coalesce(F.nullif(F.trim("role_in_case"), F.lit("")), F.trim(F.coalesce("party_type", F.lit(""))))
    return rows.withColumns({"name": F.trim(F.coalesce("party_name", F.lit(""))), "role": F.coalesce(role, F.lit(""))}).where("name <> ''")


def chronology(rows: DataFrame) -> DataFrame:
    """Events with a description: date, event, how their place is known, page ids, and the order in which they are shown
    (raw dates with hyphens, undated or unsure ones last)."""
    date = F.trim(F.coalesce("event_date", F.lit("")))
    unsure = (date == "") | (F.lower(F.coalesce("date_precision", F.lit(""))) == "unknown") if "date_precision" in rows.columns else date == ""
    order = F.struct(unsure.cast("int").alias("undated"), F.when(unsure, F.lit("9999-99-99")).otherwise(F.replace(date, F.lit("/"), F.lit("-"))).alias("day"), date.alias("raw"))
    told = rows.withColumns({"event": F.trim(F.coalesce("event_description", F.lit(""))), "date": date, "chronology_basis": F.when(date != "", "dated_source").otherwise("inferred_sequence"), "source_page_ids": jsonx.text_list(F.col("source_id")), "shown_order": order})
    return told.where("event <> ''")


def facts_register(facts_: DataFrame, pages: DataFrame, labels: DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts (key, fact_text, source_page_ids_json, case_document_id, page_number) with page_ids and labels; one without pages has
    the first page (page_id, in order) of its document and number."""
    first = pages.groupBy("case_document_id", "page_number").agg(F.min_by("page_id", "ord").alias("_page"))
    told = facts_.where(F.coalesce("fact_text", F.lit("")) != "").join(first, ["case_document_id", "page_number"], "left")
    listed = text.let(jsonx.text_list(F.col("source_page_ids_json")), lambda ids: F.when(F.size(ids) > 0, ids))  # read once a fact
    found = told.withColumn("page_ids", F.coalesce(listed, F.when(F.col("_page").isNotNull(), F.array("_page")), F.array().cast("array<string>"))).drop("_page")
    return labelled(found, [key], labels, distinct=True, ids="page_ids")


def role_rank(role: Column) -> Column:
    """0 for the claiming side, then the other side, appellants and banks; 99 for the rest."""
    lowered = F.lower(F.coalesce(role, F.lit("")))
    rank = None
    for n, words in enumerate(ROLE_RANKS):
        hit = lowered.contains(words[0])
        for w in words[1:]:
            hit = hit | lowered.contains(w)
        rank = F.when(hit, n) if rank is None else rank.when(hit, n)
    return rank.otherwise(99)


def priority_rank(priority: Column, approved: Column) -> Column:
    """struct<not approved, rank>: approved issues first, high and critical ones before others, low ones last."""
    ranks = F.create_map(*[F.lit(v) for pair in PRIORITY.items() for v in pair])
    return F.struct((~F.coalesce(approved, F.lit(False))).cast("int").alias("later"), F.coalesce(F.try_element_at(ranks, F.lower(F.coalesce(priority, F.lit("medium")))), F.lit(1)).alias("rank"))


def event_order(date: Column) -> Column:
    return dates.date_key(date)


def page_weight(claims: Column, facts: Column, parties: Column) -> Column:
    """How much a page tells: three for each claim, one for each fact and party."""
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    return 3 * n(claims) + n(facts) + n(parties)


def usable_page(status: Column, page_text: Column) -> Column:
    return F.coalesce(status, F.lit("completed")).isin("completed", "completed_review_required") & (F.trim(F.coalesce(page_text, F.lit(""))) != "")


def page_labels(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages with label "file — page N"."""
    names = documents.select("case_document_id", "original_filename")
    return pages.join(names, "case_document_id", "left").withColumn("label", F.concat(F.coalesce(F.nullif(F.trim("original_filename"), F.lit("")), F.lit("Document")), F.lit(" — page "), F.col("page_number")))


def register_fingerprint(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return fingerprint(records, keys, fields)


def persist(batch: DataFrame, known: DataFrame, keys: list[str] = ("case_id", "signature"), order: list[str] = ("ord",)) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts a case of new and skipped rows)."""
    new = new_by_signature(batch, known, list(keys), list(order))
    case = [k for k in keys if k != "signature"]
    totals = batch.groupBy(*case).agg(F.count(F.lit(1)).alias("offered"))
    counted = new.groupBy(*case).agg(F.count(F.lit(1)).alias("inserted"))
    return new, totals.join(counted, case, "left").select(*case, F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("offered") - F.coalesce("inserted", F.lit(0))).alias("duplicates_skipped"))
