"""Compact forms of records for prompts: chosen fields, caps on texts and lists, keys that must not pass.

A spec is data: of each field of the result the columns that it may come from (the first filled one counts) and the most
characters. Columns that a table lacks are left out, so one spec serves tables of different age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonx, text
from .jsontree import rewritten
from .relational import budget_prefix

# Fields, the columns that they come from and their caps, by kind of record.
CHAT = {
    "message": {"message_id": (["message_id"], None), "role": (["role"], 30), "message_text": (["message_text", "content", "text"], 700), "created_at": (["created_at"], None)},
    "document": {"case_document_id": (["case_document_id"], None), "filename": (["filename", "file_name", "name"], 220), "document_type": (["document_type"], 100), "processing_status": (["processing_status"], 60), "page_count": (["page_count"], None), "created_at": (["created_at"], None)},
    "party": {"party_id": (["party_id"], None), "name": (["party_name", "name"], 180), "role": (["party_role", "role"], 100), "party_type": (["party_type"], 80), "source_page_id": (["source_page_id"], None)},
    "fact": {"fact_id": (["fact_id", "fact_candidate_id"], None), "fact": (["fact_text", "description", "fact", "statement"], 500), "status": (["status"], 60), "source_page_id": (["source_page_id"], None)},
    "issue": {"issue_id": (["issue_id", "issue_candidate_id"], None), "issue": (["issue_text", "description", "issue", "title"], 500), "status": (["status"], 60), "source_page_id": (["source_page_id"], None)},
    "evidence": {"evidence_id": (["evidence_id"], None), "title": (["title", "name", "evidence_name"], 180), "evidence_type": (["evidence_type", "type"], 100), "description": (["description"], 400), "status": (["status"], 60), "source_page_id": (["source_page_id"], None)},
    "research": {"authority_id": (["authority_id", "node_id", "id"], None), "title": (["title", "heading", "name"], 180), "citation": (["citation", "reference"], 180), "summary": (["summary", "text", "content"], 500)},
}
ANALYSIS = {
    "authority": {"node_id": (["node_id"], None), "heading_path": (["heading_path"], 200), "text": (["canonical_text", "text"], 900), "source_url": (["source_url"], None), "language": (["language"], None)},
    "issue": {"issue_id": (["issue_id", "issue_candidate_id"], None), "issue_title": (["issue_title"], 200), "issue_description": (["issue_description"], 600), "priority": (["priority"], None)},
    "fact": {"fact_id": (["fact_id", "fact_candidate_id"], None), "fact_text": (["fact_text"], 400), "status": (["status"], None)},
    "evidence": {"evidence_id": (["evidence_id"], None), "title": (["title", "evidence_type"], 180), "status": (["status"], None)},
}
FORBIDDEN = ["page_text", "document_text", "full_text", "extracted_text", "transcription", "raw_content", "content_base64", "image_base64", "conversation_history"]
REVIEW_KEYS = {
    "scalars": ["case", "case_id", "case_name", "case_status", "case_type", "jurisdiction", "review_mode", "review_context"],
    "lists": ["messages", "documents", "document_pages", "latest_document_pages", "parties", "facts", "fact_candidates", "issues", "issue_candidates", "events", "evidence", "legal_research"],
}
REVIEW_TEXTS = {"page_summary": 1200, "summary": 1200, "description": 1000, "content": 700, "message_text": 700, "fact_text": 600, "fact": 600, "issue_text": 600, "issue": 600, "event_text": 600, "event": 600, "research_summary": 1000, "title": 250, "name": 250}
REVIEW_ROWS = 25
MAP_LISTS = {"parties": 8, "dates": 8, "amounts": 8, "case_numbers": 8, "claims": 5, "key_facts": 5, "legal_references": 5, "evidence": 5, "signatures_or_stamps": 5}
CONTEXT_ROWS = {"facts": 24, "fact_candidates": 16, "parties": 12, "issues": 12, "issue_candidates": 10, "evidence": 18, "documents": 20, "pages": 30, "events": 20}
PAGE_LISTS = {"parties": 8, "dates": 8, "amounts": 8, "case_numbers": 8, "claims": 6, "facts": 8, "legal_references": 6, "evidence_items": 6, "signatures_or_stamps": 4}
LEDGER_FIELDS = ["fact_type", "date", "description", "amount", "currency", "debit", "credit", "balance", "amount_due", "paid_amount", "remaining_amount", "account_number", "transaction_reference", "counterparty", "status", "page_number"]


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that there are and that are neither null nor empty; "" if none is."""
    filled = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*filled, F.lit(""))


def compact(df: DataFrame, spec: dict[str, tuple[list[str], int | None]], keys: list[str] = (), mark: str = "…") -> DataFrame:
    """The fields of a spec, capped; mark "" cuts without a sign."""

    def field(names: list[str], most: int | None) -> Column:
        value = first_of(df, names)
        if most is None:
            return value
        return text.truncate(F.trim(value), most) if mark else F.substring(F.trim(value), 1, most)

    return df.select(*keys, *[field(names, most).alias(f) for f, (names, most) in spec.items()])


def compact_pages(pages: DataFrame, case: str, most: int | None = None, chars: int = 2000) -> DataFrame:
    """Usable pages with a summary, or the first items of what was found on them in its place; with most, the last so many of a case."""
    status = F.lower(F.trim(F.coalesce("processing_status", F.lit(""))))
    listed = lambda c, n: jsonx.text_list(F.col(f"{c}_json"), most=n) if f"{c}_json" in pages.columns else F.array().cast("array<string>")
    pieces = F.array_join(F.flatten(F.array(*[listed(c, 4) for c in ("claims", "facts", "evidence_items", "legal_references")])), "; ")
    summary = text.truncate(F.trim(F.coalesce("page_summary", F.lit(""))), chars)
    shown = F.when(summary != "", summary).otherwise(text.truncate(F.trim(pieces), chars))
    out = pages.where(status.isin("completed", "completed_review_required")).select(
        case, "case_document_id", "page_number", "page_id", shown.alias("page_summary"), *[listed(c, n).alias(c) for c, n in PAGE_LISTS.items()], status.alias("processing_status")
    ).where("page_summary <> ''")
    if most is None:
        return out
    last = Window.partitionBy(case).orderBy(F.col("case_document_id").desc(), F.col("page_number").desc())
    return out.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_n")


def without_keys(df: DataFrame, keys: list[str], json: str, forbidden: list[str] = tuple(FORBIDDEN), most: int | None = 1500) -> DataFrame:
    """keys and json (a state's text) without members of these names at any depth, be they texts, lists or objects; texts are cut to
    most characters. What is no JSON becomes null, so nothing unread passes."""
    fix = (lambda x: F.when(F.char_length(x) > most, text.truncate(F.trim(x), most)).otherwise(x)) if most else None
    return rewritten(df, keys, json, forbidden, fix)


def whitelisted(state: DataFrame) -> DataFrame:
    """A review state's columns that may be sent: scalars, and lists that are not empty (others are null)."""
    lists = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in REVIEW_KEYS["lists"] if c in state.columns]
    return state.select(*[c for c in REVIEW_KEYS["scalars"] if c in state.columns], *lists)


def capped(x: Column, most: int) -> Column:
    """A text cut with an ellipsis; a list cut to its first 25."""
    return text.truncate(F.trim(F.coalesce(x, F.lit(""))), most)


def review_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items as a review reads them: fields of FORBIDDEN go, texts of REVIEW_TEXTS are cut, lists keep their first REVIEW_ROWS
    entries. Of fields that hold JSON, only those of the row itself go; keys inside are for without_keys()."""
    fields = {}
    for f in items.schema.fields:
        if f.name in keys or f.name in FORBIDDEN:
            continue
        if f.name in REVIEW_TEXTS:
            fields[f.name] = capped(F.col(f.name).cast("string"), REVIEW_TEXTS[f.name])
        elif isinstance(f.dataType, T.ArrayType):
            fields[f.name] = F.slice(f.name, 1, REVIEW_ROWS)
        else:
            fields[f.name] = F.col(f.name)
    return items.select(*keys, *[c.alias(n) for n, c in fields.items()])


def map_pages(pages: DataFrame, case: str, order: str, most: int = 2000, total: int = 42_000) -> DataFrame:
    """case, order, form, record (JSON): pages with a summary as a case map reads them, in order while their characters stay within total.

    A page whose record passes most characters has its summary and lists cut (form 2); one that still does keeps only its
    kind, a shorter summary and a few facts (form 3). Missing texts are "", missing lists empty.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    list_of = lambda c: (F.coalesce(F.col(c), F.array().cast("array<string>")) if c in pages.columns else F.array().cast("array<string>")).alias(c)
    number = F.col("page_number")
    rows = pages.select(case, order, *[text_of(c) for c in ("page_id", "document_type", "document_language", "summary")], number, *[list_of(c) for c in MAP_LISTS]).where(F.col("summary").rlike(r"\S"))
    head = lambda n: F.substring("summary", 1, n).alias("summary")
    known = ["page_id", "page_number", "document_type", "document_language"]
    forms = [
        F.struct(*known, "summary", *MAP_LISTS),
        F.struct(*known, head(900), *[F.slice(c, 1, n).alias(c) for c, n in MAP_LISTS.items()]),
        F.struct(*known[:3], head(700), F.slice("key_facts", 1, 4).alias("key_facts")),
    ]
    chosen = F.when(jsonx.serialised_chars(forms[0]) <= most, 1).when(jsonx.serialised_chars(forms[1]) <= most, 2).otherwise(3)
    shown = rows.withColumn("form", chosen).select(case, order, "form", F.when(F.col("form") == 1, F.to_json(forms[0])).when(F.col("form") == 2, F.to_json(forms[1])).otherwise(F.to_json(forms[2])).alias("record"))
    return budget_prefix(shown, [case], [order], F.char_length("record").cast("long"), total).where(F.col("running_cost") <= total).drop("running_cost")


def ledger_record(entries: DataFrame) -> Column:
    """An entry as JSON with only what it holds; long descriptions and notes are cut."""
    shown = {"record_id": F.col("row_id")}
    for f in LEDGER_FIELDS:
        if f in entries.columns:
            value = F.nullif(F.col(f).cast("string"), F.lit(""))
            shown[f] = F.substring(value, 1, 160) if f == "description" else value
    if "user_note" in entries.columns:
        shown["reviewer_note"] = F.substring(F.nullif(F.col("user_note"), F.lit("")), 1, 200)
    return F.to_json(F.struct(*[c.alias(f) for f, c in shown.items()]))


def heads(collections: dict[str, DataFrame], case: str, order: str) -> DataFrame:
    """The first rows of each collection and case, as many as CONTEXT_ROWS says, in one table: case, collection, place, record (JSON)."""
    parts = []
    for name, df in collections.items():
        w = Window.partitionBy(case).orderBy(order)
        record = F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c not in (case, order)]))
        parts.append(df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= CONTEXT_ROWS[name]).select(case, F.lit(name).alias("collection"), "place", record.alias("record")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
