"""Bounded batches for review, merged reviews, clauses of long agreements."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, jsonx, text
from ..session import materialised
from .relational import chunk_by_cost, new_by_signature, stitch

# Limits of a batch and of a merge, in characters, and items a batch.
BATCH_CHARS, MERGE_CHARS, BATCH_ITEMS = 24_000, 26_000, 30
CHUNK_TARGET, CHUNK_HARD = 25_200, 32_200


class ModelClient(Protocol):
    """Answers prompts with JSON text; the engine only prepares inputs and cleans outputs."""

    def complete(self, prompts: list[str]) -> list[str]: ...


def call_model(df: DataFrame, prompt: str, client: ModelClient, answer: str = "answer") -> DataFrame:
    """df with the model's answer; a failed call gives null and its error, never a failed job. If a batch fails, its prompts
    are asked one by one, so one bad prompt costs no other row its answer."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{answer}` string, `{answer}_error` string"

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = client.complete(prompts)
            if len(said) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts, {len(said)} answers")
            return [(x, None) for x in said]
        except Exception as error:  # an outside service may fail in any way; the row says how
            return [(None, repr(error))] if len(prompts) == 1 else [pair for p in prompts for pair in ask([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pairs = ask(pdf[prompt].tolist()) if len(pdf) else []
            yield pdf.assign(**{answer: [a for a, _ in pairs], f"{answer}_error": [e for _, e in pairs]})

    return df.mapInPandas(run, schema)


def batches(items: DataFrame, keys: list[str], order: str, payload: Column, chars: int = BATCH_CHARS, most: int = BATCH_ITEMS) -> DataFrame:
    """items with chunk_no: consecutive items of a section within so many characters and items."""
    return chunk_by_cost(items.withColumn("_cost", jsonx.serialised_chars(payload).cast("long")), keys, order, "_cost", chars, chars, most).drop("_cost")


def text_chunks(pages: DataFrame, keys: list[str], order: str, page_text: str, target: int = CHUNK_TARGET, hard: int = CHUNK_HARD) -> DataFrame:
    return chunk_by_cost(pages.withColumn("_cost", F.char_length(page_text).cast("long")), keys, order, "_cost", target, hard).drop("_cost")


def merge_reviews(parts: DataFrame, keys: list[str], order: str, lists: list[str]) -> DataFrame:
    """Partial reviews as one: the least score, complete and ready only if all are, lists and summaries united in order."""
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
    summary = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("summary").alias("v")))), lambda x: x["v"])), "\n")
    return parts.groupBy(*keys).agg(F.min("score").alias("score"), F.bool_and("is_complete").alias("is_complete"), F.bool_and("is_ready").alias("is_ready"), *[union(c) for c in lists], summary.alias("summary"))


def clauses(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Stitched clauses with ids: parts has chunk_no, pos, text, into_next, from_previous."""
    whole = stitch(parts, keys, "chunk_no", "pos", "text", "into_next", "from_previous")
    return whole.withColumn("clause_id", ids.ordinal_id("CL_%04d", F.col("clause_no").cast("int")))


def clause_terms(clause_rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Clauses and the defined terms that their text contains; definitions are the few of one agreement, joined within its key."""
    clauses_ = clause_rows.select("agreement_id", "clause_id", text.casefold(F.col("text")).alias("_text"))  # once a clause, not once a pair
    terms = definitions.select("agreement_id", "term", text.casefold(F.col("term")).alias("_term"))
    return clauses_.join(terms, "agreement_id").where(F.contains("_text", "_term")).select("agreement_id", "clause_id", "term")


def grounded(answers: DataFrame, allowed: DataFrame, keys: list[str], cited: str, id_column: str) -> DataFrame:
    """Answers with only such citations as were offered; supported without any becomes unsupported."""
    from .relational import known_ids

    checked = known_ids(answers, keys, cited, allowed, id_column)
    return checked.withColumn("supported", F.col("supported") & (F.size(cited) > 0))


def shrunk(page: Column, trimmed: Column, bare: Column, most: int = 2000) -> Column:
    """The first of three forms of a page's record that fits into so many characters as JSON; the last if none does."""
    return F.when(jsonx.serialised_chars(page) <= most, F.to_json(page)).when(jsonx.serialised_chars(trimmed) <= most, F.to_json(trimmed)).otherwise(F.to_json(bare))


# Lists of a review and how many of each go on to a merge; texts likewise.
REVIEW_LISTS = ["questions", "blocking_gaps", "missing_information", "contradictions", "missing_evidence", "unverified_claims", "timeline_gaps", "party_gaps", "legal_reference_gaps", "recommended_actions", "source_ids"]
MERGE_CAPS = {"blocking_gaps": 12, "missing_information": 18, "contradictions": 12, "missing_evidence": 12, "recommended_actions": 12, "source_ids": 40}


def normalised(reviews: DataFrame) -> DataFrame:
    """Reviews (lists of REVIEW_LISTS, completeness_score, is_complete, ready_for_analysis, summary, next_question as text) made
    safe: distinct lists, a score of 0 to 100, flags, and the next question among the questions."""
    none = F.array().cast("array<string>")
    lists = {c: F.array_distinct(F.coalesce(c, none)) if c in reviews.columns else none for c in REVIEW_LISTS}
    out = reviews.withColumns({
        **lists,
        "completeness_score": F.coalesce(jsonx.bounded_score(F.col("completeness_score")), F.lit(0)),
        "is_complete": F.coalesce(jsonx.truth(F.col("is_complete")), F.lit(False)),
        "ready_for_analysis": F.coalesce(jsonx.truth(F.col("ready_for_analysis")), F.lit(False)),
        "summary": F.trim(F.coalesce("summary", F.lit(""))),
        "next_question": F.trim(F.coalesce("next_question", F.lit(""))),
    })
    asked = F.col("next_question") != ""
    known = F.array_contains("questions", F.col("next_question"))
    return out.withColumns({
        "questions": F.when(asked & ~known, F.concat(F.array("next_question"), F.col("questions"))).otherwise(F.col("questions")),
        "next_question": F.when(asked, F.col("next_question")).otherwise(F.coalesce(F.get("questions", F.lit(0)), F.lit(""))),
    })


def for_merge(reviews: DataFrame) -> DataFrame:
    """Normalised reviews with short texts and the first entries of each list; all kinds of gaps are missing information."""
    gaps = F.array_distinct(F.concat("missing_information", "party_gaps", "timeline_gaps", "legal_reference_gaps", "unverified_claims"))
    united = reviews.withColumns({"missing_information": gaps, "summary": text.truncate(F.col("summary"), 1200), "next_question": text.truncate(F.col("next_question"), 500)})
    return united.withColumns({c: F.slice(c, 1, n) for c, n in MERGE_CAPS.items()}).drop(*[c for c in REVIEW_LISTS if c not in MERGE_CAPS and c != "questions"])


def merge_groups(reviews: DataFrame, keys: list[str], order: str, chars: int = MERGE_CHARS) -> DataFrame:
    """Reviews for a merge with chunk_no: consecutive ones within so many characters."""
    payload = F.struct(*[c for c in reviews.columns if c not in (*keys, order)])
    return chunk_by_cost(reviews.withColumn("_cost", jsonx.serialised_chars(payload).cast("long")), keys, order, "_cost", chars, chars).drop("_cost")


def merge_tree(parts: DataFrame, keys: list[str], order: str, lists: list[str], chars: int = MERGE_CHARS, levels: int = 8) -> DataFrame:
    """merge_reviews() level by level: groups within chars are merged until every key has one group, or until a level merges
    nothing more; then what is left is merged at once. parts: keys, order, score, is_complete, is_ready, lists, summary."""
    columns = [order, "score", "is_complete", "is_ready", *lists, "summary"]
    now, before = parts.select(*keys, *columns), None
    for _ in range(levels):
        sized = now.withColumn("_cost", jsonx.serialised_chars(F.struct(*columns)).cast("long"))
        numbered = chunk_by_cost(sized, keys, order, "_cost", chars, chars).drop("_cost")
        groups, most = numbered.select(*keys, "chunk_no").distinct().agg(F.count(F.lit(1)), F.max("chunk_no")).first()
        if groups == before or (most or 0) <= 1:
            break
        before = groups
        # written, so that a level starts from the one before, not from the first
        now = materialised(merge_reviews(numbered, [*keys, "chunk_no"], order, lists).withColumnRenamed("chunk_no", order).select(*keys, *columns))
    return merge_reviews(now, keys, order, lists)


def section_batches(sections: dict[str, DataFrame], keys: list[str], order: str, base: DataFrame, chars: int = BATCH_CHARS, most: int = BATCH_ITEMS) -> DataFrame:
    """Batches of all sections of each key: keys, section, chunk_no, items (JSON, in order). A key of base without any item has one
    batch of section "case". Items that alone pass the limit fail the query: they can't be sent."""
    found = []
    for name, items in sections.items():
        record = F.to_json(F.struct(*[c for c in items.columns if c not in keys]))
        rows = items.select(*keys, order, record.alias("item")).withColumn("_cost", F.char_length("item").cast("long"))
        fits = F.when(F.col("_cost") <= chars, F.col("_cost")).otherwise(F.raise_error(F.lit(f"an item of {name} passes {chars} characters")).cast("long"))
        numbered = chunk_by_cost(rows.withColumn("_cost", fits), keys, order, "_cost", chars, chars, most)
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "item"))), lambda x: x["item"])
        found.append(numbered.groupBy(*keys, "chunk_no").agg(listed.alias("items")).withColumn("section", F.lit(name)))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    bare = base.select(*keys).join(all_.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(1).alias("chunk_no"), F.array().cast("array<string>").alias("items"), F.lit("case").alias("section"))
    return all_.unionByName(bare)


def follow_up_evidence(actions: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Evidence to ask for, from a review's actions (keys, order, action_type, evidence_type, evidence_description, referenced_in_document,
    reason): only request_evidence counts. keys, order, evidence_title, evidence_type, description and the statuses of a request.

    The description says where a document was referred to and what it is for. What existing (keys, evidence_type, description) has
    already, or an earlier action asks for, is left out: type and description are compared in lower case with single blanks.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    given = lambda c, before, after: F.when(said(c) != "", F.concat(F.lit(before), said(c), F.lit(after)))
    whole = F.concat_ws("\n", F.nullif(said("evidence_description"), F.lit("")), given("referenced_in_document", "Referenced in document: ", "."), given("reason", "Purpose: ", ""))
    signed = lambda df, kind, description: df.withColumns({"_kind": text.squeeze(kind), "_said": text.squeeze(description)})
    asked = actions.where(F.col("action_type") == "request_evidence").select(*keys, order, said("evidence_type").alias("evidence_type"), whole.alias("description"))
    new = new_by_signature(signed(asked, F.col("evidence_type"), F.col("description")), signed(existing, F.col("evidence_type"), F.col("description")), [*keys, "_kind", "_said"], [order])
    fixed = {"authenticity_status": "not_received", "completeness_status": "not_received", "relevance_status": "requested", "reliability_status": "not_assessed", "review_status": "requested"}
    title = F.coalesce(F.nullif("evidence_type", F.lit("")), F.lit("Requested evidence"))
    return new.select(*keys, order, title.alias("evidence_title"), "evidence_type", "description", *[F.lit(v).alias(c) for c, v in fixed.items()])


def reply(actions: Column, acknowledgement: Column, most_questions: int = 3) -> Column:
    """An interviewer's answer: the acknowledgement, evidence that is asked for, up to three questions, what is to be confirmed.
    actions: array<struct<action_type, question, evidence_type, evidence_description>>."""
    of = lambda kind: F.filter(actions, lambda a: a["action_type"] == kind)
    numbered = lambda items, shown: F.array_join(F.transform(items, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), shown(a))), "\n")
    block = lambda title, items, body: F.when(F.size(items) > 0, F.concat(F.lit(f"### {title}\n"), body))
    evidence, asked, confirmed = of("request_evidence"), F.slice(F.filter(of("ask_question"), lambda a: F.trim(F.coalesce(a["question"], F.lit(""))) != ""), 1, most_questions), F.filter(of("confirm_fact"), lambda a: F.trim(F.coalesce(a["question"], F.lit(""))) != "")
    piece = lambda a: F.concat_ws(": ", F.coalesce(F.nullif(F.trim(a["evidence_type"]), F.lit("")), F.lit("document")), F.nullif(F.trim(a["evidence_description"]), F.lit("")))
    nothing = F.when(F.size(actions) == 0, F.lit("Nothing more is needed."))
    return F.concat_ws(
        "\n\n", F.nullif(F.trim(acknowledgement), F.lit("")), block("Evidence", evidence, numbered(evidence, piece)), block("Questions", asked, numbered(asked, lambda a: F.trim(a["question"]))),
        block("To confirm", confirmed, F.array_join(F.transform(confirmed, lambda a: F.concat(F.lit("- "), F.trim(a["question"]))), "\n")), nothing,
    )
