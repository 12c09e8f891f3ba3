"""Long agreements: pages in order, clauses with the terms and clauses that belong to them, answers cut to what was offered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational, review
from .graph import neighbours
from .jsontree import named_values
from .relational import known_ids, systematic_sample

# Kinds of agreement that a classification may give, the keys under which ids stand in nested records.
ID_KEYS = ["node_id", "source_id", "page_id", "case_document_page_id", "case_document_id", "document_id", "evidence_id", "case_evidence_id", "fact_id", "case_fact_id", "case_fact_candidate_id", "issue_id", "case_issue_id", "event_id", "case_event_id", "party_id", "case_party_id", "message_id", "case_message_id", "timeline_id", "discrepancy_id", "finding_id"]
RELATED, DEFINED = 12, 30


def pages_in_order(pages: DataFrame, agreement: str) -> DataFrame:
    """page_id, document_id, page_number, page_text, page_summary and place of the pages that have an id."""
    there = pages.columns
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in there], F.lit(""))
    out = pages.select(agreement, first("case_document_page_id", "page_id").alias("page_id"), first("case_document_id", "document_id").alias("document_id"), F.coalesce(F.col("page_number").try_cast("int"), F.lit(0)).alias("page_number"), first("page_text").alias("page_text"), first("page_summary").alias("page_summary")).where("page_id <> ''")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(agreement).orderBy("document_id", "page_number", "page_id")))


def clause_parts(pages: DataFrame, agreement: str, target: int = review.CHUNK_TARGET, hard: int = review.CHUNK_HARD) -> DataFrame:
    """Pages (in order, with place) with the chunk that a model reads them in."""
    return review.text_chunks(pages, [agreement], "place", "page_text", target, hard)


def units(clauses: DataFrame, edges: DataFrame, definitions: DataFrame, missing: DataFrame) -> DataFrame:
    """Clauses (agreement_id, clause_id, text) as units of review: related (clauses that an edge leads to or from, 12 at most),
    terms (defined terms that the text contains, 30 at most) and missing (open points that name the clause)."""
    whole = lambda c: F.struct("agreement_id", F.col(c).alias("clause_id"))
    pairs = edges.select(whole("source_id").alias("a"), whole("target_id").alias("b"))
    near = neighbours(pairs, "a", "b", RELATED).select(F.col("node.agreement_id").alias("agreement_id"), F.col("node.clause_id").alias("clause_id"), F.transform("neighbours", lambda n: n["clause_id"]).alias("related"))
    used = review.clause_terms(clauses, definitions).groupBy("agreement_id", "clause_id").agg(F.slice(F.array_sort(F.collect_set("term")), 1, DEFINED).alias("terms"))
    # a point names clauses by their ids: they are read out of its text, so no point meets every clause
    named = missing.select("agreement_id", "point", F.explode(F.array_distinct(F.regexp_extract_all("point", F.lit(r"CL_[0-9]{4,}"), F.lit(0)))).alias("clause_id"))
    open_ = named.groupBy("agreement_id", "clause_id").agg(F.array_sort(F.collect_set("point")).alias("missing"))
    out = clauses
    for more, c in ((near, "related"), (used, "terms"), (open_, "missing")):
        out = out.join(more, ["agreement_id", "clause_id"], "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def summaries(clauses: DataFrame, agreement: str = "agreement_id", chars: int = 29_400, each: int = 400) -> DataFrame:
    """The first clauses of an agreement with the start of their text, as many as the budget holds."""
    from .relational import budget_prefix

    short = clauses.withColumn("excerpt", F.substring("text", 1, each))
    return budget_prefix(short, [agreement], ["clause_id"], F.char_length(F.to_json(F.struct("clause_id", "excerpt"))).cast("long"), chars)


def classified(answer: Column, allowed: list[str], otherwise: str) -> Column:
    """One of the allowed names; otherwise for anything else."""
    said = F.regexp_replace(F.lower(F.trim(F.coalesce(answer, F.lit("")))), r"[\s-]+", "_")
    return F.when(said.isin(allowed), said).otherwise(F.lit(otherwise))


def pages_to_classify(pages: DataFrame, agreement: str) -> DataFrame:
    """The pages that a classification reads: all, or first, last and some between of a long agreement."""
    return systematic_sample(pages, [agreement], ["place"], place="_at").drop("_at")


def classification_material(pages: DataFrame, agreement: str, chars: int = 3500) -> DataFrame:
    """agreement, page_id, document_id, page_number, text: what a classification reads, the start of each page's summary, or of its
    text where it has none."""
    chosen = pages_to_classify(pages_in_order(pages, agreement), agreement)
    return chosen.select(agreement, "page_id", "document_id", "page_number", F.substring(F.coalesce(F.nullif("page_summary", F.lit("")), F.col("page_text")), 1, chars).alias("text"))


def grounded_reviews(reviews: DataFrame, offered: DataFrame, keys: list[str], otherwise: str = "No applicable authority was found for this clause.") -> DataFrame:
    """Reviews of units (keys, support_status, finding, authority_ids) that cite only what their own unit was offered (keys, node_id).

    Ids are compared without blanks around them and kept once, in the order cited. A unit that calls itself supported and
    cites nothing that was offered is unsupported, with a finding that says so. Null lists are empty; a null id is none.
    """
    cited = reviews.select(*keys, F.posexplode("authority_ids").alias("_at", "_id")).withColumn("_id", F.trim("_id")).groupBy(*keys, "_id").agg(F.min("_at").alias("_at"))
    known = offered.select(*keys, F.trim("node_id").alias("_id")).where("_id <> ''").distinct()
    good = cited.join(known, [*keys, "_id"], "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_good"))
    out = reviews.join(good, keys, "left").withColumn("authority_ids", F.coalesce("_good", F.array().cast("array<string>"))).drop("_good")
    bare = F.coalesce(F.col("support_status") == "supported", F.lit(False)) & (F.size("authority_ids") == 0)
    return out.withColumns({"support_status": F.when(bare, "unsupported").otherwise(F.col("support_status")), "finding": F.when(bare, otherwise).otherwise(F.col("finding"))})


def synthesis_groups(reviews: DataFrame, agreement: str, order: str, target: int = review.CHUNK_TARGET, hard: int = review.CHUNK_HARD) -> DataFrame:
    """agreement, group_no, clauses, reviews: an agreement's reviews (JSON, in order) in groups of so many characters, one call each.
    The last call reads the groups' answers alone, never all reviews again."""
    record = F.to_json(F.struct(*[c for c in reviews.columns if c not in (agreement, order)]))
    sized = reviews.select(agreement, order, record.alias("review")).withColumn("_cost", F.char_length("review").cast("long"))
    numbered = relational.chunk_by_cost(sized, [agreement], order, "_cost", target, hard)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "review"))), lambda x: x["review"])
    return numbered.groupBy(agreement, F.col("chunk_no").alias("group_no")).agg(F.count(F.lit(1)).alias("clauses"), listed.alias("reviews"))


def package_authorities(offered: DataFrame, agreement: str, order: str) -> DataFrame:
    """Each authority of an agreement once, as it was found last, at the place where it was found first. Rows without node_id go."""
    named = offered.withColumn("node_id", F.trim(F.col("node_id"))).where("node_id <> ''")
    return relational.keep_last(named, [agreement, "node_id"], order)


def harvested_ids(records: DataFrame, keys: list[str], sections: str | list[str]) -> DataFrame:
    """keys, id: every text or number that stands under one of ID_KEYS anywhere in the JSON texts of the sections, distinct.
    Blank ones and a number 0 are no ids."""
    columns = [sections] if isinstance(sections, str) else sections
    found = F.concat(*[F.coalesce(named_values(F.col(c), ID_KEYS), F.array().cast("array<struct<name:string,value:string>>")) for c in columns])
    return records.select(*keys, F.explode(F.transform(found, lambda m: F.trim(m["value"]))).alias("id")).where("id <> ''").distinct()


def answered(answers: DataFrame, allowed: DataFrame, keys: list[str], cited: str = "source_ids", otherwise: str = "The records do not say enough to answer this.") -> DataFrame:
    """Answers with only such citations as were offered (allowed: id); a blank answer says so and is marked insufficient."""
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    checked = known_ids(answers, keys, cited, allowed, "id")
    return checked.withColumns({"insufficient_support": F.coalesce("insufficient_support", F.lit(False)) | blank, "answer": F.when(blank, F.lit(otherwise)).otherwise(F.col("answer"))})
