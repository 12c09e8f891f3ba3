"""Claims against evidence: cleaned evaluations, cited records, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from .ledger import totals_by_currency

# Results of an evaluation, in the order in which they are listed.
RESULTS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTED", "NOT_VERIFIABLE", "NO_FINANCIAL_EVIDENCE", "NOT_FINANCIAL_CLAIM"]


def result(x: Column) -> Column:
    """A known result; NOT_VERIFIABLE for anything else."""
    said = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"[\s-]+", "_")
    return F.when(said.isin(RESULTS), said).otherwise(F.lit("NOT_VERIFIABLE"))


def claim_id(given: Column, index: Column) -> Column:
    """The id as given, else CLM_ and the place from 1."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.format_string("CLM_%03d", index + 1))


def evidence(groups: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (claim_id, kind, ord, text, ids array) against known (row_id): entries with the ids that exist, and per claim the unverified ids.

    An entry that cited ids and keeps none is dropped; one without ids keeps its text.
    """
    long = groups.select("claim_id", "kind", "ord", F.posexplode_outer("ids").alias("at", "row_id")).join(known.select("row_id", F.lit(True).alias("known")).distinct(), "row_id", "left")
    pick = lambda hit: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("at", "row_id")))), lambda x: x["row_id"]))
    kept = long.groupBy("claim_id", "kind", "ord").agg(pick(F.col("known").isNotNull()).alias("_ids"))
    entries = groups.join(kept, ["claim_id", "kind", "ord"]).where((F.size("_ids") > 0) | (F.size(F.coalesce("ids", F.array().cast("array<string>"))) == 0)).drop("ids").withColumnRenamed("_ids", "ids")
    loose = long.where(F.col("known").isNull() & F.col("row_id").isNotNull()).groupBy("claim_id").agg(F.array_sort(F.collect_set("row_id")).alias("unverified"))
    return entries, loose


def with_ledger(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row a cited record: the ledger's columns, or no_longer_in_ledger."""
    cited = entries.select("claim_id", "kind", "ord", F.explode("ids").alias("row_id"))
    return cited.join(ledger.withColumn("_there", F.lit(True)), "row_id", "left").withColumn("no_longer_in_ledger", F.col("_there").isNull()).drop("_there")


def claim_totals(cited: DataFrame) -> DataFrame:
    """Totals a claim and currency over distinct records."""
    return totals_by_currency(cited.where(~F.col("no_longer_in_ledger")), ["claim_id"])


def result_order(x: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for pair in zip(RESULTS, range(len(RESULTS)), strict=True) for v in pair])
    return F.coalesce(F.try_element_at(ranks, x), F.lit(len(RESULTS)))


def claims_source(summary: DataFrame, register: DataFrame) -> DataFrame:
    """Allegations of the summary, or of the register where the summary has none; with their source."""
    from .relational import fallback_table

    return fallback_table(summary.withColumn("source", F.lit("summary")), register.withColumn("source", F.lit("register")))


# Kinds of evidence; texts that say nothing.
GROUPS = ["supporting_evidence", "partially_supporting_evidence", "contradicting_evidence", "unresolved_evidence"]
NOTHING = ["none", "n/a", "-"]


def text_list(items: Column) -> Column:
    """Trimmed texts of an array, without those that say nothing."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: (x != "") & ~F.lower(x).isin(NOTHING))


def amount_text(x: Column) -> Column:
    """An amount as formatted, or as written where it can't be read; "" for none."""
    said = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(said).isin("", "null", "none", "n/a"), F.lit("")).otherwise(F.coalesce(money.format_amount(money.parse_amount(said)), said))


def evaluations(rows: DataFrame) -> DataFrame:
    """Evaluations (claim_index, claim_id, result, claimed_amount, missing_evidence, claim, evidence_record_ids: the older single list) made
    safe: an id, a known result (with the wording where it was another), amounts, and groups (kind, ord, ids) to check against
    the ledger with evidence()."""
    raw = F.when(result(F.col("result")) != F.regexp_replace(F.upper(F.trim(F.coalesce("result", F.lit("")))), r"[\s-]+", "_"), F.col("result"))
    return rows.withColumns({
        "claim_id": claim_id(F.col("claim_id"), F.col("claim_index")), "result_raw": raw, "result": result(F.col("result")), "claimed_amount": amount_text(F.col("claimed_amount")),
        "missing_evidence": text_list(F.col("missing_evidence")), "parent_claim": F.trim(F.coalesce("claim", F.lit(""))),
        "groups": F.when(F.size(F.coalesce("evidence_record_ids", F.array().cast("array<string>"))) > 0, F.array(F.struct(F.lit(GROUPS[0]).alias("kind"), F.lit(1).alias("ord"), F.array_distinct("evidence_record_ids").alias("ids")))),
    })


ENTRY = "struct<record_ids:array<string>,record_id:string,explanation:string,description:string>"


def grouped_evidence(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluations (claim_id; the arrays of ENTRY in GROUPS, financial_evidence_found and contradictions; evidence_record_ids) against the
    ledger (row_id): entries (claim_id, kind, ord, text, ids) and per claim the unverified ids, in order of their text.

    The older lists count only where a claim has no group for them once unknown records have gone: record ids as one entry of supporting
    evidence, contradictions as contradicting evidence. An entry that rests on unknown records alone goes; so does one with neither ids nor text.
    """
    none = F.array().cast("array<string>")
    listed = lambda c, kind: rows.select("claim_id", F.lit(kind).alias("kind"), F.posexplode(F.col(c).cast(f"array<{ENTRY}>")).alias("ord", "e"))

    def entries(df: DataFrame) -> DataFrame:
        ids = F.concat(F.coalesce("e.record_ids", none), F.when(F.coalesce("e.record_id", F.lit("")) != "", F.array("e.record_id")).otherwise(none))
        said = F.trim(F.coalesce(F.nullif("e.explanation", F.lit("")), F.col("e.description"), F.lit("")))
        return df.select("claim_id", "kind", "ord", said.alias("text"), F.array_distinct(F.filter(ids, lambda x: F.trim(x) != "")).alias("ids"))

    def checked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept, loose = evidence(df, known)
        return kept.where((F.size("ids") > 0) | (F.col("text") != "")), loose

    groups = listed(GROUPS[0], GROUPS[0])
    for g in GROUPS[1:]:
        groups = groups.union(listed(g, g))
    kept, loose = checked(entries(groups))
    has = lambda *kinds: kept.where(F.col("kind").isin(*kinds)).select("claim_id").distinct()
    found = F.transform(F.coalesce(F.col("financial_evidence_found").cast(f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>")), lambda e: F.coalesce(e["record_id"], F.lit("")))
    older_ids = F.array_distinct(F.filter(F.concat(F.coalesce("evidence_record_ids", none), found), lambda x: F.trim(x) != ""))
    older = rows.select("claim_id", F.lit(GROUPS[0]).alias("kind"), F.lit(0).alias("ord"), F.lit("").alias("text"), older_ids.alias("ids")).where(F.size("ids") > 0).join(has(*GROUPS[:2]), "claim_id", "left_anti")
    against = entries(listed("contradictions", GROUPS[2])).join(has(GROUPS[2]), "claim_id", "left_anti")
    kept_older, loose_older = checked(older.union(against))
    unverified = loose.union(loose_older).groupBy("claim_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("unverified")))).alias("unverified"))
    return kept.unionByName(kept_older), unverified


def strategy_rows(strategies: DataFrame, case: str) -> DataFrame:
    """A strategy (primary and alternatives: structs of description, fact_ids; actions: structs of action_type, description, priority) as
    rows: its theories, the primary one first, then its actions."""
    theories = strategies.select(case, F.posexplode(F.concat(F.when(F.col("primary").isNotNull(), F.array("primary")).otherwise(F.array().cast(strategies.schema["alternatives"].dataType)), F.coalesce("alternatives", F.array().cast(strategies.schema["alternatives"].dataType)))).alias("at", "t"), F.col("primary").isNotNull().alias("_has"))
    first = (F.col("at") == 0) & F.col("_has")
    theory = theories.where("t IS NOT NULL").select(case, F.lit(0).alias("part"), "at", F.when(first, "primary").otherwise("alternative").alias("theory_type"), F.col("t.description").alias("theory_description"), F.to_json(F.coalesce("t.fact_ids", F.array().cast("array<string>"))).alias("facts_supporting_json"), F.lit("").alias("action_type"), F.lit("").alias("action_description"), F.lit("").alias("priority"))
    actions = strategies.select(case, F.posexplode("actions").alias("at", "a")).where("a IS NOT NULL").select(
        case, F.lit(1).alias("part"), "at", F.lit("").alias("theory_type"), F.lit("").alias("theory_description"), F.lit("[]").alias("facts_supporting_json"), F.coalesce("a.action_type", F.lit("")).alias("action_type"), F.coalesce("a.description", F.lit("")).alias("action_description"), F.coalesce(F.nullif("a.priority", F.lit("")), F.lit("medium")).alias("priority")
    )
    return theory.unionByName(actions)
