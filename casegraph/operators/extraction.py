"""Records out of page text and layout: line items, harvested values, headings, cascades of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text

# The patterns of a printed date, an amount and a reference.
DATE = r"(?<![0-9])[0-9]{1,2}[\-/.][0-9]{1,2}[\-/.][0-9]{2,4}(?![0-9])"
AMOUNT = r"(?iu)(?<![\p{L}\p{N}_])\(?-?[0-9٠-٩][0-9٠-٩,.٬٫\s]*\)?\s*(?:SAR|ر\.س|ريال(?:اً)?|USD|\$|EUR|€)?(?![\p{L}\p{N}_])"
CURRENCY = r"(?iu)SAR|ر\.س|ريال(?:اً)?|USD|\$|EUR|€"
REFERENCE = r"(?iu)(?:ref(?:erence)?|مرجع|رقم\s*العملية|transaction\s*no\.?)\s*[:#\-]?\s*([A-Za-z0-9\-/]{4,})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s\"'<>]+"
NUMBER = r"[0-9]+"
DEBIT, CREDIT = r"(?iu)\bdebit\b|مدين|خصم|سحب", r"(?iu)\bcredit\b|دائن|إيداع|ايداع"


def line_candidates(pages: DataFrame, page_text: str = "page_text") -> DataFrame:
    """One row for each line with a date and an amount; of several amounts the longest, the first of equal ones."""
    lines = pages.select(*[c for c in pages.columns if c != page_text], F.posexplode(F.split(F.col(page_text), "\n")).alias("line_index", "raw_line"))
    line = F.col("raw_line")
    date = F.regexp_extract(text.ascii_digits(line), DATE, 0)
    amounts = F.transform(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0)), lambda a: F.trim(a))
    found = lines.withColumns({"date_exact_text": date, "_amounts": amounts}).where((F.col("date_exact_text") != "") & (F.size("_amounts") > 0))
    amount = text.longest_first(F.col("_amounts"))
    return (
        found.withColumn("amount_exact_text", amount)
        .withColumns(
            {
                "currency_exact_text": F.regexp_extract("amount_exact_text", CURRENCY, 0),
                "debit_or_credit": F.when(line.rlike(DEBIT), "debit").when(line.rlike(CREDIT), "credit").otherwise(""),
                "reference_number": F.regexp_extract(line, REFERENCE, 1),
                "extraction_method": F.lit("text_line"),
            }
        )
        .drop("_amounts")
    )


def harvest(x: Column, pattern: str, most: int = 30) -> Column:
    """All matches in order of first appearance, distinct, at most so many."""
    return F.slice(F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0))), 1, most)


def body_size(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The median font size of a page, each block weighted by its characters (30 at most); 10.0 for a page without text."""
    weight = F.least(F.char_length("text"), F.lit(30))
    return blocks.groupBy(*keys).agg(F.coalesce(F.percentile("size", F.lit(0.5), F.greatest(weight, F.lit(0))), F.lit(10.0)).alias("body_size"))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The share of rectangle a (x0, y0, x1, y1) that lies within b."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, width * height / area).otherwise(F.lit(0.0))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: str = "page_id", share: float = 0.55) -> DataFrame:
    """Text blocks that no table of their page covers by so much. Joined on the page, so only its own rectangles meet."""
    corners = ("x0", "y0", "x1", "y1")
    t = tables.select(F.col(page).alias("_page"), *[F.col(c).alias(f"_{c}") for c in corners])
    hit = (F.col(page) == F.col("_page")) & (overlap({c: F.col(c) for c in corners}, {c: F.col(f"_{c}") for c in corners}) >= share)
    return blocks.join(t, hit, "left_anti")


def sections(blocks: DataFrame, page_keys: list[str], document_keys: list[str]) -> DataFrame:
    """blocks (x0, y0, size, text) in reading order with heading level (1 from 1.5 times the body size, 2 from 1.2) and the
    last level-1 heading so far as section."""
    ratio = F.col("size") / F.col("body_size")
    leveled = blocks.join(body_size(blocks, page_keys), page_keys).withColumn("level", F.when(ratio >= 1.5, 1).when(ratio >= 1.2, 2).otherwise(0))
    w = Window.partitionBy(*document_keys).orderBy(*[c for c in page_keys if c not in document_keys], "y0", "x0")
    return leveled.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cascade(fast: Column, fallback: Column, recovery: Column) -> Column:
    """struct<text, status>: the first reading that is not blank; any but the fast one needs review; none is a failure."""
    filled = [F.nullif(F.trim(c), F.lit("")) for c in (fast, fallback, recovery)]
    return F.struct(F.coalesce(*filled).alias("text"), F.when(filled[0].isNotNull(), "completed").when(F.coalesce(*filled[1:]).isNotNull(), "completed_review_required").otherwise("failed").alias("status"))


def consensus(primary: Column, secondary: Column, threshold: float = 0.85) -> Column:
    """Two readings of a page: struct<similarity, agreed, only_primary, only_secondary, reasons> of words and amounts."""
    words = lambda c: F.array_distinct(F.filter(F.split(text.normalise(c), " "), lambda w: w != ""))
    figures = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), lambda a: money.amount_for_matching(a)), lambda v: v.isNotNull()))
    a, b = figures(primary), figures(secondary)
    similarity = text.jaccard(words(primary), words(secondary))
    reasons = F.filter(
        F.array(
            F.when(F.trim(F.coalesce(primary, F.lit(""))) == "", "empty primary reading"), F.when(similarity < threshold, "readings differ"), F.when((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0), "amounts differ")
        ),
        lambda r: r.isNotNull(),
    )
    ordered = lambda c: F.array_sort(c)
    return F.struct(similarity.alias("similarity"), ordered(F.array_intersect(a, b)).alias("agreed"), ordered(F.array_except(a, b)).alias("only_primary"), ordered(F.array_except(b, a)).alias("only_secondary"), reasons.alias("reasons"))


# Patterns and words by which the parts of a page are found.
PAGE_DATE = r"(?<![0-9])[٠-٩0-9]{1,4}[\-/][٠-٩0-9]{1,2}[\-/][٠-٩0-9]{1,4}(?![0-9])"
PAGE_AMOUNT = r"(?iu)(?<![\p{L}\p{N}_])(?:SAR\s*)?[٠-٩0-9][٠-٩0-9,.]*\s*(?:ريال(?:اً)?|ر\.س|SAR)(?![\p{L}\p{N}_])"
CASE_NUMBER = r"(?iu)(?:رقم|برقم|مرجع|reference|case|complaint|subject)\s*[:#\-]?\s*([A-Za-z0-9٠-٩][A-Za-z0-9٠-٩/\-]{3,})"
LEGAL_REFERENCE = r"(?:المادة|نظام|اللائحة|تعميم|قرار)\s+(?:رقم\s*)?[A-Za-z0-9٠-٩/\-]+[^\n]{0,80}"
PARTY_LABELS = ["المدعي", "المدعية", "المدعى عليه", "المدعى عليها", "اسم العميل", "Customer Name", "From:", "To:"]
CLAIM_WORDS = ["يطلب", "تطلب", "المطالبة", "رفع الحجز", "فك الحجز", "يدعي", "تنكر", "ينكر", "request", "claim", "deny"]
EVIDENCE_MARKS = {"email": ["From:", "Subject:"], "table": ["|"], "statement": ["كشف الحساب"], "claim form": ["صحيفة دعوى"], "signature": ["التوقيع", "ختم", "موقع"]}
HEADERS = {"date": ["date", "تاريخ"], "debit": ["debit", "مدين"], "credit": ["credit", "دائن"], "balance": ["balance", "رصيد"], "amount": ["amount", "مبلغ", "قيمة"], "reference": ["ref", "مرجع", "رقم"], "description": ["description", "بيان", "الوصف"]}
PAGE_FIELDS = ["parties", "dates", "amounts", "case_numbers", "claims", "legal_references", "evidence_items"]


def tidy(items: Column, most: int = 30) -> Column:
    """Items with single blanks and without separators around them, distinct whatever their case, in order, at most so many."""
    return text.ordered_distinct(F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ |:-]+|[ |:-]+$", "")), most=most)


def label_values(x: Column, labels: list[str] = tuple(PARTY_LABELS)) -> Column:
    """What stands after each label on its line."""
    lines = F.transform(F.split(x, "\n"), lambda line: F.trim(F.regexp_replace(line, r"(?U)\s+", " ")))
    after = lambda line: F.filter(F.array(*[F.when(F.contains(line, F.lit(w)), F.substring(line, F.position(F.lit(w), line) + len(w), F.char_length(line))) for w in labels]), lambda v: v.isNotNull())
    return tidy(F.flatten(F.transform(lines, after)))


def page_fields(x: Column) -> dict[str, Column]:
    """What patterns alone find on a page, by field."""
    every = lambda pattern, group=0: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    said = lambda line: F.exists(F.array(*[F.lit(w) for w in CLAIM_WORDS]), lambda w: F.contains(line, w))
    marks = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)), F.lit(kind)) for kind, words in EVIDENCE_MARKS.items()]
    return {
        "parties": label_values(x),
        "dates": tidy(every(PAGE_DATE)),
        "amounts": tidy(every(PAGE_AMOUNT)),
        "case_numbers": tidy(every(CASE_NUMBER, 1)),
        "claims": tidy(F.filter(F.split(x, "\n"), said), 10),
        "legal_references": tidy(every(LEGAL_REFERENCE)),
        "evidence_items": F.filter(F.array(F.when(F.trim(x) != "", F.lit("page")), *marks), lambda m: m.isNotNull()),
    }


def page_summaries(pages: DataFrame, page_text: str = "page_text") -> DataFrame:
    """pages (page text, answer: a model's struct of summary, key_facts and the lists, or null) with page_summary, facts, the lists
    (the model's first, then what patterns found) and summary_status; without an answer the start of the text stands in."""
    whole = F.coalesce(F.col(page_text), F.lit(""))
    found = page_fields(whole)
    none = F.array().cast("array<string>")
    told = F.col("answer").isNotNull()
    start = F.substring(F.trim(F.regexp_replace(whole, r"(?U)\s+", " ")), 1, 900)
    summary = F.when(told, F.trim(F.coalesce("answer.summary", F.lit("")))).otherwise(start)
    key_facts = F.slice(tidy(F.coalesce("answer.key_facts", none)), 1, 10)
    of_model = {f.name for f in pages.schema["answer"].dataType.fields}
    lists = {f: tidy(F.concat(F.coalesce(f"answer.{f}", none), c)) if f in of_model else c for f, c in found.items()}
    out = pages.withColumns({"page_summary": summary, **lists})
    facts = F.when(F.size(key_facts) > 0, key_facts).when(F.col("page_summary") != "", F.array("page_summary")).otherwise(none)
    return out.withColumns({"facts": facts, "summary_status": F.when(told, "completed").otherwise("fallback_deterministic")})


def page_rows(pages: DataFrame) -> DataFrame:
    """Readings (page_text, processing_status, extraction_warning, summary_warning) as rows to store: a page without text has
    failed, warnings are one text."""
    body = F.trim(F.coalesce("page_text", F.lit("")))
    said = F.lower(F.trim(F.coalesce("processing_status", F.lit(""))))
    status = F.when(body == "", "failed").when(said == "", "completed").otherwise(said)
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    warning = F.concat_ws("\n", filled("extraction_warning"), F.concat(F.lit("summary:"), filled("summary_warning")))
    return pages.withColumns({"page_text": body, "processing_status": status, "extraction_warning": warning, "text_character_count": F.char_length(body)})


def table_candidates(tables: DataFrame) -> DataFrame:
    """Rows of printed tables (keys, header array, row_index, cells array) whose amount column holds a figure. Columns are told by
    words of their heading: each heading by the first kind that fits, each kind by its first heading; without an amount
    column the debit column stands for it, else the credit column."""

    def kind(name: Column) -> Column:
        cases = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w)), F.lit(k)) for k, words in HEADERS.items()]
        return F.coalesce(*cases, F.lit(""))

    kinds = F.transform("header", lambda h: kind(F.lower(F.trim(F.coalesce(h, F.lit(""))))))
    placed = tables.withColumn("_kinds", kinds)
    at = lambda k: F.nullif(F.array_position("_kinds", F.lit(k)), F.lit(0).cast("long"))
    cell = lambda place: F.trim(F.coalesce(F.get("cells", (place - 1).cast("int")), F.lit("")))
    figure = lambda k: F.coalesce(cell(at(k)).rlike("[0-9]"), F.lit(False))
    amount = cell(F.coalesce(at("amount"), at("debit"), at("credit")))
    told = {"date_exact_text": "date", "description": "description", "reference_number": "reference", "running_balance_exact_text": "balance"}
    return (
        placed.where(F.coalesce(amount.rlike("[0-9]"), F.lit(False)))
        .withColumns({**{f: F.coalesce(cell(at(k)), F.lit("")) for f, k in told.items()}, "amount_exact_text": amount, "debit_or_credit": F.when(figure("debit"), "debit").when(figure("credit"), "credit").otherwise(""), "raw_line": F.array_join("cells", " | "), "extraction_method": F.lit("native_table")})
        .drop("_kinds")
    )
