"""Amounts and currencies. Amounts are decimal(38,6); a text that can be read in two ways is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, clean, let

AMOUNT = "decimal(38,6)"
# Fields of a fact that hold amounts, in the order in which one of them stands for the fact.
PRIMARY_ORDER = ["amount", "paid_amount", "remaining_amount", "amount_due", "balance", "debit", "credit"]
AMOUNT_FIELDS = ["amount", "debit", "credit", "balance", "amount_due", "paid_amount", "remaining_amount"]
# Currency codes and their markers in upper-case text between blanks.
FOREIGN = ["QATAR", "OMAN", "YEMEN", "IRAN", "قطري", "عماني", "يمني", "إيراني", "ايراني"]
CURRENCIES = {
    "USDT": ["USDT", "TETHER"],
    "USD": ["USD", "US$", "دولار أمريكي", "US DOLLAR"],
    "EUR": ["EUR", "€", "يورو"],
    "SAR": ["SAR", "ر.س", "ريال", " SR ", "RIYAL", "RIAL"],
}
LOOSE_CURRENCIES = {
    "USDT": ["USDT", "TETHER"],
    "USD": ["USD", "$", "دولار", "DOLLAR"],
    "EUR": ["EUR", "€", "يورو"],
    "SAR": ["SAR", "ر.س", "ريال", "ريالا", " SR ", "SAUDI RIYAL"],
}
DEBIT_WORDS = ["خصم", "سحب", "تحويل صادر", "رسوم", "فاتورة", "purchase", "pos", "fee", "debit", "مدين"]
CREDIT_WORDS = ["إيداع", "ايداع", "تحويل وارد", "بيع", "حوالة واردة", "راتب", "credit", "deposit", "refund", "دائن"]


def parse_amount(x: Column) -> Column:
    """A printed amount with thousands separators, decimal comma or point, Eastern digits, currency text or a sign.

    Null where the text has no number or can be read in two ways ("1.000"). Hyphens within digits are dropped.
    """
    text = F.translate(ascii_digits(clean(x)), "٬٫\u00a0", ",. ")

    def signed(shown: Column) -> Column:
        figures = F.trim(F.regexp_replace(shown, r"[^0-9,.\- ]", ""))
        negative = lambda f: (F.trim(shown).startswith("(") & F.trim(shown).endswith(")")) | f.startswith("-") | f.endswith("-")
        return let(figures, lambda f: let(_plain_number(F.trim(F.replace(f, F.lit("-"), F.lit("")))), lambda v: F.when(negative(f), -v).otherwise(v)))

    # most amounts are printed plainly; the same value comes from one pattern
    return F.when(x.rlike(r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)\.[0-9]{1,2}$"), F.replace(x, F.lit(","), F.lit("")).try_cast(AMOUNT)).when(x.isNotNull(), let(text, signed)).cast(AMOUNT)


def _plain_number(figures: Column) -> Column:
    """The value of digits with separators and blanks, by the form of the whole."""
    drop = lambda c, sep: F.replace(c, F.lit(sep), F.lit(""))
    spaced = figures.rlike(r"[0-9]\s+[0-9]")
    joined = F.when(spaced & ~figures.rlike(r"^[0-9]{1,3}( [0-9]{3})+([.,][0-9]+)?$"), F.lit(None)).otherwise(drop(figures, " "))

    def read(n: Column) -> Column:
        return (
            F.when(n.rlike(r"^[0-9]+$"), n)
            .when(n.rlike(r"^[0-9]+,[0-9]{3}$"), drop(n, ","))  # a single comma before three digits groups
            .when(n.rlike(r"^[0-9]+\.[0-9]{3}$"), F.lit(None))  # a single point there may group or end: not read
            .when(n.rlike(r"^[0-9]+[.,][0-9]+$"), F.replace(n, F.lit(","), F.lit(".")))
            .when(n.rlike(r"^[0-9]{1,3}((,[0-9]{3}){2,}|(\.[0-9]{3}){2,})$"), F.regexp_replace(n, "[.,]", ""))
            .when(n.rlike(r"^[0-9]{1,3}(,[0-9]{3})*\.[0-9]+$"), drop(n, ","))
            .when(n.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$"), F.replace(drop(n, "."), F.lit(","), F.lit(".")))
        )

    return let(joined, lambda n: read(n).try_cast(AMOUNT))


def format_amount(x: Column) -> Column:
    """Two decimals with grouping commas."""
    return F.format_number(x, 2)


def last_separator_amount(x: Column) -> Column:
    """The older rule: the last separator is the decimal one, whatever follows it. Null if unreadable."""
    kept = F.regexp_replace(ascii_digits(F.coalesce(x, F.lit(""))), r"[^0-9.,\-]", "")
    comma_last = F.locate(",", F.reverse(kept)) > 0
    comma_later = comma_last & ((F.locate(".", F.reverse(kept)) == 0) | (F.locate(",", F.reverse(kept)) < F.locate(".", F.reverse(kept))))
    number = F.when(comma_later, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit("")))
    return F.when(number.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number).try_cast(AMOUNT)


def normalise_amount(x: Column) -> Column:
    """last_separator_amount() as text with two decimals; "—" for no text, the text itself if unreadable."""
    trimmed = F.trim(ascii_digits(F.coalesce(x, F.lit(""))))
    empty = (F.regexp_replace(trimmed, r"[^0-9.,\-]", "") == "") | (trimmed == "—")
    return F.when(empty, F.lit("—")).otherwise(F.coalesce(format_amount(last_separator_amount(x)), x))


def amount_for_matching(x: Column) -> Column:
    """last_separator_amount() with Eastern separators and with brackets as a sign, to compare two readings."""
    text = F.translate(ascii_digits(F.trim(x)), "٬٫", ",.")
    bracketed = text.startswith("(") & text.endswith(")")
    inner = F.regexp_replace(text, r"^[()]+|[()]+$", "")
    value = last_separator_amount(inner)
    return F.when(bracketed, -F.abs(value)).otherwise(value).cast(AMOUNT)


def _coded(upper: Column, markers: dict[str, list[str]]) -> Column:
    found = None
    for code, words in markers.items():
        hit = upper.contains(words[0])
        for w in words[1:]:
            hit = hit | upper.contains(w)
        found = F.when(hit, F.lit(code)) if found is None else found.when(hit, F.lit(code))
    return found


def currency(x: Column) -> Column:
    """The code of a currency text; other countries' riyals and unknown texts stay as written, in upper case. Never a default."""

    def coded(text: Column, upper: Column) -> Column:
        foreign = F.lit(False)
        for word in FOREIGN:
            foreign = foreign | upper.contains(word)
        return F.when(foreign, text).otherwise(F.coalesce(_coded(upper, CURRENCIES), text))

    return F.when(x.isNotNull(), let(F.upper(clean(x)), lambda text: let(F.concat(F.lit(" "), text, F.lit(" ")), lambda upper: coded(text, upper))))


def loose_currency(x: Column, hint: Column | None = None) -> Column:
    """The older marker list; the hint counts only where there is no currency text at all."""
    text = F.trim(F.coalesce(x, F.lit("")))
    wrap = lambda c: F.concat(F.lit(" "), F.upper(c), F.lit(" "))
    from_hint = F.coalesce(_coded(wrap(F.coalesce(hint, F.lit(""))), LOOSE_CURRENCIES), F.lit("")) if hint is not None else F.lit("")
    return F.when(text.isin("", "—"), from_hint).otherwise(F.coalesce(_coded(wrap(text), LOOSE_CURRENCIES), F.upper(text)))


def direction(x: Column, description: Column) -> Column:
    """debit or credit: as said, else by words of the description (debit first), else unclear."""
    said = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    told = F.lower(F.coalesce(description, F.lit("")))
    any_of = lambda words: F.coalesce(*[F.when(told.contains(w), F.lit(True)) for w in words], F.lit(False))
    return F.when(said.isin("debit", "credit"), said).when(any_of(DEBIT_WORDS), F.lit("debit")).when(any_of(CREDIT_WORDS), F.lit("credit")).otherwise(F.lit("unclear"))


def primary_field(fact: Column) -> Column:
    """The name of the first amount field that can be read."""
    return F.coalesce(*[F.when(parse_amount(fact[f]).isNotNull(), F.lit(f)) for f in PRIMARY_ORDER])
