"""Arabic text that a PDF stores in the order in which it is drawn, put back into reading order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters, words and runs that are told apart, and the points of scores().
LETTER = "[ء-يٱ-ۓ]"
WORD = "[ء-يٱ-ۓً-ٰٟ]{2,}"
_RUN = r"[A-Za-z0-9٠-٩]"
LATIN_RUN = rf"[()\[\]#*]*{_RUN}(?:[A-Za-z0-9٠-٩ .,:;_*#@&%+=/\\'-]*{_RUN})?[()\[\]#*]*"
# Words that are frequent in bank statements and case files.
COMMON = [
    "ريال", "تحويل", "رسوم", "مبلغ", "حساب", "رصيد", "بطاقة", "شراء", "ايداع", "إيداع", "سحب", "دفع",
    "عبر", "مدى", "من", "الى", "إلى", "على", "في", "عن", "مع", "رقم", "تاريخ", "قيمة", "ضريبة", "خصم",
    "سداد", "قسط", "دائن", "مدين", "عميل", "بنك", "مصرف", "فاتورة", "حوالة", "واردة", "صادرة", "نقاط",
    "بيع", "تمويل", "فوائد", "غرامة", "عمولة", "اجمالي", "إجمالي", "المبلغ", "الرصيد", "البنك",
]
REVERSED = sorted({w[::-1] for w in COMMON} - {*COMMON})


def scores(line: Column) -> Column:
    """struct<logical, visual>: evidence for reading order and for drawing order in one line."""
    words = F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, f"(?!{LETTER}).", ""))
    usable = F.filter(words, lambda w: F.char_length(w) >= 2)
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    logical = F.aggregate(usable, F.lit(0), lambda s, w: s + points(w.isin(COMMON), 2) + points((F.char_length(w) >= 3) & w.startswith("ال"), 1) + points(w.endswith("ة"), 1))
    visual = F.aggregate(
        usable,
        F.lit(0),
        lambda s, w: s + points(~w.isin(COMMON) & w.isin(REVERSED), 2) + points((F.char_length(w) >= 3) & w.endswith("لا"), 1) + points(F.substring(w, 1, 1).isin("ة", "ى"), 2),
    )
    return F.struct(logical.alias("logical"), visual.alias("visual"))


def drawn(line: Column) -> Column:
    s = scores(line)
    return (s["visual"] >= 1) & (s["visual"] > s["logical"])


def read_back(line: Column) -> Column:
    """The line reversed, with every run of Latin letters and digits in its own order."""
    turned = F.reverse(line)
    runs = F.regexp_extract_all(turned, F.lit(LATIN_RUN), F.lit(0))
    between = F.split(turned, LATIN_RUN, -1)
    return F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.reverse(F.get(runs, i)), F.lit("")))), "")


def reading_order(text: Column) -> Column:
    """text with every line in drawing order turned round; other lines and texts are unchanged."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(drawn(line), read_back(line)).otherwise(line))
    return F.when(text.rlike(LETTER), F.array_join(lines, "\n")).otherwise(text)
