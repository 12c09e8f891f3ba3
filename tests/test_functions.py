"""Scalar functions against golden values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casegraph.functions import arabic, dates, ids, jsonx, money, text


def one(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


AMOUNTS = {
    "1,000,000": "1000000", "300,000": "300000", "12,450.00 SAR": "12450.00", "1.234,56": "1234.56", "(500.00)": "-500.00", "١٢٬٤٥٠٫٠٠": "12450.00",
    "1 000 000": "1000000", "SAR 540,000": "540000", "1.000": None, "about a million": None, "12-5": "125", "2024-01-15": "20240115", "SAR (500)": "500",
    "500-": "-500", "1234,567": "1234567", "12,50": "12.50", "1.000.000": "1000000", "12 34": None, "n/a": None, "": None, "1,2,3": None, "1,23.4": None, "7": "7",
}


def test_parse_amount(spark):
    assert one(spark, money.parse_amount, [*AMOUNTS, None]) == [None if v is None else Decimal(v).quantize(Decimal("1.000000")) for v in AMOUNTS.values()] + [None]


def test_older_amount_rules(spark):
    assert one(spark, money.amount_for_matching, ["1,234.56", "1.234,56", "(500.00)", "12,450.00 SAR", "١٢٬٤٥٠٫٠٠", "n/a", "12,450"]) == [
        None if v is None else Decimal(v).quantize(Decimal("1.000000")) for v in ("1234.56", "1234.56", "-500", "12450", "12450", None, "12.45")
    ]
    assert one(spark, money.normalise_amount, ["12,450", "1.000", "abc", "4,092.44", "", None, "1-2"]) == ["12.45", "1.00", "—", "4,092.44", "—", "—", "1-2"]


def test_currencies(spark):
    assert one(spark, money.currency, ["riyal", "Qatari riyal", "US$ 5", "€", "AED", "", None, "5 SR"]) == ["SAR", "QATARI RIYAL", "USD", "EUR", "AED", None, None, "SAR"]
    assert one(spark, lambda x: money.loose_currency(x, F.lit("paid in dollars")), ["AED", "", "$"]) == ["AED", "USD", "USD"]
    assert one(spark, lambda x: money.direction(F.lit(""), x), ["POS purchase", "refund", "walk"]) == ["debit", "credit", "unclear"]


def test_dates(spark):
    cases = {"2024/3/5": "2024-03-05", "05-03-2024": "2024-03-05", "26 MAY 23": "2023-05-26", "45/01/07": "1445-01-07 (AH)", "26-05-23": "1426-05-23 (AH)", "1445/01/07": "1445-01-07 (AH)", "15 مارس 2024": "15 مارس 20", "": "—"}
    assert one(spark, dates.normalise_date, list(cases)) == list(cases.values())
    assert one(spark, dates.date_for_matching, ["25/03/2024", "03/25/2024", "03/04/2024", "03/04/24", None]) == ["2024-03-25", "2024-03-25", None, None, None]
    keys = one(spark, dates.date_key, ["2024-05-01", "1/2/2024", "١٤٤٥/٠١/٠٧", "in 2023", "", "soon"])
    assert [(k.undated, k.iso) for k in keys] == [(0, "2024-05-01"), (0, "2024-02-01"), (0, "1445-01-07"), (0, "2023-99-99"), (1, "9999-99-99"), (1, "9999-99-99")]
    assert [str(t) for t in one(spark, dates.parse_timestamp, ["2024-01-02T03:04:05+03:00", "2024-01-02 03:04:05", "no"])] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "None"]


def test_text(spark):
    assert one(spark, text.normalise, ["The Bank froze the account.", "the bank FROZE the account", "أُجْرِيَ التحويل", "اجري التحويل", None]) == ["the bank froze the account"] * 2 + ["اجري التحويل"] * 2 + [""]
    assert one(spark, text.snake, ["Third Installment", " - ", "قسط", None]) == ["third_installment", None, None, None]
    assert one(spark, lambda x: text.truncate(x, 4), ["abcd", "abc de", None]) == ["abcd", "abc…", None]
    assert one(spark, lambda x: text.truncate(x, 4, inside=True), ["abcde"]) == ["abc…"]
    assert one(spark, lambda x: text.ordered_distinct(F.split(x, ",")), ["b,A,a,,B,c"]) == [["b", "A", "c"]]
    assert one(spark, lambda x: text.longest_first(F.split(x, " ")), ["aa bbb ccc d"]) == ["bbb"]
    assert one(spark, lambda x: text.jaccard(F.split(x, " "), F.array(F.lit("a"), F.lit("b"))), ["a c"]) == [pytest.approx(1 / 3)]
    long = "x" * 400 + "needle" + "y" * 400
    assert one(spark, lambda x: text.excerpt(x, [F.lit("no"), F.lit("Needle")]), [long, "short"]) == ["…" + "x" * 260 + "needle" + "y" * 260 + "…", "short"]
    assert one(spark, lambda x: text.contains_any(F.lit("Bank"), [x]), ["THE BANK", "x", None]) == [True, False, False]


def test_ids_and_json(spark):
    assert one(spark, lambda x: ids.stable_id("FACT", x, F.lit("1_F1")), ["P1"])[0].startswith("FACT_") and len(one(spark, lambda x: ids.stable_id("FACT", x), ["P1"])[0]) == 25
    assert one(spark, lambda x: ids.signature("party", x), ["A  b"]) == one(spark, lambda x: ids.signature("party", x), [" a B "])
    assert one(spark, ids.short_reference, ["case-2024/abc12"]) == ["CASE-4ABC12"]
    assert one(spark, jsonx.text_list, ['["a","b"]', "plain", "", None, "[1"]) == [["a", "b"], [], [], [], []]
    assert one(spark, lambda x: jsonx.text_list(x, keep_plain=True), ["plain", ""]) == [["plain"], []]
    assert one(spark, jsonx.object_text, ['<think>no {}</think>\n```json\n{"a": 1}\n```', 'so {"a": {"b": 2}} it is', "none"]) == ['{"a": 1}', '{"a": {"b": 2}}', None]
    assert one(spark, jsonx.bounded_score, ["120", "-3", "55.9", "x", "NaN"]) == [100, 0, 55, None, None]
    assert one(spark, lambda x: jsonx.confidence_bucket(x, F.lit(False), F.lit(None).cast("boolean")), ["0.9", "0.5", "0.1", "x"]) == ["high", "review", "low", "unverified"]


VISUAL = "Pay) /6.00 لىأ قيبطت( عملا طاقم ربع عفد ىدم ةقاطب يسيئرلا يدوعسلا كنبلا / TEA TIME RESTAURANT \\Apple / 611**# مقرلا - Pay App /SA /POS#63122666 /SNB"


def test_reading_order(spark):
    fixed = one(spark, arabic.reading_order, [VISUAL])[0]
    assert "البنك السعودي الرئيسي بطاقة مدى دفع عبر" in fixed and "TEA TIME RESTAURANT" in fixed and "Pay App /SA /POS#63122666 /SNB" in fixed
    assert "(تطبيق" in fixed and fixed.endswith("Pay)") and "611**#" in fixed
    same = [fixed, "رسوم - تفاصيل الرسوم: ضريبة القيمة المضافة", "تحويل 12,450.00 ريال", "TEA TIME RESTAURANT", "البنك السعودي الرئيسي بطاقة مدى", None]
    assert one(spark, arabic.reading_order, same) == same
    assert one(spark, arabic.reading_order, ["ةفاضملا ةميقلا ةبيرض :موسرلا ليصافت - موسر", "12,450.00 لاير ليوحت", "abc\nموسر"]) == ["رسوم - تفاصيل الرسوم: ضريبة القيمة المضافة", "تحويل ريال 12,450.00", "abc\nرسوم"]


def test_clean_as_by_patterns(spark):
    said = ["a", " a ", "a \u0085", "a  ", "\u0085", " \u0085 ", "a b\n", "\x0b\fN/A\r\n", "null", "a\nb", "", " ", None, "US$", "nan "]
    df = spark.createDataFrame([(s,) for s in said], "x string")
    slow = F.trim(F.regexp_replace("x", r"^\s+|\s+$", ""))
    want = F.when(~F.lower(slow).isin(text.NULL_TOKENS), slow)
    assert df.where(~text.clean(F.col("x")).eqNullSafe(want)).count() == 0
    assert one(spark, text.snake, ["Payment", "None", "NaN", "a b", "Payment\n", "--"]) == ["payment", None, None, "a_b", "payment", None]
