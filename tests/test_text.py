import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text

CASES = [
    (text.clean_string, "  a \t b\n", "a b"), (text.clean_string, None, ""), (text.clean_cell, "|---|", ""), (text.clean_item_name, "1. - Cable  x - ", "Cable x"),
    (text.clean_entity_name, "Vendor: ACME  Ltd", "ACME Ltd"), (text.slug, "Hedonic 黑 Cable", "hedonic黑cable"), (text.slug, "!!", "unknown"), (text.money, "HK$ 1,234.5", 1234.5), (text.money, "x", 0.0),
    (text.parse_number, "5000Mah", 5000.0), (text.parse_number, "1.2.3", 1.2), (text.parse_number, "", 0.0), (text.normalize_amount, "", None), (text.normalize_amount, "$1,000.505", 1000.51),
    (text.normalize_date_text, "02/10/2025", "2025-02-10"), (text.normalize_date_text, "25-12-2025", "2025-12-25"), (text.normalize_date_text, "x", None),
    (text.fix_code_ocr, "1O5", "105"), (text.fix_code_ocr, "BOSS", "8055"), (text.fix_code_ocr, "ab1", "AB1"), (text.fix_text_ocr, "1O2 Ol", "102 Ol"), (text.fix_numeric_ocr, "l2O", 120.0),
    (text.item_code, "Cable-5 m", "CABLE5M"), (text.format_bytes, None, None), (text.strip_tags, "<b>a</b><!-- x -->c", "ac"), (text.document_currency, "total HK$ 5", "HKD"), (text.document_currency, "nothing", None),
    (text.title, "x\n## Head\n", "Head"), (text.title, "- a\nfirst", "first"), (text.title, None, ""),
]


@pytest.mark.parametrize(("fn", "given", "expected"), CASES)
def test_scalar(spark, fn, given, expected):
    kind = "bigint" if fn is text.format_bytes else "string"
    assert spark.createDataFrame([(given,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"] == expected


def test_dates_roll_over(spark):
    rows = spark.createDataFrame([("2/10/2025",), ("10/25/2025",), ("2025年3月4日",), ("4 Mar 2025",), ("soon",), (None,)], "x string")
    assert [str(r[0]) for r in rows.select(text.normalize_date(F.col("x"))).collect()] == ["2025-10-02", "2027-01-10", "2025-03-04", "2025-03-04", "None", "None"]


def test_generated_code(spark):
    code = spark.createDataFrame([("Hedonic Cable 黑",)], "x string").select(text.gen_code(F.col("x"))).first()[0]
    assert code.startswith("H_C_黑_") and len(code) == len("H_C_黑_") + 6
