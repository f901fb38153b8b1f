"""Scalar clean-up functions as Column expressions: strings, numbers, dates, codes.

All stay inside code generation: no Python runs per row. Amounts are doubles, rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that OCR takes for digits.
OCR_LETTERS, OCR_DIGITS = "OolIZSB。", "0011258."
#: Summary rows, skipped lines, table rules.
SUMMARY = r"(?iu)^(合计|total|subtotal|grand|小計|sum)$"
LINE_SKIP = r"(?iu)^(合计|total|subtotal|grand|小計|#|序号|項次)"
TABLE_SEPARATOR = r"^[\|\-\+\s]*$"
#: Currency of a document, first that matches.
DOCUMENT_CURRENCY = (
    ("CNY", "(?iuU)¥|￥|rmb|人民币|人民幣"),
    ("HKD", r"(?iuU)hk\$|hkd|港币|港幣"),
    ("USD", r"(?iuU)\$(?!hk)|usd|us\$|美元|美金"),
    ("EUR", "(?iuU)€|eur|欧元|歐元"),
    ("GBP", "(?iuU)£|gbp|英镑|英鎊"),
)
#: Currency that a value starts with.
VALUE_CURRENCY = (
    ("CNY", "(?iu)^(¥|￥|rmb|cny|人民币|人民幣)"),
    ("HKD", r"(?iu)^(hk\$|hkd|港币|港幣)"),
    ("USD", r"(?iu)^(\$|usd|us\$|美元|美金)"),
    ("EUR", "(?iu)^(€|eur|欧元|歐元)"),
    ("GBP", "(?iu)^(£|gbp|英镑|英鎊)"),
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_string(c: Column) -> Column:
    """Runs of white space become one space; trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clean_cell(c: Column) -> Column:
    """A table cell: cleaned, and empty if only rule characters are left."""
    s = clean_string(c)
    return F.when(s.rlike(TABLE_SEPARATOR), "").otherwise(s)


def clean_item_name(c: Column) -> Column:
    """Without list marks and numbers in front, and dashes behind."""
    s = F.regexp_replace(text(c), r"^[\d.)\]\-*•\s]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[\s\-*]+$", ""), r"\s+", " "))


def clean_entity_name(c: Column) -> Column:
    """Without a leading supplier word."""
    return F.regexp_replace(clean_string(c), r"(?iu)^(供[应應]商|vendor|supplier|from)[:\s]*", "")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(text(c)), r"(?U)\s+", "")
    s = F.regexp_replace(s, r"[^a-z0-9\x{4e00}-\x{9fff}]", "")
    return F.when(s.isin("", "0"), "unknown").otherwise(s)


def number(c: Column) -> Column:
    """The longest numeric prefix as a double, 0 if there is none."""
    return F.coalesce(F.regexp_extract(c, r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double"), F.lit(0.0))


def money(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text(c), r"[^\d.,\-]", ""), ",", "")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def parse_number(c: Column) -> Column:
    """The first number in a cell, without currency signs, blanks and thousands separators."""
    s = F.regexp_replace(text(c), r"[¥￥$€£\s,]", "")
    return number(F.regexp_extract(s, r"-?[\d.]+", 0))


def normalize_amount(c: Column) -> Column:
    """A rounded amount, or null: plain numbers as they are, else what digits, points and signs make."""
    s = F.regexp_replace(c, r"[^0-9.\-]", "")
    value = F.coalesce(F.trim(c).try_cast("double"), s.try_cast("double"))
    return F.when(F.trim(c) == "", None).otherwise(F.round(value, 2))


def rolled_date(y: Column, m: Column, d: Column) -> Column:
    """A date whose month and day may lie past their ends: they roll over, as in calendar arithmetic."""
    first = F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, m.cast("int") - 1), d.cast("int") - 1)


def normalize_date(c: Column) -> Column:
    """Dates of files: Y-m-d, Y/m/d, then day first with either separator; rolled over; else null."""
    s = F.trim(text(c))
    part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit("")).try_cast("int")
    ymd, dmy, cjk = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", r"^(\d{4})年(\d{1,2})月(\d{1,2})日$"
    named = F.coalesce(*(F.try_to_date(s, f) for f in ("d MMM yyyy", "MMM d, yyyy", "d-MMM-yy", "yyyyMMdd")))
    return F.coalesce(
        rolled_date(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
        rolled_date(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
        rolled_date(part(cjk, 1), part(cjk, 2), part(cjk, 3)),
        F.when(s.rlike(r"^(\d{1,2} [A-Za-z]{3} \d{4}|[A-Za-z]{3} \d{1,2}, \d{4}|\d{1,2}-[A-Za-z]{3}-\d{2}|\d{8})$"), named),
    )


def normalize_date_text(c: Column) -> Column:
    """Dates in running text, as yyyy-mm-dd text: month first unless the first part is over 12; not checked."""
    s = F.regexp_replace(text(c), "/", "-")
    p = r"^(\d+)-(\d+)-(\d+)$"
    a, b, d = (F.regexp_extract(s, p, i) for i in (1, 2, 3))
    pad = lambda x, n: F.lpad(x.try_cast("int").cast("string"), n, "0")
    iso = F.concat_ws("-", pad(a, 4), pad(b, 2), pad(d, 2))
    day_first = a.try_cast("int") > 12
    other = F.concat_ws("-", pad(d, 4), F.when(day_first, pad(b, 2)).otherwise(pad(a, 2)), F.when(day_first, pad(a, 2)).otherwise(pad(b, 2)))
    return F.when(F.length(a) == 4, iso).when(F.length(d) == 4, other)


def fix_text_ocr(c: Column) -> Column:
    """O and l between digits are 0 and 1."""
    s = F.regexp_replace(clean_string(c), r"(?<=\d)O(?=\d)", "0")
    return F.regexp_replace(s, r"(?<=\d)l(?=\d)", "1")


def fix_code_ocr(c: Column) -> Column:
    """A code made only of digits and letters that look like digits becomes digits."""
    s = F.upper(F.trim(text(c)))
    return F.when(s.rlike("^[0-9OIlZSB]+$"), F.translate(s, "OIZSB", "01258")).otherwise(s)


def fix_numeric_ocr(c: Column) -> Column:
    s = F.trim(text(c))
    fixed = F.translate(F.regexp_replace(s, r"[，,\s]", ""), OCR_LETTERS, OCR_DIGITS)
    return F.coalesce(s.try_cast("double"), number(F.regexp_extract(fixed, r"-?[\d.]+", 0)))


def item_code(c: Column) -> Column:
    """The first ten letters and digits, upper-cased; ITEM and four digits of a hash if there are none."""
    s = F.upper(F.substring(F.regexp_replace(text(c), r"[^\p{L}\p{N}]", ""), 1, 10))
    spare = F.concat(F.lit("ITEM"), (F.pmod(F.conv(F.substring(F.md5(text(c).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(9000)) + 1000).cast("string"))
    return F.when(s == "", spare).otherwise(s)


def gen_code(c: Column) -> Column:
    """A product code of a name: other characters than A-Z, 0-9 and CJK become _, cut at 24 bytes, and six hash digits."""
    s = F.upper(F.regexp_replace(c, r"[^A-Z0-9\x{4e00}-\x{9fff}]+", "_"))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(s.cast("binary"), 1, 24).cast("string")), "�", "")
    return F.concat(cut, F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 6))


def reference_no(prefix: str, date: Column, *key: Column) -> Column:
    """prefix-yyyymmdd-hhmmss with a time of day from 9 to 17 that the key fixes."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))
    part = lambda at, n: F.pmod(F.conv(F.substring(digest, at, 6), 16, 10).cast("long"), F.lit(n))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.lit(prefix + "-"), F.date_format(date, "yyyyMMdd"), F.lit("-"), two(part(1, 9) + 9), two(part(7, 60)), two(part(13, 60)))


def fallback_email(name: Column) -> Column:
    return F.concat(F.lit("unknown+"), slug(name), F.lit("@example.com"))


def format_bytes(c: Column) -> Column:
    one = lambda x: F.regexp_replace(F.round(x, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(one(c / 1024), F.lit(" KB"))).otherwise(F.concat(one(c / 1048576), F.lit(" MB")))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")


def first_match(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def document_currency(c: Column) -> Column:
    return first_match(text(c), DOCUMENT_CURRENCY)


def value_currency(c: Column) -> Column:
    """struct<currency, amount> of one value."""
    s = F.trim(text(c))
    return F.struct(first_match(s, VALUE_CURRENCY).alias("currency"), F.regexp_extract(F.regexp_replace(s, ",", ""), r"\d+(?:\.\d+)?", 0).try_cast("double").alias("amount"))


def title(c: Column) -> Column:
    """The first heading of level 1 or 2, else the first line that starts no list, table or heading."""
    head = F.regexp_extract(text(c), r"(?dm)^#{1,2}\s+(.+)$", 1)
    line = F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[#\-*|]"))
    return F.when(head != "", F.trim(head)).otherwise(F.coalesce(F.get(line, 0), F.lit("")))


def cell(row: Column, i: Column) -> Column:
    return F.trim(F.coalesce(F.get(row, i), F.lit("")))


def keyword_hits(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur, in either case."""
    low = F.lower(text(c))
    out = F.lit(0)
    for w in words:
        out = out + F.when(low.contains(w), 1).otherwise(0)
    return out


def unwrap_json(c: Column) -> Column:
    """The page object as JSON text: the object under result, else the one under data, else the whole."""
    held = [F.get_json_object(c, f"$.{k}") for k in ("result", "data")]
    return F.coalesce(*(F.when(h.startswith("{"), h) for h in held), c)


def summary_row(code: Column, name: Column) -> Column:
    return code.rlike(SUMMARY) | name.rlike(SUMMARY)
