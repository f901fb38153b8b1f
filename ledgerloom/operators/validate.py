"""Validation and repair of items and invoices, as expressions over exploded rows.

Items: doc, pos, code, name, qty, unit_price, total. Every rule of the missing-value step looks at the
values before that step, so one projection does it all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fix_code_ocr, fix_numeric_ocr, fix_text_ocr, item_code, normalize_date
from .ledger import exact_sum


@dataclass(frozen=True)
class Limits:
    """What is out of range."""

    min_name: int = 2
    max_name: int = 200
    max_qty: float = 1e5
    max_price: float = 1e7
    max_total: float = 1e8
    tolerance: float = 0.05

    def merged(self, **overrides: float) -> Limits:
        return replace(self, **overrides)


def money(c: Column, places: int) -> Column:
    return F.round(c, places)


NUMBERS = ("qty", "unit_price", "total")
#: Header fields and what stands for a missing one.
DEFAULTS = {"source_file": "unknown", "supplier_name": "", "customer_name": "", "invoice_date": None, "invoice_number": None, "declared_total": None, "calc_total": 0.0, "currency": None}


def said(*rules: tuple[Column, Column]) -> Column:
    """The texts whose conditions hold, as an array."""
    return F.filter(F.array(*(F.when(c, w) for c, w in rules)), lambda x: x.isNotNull())


def structure(headers: DataFrame) -> DataFrame:
    """headers with every field of ``DEFAULTS``; missing columns and missing values get the default."""
    out = headers
    for name, value in DEFAULTS.items():
        kind = {"declared_total": "double", "calc_total": "double"}.get(name, "string")
        if name not in headers.columns:
            out = out.withColumn(name, F.lit(value).cast(kind))
        elif value is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def repair_header(headers: DataFrame) -> DataFrame:
    """Repairs ``entity``, and ``invoice_date`` where it is text; adds header_fixes and header_warnings (arrays of text)."""
    name = F.when(F.col("entity") != "", fix_text_ocr(F.col("entity"))).otherwise(F.col("entity"))
    fixes = said((~F.col("entity").eqNullSafe(name), F.concat(F.lit("entity: "), F.col("entity"), F.lit(" -> "), name)))
    out = headers.withColumns({"header_fixes": fixes, "entity": name})
    if dict(headers.dtypes).get("invoice_date") != "string":
        return out.withColumn("header_warnings", F.array().cast("array<string>"))
    date = normalize_date(F.col("invoice_date"))
    warn = said((date.isNull() & (F.trim("invoice_date") != ""), F.concat(F.lit("date: "), F.col("invoice_date"))))
    return out.withColumns({"header_warnings": warn, "invoice_date": date})


def repair_ocr(items: DataFrame) -> DataFrame:
    """Repairs names, codes and numbers that are text; fixes (array of text) says what changed. Empty names and codes stay."""
    fix = lambda what, old, new: (~old.eqNullSafe(new), F.concat(F.lit(what + ": "), old, F.lit(" -> "), new))
    name = F.when(F.col("name") != "", fix_text_ocr(F.col("name"))).otherwise(F.col("name"))
    code = F.when(F.col("code") != "", fix_code_ocr(F.col("code"))).otherwise(F.col("code"))
    rules, changed = [fix("name", F.col("name"), name), fix("code", F.col("code"), code)], {"name": name, "code": code}
    for c in NUMBERS:
        if dict(items.dtypes)[c] == "string":
            old, new = F.col(c), F.when(F.col(c).isNotNull(), fix_numeric_ocr(F.col(c)))
            rules.append((~F.trim(old).try_cast("double").eqNullSafe(new), F.concat(F.lit(c + ": "), old, F.lit(" -> "), new.cast("string"))))
            changed[c] = new
    return items.withColumns({"fixes": said(*rules), **changed})


def missing_values(items: DataFrame) -> DataFrame:
    """Fills total, price or quantity from the other two; names what was filled in ``fixes`` (after those there are)."""
    q, p, t = (F.coalesce(c, F.lit(0.0)) for c in NUMBERS)
    ratio = F.try_divide(t, p)
    snapped = F.when(F.abs(ratio - F.round(ratio)) < 0.01, F.round(ratio)).otherwise(F.round(ratio, 4))
    alone = (q <= 0) & (p <= 0) & (t > 0)
    no_total, no_price, no_qty = (t <= 0) & (q > 0) & (p > 0), (p <= 0) & (q > 0) & (t > 0), (q <= 0) & (p > 0) & (t > 0)
    total = F.when(no_total, F.round(q * p, 2)).otherwise(t)
    price = F.when(alone, t).when(no_price, F.round(F.try_divide(t, q), 4)).otherwise(p)
    qty = F.when(no_qty, snapped).otherwise(q)
    filled = said((no_total, F.lit("filled total")), (no_price, F.lit("filled unit_price")), (no_qty, F.lit("filled qty")), (alone, F.lit("filled qty and unit_price")))
    fixes = F.concat("fixes", filled) if "fixes" in items.columns else filled
    return items.withColumns({"fixes": fixes, "qty": F.when(qty <= 0, 1.0).otherwise(qty), "unit_price": price, "total": total})


def normalize(items: DataFrame) -> DataFrame:
    """Rounds; fills name from code and code from name; drops items without a name ("0" is none)."""
    code, name = F.trim(F.coalesce("code", F.lit(""))), F.trim(F.coalesce("name", F.lit("")))
    out = items.withColumns({"qty": F.round("qty", 4), "unit_price": F.round("unit_price", 4), "total": F.round("total", 2), "name": F.when(name == "", code).otherwise(name)})
    return out.withColumn("code", F.when(code == "", item_code(F.col("name"))).otherwise(code)).where(~F.col("name").isin("", "0"))


def range_checks(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds errors and warnings (arrays of codes) to every item."""
    n = F.length("name")
    off = F.try_divide(F.abs(F.col("qty") * F.col("unit_price") - F.col("total")), F.greatest(F.abs("total"), F.lit(1e-9)))
    say = lambda *rules: F.filter(F.array(*(F.when(c, F.lit(w)) for c, w in rules)), lambda x: x.isNotNull())
    warnings = say(
        (n < limits.min_name, "name_short"), (n > limits.max_name, "name_long"), (F.col("qty") > limits.max_qty, "qty_large"), (F.col("unit_price") > limits.max_price, "price_large"),
        (F.col("total") > limits.max_total, "total_large"), ((F.col("total") > 0) & (off > limits.tolerance), "total_off"),
    )
    errors = say((F.col("qty") < 0, "qty_negative"), (F.col("unit_price") < 0, "price_negative"), (F.col("total") < 0, "total_negative"))
    return items.withColumns({"errors": errors, "warnings": warnings})


def total_check(headers: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """headers plus calc_total and total_state: ok, no_declared, calc_not_positive or differs."""
    calc = items.groupBy("doc").agg(F.round(exact_sum(F.col("total")), 2).alias("calc_total"))
    return total_state(headers.join(calc, "doc", "left"), limits)


def total_state(headers: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """headers with calc_total, which is 0 where missing, plus total_state."""
    out = headers.withColumn("calc_total", F.coalesce("calc_total", F.lit(0.0)))
    d, c = F.col("declared"), F.col("calc_total")
    off = F.try_divide(F.abs(d - c), F.greatest(F.abs(d), F.abs(c)))
    return out.withColumn("total_state", F.when(d.isNull(), "no_declared").when(c <= 0, "calc_not_positive").when(off > limits.tolerance, "differs").otherwise("ok"))


def validate(headers: DataFrame, items: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(invoices with valid, n_errors, n_warnings, n_fixes; repaired items)."""
    fixed = range_checks(normalize(missing_values(repair_ocr(items))), limits)
    # Fixes of items that are dropped afterwards count as well, so they are counted before.
    fixes = missing_values(repair_ocr(items)).groupBy("doc").agg(F.sum(F.size("fixes")).alias("f"))
    calc = F.round(exact_sum(F.col("total")), 2).alias("calc_total")
    per = fixed.groupBy("doc").agg(calc, F.sum(F.size("errors")).alias("e"), F.sum(F.size("warnings")).alias("w"))
    out = total_state(repair_header(headers).join(per, "doc", "left"), limits).join(fixes, "doc", "left")
    bad = F.col("total_state") == "calc_not_positive"
    zero = F.lit(0).cast("long")
    errors = F.coalesce("e", zero) + F.when(F.col("e").isNull(), 1).otherwise(0) + bad.cast("int")
    warnings = F.coalesce("w", zero) + F.col("total_state").isin("no_declared", "differs").cast("int") + F.size("header_warnings")
    n_fixes = F.coalesce("f", zero) + F.size("header_fixes")
    return out.withColumns({"n_errors": errors, "n_warnings": warnings, "n_fixes": n_fixes, "valid": errors == 0}).drop("e", "w", "f"), fixed


def batch_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("n_fixes") > 0).alias("fixed"))
