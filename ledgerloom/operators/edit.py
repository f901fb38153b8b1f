"""Preview and editing of drafts: existence flags, recalculation, item edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import lookup

#: The invoice columns that an edited draft keeps.
SAVED = ("source_file", "supplier_name", "customer_name", "invoice_date", "invoice_number", "declared_total", "calc_total")


def flags(rows: DataFrame, key: str, dim: DataFrame, prefix: str) -> DataFrame:
    """rows plus {prefix}_id and {prefix}_exists; blank keys are not looked up."""
    ids = lookup(dim, key).select(F.col(key).alias("_k"), F.col("id").alias(f"{prefix}_id"))
    asked = F.nullif(F.trim(F.col(key)), F.lit(""))
    out = rows.withColumn("_asked", asked).join(ids, F.col("_asked") == F.col("_k"), "left").drop("_k", "_asked")
    return out.withColumn(f"{prefix}_exists", F.col(f"{prefix}_id").isNotNull())


def recalc(items: DataFrame) -> DataFrame:
    """doc, calc_total, total_qty after every total was set to quantity x price, over exact decimals."""
    exact = F.coalesce("qty", F.lit(0.0)).cast("decimal(18,4)") * F.coalesce("unit_price", F.lit(0.0)).cast("decimal(18,4)")
    return items.groupBy("doc").agg(F.round(F.sum(exact.cast("decimal(28,6)")), 2).cast("double").alias("calc_total"), F.sum(F.coalesce("qty", F.lit(0.0)).cast("decimal(18,4)")).cast("double").alias("total_qty"))


def line_totals(items: Column) -> Column:
    """An item array whose totals are quantity x price."""
    return F.transform(items, lambda i: i.withField("total", F.round(i["qty"] * i["unit_price"], 2)))


def add_item(items: Column) -> Column:
    """One empty item more; only for arrays of code, name, qty, unit_price, total."""
    new = F.struct(F.lit("").alias("code"), F.lit("").alias("name"), F.lit(1.0).alias("qty"), F.lit(0.0).alias("unit_price"), F.lit(0.0).alias("total"))
    return F.array_append(items, new)


def remove_item(items: Column, at: int) -> Column:
    """Without one item; the last one left can't go."""
    return F.when(F.size(items) <= 1, items).otherwise(F.filter(items, lambda _, i: i != at))


def update_item(items: Column, at: int, name: str, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == at, x.withField(name, value)).otherwise(x))


def replace_invoices(stored: DataFrame, edited: DataFrame) -> DataFrame:
    """Stored drafts with the edited runs replaced."""
    return stored.join(edited.select("run_id"), "run_id", "left_anti").unionByName(edited)
