"""Relational counterparts of table and text operators, over exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number


def column_profile(rows: DataFrame, name: str) -> DataFrame:
    """name, kind of a text column: qty, total, name or null, from its numbers and lengths (blank cells don't count)."""
    v = F.trim(F.col(name).cast("string"))
    plain = F.regexp_replace(v, ",", "")
    is_number = plain.rlike(r"^-?\d+(\.\d+)?$")
    agg = rows.where(v != "").agg(
        (F.count_if(is_number) / F.count(F.lit(1))).alias("ratio"), F.max(F.when(is_number, plain.cast("double"))).alias("top"),
        F.coalesce(F.bool_or(is_number & plain.contains(".")), F.lit(False)).alias("decimals"), F.avg(F.length(v)).alias("chars"),
    )
    kind = F.when((F.col("ratio") > 0.8) & ~F.col("decimals") & (F.col("top") < 1000), "qty").when((F.col("ratio") > 0.8) & (F.col("decimals") | (F.col("top") > 100)), "total")
    return agg.select(F.lit(name).alias("name"), kind.when((F.col("chars") > 10) & (F.col("ratio") < 0.2), "name").alias("kind"))


def dedupe_items(items: DataFrame) -> DataFrame:
    """The first (by pos) of equal doc, lower-case name, quantity and total."""
    same = Window.partitionBy("doc", F.lower("name"), "qty", "total").orderBy("pos")
    return items.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def gap_groups(rows: DataFrame, by: str, at: str, gap: float, tie: str) -> DataFrame:
    """rows plus band: a new one starts where the step from the row before is ``gap`` or more."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new = F.when(F.abs(F.col(at) - F.lag(at).over(w)) >= gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_by(rows: DataFrame, by: str, score: str, order: str, value: str) -> DataFrame:
    """by, value, score of the best row of each group; ties to the smallest order."""
    return rows.groupBy(by).agg(F.max_by(value, F.struct(F.col(score), -F.col(order))).alias(value), F.max(score).alias(score))


def line_numbers(line: Column) -> Column:
    """The positive numbers of a line."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"([\d,]+\.?\d*)"), F.lit(1)), lambda x: number(F.regexp_replace(x, ",", ""))), lambda x: x > 0)


def line_item(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows plus qty, unit_price, total of a line that fits within 10 %, other lines are dropped."""
    n = rows.withColumn("_n", line_numbers(F.col(line)))
    a, b, c = (F.get("_n", i) for i in range(3))
    first = (a <= 100) & (b > a)
    k = F.size("_n")
    qty = F.when(k >= 3, a).when((k == 2) & first, a).when(k == 2, F.try_divide(b, a)).otherwise(F.lit(1.0))
    total = F.when(k >= 3, c).when(k == 2, b).otherwise(a)
    price = F.when(k >= 3, b).when((k == 2) & first, F.try_divide(b, a)).when(k == 2, a).otherwise(F.lit(0.0))
    out = n.withColumns({"qty": F.round(qty, 4), "unit_price": F.round(price, 4), "total": F.round(total, 2), "_fit": F.try_divide(F.abs(qty * price - total), total) < 0.1})
    return out.where("size(_n) > 0 and _fit").drop("_n", "_fit")
