"""Loading invoices into the ledger: tolerance status, get-or-create dimensions, fact rows, reports.

Inputs are two frames. Headers: doc (unique), source_file, entity, invoice_date, declared. Items: doc,
pos, code, name, qty, unit_price, total. Everything is joins and grouped aggregates over them; new keys and
headers are numbered by ranges of their order, a window for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import fallback_email, gen_code, reference_no

TOLERANCE_ABS, TOLERANCE_REL = 0.05, 0.02
OK, NO_ITEMS, MISMATCH = "ok", "NO_ITEMS_FOUND", "TOTAL_MISMATCH"


def exact_sum(c: Column) -> Column:
    """A sum of doubles that doesn't depend on order: over six decimals, of values up to 1e22."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def plain_number(c: Column) -> Column:
    """A double as text without a needless fraction."""
    return F.regexp_replace(c.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")


def import_status(headers: DataFrame, items: DataFrame) -> DataFrame:
    """headers plus n_items, calc_total, total_qty, status, reason.

    Missing totals count as 0 in the sum and missing quantities as 1. No items come first; then
    declared totals that are off by more than both tolerances.
    """
    per = items.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_items"), F.round(exact_sum(F.coalesce("total", F.lit(0.0))), 2).alias("calc_total"), exact_sum(F.coalesce("qty", F.lit(1.0))).alias("total_qty")
    )
    out = headers.join(per, "doc", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    diff = F.abs(F.col("declared") - F.col("calc_total"))
    rel = F.when(F.col("declared") == 0, diff).otherwise(F.try_divide(diff, F.abs("declared")))
    off = F.col("declared").isNotNull() & (diff > TOLERANCE_ABS) & (rel > TOLERANCE_REL)
    status = F.when(F.col("n_items") == 0, NO_ITEMS).when(off, MISMATCH).otherwise(OK)
    out = out.withColumn("status", status)
    why = F.concat(F.lit("TOTAL_MISMATCH declared="), plain_number(F.col("declared")), F.lit(" calc="), plain_number(F.col("calc_total")))
    return out.withColumn("reason", F.when(F.col("status") == MISMATCH, why).when(F.col("status") == NO_ITEMS, NO_ITEMS))


def default_names(headers: DataFrame, kind: str) -> DataFrame:
    return headers.withColumn("entity", F.coalesce(F.nullif(F.trim("entity"), F.lit("")), F.lit(f"UNKNOWN_{kind.upper()}")))


def default_items(items: DataFrame) -> DataFrame:
    """Missing codes come from the name, missing names from the code; a missing total is qty x price before qty is mended."""
    name = F.trim(F.coalesce("name", F.lit("")))
    code = F.trim(F.coalesce("code", F.lit("")))
    out = items.withColumn("code", F.when(code == "", gen_code(F.when(name == "", "ITEM").otherwise(name))).otherwise(code))
    out = out.withColumn("name", F.when(name == "", F.col("code")).otherwise(name))
    out = out.withColumn("qty", F.coalesce("qty", F.lit(1.0))).withColumn("unit_price", F.coalesce("unit_price", F.lit(0.0)))
    out = out.withColumn("total", F.coalesce("total", F.col("qty") * F.col("unit_price")))
    return out.withColumn("qty", F.when(F.col("qty") <= 0, 1.0).otherwise(F.col("qty")))


#: Ranges that rows are numbered by.
RANGES = 64


def numbered(rows: DataFrame, order: list[str], top: DataFrame) -> DataFrame:
    """rows plus ``id``, counted up from the one value of ``top`` in the given order.

    Where the first column of the order is a number, rows fall into ranges of it (their bounds are approximate
    percentiles, any bounds give the same ids) that are numbered apart and put one after another.
    """
    kind = rows.schema[order[0]].dataType
    bounds = rows.agg(F.percentile_approx(order[0], [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] if isinstance(kind, NumericType) else None
    low = F.array(*map(F.lit, sorted(set(bounds or ())))) if bounds else F.array().cast("array<int>")
    out = rows.withColumn("_range", F.size(F.filter(low, lambda b: b <= F.col(order[0]))) if bounds else F.lit(0))
    sizes = out.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    out = out.join(F.broadcast(starts), "_range").join(F.broadcast(top.toDF("_top")))  # RANGES rows, and one
    return out.withColumn("id", F.col("_top") + F.col("_start") + F.col("_r")).drop("_range", "_r", "_start", "_top")


def get_or_create(wanted: DataFrame, dim: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows new to a dimension, with ids after its largest, in the order they first come.

    ``wanted`` may repeat keys: the first by ``order`` gives the attributes. Only new, distinct keys are numbered.
    """
    fresh = wanted.join(dim.select(F.col(key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return numbered(first, order, dim.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")))


def lookup(dim: DataFrame, key: str) -> DataFrame:
    """One id per key: the smallest."""
    return dim.groupBy(key).agg(F.min("id").alias("id"))


def resolve(rows: DataFrame, key: str, dim: DataFrame, created: DataFrame, id_name: str) -> DataFrame:
    """rows plus the id of their key, known or created."""
    every = lookup(dim.select(key, "id").unionByName(created.select(key, "id")), key)
    return rows.join(every.withColumnRenamed("id", id_name), key, "left")


def purchase_headers(ok: DataFrame, now: Column, with_id: bool = False) -> DataFrame:
    """The 23 purchase columns of accepted headers that carry supplier_id, and on demand their header_id as id."""
    grand = F.coalesce("declared", "calc_total")
    zero = F.lit(0.0)
    stamp = F.to_timestamp(F.concat_ws(" ", F.date_format("invoice_date", "yyyy-MM-dd"), F.date_format(now, "HH:mm:ss")))
    columns = {
        "reference_no": reference_no("pr", F.col("invoice_date"), F.col("source_file")), "user_id": F.lit(1), "warehouse_id": F.lit(2), "supplier_id": F.col("supplier_id"),
        "currency_id": F.lit(1), "exchange_rate": F.lit(1), "item": F.col("n_items"), "total_qty": F.col("total_qty"), "total_discount": zero, "total_tax": zero, "total_cost": grand,
        "order_tax_rate": zero, "order_tax": zero, "order_discount": zero, "shipping_cost": zero, "grand_total": grand, "paid_amount": grand, "status": F.lit(1),
        "payment_status": F.lit("due"), "document": F.col("source_file"), "note": F.lit(None).cast("string"), "created_at": stamp, "updated_at": stamp,
    }
    return ok.select(*([F.col("header_id").alias("id")] if with_id else []), *(c.alias(n) for n, c in columns.items()))


def sale_headers(ok: DataFrame, now: Column, with_id: bool = False) -> DataFrame:
    """The 32 sale columns of accepted headers that carry customer_id, and on demand their header_id as id."""
    grand = F.coalesce("declared", "calc_total")
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    stamp = F.to_timestamp(F.concat_ws(" ", F.date_format("invoice_date", "yyyy-MM-dd"), F.date_format(now, "HH:mm:ss")))
    columns = {
        "reference_no": reference_no("sr", F.col("invoice_date"), F.col("source_file")), "user_id": F.lit(1), "cash_register_id": none, "table_id": none, "queue": none,
        "customer_id": F.col("customer_id"), "warehouse_id": F.lit(2), "biller_id": F.lit(1), "item": F.col("n_items"), "total_qty": F.col("total_qty"), "total_discount": zero,
        "total_tax": zero, "total_price": grand, "grand_total": grand, "currency_id": F.lit(1), "exchange_rate": F.lit(1), "order_tax_rate": zero, "order_tax": zero,
        "order_discount_type": F.lit("Flat"), "order_discount_value": zero, "order_discount": zero, "coupon_id": none, "coupon_discount": none, "shipping_cost": zero,
        "sale_status": F.lit(1), "payment_status": F.lit(4), "document": F.col("source_file"), "paid_amount": grand, "sale_note": none, "staff_note": none, "created_at": stamp, "updated_at": stamp,
    }
    return ok.select(*([F.col("header_id").alias("id")] if with_id else []), *(c.alias(n) for n, c in columns.items()))


def lines(items: DataFrame, kind: str) -> DataFrame:
    """Fact lines (16 for purchases, 17 for sales) of items that carry parent_id, product_id and invoice_date."""
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    stamp = F.to_timestamp(F.concat(F.date_format("invoice_date", "yyyy-MM-dd"), F.lit(" 12:00:00")))
    columns = {f"{kind}_id": F.col("parent_id"), "product_id": F.col("product_id"), "product_batch_id": none, "variant_id": none, "imei_number": none, "qty": F.col("qty")}
    if kind == "purchase":
        columns |= {"recieved": F.col("qty"), "return_qty": zero, "purchase_unit_id": F.lit(1), "net_unit_cost": F.col("unit_price")}
    else:
        columns |= {"return_qty": zero, "sale_unit_id": F.lit(1), "net_unit_price": F.col("unit_price")}
    columns |= {"discount": zero, "tax_rate": zero, "tax": zero, "total": F.col("total"), "created_at": stamp, "updated_at": stamp}
    if kind == "sale":
        columns |= {"is_delivered": none, "is_packing": none}
    return items.select(*(c.alias(n) for n, c in columns.items()))


def new_entities(created: DataFrame, kind: str, now: Column) -> DataFrame:
    """Supplier or customer rows (with id) of created names."""
    name = F.col("entity")
    columns = {"id": F.col("id")} | ({"customer_group_id": F.lit(1), "user_id": F.lit(None).cast("long")} if kind == "customer" else {})
    columns |= {
        "name": name, "company_name": name, "email": fallback_email(name), "phone_number": F.lit("0000000000"), "address": F.lit("-"), "city": F.lit("-"), "state": F.lit(None).cast("string"),
        "postal_code": F.lit(None).cast("string"), "country": F.lit("Hong Kong"), "is_active": F.lit(1), "created_at": now, "updated_at": now,
    }
    return created.select(*(c.alias(n) for n, c in columns.items()))


def new_products(created: DataFrame, kind: str, now: Column) -> DataFrame:
    """Product rows (with id) of created codes: cost = price on purchases, 70 % of it on sales."""
    price = F.col("unit_price")
    cost = price if kind == "purchase" else F.round(price.cast("decimal(18,4)") * F.lit("0.7").cast("decimal(2,1)"), 2).cast("double")
    columns = {
        "id": F.col("id"), "name": F.col("name"), "code": F.col("code"), "type": F.lit("standard"), "barcode_symbology": F.lit("C128"), "brand_id": F.lit(None).cast("long"), "category_id": F.lit(1),
        "unit_id": F.lit(1), "purchase_unit_id": F.lit(1), "sale_unit_id": F.lit(1), "cost": cost, "price": price, "is_active": F.lit(1), "created_at": now, "updated_at": now,
    }
    return created.select(*(c.alias(n) for n, c in columns.items()))


def manifest(ok: DataFrame, prefix: str, entity_id: str) -> DataFrame:
    """One row of text per accepted header."""
    grand = F.coalesce("declared", "calc_total")
    return ok.select("source_file", reference_no(prefix, F.col("invoice_date"), F.col("source_file")).alias("reference_no"), F.col("entity").alias("entity_name"), F.col(entity_id).cast("string").alias("entity_id"), F.col("n_items").cast("string").alias("items"), plain_number(grand).alias("grand_total"), F.date_format("invoice_date", "yyyy-MM-dd").alias("date"))


def failed(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") != OK).select("source_file", F.col("entity").alias("name"), F.col("declared").alias("declared_total"), "reason")


def summary(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("status") == OK).alias("success"), F.count_if(F.col("status") != OK).alias("failed"))


def import_batch(headers: DataFrame, items: DataFrame, entities: DataFrame, products: DataFrame, kind: str, now: Column, last_id: int = 0) -> dict[str, DataFrame]:
    """All frames that one batch adds: entities, products, headers, lines, manifest, failed, summary.

    entities (id, entity) and products (id, code) are what the ledger knows; last_id is its last header's.
    Headers are numbered after it by doc, and lines name the id of theirs. Nothing is written here: ``write_batch`` or
    ``append_batch`` do that.
    """
    who, fact, prefix = ("supplier", "purchase", "pr") if kind == "purchase" else ("customer", "sale", "sr")
    status = import_status(default_names(headers, who), items)
    ok = status.where(F.col("status") == OK)
    ok = numbered(ok, ["doc"], headers.sparkSession.range(1).select(F.lit(last_id).cast("long"))).withColumnRenamed("id", "header_id")
    goods = default_items(items.join(ok.select("doc", "invoice_date", "source_file", "header_id"), "doc"))
    made = get_or_create(ok.select("entity", "doc"), entities, "entity", ["doc"])
    ok = resolve(ok, "entity", entities, made, f"{who}_id")
    made_goods = get_or_create(goods.select("code", "name", "unit_price", "doc", "pos"), products, "code", ["doc", "pos", "code", "name", "unit_price"])  # no ties, so that every reading numbers alike
    goods = resolve(goods, "code", products, made_goods, "product_id").withColumn("parent_id", F.col("header_id"))
    build = purchase_headers if kind == "purchase" else sale_headers
    heads = build(ok, now, with_id=True)
    return {
        "entities": new_entities(made, who, now), "products": new_products(made_goods, kind, now), "headers": heads, "lines": lines(goods, fact),
        "manifest": manifest(ok, prefix, f"{who}_id"), "failed": failed(status), "summary": summary(status),
    }


def write_batch(batch: dict[str, DataFrame], folder: str) -> None:
    """Writes a batch's frames below ``folder``: tables as Parquet, manifest and failed rows as CSV with a head.

    A marker is written last, so a batch without one is not whole; writing again replaces it.
    """
    spark = batch["headers"].sparkSession
    for name, frame in batch.items():
        if name in ("manifest", "failed"):
            frame.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/_whole")


def append_batch(batch: dict[str, DataFrame], url: str, kind: str, properties: dict[str, str] | None = None) -> None:
    """Appends a batch to the ledger's tables over JDBC, dimensions first."""
    who, fact = ("suppliers", "purchase") if kind == "purchase" else ("customers", "sale")
    names = {"entities": who, "products": "products", "headers": f"{fact}s", "lines": f"product_{fact}s"}
    for frame, name in names.items():
        batch[frame].write.jdbc(url, name, mode="append", properties=properties or {})
