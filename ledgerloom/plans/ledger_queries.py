"""Registered queries of the ledger operators on the driver's tables, each with its oracle.

Orders stand for invoices, line items for invoice items, customers and suppliers for entities, parts
for products. Extraction queries render documents from those rows and read them back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, text
from ..operators import edit, extract, ledger, registry, tables, validate
from ..sources import files
from .catalog import register

NOW = "2026-01-15 10:20:30"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def headers(s: SparkSession, sf: str) -> DataFrame:
    o = t(s, sf, "orders").join(t(s, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("source_file"), F.col("c_name").alias("entity"), F.to_date("o_orderdate").alias("invoice_date"), F.col("o_totalprice").alias("declared"))


def items(s: SparkSession, sf: str) -> DataFrame:
    price = F.try_divide("l_extendedprice", "l_quantity")
    return t(s, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("code"), F.col("l_quantity").alias("qty"), price.alias("unit_price"), F.col("l_extendedprice").alias("total"))


STATUS_SQL = """
h AS (SELECT o_orderkey AS doc, 'order-' || o_orderkey AS source_file, c_name AS entity, CAST(o_orderdate AS DATE) AS invoice_date, o_totalprice AS declared
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
per AS (SELECT l_orderkey AS doc, count(*) AS n_items, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS calc_total, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS total_qty FROM lineitem GROUP BY 1),
st AS (SELECT h.*, coalesce(n_items, 0) AS n_items, calc_total, total_qty, CASE WHEN n_items IS NULL THEN 'NO_ITEMS_FOUND'
       WHEN abs(declared - calc_total) > 0.05 AND (CASE WHEN declared = 0 THEN abs(declared - calc_total) ELSE abs(declared - calc_total) / abs(declared) END) > 0.02 THEN 'TOTAL_MISMATCH' ELSE 'ok' END AS status
       FROM h LEFT JOIN per USING (doc))
"""
PLAIN = "regexp_replace(CAST(CAST({0} AS DECIMAL(20,4)) AS VARCHAR), '\\.?0+$', '')"


def ref_sql(prefix: str, date: str, key: str) -> str:
    part = lambda at, n: f"(('0x' || substr(md5({key}), {at}, 6))::BIGINT % {n})"
    return f"'{prefix}-' || strftime({date}, '%Y%m%d') || '-' || lpad(CAST({part(1, 9)} + 9 AS VARCHAR), 2, '0') || lpad(CAST({part(7, 60)} AS VARCHAR), 2, '0') || lpad(CAST({part(13, 60)} AS VARCHAR), 2, '0')"


@register("import_status", f"WITH {STATUS_SQL} SELECT doc, n_items, calc_total, status FROM st")
def import_status(s, sf):
    return ledger.import_status(headers(s, sf), items(s, sf)).select("doc", "n_items", "calc_total", "status")


@register("import_summary", f"WITH {STATUS_SQL} SELECT count(*) FILTER (status = 'ok') AS success, count(*) FILTER (status <> 'ok') AS failed FROM st")
def import_summary(s, sf):
    return ledger.summary(ledger.import_status(headers(s, sf), items(s, sf)))


@register("failed_rows", f"""WITH {STATUS_SQL} SELECT source_file, entity AS name, declared AS declared_total,
 CASE status WHEN 'TOTAL_MISMATCH' THEN 'TOTAL_MISMATCH declared=' || {PLAIN.format('declared')} || ' calc=' || {PLAIN.format('calc_total')} ELSE status END AS reason FROM st WHERE status <> 'ok'""")
def failed_rows(s, sf):
    return ledger.failed(ledger.import_status(headers(s, sf), items(s, sf)))


def accepted(s, sf, id_name):
    ok = ledger.import_status(headers(s, sf), items(s, sf)).where("status = 'ok'")
    known = t(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("entity"))
    return ledger.resolve(ok, "entity", known, known.limit(0), id_name)


OK_SQL = f"WITH {STATUS_SQL}, ids AS (SELECT c_name AS entity, min(c_custkey) AS eid FROM customer GROUP BY 1), ok AS (SELECT * FROM st LEFT JOIN ids USING (entity) WHERE status = 'ok')"
STAMP = "CAST(strftime(invoice_date, '%Y-%m-%d') || ' 10:20:30' AS TIMESTAMP)"


@register("manifest_rows", f"""{OK_SQL} SELECT source_file, {ref_sql('pr', 'invoice_date', 'source_file')} AS reference_no, entity AS entity_name, CAST(eid AS VARCHAR) AS entity_id,
 CAST(n_items AS VARCHAR) AS items, {PLAIN.format('declared')} AS grand_total, strftime(invoice_date, '%Y-%m-%d') AS date FROM ok""")
def manifest_rows(s, sf):
    return ledger.manifest(accepted(s, sf, "supplier_id"), "pr", "supplier_id")


@register("purchase_headers", f"""{OK_SQL} SELECT {ref_sql('pr', 'invoice_date', 'source_file')} AS reference_no, 1 AS user_id, 2 AS warehouse_id, eid AS supplier_id, 1 AS currency_id, 1 AS exchange_rate,
 n_items AS item, total_qty, 0.0::DOUBLE AS total_discount, 0.0::DOUBLE AS total_tax, declared AS total_cost, 0.0::DOUBLE AS order_tax_rate, 0.0::DOUBLE AS order_tax, 0.0::DOUBLE AS order_discount,
 0.0::DOUBLE AS shipping_cost, declared AS grand_total, declared AS paid_amount, 1 AS status, 'due' AS payment_status, source_file AS document, NULL::VARCHAR AS note, {STAMP} AS created_at, {STAMP} AS updated_at FROM ok""")
def purchase_headers(s, sf):
    return ledger.purchase_headers(accepted(s, sf, "supplier_id"), now())


@register("sale_headers", f"""{OK_SQL} SELECT {ref_sql('sr', 'invoice_date', 'source_file')} AS reference_no, 1 AS user_id, NULL::VARCHAR AS cash_register_id, NULL::VARCHAR AS table_id, NULL::VARCHAR AS queue,
 eid AS customer_id, 2 AS warehouse_id, 1 AS biller_id, n_items AS item, total_qty, 0.0::DOUBLE AS total_discount, 0.0::DOUBLE AS total_tax, declared AS total_price, declared AS grand_total, 1 AS currency_id, 1 AS exchange_rate,
 0.0::DOUBLE AS order_tax_rate, 0.0::DOUBLE AS order_tax, 'Flat' AS order_discount_type, 0.0::DOUBLE AS order_discount_value, 0.0::DOUBLE AS order_discount, NULL::VARCHAR AS coupon_id, NULL::VARCHAR AS coupon_discount,
 0.0::DOUBLE AS shipping_cost, 1 AS sale_status, 4 AS payment_status, source_file AS document, declared AS paid_amount, NULL::VARCHAR AS sale_note, NULL::VARCHAR AS staff_note, {STAMP} AS created_at, {STAMP} AS updated_at FROM ok""")
def sale_headers(s, sf):
    return ledger.sale_headers(accepted(s, sf, "customer_id"), now())


def fact_lines(s, sf, kind):
    ok = accepted(s, sf, "eid").select("doc", "invoice_date")
    goods = items(s, sf).join(ok, "doc").withColumn("product_id", F.col("code").cast("long")).withColumn("parent_id", F.col("doc"))
    return ledger.lines(goods, kind)


NOON = "CAST(strftime(invoice_date, '%Y-%m-%d') || ' 12:00:00' AS TIMESTAMP)"
_LINE = "l_partkey AS product_id, NULL::VARCHAR AS product_batch_id, NULL::VARCHAR AS variant_id, NULL::VARCHAR AS imei_number, l_quantity AS qty"
_REST = f"0.0::DOUBLE AS discount, 0.0::DOUBLE AS tax_rate, 0.0::DOUBLE AS tax, l_extendedprice AS total, {NOON} AS created_at, {NOON} AS updated_at"


@register("purchase_lines", f"{OK_SQL} SELECT doc AS purchase_id, {_LINE}, l_quantity AS recieved, 0.0::DOUBLE AS return_qty, 1 AS purchase_unit_id, l_extendedprice / l_quantity AS net_unit_cost, {_REST} FROM lineitem JOIN ok ON doc = l_orderkey")
def purchase_lines(s, sf):
    return fact_lines(s, sf, "purchase")


@register("sale_lines", f"{OK_SQL} SELECT doc AS sale_id, {_LINE}, 0.0::DOUBLE AS return_qty, 1 AS sale_unit_id, l_extendedprice / l_quantity AS net_unit_price, {_REST}, NULL::VARCHAR AS is_delivered, NULL::VARCHAR AS is_packing FROM lineitem JOIN ok ON doc = l_orderkey")
def sale_lines(s, sf):
    return fact_lines(s, sf, "sale")


def created(s, sf, table, key, name):
    rows = t(s, sf, table)
    dim = rows.where(F.col(key) % 2 == 0).select(F.col(key).alias("id"), F.col(name).alias("entity"))
    return ledger.get_or_create(rows.select(F.col(name).alias("entity"), F.col(key).alias("doc")), dim, "entity", ["doc"])


CREATE_SQL = """WITH dim AS (SELECT {k} AS id, {n} AS entity FROM {t} WHERE {k} % 2 = 0),
f AS (SELECT {n} AS entity, min({k}) AS doc FROM {t} WHERE {n} NOT IN (SELECT entity FROM dim) GROUP BY 1),
c AS (SELECT entity, (SELECT max(id) FROM dim) + row_number() OVER (ORDER BY doc) AS id FROM f)"""
_ENTITY = """entity AS name, entity AS company_name, 'unknown+' || CASE WHEN sl IN ('', '0') THEN 'unknown' ELSE sl END || '@example.com' AS email, '0000000000' AS phone_number, '-' AS address, '-' AS city,
 NULL::VARCHAR AS state, NULL::VARCHAR AS postal_code, 'Hong Kong' AS country, 1 AS is_active, TIMESTAMP '2026-01-15 10:20:30' AS created_at, TIMESTAMP '2026-01-15 10:20:30' AS updated_at
 FROM (SELECT *, regexp_replace(regexp_replace(lower(entity), '\\s+', '', 'g'), '[^a-z0-9]', '', 'g') AS sl FROM c)"""


@register("supplier_get_or_create", CREATE_SQL.format(t="supplier", k="s_suppkey", n="s_name") + f" SELECT id, {_ENTITY}")
def supplier_get_or_create(s, sf):
    return ledger.new_entities(created(s, sf, "supplier", "s_suppkey", "s_name"), "supplier", now())


@register("customer_get_or_create", CREATE_SQL.format(t="customer", k="c_custkey", n="c_name") + f" SELECT id, 1 AS customer_group_id, NULL::BIGINT AS user_id, {_ENTITY}")
def customer_get_or_create(s, sf):
    return ledger.new_entities(created(s, sf, "customer", "c_custkey", "c_name"), "customer", now())


@register("product_get_or_create", """WITH dim AS (SELECT p_partkey AS id, p_name AS code FROM part WHERE p_partkey % 50 = 0), w AS (SELECT p_name AS code, p_type AS name, p_retailprice AS unit_price, p_partkey AS doc FROM part WHERE p_name NOT IN (SELECT code FROM dim)),
 f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY code ORDER BY doc) = 1)
 SELECT (SELECT coalesce(max(id), 0) FROM dim) + row_number() OVER (ORDER BY doc) AS id, name, code, 'standard' AS type, 'C128' AS barcode_symbology, NULL::BIGINT AS brand_id, 1 AS category_id, 1 AS unit_id, 1 AS purchase_unit_id, 1 AS sale_unit_id,
 CAST(round(CAST(unit_price AS DECIMAL(18,4)) * 0.7, 2) AS DOUBLE) AS cost, unit_price AS price, 1 AS is_active, TIMESTAMP '2026-01-15 10:20:30' AS created_at, TIMESTAMP '2026-01-15 10:20:30' AS updated_at FROM f""")
def product_get_or_create(s, sf):
    p = t(s, sf, "part")
    dim = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("code"))
    want = p.select(F.col("p_name").alias("code"), F.col("p_type").alias("name"), F.col("p_retailprice").alias("unit_price"), F.col("p_partkey").alias("doc"))
    return ledger.new_products(ledger.get_or_create(want, dim, "code", ["doc"]), "sale", now())


@register("preview_entity_flags", "SELECT o_orderkey AS doc, k.id AS entity_id, k.id IS NOT NULL AS entity_exists FROM orders LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN (SELECT c_name, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) k ON k.c_name = c.c_name")
def preview_entity_flags(s, sf):
    dim = t(s, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("entity"))
    return edit.flags(headers(s, sf), "entity", dim, "entity").select("doc", "entity_id", "entity_exists")


@register("preview_product_flags", "SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS product_id, l_partkey % 3 = 0 AS product_exists FROM lineitem")
def preview_product_flags(s, sf):
    dim = t(s, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("code"))
    return edit.flags(items(s, sf), "code", dim, "product").select("doc", "pos", F.col("code").cast("long").alias("part"), "product_id", "product_exists")


@register("recalc_totals", "SELECT l_orderkey AS doc, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS calc_total, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS total_qty FROM lineitem GROUP BY 1")
def recalc_totals(s, sf):
    return edit.recalc(items(s, sf).withColumn("unit_price", F.col("total")))


def doc_files(s, sf):
    d = t(s, sf, "documents")
    return d.select(F.col("source").alias("run_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_p1."), F.col("lang")).alias("name"), F.col("lang").alias("ext"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.col("doc_id").cast("int").alias("pos"))


FORMAT = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN regexp_replace(CAST(CAST(round({0} / 1024.0::DOUBLE, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') || ' KB' ELSE regexp_replace(CAST(CAST(round({0} / 1048576.0::DOUBLE, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') || ' MB' END"


@register("file_summary", f"WITH x AS (SELECT source AS run_id, count(*) AS total_files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS total_size, count(DISTINCT lang) AS n_extensions FROM documents GROUP BY 1) SELECT *, {FORMAT.format('total_size')} AS total_size_human FROM x")
def file_summary(s, sf):
    out = files.summarize(doc_files(s, sf))
    return out.select("run_id", "total_files", "total_size", "total_size_human", F.size("by_extension").cast("long").alias("n_extensions"))


@register("format_bytes", f"SELECT doc_id, {FORMAT.format('b')} AS human FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) * 37 AS b FROM documents)")
def format_bytes(s, sf):
    d = t(s, sf, "documents")
    return d.select("doc_id", text.format_bytes(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 37).alias("human"))


@register("base_name_group", "SELECT source AS run_id, 'f' || doc_id % 50 AS base_name, lang AS ext, arg_max('f' || doc_id % 50 || '_p' || doc_id || '.' || lang, doc_id) AS name FROM documents GROUP BY 1, 2, 3")
def base_name_group(s, sf):
    f = doc_files(s, sf).withColumn("name", F.concat(F.lit("f"), F.col("pos") % 50, F.lit("_p"), F.col("pos"), F.lit("."), F.col("ext")))
    return files.group_by_base(f.withColumn("base_name", files.base_name(F.col("name"))))


RUNS = "SELECT strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || CASE WHEN o_orderkey % 7 = 0 THEN '_files' ELSE '' END AS run_id FROM orders"


def runs(s, sf):
    return t(s, sf, "orders").select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 7 == 0, "_files").otherwise("")).alias("run_id"))


@register("run_topk", f"SELECT run_id FROM ({RUNS}) WHERE run_id LIKE '20%' AND NOT regexp_matches(run_id, '_(files|scan|unzipped)') ORDER BY run_id DESC LIMIT 50")
def run_topk(s, sf):
    return files.list_runs(runs(s, sf))


@register("run_filter_delete", f"WITH r AS ({RUNS}) SELECT run_id FROM r WHERE regexp_replace(run_id, '_files$', '') NOT IN (SELECT run_id FROM r WHERE run_id LIKE '1995%' AND run_id NOT LIKE '%files')")
def run_filter_delete(s, sf):
    r = runs(s, sf)
    return files.delete_runs(r, r.where("run_id like '1995%' and run_id not like '%files'"))


DUCK = {
    "clean_string": ("documents", "doc_id", "text", r"trim(regexp_replace(x, '\s+', ' ', 'g'))", text.clean_string, lambda: F.col("text")),
    "slug": ("part", "p_partkey", "p_name", r"CASE WHEN regexp_replace(lower(x), '[^a-z0-9]', '', 'g') IN ('', '0') THEN 'unknown' ELSE regexp_replace(lower(x), '[^a-z0-9]', '', 'g') END", text.slug, lambda: F.col("p_name")),
    "money": ("part", "p_partkey", "'HK$ ' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || ' only'", "coalesce(try_cast(regexp_replace(x, '[^0-9.-]', '', 'g') AS DOUBLE), 0)", text.money, lambda: F.concat(F.lit("HK$ "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" only"))),
    "parse_number": ("part", "p_partkey", "p_size || '00Mah ' || p_type", "CAST(p_size * 100 AS DOUBLE)", text.parse_number, lambda: F.concat(F.col("p_size").cast("string"), F.lit("00Mah "), F.col("p_type"))),
    "normalize_amount": ("part", "p_partkey", "'USD ' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)", "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)", text.normalize_amount, lambda: F.concat(F.lit("USD "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))),
    "gen_code": ("part", "p_partkey", "p_name", "left(upper(regexp_replace(x, '[^A-Z0-9]+', '_', 'g')), 24) || '_' || substr(md5(x), 1, 6)", text.gen_code, lambda: F.col("p_name")),
    "ocr_fix_code": ("part", "p_partkey", "replace(replace(CAST(p_partkey AS VARCHAR), '0', 'O'), '5', 'S') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END", "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE replace(replace(CAST(p_partkey AS VARCHAR), '0', 'O'), '5', 'S') || 'X' END", text.fix_code_ocr, lambda: F.concat(F.translate(F.col("p_partkey").cast("string"), "05", "OS"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x"))),
    "ocr_fix_numeric": ("part", "p_partkey", "'a'", "CAST(p_partkey AS DOUBLE) + 0.5", text.fix_numeric_ocr, lambda: F.concat(F.translate(F.col("p_partkey").cast("string"), "0125", "OIZS"), F.lit("。5"))),
    "ocr_fix_text": ("part", "p_partkey", "'a'", "'no ' || p_partkey || '01 ' || p_name", text.fix_text_ocr, lambda: F.concat(F.lit("no  "), F.col("p_partkey").cast("string"), F.lit("O1 "), F.col("p_name"))),
    "strip_tags": ("pages", "page_id", "html", "regexp_replace(regexp_replace(coalesce(x, ''), '<!--(.|\n)*?-->', '', 'g'), '<[^>]*>', '', 'g')", text.strip_tags, lambda: F.col("html")),
    "currency_detect": ("documents", "doc_id", "text", "CASE WHEN regexp_matches(lower(x), '¥|￥|rmb|人民币|人民幣') THEN 'CNY' WHEN regexp_matches(lower(x), 'hk\\$|hkd|港币|港幣') THEN 'HKD' WHEN regexp_matches(replace(lower(x), '$hk', ''), '\\$|usd|美元|美金') THEN 'USD' WHEN regexp_matches(lower(x), '€|eur|欧元|歐元') THEN 'EUR' WHEN regexp_matches(lower(x), '£|gbp|英镑|英鎊') THEN 'GBP' END", text.document_currency, lambda: F.col("text")),
    "date_dmy_rollover": ("orders", "o_orderkey", "'a'", "CAST(make_date(year(o_orderdate), 1, 1) + to_months(day(o_orderdate) - 1) + to_days(month(o_orderdate) + 29) AS DATE)", text.normalize_date, lambda: F.concat((F.month("o_orderdate") + 30).cast("string"), F.lit("/"), F.dayofmonth("o_orderdate").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"))),
    "normalize_date_iso": ("orders", "o_orderkey", "'a'", "CAST(o_orderdate AS DATE)", text.normalize_date, lambda: F.date_format("o_orderdate", "yyyy/M/d")),
    "date_mdy_text": ("orders", "o_orderkey", "'a'", "strftime(o_orderdate, '%Y-%m-%d')", text.normalize_date_text, lambda: F.date_format("o_orderdate", "M/d/yyyy")),
    "clean_cell": ("part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN ' |--+ ' ELSE '  ' || p_name || '  |  x ' END", r"CASE WHEN p_partkey % 3 = 0 THEN '' ELSE trim(regexp_replace(x, '\s+', ' ', 'g')) END", text.clean_cell, lambda: F.when(F.col("p_partkey") % 3 == 0, " |--+ ").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit("  |  x ")))),
    "clean_item_name": ("part", "p_partkey", "'12.) - cable   ' || p_name || ' -* '", "'cable ' || p_name", text.clean_item_name, lambda: F.concat(F.lit("12.) - cable   "), F.col("p_name"), F.lit(" -* "))),
    "clean_entity_name": ("part", "p_partkey", "'a'", "'Acme ' || p_name", text.clean_entity_name, lambda: F.concat(F.get(F.array(*map(F.lit, ("Vendor: ", "FROM  ", "供應商:", "supplier", " "))), (F.col("p_partkey") % 5).cast("int")), F.lit(" Acme  "), F.col("p_name"), F.lit(" "))),
    "summary_row": ("part", "p_partkey", "'a'", "p_partkey % 4 < 2", lambda c: text.summary_row(F.lit("c-1"), c), lambda: F.get(F.array(*map(F.lit, ("Total", "小計", "Totals", "total 5"))), (F.col("p_partkey") % 4).cast("int"))),
    "item_code": ("part", "p_partkey", "p_name", "upper(left(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'), 10))", text.item_code, lambda: F.col("p_name")),
    "title_extract": ("documents", "doc_id", "'## ' || source || '\n' || doc_id", "source", text.title, lambda: F.concat(F.lit("## "), F.col("source"), F.lit("\n"), F.col("doc_id").cast("string"))),
    "keyword_score": ("documents", "doc_id", "text", "CAST(contains(lower(x), 'the') AS INT) + CAST(contains(lower(x), 'and') AS INT) + CAST(contains(lower(x), 'der') AS INT)", lambda c: text.keyword_hits(c, ("the", "and", "der")), lambda: F.col("text")),
}


def _scalar(name, table, key, given, expression, fn, column):
    @register(name, f"SELECT {key} AS id, {expression} AS value FROM (SELECT *, {given} AS x FROM {table})")
    def run(s, sf):
        return t(s, sf, table).select(F.col(key).alias("id"), fn(column()).alias("value"))


for _name, _spec in DUCK.items():
    _scalar(_name, *_spec)


@register("reference_no", f"SELECT o_orderkey AS id, {ref_sql('sr', 'o_orderdate', 'CAST(o_orderkey AS VARCHAR)')} AS value FROM orders")
def reference_no(s, sf):
    return t(s, sf, "orders").select(F.col("o_orderkey").alias("id"), text.reference_no("sr", F.col("o_orderdate"), F.col("o_orderkey")).alias("value"))


@register("currency_value", "SELECT p_partkey AS id, 'HKD' AS currency, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM part")
def currency_value(s, sf):
    v = text.value_currency(F.concat(F.lit("hk$ "), F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2)))
    return t(s, sf, "part").select(F.col("p_partkey").alias("id"), v["currency"].alias("currency"), v["amount"].alias("amount"))


#: Headers and the field each is.
HEADERS = (("款号", "code"), ("名称", "name"), ("颜色", "color"), ("数量", "qty"), ("单价", "unit_price"), ("金额", "total"), ("Item", "code"), ("Description", "name"), ("Amount", "qty"), ("規格", "name"), ("(Qty)", "qty"), ("Unit Price", "unit_price"), ("Remarks", "remark"), ("No.", "seq"), ("product title", "name"), ("grand sum", "total"), ("Disc.", "discount"), ("xyz", None), ("", None))
FUZZY = (("product title", "name"), ("article no", "code"), ("pcs count", "qty"), ("price list", "unit_price"), ("sum up", "total"), ("colour way", "color"), ("sizes", "size"), ("zzz", None))


def _values(rows):
    return ", ".join("('{}', {})".format(h, "NULL" if f is None else f"'{f}'") for h, f in rows)


@register("header_smart_map", f"SELECT * FROM (VALUES {_values(HEADERS)}) v(header, field)")
def header_smart_map(s, sf):
    return s.createDataFrame([(h,) for h, _ in HEADERS], "header string").select("header", fields.header_field(F.col("header")).alias("field"))


@register("header_fuzzy", f"SELECT * FROM (VALUES {_values(FUZZY)}) v(header, field)")
def header_fuzzy(s, sf):
    return s.createDataFrame([(h,) for h, _ in FUZZY], "header string").select("header", fields.fuzzy_field(F.col("header")).alias("field"))


@register("infer_column_type", "SELECT * FROM (VALUES ('l_quantity_int', 'qty'), ('l_extendedprice', 'total'), ('c_name', 'name'), ('l_returnflag', NULL)) v(name, kind)")
def infer_column_type(s, sf):
    li = t(s, sf, "lineitem").withColumn("l_quantity_int", F.col("l_quantity").cast("int"))
    out = tables.column_profile(li, "l_quantity_int")
    for frame, c in ((li, "l_extendedprice"), (t(s, sf, "customer"), "c_name"), (li, "l_returnflag")):
        out = out.unionByName(tables.column_profile(frame, c))
    return out


def rendered(s, sf, row, head, foot="", sep=""):
    """doc and content: every order's items rendered by line, in a fixed order."""
    li = items(s, sf).withColumn("qty_i", F.col("qty").cast("int")).withColumn("cents", F.round(F.col("total")).cast("long"))
    per = li.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "qty_i", "cents"))).alias("r"))
    return per.select("doc", F.concat(F.lit(head), F.array_join(F.transform("r", row), sep), F.lit(foot)).alias("content"))


def parsed_items(frame, parse):
    shape = pa.schema([("doc", pa.int64()), ("name", pa.string()), ("qty", pa.float64()), ("unit_price", pa.float64()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"doc": d, **{k: i[k] for k in ("name", "qty", "unit_price", "total")}} for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in parse(c)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return frame.mapInArrow(run, "doc long, name string, qty double, unit_price double, total double")


ITEMS_SQL = "SELECT l_orderkey AS doc, 'P' || l_partkey || 'k' AS name, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS qty, CAST(round(round(l_extendedprice) / CAST(l_quantity AS INT), 4) AS DOUBLE) AS unit_price, round(l_extendedprice) AS total FROM lineitem"
_cells = lambda i: [F.concat(F.lit("P"), i["code"], F.lit("k")), i["qty_i"].cast("string"), F.lit(""), i["cents"].cast("string")]


@register("html_table_items", ITEMS_SQL)
def html_table_items(s, sf):
    row = lambda i: F.concat(F.lit("<tr><td>"), F.array_join(F.array(*_cells(i)), "</td><td>"), F.lit("</td></tr>"))
    docs = rendered(s, sf, row, "<table border=1><tr><th>Name</th><th>Qty</th><th>Price</th><th>Total</th></tr>", "<tr><td>Total</td><td></td><td></td><td>9</td></tr></table>")
    return parsed_items(docs, lambda c: extract.table_items(extract.best_table(extract.html_tables(c))))


@register("md_table_items", ITEMS_SQL)
def md_table_items(s, sf):
    row = lambda i: F.concat(F.lit("| "), F.array_join(F.array(*_cells(i)), " | "), F.lit(" |"))
    docs = rendered(s, sf, row, "# T\n\n| Name | Qty | Price | Total |\n|---|---|---|---|\n", "\n", "\n")
    return parsed_items(docs, lambda c: extract.table_items(extract.best_table(extract.pipe_tables(c), 0.3)))


@register("html_span_expand", "SELECT doc, 'a' || doc AS c0, '' AS c1, 'b' AS c2, 'c' AS d0, 'd' AS d1, 'b' AS d2 FROM (SELECT o_orderkey AS doc FROM orders)")
def html_span_expand(s, sf):
    docs = t(s, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("<table border=1><tr><td colspan=2>a"), F.col("o_orderkey").cast("string"), F.lit("</td><td rowspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>")).alias("content"))
    shape = pa.schema([("doc", pa.int64()), *((f"{r}{i}", pa.string()) for r in "cd" for i in range(3))])

    def run(batches):
        for b in batches:
            rows = [dict(zip(shape.names, [d, *(x for row in extract.html_tables(c)[0] for x in row)], strict=True)) for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return docs.mapInArrow(run, "doc long, c0 string, c1 string, c2 string, d0 string, d1 string, d2 string")


@register("text_list_items", "SELECT l_orderkey AS doc, 'cable' AS name, 1.0::DOUBLE AS qty, round(l_extendedprice) AS unit_price, round(l_extendedprice) AS total FROM lineitem GROUP BY ALL")
def text_list_items(s, sf):
    docs = rendered(s, sf, lambda i: F.concat(F.lit("- cable "), i["cents"].cast("string")), "", "", "\n")
    return parsed_items(docs, extract.text_items)


LINES_SQL = """SELECT l_orderkey AS doc, l_linenumber AS pos, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS qty, CAST(l_linenumber + 10 AS DOUBLE) AS unit_price, CAST(CAST(l_quantity AS INT) * (l_linenumber + 10) + CASE WHEN l_orderkey % 5 = 0 THEN 100000 ELSE 0 END AS DOUBLE) AS total FROM lineitem"""


@register("text_line_items", f"SELECT * FROM ({LINES_SQL}) WHERE abs(qty * unit_price - total) / total < 0.1")
def text_line_items(s, sf):
    li = items(s, sf)
    q, p = F.col("qty").cast("int"), F.col("pos") + 10
    total = q * p + F.when(F.col("doc") % 5 == 0, 100000).otherwise(0)
    return tables.line_item(li.select("doc", "pos", F.concat_ws(" ", F.lit("cable"), q.cast("string"), p.cast("string"), total.cast("string")).alias("line"))).select("doc", "pos", "qty", "unit_price", "total")


@register("text_dedupe", "SELECT l_orderkey AS doc, l_quantity AS qty, min(l_linenumber) AS pos FROM lineitem GROUP BY l_orderkey, l_quantity, l_returnflag")
def text_dedupe(s, sf):
    li = t(s, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("qty"), F.lit(1.0).alias("total"))
    return tables.dedupe_items(li).select("doc", "qty", "pos")


@register("last_total", "SELECT o_orderkey AS doc, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM orders")
def last_total(s, sf):
    docs = t(s, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("Total: 5\nGrand Total: $"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit("\nthanks")).alias("content"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract.last_total(extract.TEXT["total"], c) for c in b.column(1).to_pylist()], pa.float64())], names=["doc", "total"])

    return docs.mapInArrow(run, "doc long, total double")


@register("merged_split", "SELECT l_orderkey AS doc, count(*) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS checksum FROM lineitem GROUP BY 1")
def merged_split(s, sf):
    docs = rendered(s, sf, lambda i: F.concat(F.lit("## Invoice "), i["pos"].cast("string"), F.lit("\n- cable "), (i["pos"] * 7).cast("string"), F.lit("\n")), "")

    def run(batches):
        for b in batches:
            made = [extract.markdown("merged.md", c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len({i["source_file"] for i in m}) for m in made], pa.int64()), pa.array([int(sum(i["items"][-1]["total"] for i in m) / 7) for m in made], pa.int64())], names=["doc", "parts", "checksum"])

    return docs.mapInArrow(run, "doc long, parts long, checksum long")


@register("yband_group", """WITH g AS (SELECT user_id, event_id, CASE WHEN abs(epoch(ts) - lag(epoch(ts)) OVER w) >= 3600 THEN 1 ELSE 0 END AS n, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id))
 SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM g""")
def yband_group(s, sf):
    e = t(s, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("y"))
    return tables.gap_groups(e, "user_id", "y", 3.6e9, "event_id").select("event_id", "band")


def run_files(s, sf):
    """A Markdown table per even order and a list per odd one, as files of a run."""
    d = t(s, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit(0).alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "a.md").otherwise("a.txt").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "| Item | Qty | Price | Total |\n|---|---|---|---|\n| cable | 2 | 5 | 10 |\n").otherwise("total 20\n- cable 20 price\n- plug 7\n").alias("content"))
    return d


@register("parser_detect", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'generic_markdown' ELSE 'text_block' END AS parser_id FROM orders")
def parser_detect(s, sf):
    return registry.Registry().detect(run_files(s, sf)).select("run_id", "parser_id")


@register("parser_fallback", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'generic_markdown' ELSE 'text_block' END AS parser_id, CASE WHEN o_orderkey % 2 = 0 THEN 10.0 ELSE 7.0 END::DOUBLE AS calc_total FROM orders")
def parser_fallback(s, sf):
    return registry.Registry().parse_with_fallback(run_files(s, sf)).select("run_id", "parser_id", "calc_total")


def damaged(s, sf):
    """Items with one value of each line missing, by order key."""
    k = F.col("l_orderkey") % 5
    q, total = F.col("l_quantity").cast("int").cast("double"), F.col("l_quantity").cast("int").cast("double") * 12
    return t(s, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("code"), F.lit("cable").alias("name"), F.when(k == 1, 0.0).when(k == 3, -1.0).otherwise(q).alias("qty"), F.when(k.isin(2, 3), 0.0).otherwise(12.0).alias("unit_price"), F.when(k == 0, 0.0).otherwise(total).alias("total"))


_D = "q.l_orderkey % 5"
MISSING_SQL = f"SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN {_D} = 3 THEN 1.0::DOUBLE ELSE n END AS qty, CASE WHEN {_D} = 3 THEN n * 12 ELSE 12.0::DOUBLE END AS unit_price, n * 12 AS total FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS n FROM lineitem) q"


@register("validator_missing_calc", MISSING_SQL)
def validator_missing_calc(s, sf):
    return validate.missing_values(damaged(s, sf)).select("doc", "pos", "qty", "unit_price", "total")


@register("validator_ranges", """SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_discount > 0.05 OR l_orderkey % 4 = 0 THEN 'total_off' ELSE '' END AS warnings, CASE WHEN l_orderkey % 4 = 0 THEN 'qty_negative' ELSE '' END AS errors FROM lineitem""")
def validator_ranges(s, sf):
    li = t(s, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.lit("cable").alias("name"), F.when(F.col("l_orderkey") % 4 == 0, -1.0).otherwise(1.0).alias("qty"), F.lit(100.0).alias("unit_price"), F.when(F.col("l_discount") > 0.05, 200.0).otherwise(100.0).alias("total"))
    return validate.range_checks(rows).select("doc", "pos", F.array_join("warnings", ",").alias("warnings"), F.array_join("errors", ",").alias("errors"))


@register("validator_fixes", f"SELECT l_orderkey AS doc, l_linenumber AS pos, CASE {_D} WHEN 0 THEN 'filled total' WHEN 1 THEN 'filled qty' WHEN 2 THEN 'filled unit_price' WHEN 3 THEN 'filled qty and unit_price' ELSE '' END AS fixes FROM lineitem q")
def validator_fixes(s, sf):
    return validate.missing_values(validate.repair_ocr(damaged(s, sf))).select("doc", "pos", F.array_join("fixes", ",").alias("fixes"))


@register("validator_ocr", """SELECT l_orderkey AS doc, l_linenumber AS pos, 'part 10 of ' || l_linenumber AS name, CAST(105 + 1000 * l_linenumber AS VARCHAR) AS code, CAST(CAST(l_quantity AS INT) * 10 AS DOUBLE) AS qty, 12.0::DOUBLE AS unit_price,
 CAST(l_linenumber * 1000 + 500 AS DOUBLE) AS total, 4 AS n_fixes FROM lineitem""")
def validator_ocr(s, sf):
    """Names with blanks and letters for digits, codes and numbers as text with letters for digits."""
    line = F.col("l_linenumber").cast("string")
    rows = t(s, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("  part  10 of "), line).alias("name"), F.concat(line, F.lit("1O5")).alias("code"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("O")).alias("qty"), F.lit("12").alias("unit_price"), F.concat(line, F.lit(",5OO")).alias("total"),
    )
    return validate.repair_ocr(rows).select("doc", "pos", "name", "code", "qty", "unit_price", "total", F.size("fixes").alias("n_fixes"))


@register("validator_headers", """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'Acme 105 Ltd' ELSE 'Acme' END AS entity, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS invoice_date,
 CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_fixes, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS n_warnings FROM orders""")
def validator_headers(s, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "d/M/yyyy")).when(k % 4 == 2, F.date_format(day, "yyyy年M月d日")).otherwise("some day")
    rows = t(s, sf, "orders").select(k.alias("doc"), F.when(k % 3 == 0, "Acme 1O5  Ltd").otherwise("Acme").alias("entity"), date.alias("invoice_date"))
    return validate.repair_header(rows).select("doc", "entity", "invoice_date", F.size("header_fixes").alias("n_fixes"), F.size("header_warnings").alias("n_warnings"))


@register("validator_structure", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'unknown' END AS source_file, '' AS supplier_name, CAST(0 AS DOUBLE) AS calc_total, NULL::VARCHAR AS currency FROM orders")
def validator_structure(s, sf):
    rows = t(s, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 0, "f").alias("source_file"))
    return validate.structure(rows).select("doc", "source_file", "supplier_name", "calc_total", "currency")


@register("validator_normalize", "SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_orderkey % 3 = 1 THEN 'P' || l_partkey ELSE 'bolt' END AS name, CASE WHEN l_orderkey % 3 = 2 THEN 'BOLT' ELSE 'P' || l_partkey END AS code FROM lineitem WHERE l_orderkey % 6 <> 0 OR l_linenumber % 2 = 0")
def validator_normalize(s, sf):
    """Names from codes, codes from names, and nameless items dropped."""
    k = F.col("l_orderkey")
    none = (k % 6 == 0) & (F.col("l_linenumber") % 2 != 0)
    code = F.when(none | (k % 3 == 2), " ").otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    rows = t(s, sf, "lineitem").select(k.alias("doc"), F.col("l_linenumber").alias("pos"), F.when(none, F.lit(None).cast("string")).when(k % 3 == 1, "").otherwise(" bolt ").alias("name"), code.alias("code"), *(F.lit(1.0).alias(c) for c in ("qty", "unit_price", "total")))
    return validate.normalize(rows).select("doc", "pos", "name", "code")


TOTAL_STATE = f"WITH {STATUS_SQL} SELECT doc, coalesce(calc_total, 0) AS calc_total, CASE WHEN coalesce(calc_total, 0) <= 0 THEN 'calc_not_positive' WHEN abs(declared - calc_total) / greatest(abs(declared), abs(calc_total)) > 0.05 THEN 'differs' ELSE 'ok' END AS total_state FROM st"


@register("validator_totals", TOTAL_STATE)
def validator_totals(s, sf):
    return validate.total_check(headers(s, sf), items(s, sf)).select("doc", "calc_total", "total_state")


@register("validator_summary", "SELECT count(*) AS total, count(*) FILTER (n > 0) AS valid, count(*) FILTER (n = 0) AS invalid, count(*) FILTER (n > 0 AND o_orderkey % 5 <> 4) AS fixed FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def validator_summary(s, sf):
    return validate.batch_summary(validate.validate(headers(s, sf), damaged(s, sf))[0])


def whole_batch(s, sf, kind):
    """One batch of all orders into a ledger that knows half of the customers and a third of the parts."""
    people = t(s, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("entity"))
    goods = t(s, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("code"))
    named = items(s, sf).withColumn("name", F.concat(F.lit("part "), F.col("code")))
    return ledger.import_batch(headers(s, sf), named, people, goods, kind, now(), last_id=1000)


def batch_sql(fact: str) -> str:
    who = "supplier" if fact == "purchase" else "customer"
    return f"""{OK_SQL}, kb AS (SELECT c_name AS entity, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0),
 fresh AS (SELECT entity, min(doc) AS first FROM ok WHERE entity NOT IN (SELECT entity FROM kb) GROUP BY 1),
 eids AS (SELECT entity, id FROM kb UNION ALL SELECT entity, (SELECT max(id) FROM kb) + row_number() OVER (ORDER BY first) FROM fresh),
 hb AS (SELECT ok.doc, 1000 + row_number() OVER (ORDER BY ok.doc) AS id, source_file, eids.id AS {who}_id FROM ok LEFT JOIN eids USING (entity)),
 gb AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part, l_extendedprice AS total FROM lineitem JOIN hb ON hb.doc = l_orderkey),
 np AS (SELECT part, row_number() OVER (ORDER BY doc, pos, CAST(part AS VARCHAR)) AS r FROM (SELECT * FROM gb WHERE part % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc, pos) = 1)),
 pid AS (SELECT p_partkey AS part, p_partkey AS id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT part, (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 = 0) + r FROM np)
 SELECT hb.id AS header_id, source_file AS document, {who}_id AS entity_id, pid.id AS product_id, gb.total FROM hb JOIN gb USING (doc) JOIN pid USING (part)"""


def batch_rows(s, sf, kind, fact, who):
    made = whole_batch(s, sf, kind)
    head = made["headers"].select(F.col("id").alias("header_id"), "document", F.col(f"{who}_id").alias("entity_id"))
    return head.join(made["lines"].select(F.col(f"{fact}_id").alias("header_id"), "product_id", "total"), "header_id")


@register("import_batch_purchase", batch_sql("purchase"))
def import_batch_purchase(s, sf):
    return batch_rows(s, sf, "purchase", "purchase", "supplier")


@register("import_batch_sale", batch_sql("sale"))
def import_batch_sale(s, sf):
    return batch_rows(s, sf, "sale", "sale", "customer")


@register("item_defaults", """SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_orderkey % 2 = 0 THEN 'P' || l_partkey ELSE 'bolt' END AS name, 'P' || l_partkey AS code, CASE WHEN l_orderkey % 3 = 2 THEN l_quantity ELSE 1.0 END::DOUBLE AS qty,
 CASE l_orderkey % 3 WHEN 0 THEN 7.0 WHEN 1 THEN -21.0 ELSE l_quantity * 7 END::DOUBLE AS total FROM lineitem""")
def item_defaults(s, sf):
    """Missing names, quantities and totals; a total is made before a quantity below 1 is mended."""
    k = F.col("l_orderkey")
    qty = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 3 == 1, -3.0).otherwise(F.col("l_quantity"))
    rows = t(s, sf, "lineitem").select(k.alias("doc"), F.col("l_linenumber").alias("pos"), F.when(k % 2 == 0, " ").otherwise("bolt").alias("name"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"), qty.alias("qty"), F.lit(7.0).alias("unit_price"), F.lit(None).cast("double").alias("total"))
    return ledger.default_items(rows).select("doc", "pos", "name", "code", "qty", "total")


@register("name_defaults", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'UNKNOWN_SUPPLIER' ELSE 'Acme' END AS supplier, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN_CUSTOMER' ELSE 'Kim' END AS customer FROM orders")
def name_defaults(s, sf):
    k = F.col("o_orderkey")
    rows = t(s, sf, "orders").select(k.alias("doc"), F.when(k % 2 == 0, "  ").otherwise("Acme").alias("entity"), F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise("Kim").alias("other"))
    first = ledger.default_names(rows, "supplier").withColumn("supplier", F.col("entity")).withColumn("entity", F.col("other"))
    return ledger.default_names(first, "customer").select("doc", "supplier", F.col("entity").alias("customer"))


def order_files(s, sf, name, content):
    """A file per order, as a run of its own; the content is an expression over doc, day and line items' number n."""
    o = t(s, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.select(F.col("doc").cast("string").alias("run_id"), F.lit(0).alias("pos"), F.lit(name).alias("name"), content.alias("content"))


def _doc():
    return F.col("doc").cast("string")


FIELDS = ("supplier_name", "customer_name", "invoice_date", "invoice_number", "declared_total", "calc_total", "currency")


@register("text_header_fields", """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'Acme ' || o_orderkey || ' Ltd' AS supplier_name, 'Buyer ' || o_orderkey AS customer_name, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, 'A-' || o_orderkey AS invoice_number,
 CAST(o_orderkey AS DOUBLE) AS declared_total, 580.0::DOUBLE AS calc_total, 'HKD' AS currency FROM orders""")
def text_header_fields(s, sf):
    """Header fields of running text, through the parser that reads it when it is forced."""
    doc = _doc()
    text_ = F.concat(F.lit("Vendor: Acme "), doc, F.lit(" Ltd\nBill to: Buyer "), doc, F.lit("\nDate: "), F.col("day"), F.lit("\nInvoice No: A-"), doc, F.lit("\nTotal: 5\nCable 4 145 580\nGrand total: "), doc, F.lit("\npaid in HKD\n"))
    return registry.Registry().parse(order_files(s, sf, "a.txt", text_), "text_block").select("run_id", *FIELDS)


@register("page_fields", """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'Acme ' || o_orderkey || ' Ltd' AS supplier_name, 'Buyer ' || o_orderkey AS customer_name, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, 'A-' || o_orderkey AS invoice_number,
 CAST(o_orderkey AS DOUBLE) AS declared_total, 10.0::DOUBLE AS calc_total, NULL::VARCHAR AS currency, 'Cable - red [XL]' AS item FROM orders""")
def page_fields(s, sf):
    """Header fields and items of OCR pages, wrapped or not, through the parser that scores best."""
    doc = _doc()
    block = lambda label, *parts: F.concat(F.lit(f'{{"block_label": "{label}", "block_content": "'), *parts, F.lit('"}'))
    table = "<table><tr><td>Name</td><td>Color</td><td>Size</td><td>Qty</td><td>Price</td><td>Total</td></tr><tr><td>Cable</td><td>red</td><td>XL</td><td>2</td><td>5</td><td></td></tr><tr><td>Total</td><td></td><td></td><td></td><td></td><td>10</td></tr></table>"
    blocks = [block("text", F.lit("Vendor: Acme "), doc, F.lit(" Ltd")), block("text", F.lit("To: Buyer "), doc), block("text", F.lit("Date: "), F.col("day")), block("text", F.lit("Invoice # A-"), doc), block("text", F.lit("Grand total: "), doc), block("table", F.lit(table))]
    page = F.concat(F.lit('{"parsing_res_list": ['), F.concat_ws(",", *blocks), F.lit('], "model_settings": {}, "layout_det_res": {}}'))
    k = F.col("doc") % 3
    whole = F.when(k == 0, page).when(k == 1, F.concat(F.lit('{"result": '), page, F.lit("}"))).otherwise(F.concat(F.lit('{"data": '), page, F.lit("}")))
    out = registry.Registry().parse(order_files(s, sf, "a.json", whole))
    return out.select("run_id", *FIELDS, F.col("items")[0]["name"].alias("item"))


@register("text_multiplication", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'Widget' AS name, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS qty, 12.0::DOUBLE AS unit_price, CAST(12 * (o_orderkey % 50 + 1) AS DOUBLE) AS total FROM orders")
def text_multiplication(s, sf):
    content = F.concat(F.lit("Widget x"), (F.col("doc") % 50 + 1).cast("string"), F.lit(" @12"))
    out = registry.Registry().parse(order_files(s, sf, "a.txt", content), "text_block")
    first = F.filter("items", lambda i: (i["name"] == "Widget") & (i["metadata"]["parse_method"] == "multiplication"))[0]
    return out.select("run_id", first["name"].alias("name"), first["qty"].alias("qty"), first["unit_price"].alias("unit_price"), first["total"].alias("total"))


@register("block_group_items", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'block_group' AS how, 'cable' AS name, CAST(o_orderkey % 9 + 2 AS DOUBLE) AS qty, 12.0::DOUBLE AS unit_price, CAST(12 * (o_orderkey % 9 + 2) AS DOUBLE) AS total FROM orders")
def block_group_items(s, sf):
    """Blocks that only make an item together, by their upper edges."""
    q = F.col("doc") % 9 + 2
    block = lambda y, text_: F.concat(F.lit(f'{{"block_label": "text", "block_bbox": [0, {y}, 9, 9], "block_content": "'), text_, F.lit('"}'))
    page = F.concat(F.lit('{"parsing_res_list": ['), F.concat_ws(",", block(40, q.cast("string")), block(70, (q * 12).cast("string")), block(10, F.lit("cable")), block(300, F.lit("bye"))), F.lit("]}"))
    out = registry.Registry().parse(order_files(s, sf, "a.json", page), "text_block").select("run_id", F.explode("items").alias("i"))
    return out.select("run_id", F.col("i")["metadata"]["parse_method"].alias("how"), "i.name", "i.qty", "i.unit_price", "i.total")


@register("extension_filter", "SELECT doc_id, doc_id % 6 < 3 AS keep FROM documents")
def extension_filter(s, sf):
    ends = F.array(*map(F.lit, ("json", "MD", "md", "exe", "png", "pyc")))
    return t(s, sf, "documents").select("doc_id", files.wanted(F.concat(F.lit("f."), F.get(ends, (F.col("doc_id") % 6).cast("int")))).alias("keep"))


@register("upload_split", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 2 = 0 THEN 'kept' END AS part FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def upload_split(s, sf):
    """Uploads that failed beside those that arrived and are wanted."""
    k = F.col("doc_id")
    rows = t(s, sf, "documents").select(F.concat(k.cast("string"), F.when(k % 2 == 0, ".md").otherwise(".exe")).alias("name"), F.when(k % 3 == 0, 4).otherwise(0).alias("error"))
    ok, bad = files.ingest_upload(rows)
    number_ = F.regexp_extract("name", "^[0-9]+", 0).cast("long").alias("doc_id")
    return ok.select(number_, F.lit("kept").alias("part")).unionByName(bad.select(number_, F.lit("failed").alias("part")))


@register("llm_response_parse", "SELECT o_orderkey AS doc, CAST(o_orderkey AS DOUBLE) AS total, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END AS n FROM orders WHERE o_orderkey % 4 <> 3")
def llm_response_parse(s, sf):
    o = t(s, sf, "orders")
    body = F.concat(F.lit('{"items": [{"name": "x", "total": '), F.col("o_orderkey").cast("string"), F.lit("}]}"))
    k = F.col("o_orderkey") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("so "), body, F.lit(" ok"))).otherwise("no idea")
    docs = o.select(F.col("o_orderkey").alias("doc"), answer.alias("content"))

    def run(batches):
        for b in batches:
            made = [(d, m) for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in extract.model_invoice("x", c)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.int64()), pa.array([m["calc_total"] for _, m in made], pa.float64()), pa.array([len(m["items"]) for _, m in made], pa.int32())], names=["doc", "total", "n"])

    return docs.mapInArrow(run, "doc long, total double, n int")


@register("edit_subset", "SELECT l_orderkey AS doc, count(*) + 1 AS n_added, greatest(count(*) - 1, 1) AS n_removed FROM lineitem GROUP BY 1")
def edit_subset(s, sf):
    one = F.struct("code", F.col("code").alias("name"), "qty", "unit_price", "total")
    per = items(s, sf).groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("i"))
    return per.select("doc", F.size(edit.add_item(F.col("i"))).cast("long").alias("n_added"), F.size(edit.remove_item(F.col("i"), 0)).cast("long").alias("n_removed"))


@register("stream_ingest_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_ingest_summary(s, sf):
    """The events file read as a stream to its end, counted per micro-batch, then combined."""
    import tempfile
    import uuid

    from ..streaming import ingest

    conf = s.sparkContext.getConf().get("spark.checkpoint.dir", None) or s.conf.get("spark.checkpoint.dir", None)
    if not conf and not s.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

    name = f"stream_{uuid.uuid4().hex}"
    schema = t(s, sf, "events").schema
    stream = ingest.summary_stream(s, sf, "events.parquet", schema.simpleString()[7:-1].replace(":", " "))
    conf = conf or "file://" + tempfile.mkdtemp(prefix="ledgerloom-stream-")
    out = f"{conf.rstrip('/')}/{name}"
    each = lambda df, epoch: df.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
    ingest.ingest(stream, each, f"{out}/checkpoint").awaitTermination()
    return s.read.parquet(f"{out}/data").groupBy("event_type").agg(F.sum("n").alias("n"), F.countDistinct("user_id").alias("users"))


@register("unwrap_json", "SELECT o_orderkey AS id, '{\"a\":' || o_orderkey || '}' AS value FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, '{\"result\":5,\"a\":' || o_orderkey || '}' FROM orders WHERE o_orderkey % 4 = 3")
def unwrap_json(s, sf):
    """Pages under result, under data, bare, and with a result that is no object."""
    k = F.col("o_orderkey")
    page = F.concat(F.lit('{"a":'), k.cast("string"), F.lit("}"))
    whole = F.when(k % 4 == 0, F.concat(F.lit('{"result":'), page, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"data":'), page, F.lit("}"))).when(k % 4 == 2, page)
    return t(s, sf, "orders").select(k.alias("id"), text.unwrap_json(F.coalesce(whole, F.concat(F.lit('{"result":5,"a":'), k.cast("string"), F.lit("}")))).alias("value"))


@register("row_cell", "SELECT p_partkey AS id, trim(coalesce(string_split(p_name, ' ')[p_partkey % 6 + 1], '')) AS value FROM part")
def row_cell(s, sf):
    return t(s, sf, "part").select(F.col("p_partkey").alias("id"), text.cell(F.split("p_name", " "), (F.col("p_partkey") % 6).cast("int")).alias("value"))


@register("edit_update", "SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN first THEN 3.0 ELSE l_quantity END::DOUBLE AS qty, CASE WHEN first THEN 6.0 ELSE l_quantity * 2 END::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1 AS first FROM lineitem)")
def edit_update(s, sf):
    """The first item of every draft (by number, quantity, total) gets another quantity; all totals follow."""
    one = F.struct("pos", "qty", F.lit(2.0).alias("unit_price"), "total")
    per = items(s, sf).groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("i"))
    return per.select("doc", F.explode(edit.line_totals(edit.update_item(F.col("i"), 0, "qty", F.lit(3.0)))).alias("i")).select("doc", "i.pos", "i.qty", "i.total")


@register("parser_info", "SELECT * FROM (VALUES ('doc_parser_json', 'OCR page JSON', 'json', true), ('generic_markdown', 'Markdown', 'md,txt', true), ('text_block', 'Text blocks', 'json,md,txt', true), ('llm_assisted', 'Language model', 'json,md,txt', false)) v(id, name, extensions, enabled)")
def parser_info(s, sf):
    return registry.Registry().info(t(s, sf, "orders"))


@register("llm_content", "SELECT o_orderkey AS doc, 'Acme ' || o_orderkey || chr(10) || 'Total 5' AS shown FROM orders")
def llm_content(s, sf):
    """What a language model is shown of a page: its blocks' texts without tags."""
    page = F.concat(F.lit('{"data": {"parsing_res_list": [{"block_content": "<b>Acme</b> '), F.col("o_orderkey").cast("string"), F.lit('"}, {"block_content": "Total<!-- x --> 5"}]}}'))
    docs = t(s, sf, "orders").select(F.col("o_orderkey").alias("doc"), page.alias("content"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract.model_content("a.json", c) for c in b.column(1).to_pylist()], pa.string())], names=["doc", "shown"])

    return docs.mapInArrow(run, "doc long, shown string")
