import datetime as dt
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import edit, ledger, tables, validate
from ledgerloom.sources import files
from ledgerloom.streaming import ingest

DAY = dt.date(2026, 1, 5)
HEADERS = "doc long, source_file string, entity string, invoice_date date, declared double"
ITEMS = "doc long, pos int, code string, name string, qty double, unit_price double, total double"


@pytest.fixture(scope="module")
def batch(spark):
    heads = [(1, "a", "A", DAY, 100.0), (2, "b", " ", DAY, 100.0), (3, "c", "C", DAY, 100.0), (4, "d", "A", DAY, None), (5, "e", "E", DAY, 1.0), (6, "f", "F", DAY, 0.0)]
    items = [(1, 0, "p", "P", 1.0, 100.04, 100.04), (2, 0, "", "Q", 2.0, 50.5, 101.0), (3, 0, "r", "", 1.0, 103.0, 103.0), (4, 0, "p", "P", None, 4.0, None), (6, 0, "z", "Z", 1.0, 1.0, 1.0)]
    return spark.createDataFrame(heads, HEADERS), spark.createDataFrame(items, ITEMS)


def test_status(batch):
    got = {r["doc"]: r["status"] for r in ledger.import_status(*batch).collect()}
    assert got == {1: "ok", 2: "ok", 3: "TOTAL_MISMATCH", 4: "ok", 5: "NO_ITEMS_FOUND", 6: "TOTAL_MISMATCH"}
    assert ledger.import_status(*batch).where("doc = 3").first()["reason"] == "TOTAL_MISMATCH declared=100 calc=103"


def test_import_batch(spark, batch):
    entities = spark.createDataFrame([(7, "A")], "id long, entity string")
    products = spark.createDataFrame([(3, "x")], "id long, code string")
    for kind, columns in (("purchase", 23), ("sale", 32)):
        out = ledger.import_batch(*batch, entities, products, kind, F.lit("2026-01-15 10:20:30").cast("timestamp"))
        assert len(out["headers"].columns) == columns + 1 and out["headers"].count() == 3
        assert [(r["id"], r["name"]) for r in out["entities"].collect()] == [(8, "UNKNOWN_SUPPLIER" if kind == "purchase" else "UNKNOWN_CUSTOMER")]
        assert [r["id"] for r in out["products"].orderBy("id").collect()] == [4, 5]
        assert out["lines"].count() == 3 and out["lines"].where("product_id is null").count() == 0
        assert tuple(out["summary"].first()) == (3, 3) and out["manifest"].count() == 3 and out["failed"].count() == 3


def test_empty(batch):
    heads, items = (d.limit(0) for d in batch)
    assert tuple(ledger.summary(ledger.import_status(heads, items)).first()) == (0, 0)


def test_validation(batch):
    invoices, items = validate.validate(*batch)
    got = {r["doc"]: (r["valid"], r["total_state"]) for r in invoices.collect()}
    assert got[5] == (False, "calc_not_positive") and got[4] == (True, "no_declared") and got[1] == (True, "ok")
    assert items.where("doc = 4").first()["total"] == 0.0
    assert validate.batch_summary(invoices).first()["total"] == 6
    assert validate.Limits().merged(max_qty=5).max_qty == 5
    heads, items = batch
    text = items.select("doc", "pos", "code", "name", *(F.concat(F.col(c).cast("string"), F.lit("O")).alias(c) if c == "total" else F.col(c) for c in ("qty", "unit_price", "total")))
    fixed, rows = validate.validate(heads.withColumn("invoice_date", F.lit("no day")), text)
    assert rows.where("doc = 1").first()["total"] == 100.04 and {r["doc"]: r["n_fixes"] for r in fixed.collect()}[1] == 2  # the total, and the code in capitals
    assert fixed.where("doc = 1").first()["n_warnings"] == 2 and validate.batch_summary(fixed).first()["fixed"] >= 4


def test_edit(spark):
    rows = spark.createDataFrame([(1, [("a", "A", 2.0, 3.0, 0.0)])], "doc int, items array<struct<code:string,name:string,qty:double,unit_price:double,total:double>>")
    one = rows.select(edit.line_totals(F.col("items")).alias("i"), edit.remove_item(F.col("items"), 0).alias("r"), edit.add_item(F.col("items")).alias("a"), edit.update_item(F.col("items"), 0, "name", F.lit("B")).alias("u")).first()
    assert one["i"][0]["total"] == 6.0 and len(one["r"]) == 1 and len(one["a"]) == 2 and one["u"][0]["name"] == "B"
    kept = edit.replace_invoices(spark.createDataFrame([("r", 1), ("q", 2)], "run_id string, x int"), spark.createDataFrame([("r", 3)], "run_id string, x int"))
    assert sorted(map(tuple, kept.collect())) == [("q", 2), ("r", 3)]


def test_tables(spark):
    rows = spark.createDataFrame([(1, "Cable 4 145 580"), (2, "Cable 4 145 900"), (3, "Cable 580"), (4, "5 20"), (5, None)], "doc int, line string")
    assert [r["doc"] for r in tables.line_item(rows).collect()] == [1, 4]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b_p1.JSON").write_text("{}")
    (tmp_path / "in" / "sub" / "a.md").write_text("# t")
    (tmp_path / "in" / ".hid.md").write_text("x")
    (tmp_path / "in" / "c.pyc").write_text("x")
    got = files.scan(spark, str(tmp_path / "in"))
    assert [(r["name"], r["base_name"], r["relative_path"]) for r in got.orderBy("pos").collect()] == [("a.md", "a", "sub/a.md"), ("b_p1.JSON", "b", "b_p1.JSON")]
    assert files.summarize(got).first()["total_size_human"] == "5 B"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/e.md", "# e")
    assert [r["content"] for r in files.scan_zip(spark, str(tmp_path / "x.zip")).collect()] == ["# e"]
    errors = spark.createDataFrame([("a", 0), ("b", 4)], "name string, error int")
    assert [r["name"] for r in files.upload_errors(errors).collect()] == ["b"]
    seen = []
    ingest.ingest(ingest.files_stream(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r["length"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [2, 3]


def test_stored_drafts(spark):
    """Drafts of three generations, read, saved and read again."""
    drafts = files.load_drafts(spark, str(Path(__file__).parent / "data/uploads"))
    got = {r["run_id"]: r for r in drafts.collect()}
    assert sorted(got) == ["20260201_080000_aa11", "20260202_090000_bb22", "20260203_100000_cc33"]
    old, middle, new = (got[k] for k in sorted(got))
    assert old["type"] is None and old["invoices"][0]["items"][0]["total"] == 12 and len(middle["invoices"]) == 2
    assert new["parser"]["id"] == "generic_markdown" and new["invoices"][0]["items"][0]["name"] == "cable" and new["invoices"][0]["currency"] == "HKD"


def test_saved_drafts_replace_their_run_only(spark, tmp_path):
    """Each run is a partition of its own: saving one again leaves the others."""
    drafts = files.load_drafts(spark, str(Path(__file__).parent / "data/uploads")).cache()
    files.save_draft(drafts, str(tmp_path / "d"))
    files.save_draft(drafts.where("run_id like '%aa11'").withColumn("type", F.lit("sale")), str(tmp_path / "d"))
    again = spark.read.option("basePath", str(tmp_path / "d")).json(str(tmp_path / "d"))
    assert sorted((r["run_id"], r["type"]) for r in again.collect()) == [("20260201_080000_aa11", "sale"), ("20260202_090000_bb22", "sale"), ("20260203_100000_cc33", "purchase")]
    files.save_meta(drafts.select("run_id", "created_at"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{no")
    assert files.read_json(spark, str(tmp_path / "a.json"), "x int").first()["x"] == 1
    assert files.read_json(spark, str(tmp_path / "b.json"), "x int", strict=False).first()["x"] is None
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, str(tmp_path / "b.json"), "x int").collect()
    assert files.read_text(spark, str(tmp_path / "a.json")).first()["content"] == '{"x": 1}'


def test_written_batch(spark, batch, tmp_path):
    """Lines name the id of their header, ids go on from the last one, and what is written can be read again."""
    none = spark.createDataFrame([], "id long, entity string"), spark.createDataFrame([], "id long, code string")
    out = ledger.import_batch(*batch, *none, "purchase", F.lit("2026-01-15 10:20:30").cast("timestamp"), last_id=40)
    ledger.write_batch(out, str(tmp_path / "b"))
    heads, lines = (spark.read.parquet(str(tmp_path / "b" / n)) for n in ("headers", "lines"))
    assert sorted(r["id"] for r in heads.collect()) == [41, 42, 43] and lines.join(heads, lines["purchase_id"] == heads["id"]).count() == 3
    failed = spark.read.option("header", True).csv(str(tmp_path / "b/failed"))
    assert failed.columns == ["source_file", "name", "declared_total", "reason"] and failed.count() == 3
    assert (tmp_path / "b/_whole").exists()


def test_numbering_by_ranges(spark):
    """Ids follow the whole order over any ranges, with ties and text as the order's first column too."""
    rows = spark.range(5000).selectExpr("id * 7919 % 1000 as a", "id as b", "cast(id as string) as c").repartition(5)
    top = spark.range(1).selectExpr("100L as t")
    for order in (["a", "b"], ["c"]):
        got = ledger.numbered(rows, order, top).toPandas().sort_values(order)
        assert got.id.tolist() == list(range(101, 5101))


def test_large_sums(spark):
    assert spark.createDataFrame([(1e15,), (0.1,), (2e15,)], "x double").agg(ledger.exact_sum(F.col("x"))).first()[0] == 3e15 + 0.1
