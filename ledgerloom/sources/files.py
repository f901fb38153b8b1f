"""Sources and run storage: folders, ZIP archives, drafts, run listing; all read by Spark's own readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import format_bytes

EXTENSIONS = ("json", "md")
#: Base names that are skipped.
IGNORED = (r"^\.", r"^__", r"\.pyc$", r"(?i)^thumbs\.db$", r"(?i)^desktop\.ini$", r"(?i)^\.ds_store$")
SUFFIX = r"_(res|output|result|parsed|ocr|p\d+)$"
RUN_LIMIT = 50
#: Upload error codes and what they mean.
UPLOAD_ERRORS = {1: "file exceeds the server limit", 2: "file exceeds the form limit", 3: "file was only partly uploaded", 4: "no file was uploaded", 6: "no temporary folder", 7: "cannot write to disk", 8: "stopped by an extension"}

_INVOICE = "struct<source_file:string,format_detected:string,supplier_name:string,customer_name:string,invoice_date:string,invoice_number:string,declared_total:double,calc_total:double,currency:string,items:array<struct<code:string,name:string,description:string,qty:double,unit:string,unit_price:double,total:double,metadata:string>>>"
DRAFT = f"run_id string, type string, created_at string, source struct<upload_type:string,zip_name:string,json_count:int,file_count:int,file_summary:struct<total_files:int,by_extension:map<string,int>,total_size:bigint,total_size_human:string>>, parser struct<id:string,name:string,confidence:double>, invoices array<{_INVOICE}>"


def base_name(name: Column) -> Column:
    """The name without extension and without one page or result suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), SUFFIX, "")


def wanted(name: Column, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> Column:
    keep = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions)
    for pattern in ignored:
        keep = keep & ~name.rlike(pattern)
    return keep


def described(raw: DataFrame, root: str, run_id: str) -> DataFrame:
    """run_id, pos (by name, bytewise), path, name, ext, size, relative_path, base_name, content (text)."""
    path = F.regexp_replace("path", "^file:/*", "/")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    out = raw.select(F.lit(run_id).alias("run_id"), path.alias("path"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    out = out.withColumn("relative_path", F.regexp_replace("path", "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/")) + "/", "")).withColumn("base_name", base_name(F.col("name")))
    # Only names are put in order; contents stay where they are read.
    order = out.select("path", (F.row_number().over(Window.orderBy("name", "path")) - 1).cast("int").alias("pos"))
    return out.join(order, "path").select("run_id", "pos", *(c for c in out.columns if c != "run_id"))


def scan(spark: SparkSession, folder: str, run_id: str = "run", extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The files of a folder, at any depth, of wanted extensions."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return described(raw.where(wanted(F.regexp_extract("path", r"([^/]*)$", 1), extensions, ignored)), folder, run_id)


def scan_zip(spark: SparkSession, path: str, run_id: str = "run", extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The same of the members of ZIP archives; one archive is unpacked by one task, as a stream of members."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,ZIP}").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pa.RecordBatch.from_pydict({"path": [f"{where}/{m.filename}"], "length": [m.file_size], "content": [z.read(m)]})

    members = raw.select("path", "content").mapInArrow(run, "path string, length long, content binary")
    return described(members.where(wanted(F.regexp_extract("path", r"([^/]*)$", 1), extensions)), path, run_id)


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON documents of one object each: strict readers fail on one that is none, lenient ones give a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and content of text files, each whole."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def ingest_upload(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> tuple[DataFrame, DataFrame]:
    """(the files that arrived and are wanted; name and message of those whose upload failed), of rows with name and error."""
    return files.where((F.col("error") == 0) & wanted(F.col("name"), extensions, ignored)).drop("error"), upload_errors(files)


def save_meta(meta: DataFrame, uploads: str) -> None:
    """Replaces the stored raw metadata (run_id and any columns) of the runs in ``meta``, a partition each."""
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(uploads)


def upload_errors(files: DataFrame) -> DataFrame:
    """name and message of files whose upload (column error) failed."""
    text = F.lit("unknown upload error")
    for code, message in UPLOAD_ERRORS.items():
        text = F.when(F.col("error") == code, message).otherwise(text)
    return files.where("error <> 0").select("name", text.alias("message"))


def group_by_base(files: DataFrame) -> DataFrame:
    """run_id, base_name, ext, name: the last file of each base and extension."""
    return files.groupBy("run_id", "base_name", "ext").agg(F.max_by("name", "pos").alias("name"))


def summarize(files: DataFrame) -> DataFrame:
    """run_id, total_files, total_size, total_size_human, by_extension."""
    per = files.groupBy("run_id", "ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    out = per.groupBy("run_id").agg(F.sum("n").alias("total_files"), F.sum("size").alias("total_size"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n")))).alias("by_extension"))
    return out.withColumn("total_size_human", format_bytes(F.col("total_size")))


def load_drafts(spark: SparkSession, uploads: str) -> DataFrame:
    """Stored drafts of any generation, by an explicit schema; what a file lacks is null."""
    return spark.read.schema(DRAFT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "draft.json").json(uploads)


def save_draft(draft: DataFrame, uploads: str) -> None:
    """Replaces the stored drafts of the runs in ``draft``, a partition each."""
    draft.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(uploads)


def list_runs(runs: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """The newest runs by name."""
    real = F.col("run_id").startswith("20") & ~F.col("run_id").rlike("_(files|scan|unzipped)")
    return runs.where(real).orderBy(F.desc("run_id")).limit(limit)


def delete_runs(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """runs without those named in ``gone`` (run_id), and without their side folders."""
    base = F.regexp_replace("run_id", "_(files|scan|unzipped)$", "")
    return runs.withColumn("_base", base).join(gone.select(F.col("run_id").alias("_gone")).distinct(), F.col("_base") == F.col("_gone"), "left_anti").drop("_base")
