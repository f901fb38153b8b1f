"""Folder ingest as a stream: what is there now, or whatever arrives, through the same batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import EXTENSIONS, wanted

RAW = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", True).load(folder)
    return raw.where(wanted(F.regexp_extract("path", r"([^/]*)$", 1), extensions))


def ingest(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``each`` once and ends when all present files are done."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Rows of arriving Parquet files, counted by the caller's grouping."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
