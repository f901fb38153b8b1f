"""Shared helpers: the cluster's shared folder, lineage cuts, Arrow string buffers, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same six characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes of rows that go to a Python worker at a time, where the session doesn't say otherwise.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't make large ones; a session's own setting stays."""
    if not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all runs in one process (tests)."""
    bounded_batches(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = getattr(spark, "_ledgerloom_dir", None)
        if own is None:
            own = spark._ledgerloom_dir = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        conf = own
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    _cuts.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_cuts: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes every table that ``cut`` has written in this process, once no result that reads them is needed; gives their number."""
    jvm, n = spark.sparkContext._jvm, len(_cuts)
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called like it in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Short rows (a few numbers each) that may be handed to every task.
HANDED_OUT_ROWS = 500_000


def handed_out(df: DataFrame, rows: int = HANDED_OUT_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcast while it is known to have at most ``rows``.

    Beyond that it is left as it is: the join then shuffles both sides, with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_by_hash(rows: DataFrame, n: int, most: int, *key: str) -> DataFrame:
    """Of ``n`` rows at most ``most``, the first by hash of the key columns, in that order.

    Rows are thinned by the same hash before they are put in order, so that partitions send about ``most`` rows in all, however many there are.
    """
    place = F.xxhash64(*key)
    if n > most:
        rows = rows.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * most / n + 100 / n)))
        place = F.pmod(place, F.lit(1 << 30))
    return rows.orderBy(place, *key).limit(most)


def null_rank(c: Column) -> Column:
    """0 for a value, 1 for null: sort key that puts nulls last."""
    return F.when(c.isNull(), 1).otherwise(0)


def utf8_batches(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as (first row, row count, bytes, offsets from 0).

    A run holds at most ``max_bytes``, or one row if that row is longer. Nulls are empty.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


#: Edges (16 bytes each) that one task may hold to join them up in memory.
SMALL_EDGES = 1_000_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of an edge list, in memory."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        while True:  # every label points at a label: follow to the end
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def edge_mark(edges: DataFrame) -> tuple:
    """Count and exact sum of hashes of distinct edges: the same however rows are ordered and dealt."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(19,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 40, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components: (node, component), the smallest node reachable, for nodes with an edge to another.

    ``edges`` has bigint columns u, v. Distinct edges up to ``small`` (a fixed bound on memory) are
    joined up by one executor task; more of them by alternating large-star and small-star rounds, each a
    grouped minimum (combined before the shuffle) and an equi-join that adaptive execution may split,
    ending in a table in the shared folder. Both give the same rows. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if e.limit(small + 1).count() <= small:
        return cut(e.coalesce(1).mapInArrow(_joined_up, "node long, component long"), "components")

    before = edge_mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()  # a > b always
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low2, "a")
        e = near.select(F.col("m").alias("u"), F.col("b").alias("v")).union(near.select(F.col("m").alias("u"), F.col("a").alias("v")))
        e = cut(e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        after = edge_mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", F.col("u").alias("v")).distinct())


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, low = labels(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["node", "component"])
