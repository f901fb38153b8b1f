"""MinHash near-dedup on an LSH forest.

1. Every text becomes its shingle set, the set's identity (two 64-bit sums and its size) and
   ``TREES`` x ``DEPTH`` minhashes. Texts with equal sets are one class, represented by its smallest
   doc_id, so copies never multiply.
2. The forest: tree t orders the representatives by its own ``DEPTH`` minhashes, and a document's candidates are the
   neighbours around it whose longest common prefix is ``LEAST_DEPTH`` or more. Such a run of the order is a
   region. Regions are dealt out by that prefix and arrive sorted by their order, so runs are told by the prefixes of neighbours.
   All pairs of a region are compared by the share of equal minhashes, and only a spanning star of those within reach of the
   threshold (four standard errors) leaves the task. How regions are cut adapts to their density: those over ``REGION``
   are split into blocks, and every pair of blocks is a task's, so a dense region is compared as wholly as a sparse one.
3. Components of these candidate links are clusters; a true link lies inside one cluster, and is confirmed on full sets
   by counting common shingles. A cluster of one block (``BLOCK`` texts, ``BLOCK_SHINGLES`` shingles) is
   compared pair by pair. In a larger one every text meets ``HUBS`` of them first; what the links found join to the largest
   component is settled, as links among it can join nothing more. Only what stays open then meets the whole cluster, by pairs of blocks.
4. Components of the confirmed links are the result.

A pair at the threshold is missed if all trees part it above LEAST_DEPTH: (1 - 0.85**4)**16 is under
1e-5 (at 0.8 it is 2e-4), however many share its regions. Work inside one region, and among the open texts of a cluster, is
quadratic in distinct texts, rows are not.

Edge cases: null, empty and blank texts have an empty set and link with nothing. A null doc_id takes
no part: its component is null and it is kept. Rows that repeat a doc_id are one document: the links of all
of them are its own, and all get its component. Ties need no rule, as components don't depend on order. Extra
columns are ignored, whatever their names. Empty tables give an empty result. A doc_id that is no integer is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import components, cut, fresh, handed_out, one_array, utf8_batches
from .shingles import mix, shingle_sets

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
REGION = 2048
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
HUBS = 8
BLOCK_BYTES = 1 << 19
COLUMNS = 4096


def hashers() -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (draw[: TREES * DEPTH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[TREES * DEPTH :] >> np.uint64(32)).astype(np.uint32)


def minhashes(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[row, TREES x DEPTH] of rows whose sets follow one another and are not empty."""
    factor, offset = hashers()
    x = (sets >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), len(factor)), np.uint32)
    for i in range(len(factor)):
        v = (x ^ offset[i]) * factor[i]
        out[:, i] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), starts)
    return out


def signatures(k: int) -> Callable:
    """mapInArrow over (doc_id, text): doc_id, n_shingles, s1, s2, signature (big-endian minhashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in utf8_batches(one_array(batch.column("text")), BLOCK_BYTES):
                sets, sizes = shingle_sets(data, offsets, k)
                full = np.flatnonzero(sizes)
                s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
                sig: list[bytes | None] = [None] * n
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    s1[full] = np.add.reduceat(mix(sets), starts).view(np.int64)
                    s2[full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                    for r, m in zip(full, minhashes(sets, sizes[full]).astype(">u4"), strict=True):
                        sig[r] = m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(sizes), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "signature"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with equal values in the first ``keys`` columns, as lists of slices."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def stars(ids: np.ndarray, linked: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """(smallest id, other id) of each component of at least two; linked(i): the rows that row i links with."""
    n = len(ids)
    open_ = np.ones(n, bool)
    out = []
    for i in range(n):
        if not open_[i]:
            continue
        open_[i] = False
        todo, member = [i], [i]
        while todo:
            near = np.flatnonzero(linked(todo.pop()) & open_)
            open_[near] = False
            todo += near.tolist()
            member += near.tolist()
        if len(member) > 1:
            low = int(ids[member].min())
            out += [(low, int(ids[m])) for m in member if ids[m] != low]
    return out


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], schema=EDGE)


def region_links(least: float) -> Callable:
    """mapInArrow over (region, p, q, rep, sketch, order) dealt by (region, p, q) and sorted by these and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for parts in groups(batches, 3):
            ids = np.concatenate([p.column(3).to_numpy() for p in parts])
            sketch = np.frombuffer(b"".join(x for p in parts for x in p.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            order = np.frombuffer(b"".join(x for p in parts for x in p.column(5).to_pylist()), ">u4").reshape(len(ids), -1)
            common = np.cumprod(order[1:] == order[:-1], axis=1).sum(axis=1)  # longest common prefix with the neighbour
            ends = [0, *(np.flatnonzero(common < LEAST_DEPTH) + 1).tolist(), len(ids)]
            for a, b in pairwise(ends):
                near = sketch[a:b]
                edges += stars(ids[a:b], lambda i: (near == near[i]).mean(axis=1) >= least)  # noqa: B023
            if len(edges) > 50_000:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)

    return run


def common_counts(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[row, row]: the number of shingles in common."""
    n = len(sizes)
    rows = np.repeat(np.arange(n), sizes)
    _, ids, counts = np.unique(sets, return_inverse=True, return_counts=True)
    keep = counts[ids] > 1
    rows, ids = rows[keep], np.unique(ids[keep], return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        i, j = np.searchsorted(ids, [a, a + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[rows[i:j], ids[i:j] - a] = 1
        out += part @ part.T
    return out


def confirmed_links(k: int, percent: int) -> Callable:
    """mapInArrow over (cluster, p, q, asks, doc_id, text) dealt and sorted by (cluster, p, q); links have an end that asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for parts in groups(batches, 3):
            asks = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts])
            ids = np.concatenate([p.column(4).to_numpy() for p in parts])
            sets, sizes = [], []
            for p in parts:
                for _, _, data, offsets in utf8_batches(one_array(p.column(5)), BLOCK_BYTES):
                    s, n = shingle_sets(data, offsets, k)
                    sets.append(s)
                    sizes.append(n)
            size = np.concatenate(sizes)
            common = common_counts(np.concatenate(sets), size)
            union = size[:, None] + size[None, :] - common
            link = (100 * common >= percent * union) & (common > 0) & (asks[:, None] | asks[None, :])
            edges += stars(ids, lambda i: link[i])  # noqa: B023
            if len(edges) > 50_000:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)

    return run


def candidate_links(reps: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (u, v) of the forest over (rep, signature)."""
    hashes = TREES * DEPTH
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / hashes)
    each = reps.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    order = F.expr(f"substring(signature, t * {4 * DEPTH} + 1, {4 * DEPTH})")
    each = each.select("rep", order.alias("order"), F.xxhash64("t", F.expr(f"substring(signature, t * {4 * DEPTH} + 1, {4 * LEAST_DEPTH})")).alias("region"))
    sizes = each.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.when(F.col("n") > REGION, F.ceil(2 * F.col("n") / REGION)).otherwise(1).cast("int")
    near = cut(each.join(sizes.select("region", blocks.alias("blocks")), "region"), "regions")
    # The lowest byte of each minhash is enough to compare by: equal by chance in 1 of 256.
    sketch = F.unhex(F.regexp_replace(F.hex("signature"), "......(..)", "$1"))
    near = near.join(reps.select("rep", sketch.alias("sketch")), "rep")
    near = near.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.select("region", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "rep", "sketch", "order")
    near = near.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q", "order")
    return near.mapInArrow(region_links(least), "u long, v long")


def both_blocks(asking: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, p, q, asks, rep: every block p of members with every block q of asking ones, all of (cluster, rep, block, blocks)."""
    q = asking.groupBy("cluster").agg(F.max("blocks").alias("others"))
    a = members.join(q, "cluster").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    p = members.groupBy("cluster").agg(F.max("blocks").alias("others"))
    b = asking.join(p, "cluster").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    a = a.select("cluster", F.col("block").alias("p"), "q", F.lit(False).alias("asks"), "rep")
    return a.unionByName(b.select("cluster", "p", F.col("block").alias("q"), F.lit(True).alias("asks"), "rep"))


def confirmed(rows: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) among the texts of each (cluster, p, q, rep, asks); only those texts are shuffled."""
    places = handed_out(cut(placed, "placed"))
    texts = rows.join(places, rows["doc_id"] == places["rep"]).select("cluster", "p", "q", "asks", "doc_id", "text")
    texts = texts.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    return cut(texts.mapInArrow(confirmed_links(k, percent), "u long, v long"), "confirmed")


def cluster_links(rows: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that join up the true links of every cluster of (cluster, rep, n_shingles)."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = clusters.groupBy("cluster").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    members = cut(clusters.join(sizes, "cluster").select("cluster", "rep", "blocks", block), "members")
    zero = F.lit(0)
    small = members.where("blocks = 1").select("cluster", zero.alias("p"), zero.alias("q"), F.lit(True).alias("asks"), "rep")
    large = members.where("blocks > 1")
    hubs = large.groupBy("cluster", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(HUBS)).alias("h")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "rep"), "rep"))["rep"].alias("rep"))
    first = small.unionByName(both_blocks(hubs.select("cluster", "rep", zero.alias("block"), F.lit(1).alias("blocks")), large))
    links = confirmed(rows, first, k, percent)
    if not large.limit(1).count():
        return links
    # The component that most of a cluster has joined is settled; the rest meets every member.
    found = components(links).withColumnRenamed("node", "rep")
    now = cut(large.join(found, "rep", "left").select("cluster", "rep", "blocks", "block", F.coalesce("component", "rep").alias("component")), "joined")
    main = now.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    open_ = now.join(main, "cluster").where("component <> main").select("cluster", "rep")
    counts = open_.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("few"))
    shared = members.select("cluster", "rep", "blocks").join(open_, ["cluster", "rep"], "left_semi").join(counts, "cluster")
    fewer = F.greatest(F.lit(1), F.least(F.col("blocks"), F.ceil(1.5 * F.col("few")))).cast("int")  # no more than the cluster's, as long texts count there
    asking = cut(shared.withColumn("blocks", fewer).select("cluster", "rep", "blocks", block), "open")
    return links.unionByName(confirmed(rows, both_blocks(asking, large), k, percent))


def link(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer: components are named by the smallest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = cut(rows.mapInArrow(signatures(k), "doc_id long, n_shingles long, s1 long, s2 long, signature binary"), "signatures")
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    key = ["s1", "s2", "n_shingles"]
    classes = cut(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = full.alias("f").join(classes.alias("c"), F.expr("f.doc_id = c.rep and f.s1 = c.s1 and f.s2 = c.s2 and f.n_shingles = c.n_shingles"))
    reps = cut(reps.select("rep", "signature", "f.n_shingles").dropDuplicates(["rep", "n_shingles", "signature"]), "reps")
    clusters = components(candidate_links(reps, percent / 100)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = clusters.join(reps.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), "rep")
    links = cluster_links(rows, cut(clusters, "clusters"), k, percent)
    # A doc_id of several sets is a link between their classes.
    several = sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").select("doc_id")
    several = cut(several, "several")
    own = full.join(handed_out(several), "doc_id").join(classes, key).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    found = components(links.unionByName(own))
    named = classes.join(found, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("s1").alias("a"), F.col("s2").alias("b"), F.col("n_shingles").alias("n"), "rep", F.coalesce("component", "rep").alias("component"), "copies")
    # Only classes of copies or with links need naming; a hot class is many rows of one key, which adaptive execution splits.
    named = named.where("copies > 1 or component <> rep")
    named_ids = several.join(found, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("d"), F.coalesce("component", "doc_id").alias("by_id"))
    out = sigs.join(named, (F.col("s1") == F.col("a")) & (F.col("s2") == F.col("b")) & (F.col("n_shingles") == F.col("n")) & F.col("doc_id").isNotNull(), "left")
    out = out.join(handed_out(cut(named_ids, "named")), F.col("doc_id") == F.col("d"), "left")
    component = F.coalesce("by_id", F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (of rows that repeat it, the first by hash of the text)."""
    linked = cut(link(docs, k, percent), "linked")
    id_, n = fresh(docs.columns, "_id"), fresh(docs.columns, "_n")
    gone = handed_out(cut(linked.where("not kept").select(F.col("doc_id").alias(id_)).distinct(), "gone"))
    own = docs["doc_id"].cast("long")
    rest = docs.join(gone, own == gone[id_], "left_anti")
    again = cut(linked.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_)).count().where("count > 1").select(id_), "again")
    if not again.limit(1).count():
        return rest
    again = handed_out(again)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = rest.join(again, own == again[id_], "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    return rest.join(again, own == again[id_], "left_anti").unionByName(one)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT b.y, r.low FROM reach r JOIN both_ b ON b.x = r.node)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.low) AS component_id, d.doc_id = min(r.low) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""
