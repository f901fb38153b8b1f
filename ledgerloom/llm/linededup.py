"""Incremental line dedup: sharded cuckoo filters in front of exact reference counts.

An index is three written tables. Postings hold a row for each document and line key long enough.
Reference counts hold, for each key, in how many documents it is and the largest doc_id among them.
Cuckoo filters hold the fingerprints of the keys that are duplicates, one row a shard of key hashes. Inserting
documents adds signed deltas to the counts, and the keys that they make duplicates to the filters;
deleting them subtracts the same deltas, looks the largest doc_id up again where it has gone, and takes the keys that
are duplicates no more out of the filters. So every insertion is reversible, nothing is counted anew, and counts are
never guessed.

A line goes if its key passes its shard's filter and the exact counts confirm it. Filters all have one
shape (``BUCKETS`` x ``SLOTS`` fingerprints, a few KB) and their number grows with the keys, so postings meet them in an
equi-join by shard that the planner makes a broadcast only under its own size limit, and the probe is
an expression. A key that finds no place in its filter's buckets is kept whole in ``spill``.

Edge cases: a null or empty text is one empty line. A null doc_id is one document, never the largest.
Repeated rows count as one document by doc_id; a document inserted twice counts once. Lines are split at \\n only; keys
are the line stripped of ASCII white space with A-Z lower-cased. Extra columns pass through untouched, whatever
their names; columns called n_lines and n_dropped are replaced. Texts of any length are split whole; nothing is gathered
by key, and by document only the numbers of dropped lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, fresh

MIN_CHARS = 40
MIN_DOCS = 5
SLOTS = 4
#: Buckets of a filter, a power of two.
BUCKETS = 256
#: Keys of a filter on average when filters are laid out, and the most before they are laid out anew.
SHARD_KEYS, MOST_KEYS = 500, 800
MAX_KICKS = 200
_STRIP = SPACE_CHARS.encode()
#: Fixed value: spreads a fingerprint over the buckets.
_SPREAD = 1540483477


class CuckooFilter:
    """Partial-key cuckoo filter of one shard: 4 slots a bucket, 16-bit fingerprints, and whole keys that found no place.

    Keys are signed 64-bit hashes: the lowest bits give the first bucket, the highest 16 the fingerprint.
    """

    def __init__(self, raw: bytes | None = None, spill: list[int] | None = None, buckets: int = BUCKETS) -> None:
        flat = np.zeros(buckets * SLOTS, np.uint16) if raw is None else np.frombuffer(raw, ">u2")
        self.slots = flat.tolist()
        self.mask = len(self.slots) // SLOTS - 1
        self.spill = list(spill or ())

    def places(self, key: int) -> tuple[int, int, int]:
        """(fingerprint, first bucket, second bucket)."""
        fp = (key >> 48) & 0xFFFF or 1
        a = key & self.mask
        return fp, a, self.other(a, fp)

    def other(self, bucket: int, fp: int) -> int:
        return (bucket ^ ((fp * _SPREAD) >> 7)) & self.mask

    def contains(self, key: int) -> bool:
        fp, a, b = self.places(key)
        return fp in self.slots[a * SLOTS : a * SLOTS + SLOTS] or fp in self.slots[b * SLOTS : b * SLOTS + SLOTS] or key in self.spill

    def _put(self, bucket: int, fp: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = fp
                return True
        return False

    def insert(self, key: int) -> None:
        fp, a, b = self.places(key)
        if self._put(a, fp) or self._put(b, fp):
            return
        undo, at = [], a
        for kick in range(MAX_KICKS):
            i = at * SLOTS + (kick * 7 + fp) % SLOTS
            undo.append((i, self.slots[i]))
            fp, self.slots[i] = self.slots[i], fp
            at = self.other(at, fp)
            if self._put(at, fp):
                return
        for i, old in reversed(undo):
            self.slots[i] = old
        self.spill.append(key)

    def delete(self, key: int) -> None:
        """Removes a key that has been inserted."""
        if key in self.spill:
            self.spill.remove(key)
            return
        fp, a, b = self.places(key)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == fp:
                    self.slots[i] = 0
                    return

    def to_bytes(self) -> bytes:
        return np.array(self.slots, ">u2").tobytes()


def passes(key: Column, table: Column, spill: Column) -> Column:
    """``CuckooFilter.contains`` as an expression over a filter's row."""
    fp = F.shiftrightunsigned(key, 48)
    fp = F.when(fp == 0, F.lit(1).cast("long")).otherwise(fp)
    a = key.bitwiseAND(F.lit(BUCKETS - 1))
    b = a.bitwiseXOR(F.shiftright(fp * F.lit(_SPREAD), 7)).bitwiseAND(F.lit(BUCKETS - 1))
    print_ = F.lpad(F.hex(fp), 4, "0")
    held = lambda bucket: F.array(*(F.hex(F.substring(table, (bucket * (2 * SLOTS) + 2 * i + 1).cast("int"), F.lit(2))) for i in range(SLOTS)))
    return F.array_contains(held(a), print_) | F.array_contains(held(b), print_) | F.array_contains(spill, key)


def line_keys(min_chars: int):
    """mapInArrow over (doc_id, uid, text): (doc_id, uid, pos, h1, h2), a row for each line of enough characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, hashes = [], [], []
            texts = batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                raw = texts[i].as_py() or b""
                for k, line in enumerate(raw.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(_STRIP).lower()
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
                        continue
                    owner.append(i)
                    pos.append(k)
                    hashes.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("uid").take(at), pa.array(pos, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["doc_id", "uid", "pos", "h1", "h2"],
            )

    return run


def with_uid(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``uid``, which tells rows apart unless both are equal."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))


def changed_filters(keys: list, filters: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard's filter with its signed changes (key, sign) carried out; a shard holds a few hundred keys."""
    old = filters.to_pylist()
    f = CuckooFilter(old[0]["filter"], old[0]["spill"]) if old else CuckooFilter()
    n = old[0]["n"] if old else 0
    key, sign = (changes.column(c).to_pylist() for c in ("key", "sign"))
    for k in (k for k, s in zip(key, sign, strict=True) if s < 0):
        f.delete(k)
    for k in (k for k, s in zip(key, sign, strict=True) if s > 0):
        f.insert(k)
    shard = old[0]["shard"] if old else keys[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary()), "spill": pa.array([f.spill], pa.list_(pa.int64())), "n": pa.array([n + sum(sign)], pa.int64())})


FILTERS = "shard long, filter binary, spill array<bigint>, n long"


class LineIndex:
    """Postings, exact reference counts and cuckoo filters of inserted documents; every change is reversible."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> None:
        self.postings, self.counts, self.filters, self.shards = postings, counts, filters, shards
        self.min_docs, self.min_chars = min_docs, min_chars

    @staticmethod
    def posted(docs: DataFrame, min_chars: int) -> DataFrame:
        """The postings of some documents, as a table: doc_id, uid, pos, h1, h2."""
        kind = dict(docs.dtypes)["doc_id"]
        rows = with_uid(docs).select("doc_id", "uid", "text")
        return cut(rows.mapInArrow(line_keys(min_chars), f"doc_id {kind}, uid long, pos int, h1 long, h2 long"), "postings")

    @staticmethod
    def counted(postings: DataFrame) -> DataFrame:
        """h1, h2, n_docs, last of the postings' keys; both steps are combined before their shuffle."""
        each = postings.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        return each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        """The index of some documents: nothing stood before, so every count is its own delta."""
        postings = cls.posted(docs, min_chars)
        return cls.laid_out(postings, cut(cls.counted(postings), "counts"), min_docs, min_chars)

    @classmethod
    def laid_out(cls, postings: DataFrame, counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        """An index with its filters built from the counts, in as many shards as the duplicates ask for."""
        known = counts.where(F.col("n_docs") >= min_docs)
        shards = max(1, -(-known.count() // SHARD_KEYS))
        none = postings.sparkSession.createDataFrame([], FILTERS)
        changes = known.select("h1", "h2", F.lit(1).alias("sign"))
        return cls(postings, counts, cls.changed(none, changes, shards), shards, min_docs, min_chars)

    @staticmethod
    def changed(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
        """Filters after signed changes (h1, h2, sign); shards without a change stay as they are."""
        signed = changes.select(F.pmod("h1", F.lit(shards)).alias("shard"), F.col("h2").alias("key"), "sign")
        return cut(filters.groupBy("shard").cogroup(signed.groupBy("shard")).applyInArrow(changed_filters, FILTERS), "filters")

    def duplicates(self) -> DataFrame:
        """The references of keys found in enough documents: h1, h2, n_docs, last."""
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _after(self, postings: DataFrame, counts: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with new postings and counts; ``touched`` (h1, h2, was, now) are the counts that changed."""
        dup = lambda c: (F.coalesce(F.col(c), F.lit(0)) >= self.min_docs).cast("int")
        changes = touched.select("h1", "h2", (dup("now") - dup("was")).alias("sign")).where("sign <> 0")
        filters = self.changed(self.filters, changes, self.shards)
        if (filters.agg(F.max("n")).first()[0] or 0) > MOST_KEYS:
            return self.laid_out(postings, counts, self.min_docs, self.min_chars)
        return LineIndex(postings, counts, filters, self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with a batch of documents; what it holds of them already changes nothing."""
        new = self.posted(docs, self.min_chars)
        held = self.postings.select("h1", "h2", F.col("doc_id").alias("d")).distinct()
        key = ["h1", "h2"]
        fresh_ = new.select(*key, "doc_id").distinct().alias("a")
        fresh_ = fresh_.join(held.alias("b"), F.expr("a.h1 = b.h1 and a.h2 = b.h2 and a.doc_id <=> b.d"), "left_anti")
        delta = cut(fresh_.groupBy(*key).agg(F.count(F.lit(1)).alias("d"), F.max("doc_id").alias("top")), "delta")
        both = self.counts.join(delta, key, "full")
        now = F.coalesce("n_docs", F.lit(0)) + F.coalesce("d", F.lit(0))
        counts = cut(both.select(*key, now.alias("n_docs"), F.greatest("last", "top").alias("last")), "counts")
        touched = delta.join(self.counts, key, "left").select(*key, F.col("n_docs").alias("was"), now.alias("now"))
        postings = cut(self.postings.unionByName(new).dropDuplicates(["h1", "h2", "doc_id", "uid", "pos"]), "postings")
        return self._after(postings, counts, touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without some documents (column doc_id): exactly as if they had never been inserted."""
        gone = cut(doc_ids.select(F.col("doc_id").alias("gone")).distinct(), "gone")
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        key = ["h1", "h2"]
        left = cut(self.postings.join(gone, same, "left_anti"), "postings")
        delta = self.postings.join(gone, same, "left_semi").select(*key, "doc_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("d"))
        delta = cut(delta, "delta")
        now = F.col("n_docs") - F.col("d")
        touched = cut(self.counts.join(delta, key).select(*key, F.col("n_docs").alias("was"), now.alias("now")), "touched")
        # The largest doc_id can only be looked up again, and only for keys that lost documents.
        again = left.join(touched.where("now > 0").select(*key), key, "left_semi").groupBy(*key).agg(F.max("doc_id").alias("last"))
        stay = self.counts.join(touched.select(*key), key, "left_anti").select(*key, "n_docs", "last")
        counts = stay.unionByName(touched.where("now > 0").join(again, key).select(*key, F.col("now").alias("n_docs"), "last"))
        return self._after(left, cut(counts, "counts"), touched)

    def candidates(self) -> DataFrame:
        """Postings whose keys pass their shard's filter."""
        probe = self.filters.select("shard", "filter", "spill")
        hits = self.postings.withColumn("shard", F.pmod("h1", F.lit(self.shards))).join(probe, "shard")
        return hits.where(passes(F.col("h2"), F.col("filter"), F.col("spill"))).select("doc_id", "uid", "pos", "h1", "h2")

    def dropped(self) -> DataFrame:
        """doc_id, uid, drops (numbers of the lines that go, from 0)."""
        hits = self.candidates().join(self.duplicates(), ["h1", "h2"]).where("doc_id is null or doc_id <> last")
        return hits.groupBy("doc_id", "uid").agg(F.collect_set("pos").alias("drops"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, index: LineIndex | None = None) -> DataFrame:
    """docs with duplicate lines removed from ``text``, plus n_lines (before) and n_dropped.

    Columns of docs named like the added ones are replaced.
    """
    index = index or LineIndex.of(docs, min_docs, min_chars)
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    d, u, drops, uid = (fresh(docs.columns, n) for n in ("_d", "_u", "_drops", "_uid"))
    gone = index.dropped().select(F.col("doc_id").alias(d), F.col("uid").alias(u), F.col("drops").alias(drops))
    rows = docs.select(*keep, F.xxhash64("doc_id", "text").alias(uid))
    out = rows.join(gone, (F.col(uid) == F.col(u)) & F.col("doc_id").eqNullSafe(F.col(d)), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    # The lines are an array's one element, so that the loop over those that stay sees a value and not the splitting.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(drops))
    kept = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n")), 0)
    n = F.when(F.col(drops).isNull(), F.lit(0)).otherwise(F.size(drops)).cast("long")
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(kept)
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": n, "text": text}).select(*keep, "n_lines", "n_dropped")


ORACLE = """
WITH lines AS (
  SELECT doc_id, rowid_ AS r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, rowid_, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS rowid_, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), dup AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (d.key IS NOT NULL AND l.doc_id <> d.last) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.key IS NULL OR l.doc_id = d.last), '')) AS kept_sha256
FROM lines l LEFT JOIN dup d ON l.key = d.key GROUP BY l.doc_id, l.r
"""
