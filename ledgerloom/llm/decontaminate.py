"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Test items are the indexed documents, training passages the queries. An item's BM25 weights are
divided by the item's own score, so a score is the share of the item's BM25 mass that a passage
covers, and one threshold serves all items. All items at or above it are retrieved, not a top k.

The index is posting lists sorted by item, with each term's largest weight and its largest weight in every block of
``BLOCK_ITEMS`` items. Whether the largest weights of a passage's terms reach the threshold at all, and in which blocks their
block maxima do, is told for a batch of passages at once. A passage's cursors then skip from one block that can reach
the threshold to the next; within a block WAND takes them in order of their items until the maxima reach
the threshold, which names the pivot item: cursors behind it skip to it, and an item that all of them stand on is scored.

Passages are windows of twice the longest item, half overlapping, so every item fits into one whole.
A retrieved item is a leak when its 5-word shingles are in the passage to ``OVERLAP`` or more and both
of its parts are there: the question (all sentences but the last) by its shingles and the answer (the
last sentence) by its words, each to ``PART`` or more. Items of one sentence are question only.

Document frequencies, the mean length and the window are those of all items, so results don't depend on how the index is cut.
It is cut into shards of ``SHARD_ITEMS`` items, each a broadcast of bounded size built alone on the driver; the
corpus is read and split into words once, and a task goes through the shards one by one for every batch.

Words are runs of letters and digits of the lower-cased text (non-ASCII characters are letters; items and passages are
lower-cased by the same function). Edge cases: texts that are null or without words hold nothing, items like that are never found; items
shorter than a shingle are one shingle. Repeated rows are each judged; null ids are kept as
null. Extra columns pass through ``clean`` untouched, whatever their names. Empty tables: nothing is contaminated.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, handed_out, one_array, utf8_batches
from .shingles import mix, word_hashes

SHARD_ITEMS = 2000
BLOCK_ITEMS = 4
THRESHOLD = 0.5
SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
K1, B = 1.2, 0.75
LEAST_STRIDE = 32
BLOCK_BYTES = 1 << 19
#: Passages whose bounds are told at once, and what rounding may take off a bound.
BOUND_PASSAGES = 1024
SLACK = 1e-9

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_SENTENCE = regex.compile(r"(?<=[.!?])\s+")


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashed words, words per row) of runs of texts; items and passages both go through here."""
    for first, _, data, offsets in utf8_batches(pc.utf8_lower(texts), BLOCK_BYTES):
        yield first, *word_hashes(data, offsets, _GAP)


def hashed_words(text: str) -> np.ndarray:
    return next(words_of(pa.array([text], pa.string())))[1]


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[j : j + len(out)])
    return out


def share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


def parts(item_id: int, text: str) -> Item:
    sentences = [s for s in _SENTENCE.split(text) if len(hashed_words(s))]
    last = hashed_words(sentences[-1]) if len(sentences) > 1 else np.zeros(0, np.uint64)
    return Item(item_id, hashed_words(text), hashed_words(" ".join(sentences[:-1] if len(sentences) > 1 else sentences)), last)


@dataclass
class Statistics:
    """Of all items with words: their number, mean and largest length, and the document frequency of some words."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        each = [np.unique(i.words) for i in items if len(i.words)]
        words, df = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64),) * 2
        sizes = [len(i.words) for i in items if len(i.words)]
        return cls(len(sizes), float(np.mean(sizes)) if sizes else 1.0, max(sizes, default=0), dict(zip(words.tolist(), df.tolist(), strict=True)))


class Index:
    """One shard: posting lists by term (items ascending, weights), with maxima by term and by term and block."""

    def __init__(self, items: list[Item], stats: Statistics | None = None) -> None:
        self.items = sorted((i for i in items if len(i.words)), key=lambda i: i.item_id)
        stats = stats or Statistics.of(self.items)
        n = len(self.items)
        self.stride = max(LEAST_STRIDE, stats.longest)
        self.vocabulary = np.unique(np.concatenate([i.words for i in self.items])) if n else np.zeros(0, np.uint64)
        df = np.array([stats.df[w] for w in self.vocabulary.tolist()], np.float64)
        idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
        term, owner, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for c, i in enumerate(self.items):
            t, tf = np.unique(np.searchsorted(self.vocabulary, i.words), return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(i.words) / stats.mean))
            term.append(t)
            owner.append(np.full(len(t), c))
            weight.append(w / w.sum())
        term, owner, weight = np.concatenate(term), np.concatenate(owner), np.concatenate(weight)
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order], weight[order]
        width = len(self.vocabulary)
        self.start = np.searchsorted(term, np.arange(width + 1))
        self.block_count = -(-n // BLOCK_ITEMS)
        key = term * max(1, self.block_count) + self.owner // BLOCK_ITEMS
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block = self.owner[first] // BLOCK_ITEMS
        self.block_max = np.maximum.reduceat(self.weight, first) if len(key) else np.zeros(0)
        self.block_start = np.searchsorted(term[first], np.arange(width + 1))
        self.opened: dict[int, tuple[list[int], list[float], dict[int, float]]] = {}
        self.term_max = np.maximum.reduceat(self.weight, self.start[:-1]) if width else np.zeros(0)

    def reachable(self, term: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs, in order, whose block maxima reach the threshold; terms of all passages, one after another."""
        n = self.block_start[term + 1] - self.block_start[term]
        at = np.repeat(self.block_start[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(np.repeat(np.arange(len(size)), size), n) * self.block_count + self.block[at]
        bound = np.bincount(place, self.block_max[at], len(size) * self.block_count)
        return np.divmod(np.flatnonzero(bound >= threshold - SLACK), self.block_count)

    def postings(self, t: int) -> tuple[list[int], list[float], dict[int, float]]:
        """A term's items, weights and block maxima; kept once asked for."""
        if t not in self.opened:
            a, b, c, d = int(self.start[t]), int(self.start[t + 1]), int(self.block_start[t]), int(self.block_start[t + 1])
            self.opened[t] = self.owner[a:b].tolist(), self.weight[a:b].tolist(), dict(zip(self.block[c:d].tolist(), self.block_max[c:d].tolist(), strict=True))
        return self.opened[t]

    def wand(self, terms: list[int], blocks: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """(number of the item, score) of every item at the threshold, for one passage's terms and the blocks that can reach it."""
        lists = [self.postings(t) for t in terms]
        cursor = [0] * len(lists)
        for block in blocks:
            end = (block + 1) * BLOCK_ITEMS
            here = []
            for k, (items, _, most) in enumerate(lists):
                if block in most:  # cursors without an item in the block skip it
                    cursor[k] = bisect_left(items, block * BLOCK_ITEMS, cursor[k])
                    here.append((items[cursor[k]], k))
            while here:
                here.sort()
                bound, last = 0.0, -1
                for last, (_, k) in enumerate(here):  # noqa: B007
                    bound += lists[k][2][block]
                    if bound >= threshold - SLACK:
                        break
                else:
                    break
                pivot = here[last][0]
                if here[0][0] == pivot:
                    score = sum(lists[k][1][cursor[k]] for item, k in here if item == pivot)
                    if score >= threshold:
                        yield pivot, score
                    pivot += 1
                moved = []
                for item, k in here:
                    if item < pivot:
                        items = lists[k][0]
                        cursor[k] = bisect_left(items, pivot, cursor[k])
                        item = items[cursor[k]] if cursor[k] < len(items) else end
                    if item < end:
                        moved.append((item, k))
                here = moved

    def search(self, words: np.ndarray, per_row: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, Item, float]]:
        """(row, first word of the passage in the row, item, score) of every passage and item at the threshold."""
        if not len(self.items) or not len(words):
            return
        s = self.stride
        first = np.cumsum(per_row) - per_row
        passages = np.maximum(1, -(-per_row // s))
        base = np.cumsum(passages) - passages
        term = np.searchsorted(self.vocabulary, words)
        term[term == len(self.vocabulary)] = 0
        at = np.flatnonzero(self.vocabulary[term] == words)
        row = np.repeat(np.arange(len(per_row)), per_row)[at]
        j = (at - first[row]) // s
        width = len(self.vocabulary)
        term = term[at]
        here = (base[row] + j) * width + term
        keys = np.unique(np.concatenate([here, here[j > 0] - width]))
        if not len(keys):
            return
        passage, term = keys // width, keys % width
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(keys))
        live = np.add.reduceat(self.term_max[term], starts) >= threshold - SLACK
        starts, ends = starts[live], ends[live]
        for a in range(0, len(starts), BOUND_PASSAGES):
            sa, ea = starts[a : a + BOUND_PASSAGES], ends[a : a + BOUND_PASSAGES]
            size = ea - sa
            pick = np.repeat(sa - (np.cumsum(size) - size), size) + np.arange(size.sum())
            owner, block = self.reachable(term[pick], size, threshold)
            cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)] if len(owner) else []
            for c, d in pairwise(cuts):
                w = owner[c]
                p = int(passage[sa[w]])
                r = int(np.searchsorted(base, p, side="right")) - 1
                for i, score in self.wand(term[sa[w] : ea[w]].tolist(), block[c:d].tolist(), threshold):
                    yield r, (p - int(base[r])) * s, self.items[i], score

    def leaks(self, words: np.ndarray, per_row: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, item_id, overlap) of every retrieved item that is verified; best overlap per row and item."""
        first = np.cumsum(per_row) - per_row
        best: dict[tuple[int, int], float] = {}
        for r, start, item, _ in self.search(words, per_row):
            own = words[first[r] + start : first[r] + min(start + 2 * self.stride, int(per_row[r]))]
            # Items shorter than a shingle, and parts, are compared by shingles of their own length.
            grams = {k: shingles(own, k) for k in {min(SHINGLE, len(item.words)), min(SHINGLE, len(item.question))} if k}
            overlap = share(shingles(item.words), grams[min(SHINGLE, len(item.words))])
            if overlap >= OVERLAP and share(shingles(item.question), grams[min(SHINGLE, len(item.question))]) >= PART and share(item.answer, own) >= PART:
                best[r, item.item_id] = max(overlap, best.get((r, item.item_id), 0.0))
        yield from ((r, i, v) for (r, i), v in best.items())


def finder(shards: list[Broadcast]) -> object:
    """mapInArrow over (doc_id, uid, text): doc_id, uid, item_id, overlap of every leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = list(words_of(one_array(batch.column("text"))))
            at, items, overlaps = [], [], []
            for shard in shards:
                index = shard.value
                for first, words, per_row in split:
                    for r, i, v in index.leaks(words, per_row):
                        at.append(first + r)
                        items.append(i)
                        overlaps.append(v)
                if len(shards) > 1:  # one shard in memory at a time
                    del index
                    shard.__dict__.pop("_value", None)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("uid").take(rows), pa.array(items, pa.int64()), pa.array(overlaps, pa.float64())], names=["doc_id", "uid", "item_id", "overlap"])

    return run


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, shard, text): key, shard, length, word of every item's distinct words."""
    for batch in batches:
        for first, words, per_row in words_of(one_array(batch.column("text"))):
            row = np.repeat(np.arange(len(per_row)), per_row)
            order = np.lexsort((words, row))
            w, r = words[order], row[order]
            new = np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])) if len(w) else np.zeros(0, bool)
            w, r = w[new], r[new]
            at = pa.array(first + r)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("shard").take(at), pa.array(per_row[r].astype(np.int64)), pa.array(w.view(np.int64))], names=["key", "shard", "length", "word"])


def indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> Iterator[Index]:
    """The index, shard by shard, under the statistics of all items; the driver holds one shard at a time."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = cut(items.withColumn("key", F.xxhash64("item_id", "text")), "items")
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))
    terms = cut(items.select("key", "shard", "text").mapInArrow(item_terms, "key long, shard long, length long, word long"), "terms")
    n, mean, longest = terms.select("key", "length").distinct().agg(F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    df = terms.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for s in range(shards):
        own = terms.where(F.col("shard") == s).select("word").distinct().join(df, "word").collect()
        stats = Statistics(n, float(mean or 1.0), int(longest or 0), {r["word"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in own})
        yield Index([parts(r["item_id"], r["text"]) for r in items.where(F.col("shard") == s).collect()], stats)


def leaks(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, uid (of doc_id and text), item_id, overlap of every document and item it holds, as a table."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    shards = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes(benchmark, shard_items)]
    return cut(rows.mapInArrow(finder(shards), f"doc_id {kind}, uid long, item_id long, overlap double"), "leaks")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (array, ascending), overlap (best, 0 if none) of every row."""
    found = leaks(docs, benchmark).groupBy("uid", "doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("best"))
    found = found.select(F.col("uid").alias("u"), F.col("doc_id").alias("d"), "items", "best")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"))
    out = rows.join(found, (F.col("uid") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    d, u, uid = (fresh(docs.columns, n) for n in ("_d", "_u", "_uid"))
    gone = leaks(docs, benchmark).select(F.col("uid").alias(u), F.col("doc_id").alias(d)).distinct()
    gone = handed_out(cut(gone, "gone"))
    rows = docs.withColumn(uid, F.xxhash64("doc_id", "text"))
    return rows.join(gone, (F.col(uid) == F.col(u)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_anti").select(*docs.columns)
