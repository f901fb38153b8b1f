"""Language ID by multilingual mixture inference.

Training counts character n-grams (1 to 4 bytes of lower-cased UTF-8, words padded with a space) by
language, hashed to ``BUCKETS``, from a sample of labelled rows that is bounded per language. A
document is a bag of words, each word from one language: its log-likelihood under a language is the
sum over its n-grams. Expectation-maximisation estimates the document's language proportions from
these likelihoods, until they move by less than ``TOLERANCE``. Language sets are the likeliest 1, 2, 3, ... languages under the
mixture of all; the set of best penalised likelihood (BIC: half the log of the word count per language, times ``PENALTY``) is taken.
No number of languages is a limit: a language that explains less than a word can't pay for its penalty, so sets end there.

The score is the posterior of the predicted language, averaged over the words, under the document's proportions smoothed by one
word of every language: few words, or words that other languages explain as well, lower it.

Edge cases: text that is null or has no letter is ``und`` with score 0; with nothing to learn from,
so is every text. Rows with null text or language teach nothing. Repeated rows are each predicted; a null doc_id
is not held out. Extra columns are ignored. Any text length: words are streamed in blocks, of which a text is one at most.
The model is a table of 1 MB a language, so labels are taken to be languages, not free text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_array, utf8_batches

#: Labelled rows per language that the model is fitted on, in expectation (drawn by hash).
SAMPLE_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 4.0
#: EM ends when no proportion of a document moves by more in a round; the rounds are a guard that the tests never meet.
TOLERANCE, EM_ROUNDS = 1e-3, 500
BLOCK_BYTES = 1 << 19
UNKNOWN = "und"
#: A word's log-likelihoods differ by at most this between languages: one odd word decides nothing.
CLIP = 12.0

_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: all ASCII that is not a letter.
_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[65:91] = _GAP[97:123] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def grams(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-gram codes ending at every byte, for each order (-1: crosses a gap), and the gap mask.

    Every word counts with one space before it and one behind it.
    """
    low = _LOWER[data]
    gap = _GAP[low]
    low = np.where(gap, np.uint8(32), low).astype(np.uint32)
    out = []
    for order in ORDERS:
        code = low.copy()
        inside = np.ones(len(low), bool)
        for k in range(1, order):
            code[k:] += low[:-k] << np.uint32(8 * k) if k < 4 else 0
            inside[:k] = False
            if k < order - 1:
                inside[k:] &= ~gap[:-k]  # a gap only at the n-gram's first or last byte
        hashed = ((code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(16)).astype(np.int32)
        if order == 1:
            inside &= ~gap
        else:
            inside[order - 1 :] &= ~(gap[order - 1 :] & gap[: len(gap) - order + 1]) if len(gap) >= order else True
        hashed[~inside] = -1
        out.append(hashed)
    return out, gap


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each and one at the end, and the new row starts."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + rows + 1] = data
    return out, offsets[:-1] + np.arange(n)


def count_partial():
    """mapInArrow: n-gram counts of a partition, one row per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            for first, n, data, offsets in utf8_batches(batch.column("text"), BLOCK_BYTES):
                text, starts = padded(data, offsets)
                codes, _ = grams(text)
                ends = np.append(starts[1:], len(text))
                for i in range(n):
                    tally = counts.setdefault(labels[first + i], np.zeros((len(ORDERS), BUCKETS), np.int64))
                    for k, c in enumerate(codes):
                        own = c[starts[i] : ends[i]]
                        tally[k] += np.bincount(own[own >= 0], minlength=BUCKETS)
        for lang, tally in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "counts": pa.array([zlib.compress(tally.astype(np.int32).tobytes(), 1)], pa.binary())})

    return run


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages by code point, log-likelihoods [order, language, bucket]).

    The sample is drawn by a hash of the row, at a rate for each language that makes ``sample`` rows of it; the
    driver gets one count table per language and task, not texts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(ORDERS), 0, BUCKETS), np.float32)
    rate = F.lit(1.0)
    for lang, n in sizes.items():
        if n > sample:
            rate = F.when(F.col("lang") == lang, sample / n).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(draw < rate).select("lang", "text")
    counts = np.zeros((len(ORDERS), len(langs), BUCKETS), np.float64)
    # Repartitioned, not coalesced: the corpus is scanned by as many tasks as it has splits, and only the bounded sample moves.
    parts = rows.repartition(8).mapInArrow(count_partial(), "lang string, counts binary")
    for r in parts.toLocalIterator():
        counts[:, langs.index(r["lang"]), :] += np.frombuffer(zlib.decompress(r["counts"]), np.int32).reshape(len(ORDERS), BUCKETS)
    total = counts.sum(axis=2, keepdims=True)
    seen = (counts.sum(axis=1, keepdims=True) > 0).sum(axis=2, keepdims=True)
    return langs, np.log((counts + 0.5) / (total + 0.5 * np.maximum(seen, 1) + 1)).astype(np.float32)


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood [word, language] of the words of all rows, relative to each word's best, and words per row."""
    text, starts = padded(data, offsets)
    codes, gap = grams(text)
    begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    per_row = np.searchsorted(begin, np.append(starts[1:], len(text))) - np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros((0, table.shape[1]), np.float32), per_row
    bounds = np.append(begin, len(text))
    out = np.empty((len(begin), table.shape[1]), np.float32)
    for lang in range(table.shape[1]):
        score = np.zeros(len(text), np.float32)
        for k, c in enumerate(codes):
            score += np.append(table[k, lang], np.float32(0))[c]  # index -1 is the zero at the end
        out[:, lang] = np.add.reduceat(score, bounds[:-1])
    out -= out.max(axis=1, keepdims=True)
    np.maximum(out, -CLIP, out=out)
    return out, per_row


def mixture(weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """EM over documents at once, each until it settles: (proportions [doc, language], log-likelihood [doc]).

    weights: likelihood of each word [word, language]; allowed: the language set of each document.
    """
    pi = (allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    open_, at, w = np.arange(len(sizes)), starts, weights
    for _ in range(EM_ROUNDS):
        own = sizes[open_]
        joint = w * np.repeat(pi[open_], own, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(joint, at, axis=0) / own[:, None].astype(np.float32)
        moves = np.abs(new - pi[open_]).max(axis=1) > tolerance
        pi[open_] = new
        if not moves.any():
            break
        if moves.mean() < 0.7:
            w = w[np.repeat(moves, own)]
            open_ = open_[moves]
            at = np.cumsum(sizes[open_]) - sizes[open_]
    ll = np.add.reduceat(np.log(np.maximum((weights * np.repeat(pi, sizes, axis=0)).sum(axis=1), 1e-30)), starts)
    return pi, ll


def gain_bound(log_w: np.ndarray, best: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steep: float = 8.0) -> np.ndarray:
    """At most this can any mixture gain on the best single language, for each document.

    The log-likelihood is concave in the proportions, so the slopes at the single language bound the
    gain; words whose likelihood ratio is over ``steep`` count with the logarithm that they can gain at most.
    """
    ratio = np.exp(log_w - np.take_along_axis(log_w, np.repeat(best, sizes)[:, None], axis=1))
    top = ratio.max(axis=1)
    odd = top > steep
    slope = np.add.reduceat(np.where(odd[:, None], 0, ratio - 1), starts, axis=0).max(axis=1)
    return np.maximum(slope, 0) + np.add.reduceat(np.where(odd, np.log(top), 0), starts)


def infer(log_w: np.ndarray, per_row: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [row, language] under the language set of best penalised likelihood, posterior of the main one). Rows without words get zeros."""
    n_lang = log_w.shape[1]
    out, score = np.zeros((len(per_row), n_lang), np.float64), np.zeros(len(per_row))
    full = np.flatnonzero(per_row)
    if not len(full) or not n_lang:
        return out, score
    sizes = per_row[full]
    starts = np.cumsum(sizes) - sizes
    single = np.add.reduceat(log_w.astype(np.float64), starts, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(full), n_lang))
    chosen[np.arange(len(full)), best] = 1
    first = single.max(axis=1)
    value = first.copy()
    cost = penalty * 0.5 * np.log(sizes + 1.0)
    w = np.exp(log_w)
    open_ = np.flatnonzero(gain_bound(log_w, best, starts, sizes) > cost) if n_lang > 1 else np.zeros(0, int)
    if len(open_):
        rows, word = take(open_, starts, sizes)
        pi, _ = mixture(w[word], rows, sizes[open_], np.ones((len(open_), n_lang)))
        order = np.argsort(-pi, axis=1, kind="stable")
        worth = (pi * sizes[open_][:, None] >= 1).sum(axis=1)  # languages that explain a word at least
        for k in range(2, n_lang + 1):
            on = np.flatnonzero(worth >= k)
            if not len(on):
                break
            docs = open_[on]
            allowed = np.zeros((len(docs), n_lang))
            np.put_along_axis(allowed, order[on, :k], 1, axis=1)
            rows, word = take(docs, starts, sizes)
            pi, ll = mixture(w[word], rows, sizes[docs], allowed)
            better = ll - (k - 1) * cost[docs] > value[docs]
            win = docs[better]
            chosen[win], value[win] = pi[better], (ll - (k - 1) * cost[docs])[better]
    out[full] = chosen
    prior = (chosen * sizes[:, None] + 1) / (sizes[:, None] + n_lang)
    joint = w * np.repeat(prior, sizes, axis=0).astype(np.float32)
    main = np.take_along_axis(joint, np.repeat(chosen.argmax(axis=1), sizes)[:, None], axis=1)[:, 0] / np.maximum(joint.sum(axis=1), 1e-30)
    score[full] = np.add.reduceat(main, starts) / sizes
    return out, score


def take(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts among the taken words, word indices) of some documents."""
    own = sizes[docs]
    at = np.cumsum(own) - own
    return at, np.arange(own.sum()) + np.repeat(starts[docs] - at, own)


def predictor(langs: list[str], shared):
    """mapInArrow over (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            text = one_array(batch.column("text"))
            pred, score, mixes = [], [], []
            for first, n, data, offsets in utf8_batches(text, BLOCK_BYTES):
                log_w, per_row = word_likelihoods(data, offsets, table)
                pi, high = infer(log_w, per_row)
                top = pi.argmax(axis=1) if langs else np.zeros(n, int)
                for i in range(n):
                    if high[i] and not _LETTER.search(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")):
                        high[i] = 0
                pred.append(np.where(high > 0, names[top], UNKNOWN))
                score.append(np.clip(high, 0, 1))
                mixes += [{langs[k]: float(p[k]) for k in np.flatnonzero(p > 0)} for p in pi]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(pred) if pred else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array([list(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "proportions"],
            )

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its posterior), proportions (map) for every row of docs."""
    langs, table = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # languages x 1 MB: bounded by the label set
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(predictor(langs, shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: drops documents without a language (``und``) or without a main one (largest proportion under ``least``)."""
    names = [c for c in docs.columns]
    langs, table = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column("text"))
            ids = pa.RecordBatch.from_arrays([batch.column(0), pa.array([False] * len(batch)), text], names=["doc_id", "held_out", "text"])
            keep = [p != UNKNOWN and max(dict(m).values(), default=0.0) >= least for out in predictor(langs, shared)(iter([ids])) for p, m in zip(out.column("lang_pred").to_pylist(), out.column("proportions").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(names).mapInArrow(run, schema)
