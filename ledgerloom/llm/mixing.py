"""Mixing sources to target weights: fixed-length blocks, drawn shards, permuted indices. [native]

Words of a source form one stream (documents in a fixed pseudorandom order), cut into blocks of
``block_words`` words. The mixture is a row of output slots, ``slots_per_shard`` to a shard.

1. Draw: a table of source counts per shard. Every shard's counts are one multinomial draw, reconciled to the totals
   over all shards: slots are drawn without replacement from a pool that holds each source exactly as often as its target asks, which is
   what independent draws are under the condition that their totals are the targets'. So shards vary but totals don't wander.
2. Map: a source's slots are numbered through the shards by running counts. Slot j is in pass floor(j / n) over the
   source's n blocks and takes block ``perm(j mod n)``, with another permutation for every pass; the source's last block, which may be short,
   ends each pass. The last pass stops at the target: its last slot takes only as many words of its block as are still
   wanted, so a source's taken words are its target, rounded. Within a shard the slots are dealt around in steps of a prime from a drawn start, so that sources alternate.
3. Join: blocks are joined to slots by their index.

Permutations are swap-or-not shuffles (Hoang, Morris, Rogaway 2012): a keyed bijection on [0, n) for
any n, a few integer operations a round, so no index is ever sorted or stored.

Edge cases: a null text has no words; null sources are one source, sorted last; repeated rows are
separate documents in ``taken``, which share what was taken by whole words (the first gets the rest); an empty table or one without words gives targets and takes of 0. Extra columns
are ignored, whatever their names. The number of sources is taken to be small: a window in one task numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, handed_out, null_rank

BLOCK_WORDS = 32
SLOTS_PER_SHARD = 4096
MAX_REPEATS = 3
ROUNDS = 24
BUCKET_ROWS = 4096
CHUNK_SLOTS = 4096
#: Shards whose counts are added up at a time.
BUCKET_SHARDS = 4096
#: A prime over every number of slots in a shard.
STEP = 1_000_000_007
TASK_SLOTS = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), a sort key that tells rows with one doc_id apart and, once written, a number for each row."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("order_key"), F.monotonically_increasing_id().alias("row"))


def source_targets(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: s (its number by code point, null last), source_size, target.

    Weights are 1, 2, 3, repeating. A target is min(level x weight, max_repeats x size) with the one
    level at which targets add up to all sizes: what repeated resharing of the excess converges to.
    The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(null_rank(F.col("source")), F.encode("source", "UTF-8"))
    per = per.select("source", "source_size", (F.row_number().over(order) - 1).alias("s"))
    per = per.withColumn("weight", (F.col("s") % 3 + 1).cast("double"))
    per = per.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("weights", F.sum("weight").over(every))
    zero = F.lit(0.0)
    # The level if exactly the sources before this one (by cap per weight) stay at their caps.
    per = per.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), zero)) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), zero)),
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), "s", "level"))).over(every)["level"])
    target = F.when(F.col("total") == 0, zero).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return per.select("s", "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x under a keyed pseudorandom permutation of [0, n)."""

    def shuffled(v: Column) -> Column:
        def step(state: Column, r: Column) -> Column:
            other = F.pmod(F.xxhash64(v["key"], r) - state, v["n"])
            return F.when(F.xxhash64(v["key"], r, F.greatest(state, other)).bitwiseAND(1) == 1, other).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), v["x"], step)

    # What the rounds look at is an array's one element, so that they see values.
    given = F.struct(x.cast("long").alias("x"), n.cast("long").alias("n"), F.xxhash64(*key, n).alias("key"))
    return F.get(F.transform(F.array(given), shuffled), 0)


def place(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each document with words lies in its source's stream: s, doc_id, order_key, size, at (offset in words).

    Word offsets are prefix sums in two steps: within hashed buckets of a source (many per source,
    so that no source is one task), then over the bucket totals.
    """
    docs = sized.where("size > 0")
    rows = docs.count()
    buckets = max(256, rows // BUCKET_ROWS)
    wanted = targets.select("s", "source")
    docs = docs.join(F.broadcast(wanted) if bounded(wanted) else wanted, docs["source"].eqNullSafe(wanted["source"])).drop("source")
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("order_key"), F.lit(buckets)))
    totals = docs.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(starts, ["s", "bucket"])
    return docs.select("s", "doc_id", "order_key", "size", (F.col("at") + F.col("start")).alias("at"))


def into_blocks(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block that a placed document reaches into: block, first (word in the document), offset (in the block), words; at and size go."""
    b = F.lit(block_words)
    end = F.col("at") + F.col("size")
    rows = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((end - 1) / b))))
    first = F.greatest(F.col("at"), F.col("block") * b)
    rows = rows.withColumns({"first": first - F.col("at"), "offset": first - F.col("block") * b, "words": F.least(end, (F.col("block") + 1) * b) - first})
    return rows.drop("at", "size")


def pack(sized: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pieces of the blocks: s, doc_id, order_key, block, first (word in the document), offset (in the block), words."""
    return into_blocks(place(sized, targets), block_words)


def bounded(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of short rows is small enough to broadcast."""
    return df.limit(rows + 1).count() <= rows


def pools(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """s, n (blocks), size, wanted (words), slots, start (in the pool of all slots), pool (its size) of every source that is asked for."""
    per = targets.where("source_size > 0").select("s", F.ceil(F.col("source_size") / F.lit(block_words)).alias("n"), F.col("source_size").alias("size"), F.round("target").cast("long").alias("wanted"))
    passes = F.floor(F.col("wanted") / F.col("size"))
    count = passes * F.col("n") + F.ceil((F.col("wanted") - passes * F.col("size")) / F.lit(block_words))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("slots", count.cast("long")).where("slots > 0")
    return per.withColumns({"start": F.coalesce(F.sum("slots").over(before), F.lit(0)), "pool": F.sum("slots").over(every)})


def tasks_of(pool: int) -> int:
    return max(1, -(-pool // TASK_SLOTS))


def draws(per: DataFrame, pool: int, seed: int = 1, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The drawn source counts, as a table: shard, s, count."""
    # Slots are laid out in chunks first, so that a source with a third of them is many tasks.
    chunks = per.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK_SLOTS))))
    chunks = chunks.repartition(tasks_of(pool), "s", "chunk")  # a few short rows now, TASK_SLOTS rows a task soon
    low = F.col("chunk") * CHUNK_SLOTS
    each = chunks.select("s", "pool", F.explode(F.sequence(F.col("start") + low, F.col("start") + F.least(low + CHUNK_SLOTS, F.col("slots")) - 1)).alias("j"))
    place = permuted(F.col("j"), F.col("pool"), F.lit(seed), F.lit(-1))
    return cut(each.groupBy(F.floor(place / slots_per_shard).alias("shard"), "s").agg(F.count(F.lit(1)).alias("count")), "draws")


def slots(targets: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mixture's slots: shard, slot, s, block, most (words that the slot takes of its block)."""
    per = cut(pools(targets, block_words), "pools")
    pool = per.agg(F.max("pool")).first()[0] or 0
    counts = draws(per, pool, seed, slots_per_shard).withColumn("bucket", F.floor(F.col("shard") / BUCKET_SHARDS))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = counts.groupBy("s", "bucket").agg(F.sum("count").alias("c"))
    totals = totals.select("s", "bucket", F.coalesce(F.sum("c").over(ahead(Window.partitionBy("s").orderBy("bucket"))), zero).alias("base"))
    inside = F.coalesce(F.sum("count").over(ahead(Window.partitionBy("s", "bucket").orderBy("shard"))), zero)
    offset = F.coalesce(F.sum("count").over(ahead(Window.partitionBy("shard").orderBy("s"))), zero)
    counts = counts.withColumns({"inside": inside, "offset": offset, "filled": F.sum("count").over(Window.partitionBy("shard"))}).join(totals, ["s", "bucket"])
    own = per.select("s", "n", "size", "wanted")
    counts = counts.join(F.broadcast(own) if bounded(own) else own, "s").repartition(tasks_of(pool), "shard", "s")
    each = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("j", F.col("base") + F.col("inside") + F.col("i"))
    each = each.withColumns({"pass": F.floor(F.col("j") / F.col("n")), "k": F.col("j") % F.col("n")})
    full = F.col("n") - 1  # the blocks before the last one
    block = F.when(F.col("k") < full, permuted(F.col("k"), F.greatest(full, F.lit(1)), F.lit(seed), F.col("s"), F.col("pass"))).otherwise(F.col("k"))
    block = F.coalesce(block, F.lit(0).cast("long"))  # never null, so the join doesn't ask again
    left = F.col("wanted") - F.col("pass") * F.col("size") - F.col("k") * F.lit(block_words)  # words still wanted in the slot's pass
    slot = ((F.col("offset") + F.col("i")) * F.lit(STEP) + F.pmod(F.xxhash64(F.lit(seed), "shard"), F.col("filled"))) % F.col("filled")
    return each.select("shard", slot.alias("slot"), "s", block.alias("block"), F.least(left, F.lit(block_words)).alias("most"))


def mix(docs: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, source targets, mixture).

    The mixture has a row for each slot and document that it takes words of: shard, slot, s, block, doc_id,
    order_key, first (word), words. The same block in several slots gives as many rows.
    """
    sized = cut(sizes(docs), "sizes")
    targets = cut(source_targets(sized), "targets")
    pieces = pack(sized, targets, block_words)
    mixed = slots(targets, seed, block_words, slots_per_shard).join(pieces.hint("merge"), ["s", "block"]).where("offset < most")
    return sized, targets, mixed.withColumn("words", F.least("words", F.col("most") - F.col("offset"))).drop("offset", "most")


def taken(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, order_key, size, source_size, target, taken."""
    sized, targets, mixed = mix(docs, seed)
    took = mixed.groupBy("doc_id", "order_key").agg(F.sum("words").alias("words"))
    # Repeated rows share doc_id and order_key: they share what was taken, by number, and the first gets what is left.
    same = sized.groupBy("doc_id", "order_key").agg(F.count(F.lit(1)).alias("same"), F.min("row").alias("first"))
    took = same.alias("a").join(took.alias("b"), F.expr("a.order_key = b.order_key and a.doc_id <=> b.doc_id"), "left")
    took = took.select(F.col("a.doc_id").alias("d"), F.col("a.order_key").alias("k"), "same", "first", F.coalesce("words", F.lit(0)).alias("words"))
    few = F.broadcast(targets) if bounded(targets) else targets
    out = sized.alias("x").join(few.alias("t"), F.expr("x.source <=> t.source")).join(took, F.expr("x.order_key = k and x.doc_id <=> d"))
    share = F.floor(F.col("words") / F.col("same")) + F.when(F.col("row") == F.col("first"), F.col("words") % F.col("same")).otherwise(0)
    return out.select("x.doc_id", "x.source", "x.order_key", "size", "source_size", "target", share.alias("taken"))


def one_of_each(texts: DataFrame, sized: DataFrame) -> DataFrame:
    """texts with repeated rows once. Only rows that repeat are shuffled for it; those are counted on the short rows."""
    again = sized.groupBy("doc_id", "order_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = handed_out(cut(again.select(F.col("doc_id").alias("d"), F.col("order_key").alias("k")), "repeated"))
    same = F.expr("order_key = k and doc_id <=> d")
    repeated = texts.join(again, same, "left_semi").dropDuplicates(["doc_id", "order_key"])
    return texts.join(again, same, "left_anti").unionByName(repeated)


def shards(docs: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mixture as text: shard, slot, source, doc_ids, n_words, text (the block's words, by spaces).

    Documents are cut into the words of their blocks before the join, so a block moves as its text.
    """
    sized = cut(sizes(docs), "sizes")
    targets = cut(source_targets(sized), "targets")
    texts = one_of_each(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("order_key"), "text"), sized)
    # One short row a document meets its text; blocks are cut only after that.
    cutup = texts.alias("a").join(place(sized, targets).alias("b"), F.expr("a.order_key = b.order_key and a.doc_id <=> b.doc_id"))
    cutup = into_blocks(cutup.select("a.doc_id", "s", "at", "size", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")), block_words)
    part = F.struct(F.col("offset"), F.col("doc_id"), F.array_join(F.slice("w", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("t"))
    blocks = cutup.select("s", "block", "words", part.alias("part"))
    blocks = blocks.groupBy("s", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("words").alias("n_words"))
    out = slots(targets, seed, block_words, slots_per_shard).join(blocks.hint("merge"), ["s", "block"])
    few = targets.select("s", "source")
    out = out.join(F.broadcast(few) if bounded(few) else few, "s")
    used = F.when(F.col("most") < F.col("n_words"), F.filter("parts", lambda p: p["offset"] < F.col("most"))).otherwise(F.col("parts"))
    text = F.array_join("parts.t", " ")
    text = F.when(F.col("most") < F.col("n_words"), F.call_function("substring_index", text, F.lit(" "), F.col("most").cast("int"))).otherwise(text)
    return out.select("shard", "slot", "source", used["doc_id"].alias("doc_ids"), F.least("n_words", "most").alias("n_words"), text.alias("text"))
