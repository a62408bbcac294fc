"""Mixing sources to target weights, on built-in functions alone.

Words of a source are packed into fixed-length blocks; the slots of a source's quota fall on output shards at random and are tied to
block indexes by the source's pseudorandom permutations, one per pass; pieces of blocks are joined by that index. The mixed shards are
written, and what a document gave is counted from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import stored, stored_parts, words

#: Primes over 2**31.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)
#: Sources up to this many rows are broadcast; beyond it the joins on the source shuffle.
BROADCAST_SOURCES = 20_000
#: Buckets whose totals one window adds up.
GROUP = 2048
#: Rounds in which pieces go to the shards; each reads what all texts give and shuffles the part of its shards.
ROUNDS = 2


def source_targets(sized: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source of `sized` (source, size): source, source_id, source_size, weight, target.

    Sources count in code-point order, null last; weights repeat over them and share all words. A target stops at cap times the
    source's size and the excess goes to the others by weight, until none is above. That fixed point is found in one pass: by
    rising cap * size / weight, the first source that its share does not fill sets the price of a unit of weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = totals.withColumn("source_id", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_id") % len(weights) + 1))
    s = s.withColumns({"_cap": cap * F.col("source_size").cast("double"), "_all": F.sum("source_size").over(everything).cast("double")})
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", "source_id")
    s = s.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("_price", F.greatest(F.lit(0.0), F.col("_all") - F.col("_full")) / F.col("_rest"))
    # prices of sources that stay below their caps fall together at the first such source in this order
    s = s.withColumn("_first", F.min(F.when(F.col("_price") <= F.col("_ratio"), F.struct("_ratio", "source_id", "_price"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_first._price") * F.col("weight"), F.col("_cap")))
    return s.select("source", F.col("source_id").cast("int").alias("source_id"), "source_size", "weight", target.alias("target"))


def passes(sources: DataFrame, cap: int, seed: int) -> DataFrame:
    """Adds passes: an array of (pass, step, back, shift), the permutation of each pass that the source's quota reaches.

    A step is a product modulo the source's blocks of those of 24 prime factors that a hash has bits for and that don't divide the
    number of blocks, so it has no divisor in common with it, and block -> step * block + shift is a permutation. back is the step's
    inverse, by Euclid's algorithm, which takes at most 92 steps of division for 64 bits.
    """
    blocks = F.col("blocks")
    times = lambda x, y: ((x.cast("decimal(19,0)") * y.cast("decimal(19,0)")) % blocks).cast("long")
    primes = F.array(*[F.lit(p) for p in PRIMES])

    def one(p):
        key = F.xxhash64("source_id", p, F.lit(seed))

        def factor(step, j):
            prime = F.element_at(primes, j % len(PRIMES) + 1)
            return F.when((F.getbit(key, j) == 1) & (blocks % prime > 0), times(step, prime % blocks)).otherwise(step)

        step = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(1).cast("long"), factor)
        return F.struct(p.cast("long").alias("pass"), step.alias("step"), F.pmod(F.xxhash64("source_id", p, F.lit(seed + 3)), blocks).alias("shift"))

    def inverse(step):
        state = lambda r, r1, t, t1: F.struct(r.alias("r"), r1.alias("r1"), t.alias("t"), t1.alias("t1"))

        def divided(x, _):
            q = F.call_function("div", x["r"], x["r1"])
            return F.when(x["r1"] == 0, x).otherwise(state(x["r1"], x["r"] - q * x["r1"], x["t1"], x["t"] - q * x["t1"]))

        first = state(blocks, step, F.lit(0).cast("long"), F.lit(1).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(92)), first, divided, lambda x: F.pmod(x["t"], blocks))

    used = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: p * blocks < F.col("quota"))
    full = F.transform(F.transform(used, one), lambda p: F.struct(p["pass"].alias("pass"), p["step"].alias("step"), inverse(p["step"]).alias("back"), p["shift"].alias("shift")))
    return sources.withColumn("passes", F.when(blocks > 0, full))


def _times(x, y, blocks):
    """x * y modulo blocks, of numbers below blocks; the product may go beyond 64 bits."""
    far = (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")) % blocks
    return F.when(blocks < 1 << 31, x * y % blocks).otherwise(far.cast("long"))


def slot_of(block, p, blocks):
    """Where a pass puts a block, counted over all passes. Counts of blocks stay below 2**62."""
    return p["pass"] * blocks + (_times(p["step"], block, blocks) + p["shift"]) % blocks


def block_of(slot, p, blocks):
    """The block that a pass puts at a slot."""
    return _times(p["back"], F.pmod(slot - p["pass"] * blocks - p["shift"], blocks), blocks)


def mix_sources(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block_words: int = 32, shard_slots: int = 4096, seed: int = 17):
    """Mixes documents to target weights. Returns (documents, slots).

    documents: doc_id, source, size, source_size, target, taken; one row per input row. slots: the mix itself as it was written to the
    shared folder, partitioned and sorted by shard, one row per block that it takes: shard, source_id, slot, pass, block, tokens (the
    block's words in order) and parts (row, n: how many of them each input row gave). A source's quota of slots is its target in whole blocks. Where a slot
    falls among the output shards is a uniform draw, so a shard's counts of sources are a multinomial draw, conditioned on every
    source's total being its quota; drawn without that condition, small sources would miss their targets by the sampling error.
    A pass ties slot numbers to the source's block numbers by a permutation, so a pass takes no block twice, and cap passes bound a
    document's words by cap times its size.

    Order within a source follows a hash of doc_id, so reruns agree. Null text has size 0 and takes 0; null sources are one
    source, the last; rows with equal or null doc_id are rows of their own; an empty table gives empty results. Columns other than
    doc_id, source and text are not read.
    """
    # texts are read twice, for their sizes and for the mix, and meet their places by these 96 bits of a row
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("k1"), F.hash("text", "source", "doc_id").alias("k2"))
    sized = stored(keyed.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), "k1", "k2", F.monotonically_increasing_id().alias("row")), "mix-sizes")
    sources = stored(source_targets(sized, weights, cap), "mix-sources")
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.least(cap * blocks, F.round(F.col("target") * blocks / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumns({"blocks": blocks.cast("long"), "quota": quota})
    spark = docs.sparkSession
    sums = sources.agg(F.count("*").alias("n"), F.sum("quota").alias("slots")).first()
    n_rows = sized.count()
    small = F.broadcast if sums["n"] <= BROADCAST_SOURCES else (lambda x: x)
    shards = max(1, -(-(sums["slots"] or 0) // shard_slots))

    # word offsets within a source: hash buckets bound what one window holds, and totals of groups of buckets and of buckets give starts
    buckets = max(1, -(-n_rows // 2000))
    per_pass = passes(sources, cap, seed).select("source_id", F.col("source").alias("_s"), "blocks", "quota", "passes")
    placed = sized.filter("size > 0").join(small(per_pass), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")), F.lit(seed)), F.lit(buckets)))
    placed = placed.withColumn("group", F.floor(F.col("bucket") / GROUP))
    starts = placed.groupBy("source_id", "group", "bucket").agg(F.sum("size").alias("words"))
    upto = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = starts.groupBy("source_id", "group").agg(F.sum("words").alias("words")).select("source_id", "group", upto(Window.partitionBy("source_id").orderBy("group")).alias("_group"))
    starts = starts.withColumn("_bucket", upto(Window.partitionBy("source_id", "group").orderBy("bucket"))).join(groups, ["source_id", "group"])
    starts = starts.select("source_id", "bucket", (F.col("_group") + F.col("_bucket")).alias("start"))
    inside = Window.partitionBy("source_id", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_id", "bucket"])
    placed = placed.select("k1", "k2", "row", "source_id", "size", (F.col("start") + F.col("_in")).alias("at"), "blocks", "quota", "passes")

    texts = keyed.select("k1", "k2", "text")
    if not sized.groupBy("k1", "k2").count().filter("count > 1").isEmpty():  # repeated rows have one text; without any there is no need to sort all
        texts = texts.dropDuplicates(["k1", "k2"])

    # A permutation goes from a pass's blocks to its slots, so a text that knows its place computes the slots of all its blocks, is cut
    # there, and its pieces meet those of other documents at (source, slot): blocks are joined by index without a table of blocks.
    # A piece goes with where it begins in its source's part of the mix, slot * block_words + offset, and the row that it comes from.
    # Pieces that a pass takes are stored once, with their places in all passes, and go to the shards in rounds, each of some shards:
    # by then the texts' shuffle is gone from disk, and of the pieces' shuffle one round is there at a time
    B, at, end, n_blocks = F.lit(block_words).cast("long"), F.col("at"), F.col("at") + F.col("size"), F.col("blocks")

    def pieces(w):
        def piece(block):
            first = F.greatest(at, block * B)
            places = F.transform("passes", lambda p: slot_of(block, p, n_blocks) * B + first - block * B)
            return F.struct(F.filter(places, lambda pos: pos < F.col("quota") * B).alias("places"), (first - at + 1).cast("int").alias("begin"), (F.least(end, (block + 1) * B) - first).cast("int").alias("n"))

        own = F.sequence(F.floor(at / B), F.floor((end - 1) / B))
        taken = F.filter(F.transform(own, piece), lambda x: F.size(x["places"]) > 0)
        return F.transform(taken, lambda x: F.struct(x["places"].alias("places"), F.array_join(F.slice(w, x["begin"], x["n"]), " ").alias("text")))

    # the planner takes a filtered table for small; the hint keeps it from broadcasting texts or places
    cuts = texts.hint("merge").join(placed, ["k1", "k2"])
    # split once a text, as the variable of an outer lambda
    cuts = cuts.select("source_id", "row", F.explode(F.flatten(F.transform(F.array(words(F.col("text"))), pieces))).alias("x")).select("source_id", "row", "x.*")
    cuts = stored_parts([cuts], "mix-cuts", freed=True)
    slot_at = lambda pos: F.floor(pos / B)
    shard_at = lambda pos: F.pmod(F.xxhash64("source_id", slot_at(pos), F.lit(seed + 1)), F.lit(shards))
    rounds = min(ROUNDS, shards)
    tasks = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // rounds)

    def mixed(k):
        moved = cuts.select("source_id", "row", "text", F.explode(F.filter("places", lambda pos: F.pmod(shard_at(pos), F.lit(rounds)) == k)).alias("pos"))
        moved = moved.repartition(tasks, shard_at(F.col("pos"))).withColumns({"shard": shard_at(F.col("pos")), "slot": slot_at(F.col("pos"))})
        m = moved.groupBy("shard", "source_id", "slot").agg(F.sort_array(F.collect_list(F.struct("pos", "row", "text"))).alias("_x"))
        m = m.withColumn("tokens", F.split(F.array_join("_x.text", " "), " ", -1)).withColumn("_end", F.col("slot") * B + F.size("tokens"))
        m = m.join(small(per_pass.select("source_id", "blocks", "passes")), "source_id").withColumn("_p", F.get("passes", F.floor(F.col("slot") / n_blocks).cast("int")))
        m = m.select(
            "shard", "source_id", "slot", "_p.pass", block_of(F.col("slot"), F.col("_p"), n_blocks).alias("block"), "tokens",
            F.transform("_x", lambda x, k: F.struct(x["row"].alias("row"), (F.coalesce(F.get("_x", k + 1)["pos"], F.col("_end")) - x["pos"]).cast("int").alias("n"))).alias("parts"),
        )
        return m.sortWithinPartitions("shard", F.xxhash64("source_id", "slot", F.lit(seed + 2)), "source_id", "slot")

    slots = stored_parts([mixed(k) for k in range(rounds)], "mix-shards", freed=True)
    taken = slots.select(F.explode("parts").alias("x")).groupBy("x.row").agg(F.sum("x.n").alias("taken"))
    result = (
        sized.join(taken, "row", "left")
        .join(small(sources.select(F.col("source").alias("_s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )
    return result, slots
