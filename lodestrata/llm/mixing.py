"""Mixing sources to target weights, with DataFrame expressions only.

Words of a source form one stream (documents by bucket, then id), cut into blocks of a fixed number of words. The mix has
one slot for each block it takes, and its slots are dealt to output shards of a fixed number of slots. Each shard draws
its source counts from one multinomial distribution: every slot of the shard draws a source, with the sources' slots as
weights. Running sums of a source's counts over the shards number its slots. Draws beyond a source's own number of slots
go to sources that are short of theirs (of n slots about the square root of n), so totals are exact. Slot j of a source
takes the block that the source's own pseudorandom permutation gives for j mod (number of blocks), so no block is taken
more than once oftener than another. Slots and blocks are then joined by (source, block index).

Permutations are swap-or-not shuffles: a bijection of [0, n) for any n, computed for each index on its own, so neither
a sort nor a table of the permutation is needed and reruns agree.

Defined results: null text has size 0; a document without words has taken 0; null is a source of its own, after all
others; identical rows get one part of the stream each; texts of any length are taken whole; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast (a few rows each, under 4 MB); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Rows that a stretch of a source's stream has on average, and the number of stretches at most: running sums are taken
#: within stretches, then over the stretches of a source.
STRETCH_ROWS, STRETCHES = 2_048, 1 << 16
#: Output shards whose counts are summed up together before the running sums over a source's shards.
GROUP_SHARDS = 4_096


def permuted(x: Column, n: Column, key: Column, seed: int, rounds: int = 12) -> Column:
    """The place of x in a pseudorandom permutation of [0, n), by swap-or-not rounds."""

    def step(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, i), n) - at, n)
        swap = F.xxhash64(F.lit(seed + 1), key, i, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, sidx, source_size, target) of a table with columns source and size.

    Sources by code point, null last, take the weights in turn. A target is the lesser of cap times the source's size
    and a common level times its weight, the level being the one at which targets sum to share times all sizes: what
    resharing the excess by weight, until no source is above, ends in. The level is found in closed form, by ratio of
    cap to weight, over one row per source.
    """
    one = Window.orderBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sidx"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    t = t.withColumn("sidx", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", w).withColumn("c", F.col("source_size") * F.lit(float(cap)))
    order = one.orderBy(F.col("c") / F.col("w"), "sidx")
    t = t.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
    t = t.withColumn("free", F.when(F.col("c") > F.col("level") * F.col("w"), F.col("level")))
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(F.col("free").isNotNull(), F.struct((F.col("c") / F.col("w")).alias("r"), "sidx", "free"))).over(whole)["free"]
    t = t.withColumn("target", F.least("c", F.coalesce(first * F.col("w"), F.col("c"))))
    return t.select("source", "sidx", "source_size", "target")


def plan_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, sidx, j, block): each slot of the mix, in the shard that drew it: slot j of a source takes the block."""
    spark = targets.sparkSession
    one = Window.orderBy("sidx")
    t = targets.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    t = t.withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * 2)).where("slots > 0")
    t = t.withColumn("first", F.coalesce(F.sum("slots").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).select("sidx", "blocks", "slots", "first")
    t, _ = materialize(t, "slots")
    total = t.agg(F.count("*").alias("n"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    n, slots = max(1, total["n"]), max(1, total["slots"])
    few = F.broadcast if n <= BROADCAST_SOURCES else (lambda x: x)

    # every slot of a shard draws a number below `slots`; the source whose range holds it is found through equal cells
    cell = -(-slots // n)
    ranges = t.withColumn("cell", F.explode(F.expr(f"sequence(first div {cell}, (first + slots - 1) div {cell})"))).select("cell", "sidx", "first", (F.col("first") + F.col("slots")).alias("end"))
    shards = -(-slots // shard_slots)
    draws = spark.range(shards).withColumnRenamed("id", "shard").where(F.lit(total["slots"] > 0))
    draws = draws.select("shard", F.explode(F.expr(f"sequence(0L, least({shard_slots}L, {slots}L - shard * {shard_slots}L) - 1)")).alias("i"))
    draws = draws.withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "shard", "i"), F.lit(slots))).withColumn("cell", F.expr(f"r div {cell}"))
    drawn = draws.join(few(ranges), "cell").where("first <= r and r < end").groupBy("shard", "sidx").agg(F.count("*").alias("n"))
    drawn, _ = materialize(drawn.withColumn("part", F.expr(f"shard div {GROUP_SHARDS}")), "draws")

    # running sums over shards, within groups of shards and over the groups
    before = Window.orderBy("part").partitionBy("sidx").rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.groupBy("sidx", "part").agg(F.sum("n").alias("m"))
    parts = parts.select("sidx", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sidx", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = drawn.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, ["sidx", "part"]).withColumn("at", (F.col("at") + F.col("base")).cast("long"))
    runs = runs.join(few(t.select("sidx", "slots")), "sidx").withColumn("own", F.greatest(F.least("n", F.col("slots") - F.col("at")), F.lit(0).cast("long")))
    runs, _ = materialize(runs.select("shard", "sidx", "n", "at", "own"), "runs")

    # draws beyond a source's slots, and the slots that sources are short of, meet by rank
    over = runs.where("n > own").withColumn("over", F.col("n") - F.col("own"))
    over = over.withColumn("rank", F.coalesce(F.sum("over").over(Window.orderBy("sidx", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    over = over.select("shard", F.explode(F.expr("sequence(rank, rank + over - 1)")).alias("rank"))
    got = runs.groupBy("sidx").agg(F.sum("n").alias("got"))
    short = t.join(got, "sidx", "left").withColumn("got", F.coalesce("got", F.lit(0)).cast("long")).where("got < slots")
    short = short.withColumn("rank", F.coalesce(F.sum(F.col("slots") - F.col("got")).over(Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    short = short.select("sidx", "rank", F.explode(F.expr("sequence(got, slots - 1)")).alias("j"), "got").select("sidx", (F.col("rank") + F.col("j") - F.col("got")).alias("rank"), "j")
    own = runs.where("own > 0").select("shard", "sidx", F.explode(F.expr("sequence(at, at + own - 1)")).alias("j"))
    every = own.unionByName(over.join(short, "rank").select("shard", "sidx", "j")).join(few(t.select("sidx", "blocks")), "sidx")
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("sidx") + 1, seed + 7)
    return every.select("shard", "sidx", "j", block.alias("block"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 128, shard_slots: int = 8_192, seed: int = 20_011, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> dict[str, DataFrame]:
    """The mix as DataFrames: documents (id, row, source, size, source_size, target, taken, first_shard), slots, pieces.

    row is a hash of the row's id, source and text; pieces are (sidx, block, row, id, words), the parts of documents in
    each block, and slots joined with pieces by (sidx, block) are the mix itself: taken sums it up by document, and
    first_shard is the first output shard that takes words of the document (null: none).
    """
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), text).alias("row"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d, _ = materialize(d, "sizes")
    targets, _ = materialize(source_targets(d, weights, share, cap), "targets")
    hint = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda x: x)
    stretches = min(STRETCHES, max(1, -(-d.count() // STRETCH_ROWS)))
    t = targets.withColumnRenamed("source", "_s")
    d = d.join(hint(t), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("stretch", F.pmod("row", F.lit(stretches)))
    sums = d.groupBy("sidx", "stretch").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sidx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).select("sidx", "stretch", "base")
    w = Window.partitionBy("sidx", "stretch").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long")).join(base, ["sidx", "stretch"])
    d, _ = materialize(d.withColumn("at", F.col("at") + F.col("base")).drop("base", "stretch"), "streams")
    pieces = d.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    pieces = pieces.withColumn("words", F.expr(f"least(at + size, (block + 1) * {block_words}) - greatest(at, block * {block_words})"))
    slots = plan_slots(targets, block_words, shard_slots, seed)
    # a shuffle of both sides by (source, block index), whatever their sizes
    mix = pieces.select("sidx", "block", "at", "words").join(slots.hint("merge"), ["sidx", "block"])
    taken = mix.groupBy("sidx", "at").agg(F.sum("words").cast("long").alias("taken"), F.min("shard").alias("first_shard"))
    # documents with words start at places of their own in their source's stream
    place = F.when(F.col("size") > 0, F.col("at"))
    out = d.withColumn("place", place).join(taken.withColumnRenamed("at", "place"), ["sidx", "place"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    out = out.select(F.col("id").alias(id_col), "row", "source", "size", "source_size", "target", "taken", "first_shard")
    return {"documents": out, "slots": slots, "pieces": pieces.select("sidx", "block", "row", F.col("id").alias(id_col), "words"), "targets": targets}


def mixed_documents(docs: DataFrame, seed: int = 20_011, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Documents as the mix takes them: each row 0, 1 or 2 times, with the columns it had.

    The number of copies is taken/size rounded down, or up with the fraction as its probability (a hash of the row
    decides), so sources come near their targets with whole documents. Nulls: a null source is a source, a null id is an
    id like others; a document without words (null, empty, white space) is not taken. Rows with the same id, source and
    text are taken together as often as their sum, as copies of that with the smallest hash of the whole row. Columns may
    have any names; an empty table gives no rows.
    """
    mix = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)["documents"]
    key, at, row, copies, alike, times, whole = fresh(docs.columns, "id", "at", "row", "copies", "alike", "times", "whole")
    chance = F.pmod(F.xxhash64(F.lit(seed + 99), "row", "taken"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    n = F.floor(F.col("taken") / F.col("size") + chance).cast("long")
    sums = mix.where("taken > 0").select(F.col(id_col).alias(key), F.col("row").alias(at), n.alias(copies))
    sums = sums.groupBy(key, at).agg(F.sum(copies).alias(copies), F.count("*").alias(alike)).where(F.col(copies) > 0)
    hashed = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    both = docs.withColumn(row, hashed).join(sums, (F.col(row) == F.col(at)) & F.col(id_col).cast("long").eqNullSafe(F.col(key)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = both.where(F.col(alike) > 1).groupBy(key, at, copies).agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias(whole)).select(f"{whole}.*", copies)
    out = both.where(F.col(alike) == 1).select(*columns, copies).unionByName(one)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*columns)
