"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are laid end to end (in an order by hash) and cut into
blocks of ``block`` words. The output is a sequence of slots, each one block,
dealt to output shards. For every shard the sources of its slots are a
multinomial draw; the i-th slot of a source reads block perm(i) of that source,
where perm is a keyed permutation of the source's blocks, drawn anew for each
pass over it; slots and blocks meet in one equi-join on (source, block).

A plain draw misses the targets by its own noise. Draws beyond a source's quota
are therefore void, and what a source lacks at the end goes to closing shards,
so each source gives exactly ``round(target)`` words. The last slot of a source
is cut short where its words run out.

Nothing but the table of sources and that of (shard, source) counts is ever
ordered as a whole: offsets of documents are sums over hash buckets plus a rank
inside a bucket, so a source with a third of all rows has as many tasks as its
rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, stage

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
BUCKETS = 512
GUIDE_CELLS = 4096
ROUNDS = 12
SEED = 20240
ROWS_PER_FILE = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_index, source_size, target, budget.

    Sources stand by code point, null last, and weigh ``weights`` in turn. The
    target is min(cap * size, level * weight) with the one level at which the
    targets sum to the sum of sizes. Sources enter in order of cap * size /
    weight, so those that stop at their cap are a prefix of that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("source_index", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ceiling", F.lit(cap) * F.col("source_size"))
    filled = Window.orderBy(F.col("ceiling") / F.col("weight"), "source_index")
    everything = Window.partitionBy()
    per = per.select(
        "*",
        F.coalesce(F.sum("ceiling").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
        F.sum("source_size").over(everything).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("weight_left"))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), "source_index", "level"))).over(everything)
    target = F.least(F.col("ceiling").cast("double"), F.coalesce(open_level["level"] * F.col("weight"), F.col("ceiling").cast("double")))
    return per.select("source", "source_index", "source_size", target.alias("target")).withColumn("budget", F.round("target").cast("long"))


def _quotas(targets: DataFrame, block: int) -> DataFrame:
    """Slots that each source needs for its budget: whole passes, then a part."""
    per = targets.where("source_size > 0 and budget > 0")
    per = per.withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("n_full", F.expr(f"source_size div {block}"))
    rest = F.expr("budget % source_size")
    return per.withColumn("quota", F.expr("budget div source_size") * F.col("n_blocks") + F.ceil(rest / block))


def _permuted(position, n, key, rounds: int = ROUNDS):
    """A keyed permutation of [0, n): in each round, x and (k - x) mod n change
    places or not, as a hash of the larger of the two says."""

    def one(x, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("key")), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), position.cast("long"), one)


def draw_slots(spark: SparkSession, targets: DataFrame, *, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per output slot: shard, source_index, draw, sweep (pass over the source), block, take (words)."""
    quotas = _quotas(targets, block)
    order = Window.orderBy("source_index")
    scale = F.sum("quota").over(Window.partitionBy())
    high = F.sum("quota").over(order)
    parts = quotas.select("source_index", ((high - F.col("quota")) / scale).alias("low"), F.when(high == scale, F.lit(1.0)).otherwise(high / scale).alias("high"))
    cells = F.sequence(F.floor(F.col("low") * GUIDE_CELLS), F.least(F.floor(F.col("high") * GUIDE_CELLS), F.lit(GUIDE_CELLS - 1)))
    guide = parts.select("source_index", "low", "high", F.explode(cells).alias("cell"))

    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    uniform = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    slots = spark.range(total).select((F.col("id") / shard_slots).cast("long").alias("shard"), uniform.alias("u"))
    drawn = (
        slots.withColumn("cell", F.floor(F.col("u") * GUIDE_CELLS))
        .join(guide, "cell")
        .where("u >= low and u < high")
        .groupBy("shard", "source_index")
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    before = F.coalesce(F.sum("drawn").over(Window.partitionBy("source_index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = drawn.withColumn("first", before).join(quotas, "source_index").withColumn("n", F.least("drawn", F.col("quota") - F.col("first"))).where("n > 0")
    got = drawn.groupBy("source_index").agg(F.sum("drawn").alias("drawn"))
    lacking = quotas.join(got, "source_index", "left").withColumn("first", F.least(F.coalesce("drawn", F.lit(0)), F.col("quota"))).withColumn("n", F.col("quota") - F.col("first")).where("n > 0")
    closing = lacking.withColumn("shard", F.lit(-(-total // shard_slots)).cast("long"))
    columns = ["shard", "source_index", "first", "n", "n_blocks", "n_full", "source_size", "budget"]
    each = kept.select(*columns).unionByName(closing.select(*columns))
    # The table of draws is tiny and its rows are thousands of slots each: deal them out first.
    each = each.repartition(max(1, min(int(total // shard_slots) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard", "source_index")
    each = each.withColumn("draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    each = each.withColumn("sweep", F.expr("draw div n_blocks")).withColumn("position", F.expr("draw % n_blocks"))
    key = F.xxhash64(F.lit(seed), "source_index", "sweep")
    index = F.when(F.col("position") < F.col("n_full"), _permuted(F.col("position"), F.col("n_full"), key)).otherwise(F.col("n_full"))
    used = F.col("sweep") * F.col("source_size") + F.col("position") * block
    return each.select("shard", "source_index", "draw", "sweep", index.alias("block"), F.least(F.lit(block), F.col("budget") - used).alias("take"))


def with_offsets(sizes: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds offset: words of the same source before the row's own, in an order by
    hash bucket and then by row. ``sizes`` is read twice, so it should be staged."""
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit("lay")), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    base = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(base), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("offset", F.col("base") + F.col("inside")).drop("s", "b", "base", "inside", "bucket")


def mix_spans(spark: SparkSession, sizes: DataFrame, *, key: str, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). ``sizes`` has ``key``, source, size (words), staged.

    rows: sizes with source_size, target, source_index and offset. spans: the
    mix, one row for each stretch of one document in one slot: shard,
    source_index, draw, sweep, offset (the document's) and first, last (words of
    the source's stream, last excluded).
    """
    targets = stage(spark, source_targets(sizes, weights, cap), "mix-targets", 1)  # a row per source
    slots = draw_slots(spark, targets, block=block, seed=seed)
    t = targets.select(F.col("source").alias("s"), "source_index", "source_size", "target")
    rows = with_offsets(sizes, key).join(t, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = stage(spark, rows, "mix-rows", 1 + sizes.count() // ROWS_PER_FILE)
    pieces = rows.where("size > 0").select("source_index", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))).alias("block"))
    start = F.col("block") * block
    # Slots are many times the rows that they are expanded from, which is what a planner
    # sees: never let them be broadcast on that account.
    spans = slots.hint("merge").join(pieces, ["source_index", "block"]).select(
        "shard", "source_index", "draw", "sweep", "offset",
        F.greatest(start, "offset").alias("first"), F.least(start + F.col("take"), F.col("offset") + F.col("size")).alias("last"),
    )
    return rows, spans.where("last > first")


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with the words that the mix takes from it.

    Returns doc_id, size (words; null text: 0), source (null is a source of its
    own, last), source_size, target (double, its source's) and taken (words,
    repeats counted; never above cap * size). A source without words has target
    0. Repeated rows count as rows of their own, further columns are ignored, an
    empty table gives an empty result, and reruns agree: every choice is a hash.
    """
    sizes = stage(spark, docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    rows, spans = mix_spans(spark, sizes, key="doc_id", **options)
    taken = spans.groupBy("source_index", "offset").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    taken = taken.select(F.col("source_index").alias("i"), F.col("offset").alias("o"), "taken")
    joined = rows.join(taken, (F.col("source_index") == F.col("i")) & (F.col("offset") == F.col("o")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them, with their columns: a document comes
    once for each pass over its source that draws words of it, whole or with the
    words of the blocks drawn, in their order (n_chars follows the text).
    Documents without words have nothing to take and go. Columns of any name
    pass through; an empty table gives an empty one."""
    row, key, taken, whole_name, parts = (free_name(docs.columns, c) for c in ("_mix_row", "_mix_key", "_mix_taken", "_mix_whole", "_mix_parts"))
    marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.xxhash64("doc_id", "text"))
    table = stage(spark, marked, "mix-docs")
    sizes = stage(spark, table.select(row, key, "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    # Rows stand by content, so reruns agree; equal rows may trade places.
    rows, spans = mix_spans(spark, sizes, key=key, **options)
    # A pass reads each block once, so its stretches of a document do not overlap.
    stretch = F.struct((F.col("first") - F.col("offset")).cast("int").alias("start"), (F.col("last") - F.col("first")).cast("int").alias("n"))
    drawn = spans.groupBy("source_index", "offset", "sweep").agg(F.sum(F.col("last") - F.col("first")).alias(taken), F.sort_array(F.collect_list(stretch)).alias(parts))
    plan = rows.where("size > 0").join(drawn, ["source_index", "offset"]).select(row, (F.col(taken) == F.col("size")).alias(whole_name), parts)
    copies = table.drop(key).join(plan, row)
    whole = F.col(whole_name)
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    # An array of one binds the words to a name: a text is split once, not once a stretch.
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(w, p["start"] + 1, p["n"]))), ""))[0]
    cut = F.when(F.col(parts)[0]["start"] > 0, F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", "")).otherwise(cut)
    copies = copies.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        copies = copies.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return copies.select(*docs.columns)
