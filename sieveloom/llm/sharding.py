"""Consistent hashing with bounded loads, with DataFrame functions only.

The ring has ``CELLS`` cells; each shard owns ``VNODES`` pseudo-random cells
(its virtual nodes). A row hashes to a cell and belongs to the first virtual
node clockwise; the cells of one virtual node are its arc. Each shard may hold
its share of rows, floor or ceil of n / shards, so the loads are exact. Walking
clockwise over the arcs, a node first keeps rows of its own arc, in hash order,
and the rows it has no room for move on; room that is left takes rows that are
on the move, oldest first. After two rounds every row has a place.

The walk runs over counts per arc, a table bounded by shards * VNODES, as one
fold. A row then finds its place from its rank in its arc: below the arc's kept
count it stays, else its number among the moving rows falls into one interval
of places. No shard, arc or moving row set is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

VNODES = 100
CELLS = 1 << 14
CHUNK = 1024
SEED = 77


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES, cells: int = CELLS, seed: int = SEED) -> DataFrame:
    """cell -> arc (the cell of its virtual node), shard. Two virtual nodes on one
    cell: the one with the smaller hash stands."""
    placed = spark.range(0, shards * vnodes, numPartitions=1).select(F.expr(f"cast(id div {vnodes} as int)").alias("shard"), (F.col("id") % vnodes).alias("v"))
    placed = placed.select("shard", F.xxhash64(F.lit(seed), "shard", "v").alias("h"))  # whatever the number of shards
    nodes = placed.groupBy(F.pmod("h", F.lit(cells)).alias("cell")).agg(F.min(F.struct("h", "shard")).alias("node"))
    all_cells = spark.range(0, cells, numPartitions=1).withColumnRenamed("id", "cell").join(nodes, "cell", "left")
    here = F.when(F.col("node").isNotNull(), F.struct(F.col("cell").alias("arc"), F.col("node.shard").alias("shard")))
    onward = F.last(here, ignorenulls=True).over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0))
    start = F.min(here).over(Window.partitionBy())
    return all_cells.select("cell", F.coalesce(onward, start).alias("at")).select("cell", "at.arc", "at.shard")


def walk(counts: DataFrame, shards: int) -> DataFrame:
    """counts (arc, shard, n) -> one row per visit: arc, shard, lap, kept, base
    (slot of the first kept row), moving (number of the arc's first moving row),
    taken_from, taken (interval of moving rows placed here), taken_base."""
    arcs = counts.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    laps = F.concat(
        F.transform("arcs", lambda a: F.struct(a["arc"].alias("arc"), a["shard"].alias("shard"), a["n"].alias("n"), F.lit(0).alias("lap"))),
        F.transform("arcs", lambda a: F.struct(a["arc"].alias("arc"), a["shard"].alias("shard"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("lap"))),
    )
    visit = "array<struct<arc:bigint,shard:int,lap:int,kept:bigint,base:bigint,moving:bigint,taken_from:bigint,taken:bigint,taken_base:bigint>>"
    begin = F.struct(room.alias("room"), F.array_repeat(F.lit(0).cast("long"), shards).alias("used"), F.lit(0).cast("long").alias("moved"), F.lit(0).cast("long").alias("placed"), F.array().cast(visit).alias("visits"))

    def step(acc, a):
        free = F.element_at(acc["room"], a["shard"] + 1) - F.element_at(acc["used"], a["shard"] + 1)
        kept = F.least(a["n"], free)
        moved = acc["moved"] + a["n"] - kept
        taken = F.least(free - kept, acc["moved"] - acc["placed"])
        base = F.element_at(acc["used"], a["shard"] + 1)
        one = F.struct(
            a["arc"].alias("arc"), a["shard"].alias("shard"), a["lap"].alias("lap"), kept.alias("kept"), base.alias("base"),
            acc["moved"].alias("moving"), acc["placed"].alias("taken_from"), taken.alias("taken"), (base + kept).alias("taken_base"),
        )
        used = F.transform(acc["used"], lambda u, s: u + F.when(s == a["shard"], kept + taken).otherwise(0))
        return F.struct(acc["room"].alias("room"), used.alias("used"), moved.alias("moved"), (acc["placed"] + taken).alias("placed"), F.concat(acc["visits"], F.array(one.cast(visit[6:-1]))).alias("visits"))

    return arcs.select(F.explode(F.aggregate(laps, begin, step)["visits"]).alias("v")).select("v.*")


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = 24, *, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """Every row of ``docs`` with its shard.

    The key on the ring is doc_id (a null is a key like any other), so copies of
    a text are spread, and counts of shards differ by one at most: law ``rows``.
    Returns doc_id, size (UTF-8 bytes of the text, none for a null, plus 8),
    text_crc32 (unsigned; a null as the empty text), law, shard, slot (gapless
    from 0 in each shard) and grown_shard (null under this law). Repeated rows
    are rows of their own; ties in the order of an arc go by size and crc32. An
    empty table gives no rows, and further columns are not read.
    """
    cell_of = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    cells_table = F.broadcast(stage(spark, ring(spark, shards, vnodes, cells), "cells"))  # ``cells`` rows, whatever the input
    counts = docs.select(cell_of.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    per_arc = cells_table.join(counts, "cell", "left").groupBy("arc", "shard").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    visits = stage(spark, walk(per_arc, shards), "ring")  # a few rows per arc; the fold runs once
    own = visits.where("lap = 0").select("arc", "shard", "kept", "base", "moving")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("cell", cell_of).join(cells_table.select("cell", "arc"), "cell")
    order = Window.partitionBy("arc").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(own), "arc")  # at most shards * vnodes rows
    stays = F.col("rank") < F.col("kept")
    common = ["doc_id", "size", "text_crc32"]
    at_home = ranked.where(stays).select(*common, "shard", (F.col("base") + F.col("rank")).alias("slot"))
    moving = ranked.where(~stays).select(*common, (F.col("moving") + F.col("rank") - F.col("kept")).alias("number"))
    moving = moving.withColumn("chunk", F.expr(f"number div {CHUNK}"))
    places = visits.where("taken > 0").select("shard", "taken_from", "taken", "taken_base")
    places = places.withColumn("chunk", F.explode(F.expr(f"sequence(taken_from div {CHUNK}, (taken_from + taken - 1) div {CHUNK})")))
    placed = moving.join(places, "chunk").where("number >= taken_from and number < taken_from + taken")
    placed = placed.select(*common, "shard", (F.col("taken_base") + F.col("number") - F.col("taken_from")).alias("slot"))
    out = at_home.unionByName(placed)
    return out.select(*common, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
