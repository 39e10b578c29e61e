"""Ladders, overlays and set operations between captions, images and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def caption_ladder(images: DataFrame, rungs: list[tuple[str, DataFrame]]) -> DataFrame:
    """images (key) with the first rung that has a caption: rung, text (both null if none)."""
    out, found, text = images, None, None
    for i, (name, rows) in enumerate(rungs):
        out = out.join(rows.select("key", F.col("text").alias(f"_t{i}")), "key", "left")
        here = F.col(f"_t{i}").isNotNull()
        found = F.when(here, name) if found is None else found.when(here, name)
        text = F.col(f"_t{i}") if text is None else F.coalesce(text, F.col(f"_t{i}"))
    return out.withColumn("rung", found).withColumn("text", text).drop(*[f"_t{i}" for i in range(len(rungs))])


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def describe(tags: DataFrame, knowledge: DataFrame) -> DataFrame:
    """tags (tag) with kind, path and posts, null where unknown."""
    return tags.join(knowledge, "tag", "left")


def overlay(base: DataFrame, update: DataFrame, key: str, column: str) -> DataFrame:
    """base with ``column`` replaced where ``update`` has a known key and a text that is not blank."""
    new = update.select(key, F.nullif(F.btrim(column), F.lit("")).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def two_key_join(base: DataFrame, wiki: DataFrame) -> DataFrame:
    """base (tag) with the body of the wiki row of the same tag, else of the same title;
    the first body that is not empty stands."""
    body = F.nullif(F.btrim("body"), F.lit(""))
    stacked = wiki.select(F.col("tag").alias("k"), F.lit(0).alias("o"), body.alias("body"), "id").unionByName(wiki.select(F.col("title").alias("k"), F.lit(1).alias("o"), body.alias("body"), "id"))
    best = first_by(stacked.where("body is not null and k is not null"), ["k"], [F.col("o"), F.col("id")]).select(F.col("k").alias("tag"), "body")
    return base.join(best, "tag", "left")


def with_fallback(vocab: DataFrame, columns: DataFrame, renames: DataFrame) -> DataFrame:
    """vocab (name) with the column of its name, else of the name it had: renames (old, new)."""
    direct = vocab.join(columns.select(F.col("name"), F.col("col").alias("_direct")), "name", "left")
    old = renames.join(columns.select(F.col("name").alias("old"), F.col("col").alias("_old")), "old").select(F.col("new").alias("name"), "_old")
    return direct.join(old, "name", "left").withColumn("col", F.coalesce("_direct", "_old")).drop("_direct", "_old")


def resolve_groups(members: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (grp, place, tag), vocab (name, index) -> (groups with sorted indices, dropped members)."""
    known = members.join(vocab.select(F.col("name").alias("tag"), "index"), "tag")
    resolved = known.groupBy("grp").agg(F.array_sort(F.collect_list("index")).alias("indices"))
    return resolved, members.join(vocab.select(F.col("name").alias("tag")), "tag", "left_anti")


def manifest(captions: DataFrame, images: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, reason): why a caption is not in the manifest, the first reason that holds; null if it is.
    captions (key, rating, tags), images (key), vocab (name)."""
    known = captions.select("key", F.explode_outer("tags").alias("name")).join(vocab.select("name"), "name").select("key").distinct().withColumn("_in", F.lit(True))
    rows = captions.join(images.select("key", F.lit(True).alias("_image")), "key", "left").join(known, "key", "left")
    reason = F.when(F.col("_image").isNull(), "no-image").when(F.col("rating").isNull(), "no-rating").when(F.col("_in").isNull(), "no-tag")
    return rows.select("key", reason.alias("reason"))


def visible_groups(members: DataFrame, listing: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """members (grp, key) still in ``listing`` (key) of groups with enough of them; the rest of the listing."""
    seen = members.join(listing.select("key"), "key", "left_semi")
    kept = seen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("grp"))).where(F.col("_n") >= least).drop("_n")
    return kept, listing.join(kept.select("key").distinct(), "key", "left_anti")


def accept(report: DataFrame, curated: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(report rows that are accepted, accepted keys that no row has)."""
    return report.join(curated.select(key), key, "left_semi"), curated.join(report.select(key), key, "left_anti")


def not_excluded(images: DataFrame, ledger: DataFrame, skip: DataFrame, key: str) -> DataFrame:
    return images.join(ledger.select(key).unionByName(skip.select(key)).distinct(), key, "left_anti")


def clause_drift(before: Column, after: Column, bag: Column) -> tuple[Column, Column, Column]:
    """(moved, novel, duplicated) clause tags against the bag before and after."""
    moved = F.filter(after, lambda x: F.array_contains(before, x) & ~F.array_contains(bag, x))
    novel = F.filter(after, lambda x: ~F.array_contains(before, x))
    doubled = F.filter(after, lambda x: F.array_contains(bag, x))
    return moved, novel, doubled


def deduped_lines(lines: DataFrame, key: Column) -> DataFrame:
    """lines (page, seq, ...) without later repeats of a key on a page."""
    return first_by(lines.withColumn("_k", key), ["page", "_k"], [F.col("seq")]).drop("_k")


def least_alpha(masks: DataFrame) -> DataFrame:
    """masks (name, pixel, alpha) merged by the least alpha, in long form."""
    return masks.groupBy("name", "pixel").agg(F.min("alpha").alias("alpha"))
