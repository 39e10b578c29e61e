"""Vocabulary, co-occurrence and index statistics over tag occurrences.

All aggregate rows of (key, pos, tag); partial aggregation happens before the
shuffle, and dimension tables join on the tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as t


def tag_statistics(emitted: DataFrame, min_freq: int) -> DataFrame:
    """(name, index, freq, median_pos): rating literals aside, tags with at least
    ``min_freq`` occurrences, by frequency and then name. median_pos is a mean."""
    kept = emitted.where(~t.is_rating_tag(F.col("tag"))).groupBy(F.col("tag").alias("name")).agg(F.count(F.lit(1)).alias("freq"), F.round(F.avg("pos"), 2).alias("median_pos"))
    kept = kept.where(F.col("freq") >= min_freq)
    return kept.withColumn("index", (F.row_number().over(Window.orderBy(F.desc("freq"), "name")) - 1).cast("int"))


def rating_distribution(bags: DataFrame) -> DataFrame:
    """(rating, n): the first rating among the first two tags, on the canonical band."""
    first = F.filter(F.transform(F.slice("tags", 1, 2), t.canonical_rating), lambda r: r.isNotNull())
    return bags.select(F.try_element_at(first, F.lit(1)).alias("rating")).where("rating is not null").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def people_distribution(bags: DataFrame) -> DataFrame:
    labels = F.array(*map(F.lit, t.PEOPLE_LABELS))
    return bags.select(F.element_at(labels, t.classify_people(F.col("tags")) + 1).alias("people")).groupBy("people").agg(F.count(F.lit(1)).alias("n"))


def categorize(tags: DataFrame, cache: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """tags (tag, ...) with category: rating, artist, count, override, cache, general.
    cache and overrides: (tag, category)."""
    bare = t.strip_artist_prefix(F.col("tag"))
    out = tags.join(cache.select(F.col("tag").alias("_bare"), F.col("category").alias("_cached")), bare == F.col("_bare"), "left")
    over = F.lit(None).cast("string")
    if overrides is not None:
        out = out.join(F.broadcast(overrides.select(F.col("tag").alias("_over_tag"), F.col("category").alias("_over"))), bare == F.col("_over_tag"), "left")  # a hand-written table
        over = F.col("_over")
    c = F.col("tag")
    category = F.when(t.is_rating_tag(c), "rating").when(t.is_artist_tag(c), "artist").when(t.is_count_tag(c), "count").otherwise(F.coalesce(over, F.col("_cached"), F.lit("general")))
    return out.withColumn("category", category).withColumn("cached", F.col("_cached").isNotNull()).drop("_bare", "_cached", "_over_tag", "_over")


def coverage(emitted: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: distinct tags and occurrences, with and without an entry in ``cache`` (tag)."""
    names = emitted.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).join(cache.select("tag", F.lit(1).alias("hit")), "tag", "left")
    hit = F.col("hit").isNotNull()
    return names.agg(F.count(F.lit(1)).alias("unique_tags"), F.sum("n").alias("occurrences"), F.count_if(~hit).alias("unique_missing"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("occurrences_missing"))


def most_missing(emitted: DataFrame, cache: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent tags without an entry; ties by name."""
    missing = emitted.join(cache.select("tag"), "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return missing.orderBy(F.desc("n"), "tag").limit(n)


def inverted_index(emitted: DataFrame, axes: DataFrame, span: int = 4096) -> DataFrame:
    """(axis, tag, part, keys, n): sorted distinct keys of each tag, a row for each range
    of ``span`` keys, so the list of a tag that everything has is many bounded rows.
    axes: (tag, axis)."""
    pairs = emitted.join(axes, "tag").select("axis", "tag", "key").distinct().withColumn("part", F.floor(F.col("key") / span))
    return pairs.groupBy("axis", "tag", "part").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count(F.lit(1)).alias("n"))


def axis_coverage(emitted: DataFrame, axes: DataFrame, total: int) -> DataFrame:
    """(axis, images, percent) of images with a tag on the axis."""
    hit = emitted.join(axes, "tag").groupBy("axis").agg(F.count_distinct("key").alias("images"))
    return hit.withColumn("percent", F.round(100.0 * F.col("images") / total, 4))


def taxonomy_groups(vocab: DataFrame, knowledge: DataFrame, min_member_freq: int, min_size: int) -> DataFrame:
    """(path, name, freq, place): general tags by taxonomy path, most frequent first, of paths with enough members."""
    rows = vocab.where(F.col("freq") >= min_member_freq).join(knowledge.where("kind = 'general'").select(F.col("tag").alias("name"), "path"), "name")
    sized = rows.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("path"))).where(F.col("members") >= min_size)
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("freq"), "name"))).select("path", "name", "freq", "place")


def group_cooccurrence(solo: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, n_any, n_multi, multi_rate) over solo occurrences (key, tag)."""
    per = solo.join(groups.select("path", F.col("name").alias("tag")), "tag").groupBy("path", "key").agg(F.count_distinct("tag").alias("k"))
    out = per.groupBy("path").agg(F.count(F.lit(1)).alias("n_any"), F.count_if(F.col("k") >= 2).alias("n_multi"))
    return out.withColumn("multi_rate", F.round(F.col("n_multi") / F.col("n_any"), 6))


def decide_mode(scored: DataFrame, min_support: int, softmax_max: float, borderline_max: float) -> DataFrame:
    rate = F.col("multi_rate")
    tier = F.when(F.col("n_any") < min_support, "low_support").when(rate <= softmax_max, "confident").when(rate <= borderline_max, "borderline").otherwise("multilabel")
    return scored.withColumn("tier", tier).withColumn("mode", F.when(F.col("tier") == "confident", "softmax_when_solo").otherwise("multilabel"))


def partners(solo: DataFrame) -> DataFrame:
    """(name, partner, n) of distinct tags that share an image."""
    rows = solo.select("key", "tag").distinct()
    return rows.alias("a").join(rows.alias("b"), "key").where("a.tag <> b.tag").groupBy(F.col("a.tag").alias("name"), F.col("b.tag").alias("partner")).agg(F.count(F.lit(1)).alias("n"))


def conditional_cooccurrence(solo: DataFrame, min_solo: int, min_ratio: float) -> DataFrame:
    """(name, n_solo, n_co, ratio) of tags that rarely stand alone."""
    rows = solo.select("key", "tag").distinct()
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    out = rows.join(size, "key").groupBy(F.col("tag").alias("name")).agg(F.count(F.lit(1)).alias("n_solo"), F.count_if(F.col("k") > 1).alias("n_co"))
    out = out.withColumn("ratio", F.round(F.col("n_co") / F.col("n_solo"), 6))
    return out.where((F.col("n_solo") >= min_solo) & (F.col("ratio") >= min_ratio))


def classify_partners(cooccurrence: DataFrame, pairs: DataFrame, min_role_partners: int, dominance: float) -> DataFrame:
    """(name, bucket, base): role markers before variants before pairs before review."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), "partner")
    ranked = pairs.withColumn("r", F.row_number().over(order))
    same = t.name_prefix(F.col("name")) == t.name_prefix(F.col("partner"))
    per = ranked.groupBy("name").agg(F.count(F.lit(1)).alias("n_partners"), F.max(F.when(F.col("r") == 1, F.col("partner"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("top_n"), F.min_by("partner", F.when(same, F.col("r"))).alias("twin"))
    rows = cooccurrence.join(per, "name", "left")
    variant = F.when(t.specificity(F.col("name")) > t.specificity(F.col("twin")), "A_costume").otherwise("A_base")
    none = F.coalesce(F.col("n_partners"), F.lit(0)) == 0
    bucket = F.when(none, "B_review").when(F.col("n_partners") >= min_role_partners, "D_role").when(F.col("twin").isNotNull(), variant).when((F.col("top_n") / F.col("n_co") >= dominance) & (F.col("n_partners") >= 2), "C_pair").otherwise("B_review")
    base = F.when(none | (bucket == "D_role"), "").when(bucket.isin("A_costume", "A_base"), F.col("twin")).otherwise(F.col("top"))
    return rows.select("name", "n_solo", "n_co", "ratio", bucket.alias("bucket"), base.alias("base"))


def folder_rollup(paths: DataFrame) -> DataFrame:
    """(folder, n): files below each folder of ``path`` at any depth."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def split_train(keys: DataFrame, fraction: float, seed: int) -> DataFrame:
    """keys (key) with split: the max(1, round(n * fraction)) rows of least hash are ``val``.

    The order is a hash of the key, not a process's random numbers. The rank at
    which ``val`` ends is found in counts of the hash's top 16 bits, so only the
    rows of one such cell are ever put in order.
    """
    rows = keys.withColumn("_h", F.xxhash64("key", F.lit(seed))).withColumn("_cell", F.shiftright("_h", 48))
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.orderBy("_cell"))
    size = F.greatest(F.lit(1), F.bround(F.sum("n").over(Window.partitionBy()) * fraction, 0))
    cells = cells.select("_cell", (size - (end - F.col("n"))).alias("_left"), (end <= size).alias("_whole"))  # 65,536 rows at most
    held = rows.join(F.broadcast(cells), "_cell")
    inside = held.where(~F.col("_whole") & (F.col("_left") > 0)).withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "key")))
    split = lambda val: F.when(val, "val").otherwise("train")
    rest = held.where(F.col("_whole") | (F.col("_left") <= 0))
    return rest.select(*keys.columns, split(F.col("_whole")).alias("split")).unionByName(inside.select(*keys.columns, split(F.col("_r") <= F.col("_left")).alias("split")))
