"""Groups, overrides and matches: what a curator's files say, checked and joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lines as ln
from ..functions import tags as t

CATEGORY = "$category:"
#: Words that make a member of an exclusive group a mixture.
MIXED = ("multicolored", "two-tone", "gradient", "streaked", "hetero", "multiple", "mixed")
MODES = ("multilabel", "softmax_when_solo")
CATEGORIES = ("general", "artist", "copyright", "character", "meta", "rating", "count")


def expand_members(members: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (grp, place, tag), vocab (name, category) -> (members, clashes).

    A member ``$category:x`` stands for all names of that category, by name.
    Clashes (tag, groups) are tags that two groups then claim."""
    wild = F.col("tag").startswith(CATEGORY)
    named = members.where(wild).select("grp", "place", F.substr("tag", F.lit(len(CATEGORY) + 1)).alias("category"))
    many = named.join(vocab, "category").select("grp", "place", F.col("name").alias("tag"))
    out = members.where(~wild).select("grp", "place", "tag").unionByName(many)
    order = Window.partitionBy("grp").orderBy("place", "tag")
    clashes = out.groupBy("tag").agg(F.array_sort(F.collect_set("grp")).alias("groups")).where(F.size("groups") > 1)
    return out.withColumn("place", F.row_number().over(order)), clashes


def merge_derived(curated: DataFrame, derived: DataFrame, least: int) -> DataFrame:
    """curated (grp, tag) and derived (path, tag) -> (grp, tag, origin).

    Curated groups claim their keys and tags first. Of derived ones, whose paths
    hold each tag once, those with a curated key go, claimed tags go, and what is
    left of less than ``least`` members goes too."""
    own = curated.select("grp", "tag", F.lit("curated").alias("origin"))
    fresh = derived.withColumn("grp", t.slug(F.col("path"))).join(curated.select("grp").distinct(), "grp", "left_anti").join(curated.select("tag").distinct(), "tag", "left_anti")
    size = fresh.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return own.unionByName(fresh.join(size, "path").select("grp", "tag", F.lit("derived").alias("origin")))


def escape_hints(members: DataFrame) -> DataFrame:
    """Members of groups that are mixtures, and so may escape an exclusive choice."""
    return members.where(F.col("tag").rlike(r"\b(" + "|".join(MIXED) + r")\b"))


def recovered_paths(vocab: DataFrame, knowledge: DataFrame, renames: DataFrame) -> DataFrame:
    """vocab (name) with path: by name, else by the name it had before."""
    known = knowledge.select("tag", "path")
    rows = vocab.join(known.withColumnRenamed("tag", "name"), "name", "left").join(renames.select("name", "old"), "name", "left")
    return rows.join(known.select(F.col("tag").alias("old"), F.col("path").alias("older")), "old", "left").select("name", F.coalesce("path", "older").alias("path"))


def bad_overrides(overrides: DataFrame) -> DataFrame:
    """overrides (tag, category) whose category is none."""
    return overrides.where(F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES))


def fix_artist_category(category: Column, name: Column) -> Column:
    """Old vocabularies call every name with an @ an artist; it takes a letter behind it."""
    return F.when((category == "artist") & ~t.is_artist_tag(name), "general").otherwise(category)


def trainable_rows(unmatched: DataFrame, categories: list[str], keep_owned: bool = False) -> DataFrame:
    """unmatched (index, name, category, handle of the artist or null) that a head is trained on."""
    rows = unmatched.where(F.col("category").isin(*categories))
    return rows if keep_owned else rows.where("handle is null")


def matched_apply(matches: DataFrame, tiers: list[str], only: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """matches (source, tier, ...) of the tiers, of ``only`` sources if given, less ``skip``."""
    rows = matches.where(F.col("tier").isin(*tiers) & ~F.col("source").cast("string").isin(*skip))
    return rows if only is None else rows.where(F.col("source").cast("string").isin(*only))


def caption_tag_set(text: Column) -> Column:
    """The distinct normalized tags of a plain caption, sorted, people and ratings aside."""
    tags = F.transform(F.split(text, ","), t.normalize_tag)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda x: (x != "") & ~t.is_count_tag(x) & ~t.is_rating_tag(x))))


def line_boxes(rows: DataFrame) -> DataFrame:
    """rows (page, seq, text, box) -> the first box of each quoted text of a page."""
    return rows.groupBy("page", F.btrim(ln.quote_text(F.col("text"))).alias("text")).agg(F.min_by("box", "seq").alias("box"))


def united_lists(lists: list[Column]) -> Column:
    """Several lists as one, each name at its first place."""
    return F.array_distinct(F.concat(*lists))


def attach_lines(captions: DataFrame, rows: DataFrame) -> DataFrame:
    """captions (page, text without text clauses) with rows (page, seq, text, kind) said
    behind it: speech once per text, sounds once per sound. A page without lines keeps
    its bag alone."""
    key = F.when(F.col("kind") == "sfx", F.coalesce(F.nullif(ln.sound_key(F.col("text")), F.lit("")), F.concat(F.lit("\0"), "text"))).otherwise(F.btrim("text"))
    first = rows.groupBy("page", "kind", key.alias("key")).agg(F.min_by(F.struct("seq", "text"), "seq").alias("x"))
    said = F.transform(F.array_sort(F.collect_list("x")), lambda e: F.concat(F.lit('"'), ln.quote_text(e["text"]), F.lit('"')))
    per = first.groupBy("page").pivot("kind", ["speech", "sfx"]).agg(F.array_join(said, ", "))
    clause = lambda c, head: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    parts = F.array_compact(F.array(F.nullif(F.col("text"), F.lit("")), clause("speech", "Japanese text reads as "), clause("sfx", "Japanese SFX reads as ")))
    return captions.join(per, "page", "left").select("page", F.array_join(parts, ". ").alias("text"))


def frequency_agreement(scores: DataFrame, tiers: DataFrame) -> DataFrame:
    """scores (tag, threshold, best), tiers (tag, tier) -> (tier, n, agree): how many
    thresholds in use are within 0.05 of the best ones."""
    near = F.abs(F.col("threshold") - F.col("best")) <= 0.05
    return scores.join(tiers, "tag").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("agree"))


def draw_order(paths: DataFrame) -> DataFrame:
    """paths (path) in the order in which a tree draws them: folders open before what is
    beside them, names without regard to case. (path, depth, sort key)."""
    parts = F.transform(F.split(F.lower("path"), "/"), lambda p: F.concat(p, F.lit("\1")))
    return paths.select("path", (F.size(F.split("path", "/")) - 1).alias("depth"), F.array_join(parts, "/").alias("place"))


def listing_summary(files: DataFrame) -> DataFrame:
    """files (folder, bytes) -> (folder, files, bytes)."""
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def log_window(events: DataFrame, keep: int) -> DataFrame:
    """events (job, at, line) -> the last ``keep`` of each job with their absolute offsets."""
    order = Window.partitionBy("job")
    numbered = events.withColumn("offset", F.row_number().over(order.orderBy("at", "line")) - 1)
    return numbered.withColumn("n", F.count(F.lit(1)).over(order)).where(F.col("offset") >= F.col("n") - keep).drop("n")


# Perceptual hashes -----------------------------------------------------------


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[:, None] + 1) * k[None, :] / (2 * n))


def perceptual_bits(grey: np.ndarray) -> np.ndarray:
    """grey (rows x 32 x 32) -> 64-bit hashes: which of the first 8 x 8 products with
    the cosine table are above the median of all but the first row of them."""
    c = _cosines(32)[:8]
    low = np.einsum("ai,nij,bj->nab", c, grey, c)
    middle = np.median(low[:, 1:].reshape(len(low), -1), axis=1)
    bits = (low > middle[:, None, None]).reshape(len(low), 64)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.int64)


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """images (key, grey: 1,024 numbers, row by row) -> (key, phash long)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            grey = np.stack(pdf["grey"].to_numpy()).reshape(len(pdf), 32, 32).astype(np.float64) if len(pdf) else np.zeros((0, 32, 32))
            yield pd.DataFrame({"key": pdf["key"], "phash": perceptual_bits(grey)})

    return images.select("key", "grey").mapInPandas(run, T.StructType([images.schema["key"], T.StructField("phash", T.LongType())]))


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def uncropped(mask: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int], outside: int = 255) -> np.ndarray:
    """A mask of a crop at box (x0, y0, x1, y1) on the whole image of size (width, height)."""
    x0, y0, x1, y1 = box
    h, w = y1 - y0, x1 - x0
    fitted = mask[np.arange(h) * mask.shape[0] // h][:, np.arange(w) * mask.shape[1] // w]
    out = np.full((size[1], size[0]), outside, mask.dtype)
    out[y0:y1, x0:x1] = fitted
    return out
