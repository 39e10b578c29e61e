"""Stages that propose texts, the admission of their reports, and what a write entails.

A stage reads captions and ends in a proposal table (key, before, proposed,
status). A report is such a table that was stored; it is admitted as a whole
before its rows are tested one by one. A write is three changes, each a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as t
from . import rules, state

#: Of each stage the report's list of rows, the status that may be
#: written, and the field that holds the target's own text. All write the revised
#: caption, end its variants and leave their name in the history.
REPLAY = (
    ("autotag", "rows", "ok", "target_before"),
    ("position", "images", "proposed", "target_before"),
    ("correct", "rows", "ok", "target_before"),
    ("drop_groups", "rows", "ok", "target_before"),
)
#: Kinds of published files, and the one that a publish may take away.
PUBLISHED = ("image", "caption", "layout", "variants", "mask", "master", "index")
REMOVABLE = "layout"


def _joined(tags: Column) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")


def autotag_proposals(images: DataFrame, captions: DataFrame, predictions: DataFrame, mode: str) -> DataFrame:
    """images (key), captions and predictions (key, tags) -> a proposal per image.

    ``missing`` fills in images without a caption, ``merge`` adds what is new to
    those that have one, ``overwrite`` replaces it. Status: ok, unchanged,
    has-caption, no-prediction.
    """
    if mode not in ("missing", "merge", "overwrite"):
        raise ValueError(f"no such mode: {mode}")
    rows = images.select("key").join(captions.select("key", F.col("tags").alias("old")), "key", "left").join(predictions.select("key", F.col("tags").alias("new")), "key", "left")
    there = F.col("old").isNotNull()
    after = F.when(~there | F.lit(mode == "overwrite"), F.col("new")).when(F.lit(mode == "merge"), rules.merge_tags(F.col("old"), F.col("new"))).otherwise(F.col("old"))
    before, after = _joined(F.col("old")), _joined(after)
    status = F.when(there & F.lit(mode == "missing"), "has-caption").when(F.coalesce(F.size("new"), F.lit(0)) == 0, "no-prediction").when(before == after, "unchanged").otherwise("ok")
    return rows.select("key", before.alias("before"), F.when(status == "ok", after).otherwise(before).alias("proposed"), status.alias("status"))


def first_selector(tag: Column, kind: Column, path: Column, groups: list[tuple[str, list[str]]], selectors: list[str]) -> Column:
    """The first selector that takes a tag; null if none does."""
    return F.coalesce(*[F.when(rules.should_drop(tag, kind, path, groups, [s]), s) for s in selectors])


def drop_proposals(emitted: DataFrame, knowledge: DataFrame, groups: list[tuple[str, list[str]]], selectors: list[str], keep: list[str] | None = None) -> DataFrame:
    """emitted (key, pos, tag) -> (key, before, proposed, dropped, status): bags without
    the tags that a selector takes. One exchange by tag, one by key."""
    c = t.normalize_tag(F.col("tag"))
    taken = first_selector(c, F.col("kind"), F.col("path"), groups, selectors)
    if keep:
        taken = F.when(~t.matches_any(F.col("tag"), keep), taken)
    marked = emitted.join(knowledge.select("tag", "kind", "path"), "tag", "left").select("key", "pos", "tag", taken.alias("selector"))
    bag = F.array_sort(F.collect_list(F.struct("pos", "tag", "selector")))
    per = marked.groupBy("key").agg(bag.alias("x"))
    tags = lambda keep_row: _joined(F.transform(F.filter("x", keep_row), lambda e: e["tag"]))
    gone = tags(lambda e: e["selector"].isNotNull())
    return per.select("key", tags(lambda e: F.lit(True)).alias("before"), tags(lambda e: e["selector"].isNull()).alias("proposed"), gone.alias("dropped"), F.when(gone == "", "unchanged").otherwise("ok").alias("status"))


def selector_counts(emitted: DataFrame, knowledge: DataFrame, groups: list[tuple[str, list[str]]], selectors: list[str]) -> DataFrame:
    """(selector, n): tags dropped, each counted under the first selector that takes it."""
    c = t.normalize_tag(F.col("tag"))
    per_tag = emitted.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    named = per_tag.join(knowledge.select("tag", "kind", "path"), "tag", "left").withColumn("selector", first_selector(c, F.col("kind"), F.col("path"), groups, selectors))
    return named.where("selector is not null").groupBy("selector").agg(F.sum("n").alias("n"))


def admission(reports: DataFrame, src: Column, dst: Column) -> DataFrame:
    """reports (..., src, dst, applied) with verdict: a report that was itself written,
    names no roots, or walked other roots than these, is refused."""
    roots = F.col("src").isNull() | F.col("dst").isNull()
    verdict = F.when(F.coalesce("applied", F.lit(False)), "already-applied").when(roots, "no-roots").when((F.col("src") != src) | (F.col("dst") != dst), "other-roots").otherwise("admitted")
    return reports.withColumn("verdict", verdict)


def replay_specs(spark) -> DataFrame:
    return spark.createDataFrame(REPLAY, "stage string, rows_key string, ok_status string, before_field string")


def writable(reports: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of reports (stage, status, ...) that their stage's spec lets through."""
    return reports.join(F.broadcast(specs), "stage").where("status = ok_status")  # a row per stage


def caption_write(captions: DataFrame, history: DataFrame, variants: DataFrame, writes: DataFrame, by: str, limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next captions (key, text), history (key, seq, by, text) and variants (key, ...)
    after ``writes`` (key, text). The text replaced is recorded unless it is empty or
    the newest entry says the same; at most ``limit`` entries of a key stay, seq goes
    on; variants of written captions end."""
    after = state.overwrite_by_key(captions.select("key", "text"), writes.select("key", "text"), ["key"])
    last = history.groupBy("key").agg(F.max("seq").alias("top"), F.max_by("text", "seq").alias("said"))
    pushed = captions.select("key", F.btrim("text").alias("text")).join(writes.select("key"), "key", "left_semi").where("text <> ''")
    pushed = pushed.join(last, "key", "left").where(~F.col("said").eqNullSafe(F.col("text")))
    pushed = pushed.select("key", (F.coalesce("top", F.lit(0)) + 1).cast("int").alias("seq"), F.lit(by).alias("by"), "text")
    every = history.select("key", F.col("seq").cast("int").alias("seq"), "by", "text").unionByName(pushed)
    top = every.groupBy("key").agg(F.max("seq").alias("top"))
    kept = every.join(top, "key").where(F.col("seq") > F.col("top") - max(1, limit)).drop("top")
    return after, kept, variants.join(writes.select("key"), "key", "left_anti")


def publish_rows(source: DataFrame, destination: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """source and destination (rel, kind, stamp) -> (rel, kind, status).

    A source without a like destination is would-create or would-overwrite, else
    identical. A destination without a source is left alone, but for a layout
    file, which the trainer would read: would-remove. ``planned`` (rel, kind):
    rows of a stored plan, of which those whose source is gone are
    missing-source."""
    s, d = source.select("rel", "kind", F.col("stamp").alias("s")), destination.select("rel", "kind", F.col("stamp").alias("d"))
    status = F.when(F.col("s").isNull(), F.when(F.col("kind") == REMOVABLE, "would-remove")).when(F.col("d").isNull(), "would-create").when(F.col("s") == F.col("d"), "identical").otherwise("would-overwrite")
    rows = s.join(d, ["rel", "kind"], "full").select("rel", "kind", status.alias("status")).where("status is not null")
    if planned is not None:
        rows = rows.unionByName(planned.join(source, ["rel", "kind"], "left_anti").join(rows, ["rel", "kind"], "left_anti").select("rel", "kind", F.lit("missing-source").alias("status")))
    return rows


def excluded_rows(excluded: DataFrame, destination: DataFrame) -> DataFrame:
    """The plan of the excluded tree, mirrored below ``_excluded/``: no master rows, no
    layout, and nothing is removed."""
    own = excluded.where(F.col("kind").isin("image", "caption", "variants", "mask")).select(F.concat(F.lit("_excluded/"), "rel").alias("rel"), "kind", "stamp")
    return publish_rows(own, destination.where(F.col("rel").startswith("_excluded/") & (F.col("kind") != REMOVABLE)))


def stale_siblings(rows: DataFrame, destination: DataFrame) -> DataFrame:
    """(rel, other): images beside a published one with its stem and another ending."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    own = rows.where("kind = 'image'").select("rel", stem(F.col("rel")).alias("stem"))
    there = destination.where("kind = 'image'").select(F.col("rel").alias("other"), stem(F.col("rel")).alias("stem"))
    return own.join(there, "stem").where(F.lower("rel") != F.lower("other")).select("rel", "other")


def promoted(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """rows (key, caption) with the caption that an audit put forward, where it did."""
    return rows.join(audited.select("key", F.col("caption").alias("_a")), "key", "left").withColumn("caption", F.coalesce("_a", "caption")).drop("_a")


def artifacts(trees: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rel, tree, inode) of a file in several trees, once per inode, by the first tree."""
    out = None
    for place, (name, rows) in enumerate(trees):
        part = rows.select("rel", "inode", F.struct(F.lit(place).alias("place"), F.lit(name).alias("tree")).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rel", "inode").agg(F.min("at").alias("at")).select("rel", "inode", F.col("at.tree").alias("tree"))
