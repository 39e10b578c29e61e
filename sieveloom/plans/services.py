"""The questions an editor asks of a dataset, each as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar as g
from ..functions import tags as t
from ..operators import joins, rules, state
from ..sources.files import matches


def items(images: DataFrame, query: str = "", pattern: str = "*", limit: int = 20_000) -> DataFrame:
    """images (rel) by folder and name, without regard to case; ``limit`` is the page."""
    rel = F.col("rel")
    rows = images.where(matches(rel, pattern) & F.lower(rel).contains(query.lower()))
    return rows.orderBy(F.lower(F.regexp_replace(rel, "[^/]*$", "")), F.lower(rel), rel).limit(min(limit, 20_000))


def item(images: DataFrame, rungs: list[tuple[str, DataFrame]], history: DataFrame, key: str) -> DataFrame:
    """All versions of one image's caption, current first."""
    chosen = [(name, rows.where(F.col("key") == key)) for name, rows in rungs]
    there = images.where(F.col("key") == key).select("key")
    return state.versions(chosen, history.where(F.col("key") == key)).join(there, "key", "left_semi").orderBy("place")


def spans(captions: DataFrame) -> DataFrame:
    """(key, start, end, text, kind, clause) for an editor."""
    rows = captions.select("key", F.explode(g.caption_spans("text")).alias("s"))
    return rows.select("key", "s.start", "s.end", "s.text", "s.kind", "s.clause")


def describe(tags: DataFrame, knowledge: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """tags (tag) with what the knowledge base says, their bucket and their drop group."""
    known = joins.describe(tags, knowledge)
    c = t.normalize_tag(F.col("tag"))
    return known.select("tag", "kind", "path", "posts", F.coalesce(rules.classify(c, F.col("kind")), F.lit("general")).alias("bucket"), rules.drop_group(c, F.col("kind"), F.col("path"), groups).alias("drop_group"))


def proposals(report: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows whose image is listed, those without one)."""
    return report.join(listing.select("key"), "key", "left_semi"), report.join(listing.select("key"), "key", "left_anti")


def erasure_pool(words: DataFrame, tags: DataFrame, single_token: list) -> DataFrame:
    """words (word) fit to stand for an erased tag: 4 to 9 small ASCII letters, one token
    under every tokenizer (``single_token``: functions from a word to a boolean, run
    in Arrow batches), and no tag."""

    def run(parts):
        for pdf in parts:
            yield pdf[[all(f(w) for f in single_token) for w in pdf["word"]]]

    shaped = words.select("word").where(F.col("word").rlike("^[a-z]{4,9}$")).distinct()
    return shaped.join(tags.select(F.col("tag").alias("word")), "word", "left_anti").mapInPandas(run, "word string")
