"""Readers and writers of the curation files, through Spark's readers only."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of files that are not captions, and of images.
NOT_CAPTIONS = (".variants.txt", ".history.txt", ".ocr.txt", ".layout.txt")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")
KB_SCHEMA = "name string, category string, post_count string, description string"
FEEDBACK = "status string, key string, before string, after string"


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + _literal(root.rstrip("/") + "/"), "")


def _literal(s: str) -> str:
    import re

    return re.escape(s)


def file_key(path: Column, root: str) -> Column:
    """The path below the root without its extension."""
    return F.regexp_replace(relative(path, root), r"\.[^./]+$", "")


def matches(path: Column, pattern: str) -> Column:
    """Shell patterns joined by |; an empty or * alternative keeps all."""
    parts = [p.strip() for p in pattern.split("|")]
    if not pattern.strip() or any(p in ("", "*") for p in parts):
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | path.rlike("^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$").removeprefix("(?s:").removesuffix(")$") + "$")
    return out


def images(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(rel, key, bytes, modified) of the images below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = found.where(ending.isin(*IMAGES)).select(relative(F.col("path"), root).alias("rel"), file_key(F.col("path"), root).alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.where(matches(F.col("rel"), pattern))


def unique_keys(rows: DataFrame) -> DataFrame:
    """The rows, or an error that lists keys that stand twice."""
    bad = rows.groupBy("key").count().where("count > 1").orderBy("key").limit(20).collect()
    if bad:
        raise ValueError("several files of one key: " + ", ".join(r["key"] for r in bad))
    return rows


def captions(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(key, text) of caption files; files that are not UTF-8 are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    is_other = F.lit(False)
    for ending in NOT_CAPTIONS:
        is_other = is_other | F.col("path").endswith(ending)
    rel = relative(F.col("path"), root)
    kept = found.where(~is_other & matches(rel, pattern) & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select(file_key(F.col("path"), root).alias("key"), F.col("content").cast("string").alias("text"))


def tab_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Records of a tab file: blank, comment and damaged lines are skipped, and the last
    field keeps its tabs."""
    parts = F.split("value", "\t", len(fields))
    lines = spark.read.text(path).where((F.btrim("value") != "") & ~F.col("value").startswith("#")).select(parts.alias("p"))
    return lines.where(F.size("p") == len(fields)).select(*[F.col("p")[i].alias(f) for i, f in enumerate(fields)])


def ocr_rows(spark: SparkSession, path: str) -> DataFrame:
    """seq, box, det, score, kind, text of read lines in any of three layouts (six, five
    or four fields); what parses under none is skipped."""
    value = F.col("value")
    box = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("int"))
    out = None
    for n, (det, score, kind, text) in ((6, (2, 3, 4, 5)), (5, (2, 3, None, 4)), (4, (None, 2, None, 3))):
        p = F.split(value, "\t", n)
        good = (F.size(p) == n) & p[0].try_cast("int").isNotNull() & (F.size(box(p[1])) == 4) & ~F.exists(box(p[1]), lambda x: x.isNull()) & p[score].try_cast("double").isNotNull()
        if kind is not None:
            good = good & p[kind].isin("speech", "sfx")
        if det is not None:
            good = good & p[det].try_cast("double").isNotNull()
        row = F.struct(
            p[0].try_cast("int").alias("seq"), box(p[1]).alias("box"), (p[det].try_cast("double") if det is not None else F.lit(0.0)).alias("det"),
            p[score].try_cast("double").alias("score"), (p[kind] if kind is not None else F.lit("")).alias("kind"), p[text].alias("text"),
        )
        out = F.when(good, row) if out is None else out.when(good, row)
    lines = spark.read.text(path).where((F.btrim("value") != "") & ~value.startswith("#"))
    return lines.select(out.alias("r")).where("r is not null").select("r.*")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, category, posts, path, description): ``[a > b]`` at the start of a
    description is the taxonomy path; of equal keys the last row stands."""
    from ..functions.tags import tag_key

    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(KB_SCHEMA).csv(path).withColumn("n", F.monotonically_increasing_id())
    rows = rows.where("name is not null").withColumn("key", tag_key(F.col("name")))
    route = F.regexp_extract(F.coalesce("description", F.lit("")), r"^\[([^\]]*)\]", 1)
    typed = rows.select("key", "n", F.struct("name", "category", F.coalesce(F.col("post_count").try_cast("long"), F.lit(0)).alias("posts"), F.regexp_replace(route, r"\s*>\s*", " > ").alias("path"), F.regexp_replace(F.coalesce("description", F.lit("")), r"^\[[^\]]*\]\s*", "").alias("description")).alias("r"))
    return typed.groupBy("key").agg(F.max_by("r", "n").alias("r")).select("key", "r.*")


def tag_cache(spark: SparkSession, path: str) -> DataFrame:
    """(tag, type) from a JSON object of tag to type number; underscores are spaces."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("tag", "type"))
    return pairs.where("type is not null").select(F.replace("tag", F.lit("_"), F.lit(" ")).alias("tag"), "type")


def report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a stage report."""
    return spark.read.option("multiLine", "true").schema(f"src string, dst string, apply boolean, rows array<struct<{FEEDBACK.replace(' string', ':string')}>>").json(path).select("src", "dst", "apply", F.explode("rows").alias("r")).select("src", "dst", "apply", "r.*")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Exclusions; anything unreadable is an error, not an empty ledger."""
    return spark.read.option("mode", "FAILFAST").schema("rel string, at string, note string, moved array<string>").json(path)


def write_tab_rows(rows: DataFrame, path: str, header: str) -> None:
    """One text file of tab records after a comment line; for small results."""
    body = rows.select(F.lit(1).alias("o"), F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
    top = rows.sparkSession.createDataFrame([(0, f"# {header}")], "o int, value string")
    top.unionByName(body).orderBy("o", "value").coalesce(1).select("value").write.text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A rows table and a table of counts by status."""
    rows.write.parquet(f"{path}/rows")
    rows.groupBy("status").count().write.parquet(f"{path}/summary")


def write_index(index: DataFrame, path: str) -> None:
    index.write.partitionBy("axis").parquet(path)


def feature_work(sources: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Sources without a cached feature of this version, size and time."""
    hit = cache.where(F.col("version") == version).select("path", "size", "mtime")
    return sources.join(hit, ["path", "size", "mtime"], "left_anti")


def mask_of(images: DataFrame, mirrored: DataFrame, flat: DataFrame) -> DataFrame:
    """images (rel, name) with the mask at the mirrored path, else at the flat one."""
    out = images.join(mirrored.select("rel", F.col("mask").alias("_m")), "rel", "left").join(flat.select("name", F.col("mask").alias("_f")), "name", "left")
    return out.withColumn("mask", F.coalesce("_m", "_f")).drop("_m", "_f")


def expand_runs(cards: DataFrame, runs: DataFrame) -> DataFrame:
    """cards (place, tag) with the category of their run: runs (i, category, length), in order."""
    from pyspark.sql import Window

    end = F.sum("length").over(Window.orderBy("i"))
    spans = runs.select("category", (end - F.col("length")).alias("first"), end.alias("last"))
    return cards.join(F.broadcast(spans), (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))).select("place", "tag", "category")  # a handful of runs


