"""Files of a workspace: vocabularies, rules, sidecars, caches and small sinks."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import MODES
from .files import matches, relative


def safe_walk(top: str) -> list[str]:
    """Files below a folder, links followed, no real folder entered twice; sorted."""
    seen, out = set(), []
    for folder, inner, names in os.walk(top, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            inner[:] = []
            continue
        seen.add(real)
        inner.sort()
        out += [os.path.join(folder, n) for n in names]
    return sorted(out)


def captions_of_roots(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """(root_rank, rel, text) of caption files: roots in their order, paths with a part
    that begins with a dot skipped; a missing root has no rows."""
    out = spark.createDataFrame([], "root_rank int, rel string, text string")
    for rank, root in enumerate(roots):
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
        rows = files.select(F.lit(rank).alias("root_rank"), relative(F.col("_metadata.file_path"), root).alias("rel"), F.col("value").alias("text"))
        out = out.unionByName(rows.where(~F.col("rel").rlike(r"(^|/)\.") & matches(F.col("rel"), pattern)))
    return out


def variants(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of a variants sidecar, text as it stands; a missing file is an error."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.btrim("value") != ""))
    parts = F.split("value", "\t", 2)
    return rows.select(F.btrim(F.get(parts, 0)).alias("label"), F.get(parts, 1).alias("text")).where("text is not null")


def knowledge_candidates(folders: list[str], name: str, lang: str | None) -> list[str]:
    """Where a knowledge base may lie, best first: in each folder that of the language,
    the English one, then the plain one."""
    stem, end = os.path.splitext(name)
    names = dict.fromkeys(([f"{stem}.{lang}{end}"] if lang else []) + [f"{stem}.en{end}", name])
    return [os.path.join(f, n) for f in folders for n in names]


def vocabulary(spark: SparkSession, path: str, fold: bool = False) -> DataFrame:
    """(name, index, category) of a vocabulary file; fold: names as lower-case keys."""
    rows = spark.read.option("multiLine", "true").schema("tags array<struct<name:string,index:int,category:string>>").json(path).select(F.explode("tags").alias("t")).select("t.*")
    return rows.withColumn("name", F.lower(F.replace("name", F.lit("_"), F.lit(" ")))) if fold else rows


def names_by_category(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("category").agg(F.array_sort(F.collect_set("name")).alias("names"))


def _mapping(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading rules needs a YAML library") from e
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def group_file(path: str) -> list[tuple[str, str, int, str]]:
    """(group, mode, place, tag) of a groups file, a driver's configuration. Errors: an
    unknown mode, a tag in two groups, a sentinel on a multilabel group."""
    out, owner = [], {}
    for name, body in _mapping(path).items():
        if name == "version":
            continue
        mode = body.get("mode", "multilabel")
        if mode not in MODES:
            raise ValueError(f"{name}: no such mode: {mode}")
        if body.get("sentinel") and mode == "multilabel":
            raise ValueError(f"{name}: a sentinel needs an exclusive mode")
        for place, tag in enumerate(body.get("tags") or []):
            if owner.setdefault(tag, name) != name:
                raise ValueError(f"{tag!r} stands under both {owner[tag]!r} and {name!r}")
            out.append((name, mode, place, tag))
    return out


def rule_file(path: str) -> dict:
    """aliases, remove, dedup and replacements of a rules file; unknown parts are errors."""
    said = _mapping(path)
    known = {"aliases": {}, "remove": [], "dedup": {}, "replacements": []}
    if extra := set(said) - set(known) - {"version"}:
        raise ValueError(f"unknown rules: {sorted(extra)}")
    return known | {k: v for k, v in said.items() if k in known and v is not None}


def wiki(spark: SparkSession, path: str) -> DataFrame:
    """(tag, title, body) of a wiki mirror, deleted pages aside; other columns are not read."""
    return spark.read.parquet(path).select("tag", "title", "body", "is_deleted").where(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted")


def write_cache(rows: DataFrame, path: str, stamp: str) -> None:
    """Scores by stem under the stamp of what made them."""
    rows.withColumn("stamp", F.lit(stamp)).write.parquet(path)


def read_cache(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """A cache of the same stamp; one of another stamp is refused."""
    rows = spark.read.parquet(path)
    other = [r["stamp"] for r in rows.where(~F.col("stamp").eqNullSafe(F.lit(stamp))).select("stamp").distinct().limit(3).collect()]
    if other:
        raise ValueError(f"the cache was made by {other}, not by {stamp!r}")
    return rows.drop("stamp")


def checkpoint_tables(spark: SparkSession, folder: str, require: tuple[str, ...] = ("vocab", "thresholds")) -> dict[str, DataFrame]:
    """The tables of a checkpoint folder by name; a required one that is missing is an error."""
    out, missing = {}, []
    for name in {*require, "vocab", "thresholds", "groups"}:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        elif name in require:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {sorted(missing)}")
    return out


def masks(spark: SparkSession, root: str) -> DataFrame:
    """(folder, path) of mask images; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path")
    rel = relative(F.col("path"), root)
    return found.select(F.regexp_replace(rel, "/?[^/]*$", "").alias("folder"), "path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(group, member, score) of a near-twin manifest."""
    return spark.read.option("multiLine", "true").schema("groups array<struct<id:int,members:array<struct<rel:string,score:double>>>>").json(path).select(F.explode("groups").alias("g")).select(F.col("g.id").alias("grp"), F.explode("g.members").alias("m")).select("grp", F.col("m.rel").alias("member"), F.col("m.score").alias("score"))


def write_json(value, path: str) -> None:
    """A small result as one JSON file, put in place whole."""
    half = f"{path}.part"
    with open(half, "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
    os.replace(half, path)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A vocabulary, its rules, groups and dataset, a Parquet table each."""
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")


def write_manifest(groups: DataFrame, path: str) -> None:
    """groups (grp, member, score), one JSON record per group."""
    member = F.struct(F.col("member").alias("rel"), "score")
    groups.groupBy(F.col("grp").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members")).write.json(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches (..., hamming, score) as CSV, nearest first; a report, so one file."""
    matches.orderBy("hamming", F.desc("score")).coalesce(1).write.option("header", "true").csv(path)


def rejoined_csv(text: str, descriptions: dict[str, str], key: str = "name", column: str = "description") -> str:
    """A CSV with one column replaced where its key has a new value; all other fields
    and their quoting stay as they are."""
    lines = text.splitlines(keepends=True)
    head = next(csv.reader([lines[0]]))
    at, put = head.index(key), head.index(column)
    out = [lines[0]]
    for line in lines[1:]:
        row = next(csv.reader([line]))
        new = descriptions.get(row[at])
        if new is None or new == row[put]:
            out.append(line)
            continue
        row[put] = new
        held = io.StringIO()
        csv.writer(held, lineterminator=line[len(line.rstrip("\r\n")) :]).writerow(row)
        out.append(held.getvalue())
    return "".join(out)


def copy_published(rows: Iterable[dict]) -> list[dict]:
    """Carry out plan rows (src, dst, status) and say what became of each. Runs on the
    executors of a shared file system through mapInPandas, or on the driver."""
    import shutil

    out = []
    for row in rows:
        done = "skipped"
        if row["status"] in ("would-create", "would-overwrite"):
            if os.path.exists(row["src"]):
                os.makedirs(os.path.dirname(row["dst"]), exist_ok=True)
                shutil.copyfile(row["src"], f"{row['dst']}.part")
                os.replace(f"{row['dst']}.part", row["dst"])
                done = "written"
            else:
                done = "missing-source"
        elif row["status"] == "would-remove" and os.path.exists(row["dst"]):
            os.remove(row["dst"])
            done = "removed"
        out.append({**row, "done": done})
    return out
