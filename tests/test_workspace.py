"""Readers, writers and stage operators on hand cases."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveloom.operators import curation, stages
from sieveloom.sources import workspace as w


def test_walk_enters_a_folder_once(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("1")
    os.symlink(tmp_path / "a", tmp_path / "b")
    os.symlink(tmp_path, tmp_path / "a/loop")
    assert w.safe_walk(str(tmp_path)) == [f"{tmp_path}/a/x.txt"]


def test_captions_of_roots(spark, tmp_path):
    for name, text in (("one/b.txt", "B"), ("one/.hidden/c.txt", "C"), ("two/a.txt", "A"), ("two/a.png", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = w.captions_of_roots(spark, [f"{tmp_path}/two", f"{tmp_path}/none", f"{tmp_path}/one"]).orderBy("root_rank", "rel").collect()
    assert [tuple(r) for r in got] == [(0, "a.txt", "A"), (2, "b.txt", "B")]


def test_variants_and_candidates(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# head\nv1\t a, b\t c\n\nbroken\n")
    assert [tuple(r) for r in w.variants(spark, f"{tmp_path}/v.txt").collect()] == [("v1", " a, b\t c")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        w.variants(spark, f"{tmp_path}/none.txt").collect()
    assert w.knowledge_candidates(["r", "m"], "kb.csv", "ko") == ["r/kb.ko.csv", "r/kb.en.csv", "r/kb.csv", "m/kb.ko.csv", "m/kb.en.csv", "m/kb.csv"]
    assert w.knowledge_candidates(["r"], "kb.csv", "en") == ["r/kb.en.csv", "r/kb.csv"]


def test_vocabulary(spark, tmp_path):
    w.write_json({"tags": [{"name": "Long_Hair", "index": 0, "category": "general"}, {"name": "é", "index": 1, "category": "general"}]}, f"{tmp_path}/v.json")
    assert "é" in (tmp_path / "v.json").read_text() and not (tmp_path / "v.json").read_text().endswith("\n")
    assert [r["name"] for r in w.vocabulary(spark, f"{tmp_path}/v.json", fold=True).orderBy("index").collect()] == ["long hair", "é"]
    assert w.names_by_category(w.vocabulary(spark, f"{tmp_path}/v.json")).collect()[0]["names"] == ["Long_Hair", "é"]


def test_rule_and_group_files(tmp_path):
    pytest.importorskip("yaml")
    path = f"{tmp_path}/g.yaml"
    write = lambda s: (tmp_path / "g.yaml").write_text(s)
    write("version: 1\nhair:\n  mode: softmax_when_solo\n  sentinel: true\n  tags: [red hair, blue hair]\nother:\n  tags: [hat]\n")
    assert w.group_file(path) == [("hair", "softmax_when_solo", 0, "red hair"), ("hair", "softmax_when_solo", 1, "blue hair"), ("other", "multilabel", 0, "hat")]
    for bad in ("a:\n  mode: best\n", "a:\n  tags: [x]\nb:\n  tags: [x]\n", "a:\n  sentinel: true\n  tags: [x]\n"):
        write(bad)
        with pytest.raises(ValueError):
            w.group_file(path)
    write("aliases: {a: b}\nremove: [c]\n")
    assert w.rule_file(path) == {"aliases": {"a": "b"}, "remove": ["c"], "dedup": {}, "replacements": []}
    write("alias: {a: b}\n")
    with pytest.raises(ValueError):
        w.rule_file(path)


def test_wiki_reads_four_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", "body", False, 1), ("b", "B", "x", True, 2), ("c", "C", "y", None, 3)], "tag string, title string, body string, is_deleted boolean, views int")
    rows.write.parquet(f"{tmp_path}/wiki")
    got = w.wiki(spark, f"{tmp_path}/wiki")
    assert sorted(r["tag"] for r in got.collect()) == ["a", "c"]
    assert "views" not in got._jdf.queryExecution().executedPlan().toString()


def test_caches_refuse_other_stamps(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5)], "stem string, score double")
    w.write_cache(rows, f"{tmp_path}/c", "v1")
    assert w.read_cache(spark, f"{tmp_path}/c", "v1").collect() == rows.collect()
    with pytest.raises(ValueError, match="v1"):
        w.read_cache(spark, f"{tmp_path}/c", "v2")


def test_snapshot_and_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "name string, n int")
    w.write_snapshot({"vocab": rows, "groups": rows}, f"{tmp_path}/s")
    with pytest.raises(FileNotFoundError, match="thresholds"):
        w.checkpoint_tables(spark, f"{tmp_path}/s")
    assert set(w.checkpoint_tables(spark, f"{tmp_path}/s", ("vocab",))) == {"vocab", "groups"}


def test_manifest_round_trip_and_matches(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"groups": [{"id": 3, "members": [{"rel": "a.png", "score": 1.0}, {"rel": "b.png", "score": 0.9}]}]}))
    groups = w.manifest(spark, f"{tmp_path}/m.json")
    assert sorted(r["member"] for r in groups.collect()) == ["a.png", "b.png"]
    w.write_manifest(groups, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").collect()[0]["members"][0]["rel"] == "a.png"
    rows = spark.createDataFrame([("x", 9, 0.1), ("y", 2, 0.3), ("z", 2, 0.8)], "source string, hamming int, score double")
    w.write_matches(rows, f"{tmp_path}/csv")
    assert [r["source"] for r in spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect()] == ["z", "y", "x"]


def test_rejoined_csv_leaves_other_fields():
    text = 'name,description,n\r\na,"old, text",1\r\n"b",plain,"2"\r\n'
    got = w.rejoined_csv(text, {"a": "new, text"})
    assert got == 'name,description,n\r\na,"new, text",1\r\n"b",plain,"2"\r\n'


def test_masks_and_copies(spark, tmp_path):
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/sub/a.png").write_bytes(b"1")
    assert [r["folder"] for r in w.masks(spark, f"{tmp_path}/m").collect()] == ["sub"]
    rows = [{"src": f"{tmp_path}/m/sub/a.png", "dst": f"{tmp_path}/o/a.png", "status": "would-create"}, {"src": "none", "dst": f"{tmp_path}/o/b.png", "status": "would-overwrite"}, {"src": "", "dst": f"{tmp_path}/m/sub/a.png", "status": "would-remove"}, {"src": "x", "dst": "y", "status": "identical"}]
    assert [r["done"] for r in w.copy_published(rows)] == ["written", "missing-source", "removed", "skipped"]
    assert (tmp_path / "o/a.png").read_bytes() == b"1" and not (tmp_path / "m/sub/a.png").exists()


def test_perceptual_hashes_equal_brute_force(spark):
    r = np.random.default_rng(3)
    grey = r.normal(size=(5, 32, 32))
    frame = spark.createDataFrame(pd.DataFrame({"key": range(5), "grey": [g.reshape(-1).tolist() for g in grey]}))
    got = {x["key"]: x["phash"] for x in curation.perceptual_hashes(frame).collect()}
    for k, g in enumerate(grey):
        low = np.zeros((8, 8))
        for a in range(8):
            for b in range(8):
                low[a, b] = sum(np.cos(np.pi * (2 * a + 1) * i / 64) * g[i, j] * np.cos(np.pi * (2 * b + 1) * j / 64) for i in range(32) for j in range(32))
        bits = (low > np.median(low[1:])).reshape(-1)
        want = int("".join("01"[int(x)] for x in bits), 2)
        assert got[k] == (want - 2**64 if want >= 2**63 else want)
    near = frame.limit(1).select(curation.hash_distance(F.lit(0b1011), F.lit(0b0001)).alias("h")).first()
    assert near["h"] == 2


def test_uncropped():
    mask = np.array([[0, 10], [20, 30]], np.uint8)
    out = curation.uncropped(mask, (1, 0, 5, 2), (6, 3))
    assert out.tolist() == [[255, 0, 0, 10, 10, 255], [255, 20, 20, 30, 30, 255], [255] * 6]


def test_caption_write_keeps_the_invariants(spark):
    captions = spark.createDataFrame([("a", "old"), ("b", " "), ("c", "same")], "key string, text string")
    history = spark.createDataFrame([("a", 1, "x", "first"), ("c", 4, "x", "same")], "key string, seq int, by string, text string")
    variants = spark.createDataFrame([("a", "v1"), ("d", "v1")], "key string, label string")
    writes = spark.createDataFrame([("a", "new"), ("b", "b new"), ("c", "c new")], "key string, text string")
    after, past, left = stages.caption_write(captions, history, variants, writes, "autotag", limit=1)
    assert sorted(map(tuple, after.collect())) == [("a", "new"), ("b", "b new"), ("c", "c new")]
    assert sorted(map(tuple, past.collect())) == [("a", 2, "autotag", "old"), ("c", 4, "x", "same")]
    assert [tuple(r) for r in left.collect()] == [("d", "v1")]


def test_autotag_modes(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    captions = spark.createDataFrame([(1, ["safe", "a"])], "key int, tags array<string>")
    new = spark.createDataFrame([(1, ["general", "A", "b"]), (2, ["c"])], "key int, tags array<string>")
    got = lambda mode: {r["key"]: (r["proposed"], r["status"]) for r in stages.autotag_proposals(images, captions, new, mode).collect()}
    assert got("missing") == {1: ("safe, a", "has-caption"), 2: ("c", "ok"), 3: ("", "no-prediction")}
    assert got("merge")[1] == ("safe, a, b", "ok")
    assert got("overwrite")[1] == ("general, A, b", "ok")
    with pytest.raises(ValueError):
        got("other")
