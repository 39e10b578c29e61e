"""Grammar, lines, geometry, state and files on hand-made cases."""

import json
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.functions import grammar as g
from sieveloom.functions import lines as ln
from sieveloom.functions import tags as t
from sieveloom.operators import geometry as geo
from sieveloom.operators import metrics, rules, state, vectors
from sieveloom.plans import analytics, captions, curation, domain, images  # noqa: F401  (they register their queries)
from sieveloom.sources import files


def test_parse_positions_and_text():
    p = g.parse('safe, 2girls. On the left, red hair, dress. on the right, hat. Japanese text reads as "a, b. On the left", "c".')
    assert p["flat_tags"] == ["safe", "2girls"]
    assert [(c["prefix"], c["position"], c["tags"]) for c in p["clauses"]] == [
        ("On the ", "left", ["red hair", "dress"]),
        ("On the ", "right", ["hat"]),
        ("Japanese text reads as ", "", ['"a, b. On the left"', '"c"']),
    ]


def test_header_case_rules():
    assert g.parse("1girl, on the beach, smile")["clauses"] == []
    assert [c["position"] for c in g.parse("1girl, On the left, smile")["clauses"]] == ["left"]
    assert g.parse("a, ..., :d.")["flat_tags"] == ["a", "...", ":d"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab ,."\n「」On the left', max_size=60))
def test_spans_cover_their_text(caption):
    for s in g.tag_spans(caption):
        assert s["start"] < s["end"] and s["kind"] in ("header", "artist", "tag")
        assert caption[s["start"] : s["end"]].startswith(s["text"][:1])


def test_compose_and_flatten(spark):
    rows = spark.createDataFrame([(c,) for c in domain.CAPTIONS], "text string").select("text", g.parse_caption("text").alias("p"))
    out = {r["text"]: r for r in rows.select("text", g.compose(F.col("p.flat_tags"), F.col("p.clauses")).alias("again"), g.flatten_caption(F.col("p")).alias("flat")).collect()}
    two = domain.CAPTIONS[1]
    assert out[two]["again"] == two
    assert out[two]["flat"] == "safe, 2girls, @sincos, smile, red hair, dress, blue_hair, hat"
    once = rows.select(g.compose(F.col("p.flat_tags"), F.col("p.clauses")).alias("c"))
    twice = once.select("c", g.parse_caption("c").alias("p")).select("c", g.compose(F.col("p.flat_tags"), F.col("p.clauses")).alias("d"))
    assert all(r["c"] == r["d"] for r in twice.collect())


def test_plain_path_agrees(spark):
    texts = ["a, b", " a ,,b.", "1girl, long hair, ...", "x y"]
    rows = spark.createDataFrame([(c,) for c in texts], "text string").select(g.parse_plain(F.col("text")).alias("a"), g.parse_caption("text")["flat_tags"].alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_partition_drops_emptied_clauses(spark):
    row = spark.createDataFrame([("hat, cat. On the left, hat. On the right, dog.",)], "text string").select(g.parse_caption("text").alias("p"))
    kept, gone = g.partition_tags(F.col("p"), lambda tag, clause: tag == "hat")
    r = row.select(kept.alias("k"), gone.alias("g")).select(g.compose(F.col("k.flat_tags"), F.col("k.clauses")).alias("c"), "g").first()
    assert r["c"] == "cat. On the right, dog." and r["g"] == ["hat", "hat"]


def test_correct_order(spark):
    bag = ["long hair", "vocaloid", "@sincos", "hatsune miku", "1girl", "best quality"]
    kb = spark.createDataFrame([("vocaloid", "copyright", "", 1), ("hatsune miku", "character", "", 1), ("long hair", "general", "", 1)], "tag string, kind string, path string, posts int")
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(bag)], "key long, pos int, tag string")
    assert rules.correct_bags(rows, kb).first()["tags"] == ["best quality", "1girl", "hatsune miku", "vocaloid", "@sincos", "long hair"]


def test_implies(spark):
    cases = {("very long hair", "long hair"): True, ("no pants", "pants"): False, ("red bowtie", "bow"): True, ("diagonal-striped bowtie", "diagonal-striped bow"): True, ("hair", "hair"): False}
    rows = spark.createDataFrame([(a, b, w) for (a, b), w in cases.items()], "a string, b string, w boolean")
    assert rows.where(t.implies(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def test_people(spark):
    cases = [([], 0), (["1girl"], 1), (["1girl", "1boy"], 2), (["multiple girls"], 3), (["2girls", "1boy"], 4), (["1girl", "2boys"], 5), (["1boy"], 6), (["multiple boys"], 7), (["3girls"], 7), (["2others"], 7)]
    rows = spark.createDataFrame(cases, "tags array<string>, w int")
    assert rows.where(t.classify_people(F.col("tags")) != F.col("w")).count() == 0


def test_runaway_and_guard(spark):
    cases = [("あ" * 16, True), ("ab" * 8, True), ("x" * 15, False), ("…" * 40, False), ("123456789" * 3, True)]
    rows = spark.createDataFrame(cases, "c string, w boolean")
    assert rows.where(ln.is_runaway(F.col("c")) != F.col("w")).count() == 0
    composed = spark.createDataFrame([("é..",)], "c string").select(ln.normalize_read(F.col("c")).alias("c")).first()["c"]
    assert composed == unicodedata.normalize("NFC", "é") + "…"


def test_positions():
    two = np.array([[0, 0, 10, 10], [20, 0, 30, 10]], float)
    assert geo.position_names(two)[0] == ["left", "right"]
    diagonal = np.array([[0, 0, 10, 10], [20, 20, 30, 30]], float)
    assert geo.position_names(diagonal)[0] == ["top left", "bottom right"]
    assert geo.position_names(np.zeros((0, 4)))[0] == []
    assert geo.horizontal_names(5) == ["leftmost", "second from left", "third from left", "fourth from left", "rightmost"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 4), min_size=1, max_size=9))
def test_positions_name_every_box(raw):
    xy = np.array([[x, y, x + w + 1, y + h + 1] for x, y, w, h in raw], float)
    names, order = geo.position_names(xy)
    assert len(names) == len(xy) and all(names) and sorted(order) == list(range(len(xy)))


def test_suppress_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 0.0, 11.0, 10.0, 0.8), (1, 3, 50.0, 0.0, 60.0, 10.0, 0.1), (2, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], "image long, box int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted((r["image"], r["box"]) for r in geo.suppress(rows).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_average_precision_by_hand(spark):
    rows = spark.createDataFrame([(i, 0, s, y) for i, (s, y) in enumerate(((0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)))] + [(0, 1, 0.5, 0)], "sample int, tag int, score double, truth int")
    assert {r["tag"]: r["ap"] for r in metrics.average_precision(rows).collect()} == {0: pytest.approx(5 / 6), 1: None}


def test_components_of_a_chain(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i + 1, i) for i in range(9)], "a long, b long")
    got = {r["id"]: r["component"] for r in vectors.components(spark, nodes, edges).collect()}
    assert got == {i: 0 for i in range(10)} | {10: 10, 11: 11}


def test_dense_match_of_twins():
    grid = np.random.default_rng(1).normal(size=(8, 8, 16))
    one = vectors.pooled(grid, 4)
    assert vectors.matched_fraction(one, one) == 1.0
    assert vectors.matched_fraction(one, vectors.pooled(np.random.default_rng(2).normal(size=(8, 8, 16)), 4)) < 0.2


def test_history_keeps_the_newest(spark):
    edits = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(["a", "a", "", "b", "c", "c", "d"])], "key int, at int, order int, text string")
    assert [(r["seq"], r["text"]) for r in state.push_history(edits, 2).orderBy("seq").collect()] == [(3, "c"), (4, "d")]


def test_undo_removes_what_was_created(spark):
    targets = spark.createDataFrame([(1, "old")], "key long, text string")
    proposals = spark.createDataFrame([(1, "old", "new"), (2, "", "made"), (3, "was", "x")], "key long, before string, after string")
    plan = state.drift_plan(targets, proposals)
    assert {r["key"]: r["status"] for r in plan.collect()} == {1: "would-write", 2: "would-write", 3: "missing-caption"}
    after = state.applied(targets, plan)
    back = state.undone(after, state.undo_plan(after, plan.where("status = 'would-write'")))
    assert [(r["key"], r["text"]) for r in back.collect()] == [(1, "old")]


def test_files(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_text("1girl, smile")
    (root / "a" / "x.variants.txt").write_text("v0\t1girl")
    (root / "a" / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (root / "a" / "x.png").write_bytes(b"1234")
    (root / "y.webp").write_bytes(b"12")
    assert [tuple(r) for r in files.captions(spark, str(root)).collect()] == [("a/x", "1girl, smile")]
    found = files.unique_keys(files.images(spark, str(root)))
    assert sorted((r["key"], r["bytes"]) for r in found.collect()) == [("a/x", 4), ("y", 2)]
    assert [r["rel"] for r in files.images(spark, str(root), "a/*|b/*").collect()] == ["a/x.png"]
    tab = tmp_path / "h.txt"
    tab.write_text("# head\n1\t2\ta\tb\n\nbroken\n2\t3\tc\td\te\n")
    assert [tuple(r) for r in files.tab_rows(spark, str(tab), ["seq", "at", "by", "text"]).collect()] == [("1", "2", "a", "b"), ("2", "3", "c", "d\te")]
    ocr = tmp_path / "o.txt"
    ocr.write_text("1\t0,0,9,9\t0.5\t0.9\tsfx\tドン\n2\t0,0,9,9\t0.5\t0.9\thi\n3\t0,0,9,9\t0.9\told\nx\t1\n")
    assert [(r["seq"], r["det"], r["kind"], r["text"]) for r in files.ocr_rows(spark, str(ocr)).collect()] == [(1, 0.5, "sfx", "ドン"), (2, 0.5, "", "hi"), (3, 0.0, "", "old")]
    kb = tmp_path / "kb.csv"
    kb.write_text('name,category,post_count,description\nlong_hair,0,10,"[hair > length] long, ""very"""\n@Miku,4,x,\nlong hair,0,20,[a>b] again\n')
    assert {(r["key"], r["posts"], r["path"], r["description"]) for r in files.knowledge_base(spark, str(kb)).collect()} == {("long_hair", 20, "a > b", "again"), ("miku", 0, "", "")}
    cache = tmp_path / "t.json"
    cache.write_text(json.dumps({"long_hair": 0, "miku": 4}))
    assert {tuple(r) for r in files.tag_cache(spark, str(cache)).collect()} == {("long hair", 0), ("miku", 4)}
    led = tmp_path / "l.json"
    led.write_text('{"rel":"a","at":"1","note":"","moved":["x"]}\n{"rel":')
    with pytest.raises(Exception):
        files.ledger(spark, str(led)).collect()
    files.write_tab_rows(spark.createDataFrame([("1", "a")], "s string, t string"), str(tmp_path / "out"), "test")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# test", "1\ta"]


def test_stream_history(spark, tmp_path):
    from sieveloom.streaming.events import bounded_history

    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"key": 1, "order": i, "text": x}) for i, x in enumerate(["a", "a", "b", " ", "c"])))
    stream = spark.readStream.schema("key long, order long, text string").json(str(src))
    run = bounded_history(stream, 2).writeStream.format("memory").queryName("hist").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["seq"], r["text"]) for r in spark.table("hist").orderBy("seq").collect()] == [(2, "b"), (3, "c")]




def test_image_headers(spark):
    import struct
    import zlib

    from sieveloom.functions import images

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 5, 8, 6, 0, 0, 0))
    exif = b"Exif\0\0MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 8
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", (99) | (49 << 14) | (1 << 28))
    assert images.probe(png) == (8, 5, True) and images.probe(jpeg) == (30, 40, False) and images.probe(lossless) == (100, 50, True)
    assert images.probe(b"junk") == (None, None, None) and images.probe(b"\x89PNG\r\n\x1a\n") == (None, None, None)
    rows = spark.createDataFrame([(bytearray(png),), (None,)], "content binary").select(images.image_header("content").alias("h")).select("h.*")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(8, 5, True), (None, None, None)], key=str)


def test_services(spark):
    from sieveloom.plans import services

    images = spark.createDataFrame([("b/Two.png", "b/Two"), ("a/one.png", "a/one"), ("a/Zed.png", "a/Zed")], "rel string, key string")
    assert [r["rel"] for r in services.items(images).collect()] == ["a/one.png", "a/Zed.png", "b/Two.png"]
    assert [r["rel"] for r in services.items(images, "TWO", "b/*").collect()] == ["b/Two.png"]
    text = lambda x: spark.createDataFrame([("a/one", x)], "key string, text string")
    past = spark.createDataFrame([("a/one", 1, "old"), ("a/one", 2, "older")], "key string, seq int, text string")
    assert [r["badge"] for r in services.item(images, [("revised", text("r")), ("source", text("s"))], past, "a/one").collect()] == ["revised", "source", "revised@2", "revised@1"]
    assert [(r["text"], r["kind"]) for r in services.spans(text("1girl, @x")).collect()] == [("1girl", "tag"), ("@x", "artist")]
    words = spark.createDataFrame([("apple",), ("smile",), ("x",), ("Hat",)], "word string")
    assert [r["word"] for r in services.erasure_pool(words, spark.createDataFrame([("smile",)], "tag string"), [lambda w: len(w) == 5]).collect()] == ["apple"]


def test_masks(spark):
    from sieveloom.operators import masks

    mask = np.zeros((20, 30), bool)
    mask[2:6, 3:9] = mask[10:18, 20:24] = True
    mask[0, 29] = True
    assert masks.component_boxes(mask, 2) == [(20, 10, 24, 18), (3, 2, 9, 6)]
    rows = spark.createDataFrame([("m", 0, 1, 2, bytearray([255, 9])), ("m", 1, 1, 4, bytearray([0, 255, 255, 255]))], "name string, place int, height int, width int, alpha binary")
    assert bytes(masks.merge_masks(rows).first()["alpha"]) == bytes([0, 9])
    assert masks.mask_overlap(np.ones(4, bool), np.array([1, 0, 0, 0], bool)) == 1.0 and masks.mask_overlap(np.zeros(4, bool), np.ones(4, bool)) is None


def test_line_dedupe_keys_on_the_whole_text(spark, tmp_path):
    from sieveloom.plans.registry import QUERIES

    texts = ["hello there", "hello you", "hello there\u3000\n", "he", " hello you", "help"]
    rows = [(1, i, "user", x) for i, x in enumerate(texts)] + [(1, 9, "system", "he"), (2, 0, "user", "he")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["t01_t03_whole_line_dedupe"](spark, str(tmp_path)).collect()
    assert sorted((r["page"], r["seq"]) for r in got) == [(1, 0), (1, 1), (1, 3), (1, 5), (1, 9), (2, 0)]


def test_crops_and_masks_take_every_box(spark, sf_dir):
    from sieveloom.plans.registry import QUERIES

    n = domain.boxes(spark, sf_dir).count()
    assert QUERIES["k24_mask_coverage_all"](spark, sf_dir).count() == n
    assert QUERIES["r08_r10_clause_tags"](spark, sf_dir).where("crop > 3").count() > 0
    assert QUERIES["r09_bag_removals_all"](spark, sf_dir).where("crop > 3").count() > 0


def test_overwrite_keeps_whole_lines(spark, tmp_path):
    from sieveloom.plans.registry import QUERIES

    rows = [(1, 0, "user", "abcdef"), (1, 0, "user", "abcxyz"), (2, 0, "system", "gone"), (2, 1, "user", "a long line")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["h15_b03_overwrite_whole_text"](spark, str(tmp_path)).collect()
    assert sorted((r["page"], r["seq"], r["text"]) for r in got) == [(1, 0, "abcdef"), (1, 0, "abcxyz"), (2, 1, "a long line|user")]


def test_suppression_audit_equals_a_replay(spark, sf_dir):
    from sieveloom.plans.images import FLOORS
    from sieveloom.plans.registry import QUERIES

    def iou(a, b):
        both = max(min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), 0) * max(min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]), 0)
        area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        return both / (area(a) + area(b) - both)

    images = {}
    for r in domain.boxes(spark, sf_dir).collect():
        images.setdefault(r["image"], []).append(r)
    pairs, counts = set(), {}
    for floor in FLOORS:
        kept = gone = 0
        for image, rows in images.items():
            keep = []
            for r in sorted((r for r in rows if r["score"] >= floor), key=lambda r: (-r["score"], r["box"])):
                hit = next((k for k in keep if iou(r, k) >= 0.65), None)
                if hit is None:
                    keep.append(r)
                else:
                    gone += 1
                    pairs.add((floor, image, hit["box"], r["box"]))
            kept += len(keep)
        counts[floor] = (kept, gone)
    assert sum(g for _, g in counts.values()) > 0
    assert {tuple(r)[:4] for r in QUERIES["k25_suppression_pairs"](spark, sf_dir).collect()} == pairs
    assert {r["floor"]: (r["kept"], r["suppressed"]) for r in QUERIES["k25_suppression_audit"](spark, sf_dir).collect()} == counts


def test_span_and_sound_queries_read_their_tables(spark, sf_dir, tmp_path):
    from sieveloom.plans import analytics
    from sieveloom.plans.registry import QUERIES

    docs = [(100 + i, c) for i, c in enumerate(domain.CAPTIONS)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, i, "user", x) for i, x in enumerate(analytics.SOUNDS)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted((i, s["start"], s["end"]) for i, c in docs for s in g.tag_spans(c))
    assert sorted((r["id"], r["start"], r["end"]) for r in QUERIES["g01_z05_caption_spans"](spark, str(tmp_path)).collect()) == want
    quoted = {r["id"] + 100: r["spans"] for r in QUERIES["g06_quoted_spans"](spark, sf_dir).collect()}
    assert {r["id"]: r["spans"] for r in QUERIES["g06_document_quoted_spans"](spark, str(tmp_path)).collect()} == quoted
    words = {r["text"]: (r["sound"], r["kind"]) for r in QUERIES["f31_f32_sound_words"](spark, sf_dir).collect()}
    assert {analytics.SOUNDS[r["seq"]]: (r["sound"], r["kind"]) for r in QUERIES["f31_f32_line_sounds"](spark, str(tmp_path)).collect()} == words


def test_near_pairs_take_the_rounded_cosine(spark, tmp_path):
    import duckdb
    from sieveloom.plans.registry import ORACLES, QUERIES

    cosines = {1: 0.2999998, 2: 0.2999993, 3: 0.31, 4: float("nan")}
    rows = [(0, 7, [1.0, 0.0]), (9, 7, None), *((i, 7, [x, -((1 - x * x) ** 0.5) if i % 2 else (1 - x * x) ** 0.5]) for i, x in cosines.items())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(map(str, con.sql(f"select a, b, cosine from ({ORACLES['j13_v01_v05_near_pairs']})").fetchall()))
    got = QUERIES["j13_v01_v05_near_pairs"](spark, str(tmp_path)).select("a", "b", "cosine").collect()
    assert (0, 1, 0.3) in [tuple(r) for r in got] and sorted(str(tuple(r)) for r in got) == want


def test_masks_merge_a_batch_at_a_time(spark):
    import pandas as pd
    from sieveloom.operators import masks

    rng = np.random.default_rng(1)
    rows = [(f"m{i // 3:04}", i % 3, 1, 16, rng.integers(0, 256, 16, np.uint8).tobytes()) for i in range(3000)]
    columns = ["name", "place", "height", "width", "alpha"]
    batches = [pd.DataFrame(rows[i : i + 1000], columns=columns) for i in range(0, 3000, 1000)]
    got = list(masks.merged(iter(batches)))
    want = [(rows[i][0], bytes(map(min, *(r[4] for r in rows[i : i + 3])))) for i in range(0, 3000, 3)]
    assert len(got) == 4 and [(r.name, r.alpha) for g in got for r in g.itertuples(index=False)] == want
    # sizes that differ, a name that goes on in the next batch, a null name
    odd = [pd.DataFrame([("a", 0, 1, 2, b"\xff\x09"), ("a", 1, 1, 4, b"\x00\xff\xff\xff"), ("b", 0, 1, 1, b"\x07")], columns=columns)]
    odd += [pd.DataFrame([("b", 1, 2, 2, b"\x05\x01\x01\x01"), (None, 0, 1, 1, b"\x03"), (None, 1, 1, 1, b"\x02")], columns=columns)]
    assert [tuple(r) for g in masks.merged(iter(odd)) for r in g.itertuples(index=False)] == [("a", 1, 2, b"\x00\x09"), ("b", 1, 1, b"\x05"), (None, 1, 1, b"\x02")]
    bits = spark.sql("select a, b from (values (-3, 2), (1, 3), (3, 1), (2, 9), (null, 3), (0, null)) as t(a, b)").select(masks.mask_bits(F.col("a"), F.col("b"), 4).alias("m"))
    left = bits.select("m", masks.ignore_mask("m").alias("l")).collect()
    assert [bytes(r["m"]).hex() for r in left] == ["ffff0000", "00ffff00", "00000000", "0000ffff", "00000000", "00000000"]
    assert [bytes(r["l"]).hex() for r in left] == ["0000ffff", "ff0000ff", "ffffffff", "ffff0000", "ffffffff", "ffffffff"]


def test_clauses_of_like_crops_are_chosen_once(monkeypatch):
    import pyarrow as pa
    from sieveloom.operators import clauses as cl

    policy = cl.Policy(max_tags=3, max_novel=1, group_of={"red": "hair", "blue": "hair", "sit": "pose", "run": "pose"}, priority=("hair",), exclusive=frozenset({"hair"}), subject=frozenset({"hair", "pose"}), characters=frozenset({"miku"}), name_confidence=0.6)
    rng, tags = np.random.default_rng(3), ["red", "blue", "sit", "run", "miku", "hat", None]
    bags = [["red", "miku"], ["sit", "hat", "blue"], []]
    images = {}
    for image in range(400):
        crops = {c: {tags[k]: float(rng.integers(1, 9)) / 8 for k in rng.permutation(7)[: rng.integers(1, 5)]} for c in range(rng.integers(1, 5))}
        images[image] = (bags[image % 3], image % 4 == 0, crops)
    rows, want = [], []
    for image, (bag, again, crops) in images.items():
        held = [x for kept in crops.values() for x in kept if x is not None]
        shared = frozenset(x for x in held if held.count(x) == len(crops) and len(crops) > 1)
        own = frozenset(x for x in held if held.count(x) == 1)
        for c, kept in crops.items():
            rows += [(image, c, x, y, bag, again) for x, y in sorted(kept.items(), key=lambda r: (-r[1], r[0] or ""))]
            named = dict(sorted(((x, y) for x, y in kept.items() if x is not None)))
            want += [(image, c, i, x) for i, x in enumerate(cl.choose(named, {}, frozenset(bag), own, shared, policy, repeated=again))]
    schema = pa.schema([("image", pa.int64()), ("crop", pa.int32()), ("tag", pa.string()), ("score", pa.float64()), ("bag", pa.list_(pa.string())), ("repeated", pa.bool_())])
    batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    tuples = lambda parts: [tuple(r.values()) for p in parts for r in p.to_pylist()]
    for size in (1, 7, 100, len(batch)):
        assert tuples(cl.clause_rows((batch.slice(i, size) for i in range(0, len(batch), size)), policy)) == want
    monkeypatch.setattr(cl._Chooser, "MOST", 5)
    assert tuples(cl.clause_rows((batch.slice(i, 50) for i in range(0, len(batch), 50)), policy)) == want
    asked, choose = [], cl.choose
    monkeypatch.setattr(cl, "choose", lambda *a, **k: asked.append(1) or choose(*a, **k))
    like = [(image, c, "sit", 0.5 + image / 9999, ["sit"], False) for image in range(1000) for c in range(3)]
    one = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in like], schema)
    assert sum(len(p) for p in cl.clause_rows(iter([one]), policy)) == 0 and len(asked) == 1


def test_dense_matches_in_the_blocks_that_find_the_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64))
    rows = [(i, i % 2, (base[i % 6] + rng.normal(size=64) * rng.choice([0, 0.3, 1])).tolist()) for i in range(60)] + [(60, 0, None), (61, 0, [0.0] * 64), (62, 0, [float("nan")] * 64)]
    features = spark.createDataFrame(rows, "id long, bucket int, vector array<double>").select("id", "bucket", "vector", F.lit(4).alias("side"), F.col("vector").alias("grid"))
    pairs = vectors.near_pairs(features, 0.25).where("not isnan(cosine)").select("a", "b").collect()
    for cells, least, ratio in ((4, 0.5, 0.99), (3, 0.2, 0.9), (1, 0.1, 1.0)):
        pooled = {i: vectors.pooled(np.array(x).reshape(4, 4, -1), cells) for i, _, x in rows if x}
        want = {(a, b): round(vectors.matched_fraction(pooled[a], pooled[b], least, ratio), 6) for a, b in pairs}
        for block in (2048, 7):
            got = vectors.near_dense_matches(features, 0.25, cells, least, ratio, block).collect()
            assert len(got) == len(want) > 100 and {(r["a"], r["b"]): r["matched"] for r in got} == want
    got = vectors.dense_matches(spark.createDataFrame(pairs), features.select("id", "side", "grid"), 1, 0.1, 1.0).collect()
    assert {(r["a"], r["b"]): r["matched"] for r in got} == want
    many = np.stack([vectors.pooled(rng.normal(size=(4, 4, 4)), 4) for _ in range(9)])
    a, b = rng.integers(0, 9, 5000), rng.integers(0, 9, 5000)
    assert vectors.matched_fractions(many, a, b, 0.5, 0.99).tolist() == [vectors.matched_fraction(many[i], many[j], 0.5, 0.99) for i, j in zip(a, b, strict=True)]
    assert vectors.matched_fraction(many[0], many[0], 0.5, 0.99) == 1.0


def test_clause_tags_broadcast_no_bags(spark, sf_dir):
    from sieveloom.plans.registry import QUERIES

    plan = QUERIES["r08_r10_clause_tags"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
