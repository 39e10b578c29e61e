"""Clashing names, odd ids, bitmaps, hot groups and brute force of whole queries."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveloom.llm import bpe, common, mixing, neardup, queries, sharding, suffixdedup, tokenfile, topk, toxicity

LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
ROWS = [(1, LONG, "a", 5), (2, LONG + " more", "a", 6), (2, LONG + " more", "a", 6), (3, None, None, 7), (None, "x y", "b", 8), (4, "", "b", 9), (5, "short text here", "b", 1)]


@pytest.mark.parametrize("name", ["_deal", "_bucket", "_found", "_id", "_bits", "_mix_row", "_mix_taken", "_mix_parts", "_kept_id", "rep", "component_id", "kept"])
def test_clashing_names(spark, name):
    docs = spark.createDataFrame(ROWS, f"doc_id long, text string, source string, {name} long")
    for out in (neardup.without_near_duplicates(spark, docs), suffixdedup.remove_repeats(spark, docs), mixing.mixed_documents(spark, docs)):
        assert out.columns == docs.columns
        assert {r[name] for r in out.collect()} <= {5, 6, 7, 8, 9, 1}


def test_repeated_ids_leave_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n long")
    left = neardup.without_near_duplicates(spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]


def test_ids_by_bitmap(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(500)] + [(None, 0)], "doc_id long, _bits long")
    ids = spark.createDataFrame([(i,) for i in range(0, 900, 7)], "n long")
    want = {i for i in range(0, 500, 7)}
    assert {r[0] for r in common.with_ids(rows, "doc_id", ids).collect()} == want
    out = common.without_ids(rows, "doc_id", ids)
    assert out.columns == rows.columns and {r[0] for r in out.collect()} == (set(range(500)) - want) | {None}
    none = spark.createDataFrame([], "n long")
    assert common.with_ids(rows, "doc_id", none).count() == 0 and common.without_ids(rows, "doc_id", none).count() == 501


def test_similar_sets_share_a_size_class(spark):
    pairs = [(a, b) for a in range(1, 400, 3) for b in range(a, int(a / 0.8) + 1)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    apart = frame.where(~F.arrays_overlap(neardup._size_classes(F.col("a"), 80), neardup._size_classes(F.col("b"), 80)))
    assert apart.count() == 0


def test_deals_agree(spark):
    ids = np.array([0, 1, -1, 5, 2**31, -(2**40), 2**62, 123456789], np.int64)
    frame = spark.createDataFrame([(int(i),) for i in ids], "doc_id long")
    got = [r[0] for r in frame.select(suffixdedup._deal_column(F.col("doc_id"), 37)).collect()]
    assert got == suffixdedup.deal_of(ids, 37).tolist()


def test_rows_without_id_are_measured(spark):
    docs = spark.createDataFrame([(None, "é" * 60), (None, None), (1, "é" * 60)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(spark, docs, digests=True).collect()}
    whole = hashlib.sha256(("é" * 60).encode()).hexdigest()
    assert got == {(None, 120, 0, whole), (None, 0, 0, hashlib.sha256(b"").hexdigest()), (1, 120, 0, whole)}


def test_places_of_a_token():
    r = np.random.default_rng(5)
    ids = r.integers(0, 40, 3000).astype(np.uint32)
    block = tokenfile.Block.build(ids)
    for value in (0, 7, 39, 40, 1000):
        assert block.places(value).tolist() == np.flatnonzero(ids == value).tolist()


def test_other_tokenizers_get_whole_texts():
    path = queries.tokenizer("byte_bpe_50k.json")
    encoder = tokenfile.WordEncoder(path)
    text = "Two  words, it's 12 É\n\nend"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokenfile._rules(queries.tokenizer("word_bpe_49k.json")) == (True, True)


def test_huge_components(spark):
    rows = [(50, [1e307, 1.0]), (1, [2.0**40, 3.0]), (2, [1.0, 2.0]), (100, [3.0, float(2**30)])]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert scores[100, 1] == 3 * 256 * 2**48 + 2**38 * 3 * 256
    assert scores[100, 2] < scores[100, 1] or (100, 2) not in scores


def test_digests_equal_the_library(spark, docs_table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.token_digests(docs_table, queries.tokenizer("byte_bpe_50k.json")).collect()}
    for r in docs_table.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        said = got[r["doc_id"]]
        assert said["n_tokens"] == len(ids)
        assert said["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert said["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_taken_words_equal_the_drawn_blocks(spark, docs_table):
    """op1 against a replay of its slots over the documents laid end to end."""
    sizes = common.stage(spark, docs_table.select("doc_id", "source", common.n_words(F.col("text")).alias("size")), "t")
    targets = common.stage(spark, mixing.source_targets(sizes), "t")
    index = {r["source"]: r["source_index"] for r in targets.collect()}
    laid = {(r["source"], r["doc_id"]): r["offset"] for r in mixing.with_offsets(sizes, "doc_id").collect()}
    words: dict[int, dict[int, int]] = {}
    for r in sizes.collect():  # which document holds each word of a source
        for k in range(r["size"]):
            assert words.setdefault(index[r["source"]], {}).setdefault(laid[r["source"], r["doc_id"]] + k, r["doc_id"]) == r["doc_id"]
    want: dict[int, int] = {}
    for s in mixing.draw_slots(spark, targets).collect():
        stream = words[s["source_index"]]
        for k in range(s["block"] * mixing.BLOCK_WORDS, s["block"] * mixing.BLOCK_WORDS + s["take"]):
            if k in stream:
                want[stream[k]] = want.get(stream[k], 0) + 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs_table).collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_shards_equal_a_ring_by_hand(spark):
    """op2: the counts that stay and move equal a walk around the ring, arc by arc."""
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(700)], "doc_id long, text string")
    got = sharding.shard_rows(spark, docs, 6).collect()
    arcs = {r["cell"]: (r["arc"], r["shard"]) for r in sharding.ring(spark, 6, sharding.VNODES, sharding.CELLS).collect()}
    cell = {r["doc_id"]: r["cell"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.CELLS)).alias("cell")).collect()}
    per_arc: dict[int, int] = {}
    for i in cell:
        per_arc[arcs[cell[i]][0]] = per_arc.get(arcs[cell[i]][0], 0) + 1
    room: dict[int, int] = {}
    for r in got:
        room[r["shard"]] = room.get(r["shard"], 0) + 1
    assert sorted(room.values()) == [116, 116, 117, 117, 117, 117]
    used, carried, moved = dict.fromkeys(room, 0), 0, 0
    for lap in (0, 1):  # what an arc's shard has no room for goes on clockwise
        for arc, shard in sorted(set(arcs.values())):
            n = 0 if lap else per_arc.get(arc, 0)
            kept = min(n, room[shard] - used[shard])
            taken = min(room[shard] - used[shard] - kept, carried)
            used[shard] += kept + taken
            moved += n - kept
            carried += n - kept - taken
    assert carried == 0 and used == room
    assert moved == sum(arcs[cell[r["doc_id"]]][1] != r["shard"] for r in got)


def test_conflicting_and_repeated_labels(spark):
    docs = spark.createDataFrame([(f"d{i}", ("awful scum trash talk " if i % 2 else "plain kind words here ") * 9) for i in range(80)] * 2, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(80)] + [("d1", 0), ("d0", 0), ("d3", 7), (None, 1)], "doc_id string, toxic int")
    model = toxicity.fit_tables(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[f"d{i}"]["predicted"] == i % 2 for i in range(80))
    assert all(r["held_out"] == (zlib.crc32(r["doc_id"].encode()) % 5 == 0) for r in got.values())
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "scum trash " * 30000), ("c", "scum trash " * 30000)], "doc_id string, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(odd, model).collect()}
    assert scores["a"] == scores["b"] and all(0 <= s <= 1 for s in scores.values()) and scores["c"] > 0.5
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    assert toxicity.fit_tables(docs.limit(0), labels).scorer()(b"any") == 0.0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{(i * 131 + k * k) % 997}" for k in range(80)), "en", f"s{i % 2}", 10) for i in range(20)]
    rows += [(3, rows[3][1], "en", "s1", 10), (30, None, None, None, None), (31, "", "en", "s1", 0), (None, rows[4][1] + " z", "en", "s0", 10), (32, " ".join(f"v{k * k % 9973}" for k in range(60000)), "en", "s0", 10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, frame in (("odd", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "odd")
        assert {r["doc_id"] for r in got} <= {*range(20), None, 32}
