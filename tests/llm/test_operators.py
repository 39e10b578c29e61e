"""The ten operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sieveloom.llm import bpe, mixing, neardup, quality, queries, sharding, suffixdedup, tokenfile, topk, toxicity, urlfilter  # noqa: E402
from sieveloom.llm.oracles import ORACLES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \t\n", "en", "a", 3, None, None), (4, "one", "en", None, 3, None, None), (None, "two words", "en", "b", 9, "y", 2),
    (5, "tie tie tie", "en", "b", 11, "y", 2), (5, "tie tie tie", "en", "b", 11, "y", 2), (6, "Ünï çödé 🙂 ends", "fr", "c", 15, "y", 2), (7, "w " * 30000, "en", "a", 60000, "y", 2), (8, "a\x00b <|endoftext|> #$", "en", "c", 10, "y", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, duck, rows_of):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_document_is_there(name, spark, sf_dir, docs):
    got = queries.QUERIES[name](spark, sf_dir)
    if "doc_id" in got.columns:
        assert got.count() == docs.count() and got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


# 1 ---------------------------------------------------------------------------
def _water_fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in held]
        left = total - sum(held.values())
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return held | {s: level * w[s] for s in rest}
        held |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 500, "c": 30, None: 7}, {"a": 5}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(_water_fill(sizes))


def test_mix_meets_targets_and_repeats(spark, docs):
    first = mixing.mix(spark, docs, block=64, seed=3)
    rows = first.toPandas()
    per = rows.groupby("source").agg({"taken": "sum", "target": "first", "size": "sum"})
    assert (per["taken"] - per["target"]).abs().max() <= 1
    assert (rows["taken"] <= 3 * rows["size"]).all()
    assert per["target"].to_dict() == pytest.approx(_water_fill(per["size"].to_dict()))
    again = mixing.mix(spark, docs.repartition(7), block=64, seed=3).toPandas()
    key = ["doc_id"]
    assert rows.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(9)).alias("p")).toPandas()["p"]
        assert sorted(got) == list(range(n))


def test_mixed_documents_take_whole_words(spark, odd):
    rows = mixing.mixed_documents(spark, odd, block=4).collect()
    plan = mixing.mix(spark, odd, block=4).where("doc_id is not null").groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert rows and rows[0].__fields__ == odd.columns
    assert abs(sum(got.values()) - sum(r["t"] for r in plan)) <= 3 * 4 + 6


def test_mixed_documents_have_the_words_drawn(spark):
    """One long hot document, one that straddles borders, and a source read again and again."""
    texts = [(1, "hot", 203), (2, "hot", 30), (3, "mid", 9), (4, "mid", 50), (5, "up", 11), (6, "up", 1)]
    rows = [(i, " ".join(f"{source}{i}_{k}" for k in range(n)), source) for i, source, n in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = dict(block=8, weights=(1, 2, 5), cap=4)
    sizes = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "source", F.size(F.split("text", " ")).cast("long").alias("size")).cache()
    laid, spans = mixing.mix_spans(spark, sizes, key="k", **options)
    at = {(r["source_index"], r["offset"]): r for r in laid.collect()}
    words = {i: text.split() for i, text, _ in rows}
    passes = collections.defaultdict(list)
    for s in spans.collect():
        r = at[s["source_index"], s["offset"]]
        sweep = s["draw"] // -(-r["source_size"] // 8)
        passes[r["doc_id"], sweep] += range(s["first"] - s["offset"], s["last"] - s["offset"])
    want = sorted((i, " ".join(words[i][k] for k in sorted(ks))) for (i, _), ks in passes.items())
    got = sorted((r["doc_id"], r["text"]) for r in mixing.mixed_documents(spark, docs, **options).collect())
    assert got == want
    assert any(len(ks) < len(words[i]) and sorted(ks) != list(range(len(ks))) for (i, _), ks in passes.items())


# 2 ---------------------------------------------------------------------------
def test_shards_are_even_and_gapless(spark, docs):
    rows = sharding.shard_rows(spark, docs, 24).toPandas()
    n = rows.groupby("shard").size()
    assert len(rows) == docs.count() and n.max() - n.min() <= 1 and set(n.index) <= set(range(24))
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows.itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_walk_moves_only_the_overflow(spark):
    counts = spark.createDataFrame([(0, 0, 10), (1, 1, 0), (2, 2, 2)], "arc long, shard int, n long")
    rows = sharding.walk(counts, 3).collect()
    kept, taken = collections.Counter(), collections.Counter()
    for r in rows:
        kept[r["shard"]] += r["kept"]
        taken[r["shard"]] += r["taken"]
    assert kept == {0: 4, 1: 0, 2: 2} and taken == {0: 0, 1: 4, 2: 2}


def test_few_movers_when_a_shard_comes(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(spark, rows, 8).collect()}
    new = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(spark, rows, 9).collect()}
    assert sum(old[k] != new[k] for k in old) < 0.45 * len(old)


# 3 ---------------------------------------------------------------------------
def _components(texts, words, percent=80):
    sets = {}
    for i, x in texts:
        w = WORD.findall((x or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    r = np.random.default_rng(words)
    rows = []
    for family in range(6):
        base = [f"w{family}_{x}" for x in r.integers(0, 400, 60)]
        for copy in range(12):
            text = list(base)
            for at in r.integers(0, 60, copy // 3):
                text[at] = f"n{r.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, x) for k, x in enumerate(["", None, " ", "one", "One", "ONE two", "one two", "x y z", "x Y z"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark, docs, words=words).collect()}
    assert got == _components(rows, words)


def test_family_without_a_good_hub(spark, monkeypatch):
    """A chain whose least member is like its neighbours only, in one bucket."""
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[: 100 - 4 * k] + [f"z{i}" for i in range(4 * k)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "ROWS", 1)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark, docs, words=1).collect()}
    assert got == {i: c for i, (_, c) in _components(rows, 1).items()}


def test_block_links_match_sets():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(20, 50))) for _ in range(40)]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    label = np.arange(40)
    want = {(i, j) for i in range(40) for j in range(40) if i != j and 100 * len(set(sets[i]) & set(sets[j])) >= 50 * len(set(sets[i]) | set(sets[j]))}
    a, b = neardup.block_links(np.arange(40), np.zeros(40, int), label, cuts, np.concatenate(sets), True, 50)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    part = label % 2
    a, b = neardup.block_links(np.arange(40), part, label, cuts, np.concatenate(sets), False, 50)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in want if part[i] == 0 and part[j] == 1}


# 4 ---------------------------------------------------------------------------
def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tokenfile.write_tokens(spark, docs, path, str(tmp_path / "f"), partitions=3)
    rows = tokenfile.read_documents(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    lib, start = Tokenizer.from_file(path), 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*lib.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r["ids"]) == ids.tobytes()
        start += len(ids)
    everything = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")
    places = sorted(r["place"] for r in tokenfile.find_occurrences(spark, str(tmp_path / "f"), 2).collect())
    assert places == np.flatnonzero(everything == 2).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=1500))
def test_wavelet_matrix(ids):
    x = np.array(ids, np.uint32)
    b = tokenfile.Block.build(x)
    assert (b.ids() == x).all()
    for i in range(0, len(x), 97):
        assert b.access(i) == x[i] and b.rank(int(x[i]), i) == int((x[:i] == x[i]).sum())
        assert b.select(int(x[i]), b.rank(int(x[i]), i)) == i
    assert b.count(70001) == 0 and b.select(5, len(x)) == -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcAZ 09.,'’éÉßèñ<|>endoftext\n\t́İΣ中", max_size=40))
def test_words_equal_the_library(text):
    path = queries.tokenizer("word_bpe_49k.json")
    e = tokenfile.word_encoder(path)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# 5 ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    return bpe.vocabulary(path), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab ehlot\n'sé🙂<|endoftext|>", max_size=80), st.text(alphabet="a", max_size=200)))
def test_backtracking_equals_merging(byte_bpe, text):
    mine, lib = byte_bpe
    ids = np.frombuffer(mine.encode(text), "<u4")
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decoding_any_ids(byte_bpe, ids):
    mine, lib = byte_bpe
    assert mine.decode(np.array(ids, "<u4")) == lib.decode(ids, skip_special_tokens=False)


def test_pieces_of_every_code_point(byte_bpe):
    mine, lib = byte_bpe
    for cp in [*range(0, 0x3400), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)]:
        if not 0xD800 <= cp < 0xE000:
            s = f"a {chr(cp)}{chr(cp)} 1a"
            assert [m.span() for m in mine.pieces.finditer(s)] == [b for _, b in lib.pre_tokenizer.pre_tokenize_str(s)], hex(cp)


# 6 ---------------------------------------------------------------------------
def _judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rules", [urlfilter.RULES, (("block", "a.com", "/"), ("allow", "a.com", "/x"), ("block", "b.a.com", "/x/y"), ("allow", "com", ""), ("block", "b.a.com", ""))])
def test_urls(spark, rules):
    urls = [None, "", "no scheme", "http://", "http://COM/en/1", "https://x.example.com/en/7?q", "https://x.example.com/en/6", "http://example.net/de/8#t", "http://net/de/", "http://badexample.com/en/7",
            "http://xcom/en/", "http://a.com/x/y", "http://b.a.com/x/y/z", "http://b.a.com/", "http://c.b.a.com/x/y", "ftp://org/es/://x", "http://.com/en/", "http://a..com/en/"]
    pages = spark.createDataFrame([(i % 15, u, "h") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urlfilter.filter_urls(spark, pages, rules).collect())
    want = [(i % 15, *_judge(u, rules)) for i, u in enumerate(urls * 3)]
    assert got == sorted((a, b, c, d or "", e) for a, b, c, d, e in want)


# 7 ---------------------------------------------------------------------------
def _measures(text, coverage=quality.COVERAGE):
    text = text or ""
    w = WORD.findall(text)

    def covered(n):
        at = collections.defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
        return {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + n)}

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, own))
            seen.add(line)
    chars = sum(map(len, w))
    base = len(w) < 50 or 100 * len(covered(3)) > 50 * len(w)
    kept = not base and dup_chars <= quality.LINE_COVERAGE * chars and all(sum(len(w[j]) for j in covered(n)) <= most * chars for n, most in coverage.items())
    return len(w), chars, sum(text.count(s) for s in "#*$%&|<>"), dup, len(covered(3)), base, kept


def test_quality_equals_brute_force(spark, docs):
    lines = "alpha beta gamma delta epsilon\n"
    extra = [(10**6 + i, x) for i, x in enumerate([None, "", "x", lines * 20, " ".join(f"w{i}" for i in range(200)) + "\n" + lines * 6, "a b c d e f g h i j k l " * 9, "é " * 70, "\n\n a\n a\n", " ".join(f"u{i}" for i in range(60)) + " p q r s t u v p q r s t u v"])]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.quality(rows).collect()}
    assert got == {r["doc_id"]: _measures(r["text"]) for r in rows.collect()}
    kept = {r["doc_id"] for r in quality.passing(rows).collect()}
    assert kept == {k for k, v in got.items() if v[-1]}


def test_quality_rejects_long_repeats_of_every_length():
    for n in (6, 9, 15):
        unit = [f"w{i}" for i in range(n)]
        fresh = [f"f{i}" for i in range(9 * n)]
        text = []
        for k in range(8):
            text += unit + fresh[k * n : k * n + n]
        assert not _measures(" ".join(text + [f"g{i}" for i in range(20)]))[-1]


# 8 ---------------------------------------------------------------------------
def test_top_k_odd_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows[7] = (7, None)
    rows[8] = (8, [1.0, None] + [0.0] * 6)
    rows[9] = (9, [float("inf")] * 8)
    rows[10] = (10, rows[11][1])
    rows += [(None, [1.0] * 8), (50, rows[50][1])]
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted((-int(x @ v), i) for i, v in good if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 70), st.integers(1, 6), st.integers(0, 99), st.booleans())
def test_search_block_is_exact(n, width, k, seed, large):
    r = np.random.default_rng(seed)
    c = r.integers(-300, 300, (n, width)) * (1 << 22 if large else 1)
    q, ids = c[: max(1, n // 3)], np.arange(n)
    i, found, scores = topk.search_block(ids[: len(q)], q, ids, c, k)
    want = [(a, j, int(c[j] @ q[a])) for a in range(len(q)) for j in sorted((j for j in range(n) if j != a), key=lambda j: (-int(c[j] @ q[a]), j))[:k]]
    assert sorted(zip(i.tolist(), found.tolist(), scores.tolist(), strict=True)) == sorted(want)


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(30, 64)), r.normal(size=(30, 64))
    for s in topk.LEVELS:
        assert (topk._statistics(a, s) @ topk._statistics(b, s).T + 1e-9 >= a @ b.T).all()


# 9 ---------------------------------------------------------------------------
def _removed(rows):
    first, out = {}, {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def _noise(r, n):
    return "".join(r.choice(list("abcdefgh ,é\n"), n))


def test_repeats_equal_brute_force(spark):
    r = np.random.default_rng(9)
    passage, other = _noise(r, 140), _noise(r, 52)
    rows = [(k, _noise(r, 60) + (passage if k % 2 else passage[3 * k : 3 * k + 70]) + _noise(r, 20) + (other if k % 3 == 0 else "")) for k in range(60)]
    rows += [(60, passage), (61, passage), (62, passage[:49]), (63, passage[:50]), (64, ""), (65, None), (66, "ab" * 200), (67, "ab" * 100), (68, "é" * 60), (70, rows[3][1]), (70, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixdedup.remove_repeats(spark, docs, digests=True).collect()}
    assert got == _removed(sorted(set(rows), key=str))
    for hot_runs in (1, 20):
        assert got == {x["doc_id"]: tuple(x)[1:] for x in suffixdedup.remove_repeats(spark, docs, digests=True, hot_runs=hot_runs).collect()}


def test_hot_phrase_in_other_surroundings_is_dealt_out(spark):
    r = np.random.default_rng(3)
    phrase = "in the middle of the night, once"
    tails = [_noise(r, 25) for _ in range(8)]
    rows = [(k, _noise(r, 40) + phrase + (tails[k % 8] if k % 3 else _noise(r, 40)) + "x" * (k % 70)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixdedup.remove_repeats(spark, docs, digests=True, hot_runs=10).collect()}
    assert got == _removed(rows)


@given(st.lists(st.text("ab", min_size=50, max_size=160), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_equal_windows_share_the_finer_hash(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    _, first, count, h = suffixdedup.runs(data, offsets)
    _, parts, sizes, finer = suffixdedup.split_runs(data, first, count, h)
    covered = np.concatenate([np.arange(f, f + c) for f, c in zip(parts.tolist(), sizes.tolist(), strict=True)])
    assert covered.tolist() == np.concatenate([np.arange(f, f + c) for f, c in zip(first.tolist(), count.tolist(), strict=True)]).tolist()
    of = {}
    for at, x in zip(covered.tolist(), np.repeat(finer, sizes).tolist(), strict=True):
        assert of.setdefault(data[at : at + 50].tobytes(), x) == x


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=90), st.sampled_from([9, 50, 10**9]))
def test_suffix_ranks(symbols, need):
    t = np.array(symbols)
    order = np.argsort(suffixdedup.suffix_ranks(t, need), kind="stable")
    prefixes = [t[i : i + need].tolist() for i in order]
    assert prefixes == sorted(prefixes)


def test_packing():
    arrays = [np.array([1, 2**40], "<u8"), np.array([-5], "<i8"), np.zeros(0, "<u4")]
    assert all((a == b).all() for a, b in zip(arrays, suffixdedup.unpack(suffixdedup.pack(*arrays), ("<u8", "<i8", "<u4")), strict=True))


# 10 --------------------------------------------------------------------------
def test_toxicity_on_held_out_texts():
    r = np.random.default_rng(10)
    plain = [f"{a}{b}" for a in ("re", "tion", "an", "ver", "sta", "lo") for b in ("ment", "ing", "el", "or", "ute")]
    bad = ["idiotic", "worthless", "scumbag", "pathetic"]

    def text(toxic):
        w = list(r.choice(plain, 150))
        for at in r.integers(0, 150, 6 if toxic else 0):
            w[at] = r.choice(bad)
        return " ".join(w).encode()

    rows = [(text(k % 4 == 0), int(k % 4 == 0), zlib.crc32(b"%d" % k)) for k in range(600)]
    score = toxicity.fit(rows).scorer()
    fresh = [(score(text(y)), y) for y in (0, 1) * 60]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in fresh]) > 0.95
    assert all(0 <= s <= 1 for s, _ in fresh) and 0 <= score(b"") <= 1


def test_toxicity_without_labels(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_tables(docs, none)
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_never_reads_held_out_labels(spark, docs):
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    one = spark.createDataFrame([(i, 0, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(i, 0, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert toxicity.fit_tables(docs, one) == toxicity.fit_tables(docs, two)


# All -------------------------------------------------------------------------
def _every(spark, docs, tmp):
    tokenfile.write_tokens(spark, docs, queries.tokenizer("word_bpe_49k.json"), str(tmp))
    yield "mix", mixing.mix(spark, docs)
    yield "mixed", mixing.mixed_documents(spark, docs)
    yield "shard", sharding.shard_rows(spark, docs, 24)
    yield "near", neardup.near_duplicates(spark, docs)
    yield "near rows", neardup.without_near_duplicates(spark, docs)
    yield "files", tokenfile.read_documents(spark, str(tmp))
    yield "bpe", bpe.token_digests(docs, queries.tokenizer("byte_bpe_50k.json"))
    yield "ids", bpe.encode_documents(docs, queries.tokenizer("byte_bpe_50k.json"))
    yield "quality", quality.quality(docs, keep=None)
    yield "passing", quality.passing(docs)
    yield "repeats", suffixdedup.remove_repeats(spark, docs)
    yield "digests", suffixdedup.remove_repeats(spark, docs, digests=True)


def test_odd_rows(spark, odd, tmp_path):
    n = len(ODD)
    counts = {name: frame.count() for name, frame in _every(spark, odd, tmp_path / "f")}
    assert counts | {"mixed": 0} == {"mix": n, "mixed": 0, "shard": n, "near": n, "near rows": n - 1, "files": n, "bpe": n, "ids": n, "quality": n, "passing": counts["passing"], "repeats": n, "digests": n}
    kept = neardup.near_duplicates(spark, odd).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in kept if r["doc_id"] is None or r["doc_id"] < 5} == {(None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)}
    cut = suffixdedup.remove_repeats(spark, odd)
    assert cut.columns == odd.columns and {r["text"] for r in cut.where("doc_id = 1").collect()} == {None}


def test_empty_table(spark, empty, tmp_path):
    assert {name: frame.count() for name, frame in _every(spark, empty, tmp_path / "f")} == dict.fromkeys(("mix", "mixed", "shard", "near", "near rows", "files", "bpe", "ids", "quality", "passing", "repeats", "digests"), 0)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(spark, none).count() == 0
    assert urlfilter.filter_urls(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline as cp

    frame, seen = docs, {}
    for name, step in cp.STAGES:
        frame = step(spark, frame, sf_dir).cache()
        seen[name] = frame.toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i, x in text.items() if _measures(x)[-1]}
    assert set(seen["quality rules"]["doc_id"]) == good
    part = _components([(i, text[i]) for i in good], 5)
    assert set(seen["near duplicates"]["doc_id"]) == {i for i, (_, c) in part.items() if i == c}
    cut = dict(zip(seen["repeated passages"]["doc_id"], seen["repeated passages"]["text"], strict=True))
    want = _removed([(i, text[i]) for i in cut])
    assert {i: len((text[i] or "").encode()) - len(x.encode()) >= want[i][1] for i, x in cut.items()} == dict.fromkeys(cut, True)
    assert list(seen["mixed sources"].columns) == docs.columns
    sizes = collections.Counter()
    for i, s in zip(seen["repeated passages"]["doc_id"], seen["repeated passages"]["source"], strict=True):
        sizes[s] += len(WORD.findall(cut[i]))
    took = collections.Counter()
    for s, x in zip(seen["mixed sources"]["source"], seen["mixed sources"]["text"], strict=True):
        took[s] += len(WORD.findall(x))
    for s, target in _water_fill(dict(sizes)).items():
        assert abs(took[s] - target) <= 1
    assert len(seen["bpe tokens"]) == len(seen["mixed sources"])
    assert cp.run(spark, sf_dir).count() == len(seen["bpe tokens"])
