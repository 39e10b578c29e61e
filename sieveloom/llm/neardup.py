"""Near duplicates by MinHash: one permutation, densified, banded, star-linked.

A document's set holds its distinct shingles of ``words`` lower-cased words. One
hash per shingle serves all bins: its high bits choose the bin, the rest compete
for the bin's minimum. Empty bins copy from bins that a fixed sequence of hashes
visits, the same for all documents (optimal densification). Runs of ``ROWS``
bins make a band, and documents with an equal band share a bucket.

Documents with equal sets are one class from the start. In a bucket, each member
is compared with one hub only, first inside each batch, then the batches' hubs
with the bucket's, so candidate pairs number at most one per class and band and
no bucket is gathered in one task. A pair becomes a link after a comparison of
the full sets. Where a bucket's members are not in one component by then, a hub
may have stood between two that are alike; documents joined by such buckets form
families, and a family is compared by classes of like set size: block by block,
all shared shingles of two blocks of documents are counted by one matrix product,
and only links across components come out. No pair of a shared bucket is left out, and no
pairs of a group are ever rows. Components come from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import discard, stage, stage_texts, with_ids, without_ids

WORDS = 5
PERCENT = 80
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**51 < 2e-9.
BINS_LOG2 = 8
ROWS = 5
BANDS = 51
#: Documents in a block where a family is compared as a whole.
BLOCK = 512
#: Cells of a block's incidence matrix at a time.
CELLS = 1 << 23
#: Rows of a written table to a file, for narrow tables and for those of documents,
#: and bytes of shingles to a task where whole sets move.
NARROW_ROWS, DOC_ROWS, SET_BYTES = 200_000, 20_000, 8 << 20
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of the distinct shingles of each document, rows ascending and
    hashes ascending in a row. Fewer than ``words`` words: all of them as one."""
    low = ts.LOWER[data]
    starts, ends, rows = ts.words(low, offsets)
    word = ts.hash_spans(low, starts, ends)
    n = len(offsets) - 1
    per = np.bincount(rows, minlength=n)
    stop = np.cumsum(per)
    at = np.arange(len(word))
    left = stop[rows] - at  # words from here to the end of the row
    first = at == (stop - per)[rows]
    begins = at[(left >= words) | first]
    size = np.minimum(left[begins], words)
    window = word[begins]
    for i in range(1, words):
        more = size > i
        window[more] = ts.mix64(window[more] * _U(0xA0761D6478BD642F) + word[begins[more] + i])
    window = ts.mix64(window + size.astype(_U))
    rows = rows[begins]
    order = np.lexsort((window, rows))
    window, rows = window[order], rows[order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], window[new]


def minima(rows: np.ndarray, hashes: np.ndarray, n: int, bins_log2: int = BINS_LOG2) -> np.ndarray:
    """The densified one-permutation signature of each row (n x bins)."""
    bins = 1 << bins_log2
    slot = rows * bins + (hashes >> _U(64 - bins_log2)).astype(np.int64)
    value = hashes << _U(bins_log2)
    empty = _U(2**64 - 1)
    out = np.full(n * bins, empty, _U)
    first = np.ones(len(slot), bool)  # hashes ascend, so the first of a slot is its least
    first[1:] = slot[1:] != slot[:-1]
    out[slot[first]] = value[first]
    out = out.reshape(n, bins)
    r, b = np.nonzero((out == empty) & (np.bincount(rows, minlength=n) > 0)[:, None])
    filled = out.copy()
    attempt = 0
    while len(r):
        attempt += 1
        source = (ts.mix64(b.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> _U(64 - bins_log2)).astype(np.int64)
        got = out[r, source]
        found = got != empty
        filled[r[found], b[found]] = got[found]
        r, b = r[~found], b[~found]
    return filled


def band_keys(signature: np.ndarray, rows_per_band: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band (n x bands)."""
    part = signature[:, : rows_per_band * bands].reshape(len(signature), bands, rows_per_band)
    key = np.broadcast_to(ts.mix64(np.arange(1, bands + 1, dtype=_U)), part.shape[:2]).copy()
    for i in range(rows_per_band):
        key = ts.mix64(key * _U(0xA0761D6478BD642F) + part[:, :, i])
    return key


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b (of the whole set) and bands (binary)."""
    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.text_buffer(batch.column("text"))
            for i, j, part, ends in ts.chunks(data, offsets):
                n = j - i
                rows, hashes = shingle_sets(part, ends, words)
                sums = [np.zeros(n, _U), np.zeros(n, _U)]
                for s, salt in zip(sums, (0x1B873593CC9E2D51, 0x52DCE729), strict=True):
                    np.add.at(s, rows, ts.mix64(hashes ^ _U(salt)))
                keys = band_keys(minima(rows, hashes, n))
                size = np.bincount(rows, minlength=n).astype(np.int64)
                bands = [k.tobytes() if s else None for k, s in zip(keys, size, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(size), *(pa.array(s.view(np.int64)) for s in sums), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, shingles (array of long hashes, ascending as unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.text_buffer(batch.column("text"))
            for i, j, part, ends in ts.chunks(data, offsets):
                rows, hashes = shingle_sets(part, ends, words)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, doc) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [np.frombuffer(b, np.int64) for b in batch.column("bands").to_pylist()]
            keys = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("doc_id").to_numpy(), [len(b) for b in bands]))], names=["key", "doc"])

    return classes.select("doc_id", "bands").mapInArrow(run, "key long, doc long")


def local_stars(classes: DataFrame) -> DataFrame:
    """(key, doc, hub) for every band: inside a batch each member of a bucket points
    to the least one, which stands for the batch with hub null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [np.frombuffer(b, np.int64) for b in batch.column("bands").to_pylist()]
            if not bands:
                continue
            keys, docs = np.concatenate(bands), np.repeat(batch.column("doc_id").to_numpy(), [len(b) for b in bands])
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            hub = docs[first][np.cumsum(first) - 1]
            if not first.all():  # the same pair meets in many bands
                pairs = np.unique(np.stack([hub[~first], docs[~first]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["key", "doc", "hub"])
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(docs[first]), pa.nulls(int(first.sum()), pa.int64())], names=["key", "doc", "hub"])

    return classes.select("doc_id", "bands").mapInArrow(run, "key long, doc long, hub long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component), staged: the least node reachable over ``edges`` (a, b), a
    written table, for nodes that have an edge. Large and small stars in turn until
    nothing changes; each round is written and the one before it deleted, and only a
    count and a checksum reach the driver."""
    parts = 1 + edges.count() // NARROW_ROWS  # rounds never add edges
    now = stage(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", parts)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(least, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, stage(spark, small, "edges", parts)
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    found = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select("b", "b").toDF("node", "component").distinct())
    found = stage(spark, found, "labels", parts)
    discard(now)
    return found


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(100 * shared >= percent * (total - shared)).select("a", "b")


def block_links(doc: np.ndarray, part: np.ndarray, label: np.ndarray, cuts: np.ndarray, hashes: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links across labels between the documents of part 0 and of part 1 (all are
    part 0 if ``same``). Shingles that one document alone has cannot be shared."""
    size = np.diff(cuts)
    owner = np.repeat(np.arange(len(doc)), size)
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = (np.arange(len(doc)),) * 2 if same else (np.flatnonzero(part == 0), np.flatnonzero(part == 1))
    shared = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(doc), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    names = np.unique(column)
    step = max(1, CELLS // max(1, len(doc)))
    for k in range(0, len(names), step):
        some = names[k : k + step]
        low, high = np.searchsorted(column, [some[0], some[-1] + 1])
        o, c = owner[low:high], np.searchsorted(some, column[low:high])
        sides = []
        for ids, number in ((left, 0), (right, 1)):
            inside = np.ones(len(o), bool) if same else part[o] == number
            x = np.zeros((len(ids), len(some)), np.float32)
            x[place[o[inside]], c[inside]] = 1
            sides.append(x)
            if same:
                sides *= 2
                break
        shared += sides[0] @ sides[1].T
    total = size[left][:, None] + size[right][None, :]
    good = (100 * shared >= percent * (total - shared)) & (label[left][:, None] != label[right][None, :])
    i, j = np.nonzero(good)
    return doc[left[i]], doc[right[j]]


def _size_classes(size: Column, percent: int) -> Column:
    """The one or two classes of a set's size. Sets that are similar enough differ in
    size by a factor of 100 / percent at most, which is a step of classes, so they
    have a class in common: each set stands in its own and in the next one."""
    step = F.floor(F.log(size.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    return F.array(step, step + 1) if percent < 100 else F.array(size.cast("int"))


def family_links(members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """members (doc_id, family, label, shingles) -> links (a, b) across labels inside
    a family. Members meet by classes of like size, and each pair of blocks of a
    class is one bounded step."""
    members = members.withColumn("like", F.explode(_size_classes(F.size("shingles"), percent)))
    sizes = members.groupBy("family", "like").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.where("low < high").drop("low", "high")
    dealt = members.join(sizes, ["family", "like"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("family", "like", low.alias("i"), high.alias("j"), (F.col("own") == high).cast("int").alias("part"), "doc_id", "label", "shingles")
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "family", "like", "i", "j").sortWithinPartitions("family", "like", "i", "j", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def links() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["shingles"].combine_chunks() if isinstance(t["shingles"], pa.ChunkedArray) else t["shingles"]
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            cuts = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
            a, b = block_links(t["doc_id"].to_numpy(), t["part"].to_numpy(), t["label"].to_numpy(), cuts, x.flatten().to_numpy(), name[2] == name[3], percent)
            first = a < b if name[2] == name[3] else np.ones(len(a), bool)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[first]), pa.array(np.maximum(a, b)[first])], names=["a", "b"])

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("family", "like", "i", "j")], 1)
            if not len(group):
                continue
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(group[low].tolist())
                if this != name and held:
                    yield links()
                    held = []
                name = this
                held.append(batch.slice(low, high - low))
        if held:
            yield links()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the least doc_id reachable over links of documents whose sets
    have 100 * shared >= percent * united shingles; kept where it is the row's
    own. A null or empty text, or one without words, has an empty set and no
    links. Rows with equal sets are linked, repeated rows among them; rows that
    share a doc_id count as one document. A null doc_id takes no part: its
    component is null and it is kept. A very long text is one set, whole. An empty
    table gives no rows. Columns beside doc_id and text are not read.
    """
    signed = stage_texts(spark, signatures(docs, words), "signatures")
    rows, shingles = signed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    parts = 1 + rows // DOC_ROWS
    set_parts = parts + 8 * shingles // SET_BYTES
    alive = signed.where("n_shingles > 0 and doc_id is not null")
    whole = ["key_a", "key_b", "n_shingles"]
    reps = stage(spark, alive.groupBy(*whole).agg(F.min("doc_id").alias("rep")), "classes", parts)
    behind = alive.select("doc_id", *whole).join(reps, whole).where("doc_id <> rep").select("doc_id").distinct()
    behind = stage(spark, behind, "copies", parts)
    classes = stage(spark, without_ids(alive.select("doc_id", "bands"), "doc_id", behind), "class-bands", parts)
    discard(behind)

    stars = stage(spark, local_stars(classes), "stars")
    # One exchange of the rows by bucket gives each its hub.
    hub = F.min("doc").over(Window.partitionBy("key"))
    across = stars.where("key is not null").select(hub.alias("a"), F.col("doc").alias("b"))
    pairs = stars.where("hub is not null").select(F.col("hub").alias("a"), F.col("doc").alias("b")).unionByName(across.where("a <> b")).distinct()
    pairs = stage(spark, pairs, "pairs", parts)
    discard(stars)
    nodes = stage(spark, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates", parts)
    texts = with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", nodes)
    sets = stage_texts(spark, full_sets(texts, words), "sets", set_parts)
    if sets.count() > nodes.count():  # some ids are repeated
        every, sets = sets, stage(spark, sets.dropDuplicates(["doc_id"]), "sets", set_parts)
        discard(every)
    links = stage(spark, confirmed(pairs, sets, percent), "links", set_parts)
    discard(pairs)
    labels = components(spark, links)

    # Buckets of three and more that hold more than one component: compare the rest.
    rows = bucket_rows(with_ids(classes, "doc_id", nodes))
    named = rows.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    named = stage(spark, named, "bucket-rows", parts)
    discard(classes, nodes)
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("hub"))
    mixed = mixed.where("low < high and n > 2").select("key", "hub")
    reach = stage(spark, named.join(mixed, "key").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "open-buckets", parts)
    discard(named)
    if reach.limit(1).count():
        families = components(spark, reach)
        family = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        known = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
        members = family.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        more = stage(spark, family_links(members.join(sets, "doc_id"), percent), "links", set_parts)
        if more.limit(1).count():
            both = stage(spark, links.unionByName(more), "links", parts)
            before, labels = labels, components(spark, both)
            discard(both, before)
        discard(more, families)
    discard(reach, sets, links)

    members = signed.join(reps, whole, "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    members = stage(spark, members.select("doc_id", "n_shingles", component.alias("component_id")), "near-duplicates", parts)
    discard(signed, reps, labels)
    return members.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the
    least doc_id (any one, if that id is repeated). Rows without doc_id stay, and
    columns of any name pass through. Only rows that may go are exchanged."""
    found = near_duplicates(spark, docs, **options)
    parts = 1 + found.count() // DOC_ROWS
    gone = stage(spark, found.where("not kept").select("doc_id").distinct(), "copies", parts)
    left = without_ids(docs, "doc_id", gone)
    again = found.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stage(spark, again, "repeated-ids", parts)
    discard(found)
    if again.limit(1).count():
        left = without_ids(left, "doc_id", again).unionByName(with_ids(left, "doc_id", again).dropDuplicates(["doc_id"]))
    return left
