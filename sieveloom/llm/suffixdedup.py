"""Removal of repeated passages with a distributed suffix array.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts in a
document with a smaller id. The order of suffixes is needed only among windows
(strings of LENGTH bytes) that may be equal, so suffixes are dealt out by
content. The least hash of the K-grams in a window is the same wherever the
window stands; windows that follow one another mostly share it, and such a run
is one piece of text. All equal windows meet in the bucket of that hash.

1. Each document's runs are listed by hash alone, and hashes that only one
   document has go no further: most text ends here.
2. The text of the other runs goes to its bucket, equal pieces once.
3. In a bucket, a suffix array of the pieces is built by difference cover: sort
   the triples at positions that are 1 or 2 modulo 3, name them by rank, recurse
   on the names (until they differ or reach LENGTH bytes), and merge in the
   remaining suffixes by their first symbol and the rank that follows. Equal
   windows then are neighbours: compare adjacent prefixes, and each window of a
   group whose least document is smaller than its own goes.
4. Removed runs return to their documents, which are cut.

What a map task can settle by itself it settles before the shuffle: of equal
runs or pieces in one batch, one is sent for all, so a passage that a third of
all documents share reaches its bucket at most once per HOLD_BYTES of text. Exchanges carry
packed arrays; both passes over the text share one exchange of it.

A hash with more than HOT_RUNS runs (a phrase in ever different surroundings) is
not left to one bucket: its windows are dealt out again, by the longer string of
SPLIT bytes about the phrase that windows with it at like offsets have in common.
Hot hashes are counted whole and marked in a bitmap of fixed size; a hash that is
marked by chance is only dealt out finer than it need be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .common import free_name, stage_texts

LENGTH = 50
GRAM = 20
#: Text to a bucket of anchors or pieces, in bytes; a bucket is held in one task.
BUCKET_BYTES = 8 << 20
#: Text of the pieces that are sorted at a time, in bytes; an anchor is not split.
SORT_BYTES = 1 << 18
#: Text whose runs a map task holds and settles at a time, in bytes (or one longer document).
HOLD_BYTES = 8 << 20
#: Runs of a hash, about 64 bytes each, beyond which it is dealt out finer.
HOT_RUNS = (1 << 20) // 64
#: Offsets of the hash in a window that go together when it is dealt out finer.
STEP = 8
SPLIT = LENGTH - STEP + 1
#: Bits of the bitmap of hot hashes: 4 MB, whatever their number.
HOT_BITS = 1 << 25
NONE = 0xFFFFFFFF
_U = np.uint64


# Packed arrays ---------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of like weight stand together."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays), *(a.itemsize for a in arrays)], "<u4").tobytes()]
    parts += [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, "<u4", 1 + 2 * len(kinds))
    at, out = head.nbytes, []
    for i, kind in enumerate(kinds):
        n, size = int(head[1 + i]), int(head[1 + len(kinds) + i])
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    return out


def unpack_all(blobs, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The concatenation of the arrays of all blobs."""
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


_ANCHORS = ("<u4", "<i8", "<u4", "<u4")  # high half of the hash, document, run, runs it stands for
_RUNS = ("<i8", "<u4")  # document, run
_PIECES = ("<u8", "<i8", "<u4", "<u4", "<u1")  # hash, document, place, size, text
_CUTS = ("<i8", "<u4", "<u4")  # document, first window, windows


#: Deals of documents are by a Lehmer step of doc_id, which SQL and numpy can both do.
_PRIME, _FACTOR = 2147483647, 48271


def deal_of(doc: np.ndarray, deals: int) -> np.ndarray:
    return doc % _PRIME * _FACTOR % _PRIME % deals


def _deal_column(doc_id: Column, deals: int) -> Column:
    step = F.pmod(F.pmod(doc_id.cast("long"), F.lit(_PRIME).cast("long")) * F.lit(_FACTOR), F.lit(_PRIME).cast("long"))
    return F.pmod(step, F.lit(deals)).cast("int")


def _by_group(group: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each group, in their order."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(group[a]), [x[order[a:b]] for x in arrays]


# Runs ------------------------------------------------------------------------


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    n, width = len(x) - w + 1, 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[w - width : w - width + n]) if width < w else x[:n]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, windows, hash): consecutive windows with one least K-gram hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, _U)
    least = sliding_minimum(ts.window_hash(data, gram), length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    has = sizes >= length
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, offsets[1:][has] - length + 1, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int32) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    begins[offsets[:-1][has]] = True
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    first = np.flatnonzero(begins)
    count = np.flatnonzero(ends) - first + 1
    return np.searchsorted(offsets, first, "right") - 1, first, count, least[first]


def _ordinals(rows: np.ndarray) -> np.ndarray:
    """The number of each run in its row (rows ascend)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))


def _several(group_starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each group of rows (documents ascend inside): does it have two documents?"""
    ends = np.append(group_starts[1:], len(doc))
    return doc[group_starts] != doc[ends - 1] if len(group_starts) else np.zeros(0, bool)


def anchor_rows(buckets: int, deals: int):
    """Pass 1: documents -> (key, blob). Keys below ``buckets`` are buckets of
    anchors; those from there on are deals of documents and hold runs that other
    documents of the same batch share."""

    def packed(h: np.ndarray, doc: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, h))
        h, doc, number = h[order], doc[order], number[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        several = _several(starts, doc)
        sizes = np.diff(np.append(starts, len(h)))
        shared = np.repeat(several, sizes)
        keys, blobs = [], []
        for deal, (d, r) in _by_group(deal_of(doc[shared], deals), [doc[shared], number[shared]]):
            keys.append(buckets + deal)
            blobs.append(pack(d, r))
        times = np.ones(len(h), "<u4")
        times[starts] = np.where(several, sizes, 1)
        send = ~shared
        send[starts] = True
        send = np.flatnonzero(send)
        send = send[np.lexsort((number[send], doc[send]))]  # in this order they pack best
        number = np.where(shared, np.uint32(NONE), number)
        for bucket, x in _by_group((h[send] % _U(buckets)).astype(np.int64), [(h[send] >> _U(32)).astype("<u4"), doc[send], number[send], times[send]]):
            keys.append(bucket)
            blobs.append(pack(*x))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("doc_id").null_count:
                batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy()
            data, offsets = ts.text_buffer(batch.column("text"))
            for low, high, held, bounds in ts.chunks(data, offsets, HOLD_BYTES):
                found: list[list[np.ndarray]] = [[], [], []]
                for i, _, part, ends in ts.chunks(held, bounds):
                    row, _, _, h = runs(part, ends)
                    for out, x in zip(found, (h, ids[low:high][row + i], _ordinals(row).astype("<u4")), strict=True):
                        out.append(x)
                yield packed(*(np.concatenate(found.pop(0)) for _ in range(3)))

    return run


def hot_cells(bucket, high: np.ndarray) -> np.ndarray:
    """The bits of hashes, known by their bucket and high half, in the bitmap of hot ones."""
    return (ts.mix64(high.astype(_U) << _U(32) ^ np.asarray(bucket).astype(_U)) % _U(HOT_BITS)).astype("<u4")


def shared_runs(buckets: int, deals: int, hot_runs: int = HOT_RUNS):
    """The anchors of a bucket -> (deal, blob of runs) for hashes that two documents
    have; deals pass through. Hashes go by their bucket and their high half: the few
    that agree in both by chance cost a piece sent in vain. Cells of hashes with more
    than ``hot_runs`` runs come as deal -1."""

    def run(group: pa.Table) -> pa.Table:
        key = group["key"][0].as_py()
        if key >= buckets:
            return pa.table({"deal": pa.array([key - buckets] * len(group), pa.int32()), "blob": group["blob"]})
        h, doc, number, times = unpack_all(group["blob"].to_pylist(), _ANCHORS)
        order = np.lexsort((doc, h))
        h, doc, number, times = h[order], doc[order], number[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = _several(starts, doc) | (np.maximum.reduceat(times, starts) > 1)
        hot = np.add.reduceat(times.astype(np.int64), starts) > hot_runs
        reply = np.repeat(several, np.diff(np.append(starts, len(h)))) & (number != NONE)
        out = [(d, pack(*x)) for d, x in _by_group(deal_of(doc[reply], deals), [doc[reply], number[reply]])]
        if hot.any():
            out.append((-1, pack(np.unique(hot_cells(key, h[starts][hot])))))
        return pa.table({"deal": pa.array([d for d, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    return run


def _hot_bitmap(shared: DataFrame) -> bytes | None:
    """The bitmap of hot hashes, packed; None without any. HOT_BITS bits at most reach
    the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = unpack_all(batch.column("blob").to_pylist(), ("<u4",))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).astype(np.int64) + 1)], names=["cell"])

    found = shared.where("deal < 0").select("blob").mapInArrow(cells, "cell long")
    parts = found.groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    if not parts:
        return None
    bits = np.zeros(HOT_BITS // 8, np.uint8)
    for row in parts:
        at = (row["part"] - 1) * len(row["bits"])
        bits[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


# Pieces ----------------------------------------------------------------------


def split_runs(data: np.ndarray, first: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, windows, hash): runs of ``data`` cut where the SPLIT bytes change
    that stand about the first place of the hash in a window. Equal windows have it
    at like offsets, in like strings, so they meet under the new hash too."""
    reach = LENGTH - GRAM
    sizes = count + reach
    run = np.repeat(np.arange(len(first)), sizes)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = first[run] + inside
    found = ts.window_hash(data, GRAM)[here] == h[run]
    at = np.arange(len(run))
    following = np.minimum.accumulate(np.where(found, at, len(run))[::-1])[::-1]
    window = np.flatnonzero(inside < count[run])
    offset = following[window] - window
    part = offset // STEP
    run, here = run[window], here[window]
    finer = ts.mix64(ts.window_hash(data, SPLIT)[here + offset - part * STEP] ^ ts.mix64(part.astype(_U) + _U(1)))
    begin = np.concatenate([[True], (run[1:] != run[:-1]) | (finer[1:] != finer[:-1])])
    begin = np.flatnonzero(begin)
    return run[begin], here[begin], np.diff(np.append(begin, len(run))), finer[begin]


def piece_rows(buckets: int, hot: bytes | None = None):
    """Pass 2: documents of a deal and their shared runs -> (key, blob): the text of
    each distinct piece with its least document, by bucket, and cuts for the
    documents behind it, by deal. Runs of hashes in the bitmap ``hot`` go in parts."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        empty = pa.table({"key": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not len(docs) or not len(replies):
            return empty
        deal = replies["deal"][0].as_py()
        docs = docs.filter(docs["doc_id"].is_valid()).sort_by("doc_id")
        doc, number = unpack_all(replies["blob"].to_pylist(), _RUNS)
        wanted = np.unique(doc.astype(_U) << _U(32) ^ number.astype(_U)) if not len(doc) or abs(doc).max() < 1 << 31 else None
        pairs = None if wanted is not None else set(zip(doc.tolist(), number.tolist(), strict=True))
        ids = docs["doc_id"].to_numpy()
        data, offsets = ts.text_buffer(docs["text"])
        seen: dict[bytes, list] = {}
        cuts: tuple[list, list, list] = ([], [], [])
        bits = None if hot is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(hot), np.uint8)
        for i, _, part, ends in ts.chunks(data, offsets):
            row, first, count, h = runs(part, ends)
            own, n = ids[row + i], _ordinals(row)
            if wanted is not None:
                pick = np.flatnonzero(np.isin(own.astype(_U) << _U(32) ^ n.astype(_U), wanted))
            else:
                pick = np.array([k for k, x in enumerate(zip(own.tolist(), n.tolist(), strict=True)) if x in pairs], np.int64)
            row, first, count, h = row[pick], first[pick], count[pick], h[pick]
            if bits is not None:
                cell = hot_cells(h % _U(buckets), h >> _U(32))
                some = bits[cell >> 3] >> (cell & 7) & 1 > 0
                if some.any():
                    run, f, c, x = split_runs(part, first[some], count[some], h[some])
                    order = np.argsort(np.concatenate([first[~some], f]), kind="stable")
                    row, first, count, h = (np.concatenate([v[~some], w])[order] for v, w in ((row, row[some][run]), (first, f), (count, c), (h, x)))
            text = part.tobytes()
            place = (first - ends[row]).tolist()
            for a, c, d, p, x in zip(first.tolist(), count.tolist(), ids[row + i].tolist(), place, h.tolist(), strict=True):
                piece = text[a : a + c + LENGTH - 1]
                at = seen.get(piece)
                if at is None:
                    seen[piece] = [x, d, p]
                elif at[1] == d:
                    at.append(p)
                else:  # documents ascend, so a smaller one has this piece
                    for out, v in zip(cuts, (d, p, c), strict=True):
                        out.append(v)
        keys, blobs = [], []
        if cuts[0]:
            keys.append(buckets + deal)
            blobs.append(pack(np.array(cuts[0], "<i8"), np.array(cuts[1], "<u4"), np.array(cuts[2], "<u4")))
        # A piece that stands several times in its document is sent with each place, the text once.
        pieces = list(seen.items())
        where = np.array([v[0] % buckets for _, v in pieces], np.int64)
        for bucket, (index,) in _by_group(where, [np.arange(len(pieces))]):
            h, d, p, s, t = [], [], [], [], []
            for k in index.tolist():
                b, v = pieces[k]
                for j, at in enumerate(v[2:]):
                    h.append(v[0])
                    d.append(v[1])
                    p.append(at)
                    s.append(0 if j else len(b))
                t.append(b)
            keys.append(bucket)
            blobs.append(pack(np.array(h, "<u8"), np.array(d, "<i8"), np.array(p, "<u4"), np.array(s, "<u4"), np.frombuffer(b"".join(t), np.uint8)))
        return pa.table({"key": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


# The suffix array ------------------------------------------------------------


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One integer for each pair, in the order of the pairs."""
    size = int(low.max(initial=0)) + 1
    if int(high.max(initial=0)) + 1 >= (1 << 63) // size:
        high = np.unique(high, return_inverse=True)[1]
    return high * np.int64(size) + low


def suffix_ranks(t: np.ndarray, need: int, reach: int = 1) -> np.ndarray:
    """Ranks (from 1) of the suffixes of t, integers from 1 on, each of ``reach``
    bytes, by difference cover modulo 3. Suffixes that agree in ``need`` bytes
    may stand in any order among themselves."""
    n = len(t)
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        ranks = np.zeros(n, np.int64)
        ranks[order] = np.arange(1, n + 1)
        return ranks
    t = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    p0, p1, p2 = np.arange(0, n, 3), np.arange(1, n, 3), np.arange(2, n, 3)
    sampled = np.concatenate([p1, p2])
    triples = _joined(_joined(t[sampled], t[sampled + 1]), t[sampled + 2])
    values, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(values) < len(sampled) and 3 * reach < need:
        text = np.concatenate([names[: len(p1)], np.zeros(1, np.int64), names[len(p1) :]])
        order = suffix_ranks(text, need, 3 * reach)
        names = np.concatenate([order[: len(p1)], order[len(p1) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names
    # Suffixes 0 and 1 compare by a symbol and the next rank, 0 and 2 by two symbols.
    a = _joined(t[np.concatenate([p0, p1])], rank[np.concatenate([p0, p1]) + 1])
    q = np.concatenate([p0, p2])
    b = _joined(_joined(t[q], t[q + 1]), rank[q + 2])
    a0, a1, b0, b2 = a[: len(p0)], a[len(p0) :], b[: len(p0)], b[len(p0) :]
    order0 = np.argsort(a0, kind="stable")
    order12 = np.argsort(names, kind="stable")
    out = np.zeros(n, np.int64)
    place = np.empty(len(p0), np.int64)
    place[order0] = np.arange(1, len(p0) + 1)
    out[p0] = place + np.searchsorted(np.sort(a1), a0) + np.searchsorted(np.sort(b2), b0)
    place = np.empty(len(sampled), np.int64)
    place[order12] = np.arange(1, len(sampled) + 1)
    below = np.concatenate([np.searchsorted(a0[order0], a1, "right"), np.searchsorted(np.sort(b0), b2, "right")])
    out[sampled] = place + below
    return out


def least_documents(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the window of ``length`` bytes at each start, the least document of all
    equal windows among them."""
    ranks = suffix_ranks(text.astype(np.int64) + 1, length)
    order = np.argsort(ranks[starts], kind="stable")
    at = starts[order]
    # Compare adjacent prefixes, eight bytes at a time.
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(len(text), _U)
    for k in range(8):
        eight = eight << _U(8) | padded[k : k + len(text)].astype(_U)
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        w = eight[at + k]
        same &= w[1:] == w[:-1]
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.append(new, len(at))))
    return out


def _sort_classes(classes: list[tuple[bytes, int, list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """classes (text, document, places) -> cuts (document, first, windows)."""
    text = np.frombuffer(b"".join(c[0] for c in classes), np.uint8)
    sizes = np.array([len(c[0]) for c in classes])
    ends = np.cumsum(sizes)
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(classes)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    doc = np.array([c[1] for c in classes], np.int64)[owner]
    goes = least_documents(text, (ends - sizes)[owner] + inside, doc) < doc
    begin = goes.copy()
    begin[1:] &= ~goes[:-1] | (owner[1:] != owner[:-1])
    stop = goes.copy()
    stop[:-1] &= ~goes[1:] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begin)
    count = np.flatnonzero(stop) - first + 1
    rows = [(classes[k][1], p + i, c) for k, i, c in zip(owner[first].tolist(), inside[first].tolist(), count.tolist(), strict=True) for p in classes[k][2]]
    if rows:
        d, p, c = zip(*rows, strict=True)
        yield np.array(d, "<i8"), np.array(p, "<u4"), np.array(c, "<u4")


def cut_rows(buckets: int, deals: int):
    """The pieces of a bucket -> (deal, blob of cuts); deals pass through."""

    def run(group: pa.Table) -> pa.Table:
        key = group["key"][0].as_py()
        if key >= buckets:
            return pa.table({"deal": pa.array([key - buckets] * len(group), pa.int32()), "blob": group["blob"]})
        texts: list[bytes] = []
        parts: list[list[np.ndarray]] = []
        for blob in group["blob"].to_pylist():
            h, d, p, s, t = unpack(blob, _PIECES)
            own = np.maximum.accumulate(np.where(s > 0, np.arange(len(s)), 0))  # size 0: the text of the row before
            end = np.cumsum(s.astype(np.int64))[own]
            parts.append([h, d, p, end - s[own], end, np.full(len(h), len(texts))])
            texts.append(t.tobytes())
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[0]))  # by anchor, documents ascending
        columns = [x[order] for x in columns]
        anchors = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1], [True]])).tolist()
        cuts: list[tuple[np.ndarray, ...]] = []
        behind: tuple[list, list, list] = ([], [], [])
        waiting: list[tuple[bytes, int, list[int]]] = []
        held = 0
        for low, high in zip(anchors[:-1], anchors[1:], strict=True):
            classes: dict[bytes, tuple[int, list[int]]] = {}
            for d, p, first, end, source in zip(*(x[low:high].tolist() for x in columns[1:]), strict=True):
                piece = texts[source][first:end]
                at = classes.setdefault(piece, (d, []))
                if at[0] == d:
                    at[1].append(p)
                else:
                    for out, v in zip(behind, (d, p, len(piece) - LENGTH + 1), strict=True):
                        out.append(v)
            if len(classes) > 1:  # a single text has no order to find
                waiting += [(b, d, places) for b, (d, places) in classes.items()]
                held += sum(map(len, classes))
            if held >= SORT_BYTES:
                cuts += _sort_classes(waiting)
                waiting, held = [], 0
        if waiting:
            cuts += _sort_classes(waiting)
        if behind[0]:
            cuts.append((np.array(behind[0], "<i8"), np.array(behind[1], "<u4"), np.array(behind[2], "<u4")))
        all_cuts = [np.concatenate(x) for x in zip(*cuts, strict=True)] if cuts else [np.zeros(0, k) for k in _CUTS]
        out = [(d, pack(*x)) for d, x in _by_group(deal_of(all_cuts[0], deals), all_cuts)]
        return pa.table({"deal": pa.array([d for d, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    return run


# Cutting ---------------------------------------------------------------------


def removed_bytes(ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Which bytes of the concatenated documents go; rows with one id go alike."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    change = np.zeros(int(offsets[-1]) + 1, np.int32)
    order = np.argsort(ids, kind="stable")
    doc, first, count = cuts
    low, high = np.searchsorted(ids[order], doc), np.searchsorted(ids[order], doc, "right")
    for k in range(int((high - low).max(initial=0))):
        some = np.flatnonzero(low + k < high)
        row = order[low[some] + k]
        good = known[row]
        row, some = row[good], some[good]
        begin = np.minimum(first[some].astype(np.int64), sizes[row])
        end = np.minimum(first[some].astype(np.int64) + count[some] - 1 + LENGTH, sizes[row])
        np.add.at(change, offsets[row] + begin, 1)
        np.add.at(change, offsets[row] + end, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _cutter(names: list[str], digests: bool, text_name: str, chars: pa.DataType | None):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids = docs["doc_id"].fill_null(0).to_numpy().astype(np.int64)
        known = docs["doc_id"].is_valid().to_numpy()
        data, offsets = ts.text_buffer(docs[text_name])
        gone = removed_bytes(ids, known, np.diff(offsets), unpack_all(replies["blob"].to_pylist(), _CUTS))
        first, end = ts.spans(gone, offsets)
        keep = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if digests:
            row = np.searchsorted(offsets, first, "right") - 1
            n = len(ids)
            return pa.table({
                "doc_id": docs["doc_id"], "n_bytes": np.diff(offsets), "n_removed": ts.row_sums(end - first, row, n),
                "n_spans": np.bincount(row, minlength=n).astype(np.int64), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in keep], pa.string()),
            })
        cut = [k.decode("utf-8", "ignore") for k in keep]
        untouched = docs[text_name].combine_chunks().to_pylist() if docs[text_name].null_count else None
        if untouched is not None:
            cut = [None if u is None else c for u, c in zip(untouched, cut, strict=True)]
        columns = {c: docs[c] for c in names}
        columns[text_name] = pa.array(cut, pa.string())
        if chars is not None:
            changed = np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=len(ids)) > 0
            columns["n_chars"] = pa.array([len(c) if x else v for c, x, v in zip(cut, changed.tolist(), docs["n_chars"].to_pylist(), strict=True)], chars)
        return pa.table(columns)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, *, digests: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Cut repeated passages out of every whole text.

    digests: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of what is left. Otherwise ``docs`` with the same columns, text
    cut (bytes of a character that was cut in part go with it; a null stays
    null), and n_chars, if there is one, of the new text where it changed.

    A null text is empty; texts shorter than LENGTH lose nothing. Rows that
    share a doc_id are one document and are cut alike: repeated rows never cut
    each other. A row without doc_id neither cuts nor is cut, and takes part in no
    exchange. Decisions are made on the input, not on what is left. A very long
    text is held whole by one task. An empty table gives an empty one, and columns
    of any name pass through. ``hot_runs`` moves work between buckets and changes no
    result.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(partitions, -(-total // BUCKET_BYTES))
    deals = 2 * buckets  # a row of packed arrays for each pair of them at most
    names = ["doc_id", "text"] if digests else docs.columns
    id_type = docs.schema["doc_id"].dataType
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    deal = free_name(names, "_deal")
    source = known.select(_deal_column(F.col("doc_id"), deals).alias(deal), *[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in names])
    keyed, packed = "key int, blob binary", "deal int, blob binary"
    anchors = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(anchor_rows(buckets, deals), keyed)
    shared = stage_texts(spark, anchors.groupBy("key").applyInArrow(shared_runs(buckets, deals, hot_runs), packed), "runs")
    make = piece_rows(buckets, _hot_bitmap(shared))
    pieces = source.groupBy(deal).cogroup(shared.where("deal >= 0").groupBy("deal")).applyInArrow(lambda a, b: make(a, b), keyed)
    cuts = pieces.groupBy("key").applyInArrow(cut_rows(buckets, deals), packed)
    if digests:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
        whole = F.coalesce("text", F.lit("")).cast("binary")
        untouched = unknown.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"))
    else:
        schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "doc_id" else f.dataType) for f in docs.schema])
        untouched = unknown
    chars = None
    if not digests and "n_chars" in names:
        from pyspark.sql.pandas.types import to_arrow_type

        chars = to_arrow_type(docs.schema["n_chars"].dataType)
    cutter = _cutter(names, digests, "text", chars)
    out = source.groupBy(deal).cogroup(cuts.groupBy("deal")).applyInArrow(lambda a, b: cutter(a, b), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type)).unionByName(untouched)
