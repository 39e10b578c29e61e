"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what toxic
text has and ordinary text has not (the words of toxic training texts that are
far more frequent, by documents without their copies, in toxic ones). A window of a
text is compressed twice, against the ordinary dictionary alone and against it
with the toxic one behind it; padding keeps all distances equal, so the gain in
bytes is what the toxic dictionary alone explains. A text's features come from
the gains of its windows beyond a threshold; a logistic curve over them, fitted
on labelled texts that no dictionary was trained on, gives the score, with 0.5
as the calibrated threshold.

Only a bounded sample of labelled rows is fitted on, chosen by hash; scoring
covers every window of every text, and the model is a few kilobytes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts used of each class at most, and the longest text used, in bytes.
SAMPLE_PER_CLASS = 3000
SAMPLE_TEXT_BYTES = 12_288
#: A telling word is in this share of toxic training texts, and more frequent there by
#: this logarithm of a ratio.
WORD_SHARE = 0.015
WORD_ODDS = 3.0
ORDINARY_BYTES = 8192
TOXIC_BYTES = 4096
WINDOW = 48
STRIDE = 24
LEVEL = 9
_WORDS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall  # letters, in bytes
_OPTIONS = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    constant: float = 0.0  # the score where nothing could be learned

    def scorer(self):
        """text bytes -> score, with its own compressors."""
        if not self.weights:
            return lambda text: self.constant
        gains = _gains(self.ordinary, self.toxic)

        def score(text: bytes) -> float:
            x = sum(w * f for w, f in zip(self.weights, (1.0, *features(gains(text))), strict=True))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

        return score


def _gains(ordinary: bytes, toxic: bytes):
    """text -> bytes that the toxic dictionary saves in each of its windows."""
    make = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **_OPTIONS)
    plain, both = make(ordinary + bytes(len(toxic))).compress, make(ordinary + toxic).compress

    def gains(text: bytes) -> np.ndarray:
        text = text.lower()
        cut = [text[i : i + WINDOW] for i in range(0, max(len(text) - WINDOW + STRIDE, 1), STRIDE)]
        return np.array([len(plain(w)) - len(both(w)) for w in cut], np.int64)

    return gains


def features(gains: np.ndarray) -> tuple[float, ...]:
    """Of a text's windows: how many gain more than each of some bytes, by how much
    together, and the three largest gains."""
    n = len(gains)
    out = [math.log(n)]
    for t in (1, 2, 3, 4, 6):
        over = gains > t
        out += [math.log1p(int((gains[over] - t).sum())), math.log(int(over.sum()) / n + 0.002)]
    top = np.minimum(np.sort(gains)[::-1][:3], 12).tolist()
    return (*out, *map(float, top), *[0.0] * (3 - len(top)))


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _distinct(texts: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
    """Without later texts that share one of their least hashed shingles with an
    earlier one: copies would make all their words look telling."""
    seen: set[int] = set()
    out = []
    for item in texts:
        words = item[0].split()
        least = sorted(zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))[:4]
        if seen.isdisjoint(least):
            seen.update(least)
            out.append(item)
    return out


def _contrast(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The words of the toxic texts that tell them from ordinary ones, each time they occur."""

    def by_documents(texts: list[bytes]) -> Counter:
        found: Counter = Counter()
        for b in texts:
            found.update(set(_WORDS(b)))
        return found

    mine, other = by_documents(toxic), by_documents(ordinary)
    least = max(3.0, WORD_SHARE * len(toxic))
    odds = {w: math.log((v + 0.5) / (len(toxic) + 1) * (len(ordinary) + 1) / (other[w] + 0.5)) for w, v in mine.items() if v >= least and len(w) >= 3}
    marks = {w for w, x in odds.items() if x >= WORD_ODDS}
    return [b" " + w + b" " for b in toxic for w in _WORDS(b) if w in marks]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = penalty * np.r_[0, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[tuple[bytes, int, int]], share: float | None = None) -> Model:
    """(text, label, hash) -> model. Two thirds train the dictionaries, by hash; the
    rest, and the training texts' share of label 1, calibrate. ``share``: the
    share of label 1 among all labelled rows, if the sample's differs."""
    texts = [(b.lower(), y, h) for b, y, h in texts]
    train, held = _distinct([t for t in texts if t[2] % 3]), [t for t in texts if t[2] % 3 == 0]
    toxic, ordinary = ([b for b, y, _ in train if y == c] for c in (1, 0))
    known = [y for _, y, _ in held]
    if not 0 < sum(known) < len(known):  # too few to hold any out
        held = texts
        known = [y for _, y, _ in held]
    if not toxic or not ordinary:  # one class alone: nothing tells them apart
        return Model(b"", b"", (), float(np.mean([y for _, y, _ in texts])) if texts else 0.0)
    telling = _contrast(toxic, ordinary) or [b[i : i + 16] for b in toxic for i in range(0, len(b), 16)]
    ordinary_dict = _train(ORDINARY_BYTES, [b[i : i + 256] for b in ordinary for i in range(0, len(b), 256)])
    toxic_dict = _train(TOXIC_BYTES, [b" ".join(telling[i : i + 16]) for i in range(0, len(telling), 16)])
    gains = _gains(ordinary_dict, toxic_dict)
    x = np.array([(1.0, *features(gains(b))) for b, _, _ in held])
    weights = _logistic(x, np.array(known, float))
    if share:  # classes were sampled apart: move the curve to the true odds
        seen = sum(known) / len(known)
        weights[0] += math.log(share / (1 - share)) - math.log(seen / (1 - seen)) if 0 < share < 1 else 0.0
    return Model(ordinary_dict, toxic_dict, tuple(map(float, weights)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_tables(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fifth: of each class ``per_class``
    rows by hash of doc_id, and of these texts of at most ``text_bytes``.

    Repeated labels count once, and a document labelled both 0 and 1 not at all; of
    rows that share a doc_id, the least text is used. Labels other than 0 and 1
    and null ids are ignored. Empty tables, or one class alone, give a constant
    score (0, or that class). Ids may be of any type."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most")).where("toxic = most").drop("most")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= text_bytes).join(sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    texts = [(r["text"].encode(), r["toxic"], zlib.crc32(f"fit{r['doc_id']}".encode())) for r in rows]
    return fit(sorted(texts, key=lambda t: (t[2], t[0])), counts.get(1, 0) / max(1, sum(counts.values())))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every
    whole text. A null or empty text has one empty window and is scored like any
    other; a very long one is scored window by window, whole. Rows are scored by
    their text alone, so repeated rows and ties agree; other columns are not read.
    An empty table gives no rows."""
    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            s = np.array([score(t.as_py().encode()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return chosen.mapInArrow(run, schema)
