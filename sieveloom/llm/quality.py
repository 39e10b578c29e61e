"""Quality rules by repetition coverage.

Words and lines are hashed in numpy for a chunk of documents at once; the hash
of an n-gram is folded from the hashes of its words. A window of n words (or a
line) is duplicated if its hash occurs again in the same text. The rules compare
the characters inside duplicated windows, each counted once, with the characters
of all words: long repeats cover much text whatever their length in words.
Sorting finds duplicates; longer windows are looked at only where the next
shorter length already repeats, so clean text costs one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textscan as ts
from .common import free_name

BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50
BASE_NGRAM = 3
SYMBOLS = b"#*$%&|<>"
#: n-gram length -> largest fraction of word characters inside duplicated n-grams.
COVERAGE = {5: 0.30, 7: 0.25, 10: 0.20}
#: Largest fraction of word characters inside duplicated lines (all but the first).
LINE_COVERAGE = 0.30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    seen = np.zeros(len(keys), bool)
    seen[order[1:][ranked[1:] == ranked[:-1]]] = True
    return seen


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside windows of n words that begin at ``starts``."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(COVERAGE)) -> dict[str, np.ndarray]:
    """All measures of the documents of one chunk, an array per measure; coverage
    of n-grams as characters: ``chars_n``; of later equal lines: ``line_chars``."""
    n = len(offsets) - 1
    out = {}
    starts, ends, rows = ts.words(data, offsets)
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    out["n_words"] = np.bincount(rows, minlength=n).astype(np.int64)
    out["word_chars"] = ts.row_sums(chars, rows, n)
    marked = np.zeros(256, bool)
    marked[list(SYMBOLS)] = True
    symbols = np.flatnonzero(marked[data])
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, symbols, "right") - 1, minlength=n).astype(np.int64)

    # Lines with a word; the row is part of the key, so lines meet only in their text.
    lf, lt = ts.spans(data != 10, offsets)
    lrow = np.searchsorted(offsets, lf, "right") - 1
    first = np.searchsorted(starts, lf)
    used = np.searchsorted(starts, lt) > first
    lf, lt, lrow = lf[used], lt[used], lrow[used]
    lhash = ts.hash_spans(data, lf, lt)
    dup = _later(ts.mix64(lhash + lrow.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    out["n_dup_lines"] = np.bincount(lrow[dup], minlength=n).astype(np.int64)
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
    a, b = np.searchsorted(starts, lf[dup]), np.searchsorted(starts, lt[dup])
    out["line_chars"] = ts.row_sums(upto[b] - upto[a], lrow[dup], n)

    word = ts.hash_spans(data, starts, ends)
    last_word = np.cumsum(out["n_words"])[rows]  # index after the row's last word
    key = ts.mix64(word + rows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    at = np.arange(len(word))
    for length in (BASE_NGRAM, *sorted(lengths)):
        at = at[at + length <= last_word[at]]
        at = at[_again(_windows(word, key, at, length))]
        inside = _covered(at, length, len(word))
        if length == BASE_NGRAM:
            out["n_repeat_words"] = np.bincount(rows[inside], minlength=n).astype(np.int64)
        else:
            out[f"chars_{length}"] = ts.row_sums(chars[inside], rows[inside], n)
    return out


def _windows(word: np.ndarray, key: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words that begin at the words ``at``."""
    window = key[at]
    for i in range(1, length):
        window = ts.mix64(window * np.uint64(0xA0761D6478BD642F) + word[at + i])
    return window


def verdicts(m: dict[str, np.ndarray], coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept): the base rule is in whole numbers; then no n-gram length
    and no lines may cover more than their fraction of the word characters."""
    coverage = COVERAGE if coverage is None else coverage
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (m["line_chars"] <= line_coverage * m["word_chars"])
    for n, most in coverage.items():
        kept &= m[f"chars_{n}"] <= most * m["word_chars"]
    return failed, kept


def quality(docs: DataFrame, *, keep: tuple[str, ...] | None = ("doc_id",), text: str = "text") -> DataFrame:
    """The measures and the verdict of every whole text.

    Returns the ``keep`` columns (all, with text, if None), MEASURES (long),
    base_failed and kept. A null or empty text has no words, so it fails the
    base rule. A text is measured in one go however long it is. Each row is
    judged by itself, so repeated rows agree; an empty table gives no rows; an
    input column named like a result gives way to it.
    """
    results = [*MEASURES, "base_failed", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    whole = free_name(names, "_quality_text")
    chosen = docs.select(*names, docs[text].alias(whole))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in MEASURES] + [T.StructField(c, T.BooleanType()) for c in results[-2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.text_buffer(batch.column(whole))
            for i, j, part, ends in ts.chunks(data, offsets):
                m = measure(part, ends)
                failed, kept = verdicts(m)
                columns = [batch.column(c).slice(i, j - i) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m[c]) for c in MEASURES), pa.array(failed), pa.array(kept)], names=schema.names)

    return chosen.mapInArrow(run, schema)


def passing(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.text_buffer(batch.column(text))
            kept = [verdicts(measure(part, ends))[1] for _, _, part, ends in ts.chunks(data, offsets)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
