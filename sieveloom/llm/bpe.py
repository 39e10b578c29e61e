"""Byte-level BPE by backtracking, without merging.

A text is cut into pieces by the tokenizer's pattern, and each piece is encoded
by itself. All vocabulary tokens that start at each byte of a piece come from
one Aho-Corasick pass. The encoder goes left to right with the longest token
that starts where it stands and is compatible with the token before it; if none
is, it takes back the last token and tries that token's next shorter prefix.
Two tokens are compatible if merging their joined bytes gives the two again;
a sequence whose neighbours are all compatible is the one that merging gives.
Positions from which no continuation exists are marked, so each is left at most
once per prefix and the work is linear in the piece.

Compatibility is read off the merge history: undo, one after another, the later
of the two merges that made the right edge of the left token and the left edge
of the right token; the pair breaks up if at any moment a merge across the
border would have come before the one just undone. Answers are kept in a table.

Decoding gathers bytes through a table of offsets into the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import free_name

#: The splitting pattern of the byte-level vocabulary, and the code
#: points of its white space.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CACHE_PIECES = 300_000
CACHE_PIECE_BYTES = 64
PAIR_TABLE = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 for itself, the others from U+0100 on in byte order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """The tables of one tokenizer file (byte-level BPE in JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.to_symbols = dict(enumerate(alphabet))
        self.length = {i: len(t) for t, i in ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made = dict.fromkeys(self.length, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, r)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = pair, r
        usable = {t: i for t, i in ids.items() if len(t) == 1 or i in self.halves}
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1) for t, i in usable.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        table = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(table) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(table.get(i, b"")) for i in range(size)])
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.pieces = regex.compile(PIECES)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        key, rank, made = (left, right), self.rank, self.made
        limit, good = len(rank), None
        while good is None:
            if rank.get((left, right), limit) < limit:
                good = False
            elif made[left] > made[right]:
                limit, left = made[left], self.halves[left][1]
            elif made[right] >= 0:  # equal merges go from left to right, so the border may not tie
                limit, right = made[right] + 1, self.halves[right][0]
            else:
                good = True
        if len(self.pairs) >= PAIR_TABLE:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_piece(self, piece: str) -> bytes:
        """Token ids of one piece as little-endian unsigned 32-bit integers."""
        symbols = piece.encode().decode("latin-1").translate(self.to_symbols)
        n, length = len(symbols), self.length
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(symbols):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest stands last
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if end not in dead and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            elif last >= 0:
                dead.add(at)
                at -= length[last]
                token = self.shorter[out.pop()]
            else:
                raise ValueError("a byte has no token in this vocabulary")
        return np.array(out, "<u4").tobytes()

    def _found(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
        if len(piece) <= CACHE_PIECE_BYTES:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        get = self.young.get
        return [get(p) or self._found(p) for p in self.pieces.findall(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.marks is None or not self.marks.search(text):
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, gathered through the offset table."""
        if not len(ids):
            return b""
        first = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - first
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]))
        index += np.repeat(first - (ends - sizes), sizes)
        return self.bytes[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of tokens; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker; its tables hold a bounded number of entries."""
    return Vocabulary(path)


DECODE_IDS = 1 << 18


def decoded_utf8(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """UTF-8 of the decoded text, gathered in bounded runs of ids."""
    raw = b"".join(vocab.decode_bytes(ids[i : i + DECODE_IDS]) for i in range(0, len(ids), DECODE_IDS))
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column of token ids (little-endian unsigned 32 bits)
    for the whole text; a null text is encoded as an empty one. Other columns
    pass through unread, so their names and nulls do not matter, but an input
    column named like ``ids`` is replaced."""
    from pyspark.sql import types as T

    kept = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            encoded = [vocab.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoded, pa.binary())], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType())]))


def token_digests(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text of ``docs`` in one pass.

    Returns the ``keep`` columns, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (decoded text in UTF-8), both
    lower-case hex. A null or empty text has no tokens. Rows are independent:
    repeated rows repeat, an empty table gives an empty result, and columns not
    in ``keep`` are not read.
    """
    from pyspark.sql import types as T

    whole = free_name(keep, "_text")
    chosen = docs.select(*keep, docs["text"].alias(whole))
    fields = [docs.schema[k] for k in keep]
    out = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(whole):
                raw = vocab.encode(t.as_py() or "")
                counts.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(decoded_utf8(vocab, np.frombuffer(raw, "<u4"))).hexdigest())
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=out.names)

    return chosen.mapInArrow(run, out)
