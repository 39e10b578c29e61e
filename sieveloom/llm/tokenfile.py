"""Token ids in files of wavelet matrices.

A file row is a block: the ids of whole documents, in ascending doc_id order, at
least ``BLOCK_TOKENS`` of them unless its partition ends. The block's ids are
stored as a wavelet matrix: for each bit, highest first, one plane of bits in
the order that the planes above leave (zeros before ones, else as before), with
the number of zeros and counts of ones at every 512th bit. From these alone
``Block`` gives the id at a place, how often an id occurs before a place and the
place of an id's k-th occurrence; ``ids()`` gives everything back by undoing
the planes from the last to the first. Spark writes the blocks as Parquet, so
files come whole or not at all, in any store.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet

BLOCK_TOKENS = 1 << 18
SAMPLE = 512
END_ID = 2
CACHE_WORDS = 800_000
CACHE_WORD_CHARS = 64
#: Words of Latin-1 letters and printable ASCII but ' and <, with which contractions and
#: special tokens begin:
#: composition leaves them alone, and their pieces are runs of letters, single digits
#: and runs of other signs.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+").fullmatch
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
SYMBOLS = dict(enumerate(byte_alphabet()))

FILE_SCHEMA = "part int, seq int, n long, bits int, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids binary, has_doc_id binary, lengths binary"


class Block:
    """One wavelet matrix."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.bits = n, list(zeros), len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> Block:
        bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
        zeros, planes, ranks = [], [], []
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << b)) != 0
            packed = np.packbits(ones, bitorder="little")
            whole = np.zeros(-(-len(ones) // SAMPLE) * SAMPLE // 8, np.uint8)
            whole[: len(packed)] = packed
            per = np.bitwise_count(whole).reshape(-1, SAMPLE // 8).sum(1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)]).astype("<u4").tobytes())
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)  # places gather faster than masks
            zeros.append(len(low))
            now = np.concatenate([now.take(low), now.take(high)])
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        s = i // SAMPLE
        count, at = int(self.ranks[k][s]), s * SAMPLE // 8
        count += int(np.bitwise_count(self.planes[k][at : i // 8]).sum())
        if i % 8:
            count += int(self.planes[k][i // 8] & ((1 << i % 8) - 1)).bit_count()
        return count

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            one = self._bit(k, i)
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if one else i - ones
            value = value << 1 | one
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of an id among the first i places."""
        if value >> self.bits:
            return 0
        low, high = 0, min(i, self.n)
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (low - a, high - b)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id, -1 if there is none."""
        if k < 0 or k >= self.count(value):
            return -1
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def places(self, value: int) -> np.ndarray:
        """All places of an id, ascending: its range in the last plane, carried up the
        planes as a whole."""
        if value >> self.bits:
            return np.zeros(0, np.int64)
        low, high = 0, self.n
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (low - a, high - b)
        at = np.arange(low, high)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            one = value >> (self.bits - 1 - k) & 1
            at = np.flatnonzero(ones)[at - self.zeros[k]] if one else np.flatnonzero(~ones)[at]
        return at

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        after = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~ones)] = after[: self.zeros[k]]
            before[np.flatnonzero(ones)] = after[self.zeros[k] :] | kind(1 << self.bits - 1 - k)
            after = before
        return after


def _rules(path: str) -> tuple[bool, bool]:
    """May a tokenizer be asked word by word, and may PLAIN words be cut by PIECES here?
    Read from its file: only the normalizer and the splitter for which that is known
    to be the same are answered yes; for others the library gets whole texts."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    steps = lambda part, name: [part] if part and part.get("type") != "Sequence" else (part or {}).get(name, [])
    normal = [(x.get("type"), x.get("content")) for x in steps(said.get("normalizer"), "normalizers")]
    split = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("use_regex")) for x in steps(said.get("pre_tokenizer"), "pretokenizers")]
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    known = normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and split == [("Split", words, "Removed", None), ("ByteLevel", None, None, False)]
    plain = known and all(t["content"].startswith("<") for t in said.get("added_tokens", []))
    return plain, plain and said["model"].get("type") == "BPE" and not said.get("post_processor")


class WordEncoder(dict):
    """The tokenizers library, asked once per word: the tokenizers that ``_rules``
    knows drop white space and let nothing cross it, so a text's ids are its words' ids in turn.
    Words are cut at spaces and line feeds only, which is finer than no cut and
    never inside anything the tokenizer sees as one.

    The encoder is the table of words it knows (ids as little-endian unsigned
    32-bit integers), looked up without Python code; a word that is missing is
    encoded. A full table becomes the old one and a new one begins."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_word, self.by_piece = _rules(path)
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        """Ids of one word. A plain word is cut into the tokenizer's pieces here and the
        library's model encodes each piece once; any other goes to the library whole."""
        if not self.by_piece or not PLAIN(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for piece in PIECES(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SYMBOLS)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])
                if len(piece) <= CACHE_WORD_CHARS:
                    if len(self.pieces) >= CACHE_WORDS:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        known = self.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, *, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text; a null text is empty, a null doc_id stands
    first) with an end id after each document and write the blocks to ``folder``.
    Equal doc_ids stand by the hash of their text. A very long text is one document
    of one block; an empty table writes no blocks. Other columns are not read."""
    from pyspark import TaskContext

    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    laid = laid.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            end = np.array([END_ID], "<u4").tobytes()
            flat = np.frombuffer(b"".join(x + end for x in ids), "<u4")
            b = Block.build(flat)
            row = {
                "part": part, "seq": seq, "n": b.n, "bits": b.bits, "zeros": b.zeros, "planes": [p.tobytes() for p in b.planes], "ranks": [r.tobytes() for r in b.ranks],
                "doc_ids": np.array([x or 0 for x in names], "<i8").tobytes(), "has_doc_id": np.array([x is not None for x in names], np.uint8).tobytes(), "lengths": np.array([len(x) // 4 + 1 for x in ids], "<i8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=FILE_ARROW)

        for batch in batches:
            texts = batch.column("text")
            for i in range(0, len(texts), 256):
                some = texts.slice(i, 256).to_pylist()
                for name, x in zip(batch.column("doc_id").slice(i, 256).to_pylist(), encoder.encode(some), strict=True):
                    ids.append(x)
                    names.append(name)
                    held += len(x) // 4 + 1
                    if held >= BLOCK_TOKENS:
                        yield block()
                        ids, names, held, seq = [], [], 0, seq + 1
        if ids:
            yield block()

    laid.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(folder)


FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.binary()), ("has_doc_id", pa.binary()), ("lengths", pa.binary()),
])


def block_of(row: dict) -> Block:
    return Block(row["n"], row["zeros"], row["planes"], row["ranks"])


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, seq, block_start): ids before each block. Sums over partitions, then
    ranks inside one; only the table of partitions is ordered as a whole."""
    sizes = blocks.select("part", "seq", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sizes.join(parts, sizes["part"] == parts["p"]).select("part", "seq", (F.col("base") + F.col("inside")).alias("block_start"))


def read_documents(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 and,
    if asked for, ids (little-endian unsigned 32 bits)."""
    schema = "doc_id long, part int, seq int, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = memoryview(block_of(row).ids().astype("<u4")).cast("B")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["has_doc_id"], np.uint8) == 0),
                    pa.array(np.full(len(lengths), row["part"], np.int32)), pa.array(np.full(len(lengths), row["seq"], np.int32)), pa.array(ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                columns += [pa.array([bytes(x) for x in parts], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "seq", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = read_blocks(spark, folder)
    docs = blocks.mapInArrow(run, schema)
    out = docs.join(block_starts(blocks), ["part", "seq"])
    return out.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def find_occurrences(spark: SparkSession, folder: str, token: int, *, most_per_block: int | None = None) -> DataFrame:
    """Places of a token in the whole sequence (place long), by rank and select on
    the blocks; most_per_block, if given, is a top-k and stops early."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = block_of(row)
                n = b.count(token) if token >= 0 else 0
                if n:
                    few = most_per_block is not None and most_per_block < min(n, 16)
                    places = np.array([b.select(token, k) for k in range(most_per_block)], np.int64) if few else b.places(token)[:most_per_block]
                    m = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * m, pa.int32()), pa.array([row["seq"]] * m, pa.int32()), pa.array(places, pa.int64())], names=["part", "seq", "at"])

    blocks = read_blocks(spark, folder)
    found = blocks.mapInArrow(run, "part int, seq int, at long")
    return found.join(block_starts(blocks), ["part", "seq"]).select((F.col("block_start") + F.col("at")).alias("place"))
