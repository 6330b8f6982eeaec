"""Token files: one array of ids, with Elias-Fano coded document boundaries.

A file holds the ids of a run of documents one after another (2 bytes each where the vocabulary allows it, else 4) and where each
document ends. The n ends, at most u, are kept in n * (2 + log2(u / n)) bits: the low bits as they are, the high bits as unary gaps
in a bit vector, and the place of every 256th one in it, so that ``end(k)`` reads a few words (select) and no table of 64-bit
offsets is needed.

Files are written by Spark as binary cells of a Parquet table in the shared folder: that works in any store, a task that is
run again replaces its own files, and no executor needs another's disk. Ids come from the tokenizers library. Nothing that it does looks
past ASCII white space, so each different word is encoded once per worker.

Edge cases: null or empty texts hold the end id alone; null keys come first; documents with the same key stand in any order,
each with its own row; very long texts are encoded whole, a file ends with the document that fills it; an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from plumbline.llm.bpe import halve, visible_bytes
from plumbline.llm.common import Scratch

END_ID = 2
TABLE_SIZE = 700_000
#: A file is closed once it holds so many ids.
FILE_IDS = 4_000_000
SAMPLED = 256
MAGIC = b"PLTOKEN1"


class EliasFano:
    """A non-decreasing sequence of n numbers in near-minimal space."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        low = np.packbits((values[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLED].astype("<u4").tobytes())

    def select(self, k: int) -> int:
        """Place of the k-th one in the high bits: from the sample before it, over whole bytes, then bits."""
        at = struct.unpack_from("<I", self.samples, 4 * (k // SAMPLED))[0]
        left, byte = k % SAMPLED, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        at = k * self.width
        chunk = int.from_bytes(self.low[at >> 3 : (at + self.width + 7) >> 3], "little")
        return (self.select(k) - k) << self.width | chunk >> (at & 7) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")) - np.arange(self.n)
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return (high << self.width) + low @ (1 << np.arange(self.width, dtype=np.int64))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.width, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, width, *sizes = struct.unpack_from("<QBQQQ", data, at)
        at += 33
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, width, *parts), at


def _arrow_type(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def pack_file(ids: bytes, counts: list[int], wide: int) -> bytes:
    """The file for little-endian ids of that many bytes each and the documents' numbers of ids."""
    return MAGIC + struct.pack("<BQ", wide, len(ids) // wide) + EliasFano.of(np.cumsum(np.array(counts, np.int64))).to_bytes() + ids


class TokenFile:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.wide, self.n_ids = struct.unpack_from("<BQ", data, 8)
        self.ends, at = EliasFano.from_bytes(data, 17)
        self.ids = np.frombuffer(data, f"<u{self.wide}", self.n_ids, at)

    def document(self, k: int) -> tuple[int, np.ndarray]:
        """Where the k-th document begins and its ids, by two look-ups among the ends."""
        start = self.ends[k - 1] if k else 0
        return start, self.ids[start : self.ends[k]]


_states: dict[str, tuple] = {}
_MARKS = (b".", b",")
_VISIBLE = dict(visible_bytes())


def _state(path: str):
    """Tokenizer, table of words, bytes of each id, width of an id, and whether a word of Latin letters can go straight to the model."""
    if path not in _states:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        size = max(tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1)
        wide = 2 if size <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        kinds = [[x["type"] for x in (j.get(a) or {}).get(b, [])] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        _states[path] = tokenizer, {}, [i.to_bytes(wide, "little") for i in range(size)], wide, kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
    return _states[path]


def _letters(word: bytes) -> str | None:
    """What the stages before the model make of a word of Latin letters; None for any other word."""
    if word.isalpha():
        return word.decode().lower()
    text = word.decode("utf-8", "surrogatepass").lower()
    if text.isalpha() and max(text) < "\u0250" and unicodedata.is_normalized("NFC", text):
        return text.encode().decode("latin-1").translate(_VISIBLE)
    return None


def _encode(path: str, texts: list[str | None]) -> tuple[list[bytes], int]:
    """Each text's ids as little-endian bytes, END_ID last, and the bytes of an id; a few hundred texts at a time."""
    tokenizer, table, code, wide, direct = _state(path)
    if len(table) > TABLE_SIZE:  # the words met first are the frequent ones
        halve(table)
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    cut = [(x if b"<|" in x else x.lower()).split() for x in raw]  # the vocabulary is of lower case; a special token's spelling counts
    found = [list(map(table.get, words)) for words in cut]
    gaps = [(parts, k, words[k]) for words, parts in zip(cut, found, strict=True) if None in parts for k, x in enumerate(parts) if x is None]
    if gaps:
        new = {w for _, _, w in gaps}
        # a letter and one closing mark are different pieces to the tokenizer, so such a word needs no call of its own
        closed = {w for w in new if w[-1:] in _MARKS and w[-2:-1].isalpha()}
        asked = sorted({w for w in (new - closed).union((w[:-1] for w in closed), _MARKS) if w not in table})
        if direct:
            model, rest = tokenizer.model, []
            for w in asked:
                if (letters := _letters(w)) is None:
                    rest.append(w)
                else:
                    table[w] = b"".join([code[x.id] for x in model.tokenize(letters)])
            asked = rest
        fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for k in range(0, len(asked), 20_000):
            part = asked[k : k + 20_000]
            for w, e in zip(part, fast([w.decode("utf-8") for w in part], add_special_tokens=False), strict=True):
                table[w] = b"".join([code[i] for i in e.ids])
        for w in closed:
            table[w] = table[w[:-1]] + table[w[-1:]]
        for parts, k, w in gaps:
            parts[k] = table[w]
    end = END_ID.to_bytes(wide, "little")
    return [b"".join(parts) + end for parts in found], wide


def write_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of files, in ascending order of keys: part, file, keys, n_ids, data.

    Documents are range-partitioned and sorted by key; each partition makes files of FILE_IDS ids or one document more.
    """
    kind = dict(docs.dtypes)[key]
    dealt = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    schema = f"part int, file int, keys array<{kind}>, n_ids bigint, data binary"
    to_arrow = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("keys", pa.list_(_arrow_type(dealt.schema[key].dataType))), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, counts, size, part, file, wide = [], [], [], 0, 0, 0, 2

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "keys": keys, "n_ids": size // wide, "data": pack_file(b"".join(ids), counts, wide)}], schema=to_arrow)

        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = batch.column(1)
            if len(own):
                part = batch.column(2)[0].as_py()
            for k in range(0, len(own), 500):
                found, wide = _encode(path, texts[k : k + 500].to_pylist())
                keys += own[k : k + 500]
                ids += found
                counts += [len(x) // wide for x in found]
                size += sum(map(len, found))
                if size >= FILE_IDS * wide:
                    yield close()
                    keys, ids, counts, size, file = [], [], [], 0, file + 1
        if keys:
            yield close()

    return Scratch(docs.sparkSession, "tokens").write(dealt.mapInArrow(run, schema))


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 for each document, from the files, each document by itself through its file's Elias-Fano ends.

    A file's first id has the number of ids of all files before it; that running sum goes over one row per file.
    """
    sizes = files.select("part", "file", "n_ids")
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("base", F.coalesce(before, F.lit(0))).drop("n_ids")
    kind = files.schema["keys"].dataType.elementType.simpleString()
    to_arrow = pa.schema([(key, _arrow_type(files.schema["keys"].dataType.elementType)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = TokenFile(batch.column(1)[k].as_py())
                base = batch.column(2)[k].as_py()
                starts, counts, sums = [], [], []
                for d in range(f.ends.n):
                    start, ids = f.document(d)
                    starts.append(base + start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], schema=to_arrow)

    joined = files.join(placed, ["part", "file"]).select("keys", "data", "base")
    return joined.mapInArrow(run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
