"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the merges of neighbours. The lowest rank (the
leftmost on a tie) is merged, the new neighbours are queued, and entries whose symbols have changed meanwhile are skipped as
stale. Decoding puts the vocabulary's strings one after another, with a blank between them, which is what the file's absent
decoder stands for.

The file's stages are followed: special tokens in the raw text, NFC, white space, lower case, split pattern, bytes as visible
characters, merges with an end-of-word mark. No stage looks past ASCII white space, so a text is cut there first and every
different word is encoded once per worker. The word table has a fixed size; it only saves time.

Edge cases: a null text is empty; an empty text has no tokens, and both digests are those of nothing; very long texts are encoded whole, word by word; ties of ranks go to the left; repeated rows each get a
row; further columns are carried through by ``encode``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import map_arrow

#: Entries after which the newer half of a worker's table of words is dropped; the words met first are the frequent ones.
TABLE_SIZE = 250_000


def visible_bytes() -> dict[int, str]:
    """The usual stand-in characters of byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def halve(table: dict) -> None:
    for k in list(islice(table, len(table) // 2, None)):
        del table[k]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, parts = j["model"], {"normalizers": [x["type"] for x in j["normalizer"]["normalizers"]], "pre": [x["type"] for x in j["pre_tokenizer"]["pretokenizers"]]}
        if parts != {"normalizers": ["NFC", "Replace", "Lowercase"], "pre": ["Split", "ByteLevel"]} or j["decoder"] or model["byte_fallback"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} isn't of the kind that is read here")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        #: Rank of a merge by the ids of its two symbols, and the id of what it makes by its rank.
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: k for k, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.strings = {v: k for k, v in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.first = [self.vocab[c] for _, c in sorted(visible_bytes().items())]
        self.last = [self.vocab[c + self.end] for _, c in sorted(visible_bytes().items())]
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[bytes, tuple[int, str, str]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """The list's symbols after all merges; an entry of the queue is rank and place, and stale if the pair there has another rank."""
        n, ranks, made = len(ids), self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | k for k in range(n - 1) if (r := ranks.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            k, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[k]
            if j >= n or ids[k] < 0 or ranks.get(ids[k] << 32 | ids[j]) != rank:
                continue  # stale
            ids[k] = both = made[rank]
            ids[j] = -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := ranks.get(both << 32 | ids[j])) is not None:
                    heapq.heappush(queue, r << 32 | k)
            j = before[k]
            if j >= 0 and (r := ranks.get(ids[j] << 32 | both)) is not None:
                heapq.heappush(queue, r << 32 | j)
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the split pattern."""
        known = self.pieces.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = [self.first[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            known = self.merge(ids)
            if len(self.pieces) >= TABLE_SIZE:
                halve(self.pieces)
            self.pieces[piece] = known
        return known

    def plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        return [i for p in self.pattern.findall(text) for i in self.piece(p)]

    def ids(self, text: str) -> list[int]:
        """Ids of any text."""
        if self.cut is None or "<" not in text:
            return self.plain(text)
        return [i for k, x in enumerate(self.cut.split(text)) for i in ([self.special[x]] if k % 2 else self.plain(x))]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def word(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids of a word, then each id and each string followed by a blank."""
        ids = self.ids(raw.decode("utf-8", "surrogatepass"))
        out = (len(ids), "".join(f"{i} " for i in ids), "".join(f"{self.strings[i]} " for i in ids))
        if len(self.words) >= TABLE_SIZE:
            halve(self.words)
        self.words[raw] = out
        return out

    def text(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by blanks, decoded text."""
        words, get, add = (text or "").encode("utf-8", "surrogatepass").split(), self.words.get, self.word
        found = [get(w) or add(w) for w in words]
        return sum([x[0] for x in found]), "".join([x[1] for x in found])[:-1], "".join([x[2] for x in found])[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Made once per worker. The path must be readable on every executor, as an installed vocabulary is."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of docs with token_ids (array of int) and decoded (their decoded text); columns of these two names are replaced."""
    docs = docs.drop("token_ids", "decoded")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", token_ids array<int>, decoded string"

    def rows(batch: pa.RecordBatch) -> dict:
        found = [codec(path).text(x) for x in batch.column(names.index(text)).to_pylist()]
        ids = np.fromstring(" ".join(filter(None, (x[1] for x in found))), np.int32, sep=" ")
        ends = np.concatenate(([0], np.cumsum([x[0] for x in found]))).astype(np.int32)
        return dict(zip(names, batch.columns, strict=True)) | {"token_ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), "decoded": [x[2] for x in found]}

    return map_arrow(docs, rows, schema, 100)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 for each document: encode's outcome without moving it out of the worker."""
    kind = dict(docs.dtypes)[key]

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in batch.column(1).to_pylist():
            n, ids, decoded = codec(path).text(x)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return {key: batch.column(0)} | out

    return map_arrow(docs.select(key, text), rows, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
