"""Packing of token ids into sequences of several context sizes.

A document's ids with an end id are cut into windows of the longest context size; full ones are sequences by themselves. What is left of each document goes to the smallest context size (tier) that holds it.
Tiers are packed from the longest down: a tier's piece opens a window, its gap is filled with the longest pieces of shorter tiers that fit, and at last with the head of one that doesn't, whose rest goes to
the tier of its new length. So windows of every tier are full, and a full window of a shorter tier is a sequence of that length; only the last of a bin is padded.

Only lengths are planned with: remainders are dealt by a hash of their row into bins of BIN ids, each bin is packed by itself (applyInArrow), and its plan is joined to the ids, row by row. A bin holds a bounded number of ids
whatever documents or keys there are, at most one of its sequences is padded, and texts never leave the task that reads them.

Steps: sequences of one tier are dealt to training steps of STEP ids so that steps differ by one sequence and hardly in attention cost (the sum of the squares of the pieces' lengths): within lanes of LANE sequences they are sorted
by cost and dealt back and forth.

Edge cases: a null or empty text holds the end id alone; repeated rows and equal keys are different documents, null keys are keys; long texts are cut into many windows; ties in length go by row; an empty table
gives no pieces; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.byte_level import Encoder
from plumbline.llm.common import Scratch, ship

#: Context sizes, the longest first.
TIERS = (1024, 512, 256, 128)
#: Ids of one bin, of one step, and sequences of one lane.
BIN, STEP, LANE = 1 << 19, 1 << 16, 1 << 14
END_ID = 0

_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END_ID, size: int = TIERS[0]) -> DataFrame:
    """row (unlike in every row), key, n (ids with the end id), first (number of the first of its windows in the task), windows (ids of each full one) and rest (ids after them), as little-endian 32-bit numbers.

    To be written before it is used: rows are numbered by task.
    """
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    schema = f"row bigint, key {kind.simpleString()}, n bigint, first bigint, windows array<binary>, rest binary"
    arrow = pa.schema([("row", pa.int64()), ("key", to_arrow_type(kind)), ("n", pa.int64()), ("first", pa.int64()), ("windows", pa.list_(pa.binary())), ("rest", pa.binary())])
    wide = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(path), end.to_bytes(4, "little")
        row = first = TaskContext.get().partitionId() << 32
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            ids = [x + last for x in encoder.ids(batch.column(1).to_pylist())]
            windows = [[x[k : k + wide] for k in range(0, len(x) - wide + 1, wide)] for x in ids]
            starts = []
            for own in windows:
                starts.append(first)
                first += len(own)
            rest = [x[len(x) // wide * wide :] for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0).cast(arrow.field(1).type), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(windows, arrow.field(4).type), pa.array(rest, pa.binary())],
                schema=arrow,
            )
            row += len(ids)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


class Remainders:
    """Pieces by length; which lengths there are is a bit mask, so that the longest that fits and the shortest that doesn't are found at once."""

    def __init__(self, pieces: list[tuple[int, int]]):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0
        for row, length in sorted(pieces, reverse=True):  # the first row of a length is taken first
            self.put(length, row, 0)

    def put(self, length: int, row: int, start: int) -> None:
        self.by_length.setdefault(length, []).append((row, start))
        self.mask |= 1 << length

    def fits(self, most: int) -> int:
        """The longest length up to that; 0 if there is none."""
        return max(0, (self.mask & (1 << most + 1) - 1).bit_length() - 1)

    def over(self, length: int) -> int:
        """The shortest length above that; 0 if there is none."""
        above = self.mask >> length + 1
        return length + (above & -above).bit_length() if above else 0

    def take(self, length: int) -> tuple[int, int]:
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            self.mask &= ~(1 << length)
        return piece


def pack_bin(pieces: list[tuple[int, int]], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int]]:
    """(row, length) of each piece, none longer than the longest tier, to (row, start, length, sequence, offset, tier) of each part.

    Every sequence has exactly its tier's length but for the last, which has the longest tier to be padded to, unless it happens to fill one.
    """
    left, out, numbers = Remainders(pieces), [], count()
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (length := left.fits(tier)) > below:
            number, at, window = next(numbers), 0, []
            while at < tier and left.mask:
                length = left.fits(tier - at)
                if length:
                    row, start = left.take(length)
                else:
                    whole, length = left.over(tier - at), tier - at
                    row, start = left.take(whole)
                    left.put(whole - length, row, start + length)
                window.append((row, start, length, number, at))
                at += length
            out += [(*x, at if at in tiers else tiers[0]) for x in window]
    return out


PLAN = "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint, tier int"
#: Sequences of bins are told from whole windows by this bit.
PACKED = 1 << 61


def _pack(tiers: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    names = ("row", "start", "length", "sequence_id", "offset", "tier")

    def pack(bin_: pa.Table) -> pa.Table:
        base = PACKED | bin_["bin"][0].as_py() << 20
        parts = pack_bin(list(zip(bin_["row"].to_pylist(), bin_["length"].to_pylist(), strict=True)), tiers)
        columns = [list(x) for x in zip(*parts, strict=True)]
        columns[3] = [base + x for x in columns[3]]
        return pa.table([pa.array(x, pa.int32() if c == "tier" else pa.int64()) for c, x in zip(names, columns, strict=True)], names=list(names))

    return pack


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END_ID, tiers: tuple[int, ...] = TIERS, bin_ids: int = BIN) -> DataFrame:
    """key, start, length, ids, doc_tokens, sequence_id, offset and tier of every piece; ids are little-endian 32-bit numbers, key has its own name."""
    if list(tiers) != sorted(set(tiers), reverse=True) or not tiers or tiers[-1] < 1:
        raise ValueError("tiers are positive and descend")
    size = tiers[0]
    scratch = Scratch(docs.sparkSession, "packing")
    coded = scratch.write(tokens(docs, path, key, text, end, size))
    whole = coded.select("key", "n", "first", F.posexplode("windows").alias("k", "ids"))
    whole = whole.select("key", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids", "n", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(size).alias("tier"))

    short = coded.select("row", (F.col("n") % size).alias("length")).where("length > 0")
    bins = 1 + (short.agg(F.sum("length")).first()[0] or 0) // bin_ids
    plan = short.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins))).groupBy("bin").applyInArrow(_pack(tiers), PLAN)
    # a document's rest begins where its windows end
    parts = scratch.write(plan).join(coded.where(f"n % {size} > 0").select("row", "key", "n", "rest"), "row")
    ids = F.expr("substring(rest, int(4 * start) + 1, int(4 * length))")
    parts = parts.select("key", (F.col("n") - F.col("n") % size + F.col("start")).alias("start"), "length", ids.alias("ids"), "n", "sequence_id", "offset", "tier")
    return whole.union(parts).withColumnsRenamed({"key": key, "n": "doc_tokens"})


def steps(pieces: DataFrame, step_ids: int = STEP, lane: int = LANE) -> DataFrame:
    """sequence_id, tier, tokens, cost and step of every sequence of pieces (sequence_id, tier, length); steps of a tier and lane differ by one sequence at most."""
    square = F.col("length") * F.col("length")
    sequences = Scratch(pieces.sparkSession, "steps").write(pieces.groupBy("sequence_id").agg(F.first("tier").alias("tier"), F.sum("length").alias("tokens"), F.sum(square).alias("cost")))
    lanes = 1 + sequences.count() // lane
    own = Window.partitionBy("lane", "tier")
    sequences = sequences.withColumn("lane", F.pmod(F.xxhash64("sequence_id"), F.lit(lanes)))
    sequences = sequences.withColumn("place", F.row_number().over(own.orderBy(F.desc("cost"), "sequence_id")) - 1).withColumn("groups", F.ceil(F.count("*").over(own) * F.col("tier") / step_ids))
    turn, at = F.floor(F.col("place") / F.col("groups")), F.col("place") % F.col("groups")
    dealt = F.when(turn % 2 == 0, at).otherwise(F.col("groups") - 1 - at)
    return sequences.select("sequence_id", "tier", "tokens", "cost", F.struct("lane", "tier", dealt.cast("int").alias("number")).alias("step"))
