"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

A node that stands for n shards is split along its widest dimension into n // 2 and the rest, at the place where the rows before
it hold that share of its bytes, until each leaf is one shard. All nodes of a level are cut together. The place is found without
moving rows: each round sums bytes in 4,096 slices of every node's interval (partial sums, at most nodes * 4,096 rows), picks the
slice in which the wanted share is reached, and narrows the interval to the values that occur in it.

Rows are ordered by dimension, then by a hash of the text, then by key, so equal texts stay together. A group of equal order whose
bytes are under WHOLE_GROUP, one hundredth of a shard, is not cut, which costs the balance of a cut half of that at most; a larger one is cut by key (numbers as they are, keys of other types by their hash), however many rows it has.

Edge cases: a null text has size 8 (no bytes, and 8 for the row), CRC 0 and lies at the low end of each dimension; rows that agree in
text and key stay together; null keys come first; very long texts count by their bytes alone; columns that begin with an underscore don't clash, as only key, text and dimensions are read; with fewer rows than shards some shards stay empty; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

SLICES = 4096
STEPS = (1 << 20) - 1  # of a dimension
WHOLE_GROUP = 0.01  # of a shard's bytes
BUCKET_ROWS = 20_000


def default_dimensions(text: str = "text", lang: str = "lang") -> dict[str, Column]:
    """Of the text's metadata: bytes (as logarithm), language (its CRC, so that all of the label counts), share of characters beyond ASCII."""
    size, chars = F.octet_length(F.col(text)), F.length(F.col(text))
    return {"d_size": F.log2(F.coalesce(size, F.lit(0)) + 1.0), "d_lang": F.coalesce(F.crc32(F.col(lang).cast("binary")), F.lit(-1)).cast("double"), "d_wide": F.coalesce((size - chars) / F.when(chars > 0, chars), F.lit(0.0))}


@dataclass
class Cut:
    """Rows of the node go right if their code along the dimension is over code, or equal to it and their key is over key."""

    node: int
    left: int
    dimension: str
    code: int
    all_left: bool | None = None  # of the rows with that code; None: by key
    key: int | None = None
    key_left: bool = True

    def right(self) -> Column:
        c = F.col(self.dimension)
        if self.all_left is not None:
            return c > self.code if self.all_left else c >= self.code
        key = F.col("_key")
        return (c > self.code) | ((c == self.code) & (key > self.key if self.key_left else key >= self.key))


@dataclass
class Node:
    first: int
    shards: int
    bytes: int
    need: float
    dimension: str
    low: int
    high: int
    ties: bool = False
    code: int | None = None


def _slice(value: Column, low: int, width: int) -> Column:
    if width < 1 << 41:  # below 2^53 in all, so that doubles are exact
        return F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
    wide = [c.cast("decimal(20,0)") for c in (value, F.lit(low), F.lit(width))]
    return F.floor((wide[0] - wide[1]) / wide[2]).cast("int")


def _split(rows: DataFrame, node: Column, nodes: list[Node], whole: float) -> list[Cut]:
    """One cut for each node."""
    cuts, open_ = [], {n.first: n for n in nodes}
    while open_:
        value = F.lit(None).cast("long")
        slice_, within = F.lit(None).cast("int"), F.lit(False)
        for n in open_.values():
            own = F.col("_key" if n.ties else n.dimension)
            here = (F.col("_node") == n.first) & own.between(n.low, n.high)
            if n.ties:
                here = here & (F.col(n.dimension) == n.code)
            width = max(1, -(-(n.high - n.low + 1) // SLICES))
            value = F.when(F.col("_node") == n.first, own).otherwise(value)
            slice_ = F.when(F.col("_node") == n.first, _slice(own, n.low, width)).otherwise(slice_)
            within = within | here
        sums = rows.withColumn("_node", node).where(within).select("_node", slice_.alias("_slice"), value.alias("_v"), "size").groupBy("_node", "_slice").agg(F.sum("size").alias("b"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("b").over(Window.partitionBy("_node").orderBy("_slice"))
        need = F.lit(0.0)
        for n in open_.values():
            need = F.when(F.col("_node") == n.first, F.lit(float(n.need))).otherwise(need)
        sums = sums.withColumn("upto", upto).withColumn("all", F.sum("b").over(Window.partitionBy("_node"))).where((F.col("upto") >= need) | (F.col("upto") == F.col("all")))
        for r in sums.groupBy("_node").agg(F.min(F.struct("_slice", "b", "lo", "hi", "upto")).alias("x")).collect():
            n, x = open_[r["_node"]], r["x"]
            n.need -= x["upto"] - x["b"]
            n.low, n.high = x["lo"], x["hi"]
            if n.low < n.high:
                continue
            half = n.need * 2 >= x["b"]
            if n.ties:
                cuts.append(Cut(n.first, n.shards // 2, n.dimension, n.code, None, n.low, half))
            elif x["b"] <= whole:
                cuts.append(Cut(n.first, n.shards // 2, n.dimension, n.low, half))
            else:
                n.ties, n.code, n.low, n.high = True, n.low, -(1 << 63), (1 << 63) - 1
                continue
            del open_[n.first]
    return cuts


def assign(rows: DataFrame, dimensions: list[str], shards: int) -> Column:
    """The shard of each of the written rows (size, dimensions as codes, _key), as a decision tree of at most shards - 1 cuts."""
    cuts: dict[tuple[int, int], Cut] = {}
    counts, whole = {0: shards}, None

    def tree(first: int, n: int) -> Column:
        if (c := cuts.get((first, n))) is None:
            return F.lit(first)
        return F.when(c.right(), tree(first + c.left, n - c.left)).otherwise(tree(first, c.left))

    while any(n > 1 for n in counts.values()):
        node = tree(0, shards)
        spans = rows.withColumn("_node", node).groupBy("_node").agg(F.sum("size").alias("b"), *(f(d).alias(f"{k}{d}") for d in dimensions for k, f in (("lo_", F.min), ("hi_", F.max))))
        nodes = []
        for r in spans.collect():
            n = counts[r["_node"]]
            if n > 1:
                widest = max(dimensions, key=lambda d: (r[f"hi_{d}"] >> 32) - (r[f"lo_{d}"] >> 32))
                nodes.append(Node(r["_node"], n, r["b"], r["b"] * (n // 2) / n, widest, r[f"lo_{widest}"], r[f"hi_{widest}"]))
        if whole is None:
            whole = WHOLE_GROUP * sum(n.bytes for n in nodes) / shards
        for c in _split(rows, node, nodes, whole):
            cuts[c.node, counts[c.node]] = c
        counts = {k: v for first, n in counts.items() for k, v in ([(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, n)])}
    return tree(0, shards).cast("int")


def with_slots(rows: DataFrame, n_rows: int, shards: int, shard: str, order: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: rows before the row's bucket of hash order, and before it in its bucket."""
    buckets = max(1, n_rows // (shards * BUCKET_ROWS))
    rows = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(shard, "_b").count()
    ahead = F.coalesce(F.sum("count").over(Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(shard, "_b", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(shard, "_b").orderBy("_h", *order)) - 1
    return rows.withColumn("_place", place).join(counts, [shard, "_b"]).withColumn("slot", F.col("_ahead") + F.col("_place")).drop("_h", "_b", "_ahead", "_place")


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """key, size, text_crc32, shard and slot for each document; shards hold nearly equal bytes."""
    dims = dimensions or default_dimensions(text)
    scratch = Scratch(docs.sparkSession, "shards")
    raw = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_text"),
        F.coalesce(F.col(key).cast("long") if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(key)), F.lit(-(1 << 63))).alias("_key"),
        *(c.alias(d) for d, c in dims.items()),
    )
    raw = scratch.write(raw)
    seen = raw.agg(F.count("*").alias("n"), *(f(d).alias(f"{k}{d}") for d in dims for k, f in (("lo_", F.min), ("hi_", F.max)))).first()

    def code(d: str) -> Column:
        low, span = seen[f"lo_{d}"] or 0.0, (seen[f"hi_{d}"] or 0.0) - (seen[f"lo_{d}"] or 0.0)
        step = F.floor((F.col(d) - F.lit(low)) / F.lit(span or 1.0) * STEPS).cast("long")
        return F.shiftleft(step, 32) + F.col("_text").bitwiseAND(F.lit((1 << 32) - 1))

    coded = raw.select(key, "size", "text_crc32", "_text", "_key", *(code(d).alias(d) for d in dims))
    placed = coded.withColumn("shard", assign(coded, list(dims), shards))
    return with_slots(placed.select(key, "size", "text_crc32", "shard", "_text"), seen["n"], shards, "shard", [key, "_text"]).drop("_text")
