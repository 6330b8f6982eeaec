"""Merkle manifest: a hash tree over each group of rows and one over the groups, with a proof for every row.

Superblock reduction: the leaves of a group are numbered in order; FANOUT ** LEVELS consecutive ones are a bucket, and one applyInArrow
group collapses LEVELS levels of the tree in it. Bucket roots are the next round's leaves until each group has one node; the groups' nodes
then go the same way. Proofs come down again: a bucket's upper proof is joined to its nodes once (cogroup), their lower siblings are
recomputed in the bucket, and no table holds a proof for each row.

Rows are numbered by a range sort over (group, key, leaf), so a group may hold any share of all rows: what is counted in one place is a row
for each partition of that sort. A bucket has FANOUT ** LEVELS nodes of 64 letters at most.

Edge cases: a null field is told from an empty one; null groups are a group, first in order; null keys come first in their group; rows of one
key are ordered by their leaves, equal rows have equal leaves and stand next to each other; a group of one row has its leaf as its node;
texts are hashed whole; an empty table has no root and gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, ship

#: So many consecutive nodes become one: 2 ** BITS.
BITS = 4
FANOUT = 1 << BITS
#: Levels that one bucket collapses.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it is hashed: '-' for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _layers(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of one bucket from its nodes on, the last one node; n: nodes of the whole tree at this level."""
    layers = [nodes]
    while len(layers) <= levels and n > 1:
        own = layers[-1]
        layers.append([_hash("".join(own[k : k + FANOUT])) for k in range(0, len(own), FANOUT)])
        n = -(-n // FANOUT)
    return layers


def _collapse(levels: int, bucket: pa.Table) -> pa.Table:
    bucket = bucket.sort_by("idx")
    n = bucket["n"][0].as_py()
    layers = _layers(bucket["node"].to_pylist(), n, levels)
    return pa.table(
        {"tree": [bucket["tree"][0].as_py()], "idx": [bucket["idx"][0].as_py() >> BITS * levels], "n": [-(-n // FANOUT ** (len(layers) - 1))], "node": layers[-1]},
        schema=pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string())]),
    )


def _siblings(layer: list[str], at: int) -> tuple[str, str]:
    """What stands left and right of a node in its run."""
    start = at // FANOUT * FANOUT
    return "".join(layer[start:at]), "".join(layer[at + 1 : start + FANOUT])


_STRINGS = pa.list_(pa.string())


def _hand_down(levels: int, bucket: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's siblings up to the top, from those of its bucket's root; the crown's nodes are the groups' own."""
    bucket = bucket.sort_by("idx")
    nodes, idx = bucket["node"].to_pylist(), bucket["idx"].to_pylist()
    layers = _layers(nodes, bucket["n"][0].as_py(), levels)
    top = above.to_pylist()[0]
    left, right = [], []
    for k in range(len(nodes)):
        pairs = [_siblings(layer, k >> BITS * level) for level, layer in enumerate(layers[:-1])]
        left.append([x for x, _ in pairs] + top["left"])
        right.append([x for _, x in pairs] + top["right"])
    subroot = [top["subroot"]] * len(nodes) if top["subroot"] else nodes
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("left", _STRINGS), ("right", _STRINGS), ("subroot", pa.string())])
    return pa.table({"tree": bucket["tree"].to_pylist(), "idx": idx, "left": left, "right": right, "subroot": subroot}, schema=schema)


def _verify(levels: int, bucket: pa.Table, above: pa.Table) -> pa.Table:
    """Each leaf's proof, hashed, and the root that its claimed leaf folds to."""
    bucket = bucket.sort_by("idx")
    nodes, claims = bucket["node"].to_pylist(), bucket["claim"].to_pylist()
    layers = _layers(nodes, bucket["n"][0].as_py(), levels)
    top = above.to_pylist()[0]
    upper = list(zip(top["left"], top["right"], strict=True))
    proofs, folded = [], []
    for k, claim in enumerate(claims):
        pairs = [_siblings(layer, k >> BITS * level) for level, layer in enumerate(layers[:-1])] + upper
        proofs.append(_hash("".join([x for pair in pairs for x in pair])))
        for x, y in pairs:
            claim = _hash(x + claim + y)
        folded.append(claim)
    added = {"subroot": [top["subroot"]] * len(nodes), "proof_sha256": proofs, "folded_root": folded}
    out = bucket.drop_columns(["tree", "idx", "n"])
    for name, values in added.items():
        out = out.append_column(name, pa.array(values, pa.string()))
    return out


NODE = "tree bigint, idx bigint, n bigint, node string"
CHAIN = "tree bigint, idx bigint, left array<string>, right array<string>, subroot string"


def _bucket(levels: int) -> Column:
    return F.shiftright("idx", BITS * levels).alias("bucket")


def _with_levels(step: Callable, levels: int) -> Callable:
    """step for one bucket, or for a bucket and its root's proof, as Spark wants it: with types."""

    def one(bucket: pa.Table) -> pa.Table:
        return step(levels, bucket)

    def two(bucket: pa.Table, above: pa.Table) -> pa.Table:
        return step(levels, bucket, above)

    return one if step is _collapse else two


def _raise(scratch: Scratch, nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The given nodes and each further round's, until every tree has one node."""
    rounds = [nodes]
    while True:
        rounds.append(scratch.write(rounds[-1].select("tree", "idx", "n", "node").groupBy("tree", _bucket(levels)).applyInArrow(_with_levels(_collapse, levels), NODE)))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds


def _lower(nodes: DataFrame, above: DataFrame, step: Callable, levels: int, schema: str) -> DataFrame:
    return nodes.groupBy("tree", _bucket(levels)).cogroup(above.groupBy("tree", "idx")).applyInArrow(_with_levels(step, levels), schema)


def numbered(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """leaves (key, grp, node, ...) with tree, the number of their group in order, idx, their place in it, and n, its rows.

    Rows are range-sorted and written once; what a window runs over is a row for each group and partition.
    """
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "node", "row")]
    rows = scratch.write(leaves.withColumn("row", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.write(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    runs = dealt.groupBy("part", "grp").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    own = Window.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.write(runs.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(own)))
    heads = runs.where("base = 0").select("grp", F.col("part").alias("head"))
    parts = heads.groupBy("head").agg(F.count("*").alias("trees"))
    parts = parts.select("head", F.coalesce(F.sum("trees").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("trees"))
    trees = heads.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(F.col("grp").asc_nulls_first()))).join(parts, "head")
    trees = trees.select(F.col("grp").alias("of"), (F.col("trees") + F.col("place") - 1).cast("long").alias("tree"))
    known = runs.join(trees, F.col("grp").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), F.col("grp").alias("g"), "tree", (F.col("base") - F.col("first")).alias("shift"), "n")
    joined = dealt.join(known, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return scratch.write(joined.select(*leaves.columns, "tree", (F.col("at") + F.col("shift")).alias("idx"), F.col("n").cast("long").alias("n")))


def prove(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """leaves: key, grp (string), node (the leaf's digest), claim (what is to be proven, the same or another digest).

    Gives key, grp, leaf, subroot, root, proof_sha256 (of all siblings on the way up), folded_root (from the claim and the true siblings) and verified (whether that is the root).
    """
    ship(leaves.sparkSession)
    scratch = Scratch(leaves.sparkSession, "merkle")
    trees = _raise(scratch, numbered(scratch, leaves.select("key", "grp", "node", "claim")), levels)
    n = trees[-1].count()
    crown = _raise(scratch, trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("n"), "node"), levels)
    top = crown[-1].first()
    root = F.lit(top.node if top else None).cast("string")
    none = F.array().cast("array<string>")
    chain = crown[-1].select("tree", "idx", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"))
    for k in range(len(crown) - 2, -1, -1):
        chain = scratch.write(_lower(crown[k], chain.withColumn("subroot", F.lit(None).cast("string")), _hand_down, levels, CHAIN))
    chain = chain.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "left", "right", "subroot")
    for nodes in trees[-2:0:-1]:
        chain = scratch.write(_lower(nodes, chain, _hand_down, levels, CHAIN))
    key = dict(leaves.dtypes)["key"]
    out = _lower(trees[0], chain, _verify, levels, f"key {key}, grp string, node string, claim string, subroot string, proof_sha256 string, folded_root string")
    return out.select("key", "grp", F.col("node").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
