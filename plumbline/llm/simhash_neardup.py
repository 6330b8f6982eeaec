"""SimHash near-duplicates, found by BK-trees over shards.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its 3-word shingles. Equal fingerprints are merged first
(a partial aggregate), so copies cost nothing further on. Two fingerprints within two bits agree in one at least of three blocks
of bits; each fingerprint is sent to the three shards named by its blocks, 2^21 or 2^22 shards for a block. Each shard grows a BK-tree:
a child hangs on its integer Hamming distance to the parent, and a search for radius 2 follows only the edges from d-2 to d+2. What
leaves a shard is a spanning forest of its links, not its pairs; components joins the forests.

A shard with more than ``MOST`` fingerprints (a cluster of near copies can fill one) is split: its fingerprints go by four of six blocks instead, which two within two
bits share as well, and such a shard's differ in 22 bits at most. Either way finds the same links.

The trees reach their queries by the shuffle that makes the shards, not by a broadcast from the driver: the driver would have to
collect the fingerprints of all documents.

Edge cases: null, empty and blank texts get fingerprint zero and are linked like any other; one or two words are one shingle; very long texts are read whole;
null keys are ignored when a component's smallest key is sought (null if it has no other); repeated rows each get a row; of keys that tie for the smallest either is the same; further columns are ignored by
near_duplicates and carried by keep_one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, components, join_spread, map_arrow, unsigned_hex, with_row_id
from plumbline.shipping import ship

RADIUS = 2
SHINGLE = 3
MOST = 20_000  # fingerprints of a shard
#: Of keep_one_alike, besides the radius: words of a shingle and Jaccard similarity; texts whose shingles tell which are frequent.
STAGE_SHINGLE = 5
SIMILARITY = 0.8
SAMPLE = 2000
FREQUENT = 100_000  # of the sample's shingles, the most frequent ones: which they are bears on the order only, not on what is found
BITS = 4096
STEP_KEYS = 200_000  # that Python holds at once
PART = 500  # members of a group that are held against each other in one part
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter([one(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):  # little-endian: octet k holds bits 8k to 8k + 7
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(2 * ones > len(starts)):
            value |= 1 << (8 * k + int(bit))
    return value


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys of each row and its fingerprint as a signed long, fp."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", fp bigint"

    def rows(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(x) for x in batch.column(len(keys)).to_pylist()], np.uint64).view(np.int64)
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"fp": pa.array(found)}

    return map_arrow(docs.select(*keys, text), rows, schema)


class BKTree:
    """Of 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            k = todo.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            children = self.children[k]
            if children:
                if len(children) <= 2 * radius + 1:
                    todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
                else:
                    todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found

    def add(self, value: int) -> None:
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        k = 0
        while place:
            d = (self.values[k] ^ value).bit_count()
            if d not in self.children[k]:
                self.children[k][d] = place
                break
            k = self.children[k][d]


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among different values, found by one BK-tree."""
    tree, root, links = BKTree(), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for place, value in enumerate(values):
        root.append(place)
        for other in tree.near(value, radius):
            a, b = top(place), top(other)
            if a != b:
                root[a] = b
                links.append((value, values[other]))
        tree.add(value)
    return links


def _masks(blocks: int) -> list[int]:
    """Bits of all but RADIUS of so many blocks: two fingerprints within the radius agree in those of one of these masks."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(parts, blocks - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (shard, fp) sorted by shard; a shard may go over several batches."""
    held_shard, held = None, np.zeros(0, np.int64)

    def links(fps: np.ndarray) -> list[tuple[int, int]]:
        fps = np.unique(fps)
        return forest(fps.view(np.uint64).tolist()) if len(fps) > 1 else []

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        shards, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(shards):
            continue
        cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(shards)]))
        found: list[tuple[int, int]] = []
        first = 0
        if held_shard is not None:
            if shards[0] == held_shard:
                held = np.concatenate((held, fps[: stops[0]]))
                first = 1
            if first == 0 or len(starts) > 1:
                found += links(held)
                held_shard = None
        if first < len(starts):
            for k in np.flatnonzero(stops[first:-1] - starts[first:-1] > 1) + first:
                found += links(fps[starts[k] : stops[k]])
            held_shard, held = shards[starts[-1]], fps[starts[-1] :].copy()
        if found:
            yield batch_of(found)
    if held_shard is not None and (found := links(held)):
        yield batch_of(found)


def _dealt(fps: DataFrame, blocks: int) -> DataFrame:
    shards = F.array(*(F.xxhash64(F.lit(blocks), F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(_masks(blocks))))
    return fps.select(F.explode(shards).alias("shard"), "fp")


def near_links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that join any two of the different fingerprints fp within the radius, through a spanning forest per shard."""
    wide = _dealt(distinct, RADIUS + 1)
    full = wide.groupBy("shard").count().where(F.col("count") > most).select("shard")
    crowded = wide.join(full, "shard", "left_semi").select("fp").distinct()
    dealt = wide.join(full, "shard", "left_anti").union(_dealt(crowded, 2 * RADIUS + 2)).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_shard_links, "a bigint, b bigint")


def _rooted(scratch: Scratch, marked: DataFrame, best) -> DataFrame:
    """A row (fp, root, best, _rows) for each different fingerprint; best aggregates over the rows with that fingerprint, _rows counts them."""
    distinct = scratch.write(marked.groupBy("fp").agg(best.alias("best"), F.count("*").alias("_rows")))
    roots = components(scratch, near_links(distinct.select("fp"))).toDF("fp", "root")
    return scratch.write(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "best", "_rows"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, fingerprint (16 hex digits), component_id (smallest key reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, [key], text))
    rooted = _rooted(scratch, marked, F.min(key))
    least = rooted.groupBy("root").agg(F.min("best").alias("component_id"))
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id", "_rows"))
    return join_spread(marked, named, "fp", marked.count()).select(key, unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest key (null last, then in reading order)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    numbered = with_row_id(scratch, docs, "_plumb_row")
    marked = scratch.write(fingerprints(numbered, [key, "_plumb_row"], text))
    rooted = _rooted(scratch, marked, F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("_plumb_row"))))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best._plumb_row").alias("_plumb_row"))
    return numbered.join(stay, "_plumb_row", "left_semi").select(*docs.columns)


def shingle_hashes(text: str | None, width: int = STAGE_SHINGLE) -> np.ndarray:
    """The different hashes of the text's shingles, in order; a text of fewer words is one shingle, one without words the empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([one(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))], np.uint64))


def _sets(docs: DataFrame) -> DataFrame:
    """(id, text) to id, h (the shingles' hashes as bytes)."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "h": [shingle_hashes(x).tobytes() for x in batch.column(1).to_pylist()]}

    return map_arrow(docs, rows, "id bigint, h binary")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the known ones, which are sorted: by binary search, the known ones may be many."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, id, n): the first shingles of each text of n different ones, as many as two alike sets can't both do without.

    Sets of n and m shingles with similarity SIMILARITY have 0.8 n in common at least; so if all are put into one order, the first
    n - 0.8 n + 1 of one and of the other have one in common. Any one order serves; shingles known as frequent come last.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of() -> pa.RecordBatch:
            lengths = [len(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], names=["key", "id", "n"])

        keys, ids, sizes, held = [], [], [], 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(text.as_py())
                first = h[np.argsort(_among(h, frequent), kind="stable")][: len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-9)) + 1]
                keys.append(first)
                ids.append(k)
                sizes.append(len(h))
                held += len(first)
                if held > STEP_KEYS:
                    yield batch_of()
                    keys, ids, sizes, held = [], [], [], 0
        if keys:
            yield batch_of()

    ship(docs.sparkSession)
    return docs.mapInArrow(rows, "key bigint, id bigint, n int")


def _bits(docs: DataFrame) -> DataFrame:
    """(id, text) to id, n (different shingles) and bits: of BITS bits those that a shingle's hash falls on."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(x) for x in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "n": [len(h) for h in sets], "bits": [np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) > 0).tobytes() for h in sets]}

    return map_arrow(docs, rows, "id bigint, n int, bits binary")


def _alike(scratch: Scratch, pairs: DataFrame, docs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of SIMILARITY or more.

    A bit that one set has and the other hasn't stands for a shingle that isn't shared, which rules most pairs out; the others' sets are compared.
    """

    def within(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return both >= SIMILARITY * (n + m - both) - 1e-9

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
                left, right = (np.bitwise_count(p & ~q).sum(axis=1) for p, q in ((x, y), (y, x)))
                good = within(np.minimum(n - left, m - right), n, m)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(bool(within(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda t, c: t.withColumnsRenamed({k: c if k == "id" else f"{c}_{k}" for k in t.columns})
    met = pairs.join(side(bits, "a"), "a").join(side(bits, "b"), "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    near = scratch.write(met.mapInArrow(chances, "a bigint, b bigint"))
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = scratch.write(_sets(docs.join(ids, "id", "left_semi")))
    number = scratch.count
    out = scratch.write(near.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "a_h", "b_h").mapInArrow(same, "a bigint, b bigint"))
    scratch.drop(number)
    return out


def alike_links(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join any two of the texts (id, text) whose shingles have a Jaccard similarity of SIMILARITY or more.

    Each text is held against the first of a key's group that it shares most keys with; then those of one group that aren't in one component
    yet against the group's first; then what is still apart each with each, dealt out in parts. Pairs within a component can add nothing.
    """

    def known(batch: pa.RecordBatch) -> dict:
        return {"h": [shingle_hashes(x).view(np.int64).tolist() for x in batch.column(1).to_pylist()]}

    share = max(1, docs.count() // SAMPLE)
    sample = map_arrow(docs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), known, "h array<bigint>").select(F.explode("h").alias("h")).groupBy("h").count().where("count > 2")
    frequent = np.sort(np.array([r.h for r in sample.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))
    dealt = scratch.write(_prefixes(docs, frequent))
    groups = dealt.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("most"), F.min_by("n", "id").alias("head_n")).where("head < most").drop("most")
    members = scratch.write(dealt.join(groups, "key"))
    bits = scratch.write(_bits(docs.join(members.select("id").distinct(), "id", "left_semi")))

    def fits(n: str, m: str) -> Column:
        return (F.col(n) >= SIMILARITY * F.col(m) - 1e-6) & (F.col(m) >= SIMILARITY * F.col(n) - 1e-6)

    heads = members.where((F.col("id") != F.col("head")) & fits("n", "head_n")).groupBy("id", "head").agg(F.count("*").alias("shared"))
    heads = scratch.write(heads)
    best = heads.groupBy("id").agg(F.max_by("head", F.struct("shared", -F.col("head"))).alias("b")).withColumnRenamed("id", "a")
    links = _alike(scratch, best, docs, bits)
    roots = components(scratch, links).toDF("id", "root")

    def rooted(rows: DataFrame, c: str, root: str) -> DataFrame:
        return rows.join(roots.toDF(c, root), c, "left").withColumn(root, F.coalesce(root, c))

    others = rooted(rooted(heads.select(F.col("id").alias("a"), F.col("head").alias("b")), "a", "_ra"), "b", "_rb").where("_ra <> _rb").select("a", "b")
    links = links.union(_alike(scratch, scratch.write(others), docs, bits))
    roots = components(scratch, links).toDF("id", "root")
    members = rooted(members.select("key", "id", "n"), "id", "root")
    apart = members.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("r < s").select("key", "parts")
    members = scratch.write(members.join(apart, "key"))
    # each member of a group meets each part of it
    left = members.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("n").alias("_na"), F.col("root").alias("_ra"))
    right = members.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("root").alias("_rb"))
    rest = left.join(right, ["key", "part"]).where((F.col("a") < F.col("b")) & (F.col("_ra") != F.col("_rb")) & fits("_na", "_nb")).select("a", "b").distinct()
    return links.union(_alike(scratch, scratch.write(rest), docs, bits))


def keep_one_alike(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest key (null last, then in reading order).

    Texts are of one group if their shingles of five words have a Jaccard similarity of 0.8 or more, or if their fingerprints are
    within the query's radius.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    numbered = with_row_id(scratch, docs, "_plumb_row")
    marked = scratch.write(fingerprints(numbered, [key, "_plumb_row"], text))
    place = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_plumb_row").alias("id"))
    rooted = _rooted(scratch, marked, F.min(place))
    # equal texts have equal shingles: the first of each text is held against the others
    same = numbered.withColumn("_ta", F.xxhash64(text)).withColumn("_tb", F.xxhash64(F.lit(7), text)).groupBy("_ta", "_tb").agg(F.min("_plumb_row").alias("_plumb_row")).select("_plumb_row")
    alike = alike_links(scratch, numbered.join(same, "_plumb_row", "left_semi").select(F.col("_plumb_row").alias("id"), text))
    # rows to the roots of their fingerprints; links of texts become links of roots
    at = scratch.write(join_spread(marked.select("_plumb_row", "fp"), rooted.select("fp", "root", "_rows"), "fp", marked.count()).select("_plumb_row", "root"))
    side = lambda c: at.toDF(c, f"{c}_root")
    wider = alike.join(side("a"), "a").join(side("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    tops = components(scratch, wider).toDF("root", "top")
    stay = rooted.join(tops, "root", "left").groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("best").alias("best"))
    return numbered.join(stay.select(F.col("best.id").alias("_plumb_row")), "_plumb_row", "left_semi").select(*docs.columns)
