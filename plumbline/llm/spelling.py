"""Spelling variants: words one edit apart, and the frequent form that each rare one stands for.

Of two words that differ by one code point inserted, deleted or replaced, one half of the shorter stands unchanged in the longer: the left half at
its start or the right half at its end. Shards of an Aho-Corasick automaton hold every word's two halves; all words are scanned, hits are kept where the offset
and the lengths agree, and what is left of both words beside the half is compared.

A word isn't sent to all shards but to those that can hold a half of its own length or of one less: a half is placed by its hash, and so is each start or end of a word that could equal one (four
rows a word). A half that more than LIMIT rows share is lengthened: of the other half, again, one half stands unchanged, and so on until the block is small or the place of the
edit is known. So no task holds more than a shard's rows however many words begin alike. Where the rest that has to be compared is long, blocks are made small enough to compare word by word; else masked
forms of the rest lead to the near words, so the work grows with the words and the pairs found. A pair is found in one block alone: the one that keeps the longest common start.

A word has at most some 180 near words for each code point, so no key of the pairs grows with the table; forms are ten times as frequent as their words, so a chain of them is short and is
followed by doubling.

Edge cases: null or empty texts have no words; a null key is spelt as nothing before the colon; a text that comes twice counts twice; texts and words of any length are read whole; an empty table gives no rows;
further columns don't matter, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, ship

RUN = r"[A-Za-zÀ-ÿ]+"
#: Code points of a word at least.
LEAST = 7
#: How much more frequent a form is than its word.
TIMES = 10
#: Rows of one block at most, and of a shard on average.
LIMIT, SHARD = 20_000, 50_000
#: Rests longer than this are compared with each other, in blocks of so many rows at most.
LONG = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key and word of every run of letters with so many code points, A-Z lower-cased."""
    word = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))
    found = docs.select(F.col(key).alias("key"), word.alias("word")).where(F.char_length("word") >= least)
    plain = F.char_length("word") == F.octet_length("word")
    return found.select("key", F.when(plain, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER)).alias("word"))


def with_slips(found: DataFrame, every: int = 31) -> DataFrame:
    """word: the same but for one occurrence in so many, by the hash of key and word, which loses the code point that the hash points to."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = "int(h % char_length(word))"
    cut = F.expr(f"concat(substring(word, 1, {at}), substring(word, {at} + 2))")
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def count_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """word and n of the words that occur at least twice."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


# blocks: words of length wlen, or one longer, that agree but for the code points a to b of the shorter


def _halves(blocks: DataFrame) -> DataFrame:
    """Each block as two: what is before the middle stays as it is, or what is behind it."""
    two = F.expr("array(struct((a + b) div 2 AS a, b AS b), struct(a AS a, (a + b) div 2 AS b))")
    halves = blocks.select("word", "n", "wlen", F.explode(two).alias("s")).select("word", "n", "wlen", F.col("s.a").cast("int").alias("a"), F.col("s.b").cast("int").alias("b"))
    start, end = F.expr("substring(word, 1, a)"), F.expr("substring(word, char_length(word) - wlen + b + 1)")
    return halves.withColumn("key", F.xxhash64("wlen", "a", "b", start, end))


def _blocks(scratch: Scratch, words: DataFrame, least: int, limit: int, long: int) -> DataFrame:
    """Every word in the blocks of its own length and of the length below, none of which has more rows than the limits."""
    lengths = F.explode(F.expr("array(char_length(word), char_length(word) - 1)")).alias("wlen")
    seed = words.select("word", "n", lengths).where(F.col("wlen") >= least).select("word", "n", "wlen", F.lit(0).alias("a"), F.col("wlen").alias("b"))
    todo, ready = _halves(seed), None
    while True:
        sizes = todo.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.expr("b - a")).alias("rest"))
        crowded = scratch.write(sizes.where(f"rest > 1 AND (rows > {limit} OR rest > {long} AND rows > {long})").select("key"))
        if not crowded.count():
            return todo if ready is None else ready.union(todo)
        small = todo.join(crowded, "key", "left_anti").select(todo.columns)
        ready = small if ready is None else ready.union(small)
        todo = _halves(todo.join(crowded, "key", "left_semi"))


def _one_edit(short: str, other: str) -> bool:
    """Whether other is short with one code point replaced (equal lengths) or inserted."""
    same = bisect.bisect_left(range(1, len(short) + 1), True, key=lambda k: short[:k] != other[:k])
    return (short != other and short[same + 1 :] == other[same + 1 :]) if len(short) == len(other) else short[same:] == other[same + 1 :]


class Block:
    """The rests of one block's words, by themselves and by their masked forms."""

    def __init__(self, long: bool):
        self.long = long
        self.whole: dict[str, str] = {}
        self.masked: dict[tuple[int, str], list[str]] = {}

    def add(self, rest: str, word: str) -> None:
        if rest not in self.whole:
            self.whole[rest] = word
            if not self.long:
                for k in range(len(rest)):
                    self.masked.setdefault((k, rest[:k] + rest[k + 1 :]), []).append(word)

    def near(self, rest: str, inserted: bool) -> list[str]:
        """The words whose rest is one edit from this one."""
        if self.long:
            return [w for x, w in self.whole.items() if len(rest) == len(x) + inserted and _one_edit(x, rest)]
        shorter = [rest[:k] + rest[k + 1 :] for k in range(len(rest))]
        if inserted:
            return [self.whole[x] for x in set(shorter) if x in self.whole]
        own = self.whole.get(rest)
        return [w for k, x in enumerate(shorter) for w in self.masked.get((k, x), ()) if w != own]


def near_in_shard(rows: list[tuple[str, int, int, int]], long: int = LONG) -> list[tuple[str, str]]:
    """Pairs of near words, in both directions, from a shard's rows: word, wlen, a, b."""
    import ahocorasick

    blocks: dict[tuple, Block] = {}
    segments: dict[str, dict[int, set[tuple[int, int, bool]]]] = {}  # by the length of the words they are of
    for word, wlen, a, b in rows:
        if len(word) == wlen:
            start, end = word[:a], word[b:]
            left = len(start) >= len(end)
            segment = start[:long] if left else end[-long:]  # enough for the search, the block is looked up by the whole
            segments.setdefault(segment, {}).setdefault(wlen, set()).add((a, b, left))
            if (at := (wlen, a, b, start, end)) not in blocks:
                blocks[at] = Block(b - a > long)
            blocks[at].add(word[a:b], word)
    if not blocks:
        return []
    automaton = ahocorasick.Automaton()
    for text, kinds in segments.items():
        automaton.add_word(text, (len(text), kinds))
    automaton.make_automaton()
    pairs = []
    for word in {r[0] for r in rows}:
        m = len(word)
        for last, (size, kinds) in automaton.iter(word):
            at_start, at_end = last + 1 == size, last + 1 == m
            if not (at_start or at_end):
                continue
            for more, a, b, left in [(k, *x) for k in (0, 1) for x in kinds.get(m - k, ())]:
                block = blocks.get((m - more, a, b, word[:a], word[b + more :])) if (at_start if left else at_end) else None
                if block is None:
                    continue
                for other in block.near(word[a : b + more], more == 1):
                    if not more:
                        pairs.append((word, other))
                    elif b == m - 1 or word[a:b] != other[a:b]:  # else the block that keeps the longer start has the pair
                        pairs += [(word, other), (other, word)]
    return pairs


PAIR = "word string, n bigint, near string, near_n bigint"


def _search(long: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def search(shard: pa.Table) -> pa.Table:
        words = shard["word"].to_pylist()
        count = dict(zip(words, shard["n"].to_pylist(), strict=True))
        pairs = near_in_shard(list(zip(words, *(shard[c].to_pylist() for c in ("wlen", "a", "b")), strict=True)), long)
        left, right = [x for x, _ in pairs], [x for _, x in pairs]
        return pa.table([left, [count[x] for x in left], right, [count[x] for x in right]], schema=schema)

    return search


def near_words(scratch: Scratch, words: DataFrame, least: int = LEAST, limit: int = LIMIT, shard: int = SHARD, long: int = LONG) -> DataFrame:
    """word, n, near, near_n: every pair of words (word, n: each once) one edit apart, once in each direction."""
    blocks = _blocks(scratch, words, least, limit, long)
    shards = 1 + words.count() * 4 // shard
    dealt = blocks.withColumn("shard", F.pmod("key", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_search(long), PAIR)


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """word and root: where the links (word, form) lead to in the end. They have no cycle, since a form is more frequent than its word."""
    found = scratch.write(links.select("word", F.col("form").alias("root")))
    while True:
        number = scratch.count
        there = found.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = found.join(there, F.col("root") == F.col("at"), "left")
        found = scratch.write(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("on")))
        scratch.drop(number)
        if not found.where("on").limit(1).count():
            return found.drop("on")
        found = found.drop("on")


def group_variants(words: DataFrame, times: int = TIMES, least: int = LEAST, limit: int = LIMIT, shard: int = SHARD, long: int = LONG) -> DataFrame:
    """For each word (word, n): form, the near word of largest n if that is times as frequent, form_n, n_near (how many near words) and root, where forms lead to."""
    ship(words.sparkSession)
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.write(words.select("word", "n"))
    often: Column = F.when(F.col("near_n") >= times * F.col("n"), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_words(scratch, words, least, limit, shard, long).groupBy("word").agg(F.count("*").alias("n_near"), F.min(often).alias("best"))
    near = scratch.write(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")))
    ends = roots(scratch, near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
