"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import queries, spelling
from plumbline.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, word string, n string, key string, h int, wlen int, form string"


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(count, pairs=None):
    words = sorted(count)
    near = {w: [] for w in words}
    for x in words:
        near[x] = [y for y in words if x != y and abs(len(x) - len(y)) < 2 and one_edit(x, y)]
    form = {w: min((y for y in near[w] if count[y] >= 10 * count[w]), key=lambda y: (-count[y], y), default=None) for w in words}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def brute_counts(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def got(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_words(seed, n, letters="abÀÿ", least=7, most=11):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(least, most))): r.choice([2, 3, 30, 400, 5000]) for _ in range(n)}


@pytest.mark.parametrize(("limit", "shard", "long"), [(20_000, 50_000, 64), (6, 40, 64), (6, 10, 2), (1, 1, 1)])
def test_all_pairs_whatever_the_blocks(spark, limit, shard, long):
    count = made_words(limit, 500) | {"understandable" + x: n for x, n in (("", 5000), ("s", 400), ("a", 30), ("ss", 3), ("as", 2))}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    assert got(spelling.group_variants(words, limit=limit, shard=shard, long=long)) == brute(count)


def test_each_pair_comes_once(spark):
    count = made_words(3, 300, "ab")
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    pairs = [tuple(r) for r in spelling.near_words(Scratch(spark, "t"), words, limit=20, shard=100).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for x in count for y in count if x != y and one_edit(x, y)}


def test_one_start_of_most_words(spark):
    """A third of all words and more share one half; no shard gets far more than its rows."""
    count = {f"internationally{a}{b}{c}{d}": 2 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcd"}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    scratch = Scratch(spark, "t")
    blocks = spelling._blocks(scratch, words, 7, 200, 64)
    assert blocks.groupBy("key").count().agg(F.max("count")).first()[0] <= 200
    near = spelling.near_words(scratch, words, limit=200, shard=1000).groupBy("word").count()
    assert {r["count"] for r in near.collect()} == {7 + 7 + 7 + 3}


def test_long_words(spark):
    base = "ab" * 20_000
    count = {base: 100, base[:-1]: 5, base[:777] + "x" + base[778:]: 4, "z" + base: 3, "y" * 40_000: 2}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    assert got(spelling.group_variants(words)) == brute(count)


def test_hard_rows(spark, tmp_path):
    letters = "Grüßen Straße x7 Vergnügen VERGNÜGEN vergnügen Übergang ÜBERGANG ×multiple÷ 日本語" + " misspelling" * 40
    texts = [None, "", " \n", letters, letters, "misspeling misspelling mispelling missspelling " * 3, "K" * 300_000, "İstanbul Kelvins " * 5, "a" * 7]
    rows = [(k if k != 4 else None, t, "w", "n", "k", 1, 2, "f") for k, t in enumerate(texts * 8)] + [(3, letters, None, None, None, None, None, None)] * 3
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(brute_counts([r[:2] for r in rows]))
    assert any(r[1] for r in want)
    assert got(queries.op12_spelling_variants(spark, str(tmp_path))) == want
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert got(queries.op12_spelling_variants(spark, str(tmp_path / "none"))) == set()


def test_words_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_counts(rows)
    found = spelling.count_words(spelling.with_slips(spelling.runs(spark.read.parquet(f"{SF}/documents.parquet"))))
    assert {r.word: r.n for r in found.collect()} == want
