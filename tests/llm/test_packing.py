"""Packing: every id once, whole windows, few pads, even steps; ids as the library gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.llm import packing, queries
from plumbline.llm.byte_level import SPACE, Encoder

PATH = queries.vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, row bigint, n string, first int, bin int, rest string, lane int, tier string"


TOKENIZER = Encoder(PATH).tokenizer


def library(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_cuts_as_the_library():
    r = random.Random(1)
    letters = [*"ab'sdl.,!12éÄ日😀<|>", *" " * 6, *"\n" * 3, *SPACE, "\x1c", "\x1f", "​", "﻿", "'s", "'ll", "<|endoftext|>", "²", "ª", "́"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["", None, " ", "\n", "a  b\n\n c \n"]
    e = Encoder(PATH)
    assert e.cuts
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert e.ids(texts) == want
    assert e.ids(texts) == want  # from the tables


def test_another_kind_of_vocabulary_gets_whole_texts():
    e = Encoder(queries.vocabulary())
    assert not e.cuts
    assert e.ids(["Some  text.", None]) == [np.array(e.tokenizer.encode("Some  text.", add_special_tokens=False).ids, "<u4").tobytes(), b""]


@pytest.mark.parametrize("kind", ["mixed", "all 700", "all 1", "all 512", "short", "one"])
def test_a_bin_is_packed_without_gaps(kind):
    r = random.Random(5)
    lengths = {"mixed": [r.randint(1, 1023) for _ in range(900)], "all 700": [700] * 300, "all 1": [1] * 3000, "all 512": [512] * 9, "short": [r.randint(1, 90) for _ in range(700)], "one": [333]}[kind]
    parts = packing.pack_bin(list(enumerate(lengths)))
    covered = defaultdict(list)
    for row, start, length, *_ in parts:
        covered[row].append((start, length))
    for row, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[row]):
            assert start == at and length > 0
            at += length
        assert at == n
    sequences = defaultdict(list)
    for _, _, length, number, offset, tier in parts:
        sequences[number].append((offset, length, tier))
    padded = 0
    for own in sequences.values():
        at = 0
        for offset, length, tier in sorted(own):
            assert offset == at
            at += length
        assert {x[2] for x in own} == {at if at in packing.TIERS else 1024}
        padded += at not in packing.TIERS
    assert padded <= 1
    if kind == "mixed":  # few pieces are cut, and short ones make sequences of their own tier only once the long windows are full
        assert sum(len(x) > 1 for x in covered.values()) <= len(sequences)
        assert Counter(own[0][2] for own in sequences.values())[1024] > len(sequences) // 2


def check(rows, found, bins=1):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    by_doc = Counter(r[0] for r in rows)
    for p in found:
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(library(text), "<u4")
        want[doc_id] += len(ids)
        if by_doc[doc_id] == 1:
            at = 0
            for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    assert {k: sum(p["length"] for p in v) for k, v in pieces.items()} == dict(want)
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padded += at not in packing.TIERS
    assert padded <= bins


def test_hard_rows(spark, tmp_path):
    texts = [None, "", " ", "word", "The river ran. " * 4000, "x" * 30_000, "日本語 " * 500, "a\n\n b <|endoftext|>\tc", "same text", "same text"]
    rows = [(k, t, 1, "n", 2, 3, "r", 4, "t") for k, t in enumerate(texts)] + [(9, "same text", *[None] * 7), (None, "no key", *[None] * 7)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    check([r[:2] for r in rows], queries.op11_packing(spark, str(tmp_path)).collect())
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op11_packing(spark, str(tmp_path / "none")).collect() == []


def test_whole_table_and_its_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = packing.pack(docs, PATH, bin_ids=20_000).withColumn("ids_crc32", F.crc32("ids"))
    assert found.where("octet_length(ids) <> 4 * length").count() == 0
    total = sum(len(library(t)) for _, t in rows)
    check(rows, found.collect(), 1 + total // 20_000)


def test_steps_are_even(spark):
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH)
    rows = packing.steps(pieces, step_ids=8192, lane=50).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.step].append(r)
    sizes, costs = defaultdict(list), defaultdict(list)
    for step, own in groups.items():
        assert {r.tier for r in own} == {step.tier} and sum(r.tier for r in own) <= 8192
        sizes[step.lane, step.tier].append(len(own))
        costs[step.lane, step.tier].append(sum(r.cost for r in own))
    assert all(max(x) - min(x) <= 1 for x in sizes.values())
    assert all(max(c) - min(c) <= 2 * k[1] ** 2 for k, c in costs.items())
