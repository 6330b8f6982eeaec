"""Merkle manifest against a tree built row by row."""

import zlib
from functools import partial
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, idx int, n string, node int, claim string, row string, part string, at int"


def h(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(layer):
    """The layers from the leaves to one node."""
    layers = [layer]
    while len(layers[-1]) > 1:
        layers.append([h("".join(layers[-1][k : k + 16])) for k in range(0, len(layers[-1]), 16)])
    return layers


def brute(rows):
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((first(r["doc_id"]), brute_leaf(r, r["text"]), r))
    trees = {s: climb([x[1] for x in (own.sort(key=lambda x: x[:2]) or own)]) for s, own in groups.items()}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    crown = climb([trees[s][-1][0] for s in order])
    out = []
    for s, own in groups.items():
        for k, (_, leaf, r) in enumerate(own):
            lowered = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            fold, proof = brute_leaf(r, lowered) if chosen else leaf, ""
            for at, layers in ((k, trees[s]), (order.index(s), crown)):
                for layer in layers[:-1]:
                    start = at // 16 * 16
                    left, right = "".join(layer[start:at]), "".join(layer[at + 1 : start + 16])
                    fold, proof, at = h(left + fold + right), proof + left + right, at // 16
            out.append((r["doc_id"], s, leaf, trees[s][-1][0], crown[-1][0], h(proof), fold, fold == crown[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, files=3):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    names = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)


def row(doc_id, source, text, lang="en"):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)} | dict.fromkeys(("tree", "idx", "n", "node", "claim", "row", "part", "at"))


@pytest.mark.parametrize("levels", [1, 3])
def test_same_as_row_by_row(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "prove", partial(merkle.prove, levels=levels))
    rows = [row(k, "hot", f"Text {k % 50}") for k in range(700)] + [row(k, f"s{k}", "Lone") for k in range(700, 740)] + [row(k, None, None, None) for k in range(740, 757)]
    rows += [row(5, "hot", "Text 5"), row(5, "hot", "Other"), row(None, "hot", "No key"), row(None, None, ""), row(800, "", "Empty source"), row(801, "\U0001f600", "x"), row(802, "￮", "X" * 300_000)]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_one_row_and_none(spark, tmp_path):
    rows = [row(1, "a", "Some Text")]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert run(spark, [], tmp_path) == []


def test_other_parts_give_the_same_roots(spark, tmp_path):
    rows = [row(k % 90, "ab"[k % 2], f"T{k % 7}") for k in range(300)]
    assert run(spark, rows, tmp_path, 1) == run(spark, rows, tmp_path, 7)


def test_any_change_of_a_row_is_seen(spark):
    docs = spark.range(100).select(F.col("id").alias("key"), F.lit("g").alias("grp"), merkle.leaf(F.col("id"), F.lit("t")).alias("node"))
    claims = docs.withColumn("claim", F.when(F.col("key") == 42, merkle.leaf(F.lit(4), F.lit("2t"))).otherwise(F.col("node")))
    assert [r.key for r in merkle.prove(claims).where("not verified").collect()] == [42]
