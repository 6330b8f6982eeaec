"""Rounds against the same rules one after another."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching
from plumbline.queries.extras import written


def keep(df):
    return written(df, "parquet")


def brute_keep(sets, share):
    out = set()
    for grp in {g for g, _, _ in sets}:
        stayed = []
        for _, k, items in sorted((s for s in sets if s[0] == grp), key=lambda s: s[1]):
            own = set(items)
            if not any(own and x and len(own & x) >= share * max(len(own), len(x)) for x in stayed):
                out.add((grp, k))
                stayed.append(own)
    return out


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_first_of_alike_sets_stays(spark, share):
    r = random.Random(4)
    sets = []
    for grp in range(4):
        base = [f"c{k}" for k in range(12)]
        for k in range(30):
            own = [x for x in base if r.random() < 0.85] + [f"o{r.randrange(3)}"] if k % 3 else [f"c{r.randrange(20)}" for _ in range(r.randrange(5))]
            sets.append((grp, k, sorted(set(own))))
    sets += [(9, k, ["same", "cells"]) for k in range(200)] + [(10, k, []) for k in range(3)] + [(11, k, [f"x{j}" for j in range(k, k + 10)]) for k in range(12)] + [(None, 1, ["a"])]
    got = matching.keep_first(spark.createDataFrame(sets, "grp int, id int, items array<string>"), keep, share)
    assert {(r.grp, r.id) for r in got.collect() if r.grp is not None} == {x for x in brute_keep(sets, share) if x[0] is not None}


def test_each_target_has_one_seeker(spark):
    r = random.Random(7)
    pairs = [(g, s, t, r.choice([0.2, 0.5, 0.8, 1.0])) for g in range(5) for s in range(9) for t in range(7) if r.random() < 0.6]
    pairs += [(7, s, t, 1.0) for s in range(8) for t in range(6)]  # all want all
    want = set()
    for g in {p[0] for p in pairs}:
        taken = set()
        for s in sorted({p[1] for p in pairs if p[0] == g}):
            free = [p for p in pairs if p[:2] == (g, s) and p[2] not in taken]
            if free:
                best = min(free, key=lambda p: (-p[3], p[2]))
                taken.add(best[2])
                want.add(best)
    got = matching.one_use(spark.createDataFrame(pairs, "grp int, seeker int, target int, score double"), keep)
    assert {(r.grp, r.seeker, r.target, r.score) for r in got.collect()} == want


def test_nothing_to_match(spark):
    assert matching.one_use(spark.createDataFrame([], "grp int, seeker int, target int, score double"), keep).count() == 0
    assert matching.keep_first(spark.createDataFrame([], "grp int, id int, items array<string>"), keep).count() == 0


def test_scores_of_headings(spark):
    p = spark.createDataFrame([("d", 0, " Intro ", 0.0), ("d", 1, "a b c d", 0.4), ("d", 2, "own", 0.9), ("d", 3, "", 1.0)], "doc_id string, pos int, text string, fake_score double")
    t = spark.createDataFrame([("d", 0, "Intro"), ("d", 1, "b c x"), ("d", 2, "")], "doc_id string, tag int, tag_text string")
    assert {(r.tag, r.pos): round(r.score, 6) for r in matching.heading_pairs(p, t, ["doc_id"]).collect()} == {(0, 0): 1.0, (1, 1): 0.4, (2, 2): 0.45}


def test_no_side_of_a_match_is_broadcast(spark, tmp_path):
    """A broadcast goes through the driver, and these tables grow with the input."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(str(tmp_path / str(len(plans))))
        return spark.read.parquet(str(tmp_path / str(len(plans))))

    paragraphs = spark.createDataFrame([(1, k, f"word {k} alike", 0.7) for k in range(6)], "page int, pos int, text string, fake_score double")
    tags = spark.createDataFrame([(1, k, "alike") for k in range(3)], "page int, tag int, tag_text string")
    pairs = matching.heading_pairs(paragraphs, tags, ["page"]).select(F.col("page").alias("grp"), F.col("tag").alias("seeker"), F.col("pos").alias("target"), "score")
    assert matching.one_use(pairs, written).count() == 3
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
