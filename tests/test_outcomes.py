"""Snapshots around a fix, medians by counts, streams that come in parts, facts of a tree."""

import random
from statistics import median_high

from pyspark.sql import functions as F

from plumbline.operators import structure
from plumbline.operators.ledger import allowed
from plumbline.plans import outcomes
from plumbline.queries.extras import written
from plumbline.streaming import limits


def test_snapshots_are_paired_around_the_fix(spark):
    rows = [("a", 1, "r", 9), ("a", 5, "r", 4), ("a", 5, "s", 1), ("a", 9, "r", 1), ("a", 9, "t", 2), ("a", 20, "r", 0), ("b", 5, "r", 1), ("c", 5, None, 0), ("c", 9, None, 0), ("d", 1, "s", 3), ("d", 8, None, 0)]
    snapshots = spark.createDataFrame(rows, "doc_id string, at int, rule string, failed int")
    pairs = outcomes.paired(snapshots, spark.createDataFrame([("a", 5), ("b", 5), ("c", 7), ("d", 7), ("x", 1)], "doc_id string, at int"))
    assert {(r.doc_id, r.rule): (r.before, r.after) for r in pairs.collect()} == {("a", "r"): (4, 1), ("a", "s"): (1, 0), ("a", "t"): (0, 2), ("c", None): (0, 0), ("d", "s"): (3, 0), ("d", None): (0, 0)}
    assert outcomes.swing(pairs).first().asDict() == {"docs": 3, "compliant_before": 1, "compliant_after": 2, "better": 1, "same": 2, "worse": 0, "rules_before": 3, "rules_after": 2, "checks_before": 8, "checks_after": 3}
    assert {r.rule: (r.fixed, r.remaining, r.broken, r.never) for r in outcomes.transitions(pairs).collect()} == {"r": (0, 1, 0, 2), "s": (2, 0, 0, 1), "t": (0, 0, 1, 2)}
    assert {r.rule: (r.before, r.after, r.percent) for r in outcomes.reduction(pairs).collect()} == {"r": (4, 1, 75.0), "s": (4, 0, 100.0), "t": (0, 2, None)}
    none = outcomes.paired(snapshots.limit(0), spark.createDataFrame([], "doc_id string, at int"))
    assert outcomes.swing(none).first().docs == 0


def test_medians_by_counts(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, 1, 2, 3, 50])) for k in (1, 2, 3) for _ in range(40)] + [(4, 7), (5, None)]
    got = {x.k: x.v for x in outcomes.order_statistic(spark.createDataFrame(rows, "k int, v int"), "k", "v").collect()}
    assert got == {k: median_high([v for key, v in rows if key == k and v is not None]) for k in (1, 2, 3, 4)}


def test_limiter_stream_takes_events_out_of_order_and_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(5)
    events = [(r.randrange(4), k, 1_700_000_000.0 + r.randrange(60_000)) for k in range(400)]
    events += [(9, 1000 + k, 1_700_000_000.0) for k in range(6)]  # all at once
    frame = spark.createDataFrame(events, "user_id long, event_id long, t double").repartition(3)
    got = limits.limited_in_parts(frame, 3, 3600.0, str(tmp_path / "s"), parts=5)
    want = {}
    for user in {e[0] for e in events}:
        own = sorted((t, e) for u, e, t in events if u == user)
        want |= {e: x for (_, e), x in zip(own, allowed([t for t, _ in own], 3, 3600.0), strict=True)}
    rows = got.collect()
    assert {x.event_id: (x.allowed, x.retry) for x in rows} == want and len(rows) == len(want)
    assert limits.limited_in_parts(frame.limit(0), 3, 3600.0, str(tmp_path / "e")).count() == 0


def test_neighbouring_users_share_a_state_of_the_limiter(spark, tmp_path):
    r = random.Random(7)
    users = [None, -3, -2, *range(61)]
    events = [(r.choice(users), k, 1_700_000_000.0 + r.randrange(90_000)) for k in range(1500)]
    spark.createDataFrame(events, "user_id long, event_id long, t double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, t double").parquet(str(tmp_path / "in"))
    run = limits.limited(stream, 3, 36_000.0).writeStream.format("noop").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6
    rows = limits.limited_in_parts(spark.read.parquet(str(tmp_path / "in")), 3, 36_000.0, str(tmp_path / "s")).collect()
    want = {}
    for user in users:
        own = sorted((t, e) for u, e, t in events if u == user)
        want |= {e: (user, *x) for (_, e), x in zip(own, allowed([t for t, _ in own], 3, 36_000.0), strict=True)}
    assert {x.event_id: (x.user_id, x.allowed, x.retry) for x in rows} == want and len(rows) == len(want)


def test_facts_of_a_tree(spark):
    tree = [("d", 0, None, "Document"), ("d", 1, 0, "Table"), ("d", 2, 1, "TR"), ("d", 3, 2, "TH"), ("d", 4, 2, "TD"), ("d", 5, 4, "Table"), ("d", 6, 5, "TD"), ("d", 7, 0, "Figure"), ("d", 8, 0, "Odd"), ("d", 9, 77, "P"), ("d", 10, 11, "P"), ("d", 11, 10, "P"), ("e", 20, None, "H2")]
    nodes = spark.createDataFrame([(*x, "seen" if x[1] == 7 else None, x[1] == 7) for x in tree], "doc_id string, id int, parent int, tag string, alt string, actual_text boolean")
    docs = spark.createDataFrame([("d", True), ("e", False), ("f", True)], "doc_id string, is_marked boolean")
    links = spark.createDataFrame([("d", "http://x", True, False), ("d", "ftp://x", None, True), ("f", None, None, None)], "doc_id string, uri string, has_alt boolean, tied boolean")
    got = {r.doc_id: r.asDict() for r in structure.tree_facts(docs, nodes, links, lambda df: written(df, "parquet")).collect()}
    want = {"elements": 9, "depth": 5, "custom": 1, "figures": 1, "figures_with_alt": 1, "figures_with_actual_text": 1, "tables": 2, "th": 1, "tables_with_th": 2, "tables_with_own_th": 1, "paragraphs": 0, "annotations": 2, "annotations_valid": 1, "annotations_with_alt": 1, "annotations_tied": 1, "has_tree": True}
    assert {k: got["d"][k] for k in want} == want
    assert got["e"]["headings"] == 1 and got["f"]["has_tree"] is False and got["f"]["elements"] == 0 and got["f"]["annotations"] == 1
    deep = spark.createDataFrame([(k, k - 1 if k else None, "Table" if k == 3 else "P") for k in range(60)], "id int, parent int, tag string")
    above = structure.nearest_above(deep, "Table", lambda df: written(df, "parquet"))
    assert {r.id for r in above.collect()} == set(range(4, 60)) and above.where(F.col("above") != 3).count() == 0
