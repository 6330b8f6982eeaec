"""Queries of what a plan's fixes have brought: link findings before and after the plan was applied, with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans import actions, outcomes
from plumbline.queries.ledger import page_plan
from plumbline.queries.structure import ISSUES
from plumbline.registry import query
from plumbline.sources import tables as s
from plumbline.sources import twins as q


def pairs(spark, sf):
    """Four snapshots of each page's link findings: an older one, one just before the plan was applied, one just after, and a later one without findings."""
    links = s.faulty_anchors(spark, sf)
    element = F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id")
    model = links.select(F.col("page_id").alias("doc_id"), element, "pos", "text", "url")
    known = model.where("pos % 5 <> 2").select("doc_id", "element_id")
    done = actions.outcome(page_plan(spark, sf), known)
    after = actions.patched(model, done, "set_link_text", "text", ["doc_id", "element_id"]).select(F.col("doc_id").alias("page_id"), "pos", "text", "url")
    counted = lambda found, at: found.groupBy(F.col("page_id").alias("doc_id"), F.col("issue").alias("rule")).agg(F.count("*").alias("failed")).withColumn("at", F.lit(at))
    was, now = counted(checks.link_issues(links), 10), counted(checks.link_issues(after), 20)
    docs = links.select(F.col("page_id").alias("doc_id")).distinct()
    seen = docs.select("doc_id", F.lit(None).cast("string").alias("rule"), F.lit(0).cast("long").alias("failed"), F.explode(F.array(*map(F.lit, (5, 10, 20, 30)))).alias("at"))
    older = was.withColumn("failed", F.col("failed") + 3).withColumn("at", F.lit(5))
    return outcomes.paired(was.unionByName(now).unionByName(older).unionByName(seen), docs.withColumn("at", F.lit(12)))


AFTER = ISSUES.removeprefix(q.FAULTY_ANCHORS).replace("faulty_anchors", "patched")
PAIRS = (
    f"was AS (WITH {ISSUES} SELECT page_id, issue, pos FROM issues), texts AS (SELECT page_id, pos, issue FROM was WHERE issue IN ('empty_text', 'bare_url', 'vague_text') AND pos % 5 <> 2), "
    + f"now AS (WITH {q.FAULTY_ANCHORS}, patched AS (SELECT f.page_id, f.pos, coalesce(t.issue, f.text) AS text, f.url FROM faulty_anchors f LEFT JOIN texts t USING (page_id, pos)){AFTER} SELECT page_id, issue, pos FROM issues), "
    + "docs AS (SELECT DISTINCT page_id FROM was UNION SELECT page_id FROM pages WHERE contains(html, '<a href=')), pairs AS (SELECT page_id, rule, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after FROM (SELECT page_id, issue AS rule, 1 AS b, 0 AS a FROM was UNION ALL SELECT page_id, issue, 0, 1 FROM now) GROUP BY ALL), "
    + "per AS (SELECT page_id, count(*) FILTER (before > 0) AS b, count(*) FILTER (after > 0) AS a, coalesce(sum(before), 0) AS cb, coalesce(sum(after), 0) AS ca FROM docs LEFT JOIN pairs USING (page_id) GROUP BY 1)"
)


@query("e31_outcome_swing", f"WITH {PAIRS} SELECT count(*) AS docs, count(*) FILTER (b = 0) AS compliant_before, count(*) FILTER (a = 0) AS compliant_after, count(*) FILTER (a < b) AS better, count(*) FILTER (a = b) AS same, count(*) FILTER (a > b) AS worse, sum(b)::BIGINT AS rules_before, sum(a)::BIGINT AS rules_after, sum(cb)::BIGINT AS checks_before, sum(ca)::BIGINT AS checks_after FROM per")
def e31_outcome(spark, sf):
    return outcomes.swing(pairs(spark, sf))


@query("e27_outcome_transitions", f"WITH {PAIRS} SELECT rule, count(*) FILTER (before > 0 AND after = 0) AS fixed, count(*) FILTER (before > 0 AND after > 0) AS remaining, count(*) FILTER (before = 0 AND after > 0) AS broken, (SELECT count(*) FROM docs) - count(*) AS never FROM pairs GROUP BY 1")
def e27_outcome(spark, sf):
    return outcomes.transitions(pairs(spark, sf))


@query("e30_outcome_reduction", f"WITH {PAIRS} SELECT rule, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, round(CASE WHEN sum(before) > 0 THEN 100.0::DOUBLE * (sum(before) - sum(after)) / sum(before) END, 4) AS percent FROM pairs GROUP BY 1")
def e30_outcome(spark, sf):
    return outcomes.reduction(pairs(spark, sf))
