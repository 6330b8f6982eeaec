"""What a fix has brought: results of checks as snapshots in time, paired around each document's fix, and what the pairs say.

snapshots: doc_id, at, rule, failed (checks of that rule that fail; a rule that isn't in a snapshot has none). fixes: doc_id, at.

Edge cases: a document without a snapshot on either side of its fix isn't paired; one whose snapshots hold no rule at all needs a row with a null rule to be seen; several fixes of a document are pairs each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(snapshots: DataFrame, fixes: DataFrame) -> DataFrame:
    """doc_id, fixed_at, rule, before, after: the last snapshot up to the fix against the first one after it (as-of, by aggregates over the times alone)."""
    times = snapshots.select("doc_id", F.col("at").alias("seen")).distinct()
    near = fixes.select("doc_id", F.col("at").alias("fixed_at")).distinct().join(times, "doc_id").groupBy("doc_id", "fixed_at").agg(F.max(F.when(F.col("seen") <= F.col("fixed_at"), F.col("seen"))).alias("was"), F.min(F.when(F.col("seen") > F.col("fixed_at"), F.col("seen"))).alias("now"))
    sides = near.where("was IS NOT NULL AND now IS NOT NULL").select("doc_id", "fixed_at", F.explode(F.array(F.struct(F.col("was").alias("at"), F.lit(0).alias("side")), F.struct(F.col("now").alias("at"), F.lit(1).alias("side")))).alias("x")).select("doc_id", "fixed_at", "x.*")
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("failed"))), F.lit(0)).cast("long")
    return sides.join(snapshots, ["doc_id", "at"]).groupBy("doc_id", "fixed_at", "rule").agg(n(0).alias("before"), n(1).alias("after"))


def swing(pairs: DataFrame) -> DataFrame:
    """One row: documents without a failing rule before and after, documents with fewer, as many and more failing rules, and failing rules and checks of both sides."""
    one = lambda c: F.sum((F.col(c) > 0).cast("int"))
    docs = pairs.groupBy("doc_id", "fixed_at").agg(one("before").alias("b"), one("after").alias("a"), F.sum("before").alias("cb"), F.sum("after").alias("ca"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    a, b = F.col("a"), F.col("b")
    return docs.agg(F.count("*").alias("docs"), n(b == 0).alias("compliant_before"), n(a == 0).alias("compliant_after"), n(a < b).alias("better"), n(a == b).alias("same"), n(a > b).alias("worse"), n(b).alias("rules_before"), n(a).alias("rules_after"), n(F.col("cb")).alias("checks_before"), n(F.col("ca")).alias("checks_after"))


def transitions(pairs: DataFrame) -> DataFrame:
    """rule, fixed, remaining, broken, never: documents of each kind of transition of that rule, of all that were paired."""
    docs = pairs.select("doc_id", "fixed_at").distinct().count()
    n = lambda c: F.sum(c.cast("int")).cast("long")
    was, now = F.col("before") > 0, F.col("after") > 0
    g = pairs.where("rule IS NOT NULL").groupBy("rule").agg(n(was & ~now).alias("fixed"), n(was & now).alias("remaining"), n(~was & now).alias("broken"))
    return g.withColumn("never", F.lit(docs) - F.col("fixed") - F.col("remaining") - F.col("broken"))


def reduction(pairs: DataFrame) -> DataFrame:
    """rule, before, after, percent (of the failing checks that went)."""
    g = pairs.where("rule IS NOT NULL").groupBy("rule").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return g.withColumn("percent", F.round(F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before")), 4))


def order_statistic(rows: DataFrame, key: str, value: str, share: float = 0.5) -> DataFrame:
    """key and the value of rank floor(share * n) of n, counting from 0: ranks by counts of each different value, so no task holds a key's rows."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(key))
    ranked = counts.withColumn("_upto", upto).withColumn("_rank", F.least(F.floor(total * share), total - 1))
    return ranked.where("_upto > _rank").groupBy(key).agg(F.min(value).alias(value))
