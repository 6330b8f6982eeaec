"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a tilt: at time t in [0, 1] of the training run its weight is ``weight * (1 + tilt * (2 t - 1))``, whose
integral over the run is the weight. Targets share all words by weight; none exceeds three times its source, and what is over is shared
again by weight (water-filling, solved in one pass over the sources sorted by where they fill up).

A source's documents lie on a tape in hash order. Its demand reads the tape from the start, again and again; a document is taken as
often as its middle lies within the demand, so the words taken differ from the target by at most half a document; then one document of
the source is taken once more or less if that brings it nearer. The n-th copy's
middle, as a share of the demand, is put through the inverse of the cumulative schedule, which gives its time: its training position.
``training_order`` deals the copies out by ranges of position and sorts them.

Tapes are prefix sums over buckets of hash order, then within buckets: a source with a third of all rows is spread over as
many tasks as its rows need. Only the sources (one row each) pass through one task.

Edge cases: a null or blank text has size 0 and is never taken; a null source is a source, last in order; equal rows stand side by
side and are each taken on their own; of documents that tie for the last change the first in hash order is taken; a very long text is taken whole or not at all, so its source may miss its target by up to half of it; an empty table gives an empty result; further columns are carried by ``training_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Scratch, with_row_id

#: (weight, tilt) of the sources in order, repeating: the first fade out, the second stay even, the third grow.
SCHEDULES = ((5.0, -0.5), (2.0, 0.0), (1.0, 0.5))
MOST_REPEATS = 3
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, schedules=SCHEDULES, most: int = MOST_REPEATS) -> DataFrame:
    """For rows (source, size): source, source_size, weight, tilt, target."""
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = ranked.withColumn("_rank", rank)

    def turn(k: int) -> Column:
        c = F.lit(schedules[-1][k])
        for n, s in enumerate(schedules[:-1]):
            c = F.when(F.col("_rank") % len(schedules) == n, F.lit(s[k])).otherwise(c)
        return c

    ranked = ranked.withColumn("weight", turn(0)).withColumn("tilt", turn(1))
    # with level x a source gets min(weight * x, most * size); sources fill up in the order of most * size / weight
    fill = F.col("source_size") * most / F.col("weight")
    order = Window.orderBy(fill, "_rank")
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    total, weights = F.sum("source_size").over(all_), F.sum("weight").over(all_)
    before_size = F.sum("source_size").over(upto) - F.col("source_size")
    before_weight = F.sum("weight").over(upto) - F.col("weight")
    level = (total - most * before_size) / (weights - before_weight)  # if all sources before this one are full, and no other
    ranked = ranked.select("source", "source_size", "weight", "tilt", "_rank", fill.alias("_fill"), level.alias("_level"))
    right = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_rank", "_level"))).over(all_)["_level"]
    ranked = ranked.withColumn("_x", right)
    return ranked.select("source", "source_size", "weight", "tilt", F.least(F.col("weight") * F.col("_x"), F.lit(float(most)) * F.col("source_size")).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", schedules=SCHEDULES, most: int = MOST_REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: key, source, size, source_size, target, copies, taken, positions (one for each copy), carry."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_order"), *carry)
    sized = scratch.write(sized)
    rows = sized.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    sized = sized.withColumn("_bucket", F.substring("_order", 1, digits))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(F.col("source").alias("_s"), F.col("_bucket").alias("_k"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    goals = targets(sized, schedules, most).withColumnRenamed("source", "_t")
    buckets = buckets.join(goals, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    laid = sized.join(buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_k"))).drop("_s", "_k")
    along = Window.partitionBy("source", "_bucket").orderBy("_order", key, "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_ahead") + F.coalesce(F.sum("size").over(along), F.lit(0)) + F.col("size") / 2
    laid = laid.withColumn("_middle", middle)
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), F.ceil((F.col("target") - F.col("_middle")) / F.col("source_size"))))).otherwise(0).cast("int")
    laid = scratch.write(laid.withColumn("copies", copies))
    laid = laid.join(_last_changes(laid, most), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_middle") == F.col("_m")), "left")
    laid = laid.withColumn("copies", (F.col("copies") + F.coalesce("_change", F.lit(0))).cast("int"))
    share = lambda n: F.least((F.col("_middle") + n * F.col("source_size")) / F.col("target"), F.lit(1.0))

    def when(x: Column) -> Column:  # the inverse of (1 - tilt) t + tilt t^2
        a = F.col("tilt")
        return F.when(a == 0, x).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * a))

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda n: when(share(n)))).otherwise(F.array().cast("array<double>"))
    return laid.select(key, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"), *carry)


def _last_changes(laid: DataFrame, most: int) -> DataFrame:
    """At most one row for each source: the place (_m) of the document of which a copy more or less brings the source nearest to its target."""
    missing = laid.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_missing"))
    rows = laid.where("size > 0").join(missing, F.col("source").eqNullSafe(F.col("_s")))
    r, size = F.col("_missing"), F.col("size")
    after = F.when((r > 0) & (F.col("copies") < most), F.abs(r - size)).when((r < 0) & (F.col("copies") > 0), F.abs(r + size))
    better = rows.select("_s", "_order", F.col("_middle").alias("_m"), F.signum(r).cast("int").alias("_change"), F.abs(r).alias("_now"), after.alias("_after")).where("_after < _now")
    best = better.groupBy("_s").agg(F.min(F.struct("_after", "_order", "_m", "_change")).alias("x"))
    return best.select("_s", F.col("x._m").alias("_m"), F.col("x._change").alias("_change"))


def by_position(planned: DataFrame) -> DataFrame:
    """Planned documents dealt out and sorted by their first position; those not taken come first."""
    first = F.element_at(F.col("positions"), F.when(F.size("positions") > 0, 1))
    return planned.withColumn("position", first).repartitionByRange(F.col("position"), F.xxhash64(*planned.columns[:3])).sortWithinPartitions("position")


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as the mix takes them, in the order of training: repeated, left out and range-sorted by position."""
    numbered = with_row_id(Scratch(docs.sparkSession, "mixing"), docs, "_plumb_row")
    planned = plan(numbered, key, text, source, carry=("_plumb_row",)).where("copies > 0")
    copies = planned.select("_plumb_row", F.explode("positions").alias("_plumb_position"))
    placed = numbered.join(copies, "_plumb_row")
    return placed.repartitionByRange(F.col("_plumb_position")).sortWithinPartitions("_plumb_position").select(*docs.columns)
