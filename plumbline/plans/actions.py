"""Actions on model frames. An action is (doc_id, seq, element_id, action_type, value, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("set_title", "set_language", "fix_all_contrast", "set_link_text", "set_heading_level", "mark_header_rows", "set_decorative", "set_alt_text")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def action(rows: DataFrame, kind: str, element: Column, value: Column, key: str = "doc_id", pos: Column | None = None) -> DataFrame:
    return rows.select(F.col(key).alias("doc_id"), F.lit(PHASES.index(kind)).alias("phase"), (F.lit(0) if pos is None else pos).cast("long").alias("pos"), element.alias("element_id"), F.lit(kind).alias("action_type"), value.cast("string").alias("value"))


def ordered(actions: DataFrame) -> DataFrame:
    """Actions with their place in the document's plan."""
    w = Window.partitionBy("doc_id").orderBy("phase", "pos", "element_id")
    return actions.withColumn("seq", F.row_number().over(w)).drop("phase", "pos")


def patched(model: DataFrame, actions: DataFrame, kind: str, column: str, key: list[str]) -> DataFrame:
    """The model with the column's value from the last executed action of that kind on each element."""
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    last = actions.where((F.col("action_type") == kind) & (F.col("status") == "executed")).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, F.col("value").alias("_value"))
    kind_ = dict(model.dtypes)[column]
    return model.join(last, key, "left").withColumn(column, F.coalesce(F.col("_value").cast(kind_), F.col(column))).drop("_value")


def outcome(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Actions with status: skipped for an unknown kind, failed for an empty value or unknown element, else executed."""
    known = elements.select("doc_id", "element_id", F.lit(True).alias("_known")).distinct()
    whole = F.col("action_type").isin("set_title", "set_language", "fix_all_contrast")
    status = F.when(~F.col("action_type").isin(*PHASES), "skipped").when((F.coalesce("value", F.lit("")) == "") & (F.col("action_type") != "set_decorative"), "failed").when(~whole & F.col("_known").isNull(), "failed").otherwise("executed")
    return actions.join(known, ["doc_id", "element_id"], "left").withColumn("status", status).drop("_known")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, only_a, only_b, common, differing: two plans held against each other by element and kind."""
    key = ["doc_id", "element_id", "action_type"]
    j = a.select(*key, F.col("value").alias("va"), F.lit(1).alias("ia")).join(b.select(*key, F.col("value").alias("vb"), F.lit(1).alias("ib")), key, "full")
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    return j.groupBy("doc_id").agg(n(F.col("ib").isNull()).alias("only_a"), n(F.col("ia").isNull()).alias("only_b"), n(both).alias("common"), n(both & ~F.col("va").eqNullSafe(F.col("vb"))).alias("differing"))
