"""Sequential choices as rounds over frames: keeping the first of alike sets, and giving each target to one seeker.

Both rules go one after another in a fixed order, and both come out the same if everything that can be decided is decided at once, round after round. A round is a few joins; no group is held in one task.
``written`` stores a round's rows and gives them back. Groups are never null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Written = Callable[[DataFrame], DataFrame]


def alike_pairs(sets: DataFrame, share: float) -> DataFrame:
    """grp, a, b of sets (grp, id, items; distinct ones, none empty) with a < b that share so much of the larger.

    Alike sets have one of their rarest items in common: with n items, one of the first n - ceil(share * n) + 1. Only those are joined.
    """
    often = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    items = sets.select("grp", "id", F.size("items").alias("size"), F.explode("items").alias("item")).join(often, "item")
    ranked = items.groupBy("grp", "id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("x"))
    few = F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9) + 1
    first = ranked.select("grp", "id", "size", F.explode(F.slice("x", F.lit(1), few.cast("int"))).alias("x")).select("grp", "id", "size", "x.item")
    other = first.select("grp", "item", F.col("id").alias("b"), F.col("size").alias("other_size"))
    fits = F.least("size", "other_size") >= F.lit(share) * F.greatest("size", "other_size") - 1e-9
    found = first.withColumnRenamed("id", "a").join(other, ["grp", "item"]).where((F.col("a") < F.col("b")) & fits).select("grp", "a", "b").distinct()
    whole = lambda name: sets.select("grp", F.col("id").alias(name), F.col("items").alias(f"items_{name}"))
    both = found.join(whole("a"), ["grp", "a"]).join(whole("b"), ["grp", "b"])
    return both.where(F.size(F.array_intersect("items_a", "items_b")) >= F.lit(share) * F.greatest(F.size("items_a"), F.size("items_b")) - 1e-9).select("grp", "a", "b")


def keep_first(sets: DataFrame, written: Written, share: float = 0.8) -> DataFrame:
    """grp, id of the sets (grp, id, items) that stay: in order of id a set goes if it is alike one that stayed; empty sets stay.

    Equal sets share their first one's fate or go for it, so only the first of each is held against others. Each round the earliest undecided of their neighbours stay, and what is alike them goes.
    """
    empty = sets.where(F.size("items") == 0).select("grp", "id")
    full = sets.where(F.size("items") > 0).withColumn("items", F.sort_array(F.array_distinct("items")))
    distinct = written(full.groupBy("grp", "items").agg(F.min("id").alias("id")))
    edges = written(alike_pairs(distinct, share))
    gone, left = None, edges
    while left.limit(1).count():
        waits = left.select("grp", F.col("b").alias("id")).distinct()
        stays = left.select("grp", F.col("a").alias("id")).distinct().join(waits, ["grp", "id"], "left_anti")
        goes = written(left.join(stays.withColumnRenamed("id", "a"), ["grp", "a"]).select("grp", F.col("b").alias("id")).distinct())
        gone = goes if gone is None else gone.union(goes)
        decided = written(stays.union(goes))
        for end in ("a", "b"):
            left = left.join(decided.withColumnRenamed("id", end), ["grp", end], "left_anti")
        left = written(left.select("grp", "a", "b"))
    kept = distinct.select("grp", "id")
    return (kept if gone is None else kept.join(gone, ["grp", "id"], "left_anti")).union(empty)


def one_use(pairs: DataFrame, written: Written) -> DataFrame:
    """grp, seeker, target, score: in order of seeker each takes the target of highest score (the first of equals) that is free.

    Propose and accept: every seeker proposes to its best target, a target takes the first of those that propose, and the others strike it off. Since all targets prefer alike, what comes out when nobody is
    turned down is what the sequence gives. Rows meet by shuffles, none are sent to the driver to be broadcast. A round decides all seekers whose turn depends on nobody still moving; the number of rounds is the longest chain of such dependences.
    """
    left = written(pairs.select("grp", "seeker", "target", "score"))
    while True:
        best = left.groupBy("grp", "seeker").agg(F.min(F.struct((-F.col("score")).alias("minus"), "target")).alias("x")).select("grp", "seeker", "x.target", (-F.col("x.minus")).alias("score"))
        asked = written(best)
        first = asked.groupBy("grp", "target").agg(F.min("seeker").alias("taker"))
        turned = written(asked.join(first.hint("merge"), ["grp", "target"]).where("seeker <> taker").select("grp", "seeker", "target"))
        if not turned.limit(1).count():
            return asked
        left = written(left.join(turned.hint("merge"), ["grp", "seeker", "target"], "left_anti").select("grp", "seeker", "target", "score"))


def heading_pairs(paragraphs: DataFrame, tags: DataFrame, key: list[str], least: float = 0.1) -> DataFrame:
    """key..., tag, pos, score of heading tags (key, tag, tag_text) and paragraphs (key, pos, text, fake_score) of one page, for scores over least.

    1 if one text holds the other, else 0.8 times the share of common words in the larger; a tag without a text scores half the paragraph's own score as a heading, if that is 0.5 or more.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    both = paragraphs.withColumn("text", F.trim("text")).where("text <> ''").join(tags.withColumn("tag_text", F.trim("tag_text")).hint("merge"), key)
    a, b = words("text"), words("tag_text")
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) * 0.8
    score = F.when(F.col("tag_text") == "", F.when(F.col("fake_score") >= 0.5, F.col("fake_score") * 0.5).otherwise(0.0)).when(F.contains("text", F.col("tag_text")) | F.contains("tag_text", F.col("text")), 1.0).otherwise(overlap)
    return both.select(*key, "tag", "pos", score.alias("score")).where(F.col("score") > least)
