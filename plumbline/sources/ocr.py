"""Recognised words to blocks, and blocks with a page's regions to typed parts of the model.

``lines_and_blocks`` finds lines and blocks where a recogniser gives words alone: islands along y (a word begins a line if it starts below the middle of all before it in the line's run), then islands of lines by the gap between
them. ``blocks`` joins words of one block in their order, with the box around them. ``merge`` lets regions name blocks: ids exploded with their place, texts joined in that order, and a typed
part for each region, numbered through the document.

Edge cases: words of low confidence and blank ones don't count; blocks under three characters and leaked page headers go, and ids are gapless after that; a region without blocks has no text; a block named twice is
said twice; unknown blocks are passed over; regions of one reading order keep their own; an unknown type is nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import is_leaked_header, strip

#: Least confidence, least characters of a block, points of relative sizes, types of text regions.
CONFIDENT, CHARACTERS = 20, 3
POINTS = {"large": 16.0, "normal": 12.0, "small": 10.0}
TEXTS = ("heading", "paragraph", "equation", "caption", "footnote")


def lines_and_blocks(words: DataFrame, gap: float = 1.5) -> DataFrame:
    """words (doc_id, page, i, text, conf, x, y, w, h) with line and block: numbers by islands on two axes.

    In order of y a word begins a new line if its top is at or below the lowest middle of the words before it; a line begins a new block if the blank above it is more than gap times its own height.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("y", "x", "i")
    before, so_far = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("y") >= F.coalesce(F.max(F.col("y") + F.col("h") / 2).over(before), F.col("y"))
    out = words.withColumn("line", F.sum(fresh.cast("int")).over(so_far)).withColumn("fresh", fresh).where("line is not null")
    own = Window.partitionBy("doc_id", "page", "line")
    out = out.withColumn("top", F.min("y").over(own)).withColumn("bottom", F.max(F.col("y") + F.col("h")).over(own))
    # the word before a line's first one belongs to the line before
    apart = F.col("fresh") & (F.col("top") - F.lag("bottom").over(page) > gap * (F.col("bottom") - F.col("top")))
    out = out.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    return out.withColumn("block", F.sum("apart").over(so_far)).drop("fresh", "top", "bottom", "apart")


def blocks(words: DataFrame, order: tuple[str, ...] = ("i",)) -> DataFrame:
    """doc_id, page, id, text, x, y, w, h, words of words (doc_id, page, block, order, text, conf, x, y, w, h)."""
    good = words.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & (F.col("conf") >= CONFIDENT))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ")
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    g = good.groupBy("doc_id", "page", "block").agg(said.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), F.count("*").alias("words"))
    kept = g.where((F.length("text") >= CHARACTERS) & ~is_leaked_header(F.col("text")))
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block")) - 1).drop("block")


def _points(c: Column, default: str) -> Column:
    size = F.coalesce(c, F.lit(default))
    return F.when(size == "large", POINTS["large"]).when(size == "small", POINTS["small"]).otherwise(POINTS["normal"])


def _numbered(df: DataFrame, prefix: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "reading_order", "region")) - 1
    return df.withColumn("id", F.format_string(f"ocr_{prefix}_%d", n))


def merge(found: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    """paragraphs, tables (with cells) and images of regions over blocks (doc_id, page, id, text).

    regions: doc_id, page, region (place in the answer), reading_order, type, block_ids, heading_level, bold, italic, size, headers, rows (arrays of cells), description.
    """
    body = regions.where(~F.coalesce("type", F.lit("")).isin("page_header", "page_footer")).withColumn("reading_order", F.coalesce("reading_order", F.lit(0)))
    key = ["doc_id", "page", "region"]
    named = body.select(*key, F.posexplode("block_ids").alias("place", "id"))
    texts = found.select("doc_id", "page", "id", strip(F.col("text")).alias("text")).where("text <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    said = named.join(texts, ["doc_id", "page", "id"]).groupBy(*key).agg(joined.alias("text"))
    out = body.join(said, key, "left").fillna("", ["text"])
    kind, text = F.col("type"), F.col("text")
    out = out.where(kind.isin("table", "figure") | (text == "") | ~is_leaked_header(text))
    grid = F.size(F.coalesce("headers", F.array().cast("array<string>"))) + F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))) > 0

    level = F.when(kind == "heading", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("heading_level", F.lit(2)))))
    points = F.when(kind == "heading", _points(F.col("size"), "large")).when(kind.isin("caption", "footnote"), F.lit(POINTS["small"])).when(kind == "table", F.lit(None)).otherwise(_points(F.col("size"), "normal"))
    true = lambda c: F.when(c, True)
    bold = F.when(kind == "heading", True).when(kind == "paragraph", true(F.col("bold")))
    italic = F.when(kind.isin("equation", "caption"), True).when(kind == "paragraph", true(F.col("italic")))
    paragraphs = _numbered(out.where((text != "") & (kind.isin(*TEXTS) | ((kind == "table") & ~grid))), "p")
    paragraphs = paragraphs.select("doc_id", "page", "id", "text", level.cast("int").alias("heading_level"), bold.alias("bold"), italic.alias("italic"), points.alias("points"))

    lines = F.concat(F.when(F.size(F.coalesce("headers", F.array().cast("array<string>"))) > 0, F.array("headers")).otherwise(F.array().cast("array<array<string>>")), F.coalesce("rows", F.array().cast("array<array<string>>")))
    tables = _numbered(out.where((kind == "table") & grid).withColumn("lines", lines), "tbl")
    width = F.array_max(F.transform("lines", F.size))
    sizes = tables.select("doc_id", "page", "id", F.size("lines").alias("rows"), width.alias("columns"), (F.size(F.coalesce("headers", F.array().cast("array<string>"))) > 0).cast("int").alias("header_rows"))
    cells = tables.select("doc_id", "id", F.posexplode("lines").alias("r", "line")).select("doc_id", "id", "r", F.posexplode("line").alias("c", "text"))
    images = _numbered(out.where(kind == "figure"), "img").select("doc_id", "page", "id", F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(text).alias("alt"))
    return {"paragraphs": paragraphs, "tables": sizes, "cells": cells, "images": images}
