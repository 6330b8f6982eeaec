"""Markdown pages to paragraphs, tables, links and the order of contents, as a state machine over lines.

Each line gets a kind of its own; the states that reach over lines (within a fence, within a table, within a paragraph that a next line goes on with) are window functions over the page's lines, and a block is an island
of lines. Ids run through a document: ocr_p_N, ocr_tbl_N, ocr_link_N, from one page to the next.

What counts is CommonMark with tables: headings of both kinds, fences (dropped), rules, quotes, list items, lazily continued paragraphs; inline: emphasis, links, images and code (dropped), escapes, line breaks.
Not read: indented code, HTML blocks, reference links, nested quotes of tables.

A line that holds nothing but a link to tbl-N.md stands for that table of the page, if there is one. A page number and capitals in the first line are dropped.

Edge cases: null and empty pages have no rows; an open fence runs to the page's end; a table row has as many cells as its head, more are dropped and missing ones are empty; a link without text is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip, without_page_header

FENCE = r"^ {0,3}(```|~~~)"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
QUOTE = r"^ {0,3}>[ \t]?(.*)$"
ITEM = r"^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$"
MARKED = r"^ {0,3}[#=\-*_>+0-9]"  # lines of any kind above
DELIMITER = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
LINK = r'(?<!!)\[([^\[\]]*)\]\([ \t]*<?([^)<>\s]*)>?(?:[ \t]+"[^"]*")?[ \t]*\)'
TABLE_LINK = r"^\s*\[[^\]]*\]\((tbl-\d+\.md)\)\s*$"


def _without_marks(c: Column) -> Column:
    """Emphasis, one within another as well, and escapes resolved."""
    strong, star, line = r"(?<!\\)\*\*(?!\s)([^*]+?)(?<!\s)\*\*", r"(?<![\\*])\*(?![\s*])([^*]+?)(?<![\s\\])\*", r"(?<![\p{L}\p{N}\\_])_(?!\s)([^_]+?)(?<!\s)_(?![\p{L}\p{N}])"
    for pattern in (strong, r"(?<!\\)__(?!\s)([^_]+?)(?<!\s)__", star, line, strong):
        c = F.regexp_replace(c, pattern, "$1")
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def inline(c: Column) -> Column:
    """What an inline text says: one blank for a line's end, nothing for a hard break, an image or code. Texts without a mark are looked at once."""
    plain = c
    c = F.regexp_replace(c, r"(?: {2,}|\\)\n", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n", " "), r"!\[[^\]]*\]\([^)]*\)|(`+)[^`]+\1", "")
    return F.when(plain.rlike(r"[\n*_`\[\\]"), _without_marks(F.regexp_replace(c, LINK, "$1"))).otherwise(plain)


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda x: F.replace(strip(x), F.lit("\\|"), F.lit("|")))


def lines(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, page, pos, line: the pages' lines without the page header, with the tables (doc_id, page, name, content) that lines refer to in their place."""
    body = without_page_header(F.col("markdown"))
    out = pages.select("doc_id", "page", F.posexplode(F.split(body, "\r?\n")).alias("at", "line"))
    if tables is not None:
        named = tables.select("doc_id", "page", "name", F.col("content").alias("_content")).dropDuplicates(["doc_id", "page", "name"])
        out = out.withColumn("name", F.nullif(F.regexp_extract("line", TABLE_LINK, 1), F.lit(""))).join(named, ["doc_id", "page", "name"], "left")
        spread = F.when(F.col("_content").isNotNull(), F.concat(F.array(F.lit("")), F.split("_content", "\r?\n"), F.array(F.lit("")))).otherwise(F.array("line"))
        out = out.select("doc_id", "page", "at", F.posexplode(spread).alias("sub", "line"))
    else:
        out = out.withColumn("sub", F.lit(0))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("at", "sub"))
    return out.select("doc_id", "page", place.alias("pos"), "line")


def blocks(found: DataFrame) -> DataFrame:
    """doc_id, page, pos, line, kind (heading, text, head, row), block (where the block begins), level, content."""
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    fences = F.sum(line.rlike(FENCE).cast("int"))
    out = found.withColumn("fenced", line.rlike(FENCE) | (F.coalesce(fences.over(before), F.lit(0)) % 2 == 1))
    blank = strip(line) == ""
    kind = (
        F.when(F.col("fenced"), "fence").when(blank, "blank").when(~line.rlike(MARKED), "text").when(line.rlike(HEADING), "heading").when(line.rlike(r"^ {0,3}=+[ \t]*$"), "under").when(line.rlike(r"^ {0,3}-+[ \t]*$"), "under")
        .when(line.rlike(RULE), "rule").when(line.rlike(QUOTE), "quote").when(line.rlike(ITEM), "item").otherwise("text")
    )
    out = out.withColumn("own", kind)
    after, next_kind = F.lead("line").over(page), F.lead("own").over(page)
    wide = F.size(_cells(after)) == F.size(_cells(line))
    head = (F.col("own") == "text") & line.contains("|") & F.coalesce(after.rlike(DELIMITER) & wide & (next_kind != "fence"), F.lit(False))
    out = out.withColumn("head", head)
    at = lambda c: F.max(F.when(c, F.col("pos"))).over(so_far)
    begins, breaks = at(F.col("head")), at(F.col("own").isin("fence", "blank", "heading", "rule", "quote", "item"))
    out = out.withColumn("table", F.when(begins > F.coalesce(breaks, F.lit(0)), begins)).withColumn("width", F.last(F.when(F.col("head"), F.size(_cells(line))), ignorenulls=True).over(so_far))
    # a line of one sort goes on with a paragraph if the line before is part of one
    part = F.col("table").isNull() & F.col("own").isin("text", "quote", "item", "under")
    out = out.withColumn("part", part).withColumn("was", F.coalesce(F.lag("part").over(page), F.lit(False))).withColumn("was_own", F.lag("own").over(page))
    first = (F.col("own") == "item") | ~F.col("was") | ((F.col("own") == "quote") & (F.col("was_own") != "quote")) | (F.col("was_own") == "under")
    content = F.when(F.col("own") == "quote", F.regexp_extract("line", QUOTE, 1)).when(F.col("own") == "item", F.regexp_extract("line", ITEM, 1)).when(F.col("own") == "heading", F.coalesce(F.regexp_extract("line", HEADING, 2), F.lit(""))).otherwise(line)
    out = out.withColumn("content", F.ltrim(content)).withColumn("level", F.when(F.col("own") == "heading", F.length(F.regexp_extract("line", HEADING, 1))))
    # an underline that follows a paragraph makes it a heading; without one dashes are a rule and equals signs a text
    lone = (F.col("own") == "under") & ~F.col("was")
    out = out.withColumn("first", F.col("part") & first).where(~(lone & line.contains("-") & (F.length(strip(line)) > 2)))
    out = out.withColumn("block", F.when(F.col("own") == "heading", F.col("pos")).when(F.col("table").isNotNull(), F.col("table")).when(F.col("part"), F.max(F.when(F.col("first"), F.col("pos"))).over(so_far)))
    role = F.when(F.col("own") == "heading", "heading").when(F.col("head"), "head").when(F.col("table").isNotNull() & (F.col("pos") == F.col("table") + 1), "delimiter").when(F.col("table").isNotNull(), "row").when(F.col("part"), "text")
    return out.withColumn("kind", role).where("kind IS NOT NULL AND kind <> 'delimiter'").select("doc_id", "page", "pos", "kind", "block", "level", "content", F.when(F.col("table").isNotNull(), _cells(line)).alias("cells"), "width", (F.col("own") == "under").alias("under"), "was")


def _numbered(df: DataFrame, prefix: str, *order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", *order)) - 1
    return df.withColumn("id", F.format_string(f"ocr_{prefix}_%d", n))


def _texts(said: DataFrame, *block: str) -> DataFrame:
    """block..., raw, heading_level, text of the blocks, those without a text aside unless they are headings or, if a column of that name says so, tables."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("under") | ~F.col("was"), F.struct("pos", "content")))), lambda x: x["content"]), "\n")
    marked = F.max(F.when(F.col("under") & F.col("was"), F.when(F.trim("content").startswith("="), 1).otherwise(2)))
    g = said.groupBy(*block).agg(whole.alias("raw"), F.coalesce(F.max("level"), marked).alias("heading_level"))
    stays = F.col("heading_level").isNotNull() | (strip(F.col("text")) != "")
    return g.withColumn("text", inline(F.rtrim("raw"))).where((F.col("table") | stays) if "table" in block else stays)


def _order(scan: DataFrame) -> DataFrame:
    """doc_id, page, seq, kind, id: paragraphs and tables as they come, found in one pass over the lines."""
    table = F.col("kind").isin("head", "row")
    found = scan.select("doc_id", "page", "block", table.alias("table"), "pos", F.when(~table, F.col("content")).alias("content"), "level", "under", "was")
    both = _texts(found, "doc_id", "page", "block", "table").select("doc_id", "page", "block", "table")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1
    nth = F.row_number().over(Window.partitionBy("doc_id", "table").orderBy("page", "block")) - 1
    name = F.when(F.col("table"), F.format_string("ocr_tbl_%d", nth)).otherwise(F.format_string("ocr_p_%d", nth))
    return both.select("doc_id", "page", seq.alias("seq"), F.when(F.col("table"), "table").otherwise("paragraph").alias("kind"), name.alias("id"))


def model(pages: DataFrame, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """paragraphs, tables, cells, links, order of pages (doc_id, page, markdown); tables (doc_id, page, name, content) are those that the text refers to."""
    scan = blocks(lines(pages, tables))
    texts = _texts(scan.where("kind IN ('heading', 'text')"), "doc_id", "page", "block")
    texts = _numbered(texts, "p", "block")

    bare = F.regexp_replace(F.regexp_replace("raw", r"[ \t]*\n", " "), r"!\[[^\]]*\]\([^)]*\)|(`+)[^`]+\1", "")
    pairs = F.arrays_zip(F.regexp_extract_all(bare, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(bare, F.lit(LINK), F.lit(2)).alias("url"))
    links = texts.select("doc_id", "page", "block", F.col("id").alias("paragraph_id"), F.posexplode(pairs).alias("nth", "x")).select("doc_id", "page", "block", "paragraph_id", "nth", _without_marks(F.col("x.text")).alias("text"), F.col("x.url").alias("url"))
    links = _numbered(links.where("text <> ''"), "link", "block", "nth")

    rows = scan.where("kind IN ('head', 'row')").withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page", "block").orderBy("pos")) - 1)
    filled = F.transform(F.sequence(F.lit(1), F.col("width")), lambda k: F.coalesce(F.get("cells", k - 1), F.lit("")))
    cells = rows.select("doc_id", "page", "block", "r", F.posexplode(filled).alias("c", "text"))
    grids = rows.groupBy("doc_id", "page", "block").agg(F.count("*").alias("rows"), F.max("width").alias("columns"), F.lit(1).alias("header_rows"))
    grids = _numbered(grids, "tbl", "block")
    named = cells.join(grids.select("doc_id", "page", "block", "id"), ["doc_id", "page", "block"])
    return {"paragraphs": texts.drop("raw"), "tables": grids, "cells": named, "links": links, "order": _order(scan)}
