"""HTML to the document model, as a scan over tags.

A page is cut into tokens (tags, texts, and whole comments, scripts, formulas and error marks); running sums over its tokens give the nesting, and what encloses a token is the last element opened
at its depth. Paragraphs and headings end where any block begins or ends, so a tag that is never closed costs nothing but itself; tables may be nested, their text belongs to the innermost.
One shuffle by page serves all of it, in tasks of ``HTML_PER_TASK`` characters of pages or thereabouts: the sorts of a task hold 50 to 100 times that. A page's tokens are sorted in one task, so a page has to fit there; pages are as many as you like.

``model`` gives frames of paragraphs, tables, cells, images, formulas and the order of contents. Ids count from zero on each page: p_N, tbl_N, img_N, math_N.

Edge cases: a null or empty page has no rows in any frame; tokens outside of the article (or else the body) don't count; unknown entities stay as they are; a page that breaks off within a tag ends before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import latex
from plumbline.functions.text import escape_html, mime, strip
from plumbline.operators.spread import dealt_out

# Element names and class names that results depend on.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "div", "article", "section", "nav", "header", "footer", "main", "aside", "body", "html", "head", "title", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "form")
ROWS = ("thead", "tbody", "tfoot", "tr", "td", "th")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
ERROR = r"<span\b[^>]*\bltx_ERROR\b[^>]*>[^<]*</span\s*>"
NUMBER = r"<span\b[^>]*\bltx_tag_equation\b[^>]*>[^<]*</span\s*>"
TOKEN = rf"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<math\b.*?</math\s*>|{ERROR}|{NUMBER}|<[^>]*>?|[^<]+"
COMMAND = r"\\[A-Za-z]+\*?"
#: Characters of pages whose tokens one task sorts.
HTML_PER_TASK = 2_000_000


def attribute(token: Column, name: str) -> Column:
    """The value in quotes, entities resolved; empty if there is none."""
    pattern = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return unescaped(F.concat(F.regexp_extract(token, pattern, 1), F.regexp_extract(token, pattern, 2)))


def unescaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ENTITIES, text)


def has_class(token: Column, name: str) -> Column:
    return F.array_contains(F.split(attribute(token, "class"), r"\s+"), name)


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, pos, tok, tag, kind: kind is text, open, close, math, error or number (of an equation)."""
    found = pages.select(F.col(key).alias("page_id"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    tok = F.col("tok")
    tag = F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    closing = tok.startswith("</")
    kind = (
        F.when(~tok.startswith("<"), "text")
        .when((F.col("tag") == "math") & ~closing, "math")
        .when(tok.rlike(f"(?is)^{ERROR}"), "error")
        .when(tok.rlike(f"(?is)^{NUMBER}"), "number")
        .when(closing, "close")
        .otherwise("open")
    )
    whole = ~tok.startswith("<") | ((F.col("tag") != "") & ~F.col("tag").isin("script", "style") & tok.endswith(">"))
    kinds = found.withColumn("tag", tag).where(whole).withColumn("kind", kind)
    return dealt_out(kinds, "page_id", of=pages, size=F.length(html), most=HTML_PER_TASK)


def nested(found: DataFrame) -> DataFrame:
    """tokens with what encloses them: block (its place, tag), grid (the innermost table's place, whether it is an equation), row, cell and head in it, and n, the token's number among its page's formulas.

    block is null outside paragraphs and headings, grid outside tables, cell outside cells.
    """
    page = Window.partitionBy("page_id")
    so_far = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tag, kind, tok = F.col("tag"), F.col("kind"), F.col("tok")
    is_open = kind == "open"
    one = lambda c: F.when(c, 1).otherwise(0)
    last = lambda c, value, w: F.last(F.when(c, value), ignorenulls=True).over(w)

    article = is_open & (tag == "article") & has_class(tok, "ltx_document")
    first = lambda c: F.min(F.when(c, F.col("pos"))).over(page)
    out = found.withColumn("start", F.coalesce(first(article), first(is_open & (tag == "body")), F.lit(-1)))
    out = out.withColumn("end", F.when(first(article).isNotNull(), F.max(F.when((kind == "close") & (tag == "article"), F.col("pos"))).over(page)))
    out = out.withColumn("block", last(tag.isin(*BLOCKS) & kind.isin("open", "close"), F.struct(F.col("pos").alias("at"), "tag", is_open.alias("opens")), so_far))
    out = out.withColumn("block", F.when(F.col("block.opens") & F.col("block.tag").isin("p", *HEADINGS), F.col("block")))
    out = out.withColumn("depth", F.sum(F.when((tag == "table") & is_open, 1).when((tag == "table") & (kind == "close"), -1).otherwise(0)).over(so_far))
    level = Window.partitionBy("page_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grid = F.struct(F.col("pos").alias("at"), attribute(tok, "class").contains("ltx_equation").alias("equation"))
    out = out.withColumn("grid", F.when(F.col("depth") > 0, last((tag == "table") & is_open, grid, level)))

    own = Window.partitionBy("page_id", "grid.at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    edge = tag.isin(*ROWS) & kind.isin("open", "close")
    is_cell = tag.isin("td", "th")
    out = out.withColumn("row", F.sum(one(is_open & (tag == "tr"))).over(own)).withColumn("cell", F.sum(one(is_open & is_cell)).over(own))
    out = out.withColumn("inside", last(edge, is_open & is_cell, own)).withColumn("head", last(tag.isin("thead", "tbody", "tfoot"), is_open & (tag == "thead"), own))
    out = out.withColumn("nth", F.sum(one(kind == "math")).over(own))
    out = out.withColumn("cell", F.when(F.col("grid").isNotNull() & F.col("inside"), F.col("cell"))).withColumn("head", F.coalesce("head", F.lit(False)))

    of_block = Window.partitionBy("page_id", "block.at")
    out = out.withColumn("marked", F.max(kind == "error").over(of_block)).where("pos > start AND (end IS NULL OR pos < end)")
    equation = F.coalesce("grid.equation", F.lit(False))
    counts = (kind == "math") & F.when(equation, F.col("nth") == 1).otherwise((F.coalesce("block.tag", F.lit("")) == "p") & ~F.col("marked"))
    return out.withColumn("equation", equation).withColumn("counts", counts).withColumn("n", F.sum(one(F.col("counts"))).over(so_far) - 1).select("page_id", "pos", "tok", "tag", "kind", "block", "grid", "row", "cell", "head", "equation", "counts", "n")


def _inner(token: Column) -> Column:
    return unescaped(strip(F.regexp_extract(token, r"(?s)>([^<]*)<", 1)))


def _joined(parts: Column, value) -> Column:
    return F.array_join(F.transform(parts, value), "")


def paragraphs(scan: DataFrame) -> DataFrame:
    """page_id, at, id, text, heading_level, math_ids, drawing (the source of a TikZ drawing, its placeholder being the text; its entry among the formulas has the same place)."""
    tok, kind = F.col("tok"), F.col("kind")
    value = F.when(kind == "text", unescaped(tok)).when(kind.isin("error", "number"), _inner(tok)).when(kind == "math", F.when(F.col("counts"), F.format_string("[math_%d]", "n")).otherwise(unescaped(F.regexp_replace(tok, "<[^>]*>", "")))).otherwise("")
    part = F.struct("pos", "kind", value.alias("value"), F.when(F.col("counts"), F.format_string("math_%d", "n")).alias("math"))
    said = scan.where(F.col("block").isNotNull() & ~F.col("equation") & kind.isin("text", "math", "error", "number"))
    g = said.groupBy("page_id", F.col("block.at").alias("at"), F.col("block.tag").alias("tag")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    errors = F.filter("parts", lambda x: x["kind"] == "error")
    told = F.array_join(F.transform(errors, lambda x: x["value"]), " ")
    plain = _joined(F.col("parts"), lambda x: x["value"])
    without = _joined(F.col("parts"), lambda x: F.when(x["kind"] == "error", strip(F.regexp_replace(x["value"], COMMAND, ""))).otherwise(x["value"]))
    drawn = (F.size(errors) > 0) & (F.col("tag") == "p") & ~latex.is_pseudocode(told) & (latex.is_tikz(told) | latex.is_tikz(plain))
    text = (
        F.when(F.col("tag") != "p", latex.without_noise(_joined(F.col("parts"), lambda x: strip(x["value"]))))
        .when(F.size(errors) == 0, latex.without_noise(strip(plain)))
        .when(latex.is_pseudocode(told), latex.pseudocode(told))
        .when(drawn, latex.tikz_placeholder(plain))
        .otherwise(latex.without_noise(strip(without)))
    )
    level = F.when(F.col("tag") != "p", F.substring("tag", 2, 1).cast("int"))
    ids = F.when(F.col("tag") == "p", F.filter(F.transform("parts", lambda x: x["math"]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    # the filter on what explode gives stays above it, so texts are made once
    out = g.select("page_id", "at", F.explode(F.array(text)).alias("text"), level.alias("heading_level"), ids.alias("math_ids"), F.when(drawn, plain).alias("drawing")).where("text <> ''")
    return out.withColumn("id", F.format_string("p_%d", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1))


def cells(scan: DataFrame) -> DataFrame:
    """page_id, at (of the table), r, c, text, header: cells of the tables that aren't equations; rows without a cell don't count."""
    inside = scan.where(F.col("cell").isNotNull() & ~F.col("equation"))
    value = F.when(F.col("kind") == "text", strip(unescaped(F.col("tok")))).when(F.col("kind").isin("error", "number"), _inner(F.col("tok"))).when(F.col("kind") == "math", unescaped(F.regexp_replace("tok", "<[^>]*>", "")))
    parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("value")))))
    g = inside.groupBy("page_id", F.col("grid.at").alias("at"), "row", "cell", "head").agg(_joined(parts, lambda x: x["value"]).alias("text"))
    table = Window.partitionBy("page_id", "at")
    r = F.dense_rank().over(table.orderBy("row")) - 1
    c = F.row_number().over(Window.partitionBy("page_id", "at", "row").orderBy("cell")) - 1
    return g.select("page_id", "at", r.alias("r"), c.alias("c"), "text", F.col("head").alias("header"))


def tables(grid: DataFrame) -> DataFrame:
    """page_id, at, id, rows, columns, header_rows of cells."""
    g = grid.groupBy("page_id", "at").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), F.countDistinct(F.when(F.col("header"), F.col("r"))).cast("int").alias("header_rows"))
    return g.withColumn("id", F.format_string("tbl_%d", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1))


def images(scan: DataFrame) -> DataFrame:
    """page_id, at, id, src, alt, mime."""
    src = attribute(F.col("tok"), "src")
    found = scan.where("kind = 'open' AND tag = 'img'").select("page_id", F.col("pos").alias("at"), src.alias("src"), attribute(F.col("tok"), "alt").alias("alt"), mime(src).alias("mime"))
    return found.withColumn("id", F.format_string("img_%d", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1))


def formulas(scan: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, at, id, latex, display, unparsed, equation_number, drawing; drawings of paragraphs are entries without a formula."""
    numbers = scan.where("kind = 'number' AND equation").groupBy("page_id", F.col("grid.at").alias("table")).agg(F.min(F.struct("pos", _inner(F.col("tok")).alias("number"))).alias("number"))
    shown = attribute(F.col("tok"), "display")
    found = scan.where("counts").select(
        "page_id", F.col("pos").alias("at"), F.when(F.col("equation"), F.col("grid.at")).alias("table"), F.format_string("math_%d", "n").alias("id"), attribute(F.col("tok"), "alttext").alias("latex"),
        F.when(F.col("equation"), "block").when(shown == "", "inline").otherwise(shown).alias("display"), has_class(F.col("tok"), "ltx_math_unparsed").alias("unparsed"),
    )
    found = found.join(numbers, ["page_id", "table"], "left").select("page_id", "at", "id", "latex", "display", "unparsed", F.col("number.number").alias("equation_number"), F.lit(None).cast("string").alias("drawing"))
    drawn = texts.where("drawing IS NOT NULL").select("page_id", "at", F.lit(None).cast("string").alias("id"), F.lit("").alias("latex"), F.lit("block").alias("display"), F.lit(False).alias("unparsed"), F.lit(None).cast("string").alias("equation_number"), "drawing")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return found.unionByName(drawn).withColumn("place", place).withColumn("id", F.coalesce("id", F.format_string("math_tikz_%d", "place"))).drop("place")


def order(scan: DataFrame, texts: DataFrame, grids: DataFrame) -> DataFrame:
    """page_id, seq, kind, id: paragraphs, tables and block equations as they come."""
    equations = scan.where("counts AND equation").select("page_id", F.col("grid.at").alias("at"), F.lit("math").alias("kind"), F.format_string("math_%d", "n").alias("id"))
    both = texts.select("page_id", "at", F.lit("paragraph").alias("kind"), "id").union(grids.select("page_id", "at", F.lit("table").alias("kind"), "id")).union(equations)
    return both.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).alias("seq"), "kind", "id")


def model(pages: DataFrame, key: str = "page_id", html: str = "html") -> dict[str, DataFrame]:
    """paragraphs, tables, cells, images, math, order of the pages. Frames share a plan; whoever uses several writes ``nested(tokens(pages))`` first."""
    return frames(nested(tokens(pages, key, html)))


def frames(scan: DataFrame) -> dict[str, DataFrame]:
    texts, grid = paragraphs(scan), cells(scan)
    grids = tables(grid)
    named = grid.join(grids.select("page_id", "at", "id"), ["page_id", "at"])
    return {"paragraphs": texts, "tables": grids, "cells": named, "images": images(scan), "math": formulas(scan, texts), "order": order(scan, texts, grids)}


def render(pages: DataFrame, scan: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, html: the model written as a page again, its paragraphs, tables, images and block equations in their order; what pages hold besides is left out."""
    found = frames(scan)
    text = escape_html(F.col("text"))
    level = F.col("heading_level").cast("string")
    coded = F.col("text").startswith('<pre class="algorithm">')
    paragraph = F.when(level.isNotNull(), F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))).when(coded, F.col("text")).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    cell = F.when(F.col("header"), F.concat(F.lit('<th scope="col">'), text, F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), text, F.lit("</td>")))
    joined = lambda parts, name: F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda x: x[name]), "")
    rows = found["cells"].groupBy("page_id", "at", "r").agg(F.concat(F.lit("<tr>"), joined(F.struct("c", cell.alias("h")), "h"), F.lit("</tr>")).alias("row"), F.bool_and("header").alias("head"))
    part = lambda own, tag: F.when(F.count(F.when(own, 1)) > 0, F.concat(F.lit(f"<{tag}>"), joined(F.when(own, F.struct("r", "row")), "row"), F.lit(f"</{tag}>"))).otherwise("")
    grids = rows.groupBy("page_id", "at").agg(F.concat(F.lit("<table>"), part(F.col("head"), "thead"), part(~F.col("head"), "tbody"), F.lit("</table>")).alias("part"))
    alt, src = escape_html(F.col("alt")), escape_html(F.col("src"))
    images_ = found["images"].select("page_id", "at", F.concat(F.lit('<img alt="'), alt, F.lit('" src="'), src, F.lit('">')).alias("part"))
    equations = found["math"].where("display = 'block' AND drawing IS NULL").select("page_id", "at", F.concat(F.lit('<div role="math">'), escape_html(F.col("latex")), F.lit("</div>")).alias("part"))
    both = reduce(DataFrame.unionByName, [found["paragraphs"].select("page_id", "at", paragraph.alias("part")), grids, images_, equations])
    bodies = both.groupBy("page_id").agg(joined(F.struct("at", "part"), "part").alias("body"))
    title = escape_html(strip(unescaped(F.regexp_extract(html, "(?is)<title[^>]*>([^<]*)</title", 1))))
    lang = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']([^"']*)["']""", 1)
    head = F.concat(F.lit('<!DOCTYPE html><html lang="'), F.when(lang == "", "en").otherwise(lang), F.lit('"><head><title>'), title, F.lit("</title></head><body>"))
    named = pages.select(F.col(key).alias("page_id"), head.alias("head"))
    return named.join(bodies, "page_id", "left").select("page_id", F.concat("head", F.coalesce("body", F.lit("")), F.lit("</body></html>")).alias("html"))
