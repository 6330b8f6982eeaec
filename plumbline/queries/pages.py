"""Queries of Markdown pages, recognised words and regions, with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.registry import query
from plumbline.sources import markdown, ocr
from plumbline.sources import tables as s
from plumbline.sources import twins as q


def markdown_pages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A page of Markdown for eight lines of a document, each line as another construct by its place, and the tables that some lines refer to."""
    p, pos = F.col("pos"), F.col("pos").cast("string")
    w = F.concat(F.lit("w"), F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 10))
    c = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    kinds = (
        c("# Head ", w, " #"), c("Text **", w, "**\ncontinued [go *", w, "*](http://x/", pos, ") and `code` end"), c("> quote ", w, "\nlazy line"), c("- item ", w, "\n- second"),
        c("A | B\n--- | :-:\n", w, " | **y** | extra\nz\n> after"), c("```\n# no ", w, "\n```\nafter fence"), c("Setext ", w, "\n==="), F.lit("152 MAYER"), c("[t](tbl-", pos, ".md)"),
    )
    piece = F.element_at(F.array(*kinds), (p % 9 + 1).cast("int"))
    rows = s.lines(spark, sf).withColumn("page", F.floor(p / 8)).withColumn("piece", piece).withColumn("w", w)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "\n\n")
    named = rows.where((p % 9 == 8) & (p % 2 == 0)).select("doc_id", "page", c("tbl-", pos, ".md").alias("name"), c("| H |\n|---|\n| ", F.col("w"), " |").alias("content"))
    return rows.groupBy("doc_id", "page").agg(text.alias("markdown")), named


MARKDOWN = (
    q.LINES
    + """, pieces AS (SELECT doc_id, pos, pos // 8 AS page, pos % 9 AS t, 'w' || left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 10) AS w FROM lines),
texts AS (SELECT doc_id, page, pos, 0 AS sub, 'Head ' || w AS text, 1 AS heading_level FROM pieces WHERE t = 0
  UNION ALL SELECT doc_id, page, pos, 0, 'Text ' || w || ' continued go ' || w || ' and  end', NULL FROM pieces WHERE t = 1
  UNION ALL SELECT doc_id, page, pos, 0, 'quote ' || w || ' lazy line', NULL FROM pieces WHERE t = 2
  UNION ALL SELECT doc_id, page, pos, 0, 'item ' || w, NULL FROM pieces WHERE t = 3 UNION ALL SELECT doc_id, page, pos, 1, 'second', NULL FROM pieces WHERE t = 3
  UNION ALL SELECT doc_id, page, pos, 1, 'after', NULL FROM pieces WHERE t = 4 UNION ALL SELECT doc_id, page, pos, 0, 'after fence', NULL FROM pieces WHERE t = 5
  UNION ALL SELECT doc_id, page, pos, 0, 'Setext ' || w, 1 FROM pieces WHERE t = 6 UNION ALL SELECT doc_id, page, pos, 0, '152 MAYER', NULL FROM pieces WHERE t = 7 AND pos % 8 <> 0
  UNION ALL SELECT doc_id, page, pos, 0, 't', NULL FROM pieces WHERE t = 8 AND pos % 2 = 1),
paragraphs AS (SELECT *, 'ocr_p_' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1) AS id FROM texts),
tables AS (SELECT *, 'ocr_tbl_' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS id FROM pieces WHERE t = 4 OR t = 8 AND pos % 2 = 0)"""
)


def _markdown(spark, sf, frame: str) -> DataFrame:
    return markdown.model(*markdown_pages(spark, sf))[frame]


@query("a06_markdown_paragraphs", f"WITH {MARKDOWN} SELECT doc_id, page, id, text, heading_level FROM paragraphs")
def a06_paragraphs(spark, sf):
    return _markdown(spark, sf, "paragraphs").select("doc_id", "page", "id", "text", "heading_level")


@query("a06_markdown_tables", f"WITH {MARKDOWN} SELECT doc_id, page, id, CASE WHEN t = 4 THEN 3 ELSE 2 END AS rows, CASE WHEN t = 4 THEN 2 ELSE 1 END AS columns, 1 AS header_rows FROM tables")
def a06_tables(spark, sf):
    return _markdown(spark, sf, "tables").select("doc_id", "page", "id", "rows", "columns", "header_rows")


@query("a06_markdown_cells", f"WITH {MARKDOWN} SELECT doc_id, id, x[1]::INT AS r, x[2]::INT AS c, x[3] AS text FROM (SELECT doc_id, id, unnest(CASE WHEN t = 4 THEN [['0', '0', 'A'], ['0', '1', 'B'], ['1', '0', w], ['1', '1', '**y**'], ['2', '0', 'z'], ['2', '1', '']] ELSE [['0', '0', 'H'], ['1', '0', w]] END) AS x FROM tables)")
def a06_cells(spark, sf):
    return _markdown(spark, sf, "cells").select("doc_id", "id", "r", "c", "text")


@query("a06_markdown_links", f"WITH {MARKDOWN} SELECT doc_id, page, 'ocr_link_' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS id, paragraph_id, text, url FROM (SELECT p.doc_id, p.page, p.pos, id AS paragraph_id, CASE WHEN t = 1 THEN 'go ' || w ELSE 't' END AS text, CASE WHEN t = 1 THEN 'http://x/' || p.pos ELSE 'tbl-' || p.pos || '.md' END AS url FROM paragraphs p JOIN pieces USING (doc_id, pos) WHERE t = 1 OR t = 8)")
def a06_links(spark, sf):
    return _markdown(spark, sf, "links").select("doc_id", "page", "id", "paragraph_id", "text", "url")


@query("a06_markdown_order", f"WITH {MARKDOWN} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1)::INT AS seq, kind, id FROM (SELECT doc_id, page, pos, sub, 'paragraph' AS kind, id FROM paragraphs UNION ALL SELECT doc_id, page, pos, 0, 'table', id FROM tables)")
def a06_order(spark, sf):
    return _markdown(spark, sf, "order")


def words(spark, sf) -> DataFrame:
    """Words of documents on pages of 180, six in a line and three lines in a block, with confidence and boxes."""
    i, j = F.col("i"), F.col("i") % 180
    line = F.floor(j / 6)
    found = s.dealt_documents(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return found.select("doc_id", F.floor(i / 180).alias("page"), "i", "text", ((F.col("doc_id") + i) * 13 % 100).alias("conf"), (j % 6 * 50).alias("x"), (line * 20 + F.floor(line / 3) * 40 + i % 3).alias("y"), F.least(F.length("text"), F.lit(45)).alias("w"), F.lit(10).alias("h"))


WORDS = """words AS (SELECT doc_id, i // 180 AS page, i, text, (doc_id + i) * 13 % 100 AS conf, i % 180 % 6 * 50 AS x, i % 180 // 6 * 20 + i % 180 // 18 * 40 + i % 3 AS y, least(length(text), 45) AS w, 10 AS h, i % 180 // 6 + 1 AS line, i % 180 // 18 AS block
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS i FROM documents))"""
LEAKED = f"({q.N_WORDS.format('text')} BETWEEN 1 AND 12 AND (regexp_matches(text, '^[A-Z][A-Z\\s''’:,\\-]+\\d{{1,4}}\\s*$') OR regexp_matches(text, '^\\d{{1,4}}\\s+[A-Z]{{2,}}(\\s+[A-Z]{{2,}})*\\s*$') OR regexp_matches(text, '^\\d{{1,3}}$')))"


@query("a10_lines_and_blocks", f"WITH {WORDS} SELECT doc_id, page, i, line, block FROM words")
def a10_islands(spark, sf):
    return ocr.lines_and_blocks(words(spark, sf)).select("doc_id", "page", "i", "line", "block")


@query("a10_blocks", f"""WITH {WORDS}, good AS (SELECT *, {q.STRIP.format('text')} AS t FROM words WHERE conf >= 20), g AS (SELECT doc_id, page, block, string_agg(t, ' ' ORDER BY line, x) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS words FROM good WHERE t <> '' GROUP BY ALL)
  SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block) - 1)::INT AS id, text, x, y, w, h, words FROM g WHERE length(text) >= 3 AND NOT {LEAKED}""")
def a10_blocks(spark, sf):
    return ocr.blocks(ocr.lines_and_blocks(words(spark, sf)), ("line", "x")).select("doc_id", "page", "id", "text", "x", "y", "w", "h", "words")


REGION_TYPES = ("heading", "paragraph", "equation", "caption", "footnote", "table", "figure", "page_header", "paragraph")


def regions(spark, sf) -> dict[str, DataFrame]:
    """Blocks from lines, twelve a page, and four regions a page of all types, each naming two blocks, the later one first, and one that isn't there."""
    found = s.faulty_lines(spark, sf).select("doc_id", F.floor(F.col("pos") / 12).alias("page"), (F.col("pos") % 12).alias("id"), "text")
    r, key = F.col("region"), F.col("doc_id") + F.col("page")
    pages = found.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region"))
    kind = F.element_at(F.array(*map(F.lit, REGION_TYPES)), ((key + r) % 9 + 1).cast("int"))
    strings = lambda *x: F.array(*map(F.lit, x))
    structured = (kind == "table") & (key % 2 == 0)
    asked = pages.select(
        "doc_id", "page", "region", (r * 3 % 4).alias("reading_order"), kind.alias("type"), F.array(2 * r + 1, 2 * r, F.lit(99)).alias("block_ids"), ((F.col("doc_id") + r) % 9).cast("int").alias("heading_level"), (r % 2 == 0).alias("bold"), (r % 3 == 0).alias("italic"),
        F.when(r == 0, "large").when(r == 1, "small").when(r == 2, "normal").alias("size"), F.when(structured, strings("h1", "h2")).alias("headers"), F.when(structured, F.array(strings("a", "b", "c"), strings("d"))).alias("rows"), F.when((kind == "figure") & (r % 2 == 0), F.format_string("Figure %d", r)).alias("description"),
    )
    return ocr.merge(found, asked)


REGIONS = (
    q.FAULTY_LINES
    + f""", found AS (SELECT doc_id, pos // 12 AS page, pos % 12 AS id, {q.STRIP.format('text')} AS t FROM faulty),
asked AS (SELECT doc_id, page, r, r * 3 % 4 AS o, ({list(REGION_TYPES)!r})[(doc_id + page + r) % 9 + 1] AS type, (doc_id + page) % 2 = 0 AS even FROM (SELECT DISTINCT doc_id, page FROM found), range(4) g(r)),
said AS (SELECT a.*, concat_ws(' ', nullif(x.t, ''), nullif(y.t, '')) AS text FROM asked a LEFT JOIN found x ON x.doc_id = a.doc_id AND x.page = a.page AND x.id = 2 * r + 1 LEFT JOIN found y ON y.doc_id = a.doc_id AND y.page = a.page AND y.id = 2 * r),
body AS (SELECT * FROM said WHERE type <> 'page_header' AND (type IN ('table', 'figure') OR text = '' OR NOT {LEAKED}))"""
)


def _number(prefix: str) -> str:
    return f"'ocr_{prefix}_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page, o) - 1)"


@query("d12_region_paragraphs", f"""WITH {REGIONS} SELECT doc_id, page, {_number('p')} AS id, text, CASE WHEN type = 'heading' THEN greatest(1, least(6, (doc_id + r) % 9)) END::INT AS heading_level, CASE WHEN type = 'heading' OR type = 'paragraph' AND r % 2 = 0 THEN true END AS bold,
  CASE WHEN type IN ('equation', 'caption') OR type = 'paragraph' AND r % 3 = 0 THEN true END AS italic, CASE WHEN type = 'table' THEN NULL WHEN type IN ('caption', 'footnote') OR r = 1 THEN 10.0 WHEN r = 0 OR type = 'heading' AND r = 3 THEN 16.0 ELSE 12.0 END::DOUBLE AS points FROM body WHERE text <> '' AND (type NOT IN ('table', 'figure') OR type = 'table' AND NOT even)""")
def d12_paragraphs(spark, sf):
    return regions(spark, sf)["paragraphs"]


@query("d12_region_tables", f"WITH {REGIONS} SELECT doc_id, page, {_number('tbl')} AS id, 3 AS rows, 3 AS columns, 1 AS header_rows FROM body WHERE type = 'table' AND even")
def d12_tables(spark, sf):
    return regions(spark, sf)["tables"]


@query("d12_region_images", f"WITH {REGIONS} SELECT doc_id, page, {_number('img')} AS id, CASE WHEN r % 2 = 0 THEN 'Figure ' || r ELSE text END AS alt FROM body WHERE type = 'figure'")
def d12_images(spark, sf):
    return regions(spark, sf)["images"]
