"""Queries of applied plans: documents of three formats, actions that fit and actions that don't, and the model after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import apply
from plumbline.registry import query
from plumbline.sources import tables as s
from plumbline.sources import twins as q

KINDS = ("set_title", "set_language", "set_alt_text", "set_decorative", "set_heading_level", "mark_header_rows", "set_link_text", "add_math_description", "fix_all_contrast", "paint", "set_title", "set_link_text", "set_alt_text", "set_heading_level")


def model(spark, sf) -> dict[str, DataFrame]:
    """A document for each page: docx, pptx and tex in turn, with paragraphs, images, tables, links and a formula by page_id."""
    k = F.col("doc_id")
    pages = s.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    each = lambda n: pages.select("doc_id", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    named = lambda prefix: F.format_string(prefix + "_%d", "i").alias("id")
    number = lambda c: c.cast("int")
    return {
        "meta": pages.select("doc_id", F.when(k % 3 == 0, "docx").when(k % 3 == 1, "pptx").otherwise("tex").alias("format"), F.col("url").alias("title"), F.lit("en").alias("language")),
        "paragraphs": each(F.lit(5) + k % 3).select("doc_id", named("p"), F.format_string("Paragraph %d", "i").alias("text"), F.lit(None).cast("int").alias("heading_level")),
        "images": each(F.lit(2)).select("doc_id", named("img"), F.col("i").alias("paragraph_index"), F.lit(0).alias("drawing_index"), F.lit(0).alias("slide_index"), F.col("i").alias("shape_index"), F.lit("old").alias("alt"), F.lit(False).alias("decorative")),
        "tables": each(F.lit(2)).select("doc_id", named("tbl"), number(F.lit(2) - F.col("i")).alias("rows"), F.lit(0).alias("header_rows"), ((F.col("i") == 0) & (k % 2 == 0)).alias("first_row_empty")),
        "links": each(F.lit(3)).select("doc_id", named("link"), F.format_string("link %d", "i").alias("text")),
        "math": pages.select("doc_id", F.lit("math_0").alias("id"), F.lit("").alias("description"), F.lit(0.5).alias("confidence")),
        "runs": s.colours(spark, sf).select("doc_id", F.lit("p_0").alias("paragraph_id"), F.col("k").alias("run"), "fg", "size", "bold"),
    }


def plan(spark, sf) -> DataFrame:
    """28 actions for each page, each kind twice, so that later ones override earlier ones or fail."""
    k, n = F.col("doc_id"), F.col("seq")
    rows = s.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(27))).alias("seq"))
    turn = n % 14
    text = lambda c: c.cast("string")
    pick = (k + n) % 4
    element = (
        F.when(turn.isin(2, 12), F.concat(F.lit("img_"), text(pick))).when(turn == 3, "img_0").when(turn == 4, F.concat(F.lit("p_"), text((k + n) % 9))).when(turn == 5, F.concat(F.lit("tbl_"), text((k + n) % 3)))
        .when(turn == 6, F.concat(F.lit("link_"), text((k + n) % 5))).when(turn == 7, F.when(n < 14, "math_0").otherwise("math_7")).when(turn == 11, "link-x").when(turn == 13, "p_1")
    )
    value = F.when((k + n) % 7 == 0, "").otherwise(F.concat(F.lit("value "), text(n), F.lit(" "), F.repeat(F.lit("long "), (k % 3 * 10).cast("int"))))
    parts = {
        "title": value, "language": F.lit("fr"), "alt_text": value, "new_text": value, "description": value, "header_count": text(1 + (k + n) % 2), "level": F.when(turn == 13, "").otherwise(text((k + n) % 11)),
        "paragraph_index": F.when(turn == 12, "").when(turn == 4, text((k + n) % 9)).when(turn == 3, "0").otherwise(text(pick)), "slide_index": F.when(turn == 12, "").otherwise(text(F.floor(pick / 3))), "shape_index": F.when(turn == 3, "0").otherwise(text(pick)),
        "table_index": text((k + n) % 3),
    }
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (turn + 1).cast("int"))
    return rows.select("doc_id", "seq", kind.alias("action_type"), element.alias("element_id"), F.create_map(*(x for name, c in parts.items() for x in (F.lit(name), c))).alias("parameters"), F.when(turn == 10, "skipped").otherwise("planned").alias("status"))


ACTIONS = (
    q.COLOURS
    + f""", mended AS (WITH pairs AS (SELECT DISTINCT fg, '#FFFFFF' AS bg, size, bold FROM colours), {q.REPAIRED} SELECT colours.doc_id, k, colours.fg, fixed, fixed <> colours.fg OR bad AS failing, fixed IS NOT NULL AND still AS still FROM colours JOIN (
    SELECT fg, size, bold, fixed, ratio < need AS bad, greatest(lx, 1.0) / least(lx, 1.0) AS unused, (1.05 / (lx + 0.05)) < need AS still FROM (SELECT fg, size, bold, fixed, {q.luminance('fixed')} AS lx, 1.05 / ({q.luminance('fg')} + 0.05) AS ratio, CASE WHEN size >= CASE WHEN bold THEN 14 ELSE 18 END THEN 3.0 ELSE 4.5 END AS need FROM repaired)) r
    ON r.fg = colours.fg AND r.size = colours.size AND r.bold = colours.bold),
counts AS (SELECT doc_id, count(*) FILTER (failing) AS first, count(*) FILTER (still) AS later FROM mended GROUP BY 1),
p AS (SELECT page_id AS k, n, n % 14 AS t, (page_id + n) % 4 AS pick, ['docx', 'pptx', 'tex'][page_id % 3 + 1] AS f, ({list(KINDS)!r})[n % 14 + 1] AS kind,
  CASE WHEN (page_id + n) % 7 = 0 THEN '' ELSE 'value ' || n || ' ' || repeat('long ', (page_id % 3 * 10)::INT) END AS v FROM pages, range(28) r(n)),
e AS (SELECT *, CASE WHEN t IN (2, 12) THEN 'img_' || pick WHEN t = 3 THEN 'img_0' WHEN t = 4 THEN 'p_' || (k + n) % 9 WHEN t = 5 THEN 'tbl_' || (k + n) % 3 WHEN t = 6 THEN 'link_' || (k + n) % 5 WHEN t = 7 THEN CASE WHEN n < 14 THEN 'math_0' ELSE 'math_7' END WHEN t = 11 THEN 'link-x' WHEN t = 13 THEN 'p_1' END AS element_id FROM p),
o AS (SELECT *, CASE
  WHEN t = 10 THEN ['skipped', 'Pre-skipped'] WHEN t = 9 THEN ['skipped', 'Unknown action type: paint']
  WHEN f = 'pptx' AND t IN (4, 13) THEN ['skipped', 'Heading levels not modifiable in PPTX'] WHEN f = 'pptx' AND t = 5 THEN ['skipped', 'Table headers not modifiable in PPTX']
  WHEN f = 'pptx' AND t IN (6, 11) THEN ['skipped', 'Link text modification not yet supported for PPTX'] WHEN f = 'pptx' AND t = 8 THEN ['skipped', 'Contrast fix not yet supported for PPTX']
  WHEN f <> 'tex' AND t = 7 THEN ['skipped', 'Math descriptions apply to document model only (not docx/pptx)']
  WHEN t = 13 THEN ['failed', 'Missing level']
  WHEN v = '' AND t = 0 THEN ['failed', 'Empty title'] WHEN v = '' AND t IN (2, 12) THEN ['failed', 'Empty alt text'] WHEN v = '' AND t IN (6, 11) THEN ['failed', CASE WHEN f = 'tex' THEN 'Empty link text' ELSE 'Empty new_text' END] WHEN v = '' AND t = 7 THEN ['failed', 'Empty description']
  WHEN f = 'pptx' AND t = 12 THEN ['failed', 'Missing slide_index or shape_index for pptx'] WHEN f = 'docx' AND t = 12 THEN ['failed', 'Missing paragraph_index']
  WHEN f = 'pptx' AND t IN (2, 3) AND pick = 3 THEN ['failed', 'Slide index 1 out of range (pres has 1 slides)'] WHEN f = 'pptx' AND t = 2 AND pick = 2 THEN ['failed', 'Shape index 2 out of range (slide has 2 shapes)']
  WHEN f = 'docx' AND t = 2 AND pick >= 2 THEN ['failed', 'Drawing index 0 out of range (paragraph has 0 images)']
  WHEN f = 'docx' AND t = 4 AND (k + n) % 11 NOT BETWEEN 1 AND 9 THEN ['failed', 'Invalid heading level: ' || (k + n) % 11]
  WHEN f = 'docx' AND t = 4 AND (k + n) % 9 >= 5 + k % 3 THEN ['failed', 'Paragraph index ' || (k + n) % 9 || ' out of range']
  WHEN f = 'docx' AND t = 5 AND (k + n) % 3 = 2 THEN ['failed', 'Table index 2 out of range (doc has 2 tables)'] WHEN f = 'docx' AND t = 5 AND 1 + (k + n) % 2 > 2 - (k + n) % 3 THEN ['failed', 'header_count 2 exceeds table row count 1']
  WHEN f = 'docx' AND t = 11 THEN ['failed', 'Cannot parse link index from: link-x'] WHEN f = 'docx' AND t = 6 AND (k + n) % 5 > 2 THEN ['failed', 'Link index ' || (k + n) % 5 || ' out of range (document has 3 hyperlinks)']
  WHEN t IN (2, 12) AND pick > 1 THEN ['failed', 'Image not found: ' || element_id] WHEN t = 4 AND (k + n) % 9 >= 5 + k % 3 THEN ['failed', 'Paragraph not found: ' || element_id] WHEN t = 5 AND (k + n) % 3 = 2 THEN ['failed', 'Table not found: tbl_2']
  WHEN t = 11 OR t = 6 AND (k + n) % 5 > 2 THEN ['failed', 'Link not found: ' || element_id] WHEN t = 7 AND n > 14 THEN ['failed', 'Math element not found: math_7']
  WHEN f = 'tex' AND t = 5 AND (k + n) % 3 = 0 AND k % 2 = 0 THEN ['skipped', 'First row is all empty — not marking as header']
  WHEN t IN (2, 12) THEN ['executed', 'Set alt text: ' || left(v, 80)] WHEN t = 3 THEN ['executed', 'Marked as decorative'] WHEN t = 4 THEN ['executed', 'Set to Heading ' || (k + n) % 11] WHEN t = 5 THEN ['executed', 'Marked ' || (1 + (k + n) % 2) || ' header row(s)']
  WHEN t = 0 THEN ['executed', 'Set title: ' || v] WHEN t = 1 THEN ['executed', 'Set language: fr'] WHEN t = 6 THEN ['executed', 'Set link text: ' || left(v, 80)] WHEN t = 7 THEN ['executed', 'Set math description: ' || left(v, 80)]
  ELSE ['executed', 'Fixed ' || coalesce(CASE WHEN n < 14 THEN first ELSE later END, 0) || ' contrast issues'] END AS x FROM e LEFT JOIN counts ON counts.doc_id = k),
acts AS (SELECT k AS doc_id, n AS seq, t, f, kind AS action_type, element_id, v, pick, x[1] AS status, x[2] AS detail FROM o), ok AS (SELECT *, doc_id AS k, seq AS n FROM acts WHERE status = 'executed')"""
)


@query("j01_execution", f"WITH {ACTIONS} SELECT doc_id, seq, action_type, element_id, status, detail FROM acts")
def j01_execution(spark, sf):
    return apply.execute(plan(spark, sf), model(spark, sf))[0]


@query("j01_execution_totals", f"WITH {ACTIONS} SELECT doc_id, count(*) FILTER (status = 'executed') AS executed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM acts GROUP BY 1")
def j01_totals(spark, sf):
    return apply.totals(apply.execute(plan(spark, sf), model(spark, sf))[0])


def after(spark, sf, frame: str) -> DataFrame:
    return apply.execute(plan(spark, sf), model(spark, sf))[1][frame]


@query("j03_meta_after", f"WITH {ACTIONS} SELECT page_id AS doc_id, coalesce((SELECT arg_max(v, seq) FROM ok WHERE k = page_id AND t = 0), url) AS title, 'fr' AS language FROM pages")
def j03_meta(spark, sf):
    return after(spark, sf, "meta").select("doc_id", "title", "language")


@query("j03_images_after", f"""WITH {ACTIONS} SELECT page_id AS doc_id, 'img_' || i AS id, coalesce((SELECT arg_max(CASE WHEN t = 3 THEN '' ELSE v END, seq) FROM ok WHERE k = page_id AND (t IN (2, 12) AND pick = i OR t = 3 AND i = 0)), 'old') AS alt,
  page_id % 3 = 2 AND i = 0 AS decorative FROM pages, range(2) r(i)""")
def j03_images(spark, sf):
    return after(spark, sf, "images").select("doc_id", "id", "alt", "decorative")


@query("j03_paragraphs_after", f"WITH {ACTIONS} SELECT page_id AS doc_id, 'p_' || i AS id, (SELECT arg_max((k + n) % 11, seq)::INT FROM ok WHERE k = page_id AND t = 4 AND (k + n) % 9 = i) AS heading_level FROM pages, range(7) r(i) WHERE i < 5 + page_id % 3")
def j03_paragraphs(spark, sf):
    return after(spark, sf, "paragraphs").select("doc_id", "id", "heading_level")


@query("j03_tables_after", f"WITH {ACTIONS} SELECT page_id AS doc_id, 'tbl_' || i AS id, coalesce((SELECT arg_max(1 + (k + n) % 2, seq) FROM ok WHERE k = page_id AND t = 5 AND (k + n) % 3 = i), 0)::INT AS header_rows FROM pages, range(2) r(i)")
def j03_tables(spark, sf):
    return after(spark, sf, "tables").select("doc_id", "id", "header_rows")


@query("j03_links_after", f"WITH {ACTIONS} SELECT page_id AS doc_id, 'link_' || i AS id, coalesce((SELECT arg_max(v, seq) FROM ok WHERE k = page_id AND t = 6 AND (k + n) % 5 = i), 'link ' || i) AS text FROM pages, range(3) r(i)")
def j03_links(spark, sf):
    return after(spark, sf, "links")


@query("j03_math_after", f"WITH {ACTIONS} SELECT page_id AS doc_id, 'math_0' AS id, coalesce((SELECT arg_max(v, seq) FROM ok WHERE k = page_id AND t = 7), '') AS description, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE k = page_id AND t = 7) THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM pages")
def j03_math(spark, sf):
    return after(spark, sf, "math")


@query("j03_runs_after", f"WITH {ACTIONS} SELECT doc_id, k AS run, CASE WHEN doc_id % 3 <> 1 AND EXISTS (SELECT 1 FROM pages WHERE page_id = doc_id) THEN fixed ELSE fg END AS fg FROM mended")
def j03_runs(spark, sf):
    return after(spark, sf, "runs").select("doc_id", "run", "fg")
