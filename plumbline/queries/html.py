"""Queries of the document model that HTML pages give, with SQL written on its own: nesting by window functions in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import latex
from plumbline.operators.spread import dealt_out
from plumbline.queries.extras import written
from plumbline.queries.scalar import told
from plumbline.registry import query
from plumbline.sources import html
from plumbline.sources import tables as s
from plumbline.sources import twins as q


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _mark(text: str) -> str:
    return f'<span class="ltx_ERROR undefined">{text}</span>'


RICH = (
    """rich AS (SELECT page_id, replace(html, '</article>', '<h2 class="ltx_title">Part &amp; ' || page_id || '</h2><p class="ltx_p">Let <math alttext="x_' || page_id || '" display="inline"><mi>x</mi></math> be <i>real</i>.</p>'
  || CASE WHEN page_id % 3 = 0 THEN '<table class="ltx_equation ltx_eqn"><tr><td><p>in</p><math class="ltx_math_unparsed" alttext="E=' || page_id || '"><mi>E</mi></math></td><td><span class="ltx_tag ltx_tag_equation">(' || page_id || ')</span></td></tr></table>' ELSE '' END
  || '<table class="ltx_tabular">' || CASE WHEN page_id % 2 = 0 THEN '<thead><tr><th>Name</th><th> Value</th></tr></thead>' ELSE '' END || '<tbody><tr><td>x <b>y</b></td><td>' || page_id
  || CASE WHEN page_id % 5 = 0 THEN '<table><tr><td>inner</td></tr></table>after' ELSE '' END || '</td></tr><tr></tr><tr><td>last</td></tr></tbody></table>'"""
    + f"""
  || CASE page_id % 4 WHEN 0 THEN {_lit('<p>' + _mark(chr(92) + 'draw') + ' (0,0) -- (1,1);</p>')} WHEN 1 THEN {_lit('<p>Some text. ' + _mark(chr(92) + 'badcmd') + ' More ' + _mark(chr(92) + 'sc kept') + '.</p>')}
     WHEN 2 THEN {_lit('<p>' + _mark(chr(92) + 'Function') + ' <span class="ltx_ERROR">{F')} || page_id || {_lit('}</span> ' + _mark('{x}') + ' ' + _mark(chr(92) + 'State') + ' ' + _mark(chr(92) + 'Return') + ' ' + _mark('x') + '</p>')} ELSE '' END
  || '<p>next <img src="fig_' || page_id || CASE WHEN page_id % 7 = 0 THEN '.jpg"' ELSE '.png"' END || CASE WHEN page_id % 3 <> 1 THEN ' alt="Figure of ' || page_id || '"' ELSE '' END || '> para</article>') AS html FROM pages)"""
)


def _plain(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _clean(c: str) -> str:
    noise, strip = f"regexp_replace({c}, {_lit(latex.PAGE_NOISE.replace(chr(92) + 'u2026', chr(0x2026)))}, '', 'g')", q.STRIP.format
    lines = f"list_filter(string_split({noise}, chr(10)), lambda x: {strip('x')} <> '' AND NOT regexp_matches({strip('x')}, {_lit(latex.ARGUMENT_NOISE)}))"
    return f"CASE WHEN regexp_matches({strip(noise)}, {_lit(latex.LISTING_NOISE)}) THEN '' ELSE regexp_replace({strip(f'array_to_string({lines}, chr(10))')}, '  +', ' ', 'g') END"


_BLOCK = "'" + "', '".join(html.BLOCKS) + "'"
_INNER = _plain(q.STRIP.format("regexp_extract(tok, '>([^<]*)<', 1)"))
_CELL = "regexp_replace(tok, '<[^>]*>', '', 'g')"

SCAN = (
    RICH
    + f""",
raw AS (SELECT page_id, unnest(regexp_extract_all(html, {_lit(html.TOKEN)})) AS tok, unnest(range(len(regexp_extract_all(html, {_lit(html.TOKEN)})))) AS pos FROM rich),
named AS (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM raw),
kinds AS (SELECT *, CASE WHEN tok NOT LIKE '<%' THEN 'text' WHEN tok LIKE '</%' THEN 'close' WHEN tag = 'math' THEN 'math' WHEN tok LIKE '%"ltx_ERROR%' AND tok LIKE '%</span>' THEN 'error' WHEN tok LIKE '%ltx_tag_equation%</span>' THEN 'number' ELSE 'open' END AS kind
  FROM named WHERE tok NOT LIKE '<%' OR tag <> '' AND tag NOT IN ('script', 'style') AND tok LIKE '%>'),
level AS (SELECT *, last_value(CASE WHEN tag IN ({_BLOCK}) AND kind IN ('open', 'close') THEN pos END IGNORE NULLS) OVER w AS edge, sum(CASE WHEN tag <> 'table' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER w AS depth,
  min(CASE WHEN tag = 'body' AND kind = 'open' THEN pos END) OVER (PARTITION BY page_id) AS begin FROM kinds WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
blocked AS (SELECT l.*, CASE WHEN e.kind = 'open' AND e.tag IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN edge END AS block, e.tag AS block_tag FROM level l LEFT JOIN kinds e ON e.page_id = l.page_id AND e.pos = l.edge),
grids AS (SELECT *, CASE WHEN depth > 0 THEN last_value(CASE WHEN tag = 'table' AND kind = 'open' THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS grid FROM blocked),
rowed AS (SELECT *, sum((kind = 'open' AND tag = 'tr')::INT) OVER w AS r, sum((kind = 'open' AND tag IN ('td', 'th'))::INT) OVER w AS c, sum((kind = 'math')::INT) OVER w AS nth,
  last_value(CASE WHEN tag IN ('thead', 'tbody', 'tfoot', 'tr', 'td', 'th') AND kind IN ('open', 'close') THEN kind = 'open' AND tag IN ('td', 'th') END IGNORE NULLS) OVER w AS inside,
  coalesce(last_value(CASE WHEN tag IN ('thead', 'tbody', 'tfoot') THEN kind = 'open' AND tag = 'thead' END IGNORE NULLS) OVER w, false) AS head,
  coalesce(max(CASE WHEN pos = grid THEN tok LIKE '%"ltx_equation%' END) OVER (PARTITION BY page_id, grid), false) AND grid IS NOT NULL AS equation, bool_or(kind = 'error') OVER (PARTITION BY page_id, block) AS marked
  FROM grids WINDOW w AS (PARTITION BY page_id, grid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
counted AS (SELECT *, kind = 'math' AND CASE WHEN equation THEN nth = 1 ELSE block IS NOT NULL AND block_tag = 'p' AND NOT marked END AS counts FROM rowed WHERE pos > begin),
scan AS (SELECT *, sum(counts::INT) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS n FROM counted),
parts AS (SELECT page_id, block, block_tag, pos, kind, counts, n, CASE WHEN kind = 'text' THEN {_plain('tok')} WHEN kind IN ('error', 'number') THEN {_INNER} WHEN counts THEN '[math_' || n || ']' ELSE {_plain(_CELL)} END AS value
  FROM scan WHERE block IS NOT NULL AND NOT equation AND kind IN ('text', 'math', 'error', 'number')),
said AS (SELECT page_id, block, block_tag, string_agg(value, '' ORDER BY pos) AS plain, string_agg({q.STRIP.format('value')}, '' ORDER BY pos) AS tight, coalesce(string_agg(value, ' ' ORDER BY pos) FILTER (kind = 'error'), '') AS errors,
  string_agg(CASE WHEN kind = 'error' THEN {q.STRIP.format("regexp_replace(value, '" + chr(92) * 2 + "[A-Za-z]+" + chr(92) + "*?', '', 'g')")} ELSE value END, '' ORDER BY pos) AS bare,
  coalesce(list('math_' || n ORDER BY pos) FILTER (counts), []) AS ids FROM parts GROUP BY ALL),
texts AS (SELECT page_id, block AS place, CASE WHEN block_tag <> 'p' THEN substr(block_tag, 2, 1)::INT END AS heading_level, CASE WHEN block_tag = 'p' THEN ids ELSE [] END AS ids, contains(errors, '\\draw') AS drawn, plain,
  CASE WHEN block_tag <> 'p' THEN {_clean('tight')} WHEN errors = '' THEN {_clean(q.STRIP.format('plain'))} WHEN contains(errors, '\\Function') THEN '<pre class="algorithm">' || chr(10) || '<strong>Function</strong> F' || page_id || '(x):' || chr(10) || '    <strong>Return</strong> x' || chr(10) || '</pre>'
    WHEN contains(errors, '\\draw') THEN {_lit(told('diagram', 'It contains a TikZ diagram with 2 edges.'))} ELSE {_clean(q.STRIP.format('bare'))} END AS text FROM said),
paragraphs AS (SELECT *, 'p_' || (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1) AS id FROM texts WHERE text <> ''),
cells AS (SELECT page_id, grid, r, c, head, coalesce(string_agg(CASE WHEN kind = 'text' THEN {q.STRIP.format(_plain('tok'))} WHEN kind IN ('error', 'number') THEN {_INNER} WHEN kind = 'math' THEN {_plain(_CELL)} END, '' ORDER BY pos), '') AS text
  FROM scan WHERE grid IS NOT NULL AND inside AND NOT equation GROUP BY ALL),
tables AS (SELECT page_id, grid, count(DISTINCT r)::INT AS n_rows, max(cs)::INT AS n_columns, count(DISTINCT r) FILTER (head)::INT AS header_rows FROM (SELECT page_id, grid, r, head, count(*) OVER (PARTITION BY page_id, grid, r) AS cs FROM cells) GROUP BY ALL),
named_tables AS (SELECT *, 'tbl_' || (row_number() OVER (PARTITION BY page_id ORDER BY grid) - 1) AS id FROM tables)"""
)


def _frame(spark, sf, name):
    return s.page_model(spark, sf)[name]


@query("a05_html_paragraphs", f"WITH {SCAN} SELECT page_id, id, text, heading_level, array_to_string(ids, ' ') AS math_ids FROM paragraphs")
def a05_paragraphs(spark, sf):
    return _frame(spark, sf, "paragraphs").select("page_id", "id", "text", "heading_level", F.array_join("math_ids", " ").alias("math_ids"))


@query("a05_html_tables", f"WITH {SCAN} SELECT page_id, id, n_rows AS rows, n_columns AS columns, header_rows FROM named_tables")
def a05_tables(spark, sf):
    return _frame(spark, sf, "tables").select("page_id", "id", "rows", "columns", "header_rows")


@query("a05_html_cells", f"WITH {SCAN} SELECT page_id, id, (dense_rank() OVER (PARTITION BY page_id, grid ORDER BY r) - 1)::INT AS r, (row_number() OVER (PARTITION BY page_id, grid, r ORDER BY c) - 1)::INT AS c, text, head AS header FROM cells JOIN named_tables USING (page_id, grid)")
def a05_cells(spark, sf):
    return _frame(spark, sf, "cells").select("page_id", "id", "r", "c", "text", "header")


@query("a05_html_images", f"WITH {RICH} SELECT page_id, 'img_0' AS id, 'fig_' || page_id || CASE WHEN page_id % 7 = 0 THEN '.jpg' ELSE '.png' END AS src, regexp_extract(html, '<img [^>]*alt=\"([^\"]*)\"', 1) AS alt, CASE WHEN page_id % 7 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM rich WHERE contains(html, '<img ')")
def a05_images(spark, sf):
    return _frame(spark, sf, "images").select("page_id", "id", "src", "alt", "mime")


@query("a05_html_math", f"""WITH {SCAN}, found AS (SELECT page_id, pos, n, regexp_extract(tok, 'alttext="([^"]*)"', 1) AS latex, CASE WHEN equation THEN 'block' ELSE 'inline' END AS display, contains(tok, '"ltx_math_unparsed"') AS unparsed, CASE WHEN equation THEN '(' || page_id || ')' END AS equation_number, NULL AS drawing FROM scan WHERE counts
    UNION ALL SELECT page_id, place, NULL, '', 'block', false, NULL, plain FROM paragraphs WHERE drawn)
  SELECT page_id, CASE WHEN n IS NULL THEN 'math_tikz_' || (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1) ELSE 'math_' || n END AS id, latex, display, unparsed, equation_number, drawing FROM found""")
def a05_math(spark, sf):
    return _frame(spark, sf, "math").select("page_id", "id", "latex", "display", "unparsed", "equation_number", "drawing")


@query("a05_html_order", f"""WITH {SCAN}, found AS (SELECT page_id, place, 'paragraph' AS kind, id FROM paragraphs UNION ALL SELECT page_id, grid, 'table', id FROM named_tables UNION ALL SELECT page_id, grid, 'math', 'math_' || n FROM scan WHERE counts AND equation)
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS seq, kind, id FROM found""")
def a05_order(spark, sf):
    return _frame(spark, sf, "order")


def _escaped(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query("a23_html_of_model", f"""WITH {SCAN}, cell_html AS (SELECT page_id, grid, r, c, head, CASE WHEN head THEN '<th scope="col">' || {_escaped('text')} || '</th>' ELSE '<td>' || {_escaped('text')} || '</td>' END AS h FROM cells),
  row_html AS (SELECT page_id, grid, r, bool_and(head) AS head, '<tr>' || string_agg(h, '' ORDER BY c) || '</tr>' AS h FROM cell_html GROUP BY ALL),
  parts_html AS (SELECT page_id, place, CASE WHEN heading_level IS NOT NULL THEN '<h' || heading_level || '>' || {_escaped('text')} || '</h' || heading_level || '>' WHEN text LIKE '<pre class="algorithm">%' THEN text ELSE '<p>' || {_escaped('text')} || '</p>' END AS h FROM paragraphs
    UNION ALL SELECT page_id, grid, '<table>' || coalesce('<thead>' || string_agg(h, '' ORDER BY r) FILTER (head) || '</thead>', '') || coalesce('<tbody>' || string_agg(h, '' ORDER BY r) FILTER (NOT head) || '</tbody>', '') || '</table>' FROM row_html GROUP BY page_id, grid
    UNION ALL SELECT page_id, pos, '<img alt="' || regexp_extract(tok, 'alt="([^"]*)"', 1) || '" src="' || regexp_extract(tok, 'src="([^"]*)"', 1) || '">' FROM scan WHERE tag = 'img' AND kind = 'open'
    UNION ALL SELECT page_id, pos, '<div role="math">' || regexp_extract(tok, 'alttext="([^"]*)"', 1) || '</div>' FROM scan WHERE counts AND equation),
  bodies AS (SELECT page_id, string_agg(h, '' ORDER BY place) AS h FROM parts_html GROUP BY 1)
  SELECT page_id, '<!DOCTYPE html><html lang="' || regexp_extract(html, '<html lang="([^"]*)"', 1) || '"><head><title>' || {_escaped(q.STRIP.format(_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")))} || '</title></head><body>' || coalesce(h, '') || '</body></html>' AS html FROM rich LEFT JOIN bodies USING (page_id)""")
def a23_model(spark, sf):
    pages = s.rich_pages(spark, sf)
    scan = written(html.nested(html.tokens(pages)), "parquet")
    return html.render(pages, dealt_out(scan, "page_id", of=pages, size=F.length("html"), most=html.HTML_PER_TASK))
