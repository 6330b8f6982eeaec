"""Queries of ordered scans, tables, boxes, fonts and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import colour, text
from plumbline.operators import checks, structure
from plumbline.queries.scalar import LIST_TYPE, REPAIR, SEVERITY, alt_sql, quoted
from plumbline.registry import ORACLES, query
from plumbline.sources import tables as s
from plumbline.sources import twins as q


@query("f01_heading_hierarchy", f"""WITH {q.FAULTY_LINES}, h AS (SELECT doc_id, pos, heading_level AS l, lag(heading_level) OVER w AS last, row_number() OVER w AS n,
  sum(CASE WHEN heading_level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS h1s, sum(CASE WHEN heading_level = 1 THEN 1 ELSE 0 END) OVER w AS nth FROM faulty WHERE heading_level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, pos, 'no_h1' AS issue, 1 AS suggested FROM h WHERE n = 1 AND h1s = 0 UNION ALL SELECT doc_id, pos, 'multiple_h1', 2 FROM h WHERE l = 1 AND nth > 1 UNION ALL SELECT doc_id, pos, 'skipped_level', last + 1 FROM h WHERE l > last + 1""")
def f01(spark, sf):
    return structure.heading_issues(s.faulty_lines(spark, sf))


@query("f02_fake_lists", f"""WITH {q.FAULTY_LINES}, k AS (SELECT doc_id, pos, CASE WHEN heading_level IS NULL THEN {LIST_TYPE} END AS t FROM faulty), g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS island FROM k)
  SELECT doc_id, t AS list_type, min(pos) AS first, max(pos) AS last, count(*) AS items, round(least(0.5 + count(*) * 0.1, 1.0), 3)::DOUBLE AS confidence FROM g WHERE t IS NOT NULL GROUP BY doc_id, t, island HAVING count(*) >= 2""")
def f02(spark, sf):
    return structure.fake_lists(s.faulty_lines(spark, sf))


def scored(spark, sf):
    return s.lines(spark, sf).select("doc_id", "pos", ((F.col("doc_id") * 7 + F.floor(F.col("pos") / 6) * 5 + (F.col("pos") % 11 == 3).cast("int") * 4) % 10 / 10.0).alias("score"))


@query("f06_cluster_penalty", f"""WITH {q.LINES}, v AS (SELECT doc_id, pos, (doc_id * 7 + pos // 6 * 5 + CASE WHEN pos % 11 = 3 THEN 4 ELSE 0 END) % 10 / 10.0::DOUBLE AS score FROM lines),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, score >= 0.5 ORDER BY pos) AS island FROM v)
  SELECT doc_id, pos, CASE WHEN score >= 0.5 AND count(*) OVER (PARTITION BY doc_id, score >= 0.5, island) >= 5 THEN round(greatest(score - 0.15, 0), 3) ELSE score END AS score FROM g""")
def f06(spark, sf):
    return structure.cluster_penalty(scored(spark, sf)).select("doc_id", "pos", "score")


@query("c01_heading_candidates", f"WITH {q.LINES} SELECT doc_id, pos, score FROM (SELECT doc_id, pos, (doc_id * 7 + pos // 6 * 5 + CASE WHEN pos % 11 = 3 THEN 4 ELSE 0 END) % 10 / 10.0::DOUBLE AS score FROM lines) WHERE score >= 0.5")
def c01(spark, sf):
    return scored(spark, sf).where("score >= 0.5").sort(F.desc("score"), "doc_id", "pos")


def styled(spark, sf):
    pos, k = F.col("pos"), F.col("doc_id") + F.col("pos")
    font = F.when(k % 6 == 0, "Arial-Bold").when(k % 6 == 1, "ABCDEF+Century").otherwise("TimesNewRomanPSMT")
    return s.faulty_lines(spark, sf).select("doc_id", "pos", "text", (k % 4 == 0).alias("bold"), F.when(pos % 5 == 0, 16.0).when(pos % 7 == 0, 9.0).otherwise(11.0).alias("size"), font.alias("font"))


def score_sql(weights: dict[str, float]) -> str:
    return f"""WITH {q.FAULTY_LINES}, p AS (SELECT doc_id, pos, text, (doc_id + pos) % 4 = 0 AS bold, CASE WHEN pos % 5 = 0 THEN 16.0 WHEN pos % 7 = 0 THEN 9.0 ELSE 11.0 END::DOUBLE AS size,
    CASE (doc_id + pos) % 6 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Century' ELSE 'TimesNewRomanPS' END AS base FROM faulty),
  f AS (SELECT doc_id, base, sum(length(text)) AS n, min(pos) AS first FROM p GROUP BY ALL), d AS (SELECT doc_id, base AS dominant FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
  m AS (SELECT doc_id, quantile_cont(size, 0.5) AS median FROM p GROUP BY doc_id), x AS (SELECT *, lead(bold) OVER (PARTITION BY doc_id ORDER BY pos) AS next_bold FROM p)
  SELECT doc_id, pos, CASE WHEN bold OR size >= median + 2 OR base <> dominant THEN round(CASE WHEN cited THEN greatest(raw - 0.30, 0) ELSE raw END, 3) END AS score FROM (
  SELECT x.doc_id, pos, bold, size, median, base, dominant, regexp_matches(text, '\\(\\d{{4}}\\)') OR length(text) - length(replace(text, ',', '')) >= 3 AS cited,
  ({weights['bold']} * bold::INT + {weights['size']} * (size >= median + 2)::INT + {weights['short']} * ({q.N_WORDS.format('text')} < 10)::INT + {weights['followed']} * coalesce(NOT next_bold, false)::INT + {weights['always']} + {weights['font']} * (base <> dominant)::INT)::DOUBLE AS raw
  FROM x JOIN d USING (doc_id) JOIN m USING (doc_id))"""


#: The weights of a disguised heading's signs, in pages and in office files.
PAGE_WEIGHTS = {"bold": 0.25, "size": 0.20, "short": 0.20, "followed": 0.10, "always": 0.10, "font": 0.15}
OFFICE_WEIGHTS = {"bold": 0.30, "size": 0.25, "short": 0.20, "followed": 0.15, "always": 0.10, "font": 0.0}


@query("f03_heading_score_pages", score_sql(PAGE_WEIGHTS))
def f03(spark, sf):
    return structure.fake_heading_scores(styled(spark, sf), PAGE_WEIGHTS)


@query("f04_heading_score_office", score_sql(OFFICE_WEIGHTS).replace("SELECT doc_id, pos, CASE WHEN bold OR size >= median + 2 OR base <> dominant THEN", "SELECT doc_id, pos, CASE WHEN bold THEN").replace("CASE WHEN cited THEN greatest(raw - 0.30, 0) ELSE raw END", "raw"))
def f04(spark, sf):
    return structure.fake_heading_scores(styled(spark, sf), OFFICE_WEIGHTS, citations=False, bold_only=True)


@query("b18_suggest_level", f"""WITH {q.FAULTY_LINES} SELECT doc_id, pos, CASE WHEN last IS NULL THEN 1 WHEN size >= 20 THEN greatest(1, last) ELSE least(last + 1, 6) END AS level FROM (SELECT doc_id, pos, 10 + pos % 14 AS size, heading_level,
  last_value(heading_level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM faulty) WHERE heading_level IS NULL""")
def b18(spark, sf):
    w = structure.along("pos").rowsBetween(Window.unboundedPreceding, -1)
    p = s.faulty_lines(spark, sf).withColumn("last", F.last("heading_level", ignorenulls=True).over(w)).where("heading_level is null")
    last, size = F.col("last"), 10 + F.col("pos") % 14
    return p.select("doc_id", "pos", F.when(last.isNull(), 1).when(size >= 20, F.greatest(F.lit(1), last)).otherwise(F.least(last + 1, F.lit(6))).alias("level"))


@query("h01_paragraph_dedup", f"""WITH {q.LINES}, n AS (SELECT doc_id, pos, length(trim(text)) <= 50 AS short, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS f FROM lines)
  SELECT doc_id, pos FROM n QUALIFY short OR row_number() OVER (PARTITION BY doc_id, short, CASE WHEN length(f) >= 60 THEN substr(f, 1, 60) ELSE f END ORDER BY pos) = 1""")
def h01(spark, sf):
    return structure.duplicates(s.lines(spark, sf))


@query("h03_unique_documents", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def h03(spark, sf):
    return s.table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


CAPTION = "regexp_matches(trim(text), '^(?:TABLE|Table|table)\\s+(?:\\d+|[IVXLC]+)\\b[\\s.:]*')"


@query("f12_table_captions", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, trim(text) AS caption FROM faulty WHERE {CAPTION}")
def f12(spark, sf):
    t = text.strip(F.col("text"))
    return s.faulty_lines(spark, sf).where(t.rlike(text.CAPTION)).select("doc_id", "pos", t.alias("caption"))


@query("f11_table_spans", f"""WITH {q.FAULTY_LINES}, p AS (SELECT doc_id, pos, {CAPTION} AS c, heading_level IS NOT NULL OR length(trim(text)) > 200 OR (regexp_matches(trim(text), '^.{{10,}}\\.\\s*$') AND {q.N_WORDS.format('text')} >= 2) AS s FROM faulty),
  k AS (SELECT *, max(CASE WHEN c THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS caption FROM p)
  SELECT doc_id, caption, pos FROM k WHERE NOT c AND caption IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k j WHERE j.doc_id = k.doc_id AND j.pos > k.caption AND j.pos <= k.pos AND j.s)""")
def f11(spark, sf):
    return structure.table_spans(s.faulty_lines(spark, sf))


@query("a36_page_furniture", "SELECT doc_id, text, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS text FROM documents) WHERE text <> '' AND length(text) <= 50 GROUP BY ALL HAVING count(*) >= 2")
def a36(spark, sf):
    t = text.strip(F.col("text"))
    return s.lines(spark, sf).select("doc_id", t.alias("text")).where("text <> '' and length(text) <= 50").groupBy("doc_id", "text").agg(F.count("*").alias("n")).where("n >= 2")


@query("b24_is_furniture", f"""WITH {q.FAULTY_LINES}, t AS (SELECT doc_id, pos, trim(text) AS t FROM faulty), f AS (SELECT doc_id, t FROM t WHERE t <> '' AND length(t) <= 50 GROUP BY ALL HAVING count(*) >= 2)
  SELECT doc_id, pos, t = '' OR regexp_matches(t, '(?i)^[\\s\\-\\x{{2013}}\\x{{2014}}.]*(?:\\d{{1,4}}|[ivxlcdm]{{1,8}})[\\s\\-\\x{{2013}}\\x{{2014}}.]*$') OR (doc_id, t) IN (SELECT (doc_id, t) FROM f) AS furniture FROM t""")
def b24(spark, sf):
    p = s.faulty_lines(spark, sf).select("doc_id", "pos", text.strip(F.col("text")).alias("t"))
    known = p.where("t <> '' and length(t) <= 50").groupBy("doc_id", "t").count().where("count >= 2").select("doc_id", "t", F.lit(True).alias("known"))
    return p.join(known, ["doc_id", "t"], "left").select("doc_id", "pos", (text.is_page_number(F.col("t")) | F.coalesce("known", F.lit(False))).alias("furniture"))


@query("c02_data_tables", f"""WITH {q.CELLS}, w AS (SELECT table_id, max(r) + 1 AS rows_, max(c) + 1 AS cols, count(*) AS n, count(*) FILTER (trim(text) = '') AS empty, sum(length(trim(text))) AS chars, count(*) FILTER (r = 0 AND trim(text) <> '') AS top, max(CASE WHEN r = 0 THEN length(trim(text)) END) AS longest FROM cells GROUP BY 1),
  k AS (SELECT table_id, c, sum(length(trim(text))) AS n, count(*) FILTER (trim(text) <> '') AS filled FROM cells GROUP BY ALL), m AS (SELECT table_id, max(n) AS most, min(CASE WHEN filled >= 3 AND n / filled > 120 THEN c END) AS prose FROM k GROUP BY 1)
  SELECT table_id, CASE WHEN cols <= 1 THEN 'single-column table' WHEN rows_ <= 1 THEN 'single-row table' WHEN rows_ <= 2 AND cols <= 2 THEN 'very small table (<=2x2)' WHEN empty > 0.6 * n THEN 'over 60% empty cells'
    WHEN NOT (top >= 2 AND longest < 50) AND most > 0.85 * chars THEN 'single column dominates text (likely list)' WHEN NOT (top >= 2 AND longest < 50) AND prose IS NOT NULL THEN 'column ' || prose || ' has very long text (likely prose/references)' ELSE '' END AS reason FROM w JOIN m USING (table_id)""")
def c02(spark, sf):
    return structure.data_tables(s.cells(spark, sf))


@query("e09_table_findings", f"WITH {q.CELLS} SELECT table_id, max(header_rows) > 0 AS has_header, bool_or(span > 1) AS complex, (max(header_rows) = 0)::INT + bool_or(span > 1)::INT AS issues FROM cells GROUP BY 1")
def e09(spark, sf):
    g = s.cells(spark, sf).groupBy("table_id").agg((F.max("header_rows") > 0).alias("has_header"), F.bool_or(F.col("span") > 1).alias("complex"))
    return g.select("table_id", "has_header", "complex", ((~F.col("has_header")).cast("int") + F.col("complex").cast("int")).alias("issues"))


@query("a26_render_table", f"""WITH {q.CELLS} SELECT table_id, '<table>' || string_agg(row_html, '' ORDER BY r) || '</table>' AS html FROM (SELECT table_id, r, '<tr>' || string_agg(CASE WHEN r < header_rows THEN '<th scope="col"' ELSE '<td' END || CASE WHEN span > 1 THEN ' colspan="' || span || '"' ELSE '' END || '>' || text || CASE WHEN r < header_rows THEN '</th>' ELSE '</td>' END, '' ORDER BY c) || '</tr>' AS row_html FROM cells GROUP BY ALL) GROUP BY 1""")
def a26(spark, sf):
    head = F.col("r") < F.col("header_rows")
    cell = F.concat(F.when(head, '<th scope="col"').otherwise("<td"), F.when(F.col("span") > 1, F.concat(F.lit(' colspan="'), F.col("span").cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), text.escape_html(F.col("text")), F.when(head, "</th>").otherwise("</td>"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["h"]), "")
    rows = s.cells(spark, sf).groupBy("table_id", "r").agg(F.concat(F.lit("<tr>"), joined(F.struct("c", cell.alias("h"))), F.lit("</tr>")).alias("h"))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table>"), joined(F.struct("r", "h")), F.lit("</table>")).alias("html"))


@query("a07_pipe_tables", "SELECT o_orderkey AS table_id, 1 + o_orderkey % 3 AS header_rows, 1 + o_orderkey % 2 AS body_rows, 2::INT AS cols FROM orders")
def a07(spark, sf):
    k = F.col("o_orderkey")
    row = lambda a, n: F.repeat(F.lit(f"| {a} | b |\n"), n.cast("int"))
    md = F.concat(row("h", 1 + k % 3), F.lit("|---|:--:|\n"), row("x", 1 + k % 2))
    lines = F.filter(F.split(md, "\n"), lambda x: x != "")
    is_rule = lambda x: x.rlike(r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")
    split = F.array_position(F.transform(lines, is_rule), True).cast("int")
    cols = F.size(F.split(F.regexp_replace(lines[0], r"^\||\|$", ""), r"\|"))
    return s.table(spark, sf, "orders").where(split > 1).select(k.alias("table_id"), (split - 1).cast("long").alias("header_rows"), (F.size(lines) - split).cast("long").alias("body_rows"), cols.alias("cols"))


@query("a08_stitch_pages", f"WITH {q.BOXES} SELECT doc_id, page, pos, 'p_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1) AS id FROM boxes WHERE n_chars > 0")
def a08(spark, sf):
    n = F.row_number().over(structure.along("page", "pos")) - 1
    return s.boxes(spark, sf).where("n_chars > 0").select("doc_id", "page", "pos", F.concat(F.lit("p_"), n.cast("string")).alias("id"))


@query("a09_stitch_by_kind", f"WITH {q.BOXES} SELECT doc_id, page, pos, 'ocr_' || k || '_' || (row_number() OVER (PARTITION BY doc_id, k ORDER BY page, pos) - 1) AS id FROM (SELECT *, CASE n_chars % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'tbl' ELSE 'img' END AS k FROM boxes)")
def a09(spark, sf):
    k = F.col("n_chars") % 3
    b = s.boxes(spark, sf).withColumn("k", F.when(k == 0, "p").when(k == 1, "tbl").otherwise("img"))
    n = F.row_number().over(structure.along("page", "pos", by=("doc_id", "k"))) - 1
    return b.select("doc_id", "page", "pos", F.concat(F.lit("ocr_"), F.col("k"), F.lit("_"), n.cast("string")).alias("id"))


@query("a10_words_to_blocks", """SELECT doc_id, block, string_agg(w, ' ' ORDER BY i) AS text, min(x0) AS x0, max(x1) AS x1, count(*) AS words FROM (SELECT doc_id, i // 8 AS block, i, w, 10 + i * 7 % 300 AS x0, 10 + i * 7 % 300 + length(w) AS x1, (doc_id + i) * 13 % 100 AS conf
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents)) WHERE conf >= 20 GROUP BY ALL HAVING length(string_agg(w, ' ' ORDER BY i)) >= 3""")
def a10(spark, sf):
    w = s.dealt_documents(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    x0 = 10 + F.col("i") * 7 % 300
    w = w.where((F.col("doc_id") + F.col("i")) * 13 % 100 >= 20).select("doc_id", F.floor(F.col("i") / 8).alias("block"), "i", "w", x0.alias("x0"), (x0 + F.length("w")).alias("x1"))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ")
    g = w.groupBy("doc_id", "block").agg(words.alias("text"), F.min("x0").cast("long").alias("x0"), F.max("x1").cast("long").alias("x1"), F.count("*").alias("words"))
    return g.where("length(text) >= 3")


@query("c03_text_in_tables", f"""WITH {q.BOXES}, t AS (SELECT doc_id, page, x0 - 20 AS x0, y0 - 5 AS y0, x1 AS x1, y1 + 40 AS y1 FROM boxes WHERE n_chars % 9 = 4)
  SELECT b.doc_id, b.page, b.pos FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page = b.page AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def c03(spark, sf):
    b = s.boxes(spark, sf)
    t = b.where("n_chars % 9 = 4").select("doc_id", "page", (F.col("x0") - 20).alias("a0"), (F.col("y0") - 5).alias("b0"), F.col("x1").alias("a1"), (F.col("y1") + 40).alias("b1"))
    side = lambda lo, hi, lo2, hi2: F.greatest(F.lit(0), F.least(F.col(hi), F.col(hi2)) - F.greatest(F.col(lo), F.col(lo2)))
    area = side("x0", "x1", "a0", "a1") * side("y0", "y1", "b0", "b1")
    inside = area > 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cond = (b["doc_id"] == t["doc_id"]) & (b["page"] == t["page"]) & inside
    return b.join(t, cond, "left_anti").select("doc_id", "page", "pos")


@query("c04_scanned_pages", f"WITH {q.BOXES} SELECT doc_id, page FROM boxes GROUP BY ALL HAVING sum(n_chars) < 100 AND max(CASE WHEN n_chars % 3 = 0 THEN (x1 - x0) * 4000 ELSE 0 END) > 0.8 * 612 * 792 OR (sum(n_chars) < 20 AND bool_or(n_chars % 3 = 0))")
def c04(spark, sf):
    image = F.col("n_chars") % 3 == 0
    area = F.when(image, (F.col("x1") - F.col("x0")) * 4000).otherwise(0)
    g = s.boxes(spark, sf).groupBy("doc_id", "page").agg(F.sum("n_chars").alias("n"), F.max(area).alias("area"), F.bool_or(image).alias("image"))
    return g.where((F.col("image") & (F.col("n") < 20)) | ((F.col("n") < 100) & (F.col("area") > 0.8 * 612 * 792))).select("doc_id", "page")


@query("f07_interleaved", f"""WITH {q.BOXES}, c AS (SELECT *, (x0 + x1) / 2 < 306 * 0.85 AS l FROM boxes), k AS (SELECT *, l <> lag(l) OVER (PARTITION BY doc_id, page ORDER BY pos) AS sw FROM c)
  SELECT doc_id, page, count(*) >= 4 AND sum(l::INT) >= 2 AND sum((NOT l)::INT) >= 2 AND sum(coalesce(sw, false)::INT) > 3 AS interleaved FROM k GROUP BY ALL""")
def f07(spark, sf):
    return structure.interleaved(s.boxes(spark, sf))


DISPLACED = f"""{q.BOXES}, r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS s, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 15, 0), x0, pos) AS v FROM boxes WHERE n_chars > 10 AND page < 5),
  d AS (SELECT doc_id, round(avg(d), 6) AS displacement FROM (SELECT doc_id, page, sum(abs(s - v)) / greatest(count(*) * count(*) / 2, 1) AS d FROM r GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1)"""
JUMPS = """j AS (SELECT doc_id, page, sum(coalesce(up, false)::INT)::BIGINT AS jumps, count(*) - 1 AS steps FROM (SELECT doc_id, page, y0 < lag(y0) OVER (PARTITION BY doc_id, page ORDER BY pos) - 20 AS up FROM boxes WHERE NOT ((y0 < 80 OR y0 > 680) AND n_chars < 80)) GROUP BY ALL HAVING count(*) >= 3)"""


@query("f08_displacement", f"WITH {DISPLACED} SELECT * FROM d")
def f08(spark, sf):
    return structure.displacement(s.boxes(spark, sf))


@query("f09_page_jumps", f"WITH {q.BOXES}, {JUMPS} SELECT doc_id, page, jumps, steps FROM j")
def f09(spark, sf):
    return structure.page_jumps(s.boxes(spark, sf))


@query("i05_reading_order", f"WITH {DISPLACED}, {JUMPS} SELECT doc_id, CASE WHEN displacement >= 0.7 THEN 'failed' WHEN bad >= 0.4 THEN 'failed' WHEN bad >= 0.15 THEN 'cannot_tell' ELSE 'passed' END AS label FROM (SELECT doc_id, avg((jumps > 0.25 * steps)::INT) AS bad FROM j GROUP BY 1) LEFT JOIN d USING (doc_id)")
def i05(spark, sf):
    b = s.boxes(spark, sf)
    pages = structure.page_jumps(b).groupBy("doc_id").agg(F.avg((F.col("jumps") > 0.25 * F.col("steps")).cast("int")).alias("bad"))
    bad = F.col("bad")
    label = F.when(F.col("displacement") >= 0.7, "failed").when(bad >= 0.4, "failed").when(bad >= 0.15, "cannot_tell").otherwise("passed")
    return pages.join(structure.displacement(b), "doc_id", "left").select("doc_id", label.alias("label"))


@query("e38_repeated_edges", f"WITH {q.BOXES} SELECT doc_id, n_chars FROM boxes WHERE y0 < 80 OR y0 > 680 GROUP BY ALL HAVING count(DISTINCT page) >= 2")
def e38(spark, sf):
    return s.boxes(spark, sf).where("y0 < 80 or y0 > 680").groupBy("doc_id", "n_chars").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").select("doc_id", "n_chars")


@query("e20_dominant_font", f"WITH {q.RUNS}, f AS (SELECT doc_id, {q.BASE_FONT.format('font')} AS font, sum(n_chars) AS n, min(pos) AS first FROM runs GROUP BY ALL) SELECT doc_id, font FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1")
def e20(spark, sf):
    f = s.runs(spark, sf).select("doc_id", text.base_font(F.col("font")).alias("font"), "n_chars", "pos").groupBy("doc_id", "font").agg(F.sum("n_chars").alias("n"), F.min("pos").alias("first"))
    return f.groupBy("doc_id").agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))


STATS = f"""{q.RUNS}, f AS (SELECT doc_id, regexp_replace(font, '^[^+]{{6}}\\+', '') AS font, sum(n_chars)::BIGINT AS chars, min(pos) AS first, list(round(size, 1) ORDER BY size) AS s FROM runs GROUP BY ALL),
  top AS (SELECT doc_id, font, chars, s, len(s) AS n FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1),
  stats AS (SELECT doc_id, font, chars, n, s[1] AS least, s[n // 4 + 1] AS p25, s[n // 2 + 1] AS median, s[3 * n // 4 + 1] AS p75, s[n] AS most, round(len(list_filter(s, lambda v: v < 8)) / n, 6) AS below_8, round(len(list_filter(s, lambda v: v < 8.5)) / n, 6) AS below_85, round(len(list_filter(s, lambda v: v < 9)) / n, 6) AS below_9 FROM top)"""


@query("e21_font_stats", f"WITH {STATS} SELECT doc_id, font, chars, n::INT AS n, least, p25, median, p75, most, below_8, below_85, below_9 FROM stats")
def e21(spark, sf):
    return structure.size_stats(s.runs(spark, sf))


@query("e25_tiny_runs", f"WITH {q.RUNS} SELECT doc_id, count(*) AS n FROM runs WHERE round(size, 1) < 6 AND n_chars >= 3 GROUP BY 1")
def e25(spark, sf):
    return s.runs(spark, sf).where((F.round("size", 1) < 6) & (F.col("n_chars") >= 3)).groupBy("doc_id").agg(F.count("*").alias("n"))


LABEL = "CASE WHEN least < 6 AND p75 >= 9 AND tiny < 5 THEN 'cannot_tell' WHEN tiny >= 1 AND below_85 < 0.15 AND median >= 9 THEN 'cannot_tell' WHEN median < 8.5 OR below_85 >= 0.25 THEN 'failed' WHEN least >= 8.7 AND median >= 9 THEN 'passed' ELSE 'cannot_tell' END"


@query("i03_fonts_label", f"WITH {STATS}, t AS (SELECT doc_id, count(*) FILTER (round(size, 1) < 6 AND n_chars >= 3) AS tiny FROM runs GROUP BY 1) SELECT doc_id, {LABEL} AS label FROM stats JOIN t USING (doc_id)")
def i03(spark, sf):
    r = s.runs(spark, sf)
    tiny = r.groupBy("doc_id").agg(F.sum(((F.round("size", 1) < 6) & (F.col("n_chars") >= 3)).cast("int")).alias("tiny"))
    c = F.col
    label = (
        F.when((c("least") < 6) & (c("p75") >= 9) & (c("tiny") < 5), "cannot_tell")
        .when((c("tiny") >= 1) & (c("below_85") < 0.15) & (c("median") >= 9), "cannot_tell")
        .when((c("median") < 8.5) | (c("below_85") >= 0.25), "failed")
        .when((c("least") >= 8.7) & (c("median") >= 9), "passed")
        .otherwise("cannot_tell")
    )
    return structure.size_stats(r).join(tiny, "doc_id").select("doc_id", label.alias("label"))


@query("f13_paragraph_split", f"""WITH {q.RUNS}, c AS (SELECT doc_id, pos, (bold <> lag(bold) OVER w OR abs(size - lag(size) OVER w) > 1.5 OR {q.BASE_FONT.format('font')} <> lag({q.BASE_FONT.format('font')}) OVER w) AS cut FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, pos, (sum(coalesce(cut, false)::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS part FROM c""")
def f13(spark, sf):
    w = structure.along("pos")
    r = s.runs(spark, sf).withColumn("base", text.base_font(F.col("font")))
    cut = (F.col("bold") != F.lag("bold").over(w)) | (F.abs(F.col("size") - F.lag("size").over(w)) > 1.5) | (F.col("base") != F.lag("base").over(w))
    return r.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).select("doc_id", "pos", structure.before(F.col("cut"), w).alias("part"))


@query("f14_primary_font", f"WITH {q.RUNS} SELECT doc_id, pos // 5 AS line, font, size FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, pos // 5 ORDER BY n_chars DESC, pos) = 1")
def f14(spark, sf):
    best = F.max_by(F.struct("font", "size"), F.struct("n_chars", -F.col("pos"))).alias("x")
    return s.runs(spark, sf).groupBy("doc_id", F.floor(F.col("pos") / 5).alias("line")).agg(best).select("doc_id", "line", "x.font", "x.size")


@query("g07_font_ranks", f"WITH {q.RUNS} SELECT DISTINCT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS rank FROM runs")
def g07(spark, sf):
    sizes = s.runs(spark, sf).select("doc_id", "size").distinct()
    return sizes.select("doc_id", "size", F.row_number().over(structure.along(F.desc("size"))).alias("rank"))


@query("c10_auto_headings", f"WITH {q.RUNS} SELECT doc_id, pos, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 3)::INT AS level FROM runs WHERE bold AND n_chars < 60")
def c10(spark, sf):
    return s.runs(spark, sf).where("bold and n_chars < 60").select("doc_id", "pos", F.least(F.dense_rank().over(structure.along(F.desc("size"))), F.lit(3)).alias("level"))


@query("f15_untagged_runs", "WITH t AS (SELECT event_id // 100 AS page, event_id AS i, CASE event_id % 7 WHEN 1 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS d FROM events), x AS (SELECT *, sum(d) OVER (PARTITION BY page ORDER BY i) AS depth FROM t), g AS (SELECT *, i - row_number() OVER (PARTITION BY page ORDER BY i) AS island FROM x WHERE depth = 0 AND d = 0) SELECT page, min(i) AS first, max(i) AS last FROM g GROUP BY page, island")
def f15(spark, sf):
    k = F.col("event_id")
    d = F.when(k % 7 == 1, 1).when(k % 7 == 4, -1).otherwise(0)
    w = structure.along("i", by=("page",))
    t = s.table(spark, sf, "events").select(F.floor(k / 100).alias("page"), k.alias("i"), d.alias("d")).withColumn("depth", structure.before(F.col("d"), w)).where("depth = 0 and d = 0")
    t = t.withColumn("island", F.col("i") - F.row_number().over(w))
    return t.groupBy("page", "island").agg(F.min("i").alias("first"), F.max("i").alias("last")).select("page", "first", "last")


@query("f16_max_mcid", "SELECT event_id // 100 AS page, max(event_id * 37 % 101) AS mcid FROM events GROUP BY 1")
def f16(spark, sf):
    k = F.col("event_id")
    token = F.concat(F.lit("/P <</MCID "), (k * 37 % 101).cast("string"), F.lit(">> BDC"))
    return s.table(spark, sf, "events").groupBy(F.floor(k / 100).alias("page")).agg(F.max(F.regexp_extract(token, r"/MCID (\d+)", 1).cast("long")).alias("mcid"))


ISSUES = f"""{q.FAULTY_ANCHORS}, {REPAIR}, own AS (SELECT page_id, pos, url, fixed, lower(trim(text)) AS low, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN regexp_matches(trim(text), '(?i)^(https?://|www\\.|ftp://|mailto:)') THEN 'bare_url' WHEN rtrim(lower(trim(text)), '.') IN ({quoted(text.VAGUE)}) THEN 'vague_text' END AS issue FROM repaired),
  multi AS (SELECT page_id, low FROM own WHERE issue IS NULL GROUP BY ALL HAVING count(DISTINCT url) > 1),
  issues AS (SELECT page_id, pos, 'broken_uri' AS issue FROM own WHERE fixed IS NOT NULL UNION ALL SELECT page_id, pos, issue FROM own WHERE issue IS NOT NULL UNION ALL SELECT page_id, pos, 'same_text_different_url' FROM own JOIN multi USING (page_id, low) WHERE issue IS NULL)"""


@query("e10_link_findings", f"WITH {ISSUES} SELECT * FROM issues")
def e10(spark, sf):
    return checks.link_issues(s.faulty_anchors(spark, sf))


@query("e06_link_check", f"WITH {ISSUES}, n AS (SELECT page_id, count(*) AS items FROM anchors GROUP BY 1), b AS (SELECT page_id, count(*) AS issues FROM issues GROUP BY 1) SELECT page_id, items, coalesce(issues, 0) AS issues, CASE WHEN coalesce(issues, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM n LEFT JOIN b USING (page_id)")
def e06(spark, sf):
    links = s.faulty_anchors(spark, sf)
    bad = checks.link_issues(links).groupBy("page_id").agg(F.count("*").alias("issues"))
    n = links.groupBy("page_id").agg(F.count("*").alias("items")).join(bad, "page_id", "left")
    return n.select("page_id", "items", F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.col("issues") > 0, "fail").otherwise("pass").alias("status"))


@query("e03_alt_check", f"""WITH {q.ALTS}, {alt_sql(text.AUTO_CAPTIONS)}, k AS (SELECT doc_id, CASE WHEN decorative THEN 'skipped' WHEN trim(alt) = '' THEN 'bad' ELSE quality END AS g FROM graded)
  SELECT doc_id, CASE WHEN count(*) FILTER (g = 'bad') > 0 THEN 'fail' WHEN count(*) FILTER (g = 'borderline') > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) AS items, count(*) FILTER (g IN ('bad', 'borderline')) AS issues FROM k GROUP BY 1""")
def e03(spark, sf):
    return checks.alt_check(s.alts(spark, sf))


@query("i01_alt_label", f"WITH {q.ALTS}, {alt_sql(('automatically generated',))} SELECT doc_id, CASE WHEN count(*) FILTER (trim(alt) <> '') = 0 THEN 'not_present' WHEN count(*) FILTER (trim(alt) <> '' AND quality = 'bad') > 0 THEN 'failed' WHEN count(*) FILTER (trim(alt) <> '' AND quality = 'good') >= 0.6 * count(*) FILTER (trim(alt) <> '') THEN 'passed' ELSE 'cannot_tell' END AS label FROM graded GROUP BY 1")
def i01(spark, sf):
    return checks.alt_label(s.alts(spark, sf))


@query("c05_images_to_caption", f"WITH {q.ALTS}, {alt_sql(text.AUTO_CAPTIONS)} SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 4 AS batch FROM graded WHERE NOT decorative AND quality <> 'good'")
def c05(spark, sf):
    i = s.alts(spark, sf).where(~F.col("decorative") & (text.alt_quality(F.col("alt")) != "good"))
    return i.select("doc_id", "pos", F.floor((F.row_number().over(structure.along("pos")) - 1) / 4).alias("batch"))


@query("e08_contrast_findings", f"WITH {q.RATED} SELECT doc_id, k, fg, bg, round(ratio, 2) AS ratio, required::DOUBLE AS required FROM rated WHERE ratio < required")
def e08(spark, sf):
    r, need = colour.ratio(F.col("fg"), F.col("bg")), colour.required(F.col("size"), F.col("bold"))
    return s.colours(spark, sf).where(r < need).select("doc_id", "k", "fg", "bg", F.round(r, 2).alias("ratio"), need.alias("required"))


CONTRAST = f"{q.RATED}, c AS (SELECT doc_id, count(*) AS items, count(*) FILTER (ratio < required) AS issues, count(*) FILTER (ratio < required AND yellow AND ratio < 1.5) AS severe FROM rated GROUP BY 1)"


@query("e05_contrast_check", f"WITH {CONTRAST} SELECT * FROM c")
def e05(spark, sf):
    return checks.contrast_check(s.colours(spark, sf))


@query("i02_contrast_label", f"WITH {CONTRAST} SELECT doc_id, CASE WHEN severe >= 1 THEN 'failed' WHEN issues < 0.01 * items THEN 'passed' WHEN issues >= 0.03 * items THEN 'failed' ELSE 'cannot_tell' END AS label FROM c")
def i02(spark, sf):
    return checks.contrast_check(s.colours(spark, sf)).select("doc_id", checks.contrast_label(F.col("items"), F.col("issues"), F.col("severe")).alias("label"))


@query("i09_yellow_on_white", f"WITH {q.RATED} SELECT doc_id, count(*) AS n FROM rated WHERE yellow AND ratio < 1.5 GROUP BY 1")
def i09(spark, sf):
    return checks.contrast_check(s.colours(spark, sf)).where("severe > 0").select("doc_id", F.col("severe").alias("n"))


CANDIDATES = ORACLES["f04_heading_score_office"].replace(q.FAULTY_LINES, q.OUTLINED).replace("(doc_id + pos) % 4 = 0 AS bold", "doc_id % 3 <> 1 AND (doc_id + pos) % 4 = 0 AS bold")
STRUCTURE = f"""h AS (SELECT doc_id, count(*) AS n, bool_or(issue IN ('no_h1', 'skipped_level')) AS errors FROM ({ORACLES["f01_heading_hierarchy"].replace(q.FAULTY_LINES, q.OUTLINED)}) GROUP BY 1),
  f AS (SELECT doc_id, count(*) AS n FROM ({CANDIDATES}) WHERE score >= 0.5 GROUP BY 1), p AS (WITH {q.LINES} SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
  t AS (WITH {q.CELLS}, x AS (SELECT any_value(table_id // 40) AS doc_id, table_id, CASE WHEN table_id // 40 % 2 = 0 THEN 0 ELSE (max(header_rows) = 0)::INT + bool_or(span > 1)::INT END AS issues, count(*) FILTER (r < header_rows OR r = 0 AND table_id // 40 % 2 = 0) AS th FROM cells GROUP BY table_id)
    SELECT doc_id, count(*) AS n, sum(issues) + CASE WHEN count(*) > 1 AND doc_id % 4 = 1 THEN count(*) FILTER (th = 0) ELSE 0 END AS issues FROM x GROUP BY 1),
  s AS (SELECT doc_id, CASE WHEN errors THEN 'fail' WHEN coalesce(h.n, 0) + coalesce(f.n, 0) + coalesce(t.issues, 0) > 0 THEN 'warn' ELSE 'pass' END AS status, (p.n + coalesce(t.n, 0))::BIGINT AS items, (coalesce(h.n, 0) + coalesce(f.n, 0) + coalesce(t.issues, 0))::BIGINT AS issues
    FROM p LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id))"""


@query("e04_structure_check", f"WITH {STRUCTURE} SELECT * FROM s")
def e04(spark, sf):
    return structure_of(s.outlined(spark, sf), s.document_tables(spark, sf))


def structure_of(paragraphs, cells):
    candidates = structure.fake_heading_scores(paragraphs, OFFICE_WEIGHTS, citations=False, bold_only=True).where("score >= 0.5")
    tables = cells.groupBy("doc_id", "table_id").agg(
        ((F.max("header_rows") == 0).cast("int") + F.bool_or(F.col("span") > 1).cast("int")).alias("issues"), F.sum((F.col("r") < F.col("header_rows")).cast("int")).alias("th")
    )
    return checks.structure_check(paragraphs, candidates, tables.withColumn("tagged", F.col("doc_id") % 4 == 1))


PAGE_CHECKS = f"""l AS (WITH {ISSUES} SELECT page_id, count(DISTINCT pos) AS items, (SELECT count(*) FROM issues i WHERE i.page_id = a.page_id) AS issues FROM anchors a GROUP BY 1), alt AS ({ORACLES["e03_alt_check"]}), con AS ({ORACLES["e05_contrast_check"]}), str AS ({ORACLES["e04_structure_check"]}),
  hd AS (SELECT page_id, regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1) AS h FROM pages),
  c AS (SELECT page_id, '2.4.2' AS criterion, CASE WHEN regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' THEN 'pass' ELSE 'fail' END AS status, 1 AS items FROM pages
  UNION ALL SELECT page_id, '3.1.1', CASE WHEN regexp_extract(html, '<html lang="([^"]*)"', 1) <> '' THEN 'pass' ELSE 'fail' END, 1 FROM pages
  UNION ALL SELECT page_id, '2.4.4', CASE WHEN items IS NULL THEN 'na' WHEN issues > 0 THEN 'fail' ELSE 'pass' END, coalesce(items, 0) FROM pages LEFT JOIN l USING (page_id)
  UNION ALL SELECT page_id, '2.4.6', CASE WHEN len(h) = 0 OR len(list_filter(h, lambda x: length(trim(x)) < 2)) > 0 THEN 'warn' ELSE 'pass' END, len(h) FROM hd
  UNION ALL SELECT page_id, '1.1.1', coalesce(status, 'na'), coalesce(items, 0) FROM pages LEFT JOIN alt ON doc_id = page_id
  UNION ALL SELECT page_id, '1.4.3', CASE WHEN items IS NULL THEN 'na' WHEN issues > 0 THEN 'fail' ELSE 'pass' END, coalesce(items, 0) FROM pages LEFT JOIN con ON doc_id = page_id
  UNION ALL SELECT page_id, '1.3.1', coalesce(status, 'pass'), coalesce(items, 0) FROM pages LEFT JOIN str ON doc_id = page_id)"""


def all_checks(spark, sf):
    """Only documents that have a page are looked at."""
    pages = s.table(spark, sf, "pages")
    named = pages.select(F.col("page_id").alias("doc_id"))
    own = lambda df: df.join(named, "doc_id", "left_semi")
    return checks.document_checks(pages, s.faulty_anchors(spark, sf), s.alts(spark, sf, named), own(s.colours(spark, sf)), structure_of(s.outlined(spark, sf, named), s.document_tables(spark, sf, named)))


@query("e07_page_checks", f"WITH {PAGE_CHECKS} SELECT page_id, criterion, status, items FROM c")
def e07(spark, sf):
    return all_checks(spark, sf).drop("issues")


@query("e02_validation_roll_up", f"""WITH {PAGE_CHECKS}, n AS (SELECT page_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'na') AS not_applicable FROM c GROUP BY 1)
  SELECT *, CASE WHEN failed > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status, concat_ws(', ', CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN warnings > 0 THEN warnings || ' warnings' END, CASE WHEN passed > 0 THEN passed || ' passed' END, CASE WHEN not_applicable > 0 THEN not_applicable || ' N/A' END) AS summary FROM n""")
def e02(spark, sf):
    return checks.roll_up(all_checks(spark, sf), "page_id")


@query("e26_uri_counts", f"WITH {q.FAULTY_ANCHORS} SELECT page_id, count(*) FILTER (url <> '') AS total, count(*) FILTER ({SEVERITY} = 'severe') AS severe FROM faulty_anchors GROUP BY 1")
def e26(spark, sf):
    return s.faulty_anchors(spark, sf).groupBy("page_id").agg(F.sum((F.col("url") != "").cast("int")).alias("total"), F.sum((text.uri_severity(F.col("url")) == "severe").cast("int")).alias("severe"))


@query("i04_links_label", f"WITH {q.FAULTY_ANCHORS}, n AS (SELECT page_id, count(*) AS total, count(*) FILTER ({SEVERITY} = 'severe') AS severe, CASE WHEN page_id % 3 = 0 THEN count(*) WHEN page_id % 3 = 1 THEN 0 ELSE count(*) // 2 END AS tagged FROM faulty_anchors GROUP BY 1) SELECT page_id, CASE WHEN tagged >= 0.8 * total THEN 'passed' WHEN tagged = 0 AND (severe >= 3 OR severe >= 0.1 * total) THEN 'failed' ELSE 'cannot_tell' END AS label FROM n")
def i04(spark, sf):
    n = s.faulty_anchors(spark, sf).groupBy("page_id").agg(F.count("*").alias("total"), F.sum((text.uri_severity(F.col("url")) == "severe").cast("int")).alias("severe"))
    k = F.col("page_id") % 3
    tagged = F.when(k == 0, F.col("total")).when(k == 1, 0).otherwise(F.floor(F.col("total") / 2))
    broken = (F.col("severe") >= 3) | (F.col("severe") >= 0.1 * F.col("total"))
    return n.select("page_id", F.when(tagged >= 0.8 * F.col("total"), "passed").when((tagged == 0) & broken, "failed").otherwise("cannot_tell").alias("label"))


TAGS = "SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages"


@query("e12_tag_counts", f"SELECT tag, tag IN ('p', 'h1', 'h2', 'li', 'table', 'a', 'img') AS standard, count(*) AS n FROM ({TAGS}) GROUP BY ALL")
def e12(spark, sf):
    t = s.table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n")).select("tag", F.col("tag").isin("p", "h1", "h2", "li", "table", "a", "img").alias("standard"), "n")


@query("g05_top_tags", f"SELECT tag, count(*) AS n FROM ({TAGS}) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def g05(spark, sf):
    t = s.table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n")).sort(F.desc("n"), "tag").limit(10)


@query("i06_tagging_label", f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not_present' WHEN count(*) < 3 THEN 'cannot_tell' WHEN count(*) FILTER (regexp_matches(tag, '^h[1-6]$') AND page_id % 3 <> 0) > 0 THEN 'passed' ELSE 'failed' END AS label FROM ({TAGS}) GROUP BY 1")
def i06(spark, sf):
    t = s.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    head = F.col("tag").rlike("^h[1-6]$") & (F.col("page_id") % 3 != 0)
    g = t.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(head.cast("int")).alias("h"))
    return g.select("page_id", F.when(F.col("page_id") % 5 == 0, "not_present").when(F.col("n") < 3, "cannot_tell").when(F.col("h") > 0, "passed").otherwise("failed").alias("label"))


@query("i07_table_label", f"WITH {q.CELLS}, t AS (SELECT table_id % 300 AS doc_id, table_id, count(*) FILTER (r < header_rows AND table_id % 3 <> 0) AS th FROM cells GROUP BY ALL), d AS (SELECT doc_id, count(*) AS tables, sum(th) AS th, min(th) AS least FROM t GROUP BY 1) SELECT doc_id, CASE WHEN th = 0 THEN 'failed' WHEN th >= 1.5 * tables AND least = 0 THEN 'cannot_tell' WHEN th >= 1.5 * tables THEN 'passed' ELSE 'cannot_tell' END AS label FROM d")
def i07(spark, sf):
    th = (F.col("r") < F.col("header_rows")) & (F.col("table_id") % 3 != 0)
    t = s.cells(spark, sf).groupBy((F.col("table_id") % 300).alias("doc_id"), "table_id").agg(F.sum(th.cast("int")).alias("th"))
    d = t.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum("th").alias("th"), F.min("th").alias("least"))
    enough = F.col("th") >= 1.5 * F.col("tables")
    return d.select("doc_id", F.when(F.col("th") == 0, "failed").when(enough & (F.col("least") == 0), "cannot_tell").when(enough, "passed").otherwise("cannot_tell").alias("label"))


@query("e13_th_per_table", f"WITH {q.CELLS} SELECT table_id, count(*) FILTER (r < header_rows) AS th FROM cells GROUP BY 1")
def e13(spark, sf):
    return s.cells(spark, sf).groupBy("table_id").agg(F.sum((F.col("r") < F.col("header_rows")).cast("int")).alias("th"))


@query("e01_document_stats", f"WITH {q.FAULTY_LINES} SELECT doc_id, count(*) AS paragraphs, count(heading_level) AS headings, count(*) FILTER ({LIST_TYPE} IS NOT NULL) AS list_items FROM faulty GROUP BY 1")
def e01(spark, sf):
    items = text.list_type(F.col("text")).isNotNull()
    return s.faulty_lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count("heading_level").alias("headings"), F.sum(items.cast("int")).alias("list_items"))


@query("a05_html_model", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, coalesce(nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), ''), 'en') AS lang, len(regexp_extract_all(html, '<h[1-6]>'))::INT AS headings, len(regexp_extract_all(html, '<a href='))::INT AS links FROM pages")
def a05(spark, sf):
    got = lambda p: F.regexp_extract("html", p, 1)
    lang = got('<html lang="([^"]*)"')
    return s.table(spark, sf, "pages").select("page_id", text.strip(got("<title>([^<]*)</title>")).alias("title"), F.when(lang == "", "en").otherwise(lang).alias("lang"), F.regexp_count("html", F.lit("<h[1-6]>")).alias("headings"), F.regexp_count("html", F.lit("<a href=")).alias("links"))


@query("h06_mcid_difference", "SELECT coalesce(a.page, b.page) AS page, coalesce(a.m, b.m) AS mcid, CASE WHEN b.m IS NULL THEN 'tree' ELSE 'content' END AS side FROM (SELECT DISTINCT event_id // 100 AS page, event_id * 7 % 50 AS m FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT event_id // 100 AS page, event_id * 7 % 50 AS m FROM events WHERE event_id % 5 <> 0 AND event_id % 2 = 0) b ON a.page = b.page AND a.m = b.m WHERE a.m IS NULL OR b.m IS NULL")
def h06(spark, sf):
    k = F.col("event_id")
    e = s.table(spark, sf, "events").select(k, F.floor(k / 100).alias("page"), (k * 7 % 50).alias("mcid"))
    a = e.where(k % 3 != 0).select("page", "mcid").distinct().withColumn("a", F.lit(True))
    b = e.where((k % 5 != 0) & (k % 2 == 0)).select("page", "mcid").distinct().withColumn("b", F.lit(True))
    return a.join(b, ["page", "mcid"], "full").where("a is null or b is null").select("page", "mcid", F.when(F.col("b").isNull(), "tree").otherwise("content").alias("side"))
