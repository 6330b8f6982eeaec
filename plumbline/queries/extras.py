"""Queries of sinks, renderers and the operators that SQL can't express or that write files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import latex, text
from plumbline.functions.repair import repaired
from plumbline.operators import checks, ledger, matching, structure
from plumbline.operators.spread import in_parts
from plumbline.plans import actions
from plumbline.queries.ledger import JUDGED, PLAN, J, judged, link_actions, page_plan
from plumbline.queries.scalar import LIST_TYPE
from plumbline.queries.structure import OFFICE_WEIGHTS, all_checks, styled
from plumbline.registry import ORACLES, query
from plumbline.sources import tables as s
from plumbline.sources import twins as q



def shared(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder in that format and read again."""
    path = shared(df.sparkSession, kind)
    df.write.format(kind).save(path)
    reader = df.sparkSession.read
    return reader.text(path) if kind == "text" else reader.schema(df.schema).format(kind).load(path)


@query("a15_structure_tree", "WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id % 50 > 0 THEN event_id - 1 - event_id % 3 * (event_id % 50 > 3)::INT END AS parent, event_id // 50 AS doc_id FROM events), w AS (SELECT id, doc_id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.doc_id, w.depth + 1 FROM t JOIN w ON t.parent = w.id) SELECT doc_id, count(*) AS elements, max(depth)::BIGINT AS depth FROM w GROUP BY 1")
def a15(spark, sf):
    k = F.col("event_id")
    tree = s.table(spark, sf, "events").select(k.alias("id"), F.when(k % 50 > 0, k - 1 - k % 3 * (k % 50 > 3).cast("int")).alias("parent"), F.floor(k / 50).alias("doc_id"))
    deep = structure.depths(tree, lambda df: written(df, "parquet"))
    return in_parts(deep, deep.count(), "doc_id").groupBy("doc_id").agg(F.count("*").alias("elements"), F.max("depth").alias("depth"))


@query("a20_table_copy", f"{J} SELECT id, user_id, status FROM jobs")
def a20(spark, sf):
    return written(s.jobs(spark, sf).select("id", "user_id", "status"), "parquet")


def pages_html(spark, sf):
    p = s.faulty_lines(spark, sf).where(text.strip(F.col("text")) != "")
    level, t = F.least("heading_level", F.lit(6)).cast("string"), text.escape_html(F.col("text"))
    html = F.when(F.col("heading_level").isNotNull(), F.concat(F.lit("<h"), level, F.lit(">"), t, F.lit("</h"), level, F.lit(">"))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", html.alias("h")))), lambda x: x["h"]), "")
    return p.groupBy("doc_id").agg(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def escaped_sql(c: str) -> str:
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{x}', '{y}')"
    return c


@query("a23_html_sink", f"""WITH {q.FAULTY_LINES} SELECT '<html><body>' || string_agg(CASE WHEN heading_level IS NULL THEN '<p>' || t || '</p>' ELSE '<h' || heading_level || '>' || t || '</h' || heading_level || '>' END, '' ORDER BY pos) || '</body></html>' AS html
  FROM (SELECT doc_id, pos, heading_level, {escaped_sql('text')} AS t FROM faulty WHERE trim(text) <> '') GROUP BY doc_id""")
def a23(spark, sf):
    return written(pages_html(spark, sf).select(F.col("html").alias("value")), "text").withColumnRenamed("value", "html")


@query("a25_inline_render", f"""WITH {q.RUNS}, t AS (SELECT doc_id, pos, pos // 6 AS paragraph, '<span style="font-size: ' || size || 'pt">' || CASE WHEN bold THEN '<strong>run ' || pos || ' &lt;b&gt;</strong>' ELSE 'run ' || pos || ' &lt;b&gt;' END || '</span>' AS h FROM runs),
  g AS (SELECT doc_id, paragraph, string_agg(h, '' ORDER BY pos) AS html, min(pos) AS first FROM t GROUP BY ALL) SELECT doc_id, paragraph, regexp_replace(html, '^(.*?)(run ' || first || ')', '\\1<a href="#">\\2</a>') AS html FROM g""")
def a25(spark, sf):
    run = s.runs(spark, sf).withColumn("text", F.concat(F.lit("run "), F.col("pos").cast("string"), F.lit(" <b>")))
    t = text.escape_html(F.col("text"))
    t = F.when(F.col("bold"), F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t)
    t = F.concat(F.lit('<span style="font-size: '), F.col("size").cast("string"), F.lit('pt">'), t, F.lit("</span>"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", t.alias("h")))), lambda x: x["h"]), "")
    g = run.groupBy("doc_id", F.floor(F.col("pos") / 6).alias("paragraph")).agg(joined.alias("html"), F.min("pos").alias("first"))
    link = F.concat(F.lit("run "), F.col("first").cast("string"))
    return g.select("doc_id", "paragraph", F.regexp_replace("html", F.concat(F.lit("^(.*?)("), link, F.lit(")")), F.concat(F.lit('$1<a href="#">$2</a>'))).alias("html"))


@query("a28_report_sink", f"WITH r AS ({ORACLES['e02_validation_roll_up']}) " + " UNION ALL ".join(f"SELECT '<tr><td>{c}</td><td>' || sum({c}) || '</td></tr>' AS value FROM r" for c in ("passed", "failed", "warnings", "not_applicable")))
def a28(spark, sf):
    r = checks.roll_up(all_checks(spark, sf), "page_id")
    totals = r.agg(*(F.sum(c).alias(c) for c in ("passed", "failed", "warnings", "not_applicable")))
    rows = totals.select(F.explode(F.array(*(F.concat(F.lit(f"<tr><td>{c}</td><td>"), F.col(c).cast("string"), F.lit("</td></tr>")) for c in totals.columns))).alias("value"))
    return written(rows, "text")


@query("a33_json_sink", f"{J} SELECT id, status, pages FROM jobs")
def a33(spark, sf):
    nested = s.jobs(spark, sf).select("id", F.struct("status", "pages").alias("result"))
    return written(nested, "json").select("id", "result.status", "result.pages")


@query("a35_benchmark_report", f"SELECT printf('| %s | %d/%d | %.2f%% |', task, correct, n, accuracy * 100) AS value FROM ({ORACLES['e22_accuracy']})")
def a35(spark, sf):
    lines = checks.accuracy(judged(spark, sf)).select(F.format_string("| %s | %d/%d | %.2f%% |", "task", "correct", "n", F.col("accuracy") * 100).alias("value"))
    return written(lines, "text")


@query("b06_lightness_bisection", f"WITH {q.COLOURS}, pairs AS (SELECT DISTINCT fg, '#FFFFFF' AS bg, 11.0::DOUBLE AS size, false AS bold FROM colours), {q.REPAIRED} SELECT fg, fixed FROM repaired")
def b06(spark, sf):
    pairs = s.colours(spark, sf).select("fg", F.lit("#FFFFFF").alias("bg"), F.lit(11.0).alias("size"), F.lit(False).alias("bold")).distinct()
    return pairs.select("fg", repaired("fg", "bg", "size", "bold").alias("fixed"))


@query("b32_latex_symbols", f"WITH {q.LINES} SELECT doc_id, pos, '∀x ∃y α→β foo ' || text AS t FROM lines")
def b32(spark, sf):
    t = F.concat(F.lit("\\forallx \\existsy \\alpha\\to\\beta \\foo "), F.col("text"))
    return s.lines(spark, sf).select("doc_id", "pos", latex.symbols(t).alias("t"))


@query("b33_pseudocode_format", """SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '<pre class="algorithm">' || chr(10) || '<strong>Require:</strong> ' || t || chr(10) || '<strong>Function</strong> F' || pos || '(' || t || '):' || chr(10)
    || '    <strong>If</strong> x ≥ {' || doc_id || '}:' || chr(10) || '        ' || t || chr(10) || '    <strong>Else If</strong> ' || t || ' b:' || chr(10) || '        <strong>Return</strong>' || chr(10) || '    <strong>Else</strong>:' || chr(10) || '        G(' || t || ')' || chr(10) || '</pre>'
  WHEN 1 THEN '<pre class="algorithm">' || chr(10) || '<strong>While</strong> p q:' || chr(10) || '    <strong>For</strong> α ∈ ' || t || ':' || chr(10) || '        a {' || pos || ' c} ' || t || chr(10) || '<strong>Ensure:</strong>' || chr(10) || '<strong>Return</strong> ' || t || chr(10) || '</pre>'
  WHEN 2 THEN '<pre class="algorithm">' || chr(10) || '<strong>Procedure</strong> P():' || chr(10) || '    ' || t || chr(10) || '</pre>' END AS code
  FROM (SELECT doc_id, pos, upper(replace(left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 12), 'z', 'y')) AS t FROM lines) WHERE t <> ''""".replace("SELECT doc_id, pos, CASE", f"WITH {q.LINES} SELECT doc_id, pos, CASE", 1))
def b33(spark, sf):
    word = F.upper(F.replace(F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 12), F.lit("z"), F.lit("y")))
    rows = s.lines(spark, sf).select("doc_id", "pos", word.alias("t")).where("t <> ''")
    pos, t = F.col("pos").cast("string"), F.col("t")
    first = ("\\Require ", t, "\n\\Function{F", pos, "}{", t, "} \\If{x \\geq {", F.col("doc_id").cast("string"), "}} \\State ", t, " \\Comment{no} \\ElsIf{", t, "}{b} text \\State \\Return \\Else \\Call{G}{", t, "} \\EndIf \\EndFunction \\EndIf")
    second = ("\\While{p}{q} \\For{\\alpha \\in ", t, "} \\State {a {", pos, " c}} ", t, " \\EndFor \\EndWhile \\Ensure \\Return ", t)
    third = ("\\Procedure {P} {} ", t, " \\State ", t, "\n \\gets ", t)
    join = lambda parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    source = F.when(F.col("pos") % 4 == 0, join(first)).when(F.col("pos") % 4 == 1, join(second)).when(F.col("pos") % 4 == 2, join(third)).otherwise(t)
    return rows.withColumn("source", source).select("doc_id", "pos", F.when(latex.is_pseudocode(F.col("source")), latex.pseudocode(F.col("source"))).alias("code"))


@query("b43_surrounding_text", f"""WITH {q.LINES}, c AS (SELECT doc_id, pos, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
  b AS (SELECT a.doc_id, a.pos, string_agg(right(x.text, (100 - (a.upto - a.n - x.upto))::BIGINT), ' ' ORDER BY x.pos) AS t FROM c a JOIN c x ON x.doc_id = a.doc_id AND x.pos < a.pos AND a.upto - a.n - x.upto < 100 GROUP BY ALL),
  f AS (SELECT a.doc_id, a.pos, string_agg(left(x.text, (100 - (x.upto - x.n - a.upto))::BIGINT), ' ' ORDER BY x.pos) AS t FROM c a JOIN c x ON x.doc_id = a.doc_id AND x.pos > a.pos AND x.upto - x.n - a.upto < 100 GROUP BY ALL)
  SELECT doc_id, pos, concat_ws(' [...] ', nullif({q.STRIP.format("b.t")}, ''), nullif({q.STRIP.format("f.t")}, '')) AS around FROM lines LEFT JOIN b USING (doc_id, pos) LEFT JOIN f USING (doc_id, pos)""")
def b43(spark, sf):
    """About 100 characters on each side. Lines have at least one character, so 100 of them always are enough."""
    w = structure.along("pos")
    p = s.lines(spark, sf)
    before = F.collect_list("text").over(w.rowsBetween(-100, -1))
    after = F.collect_list("text").over(w.rowsBetween(1, 100))

    def take(parts, last):
        """Whole parts while they fit into 100 characters, then a piece of the next."""
        ordered = F.reverse(parts) if last else parts
        step = lambda acc, x: F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - F.length(x)).alias("left"), F.array_append(acc["got"], F.when(F.length(x) >= acc["left"], F.right(x, acc["left"]) if last else F.left(x, acc["left"])).otherwise(x)).alias("got")))
        got = F.aggregate(ordered, F.struct(F.lit(100).alias("left"), F.array().cast("array<string>").alias("got")), step)["got"]
        return text.strip(F.array_join(F.reverse(got) if last else got, " "))

    both = F.filter(F.array(take(F.col("b"), True), take(F.col("a"), False)), lambda x: x != "")
    return p.select("doc_id", "pos", before.alias("b"), after.alias("a")).select("doc_id", "pos", F.array_join(both, " [...] ").alias("around"))


@query("b49_pixel_difference", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 100.0 ELSE round(100.0 * (event_id % 16) / 16, 4) END::DOUBLE AS percent FROM events")
def b49(spark, sf):
    k = F.col("event_id")
    a = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 10)
    b = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 10 + F.when(i < k % 16, 6).otherwise(5))
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) > 5), lambda x: x))
    return s.table(spark, sf, "events").select("event_id", F.when(k % 10 == 0, 100.0).otherwise(F.round(100.0 * differ / F.size(a), 4)).alias("percent"))


@query("c12_language_present", "SELECT page_id, trim(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) <> '' AS has_language FROM pages")
def c12(spark, sf):
    return s.table(spark, sf, "pages").select("page_id", (text.strip(F.regexp_extract("html", '<html lang="([^"]*)"', 1)) != "").alias("has_language"))


@query("d16_heading_match", f"""WITH {q.LINES}, p AS (SELECT doc_id, pos // 5 AS page, pos, text, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM lines),
  t AS (SELECT doc_id, page, pos AS tag, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS tt FROM p WHERE (doc_id + pos) % 3 = 0),
  x AS (SELECT p.doc_id, p.page, p.pos, tag, CASE WHEN contains(text, tt) OR contains(tt, text) THEN 1.0::DOUBLE ELSE len(list_intersect(w, list_distinct(regexp_split_to_array(lower(tt), '\\s+'))))::DOUBLE / greatest(len(w), len(list_distinct(regexp_split_to_array(lower(tt), '\\s+')))) * 0.8 END AS score,
    dense_rank() OVER (PARTITION BY p.doc_id, p.page ORDER BY tag) AS nth FROM p JOIN t USING (doc_id, page)),
  one AS (SELECT doc_id, page, tag, pos, score FROM x WHERE nth = 1 AND score > 0.1 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, pos) = 1),
  two AS (SELECT x.doc_id, x.page, x.tag, x.pos, x.score FROM x LEFT JOIN one ON one.doc_id = x.doc_id AND one.page = x.page AND one.pos = x.pos WHERE nth = 2 AND x.score > 0.1 AND one.pos IS NULL QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.page ORDER BY x.score DESC, x.pos) = 1)
  SELECT * FROM one UNION ALL SELECT * FROM two""")
def d16(spark, sf):
    return heading_matches(spark, sf, 5, 1)


def heading_matches(spark, sf, size: int, silent: int):
    """Heading tags hold the first words of some lines, on pages of that many; of so many tags one has no text."""
    page, pos = F.floor(F.col("pos") / size), F.col("pos")
    p = s.lines(spark, sf).withColumn("page", page).withColumn("fake_score", pos * 7 % 11 / 10.0)
    words = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    tags = p.where("(doc_id + pos) % 3 = 0").select("doc_id", "page", pos.alias("tag"), (words if silent == 1 else F.when(pos % silent == 0, "").otherwise(words)).alias("tag_text"))
    pairs = matching.heading_pairs(p, tags, ["doc_id", "page"]).select(F.struct("doc_id", "page").alias("grp"), F.col("tag").alias("seeker"), F.col("pos").alias("target"), "score")
    return matching.one_use(pairs, lambda df: written(df, "parquet")).select("grp.doc_id", "grp.page", F.col("seeker").alias("tag"), F.col("target").alias("pos"), "score")


@query("d16_heading_match_long_pages", f"""WITH RECURSIVE {q.LINES}, p AS (SELECT doc_id, pos // 12 AS page, pos, trim(text) AS text, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w, (pos * 7 % 11 / 10.0)::DOUBLE AS fake FROM lines),
  t AS (SELECT doc_id, pos // 12 AS page, pos AS tag, CASE WHEN pos % 2 = 0 THEN '' ELSE trim(array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')) END AS tt FROM lines WHERE (doc_id + pos) % 3 = 0),
  x AS (SELECT p.doc_id, p.page, p.pos, tag, CASE WHEN tt = '' THEN CASE WHEN fake >= 0.5 THEN fake * 0.5 ELSE 0 END WHEN contains(text, tt) OR contains(tt, text) THEN 1.0::DOUBLE
    ELSE len(list_intersect(w, list_distinct(regexp_split_to_array(lower(tt), '\\s+'))))::DOUBLE / greatest(len(w), len(list_distinct(regexp_split_to_array(lower(tt), '\\s+')))) * 0.8 END AS score FROM p JOIN t USING (doc_id, page) WHERE text <> ''),
  c AS (SELECT doc_id, page, tag, list({{'a': pos, 'b': score}} ORDER BY score DESC, pos) AS wish, row_number() OVER (PARTITION BY doc_id, page ORDER BY tag) AS nth FROM x WHERE score > 0.1 GROUP BY doc_id, page, tag),
  r AS (SELECT doc_id, page, 0::BIGINT AS nth, NULL::BIGINT AS tag, NULL::STRUCT(a BIGINT, b DOUBLE) AS got, []::BIGINT[] AS taken FROM (SELECT DISTINCT doc_id, page FROM c)
    UNION ALL SELECT doc_id, page, nth, tag, got, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.a) END FROM (SELECT c.doc_id, c.page, c.nth, c.tag, r.taken, list_filter(wish, lambda y: NOT list_contains(r.taken, y.a))[1] AS got FROM r JOIN c ON c.doc_id = r.doc_id AND c.page = r.page AND c.nth = r.nth + 1))
  SELECT doc_id, page, tag, got.a AS pos, got.b AS score FROM r WHERE got IS NOT NULL""")
def d16_long(spark, sf):
    return heading_matches(spark, sf, 12, 2)


@query("e37_tree_assessment", "SELECT page, CASE WHEN orphans > 0.2 THEN 'rebuild' WHEN content >= 20 THEN 'preserve' WHEN coverage < 0.5 THEN 'rebuild' ELSE 'preserve' END AS decision FROM (SELECT coalesce(a.page, b.page) AS page, count(*) FILTER (a.m IS NULL OR b.m IS NULL) / count(*) AS orphans, count(a.m) AS content, count(*) FILTER (a.m IS NOT NULL AND b.m IS NOT NULL) / count(*) AS coverage FROM (SELECT DISTINCT event_id // 100 AS page, event_id * 7 % 50 AS m FROM events WHERE event_id % 13 <> 0) a FULL JOIN (SELECT DISTINCT event_id // 100 AS page, event_id * 7 % 50 AS m FROM events WHERE event_id % 11 <> event_id // 100 % 7) b ON a.page = b.page AND a.m = b.m GROUP BY 1)")
def e37(spark, sf):
    k = F.col("event_id")
    e = s.table(spark, sf, "events").select(k, F.floor(k / 100).alias("page"), (k * 7 % 50).alias("m"))
    a = e.where(k % 13 != 0).select("page", "m").distinct().withColumn("a", F.lit(1))
    b = e.where(k % 11 != F.col("page") % 7).select("page", "m").distinct().withColumn("b", F.lit(1))
    g = a.join(b, ["page", "m"], "full").groupBy("page").agg(F.count("*").alias("n"), F.count("a").alias("content"), F.count(F.col("a") + F.col("b")).alias("both"))
    orphans, coverage = 1 - F.col("both") / F.col("n"), F.col("both") / F.col("n")
    return g.select("page", F.when(orphans > 0.2, "rebuild").when(F.col("content") >= 20, "preserve").when(coverage < 0.5, "rebuild").otherwise("preserve").alias("decision"))


@query("f05_heading_score_slides", f"""WITH {q.FAULTY_LINES}, z AS ({ORACLES['f04_heading_score_office']}) SELECT doc_id, pos, CASE WHEN pos % 4 < 3 AND heading_level IS NULL AND {LIST_TYPE} IS NULL THEN score END AS score FROM z JOIN faulty USING (doc_id, pos)""")
def f05(spark, sf):
    """Scores of paragraphs in body style that are neither headings nor list items; a shape in four has a title's style."""
    p = styled(spark, sf)
    body = s.faulty_lines(spark, sf).select("doc_id", "pos", ((F.col("pos") % 4 < 3) & F.col("heading_level").isNull() & text.list_type(F.col("text")).isNull()).alias("body"))
    return structure.fake_heading_scores(p, OFFICE_WEIGHTS, citations=False, bold_only=True).join(body, ["doc_id", "pos"]).select("doc_id", "pos", F.when(F.col("body"), F.col("score")).alias("score"))


@query("h02_table_dedup", f"""WITH RECURSIVE {q.CELLS}, t AS (SELECT doc_id, table_id, cells, row_number() OVER (PARTITION BY doc_id ORDER BY table_id) AS n FROM (SELECT table_id // 200 AS doc_id, table_id, coalesce(list_distinct(list(CASE WHEN trim(text) <> '' THEN lower(trim(text)) END)), []) AS cells FROM cells GROUP BY ALL)),
  w AS (SELECT doc_id, 0::BIGINT AS n, NULL::BIGINT AS table_id, false AS stays, []::VARCHAR[][] AS kept FROM (SELECT DISTINCT doc_id FROM t)
    UNION ALL SELECT doc_id, n, table_id, stays, CASE WHEN stays AND len(cells) > 0 THEN list_append(kept, cells) ELSE kept END FROM (SELECT w.doc_id, t.n, t.table_id, t.cells, w.kept,
      len(cells) = 0 OR len(list_filter(w.kept, lambda x: len(list_intersect(x, t.cells)) >= 0.8 * greatest(len(x), len(t.cells)))) = 0 AS stays FROM w JOIN t ON t.doc_id = w.doc_id AND t.n = w.n + 1))
  SELECT doc_id, table_id FROM w WHERE stays""")
def h02(spark, sf):
    cells = s.cells(spark, sf).withColumn("low", F.lower(text.strip(F.col("text"))))
    t = cells.groupBy(F.floor(F.col("table_id") / 200).alias("grp"), F.col("table_id").alias("id")).agg(F.collect_set(F.when(F.col("low") != "", F.col("low"))).alias("items"))
    return matching.keep_first(t, lambda df: written(df, "parquet")).select(F.col("grp").alias("doc_id"), F.col("id").alias("table_id"))


@query("j03_office_actions", f"WITH {q.FAULTY_ANCHORS} SELECT page_id AS doc_id, count(*) FILTER (pos % 2 = 0) AS executed, count(*) FILTER (pos % 2 = 1) AS failed FROM faulty_anchors GROUP BY 1")
def j03(spark, sf):
    a = link_actions(spark, sf).where("seq % 2 = 1")
    return a.groupBy("doc_id").agg(F.sum((F.col("status") == "executed").cast("int")).alias("executed"), F.sum((F.col("status") == "failed").cast("int")).alias("failed"))


@query("j01_execution_counts", f"WITH {PLAN} SELECT doc_id, count(*) AS executed FROM plan GROUP BY 1")
def j01(spark, sf):
    known = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"))
    return actions.outcome(page_plan(spark, sf), known).where("status = 'executed'").groupBy("doc_id").agg(F.count("*").alias("executed"))


@query("j05_bulk_contrast", f"WITH {q.COLOURS}, pairs AS (SELECT DISTINCT fg, bg, size, bold FROM colours), {q.REPAIRED} SELECT doc_id, count(*) AS runs, count(*) FILTER (fixed <> fg) AS changed FROM colours JOIN repaired USING (fg, bg, size, bold) GROUP BY 1")
def j05(spark, sf):
    runs = s.colours(spark, sf)
    out = runs.withColumn("fixed", repaired("fg", "bg", "size", "bold"))
    return out.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum((F.col("fixed") != F.col("fg")).cast("int")).alias("changed"))


@query("k02_window_expiry", "SELECT user_id, count(*) AS n FROM (SELECT user_id, epoch(ts::TIMESTAMP) AS t, max(epoch(ts::TIMESTAMP)) OVER () AS now, max(epoch(ts::TIMESTAMP)) OVER (PARTITION BY user_id) AS last FROM events) WHERE last > now - 3600 * 24 GROUP BY 1")
def k02(spark, sf):
    e = s.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    now = g.agg(F.max("last").alias("now"))
    return g.join(F.broadcast(now)).where("last > now - 3600 * 24").select("user_id", "n")


@query("l01_insert_job", f"{J} SELECT count(*) AS jobs, count(*) FILTER (status = 'queued') + 1 AS queued FROM (SELECT status FROM jobs UNION ALL SELECT 'new')")
def l01(spark, sf):
    new = spark.createDataFrame([(-1, "queued")], "id long, status string")
    both = s.jobs(spark, sf).select("id", "status").unionByName(new)
    return both.agg(F.count("*").alias("jobs"), F.sum((F.col("status") == "queued").cast("int")).alias("queued"))


@query("l04_quota_increment", f"{J} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) <= 5 AS granted FROM jobs")
def l04(spark, sf):
    return s.jobs(spark, sf).select("user_id", "id", (F.row_number().over(Window.partitionBy("user_id").orderBy("id")) <= 5).alias("granted"))


@query("l09_added_column", f"{J} SELECT id, CASE WHEN id % 2 = 0 THEN 'x' END AS note FROM jobs")
def l09(spark, sf):
    jobs = s.jobs(spark, sf).select("id")
    return jobs.where("id % 2 = 1").unionByName(jobs.where("id % 2 = 0").withColumn("note", F.lit("x")), allowMissingColumns=True)


@query("k05_stream_hourly", "SELECT user_id, date_trunc('hour', ts::TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY ALL")
def k05s(spark, sf):
    from plumbline.streaming.limits import hourly_counts

    return hourly_counts(spark, f"{sf}/events.parquet", shared(spark, "stream"))


@query("k01_rate_limiter_stream", ORACLES["k01_rate_limiter"])
def k01s(spark, sf):
    from plumbline.streaming.limits import limited_in_parts

    e = s.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return limited_in_parts(e, 3, 36_000.0, shared(spark, "limiter"))


FACTS = ("Document", "Sect", "Figure", "Table", "TR", "TH", "TD", "H1", "H3", "H", "P", "Span", "L", "Link", "MyTag", "P")


@query("a15_structure_facts", f"""WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id % 50 > 0 THEN event_id - 1 - event_id % 3 * (event_id % 50 > 3)::INT END AS parent, event_id // 50 AS doc_id, ({list(FACTS)!r})[event_id * 7 % 16 + 1] AS tag, CASE WHEN event_id % 3 = 0 THEN 'alt ' || event_id WHEN event_id % 3 = 1 THEN '' END AS alt, event_id % 5 = 0 AS actual FROM events WHERE event_id % 50 <> 37),
  w AS (SELECT id, doc_id, tag, alt, actual, 0 AS depth, NULL::BIGINT AS grid FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.doc_id, t.tag, t.alt, t.actual, w.depth + 1, CASE WHEN w.tag = 'Table' THEN w.id ELSE w.grid END FROM t JOIN w ON t.parent = w.id),
  f AS (SELECT doc_id, count(*) AS elements, max(depth)::BIGINT AS depth, count(*) FILTER (tag = 'MyTag') AS custom, count(*) FILTER (tag = 'Figure') AS figures, count(*) FILTER (tag = 'Figure' AND alt <> '') AS figures_with_alt, count(*) FILTER (tag = 'Figure' AND actual) AS figures_with_actual_text,
    count(*) FILTER (tag = 'Table') AS tables, count(*) FILTER (tag = 'TH') AS th, count(*) FILTER (tag IN ('H', 'H1', 'H3')) AS headings, count(*) FILTER (tag = 'Link') AS links, count(*) FILTER (tag = 'P') AS paragraphs, count(*) FILTER (tag = 'Span') AS spans, count(*) FILTER (tag = 'L') AS lists,
    count(DISTINCT CASE WHEN tag = 'TH' THEN grid END) AS tables_with_own_th FROM w GROUP BY 1)
  SELECT page_id AS doc_id, page_id % 4 > 0 AS is_marked, f.doc_id IS NOT NULL AS has_tree, coalesce(elements, 0) AS elements, depth, coalesce(custom, 0) AS custom, round(custom / elements, 6) AS custom_ratio, coalesce(figures, 0) AS figures, coalesce(figures_with_alt, 0) AS figures_with_alt, coalesce(figures_with_actual_text, 0) AS figures_with_actual_text,
    coalesce(tables, 0) AS tables, coalesce(th, 0) AS th, CASE WHEN tables > 0 AND th > 0 THEN tables ELSE 0 END AS tables_with_th, coalesce(tables_with_own_th, 0) AS tables_with_own_th, coalesce(headings, 0) AS headings, coalesce(f.links, 0) AS links, coalesce(paragraphs, 0) AS paragraphs, coalesce(spans, 0) AS spans, coalesce(lists, 0) AS lists,
    a.n AS annotations, a.valid AS annotations_valid, a.alt AS annotations_with_alt, a.tied AS annotations_tied FROM (SELECT page_id, count(*) AS n, count(*) FILTER (url LIKE 'http%' OR url LIKE 'mailto:%') AS valid, count(*) FILTER (pos % 2 = 0) AS alt, count(*) FILTER (pos % 3 = 0) AS tied FROM faulty_anchors GROUP BY 1) a LEFT JOIN f ON f.doc_id = page_id""".replace("WITH RECURSIVE t AS", "WITH RECURSIVE " + q.FAULTY_ANCHORS + ", t AS", 1))
def a15_facts(spark, sf):
    k = F.col("event_id")
    tag = F.element_at(F.array(*map(F.lit, FACTS)), (k * 7 % 16 + 1).cast("int"))
    alt = F.when(k % 3 == 0, F.concat(F.lit("alt "), k.cast("string"))).when(k % 3 == 1, "")
    tree = s.table(spark, sf, "events").where("event_id % 50 <> 37").select(k.alias("id"), F.when(k % 50 > 0, k - 1 - k % 3 * (k % 50 > 3).cast("int")).alias("parent"), F.floor(k / 50).alias("doc_id"), tag.alias("tag"), alt.alias("alt"), (k % 5 == 0).alias("actual_text"))
    docs = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id")).distinct().withColumn("is_marked", F.col("doc_id") % 4 > 0)
    links = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id"), F.col("url").alias("uri"), (F.col("pos") % 2 == 0).alias("has_alt"), (F.col("pos") % 3 == 0).alias("tied"))
    return structure.tree_facts(docs, tree, links, lambda df: written(df, "parquet"))


@query("a35_confusion_report", f"""WITH {JUDGED}, n AS (SELECT task, gold, predicted, count(*) AS n FROM judged GROUP BY ALL), t AS (SELECT task, string_agg(x, chr(10) ORDER BY gold) AS rows, sum(total)::BIGINT AS total FROM (SELECT task, gold, '| ' || gold || ' | ' || coalesce(sum(n) FILTER (predicted = 0), 0) || ' | ' || coalesce(sum(n) FILTER (predicted = 1), 0) || ' |' AS x, sum(n) AS total FROM n GROUP BY task, gold) GROUP BY 1)
  SELECT '## ' || task || ' (' || total || ')' || chr(10) || '| gold | 0 | 1 |' || chr(10) || '|---|---|---|' || chr(10) || rows AS value FROM t""")
def a35_confusion(spark, sf):
    return checks.confusion_report(judged(spark, sf), [0, 1])


@query("l01_insert_job_rows", f"{J} SELECT id, user_id, status, pages FROM jobs UNION ALL SELECT max(id) OVER () + row_number() OVER (ORDER BY id), user_id, 'queued', pages FROM (SELECT id, user_id, pages FROM jobs WHERE id % 10 = 3)".replace("SELECT max(id) OVER () + row_number() OVER (ORDER BY id), user_id", "SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY id), user_id"))
def l01_rows(spark, sf):
    jobs = s.jobs(spark, sf).select("id", "user_id", "status", "pages")
    return ledger.inserted(jobs, jobs.where("id % 10 = 3").select(F.col("id").alias("asked"), "user_id", "pages"), "asked", lambda df: written(df, "parquet"))
