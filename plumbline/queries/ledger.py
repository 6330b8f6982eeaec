"""Queries of joins, plans, evaluation and the job ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.repair import repaired
from plumbline.functions import text
from plumbline.operators import checks, ledger
from plumbline.plans import actions, outcomes
from plumbline.queries.scalar import LIST_TYPE
from plumbline.queries.structure import ISSUES
from plumbline.registry import query
from plumbline.sources import tables as s
from plumbline.sources import twins as q

J = f"WITH {q.JOBS}"


@query("a21_row_counts", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def a21(spark, sf):
    return actions.union([s.table(spark, sf, t).groupBy().agg(F.lit(t).alias("t"), F.count("*").alias("n")).select("t", "n") for t in ("orders", "customer", "events")])


@query("c06_jobs_of_owner", f"{J} SELECT id, status FROM jobs WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND user_id % 2 = 1")
def c06(spark, sf):
    ids = s.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return s.jobs(spark, sf).where("user_id % 2 = 1").join(ids, "id", "left_semi").select("id", "status")


@query("c07_deletable_jobs", f"{J} SELECT id FROM jobs WHERE user_id % 2 = 1 AND status NOT IN ('queued', 'processing')")
def c07(spark, sf):
    return s.jobs(spark, sf).where("user_id % 2 = 1 and status not in ('queued', 'processing')").select("id")


@query("c08_unexpired_tokens", "SELECT o_custkey AS user_id, o_orderkey AS id FROM orders WHERE sha256(o_orderkey::VARCHAR) < '8' AND o_orderdate::DATE > DATE '1999-06-01'")
def c08(spark, sf):
    return s.table(spark, sf, "orders").where((F.sha2(F.col("o_orderkey").cast("string"), 256) < "8") & (F.col("o_orderdate").cast("date") > F.lit("1999-06-01").cast("date"))).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"))


@query("c09_case_insensitive_key", "SELECT a.c_custkey AS k FROM customer a JOIN customer b ON lower(a.c_name) = lower(upper(b.c_name)) WHERE b.c_custkey % 7 = 0")
def c09(spark, sf):
    c = s.table(spark, sf, "customer")
    asked = c.where("c_custkey % 7 = 0").select(F.lower(F.upper("c_name")).alias("low"))
    return c.withColumn("low", F.lower("c_name")).join(asked, "low").select(F.col("c_custkey").alias("k"))


@query("d01_reading_order", f"WITH {q.LINES}, o AS (SELECT doc_id, pos, 'p_' || ((pos * 7 + 3) % 40) AS id FROM lines) SELECT o.doc_id, o.pos AS place, l.text FROM o JOIN lines l ON l.doc_id = o.doc_id AND 'p_' || l.pos = o.id")
def d01(spark, sf):
    p = s.lines(spark, sf)
    order = p.select("doc_id", F.col("pos").alias("place"), F.concat(F.lit("p_"), ((F.col("pos") * 7 + 3) % 40).cast("string")).alias("id"))
    return order.join(p.withColumn("id", F.concat(F.lit("p_"), F.col("pos").cast("string"))), ["doc_id", "id"]).select("doc_id", "place", "text").sort("doc_id", "place")


@query("d02_replace_scanned", f"WITH {q.LINES}, s AS (SELECT DISTINCT doc_id, pos // 5 AS page FROM lines WHERE (doc_id + pos // 5) % 4 = 0) SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (ocr) AS from_ocr FROM (SELECT doc_id, pos, false AS ocr FROM lines l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = l.doc_id AND s.page = l.pos // 5) UNION ALL SELECT doc_id, page, true FROM s) GROUP BY 1")
def d02(spark, sf):
    p = s.lines(spark, sf).withColumn("page", F.floor(F.col("pos") / 5))
    scanned = p.where((F.col("doc_id") + F.col("page")) % 4 == 0).select("doc_id", "page").distinct()
    kept = p.join(scanned, ["doc_id", "page"], "left_anti").select("doc_id", F.lit(False).alias("ocr"))
    return kept.unionByName(scanned.select("doc_id", F.lit(True).alias("ocr"))).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.col("ocr").cast("int")).alias("from_ocr"))


def link_actions(spark, sf):
    a = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"), "pos")
    many = a.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return many.select("doc_id", "element_id", (F.col("pos") * 2 + F.col("n")).alias("seq"), F.lit("set_link_text").alias("action_type"), F.concat(F.lit("text "), F.col("n").cast("string")).alias("value"), F.when(F.col("pos") % (F.col("n") + 1) == 0, "executed").otherwise("failed").alias("status"))


@query("d03_patch_links", f"WITH {q.FAULTY_ANCHORS} SELECT page_id AS doc_id, 'link_' || pos AS element_id, CASE WHEN pos % 3 = 0 THEN 'text 2' WHEN pos % 2 = 0 THEN 'text 1' ELSE text END AS text FROM faulty_anchors")
def d03(spark, sf):
    model = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"), "text")
    return actions.patched(model, link_actions(spark, sf), "set_link_text", "text", ["doc_id", "element_id"])


@query("d04_element_index", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS index FROM faulty WHERE trim(text) <> ''")
def d04(spark, sf):
    p = s.faulty_lines(spark, sf).where(text.strip(F.col("text")) != "")
    return p.select("doc_id", "pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("index"))


@query("d05_image_paragraph", f"WITH {q.LINES}, i AS (SELECT doc_id, pos, unnest([pos % 5, pos % 7]) AS img FROM lines) SELECT doc_id, 'img_' || img AS image, min(pos) AS pos FROM i GROUP BY ALL")
def d05(spark, sf):
    i = s.lines(spark, sf).select("doc_id", "pos", F.explode(F.array(F.col("pos") % 5, F.col("pos") % 7)).alias("img"))
    return i.groupBy("doc_id", F.concat(F.lit("img_"), F.col("img").cast("string")).alias("image")).agg(F.min("pos").alias("pos"))


PLAN = f"""{ISSUES}, a AS (SELECT page_id AS doc_id, 0 AS phase, 0 AS pos, 'doc' AS element_id, 'set_title' AS action_type, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS value FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 1, 0, 'doc', 'set_language', regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 3, pos, 'link_' || pos, 'set_link_text', issue FROM issues WHERE issue IN ('empty_text', 'bare_url', 'vague_text')),
  plan AS (SELECT doc_id, element_id, action_type, value, row_number() OVER (PARTITION BY doc_id ORDER BY phase, pos, element_id) AS seq FROM a)"""


def page_plan(spark, sf):
    pages, links = s.table(spark, sf, "pages"), s.faulty_anchors(spark, sf)
    got = lambda p: text.strip(F.regexp_extract("html", p, 1))
    link = checks.link_issues(links).where(F.col("issue").isin("empty_text", "bare_url", "vague_text"))
    doc = F.lit("doc")
    return actions.ordered(
        actions.union(
            [
                actions.action(pages.where("page_id % 2 = 0"), "set_title", doc, got("<h1>([^<]*)</h1>"), "page_id"),
                actions.action(pages.where("page_id % 3 = 0"), "set_language", doc, got('<html lang="([^"]*)"'), "page_id"),
                actions.action(link, "set_link_text", F.concat(F.lit("link_"), F.col("pos").cast("string")), F.col("issue"), "page_id", F.col("pos")),
            ]
        )
    )


@query("d06_plan", f"WITH {PLAN} SELECT * FROM plan")
def d06(spark, sf):
    return page_plan(spark, sf)


@query("d07_tagging_plan", f"WITH {PLAN} SELECT p.doc_id, p.seq, p.element_id, p.value, f.url FROM plan p JOIN faulty_anchors f ON f.page_id = p.doc_id AND 'link_' || f.pos = p.element_id")
def d07(spark, sf):
    links = s.faulty_anchors(spark, sf).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"), "url")
    return page_plan(spark, sf).join(links, ["doc_id", "element_id"]).select("doc_id", "seq", "element_id", "value", "url")


@query("d08_plan_without_tagged", f"WITH {PLAN} SELECT doc_id, seq, element_id FROM plan WHERE NOT (action_type = 'set_link_text' AND (coalesce(nullif(regexp_extract(element_id, '\\d+$'), ''), '0')::INT + doc_id) % 3 = 0)")
def d08(spark, sf):
    tagged = s.faulty_anchors(spark, sf).where("(page_id + pos) % 3 = 0").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"))
    return page_plan(spark, sf).join(tagged, ["doc_id", "element_id"], "left_anti").select("doc_id", "seq", "element_id")


@query("d09_figure_image", f"WITH {q.BOXES}, i AS (SELECT doc_id, page, pos FROM boxes WHERE n_chars % 3 = 0), f AS (SELECT doc_id, page, pos, CASE WHEN n_chars % 2 = 0 THEN pos - 1 END AS ref FROM boxes WHERE n_chars % 3 = 1) SELECT f.doc_id, f.page, f.pos, coalesce((SELECT min(pos) FROM i WHERE i.doc_id = f.doc_id AND i.page = f.page AND i.pos = f.ref), (SELECT min(pos) FROM i WHERE i.doc_id = f.doc_id AND i.page = f.page)) AS image FROM f")
def d09(spark, sf):
    b = s.boxes(spark, sf)
    images = b.where("n_chars % 3 = 0")
    figures = b.where("n_chars % 3 = 1").select("doc_id", "page", "pos", F.when(F.col("n_chars") % 2 == 0, F.col("pos") - 1).alias("ref"))
    own = images.select("doc_id", "page", F.col("pos").alias("ref"), F.col("pos").alias("by_ref"))
    first = images.groupBy("doc_id", "page").agg(F.min("pos").alias("first"))
    return figures.join(own, ["doc_id", "page", "ref"], "left").join(first, ["doc_id", "page"], "left").select("doc_id", "page", "pos", F.coalesce("by_ref", "first").alias("image"))


@query("d10_link_blocks", f"WITH {q.BOXES} SELECT b.doc_id, b.page, b.pos, l.pos AS link FROM boxes b JOIN (SELECT *, x0 + 30 AS a0, y0 + 4 AS b0, x0 + 50 AS a1, y0 + 9 AS b1 FROM boxes WHERE n_chars % 4 = 0) l ON b.doc_id = l.doc_id AND b.page = l.page AND b.x0 < l.a1 AND l.a0 < b.x1 AND b.y0 < l.b1 AND l.b0 < b.y1")
def d10(spark, sf):
    b = s.boxes(spark, sf)
    link = b.where("n_chars % 4 = 0").select("doc_id", "page", F.col("pos").alias("link"), (F.col("x0") + 30).alias("a0"), (F.col("y0") + 4).alias("b0"), (F.col("x0") + 50).alias("a1"), (F.col("y0") + 9).alias("b1"))
    return b.join(link, ["doc_id", "page"]).where("x0 < a1 and a0 < x1 and y0 < b1 and b0 < y1").select("doc_id", "page", "pos", "link")


@query("d11_corrections", f"WITH {q.LINES} SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 5 = 0 THEN reverse(text) ELSE text END AS text FROM lines")
def d11(spark, sf):
    p = s.lines(spark, sf)
    better = p.where("(doc_id + pos) % 5 = 0").select("doc_id", "pos", F.reverse("text").alias("better"))
    return p.join(better, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("better", "text").alias("text"))


@query("d12_regions", f"WITH {q.LINES} SELECT doc_id, pos // 4 AS region, string_agg(text, ' ' ORDER BY pos) AS text, least(greatest(min(pos) % 9, 1), 6) AS level FROM lines WHERE pos // 4 % 5 <> 4 GROUP BY ALL")
def d12(spark, sf):
    p = s.lines(spark, sf).withColumn("region", F.floor(F.col("pos") / 4)).where("region % 5 <> 4")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return p.groupBy("doc_id", "region").agg(joined.alias("text"), F.least(F.greatest(F.min("pos") % 9, F.lit(1)), F.lit(6)).cast("long").alias("level"))


@query("d13_plan_difference", f"WITH {PLAN}, b AS (SELECT doc_id, element_id, action_type, CASE WHEN seq % 3 = 0 THEN value || '!' ELSE value END AS value FROM plan WHERE seq % 5 <> 1 UNION ALL SELECT page_id, 'extra', 'set_title', 'x' FROM pages WHERE page_id % 4 = 0) SELECT coalesce(p.doc_id, b.doc_id) AS doc_id, count(*) FILTER (b.doc_id IS NULL) AS only_a, count(*) FILTER (p.doc_id IS NULL) AS only_b, count(*) FILTER (p.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS common, count(*) FILTER (p.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND p.value IS DISTINCT FROM b.value) AS differing FROM plan p FULL JOIN b ON p.doc_id = b.doc_id AND p.element_id = b.element_id AND p.action_type = b.action_type GROUP BY 1")
def d13(spark, sf):
    a = page_plan(spark, sf)
    b = a.where("seq % 5 <> 1").withColumn("value", F.when(F.col("seq") % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value"))).select("doc_id", "element_id", "action_type", "value")
    extra = s.table(spark, sf, "pages").where("page_id % 4 = 0").select(F.col("page_id").alias("doc_id"), F.lit("extra").alias("element_id"), F.lit("set_title").alias("action_type"), F.lit("x").alias("value"))
    return actions.difference(a, b.unionByName(extra))


FILES = "files AS (SELECT id, 'f' || (id % 5000) AS path, id * 13 % 900 AS bytes, created_at FROM jobs), active AS (SELECT DISTINCT unnest(['f' || (id % 5000), 'f' || (id * 3 % 5000)]) AS path FROM jobs WHERE status = 'processing')"


def files(spark, sf):
    return s.jobs(spark, sf).select("id", F.concat(F.lit("f"), (F.col("id") % 5000).cast("string")).alias("path"), (F.col("id") * 13 % 900).alias("bytes"), "created_at")


def active(spark, sf):
    name = lambda c: F.concat(F.lit("f"), (c % 5000).cast("string"))
    return s.jobs(spark, sf).where("status = 'processing'").select(F.explode(F.array(name(F.col("id")), name(F.col("id") * 3))).alias("path")).distinct()


@query("d14_retention", f"{J}, {FILES} SELECT id, path FROM files WHERE created_at < DATE '1998-01-01' AND path NOT IN (SELECT path FROM active)")
def d14(spark, sf):
    return files(spark, sf).where("created_at < date '1998-01-01'").join(active(spark, sf), "path", "left_anti").select("id", "path")


@query("d15_active_paths", f"{J}, {FILES} SELECT path FROM active")
def d15(spark, sf):
    return active(spark, sf)


@query("k07_retention_report", f"{J}, {FILES} SELECT count(*) AS scanned, count(*) FILTER (created_at >= DATE '1998-01-01') AS recent, count(*) FILTER (created_at < DATE '1998-01-01' AND path IN (SELECT path FROM active)) AS active, count(*) FILTER (created_at < DATE '1998-01-01' AND path NOT IN (SELECT path FROM active)) AS deleted, sum(CASE WHEN created_at < DATE '1998-01-01' AND path NOT IN (SELECT path FROM active) THEN bytes ELSE 0 END)::BIGINT AS freed FROM files")
def k07(spark, sf):
    f = files(spark, sf).join(active(spark, sf).withColumn("a", F.lit(True)), "path", "left")
    old, used = F.col("created_at") < F.lit("1998-01-01").cast("date"), F.col("a").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    return f.agg(F.count("*").alias("scanned"), n(~old).alias("recent"), n(old & used).alias("active"), n(old & ~used).alias("deleted"), F.sum(F.when(old & ~used, F.col("bytes")).otherwise(0)).alias("freed"))


@query("e11_layers_total", f"{J} SELECT id, status = 'completed' AS has_html, (id % 5) + coalesce(CASE WHEN status = 'completed' THEN id % 7 END, 0) + coalesce(CASE WHEN id % 2 = 0 THEN id % 11 END, 0) AS total FROM jobs")
def e11(spark, sf):
    k, done = F.col("id"), F.col("status") == "completed"
    return s.jobs(spark, sf).select("id", done.alias("has_html"), (k % 5 + F.coalesce(F.when(done, k % 7), F.lit(0)) + F.coalesce(F.when(k % 2 == 0, k % 11), F.lit(0))).alias("total"))


@query("e14_cost_summary", "SELECT user_id, count(*) AS calls, sum(event_id % 5000)::BIGINT AS tokens_in, sum(event_id * 3 % 900)::BIGINT AS tokens_out, round(sum(CASE event_id % 3 WHEN 0 THEN (event_id % 5000 * 0.15::DOUBLE + event_id * 3 % 900 * 0.60::DOUBLE) / 1e6 WHEN 1 THEN (event_id % 5000 * 3.0::DOUBLE + event_id * 3 % 900 * 15.0::DOUBLE) / 1e6 ELSE 0 END), 4) AS cost FROM events GROUP BY 1")
def e14(spark, sf):
    k = F.col("event_id")
    model = F.when(k % 3 == 0, "gemini").when(k % 3 == 1, "claude").otherwise("other")
    return s.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum(k % 5000).alias("tokens_in"), F.sum(k * 3 % 900).alias("tokens_out"), F.round(F.sum(text.usage_cost(model, k % 5000, k * 3 % 900)), 4).alias("cost"))


@query("e32_vendor_totals", "SELECT CASE event_id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'claude' ELSE 'other' END AS model, count(*) AS calls, round(sum(CASE event_id % 3 WHEN 0 THEN (event_id % 5000 * 0.15::DOUBLE) / 1e6 WHEN 1 THEN (event_id % 5000 * 3.0::DOUBLE) / 1e6 ELSE 0 END), 4) AS cost FROM events GROUP BY 1")
def e32(spark, sf):
    k = F.col("event_id")
    e = s.table(spark, sf, "events").withColumn("model", F.when(k % 3 == 0, "gemini").when(k % 3 == 1, "claude").otherwise("other"))
    return e.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(text.usage_cost(F.col("model"), k % 5000, F.lit(0))), 4).alias("cost"))


@query("e33_vendor_cost", "SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN (event_id % 100 * 0.1::DOUBLE + event_id % 7 * 0.4::DOUBLE) / 1e6 WHEN 1 THEN (event_id % 100 * 1.25::DOUBLE + event_id % 7 * 10.0::DOUBLE) / 1e6 ELSE 0 END, 9) AS cost FROM events")
def e33(spark, sf):
    k = F.col("event_id")
    prices = F.create_map(F.lit(0), F.array(F.lit(0.1), F.lit(0.4)), F.lit(1), F.array(F.lit(1.25), F.lit(10.0)))
    p = prices[(k % 3).cast("int")]
    return s.table(spark, sf, "events").select("event_id", F.round(F.coalesce((k % 100 * p[0] + k % 7 * p[1]) / 1e6, F.lit(0.0)), 9).alias("cost"))


@query("e15_cost_since", f"{J} SELECT round(coalesce(sum(cost), 0), 2) AS cost FROM jobs WHERE created_at >= DATE '2000-06-01'")
def e15(spark, sf):
    return s.jobs(spark, sf).where("created_at >= date '2000-06-01'").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"))


@query("e16_jobs_per_status", f"{J} SELECT s.status, count(id) AS n FROM (VALUES ('queued'), ('processing')) s(status) LEFT JOIN jobs USING (status) GROUP BY 1")
def e16(spark, sf):
    counted = s.jobs(spark, sf).where("status in ('queued', 'processing')").groupBy("status").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("queued",), ("processing",)], "status string").join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("e17_mean_job_time", f"{J} SELECT round(coalesce(avg(pages * 10.0::DOUBLE), 180), 6) AS seconds FROM jobs WHERE status = 'completed'")
def e17(spark, sf):
    return s.jobs(spark, sf).where("status = 'completed' and pages > 0").agg(F.round(F.coalesce(F.avg(F.col("pages") * 10.0), F.lit(180.0)), 6).alias("seconds"))


@query("e18_batch_status", f"{J} SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS in_flight FROM jobs GROUP BY 1")
def e18(spark, sf):
    done = F.col("status") == "completed"
    return s.jobs(spark, sf).groupBy("batch_id").agg(F.count("*").alias("total"), F.sum(done.cast("int")).alias("completed"), F.sum((~done).cast("int")).alias("in_flight"))


@query("e19_admin_totals", "SELECT c_mktsegment AS tier, count(*) AS users, sum(n)::BIGINT AS docs, sum(p)::BIGINT AS pages FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(1 + o_orderkey % 30) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def e19(spark, sf):
    per = s.jobs(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("pages").alias("p"))
    c = s.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    return c.join(per, "user_id", "left").groupBy("tier").agg(F.count("*").alias("users"), F.sum("n").alias("docs"), F.sum("p").alias("pages"))


JUDGED = "judged AS (SELECT lang AS task, quality AS gold, (length(text) - length(replace(text, chr(10), '')) > 2 AND NOT contains(text, '$'))::INT AS predicted FROM labels JOIN documents USING (doc_id))"


def judged(spark, sf):
    d = s.table(spark, sf, "documents").join(s.table(spark, sf, "labels"), "doc_id")
    guess = (F.regexp_count("text", F.lit("\n")) > 2) & ~F.contains(F.col("text"), F.lit("$"))
    return d.select(F.col("lang").alias("task"), F.col("quality").alias("gold"), guess.cast("int").alias("predicted"))


@query("e22_accuracy", f"WITH {JUDGED} SELECT coalesce(task, '(all)') AS task, count(*) AS n, sum((gold = predicted)::INT)::BIGINT AS correct, round(sum((gold = predicted)::INT) / count(*), 6) AS accuracy FROM judged GROUP BY ROLLUP (task)")
def e22(spark, sf):
    return checks.accuracy(judged(spark, sf))


@query("e23_confusion", f"WITH {JUDGED} SELECT gold, count(*) FILTER (predicted = 0) AS as_0, count(*) FILTER (predicted = 1) AS as_1 FROM judged GROUP BY 1")
def e23(spark, sf):
    return judged(spark, sf).groupBy("gold").pivot("predicted", [0, 1]).count().na.fill(0).select("gold", F.col("0").alias("as_0"), F.col("1").alias("as_1"))


@query("e24_baselines", f"WITH {JUDGED} SELECT 'own' AS system, round(avg((gold = predicted)::INT), 4) AS accuracy FROM judged UNION ALL SELECT * FROM (VALUES ('a', 0.85::DOUBLE), ('b', 0.81), ('c', 0.75), ('d', 0.74), ('e', 0.42)) v(system, accuracy)")
def e24(spark, sf):
    own = judged(spark, sf).agg(F.lit("own").alias("system"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("int")), 4).alias("accuracy"))
    return own.unionByName(spark.createDataFrame([("a", 0.85), ("b", 0.81), ("c", 0.75), ("d", 0.74), ("e", 0.42)], "system string, accuracy double"))


@query("i08_label_dispatch", f"WITH {JUDGED} SELECT task, predicted, CASE WHEN predicted = 1 THEN 'passed' ELSE 'failed' END AS label, count(*) AS n FROM judged GROUP BY ALL")
def i08(spark, sf):
    return judged(spark, sf).groupBy("task", "predicted").agg(F.count("*").alias("n")).withColumn("label", F.when(F.col("predicted") == 1, "passed").otherwise("failed"))


@query("e27_tree_gains", f"{J} SELECT id, (id % 4 > 0 AND id % 3 = 0)::INT + (id % 5 > 0 AND id % 7 = 0)::INT + (least(id % 6 / 5.0, 1) > least(id % 9 / 8.0, 1))::INT AS gains FROM jobs")
def e27(spark, sf):
    k = F.col("id")
    share = lambda a, b: F.least(a / b, F.lit(1.0))
    before = s.jobs(spark, sf).select("id", (k % 3 != 0).alias("tree0"), (k % 7 != 0).alias("heads0"), share(k % 9, F.lit(8.0)).alias("alt0"))
    after = s.jobs(spark, sf).select("id", (k % 4 > 0).alias("tree1"), (k % 5 > 0).alias("heads1"), share(k % 6, F.lit(5.0)).alias("alt1"))
    gain = (F.col("tree1") & ~F.col("tree0")).cast("int") + (F.col("heads1") & ~F.col("heads0")).cast("int") + (F.col("alt1") > F.col("alt0")).cast("int")
    return before.join(after, "id").select("id", gain.alias("gains"))


@query("e28_remediation_roll_up", f"{J} SELECT batch_id, count(*) AS docs, sum(id % 12)::BIGINT AS before, sum(id % 5)::BIGINT AS after, round(sum(cost), 2) AS cost, list_sort(list(pages))[count(*) // 2 + 1] AS median_pages FROM jobs GROUP BY 1")
def e28(spark, sf):
    jobs = s.jobs(spark, sf)
    g = jobs.groupBy("batch_id").agg(F.count("*").alias("docs"), F.sum(F.col("id") % 12).alias("before"), F.sum(F.col("id") % 5).alias("after"), F.round(F.sum("cost"), 2).alias("cost"))
    return g.join(outcomes.order_statistic(jobs, "batch_id", "pages").withColumnRenamed("pages", "median_pages"), "batch_id")


@query("e29_batch_report", f"{J} SELECT count(*) AS docs, sum(greatest(id % 12 - id % 5, 0))::BIGINT AS fixed, count(*) FILTER (status <> 'completed') AS failures, round(sum(cost), 1) AS cost FROM jobs")
def e29(spark, sf):
    k = F.col("id")
    return s.jobs(spark, sf).agg(F.count("*").alias("docs"), F.sum(F.greatest(k % 12 - k % 5, F.lit(0))).alias("fixed"), F.sum((F.col("status") != "completed").cast("int")).alias("failures"), F.round(F.sum("cost"), 1).alias("cost"))


@query("e30_fix_roll_up", f"{J} SELECT status, count(*) AS n, sum(id % 12)::BIGINT AS before, sum(coalesce(CASE WHEN id % 3 <> 0 THEN id % 5 END, id % 12))::BIGINT AS after, round(100.0::DOUBLE * (sum(id % 12) - sum(coalesce(CASE WHEN id % 3 <> 0 THEN id % 5 END, id % 12))) / sum(id % 12), 4) AS reduction FROM jobs GROUP BY 1")
def e30(spark, sf):
    k = F.col("id")
    after = F.coalesce(F.when(k % 3 != 0, k % 5), k % 12)
    g = s.jobs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum(k % 12).alias("before"), F.sum(after).alias("after"))
    return g.select("*", F.round(100.0 * (F.col("before") - F.col("after")) / F.col("before"), 4).alias("reduction"))


@query("e31_compliance_swing", f"{J} SELECT count(*) FILTER (id % 12 = 0) AS compliant_before, count(*) FILTER (id % 5 = 0) AS compliant_after, count(*) FILTER (id % 5 < id % 12) AS better, count(*) FILTER (id % 5 = id % 12) AS same, count(*) FILTER (id % 5 > id % 12) AS worse FROM jobs")
def e31(spark, sf):
    a, b = F.col("id") % 12, F.col("id") % 5
    n = lambda c: F.sum(c.cast("int"))
    return s.jobs(spark, sf).agg(n(a == 0).alias("compliant_before"), n(b == 0).alias("compliant_after"), n(b < a).alias("better"), n(b == a).alias("same"), n(b > a).alias("worse"))


@query("e34_actions_by_type", f"WITH {PLAN} SELECT action_type, count(*) AS n, count(DISTINCT (doc_id, element_id)) AS elements FROM plan GROUP BY 1")
def e34(spark, sf):
    return page_plan(spark, sf).groupBy("action_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "element_id").alias("elements"))


REPORT = f"{q.LINES}, r AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN '[FAIL] ' || (pos // 4 % 3) WHEN pos % 4 = 3 THEN 'note' ELSE '- detail ' || pos END AS line FROM lines)"


def grouped_report(spark, sf):
    pos = F.col("pos")
    line = F.when(pos % 4 == 0, F.concat(F.lit("[FAIL] "), F.floor(pos / 4 % 3).cast("string"))).when(pos % 4 == 3, "note").otherwise(F.concat(F.lit("- detail "), pos.cast("string")))
    r = s.lines(spark, sf).select("doc_id", "pos", line.alias("line"))
    header = F.last(F.when(F.col("line").rlike(r"^\[(FAIL|WARN)\]"), F.col("line")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    return r.withColumn("header", header).where("line like '- %' and header is not null").select("doc_id", "header", "pos", F.expr("substring(line, 3)").alias("detail"))


GROUPED = f"{REPORT}, g AS (SELECT doc_id, pos, substr(line, 3) AS detail, last_value(CASE WHEN starts_with(line, '[') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS header, line FROM r)"


@query("e35_issue_groups", f"WITH {GROUPED} SELECT doc_id, header, count(*) AS n, string_agg(detail, ';' ORDER BY pos) AS details FROM g WHERE starts_with(line, '- ') AND header IS NOT NULL GROUP BY ALL")
def e35(spark, sf):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "detail"))), lambda x: x["detail"]), ";")
    return grouped_report(spark, sf).groupBy("doc_id", "header").agg(F.count("*").alias("n"), joined.alias("details"))


@query("e36_issue_summary", f"WITH {GROUPED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, header ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id, header) AS n FROM g WHERE starts_with(line, '- ') AND header IS NOT NULL) SELECT doc_id, header, string_agg(detail, '; ' ORDER BY pos) || CASE WHEN max(n) > 5 THEN ' ...and ' || (max(n) - 5) || ' more' ELSE '' END AS summary FROM n WHERE k <= 5 GROUP BY ALL")
def e36(spark, sf):
    w = Window.partitionBy("doc_id", "header")
    g = grouped_report(spark, sf).withColumn("k", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w)).where("k <= 5")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "detail"))), lambda x: x["detail"]), "; ")
    more = F.when(F.max("n") > 5, F.concat(F.lit(" ...and "), (F.max("n") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return g.groupBy("doc_id", "header").agg(F.concat(joined, more).alias("summary"))


@query("f10_queue_position", f"{J}, n AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs WHERE status = 'queued'), a AS (SELECT coalesce(avg(pages * 10.0::DOUBLE) FILTER (status = 'completed'), 180) AS seconds, bool_or(status = 'processing')::INT AS busy FROM jobs) SELECT id, position, round((position - 1 + busy) * seconds, 3) AS wait FROM n, a")
def f10(spark, sf):
    jobs = s.jobs(spark, sf)
    done = F.col("status") == "completed"
    whole = jobs.agg(F.coalesce(F.avg(F.when(done, F.col("pages") * 10.0)), F.lit(180.0)).alias("seconds"), F.max((F.col("status") == "processing").cast("int")).alias("busy"))
    return ledger.queue_positions(jobs).join(F.broadcast(whole)).select("id", "position", F.round((F.col("position") - 1 + F.col("busy")) * F.col("seconds"), 3).alias("wait"))


@query("g01_recent_jobs", f"{J} SELECT id, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 50")
def g01(spark, sf):
    return s.jobs(spark, sf).select("id", "created_at").sort(F.desc("created_at"), "id").limit(50)


# a batch here is one of 200, which grow with the ledger; elsewhere batches hold a number of jobs at most
@query("g02_batch_jobs", f"{J} SELECT id, created_at FROM (SELECT id, created_at, id % 200 AS batch_id FROM jobs) WHERE batch_id = 17")
def g02(spark, sf):
    return s.jobs(spark, sf).withColumn("batch_id", F.col("id") % 200).where("batch_id = 17").select("id", "created_at").sort(F.desc("created_at"), "id")


@query("g03_users_newest_first", "SELECT c_custkey AS user_id FROM customer")
def g03(spark, sf):
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).sort(F.desc("user_id"))


@query("g04_transactions", f"{J} SELECT id, cost FROM jobs WHERE user_id = 7")
def g04(spark, sf):
    return s.jobs(spark, sf).where("user_id = 7").select("id", "cost", "created_at").sort(F.desc("created_at")).select("id", "cost")


@query("g06_diverse_pick", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS n FROM documents) ORDER BY n, lang LIMIT 100")
def g06(spark, sf):
    n = F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id"))
    return s.table(spark, sf, "documents").select("doc_id", "lang", n.alias("n")).where("n <= 100").sort("n", "lang").limit(100).select("doc_id", "lang")


@query("h04_resume", f"{J} SELECT id FROM jobs a WHERE NOT EXISTS (SELECT 1 FROM jobs b WHERE b.status = 'completed' AND b.id = a.id AND b.id % 2 = 0)")
def h04(spark, sf):
    done = s.jobs(spark, sf).where("status = 'completed' and id % 2 = 0").select("id")
    return s.jobs(spark, sf).select("id").join(done, "id", "left_anti")


@query("h05_union_sources", "SELECT 'document' AS kind, doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages")
def h05(spark, sf):
    d = s.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"))
    return d.unionByName(s.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("chars")))


@query("h07_orphan_markers", "SELECT event_id, event_id * 7 % 50 AS mcid FROM events e WHERE event_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id // 100 = e.event_id // 100 AND r.event_id * 7 % 50 = e.event_id * 7 % 50 AND r.event_id % 3 = 0)")
def h07(spark, sf):
    k = F.col("event_id")
    e = s.table(spark, sf, "events").select("event_id", F.floor(k / 100).alias("page"), (k * 7 % 50).alias("mcid"))
    return e.where("event_id % 4 = 0").join(e.where("event_id % 3 = 0").select("page", "mcid"), ["page", "mcid"], "left_anti").select("event_id", "mcid")


@query("h08_image_dedup", f"WITH {q.BOXES} SELECT doc_id, page, n_chars AS xref, min(pos) AS pos FROM boxes WHERE x1 - x0 >= 70 GROUP BY ALL")
def h08(spark, sf):
    return s.boxes(spark, sf).where("x1 - x0 >= 70").groupBy("doc_id", "page", F.col("n_chars").alias("xref")).agg(F.min("pos").alias("pos"))


@query("j02_apply_actions", f"WITH {PLAN}, w AS (SELECT doc_id, seq, element_id, CASE WHEN seq % 9 = 5 THEN 'paint' ELSE action_type END AS action_type, CASE WHEN seq % 7 = 3 THEN '' ELSE value END AS value FROM plan) SELECT doc_id, seq, action_type, CASE WHEN action_type = 'paint' THEN 'skipped' WHEN value = '' THEN 'failed' WHEN action_type = 'set_link_text' AND substr(element_id, 6)::INT % 5 = 2 THEN 'failed' ELSE 'executed' END AS status FROM w")
def j02(spark, sf):
    k = F.col("seq")
    plan = page_plan(spark, sf).withColumn("action_type", F.when(k % 9 == 5, "paint").otherwise(F.col("action_type"))).withColumn("value", F.when(k % 7 == 3, "").otherwise(F.col("value")))
    known = s.faulty_anchors(spark, sf).where("pos % 5 <> 2").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("link_"), F.col("pos").cast("string")).alias("element_id"))
    return actions.outcome(plan, known).select("doc_id", "seq", "action_type", "status")


@query("j06_before_after", f"WITH {ISSUES}, b AS (SELECT page_id, count(*) AS before, count(*) FILTER (issue = 'same_text_different_url') AS after FROM issues GROUP BY 1) SELECT page_id, before, after, greatest(before - after, 0) AS fixed FROM b")
def j06(spark, sf):
    found = checks.link_issues(s.faulty_anchors(spark, sf))
    g = found.groupBy("page_id").agg(F.count("*").alias("before"), F.sum((F.col("issue") == "same_text_different_url").cast("int")).alias("after"))
    return g.select("page_id", "before", "after", F.greatest(F.col("before") - F.col("after"), F.lit(0)).alias("fixed"))


@query("k01_rate_limiter", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts::TIMESTAMP)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts::TIMESTAMP), event_id) AS n FROM events),
  w AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS n, []::DOUBLE[] AS kept, true AS allowed, 0::BIGINT AS retry FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT user_id, event_id, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(trunc(live[1] - (t - 36000.0))::BIGINT + 1, 1) END
      FROM (SELECT w.user_id, e.event_id, e.n, e.t, list_filter(w.kept, lambda x: x > e.t - 36000.0) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
  SELECT user_id, event_id, allowed, retry FROM w WHERE n > 0""")
def k01(spark, sf):
    e = s.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return ledger.rate_limit(e, 3, 36_000.0)


@query("k03_spend_caps", f"{J}, d AS (SELECT created_at AS day, sum(cost) AS c FROM jobs GROUP BY 1), w AS (SELECT day, round(c, 2) AS day_cost, round(sum(c) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 2) AS week_cost FROM d) SELECT *, CASE WHEN day_cost >= 900000 THEN 'daily_cap_exceeded' WHEN week_cost >= 5000000 THEN 'weekly_cap_exceeded' ELSE 'ok' END AS reason FROM w")
def k03(spark, sf):
    return ledger.spend_status(s.jobs(spark, sf).select(F.col("created_at").alias("day"), "cost"), 900_000, 5_000_000)


@query("k04_active_jobs", f"{J} SELECT user_id, count(*) FILTER (status IN ('queued', 'processing')) AS n FROM jobs GROUP BY 1")
def k04(spark, sf):
    return s.jobs(spark, sf).groupBy("user_id").agg(F.sum(F.col("status").isin("queued", "processing").cast("int")).alias("n"))


@query("k05_trailing_hour", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts::TIMESTAMP)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def k05(spark, sf):
    t = F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long")  # the nearest second, as in the SQL
    w = Window.partitionBy("user_id").orderBy(t).rangeBetween(-3600, 0)
    return s.table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("k06_user_caps", f"{J} SELECT user_id, CASE WHEN user_id % 50 = 0 THEN 'ok' WHEN count(*) FILTER (status IN ('queued', 'processing')) >= 6 THEN 'concurrent_cap' WHEN count(*) FILTER (created_at >= DATE '1999-01-01') >= 5 THEN 'hourly_cap' ELSE 'ok' END AS reason FROM jobs GROUP BY 1")
def k06(spark, sf):
    n = lambda c: F.sum(c.cast("int"))
    g = s.jobs(spark, sf).groupBy("user_id").agg(n(F.col("status").isin("queued", "processing")).alias("a"), n(F.col("created_at") >= F.lit("1999-01-01").cast("date")).alias("r"))
    return g.select("user_id", F.when(F.col("user_id") % 50 == 0, "ok").when(F.col("a") >= 6, "concurrent_cap").when(F.col("r") >= 5, "hourly_cap").otherwise("ok").alias("reason"))


@query("k09_recovery", f"{J} SELECT id, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS status FROM jobs")
def k09(spark, sf):
    return s.jobs(spark, sf).select("id", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")).alias("status"))


@query("l02_update_jobs", f"{J} SELECT batch_id, arg_max(status, id) AS status, max(id) AS id FROM jobs GROUP BY 1")
def l02(spark, sf):
    return ledger.latest(s.jobs(spark, sf).select("batch_id", "status", "id"), "batch_id", F.col("id"))


@query("l03_delete_jobs", f"{J} SELECT id FROM jobs WHERE NOT (user_id % 2 = 1 AND status = 'completed' AND id % 3 = 0)")
def l03(spark, sf):
    gone = s.jobs(spark, sf).where("user_id % 2 = 1 and status = 'completed' and id % 3 = 0").select("id")
    return s.jobs(spark, sf).join(gone, "id", "left_anti").select("id")


@query("l05_deduct_pages", f"""WITH RECURSIVE {J.removeprefix('WITH ')}, o AS (SELECT user_id, id, pages, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM jobs),
  w AS (SELECT user_id, NULL::BIGINT AS seq, 0::BIGINT AS n, true AS granted, 100::BIGINT AS balance FROM (SELECT DISTINCT user_id FROM jobs)
    UNION ALL SELECT w.user_id, o.id, o.n, o.pages <= w.balance, w.balance - CASE WHEN o.pages <= w.balance THEN o.pages ELSE 0 END FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
  SELECT user_id, seq, granted, balance FROM w WHERE n > 0""")
def l05(spark, sf):
    jobs = s.jobs(spark, sf)
    return ledger.deduct(jobs.select("user_id", F.col("id").alias("seq"), "pages", F.lit(100).cast("long").alias("start")))


@query("l06_refund_pages", f"{J} SELECT user_id, greatest(50 - sum(pages)::BIGINT, 0) AS documents FROM jobs GROUP BY 1")
def l06(spark, sf):
    return s.jobs(spark, sf).groupBy("user_id").agg(F.greatest(50 - F.sum("pages"), F.lit(0)).alias("documents"))


@query("l07_credit_purchases", f"{J} SELECT user_id, sum(p)::BIGINT AS credited FROM (SELECT DISTINCT user_id, id // 4 AS session, user_id % 7 + 1 AS p FROM jobs) GROUP BY 1")
def l07(spark, sf):
    once = s.jobs(spark, sf).select("user_id", F.floor(F.col("id") / 4).alias("session"), (F.col("user_id") % 7 + 1).alias("p")).dropDuplicates(["user_id", "session"])
    return once.groupBy("user_id").agg(F.sum("p").alias("credited"))


@query("l08_record_cost", f"{J} SELECT user_id, round(arg_max(cost, id), 6) AS cost FROM jobs GROUP BY 1")
def l08(spark, sf):
    return s.jobs(spark, sf).groupBy("user_id").agg(F.round(F.max_by("cost", "id"), 6).alias("cost"))


@query("a16_validator_report", "SELECT event_id, event_id % 4 = 0 AS compliant, event_id % 4 AS failed_rules FROM events")
def a16(spark, sf):
    k = F.col("event_id")
    report = F.concat(F.lit('{"report":{"jobs":[{"validationResult":{"compliant":'), F.when(k % 4 == 0, "true").otherwise("false"), F.lit(',"details":{"failedRules":'), (k % 4).cast("string"), F.lit("}}}]}}"))
    doc = F.from_json(report, "report struct<jobs: array<struct<validationResult: struct<compliant: boolean, details: struct<failedRules: long>>>>>")
    one = doc["report"]["jobs"][0]["validationResult"]
    return s.table(spark, sf, "events").select("event_id", F.coalesce(one["compliant"], one["details"]["failedRules"] == 0).alias("compliant"), one["details"]["failedRules"].alias("failed_rules"))


@query("a17_validation_result", "SELECT event_id, 'r' || (event_id % 3) AS rule, i AS n FROM events, range(3) g(i) WHERE i < event_id % 4")
def a17(spark, sf):
    k = F.col("event_id")
    one = F.concat(F.lit('{"rule":"r'), (k % 3).cast("string"), F.lit('"}'))
    text_ = F.concat(F.lit("["), F.array_join(F.array_repeat(one, (k % 4).cast("int")), ","), F.lit("]"))
    failed = F.from_json(text_, "array<struct<rule: string>>")
    return s.table(spark, sf, "events").select("event_id", F.posexplode(failed).alias("n", "x")).select("event_id", "x.rule", F.col("n").cast("long").alias("n"))


@query("a18_lenient_json", "SELECT event_id, len(json_keys(props::JSON))::INT AS n_keys, array_to_string(list_transform(list_sort(json_keys(props::JSON)), lambda k: k || '=' || json_extract_string(props::JSON, '$.' || k)), ';') AS pairs FROM events")
def a18(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k % 4 == 1, F.regexp_replace("props", r"\}$", ",}")).when(k % 4 == 2, F.regexp_replace("props", '"', "'")).otherwise(F.concat(F.lit("Here: "), F.col("props"), F.lit(" done")))
    fences = F.regexp_replace(raw, r"(?s)^\s*```(json)?\s*|\s*```\s*$", "")
    commas = F.regexp_replace(fences, r",\s*([}\]])", "$1")
    quotes = F.regexp_replace(commas, "'", '"')
    inner = F.regexp_extract(quotes, r"(?s)(\{.*\})", 1)
    schema = "map<string, string>"
    ok = lambda c: F.try_parse_json(c).isNotNull()
    best = F.when(ok(raw), raw).when(ok(fences), fences).when(ok(commas), commas).when(ok(quotes), quotes).otherwise(inner)
    found = s.table(spark, sf, "events").select("event_id", F.from_json(best, schema).alias("m"))
    pairs = F.array_join(F.transform(F.sort_array(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k))), ";")
    return found.select("event_id", F.size("m").alias("n_keys"), pairs.alias("pairs"))


@query("b05_contrast_repair", f"WITH {q.COLOURS}, pairs AS (SELECT DISTINCT fg, bg, size, bold FROM colours), {q.REPAIRED} SELECT fg, bg, size, bold, fixed FROM repaired")
def b05(spark, sf):
    pairs = s.colours(spark, sf).select("fg", "bg", "size", "bold").distinct()
    return pairs.withColumn("fixed", repaired("fg", "bg", "size", "bold"))


@query("a06_markdown_lines", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, CASE WHEN heading_level IS NOT NULL THEN 'heading' WHEN {LIST_TYPE} IS NOT NULL THEN 'item' ELSE 'paragraph' END AS kind FROM faulty")
def a06(spark, sf):
    md = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    kind = F.when(md.rlike(r"^#{1,6}\s"), "heading").when(text.list_type(md).isNotNull(), "item").otherwise("paragraph")
    return s.faulty_lines(spark, sf).select("doc_id", "pos", kind.alias("kind"))
