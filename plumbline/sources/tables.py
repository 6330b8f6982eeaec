"""The given tables, and frames of the document model derived from them by integer arithmetic.

Rules such as contrast or list detection need colours, boxes, fonts and faults that no given table holds; they are derived from
unique keys, so that each branch of a rule occurs. Each frame here has its SQL twin in ``plumbline.sources.twins``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.spread import dealt_out
from plumbline.sources import html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, text: a paragraph for each line of a document, if its doc_id is among those given: whole texts are looked up, not their lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs if among is None else docs.join(among, "doc_id", "left_semi")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


#: Characters of texts that are dealt out to one task.
TEXT_PER_TASK = 4_000_000


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, dealt out by doc_id: what is made of a text and then grouped or sorted within its document isn't shuffled again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dealt_out(docs, "doc_id", of=docs, size=F.length("text"), most=TEXT_PER_TASK)


def faulty_lines(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """lines with list prefixes, citations, page headers and captions put in by position."""
    t, pos = F.col("text"), F.col("pos")
    out = (
        F.when((pos % 7).isin(1, 2, 3), F.concat((pos % 7).cast("string"), F.lit(". "), t))
        .when(pos % 7 == 5, F.concat(F.lit("- "), t))
        .when(pos % 11 == 4, F.concat(t, F.lit(" et al. (2019)")))
        .when(pos % 13 == 6, F.concat((pos + 100).cast("string"), F.lit(" MAYER SMITH")))
        .when(pos % 17 == 0, F.concat(F.lit("Table "), (pos + 1).cast("string"), F.lit(". "), t))
        .when(pos % 19 == 7, pos.cast("string"))
        .otherwise(t)
    )
    level = F.when(pos % 5 == 0, F.lit(1) + (F.col("doc_id") + pos) % 4).cast("int")
    return lines(spark, sf_dir, among).select("doc_id", "pos", out.alias("text"), level.alias("heading_level"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, fg, bg, size, bold: text runs with colours, from customers."""
    k = F.col("c_custkey")
    hex_ = lambda a, b, c: F.format_string("#%02X%02X%02X", *((k * n % 256).cast("int") for n in (a, b, c)))
    bg = F.when(k % 3 == 0, "#FFFFFF").when(k % 3 == 1, "#F5F5F0").otherwise(hex_(7, 11, 13))
    fg = F.when(k % 10 == 0, F.format_string("#%02X%02X%02X", (200 + k % 56).cast("int"), (200 + k * 3 % 56).cast("int"), (k % 100).cast("int"))).otherwise(hex_(37, 91, 53))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.floor(k / 30).alias("doc_id"), fg.alias("fg"), bg.alias("bg"), (8 + k % 15).cast("double").alias("size"), (k % 3 == 0).alias("bold"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, n_chars, size, bold, font: a run of one font for each event."""
    k = F.col("event_id")
    fonts = F.when(k % 4 == 0, "ABCDEF+TimesNewRomanPS-BoldMT").when(k % 4 == 1, "TimesNewRomanPSMT").when(k % 4 == 2, "GHIJKL+Century-Italic").otherwise("Arial-BoldItalic")
    return table(spark, sf_dir, "events").select(
        F.floor(k / 250).alias("doc_id"), (k % 250).alias("pos"), (1 + k * 7 % 90).alias("n_chars"), (5 + k % 9 + (k % 10) / 10.0).alias("size"), (k % 3 == 0).alias("bold"), fonts.alias("font")
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, text, url of each link of a page."""
    p = r'<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(p), F.lit(2)).alias("text"), F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(both).alias("pos", "a")).select("page_id", "pos", "a.text", "a.url")


def faulty_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchors with empty, vague and bare texts and broken addresses put in by position."""
    text, url, pos = F.col("text"), F.col("url"), F.col("pos")
    n = (F.col("page_id") + pos) % 8
    bad_text = F.when(pos % 6 == 0, "").when(pos % 6 == 1, "click here").when(pos % 6 == 2, "Read more.").when(pos % 6 == 3, url).otherwise(text)
    bad_url = (
        F.when(n == 0, F.regexp_replace(url, "://", ":/"))
        .when(n == 1, F.regexp_replace(url, "://", ":////"))
        .when(n == 2, F.regexp_replace(url, r"://([^/]*)/", "://$1 /"))
        .when(n == 3, F.lit("mailto: u@ ex.com"))
        .when(n == 4, F.concat(url, F.lit("/a b")))
        .otherwise(url)
    )
    return anchors(spark, sf_dir).select("page_id", "pos", bad_text.alias("text"), bad_url.alias("url"))


def alts(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, alt, decorative: an image for each line, its alternative text the first words of the line."""
    pos = F.col("pos")
    words = F.array_join(F.slice(F.split("text", " "), 1, (F.lit(1) + pos % 18).cast("int")), " ")
    key = (F.col("doc_id") + pos) % 9
    alt = (
        F.when(key == 0, "")
        .when(key == 1, F.concat(F.lit("Image of "), words))
        .when(key == 2, F.concat(F.lit("Figure "), pos.cast("string")))
        .when(key == 3, F.concat(words, F.lit(" Description automatically generated")))
        .when(key == 4, F.concat(F.lit("scan_"), pos.cast("string"), F.lit(".jpg")))
        .when(key == 5, F.concat(F.lit("A picture containing "), words))
        .otherwise(words)
    )
    return lines(spark, sf_dir, among).select("doc_id", "pos", alt.alias("alt"), ((F.col("doc_id") + pos) % 11 == 3).alias("decorative"))


def cells(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """table_id, r, c, text, span, header: cells of a grid for each order, if the document of its forty is among those given."""
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    orders = orders if among is None else orders.join(among, F.floor(o / 40) == F.col("doc_id"), "left_semi")
    grid = orders.select(o.alias("table_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"))
    r, c, t = F.floor(F.col("n") / 3).cast("int"), (F.col("n") % 3).cast("int"), F.col("table_id")
    rows, cols = 1 + t % 4, 1 + t * 7 % 3
    text = F.when((t + F.col("n")) % (2 + t % 5) == 0, "").when((t % 11 == 5) & (c == 0), F.concat(F.lit("• item "), F.col("n").cast("string"))).when((t % 13 == 2) & (c == 1), F.repeat(F.lit("long cell text "), 12)).otherwise(F.concat(F.lit("v"), (t * 31 % 97 + F.col("n")).cast("string")))
    return grid.where((r < rows) & (c < cols)).select("table_id", r.alias("r"), c.alias("c"), text.alias("text"), F.when((t + F.col("n")) % 7 == 0, 2).otherwise(1).alias("span"), F.when(t % 2 == 0, 1).otherwise(0).alias("header_rows"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, pos, x0, y0, x1, y1, n_chars: text blocks with boxes, from parts; furniture at the top of pages, and a page in seven nearly without text."""
    p = F.col("p_partkey")
    x, y = 40 + p * 13 % 400, 30 + p * 29 % 700
    chars = F.when(F.floor(p / 20) % 7 == 3, p % 3).when(y < 80, 40 + p % 2).otherwise(p % 37)
    return table(spark, sf_dir, "part").select(F.floor(p / 100).alias("doc_id"), (F.floor(p / 20) % 5).cast("int").alias("page"), (p % 20).alias("pos"), x.alias("x0"), y.alias("y0"), (x + 60 + p % 90).alias("x1"), (y + 12).alias("y1"), chars.alias("n_chars"))


def outlined(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """faulty_lines with bold, size and font; a document in three has levels without a gap and nothing bold."""
    pos, tidy = F.col("pos"), F.col("doc_id") % 3 == 1
    level = F.when(tidy & (pos == 0), 1).when(tidy & (pos % 5 == 0), 2 + F.floor(pos / 10) % 2).when(~tidy, F.col("heading_level")).cast("int")
    size = F.when(pos % 5 == 0, 16.0).when(pos % 7 == 0, 9.0).otherwise(11.0)
    return faulty_lines(spark, sf_dir, among).select("doc_id", "pos", "text", level.alias("heading_level"), (~tidy & ((F.col("doc_id") + pos) % 4 == 0)).alias("bold"), size.alias("size"), F.lit("Arial").alias("font"))


def document_tables(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """cells of the tables of documents, forty each; those of every second document have a header row and no merged cells."""
    doc = F.floor(F.col("table_id") / 40)
    tidy = doc % 2 == 0
    return cells(spark, sf_dir, among).select(doc.alias("doc_id"), "table_id", "r", "c", "text", F.when(tidy, 1).otherwise(F.col("span")).alias("span"), F.when(tidy, 1).otherwise(F.col("header_rows")).alias("header_rows"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, status, created_at, cost, pages, batch_id: the ledger, from orders."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), F.col("o_totalprice").cast("double").alias("cost"), (1 + F.col("o_orderkey") % 30).alias("pages"), F.floor(F.col("o_orderkey") / 50).alias("batch_id")
    )




def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: pages whose article also has headings, formulas, equations, tables (nested, with and without head), images, error marks and an open paragraph, chosen by page_id."""
    k, page = F.col("page_id").cast("string"), F.col("page_id")
    lit, join = F.lit, F.concat
    when = lambda c, *parts: F.when(c, join(*parts)).otherwise("")
    mark = lambda s: f'<span class="ltx_ERROR undefined">{s}</span>'
    extra = join(
        lit('<h2 class="ltx_title">Part &amp; '), k, lit('</h2><p class="ltx_p">Let <math alttext="x_'), k, lit('" display="inline"><mi>x</mi></math> be <i>real</i>.</p>'),
        when(page % 3 == 0, lit('<table class="ltx_equation ltx_eqn"><tr><td><p>in</p><math class="ltx_math_unparsed" alttext="E='), k, lit('"><mi>E</mi></math></td><td><span class="ltx_tag ltx_tag_equation">('), k, lit(")</span></td></tr></table>")),
        lit('<table class="ltx_tabular">'), when(page % 2 == 0, lit("<thead><tr><th>Name</th><th> Value</th></tr></thead>")), lit("<tbody><tr><td>x <b>y</b></td><td>"), k,
        when(page % 5 == 0, lit("<table><tr><td>inner</td></tr></table>after")), lit("</td></tr><tr></tr><tr><td>last</td></tr></tbody></table>"),
        when(page % 4 == 0, lit(f"<p>{mark('\\draw')} (0,0) -- (1,1);</p>")),
        when(page % 4 == 1, lit(f"<p>Some text. {mark('\\badcmd')} More {mark('\\sc kept')}.</p>")),
        when(page % 4 == 2, lit(f"<p>{mark('\\Function')} <span class=\"ltx_ERROR\">{{F"), k, lit(f"}}</span> {mark('{x}')} {mark('\\State')} {mark('\\Return')} {mark('x')}</p>")),
        lit('<p>next <img src="fig_'), k, F.when(page % 7 == 0, '.jpg"').otherwise('.png"'), when(page % 3 != 1, lit(' alt="Figure of '), k, lit('"')), lit("> para"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</article>"), F.concat(extra, F.lit("</article>"))).alias("html"))


def page_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The document model of rich_pages: paragraphs, tables, cells, images, math, order."""
    return html.model(rich_pages(spark, sf_dir))
