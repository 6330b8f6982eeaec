"""Ordered scans over paragraphs, lines and boxes as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.spread import in_parts


def along(*order, by=("doc_id",)):
    return Window.partitionBy(*by).orderBy(*order)


def before(c: Column, w) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def depths(tree: DataFrame, written) -> DataFrame:
    """tree (id, parent, doc_id) with depth, 0 at the roots: each round doubles how far up an element looks, so a tree d levels deep takes log d of them.

    written stores a round's rows and gives them back. Elements on a cycle, or under a parent that isn't there, have no depth and are left out.
    """
    p = tree.select("id", "doc_id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    left = None
    while True:
        p = written(p)
        n, open_ = p.count(), p.where("up is not null").count()
        if not open_ or open_ == left:
            return p.where("up is null").drop("up")
        left = open_
        above = p.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("depth").alias("_more"))
        # decided elements stay where they are: they have nothing to be dealt out by, and would meet in one task
        done, going = p.where("up is null"), in_parts(p.where("up is not null"), n, "up").join(in_parts(above, n, "up"), "up", "left")
        p = done.union(going.select("id", "doc_id", F.when(F.col("_more").isNull(), F.col("up")).otherwise(F.col("_next")).alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))


# The standard structure types.
STANDARD_TAGS = (
    "Document", "Part", "Art", "Article", "Sect", "Div", "P", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot",
    "H1", "H2", "H3", "H4", "H5", "H6", "H", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Form", "Formula", "Figure", "Artifact",
)


def nearest_above(tree: DataFrame, tag: str, written) -> DataFrame:
    """id, above of the elements (id, parent, tag) that have one of that tag over them: the nearest one. Each round doubles how far up an element looks."""
    named = tree.select(F.col("id").alias("up"), F.when(F.col("tag") == tag, F.col("id")).alias("above"))
    n = tree.count()
    p = in_parts(tree.where("parent is not null").select("id", F.col("parent").alias("up")), n, "up").join(in_parts(named, n, "up"), "up", "left").select("id", "up", "above")
    while True:
        p = written(p)
        todo = p.where("above is null and up is not null").count()
        if not todo:
            return p.where("above is not null").select("id", "above")
        further = p.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("above").alias("_above"))
        done, left = p.where("above is not null or up is null"), p.where("above is null and up is not null")
        moved = in_parts(left, n, "up").join(in_parts(further, n, "up"), "up", "left").select("id", F.when(F.col("_above").isNull(), F.col("_up")).alias("up"), F.col("_above").alias("above"))
        p = done.union(moved)


def tree_facts(docs: DataFrame, tree: DataFrame, annotations: DataFrame, written) -> DataFrame:
    """A row of counters for each document (doc_id, is_marked), of its structure tree (doc_id, id, parent, tag, alt, actual_text) and its link annotations (doc_id, uri, has_alt, tied).

    Only elements that hang together with a root count. tables_with_th credits all tables of a document that has a header cell anywhere; tables_with_own_th are those with one below them.
    """
    reached = depths(tree, written).select("id", "depth")
    n = reached.count()
    e = written(in_parts(tree, n, "id").join(in_parts(reached, n, "id"), "id"))
    tag = F.col("tag")
    of = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    figure, told = tag == "Figure", F.col("alt") != ""
    counts = in_parts(e, n, "doc_id").groupBy("doc_id").agg(
        F.count("tag").alias("elements"), F.max("depth").alias("depth"), of(~tag.isin(*STANDARD_TAGS), "custom"), of(figure, "figures"), of(figure & told, "figures_with_alt"), of(figure & F.col("actual_text"), "figures_with_actual_text"), of(tag == "Table", "tables"), of(tag == "TH", "th"),
        of(tag.rlike("^H[1-6]?$"), "headings"), of(tag == "Link", "links"), of(tag == "P", "paragraphs"), of(tag == "Span", "spans"), of(tag == "L", "lists"),
    )
    own = in_parts(nearest_above(e, "Table", written), n, "id").join(in_parts(e.where("tag = 'TH'").select("id", "doc_id"), n, "id"), "id").groupBy("doc_id").agg(F.count_distinct("above").alias("tables_with_own_th"))
    linked = in_parts(annotations, annotations.count(), "doc_id").groupBy("doc_id").agg(F.count("*").alias("annotations"), of(F.col("uri").startswith("http") | F.col("uri").startswith("mailto:"), "annotations_valid"), of(F.col("has_alt"), "annotations_with_alt"), of(F.col("tied"), "annotations_tied"))
    out = docs.join(counts, "doc_id", "left").join(own, "doc_id", "left").join(linked, "doc_id", "left")
    credited = F.when((F.col("tables") > 0) & (F.col("th") > 0), F.col("tables")).otherwise(0)
    out = out.select("*", F.col("elements").isNotNull().alias("has_tree"), F.round(F.col("custom") / F.col("elements"), 6).alias("custom_ratio"), credited.alias("tables_with_th"))
    return out.fillna(0, [c for c in out.columns if c not in ("doc_id", "is_marked", "has_tree", "depth", "custom_ratio")])


def heading_issues(paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos, issue, suggested of paragraphs (doc_id, pos, heading_level): no first level, several, skipped levels."""
    w = along("pos")
    level = F.col("heading_level")
    headings = paragraphs.where(level.isNotNull()).select("doc_id", "pos", "heading_level")
    all_ = Window.partitionBy("doc_id")
    h = headings.select(
        "*", F.lag("heading_level").over(w).alias("last"), F.row_number().over(w).alias("n"), before((level == 1).cast("int"), w).alias("nth_h1"), F.sum((level == 1).cast("int")).over(all_).alias("h1s")
    )
    found = F.filter(
        F.array(
            F.when((F.col("n") == 1) & (F.col("h1s") == 0), F.struct(F.lit("no_h1").alias("issue"), F.lit(1).alias("suggested"))),
            F.when((level == 1) & (F.col("nth_h1") > 1), F.struct(F.lit("multiple_h1").alias("issue"), F.lit(2).alias("suggested"))),
            F.when(level > F.col("last") + 1, F.struct(F.lit("skipped_level").alias("issue"), (F.col("last") + 1).alias("suggested"))),
        ),
        lambda x: x.isNotNull(),
    )
    return h.select("doc_id", "pos", F.explode(found).alias("x")).select("doc_id", "pos", "x.issue", "x.suggested")


def fake_lists(paragraphs: DataFrame) -> DataFrame:
    """Maximal runs of two or more items of one list type; headings and other text break them."""
    kind = F.when(F.col("heading_level").isNull(), text.list_type(F.col("text")))
    w = along("pos")
    p = paragraphs.select("doc_id", "pos", kind.alias("list_type"))
    p = p.withColumn("new", (~F.coalesce(F.lag("list_type").over(w) == F.col("list_type"), F.lit(False))).cast("int"))
    p = p.withColumn("run", before(F.col("new"), w)).where("list_type is not null")
    runs = p.groupBy("doc_id", "run", "list_type").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("items"))
    return runs.where("items >= 2").select("doc_id", "list_type", "first", "last", "items", F.round(F.least(0.5 + F.col("items") * 0.1, F.lit(1.0)), 3).alias("confidence"))


def cluster_penalty(scored: DataFrame) -> DataFrame:
    """Scores less 0.15 (not below 0) in runs of five or more consecutive paragraphs that score 0.5 or more."""
    w = along("pos")
    high = F.coalesce(F.col("score") >= 0.5, F.lit(False))
    s = scored.withColumn("_run", before((~high).cast("int"), w)).withColumn("_high", high)
    size = F.sum(F.col("_high").cast("int")).over(Window.partitionBy("doc_id", "_run"))
    return s.withColumn("score", F.when(F.col("_high") & (size >= 5), F.round(F.greatest(F.col("score") - 0.15, F.lit(0.0)), 3)).otherwise(F.col("score"))).drop("_run", "_high")


def fake_heading_scores(paragraphs: DataFrame, weights: dict[str, float], larger_by: float = 2.0, citations: bool = True, bold_only: bool = False) -> DataFrame:
    """Scores paragraphs (doc_id, pos, text, bold, size, font) against their document's median size and dominant font.

    citations: text like a citation loses 0.30; bold_only: only bold paragraphs are candidates.
    """
    w = along("pos")
    p = paragraphs.withColumn("_next_bold", F.lead("bold").over(w))
    everything = Window.partitionBy("doc_id")
    median = F.percentile("size", F.lit(0.5)).over(everything)
    base = text.base_font(F.col("font"))
    fonts = paragraphs.select("doc_id", base.alias("_base"), F.length("text").alias("n"), "pos").groupBy("doc_id", "_base").agg(F.sum("n").alias("n"), F.min("pos").alias("first"))
    dominant = fonts.groupBy("doc_id").agg(F.max_by("_base", F.struct("n", -F.col("first"))).alias("_dominant"))
    p = p.withColumn("_median", median).join(dominant, "doc_id")
    bold, big, other = F.col("bold"), F.col("size") >= F.col("_median") + larger_by, base != F.col("_dominant")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = weights["bold"] * one(bold) + weights["size"] * one(big) + weights["short"] * one(text.n_words(F.col("text")) < 10) + weights["followed"] * one(F.coalesce(~F.col("_next_bold"), F.lit(False))) + weights["always"] + weights["font"] * one(other)
    if citations:
        score = F.when(text.is_citation(F.col("text")), F.greatest(score - 0.30, F.lit(0.0))).otherwise(score)
    return p.select("doc_id", "pos", F.when(bold if bold_only else bold | big | other, F.round(score, 3)).alias("score"))


def duplicates(paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos of the paragraphs that stay: short ones always, else the first of each normal form or 60-character start."""
    t = text.strip(F.col("text"))
    form = text.dedup_form(F.col("text"))
    key = F.when(F.length(form) >= 60, F.substring(form, 1, 60)).otherwise(form)
    p = paragraphs.select("doc_id", "pos", (F.length(t) <= 50).alias("_short"), key.alias("_key"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_short", "_key").orderBy("pos"))
    return p.withColumn("_n", nth).where("_short or _n = 1").select("doc_id", "pos")


def table_spans(paragraphs: DataFrame) -> DataFrame:
    """doc_id, caption, pos of the paragraphs after a table caption up to a heading, a caption, long text or a sentence."""
    w = along("pos")
    t = text.strip(F.col("text"))
    is_caption = t.rlike(text.CAPTION)
    stop = F.col("heading_level").isNotNull() | is_caption | (F.length(t) > 200) | (t.rlike(r"^.{10,}\.\s*$") & (text.n_words(t) >= 2))
    p = paragraphs.select("doc_id", "pos", is_caption.alias("c"), stop.alias("s"))
    p = p.withColumn("caption", F.last(F.when(F.col("c"), F.col("pos")), ignorenulls=True).over(w))
    p = p.withColumn("stops", F.sum((F.col("s") & ~F.col("c")).cast("int")).over(along("pos", by=("doc_id", "caption")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return p.where("caption is not null and not c and stops = 0").select("doc_id", "caption", "pos")


def data_tables(cells: DataFrame) -> DataFrame:
    """table_id, reason: empty for a real data table, else the first rule that rejects it."""
    t = text.strip(F.col("text"))
    c = cells.withColumn("n", F.length(t)).withColumn("filled", t != "")
    mark = t.rlike(r"^[•‣◦▪●○–—∙·\-\*]\s*$") | t.rlike(r"^\d{1,3}[\.\)]\s*$")
    top, first = F.col("r") == 0, F.col("c") == 0
    count = lambda x: F.sum(x.cast("int"))
    whole = c.groupBy("table_id").agg(
        (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("*").alias("cells"), count(~F.col("filled")).alias("empty"), F.sum("n").alias("chars"),
        count(first & F.col("filled")).alias("first_filled"), count(first & F.col("filled") & mark).alias("first_marked"),
        ((count(top & F.col("filled")) >= 2) & (F.max(F.when(top, F.col("n"))) < 50)).alias("header"),
    )
    columns = c.groupBy("table_id", "c").agg(F.sum("n").alias("n"), count(F.col("filled")).alias("filled"))
    columns = columns.groupBy("table_id").agg(F.max("n").alias("most"), F.min(F.when((F.col("filled") >= 3) & (F.col("n") / F.col("filled") > 120), F.col("c"))).alias("prose"))
    j = whole.join(columns, "table_id")
    col = F.col
    reason = (
        F.when(col("cols") <= 1, "single-column table")
        .when(col("rows") <= 1, "single-row table")
        .when((col("rows") <= 2) & (col("cols") <= 2), "very small table (<=2x2)")
        .when(col("empty") / col("cells") > 0.6, "over 60% empty cells")
        .when(col("first_marked") > 0.5 * col("first_filled"), "bullet/number first column (formatted list)")
        .when(~col("header") & (col("most") > 0.85 * col("chars")), "single column dominates text (likely list)")
        .when(~col("header") & col("prose").isNotNull(), F.concat(F.lit("column "), col("prose").cast("string"), F.lit(" has very long text (likely prose/references)")))
        .otherwise("")
    )
    return j.select("table_id", reason.alias("reason"))


def displacement(blocks: DataFrame) -> DataFrame:
    """doc_id, displacement: mean over the first pages of how far blocks' stream ranks are from their visual ranks."""
    b = blocks.where("n_chars > 10 and page < 5")
    page = ("doc_id", "page")
    stream, visual = F.row_number().over(along("pos", by=page)), F.row_number().over(along(F.bround(F.col("y0") / 15, 0), "x0", "pos", by=page))
    b = b.select(*page, stream.alias("s"), visual.alias("v"))
    pages = b.groupBy(*page).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("s") - F.col("v"))).alias("d")).where("n >= 3")
    return pages.groupBy("doc_id").agg(F.round(F.avg(F.col("d") / F.greatest(F.col("n") * F.col("n") / 2, F.lit(1.0))), 6).alias("displacement"))


def page_jumps(blocks: DataFrame) -> DataFrame:
    """doc_id, page, jumps, steps: steps that go up by more than 20 points, short blocks at the edges left out."""
    b = blocks.where("not ((y0 < 80 or y0 > 680) and n_chars < 80)")
    b = b.withColumn("up", F.col("y0") < F.lag("y0").over(along("pos", by=("doc_id", "page"))) - 20)
    return b.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("up"), F.lit(False)).cast("int")).alias("jumps")).where("n >= 3").select("doc_id", "page", "jumps", (F.col("n") - 1).alias("steps"))


def interleaved(blocks: DataFrame, width: float = 612.0) -> DataFrame:
    """doc_id, page, interleaved: two columns between which the order of blocks switches more than three times."""
    left = (F.col("x0") + F.col("x1")) / 2 < width / 2 * 0.85
    b = blocks.withColumn("left", left)
    b = b.withColumn("switch", F.coalesce(F.col("left") != F.lag("left").over(along("pos", by=("doc_id", "page"))), F.lit(False)))
    g = b.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.col("left").cast("int")).alias("l"), F.sum(F.col("switch").cast("int")).alias("s"))
    return g.select("doc_id", "page", ((F.col("n") >= 4) & (F.col("l") >= 2) & (F.col("n") - F.col("l") >= 2) & (F.col("s") > 3)).alias("interleaved"))


def size_stats(runs: DataFrame) -> DataFrame:
    """doc_id, font, sizes at the fixed places n // 4, n // 2, 3 n // 4, of the font with the most characters."""
    font = F.regexp_replace("font", r"^[^+]{6}\+", "")
    r = runs.select("doc_id", font.alias("font"), F.round("size", 1).alias("size"), "n_chars", "pos")
    fonts = r.groupBy("doc_id", "font").agg(F.sum("n_chars").alias("chars"), F.min("pos").alias("first"), F.sort_array(F.collect_list("size")).alias("s"))
    top = fonts.groupBy("doc_id").agg(F.max_by(F.struct("font", "chars", "s"), F.struct("chars", -F.col("first"))).alias("x")).select("doc_id", "x.*")
    n = F.size("s")
    at = lambda k: F.element_at(F.col("s"), (F.floor(k) + 1).cast("int"))
    below = lambda x: F.round(F.size(F.filter("s", lambda v: v < x)) / n, 6)
    return top.select("doc_id", "font", "chars", n.alias("n"), at(F.lit(0)).alias("least"), at(n / 4).alias("p25"), at(n / 2).alias("median"), at(n * 3 / 4).alias("p75"), F.element_at("s", -1).alias("most"), below(8.0).alias("below_8"), below(8.5).alias("below_85"), below(9.0).alias("below_9"))
