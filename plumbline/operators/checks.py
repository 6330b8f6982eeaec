"""Checks of documents: findings, roll-ups and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import colour, text
from plumbline.operators import structure


def link_issues(links: DataFrame) -> DataFrame:
    """page_id, pos, issue: broken addresses, and the first of empty, bare or vague texts, else one text for several addresses."""
    t = text.strip(F.col("text"))
    broken = F.when(text.repair_uri(F.col("url")).isNotNull(), "broken_uri")
    own = F.when(t == "", "empty_text").when(text.is_url(t), "bare_url").when(text.is_vague(t), "vague_text")
    l = links.select("page_id", "pos", "url", F.lower(t).alias("low"), broken.alias("broken"), own.alias("own"))  # noqa: E741
    same = Window.partitionBy("page_id", "own", "low")
    many = F.min("url").over(same) != F.max("url").over(same)
    l = l.withColumn("own", F.coalesce("own", F.when(many, "same_text_different_url")))  # noqa: E741
    return l.select("page_id", "pos", F.explode(F.array_compact(F.array("broken", "own"))).alias("issue"))


def roll_up(checks: DataFrame, key: str) -> DataFrame:
    """key, counts of statuses and the overall status: fail if any fails, else warn if any warns, else pass."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    g = checks.groupBy(key).agg(n("pass").alias("passed"), n("fail").alias("failed"), n("warn").alias("warnings"), n("na").alias("not_applicable"))
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    summary = F.concat_ws(", ", part("failed", "failed"), part("warnings", "warnings"), part("passed", "passed"), part("not_applicable", "N/A"))
    return g.select("*", F.when(F.col("failed") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass").alias("status"), summary.alias("summary"))


def structure_check(paragraphs: DataFrame, candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, status, items, issues of 1.3.1: headings in disguise, tables without header cells or with merged ones, levels of headings.

    paragraphs: doc_id, pos, heading_level; candidates: doc_id of each paragraph that looks like a heading; tables: doc_id, issues, th (header cells), tagged (whether the
    document has a tree of tags, where one table without header cells among several is another issue). Skipped levels and a missing first level fail, all else warns.
    """
    levels = structure.heading_issues(paragraphs).groupBy("doc_id").agg(F.count("*").alias("of_levels"), F.bool_or(F.col("issue").isin("skipped_level", "no_h1")).alias("errors"))
    bare = F.sum((F.col("tagged") & (F.col("th") == 0)).cast("int"))
    t = tables.groupBy("doc_id").agg(F.count("*").alias("tables"), (F.sum("issues") + F.when(F.count("*") > 1, bare).otherwise(0)).alias("of_tables"))
    d = paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    for part in (levels, candidates.groupBy("doc_id").agg(F.count("*").alias("disguised")), t):
        d = d.join(part, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = d.select("doc_id", "errors", (F.col("paragraphs") + n("tables")).alias("items"), (n("of_levels") + n("disguised") + n("of_tables")).alias("issues"))
    return d.select("doc_id", F.when(F.col("errors"), "fail").when(F.col("issues") > 0, "warn").otherwise("pass").alias("status"), "items", "issues")


def document_checks(pages: DataFrame, links: DataFrame, images: DataFrame, runs: DataFrame, structure_: DataFrame) -> DataFrame:
    """page_id, criterion, status, items, issues: all seven checks of every page.

    pages: page_id, html, read once; links: page_id, pos, text, url; images: doc_id, alt, decorative; runs: doc_id, fg, bg, size, bold; structure_: what structure_check gives. Those
    with a doc_id belong to the page of that number; a page without images, links or runs isn't judged by them, one without paragraphs has no structure to fault.
    """
    found = lambda p: text.strip(F.regexp_extract("html", p, 1)) != ""
    heads = F.transform(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1)), text.strip)
    p = pages.select("page_id", found("<title>([^<]*)</title>").alias("title"), found('<html lang="([^"]*)"').alias("lang"), F.size(heads).alias("heads"), F.size(F.filter(heads, lambda x: F.length(x) < 2)).alias("short"))
    contrast = contrast_check(runs)
    parts = {
        "link": links.groupBy("page_id").agg(F.count("*").alias("link_items")),
        "linked": link_issues(links).groupBy("page_id").agg(F.count("*").alias("link_issues")),
        "alt": alt_check(images).toDF("page_id", "alt_status", "alt_items", "alt_issues"),
        "contrast": contrast.select(F.col("doc_id").alias("page_id"), F.col("items").alias("run_items"), F.col("issues").alias("run_issues")),
        "structure": structure_.select(F.col("doc_id").alias("page_id"), F.col("status").alias("structure_status"), F.col("items").alias("structure_items"), F.col("issues").alias("structure_issues")),
    }
    for part in parts.values():
        p = p.join(part, "page_id", "left")

    def check(name: str, status: Column, items: Column, issues: Column) -> Column:
        whole = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
        return F.struct(F.lit(name).alias("criterion"), status.alias("status"), whole(items).alias("items"), whole(issues).alias("issues"))

    c = F.col
    yes = lambda name, ok: check(name, F.when(c(ok), "pass").otherwise("fail"), F.lit(1), F.when(c(ok), 0).otherwise(1))
    any_ = lambda items, issues: F.when(c(items).isNull(), "na").when(c(issues) > 0, "fail").otherwise("pass")
    untitled = F.when(c("heads") == 0, 1).otherwise(c("short"))
    checks = F.array(
        check("1.1.1", F.coalesce("alt_status", F.lit("na")), c("alt_items"), c("alt_issues")),
        check("1.3.1", F.coalesce("structure_status", F.lit("pass")), c("structure_items"), c("structure_issues")),
        check("1.4.3", any_("run_items", "run_issues"), c("run_items"), c("run_issues")),
        yes("2.4.2", "title"),
        check("2.4.4", any_("link_items", "link_issues"), c("link_items"), c("link_issues")),
        check("2.4.6", F.when(untitled > 0, "warn").otherwise("pass"), c("heads"), untitled),
        yes("3.1.1", "lang"),
    )
    return p.select("page_id", F.explode(checks).alias("x")).select("page_id", "x.*")


def contrast_check(runs: DataFrame) -> DataFrame:
    """doc_id, items, issues, severe of runs (doc_id, fg, bg, size, bold)."""
    r = colour.ratio(F.col("fg"), F.col("bg"))
    low = r < colour.required(F.col("size"), F.col("bold"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum(low.cast("int")).alias("issues"), F.sum((low & colour.is_severe(F.col("fg"), F.col("bg"), r)).cast("int")).alias("severe"))


def contrast_label(items: Column, issues: Column, severe: Column) -> Column:
    share = issues / F.greatest(items, F.lit(1))
    return F.when(severe >= 1, "failed").when(share < 0.01, "passed").when(share >= 0.03, "failed").otherwise("cannot_tell")


def alt_check(images: DataFrame) -> DataFrame:
    """doc_id, status, items, issues of images (doc_id, alt, decorative)."""
    alt = text.strip(F.col("alt"))
    grade = F.when(F.col("decorative"), "skipped").when(alt == "", "bad").otherwise(text.alt_quality(alt))
    n = lambda s: F.sum((F.col("grade") == s).cast("int"))
    g = images.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.count("*").alias("items"), n("bad").alias("bad"), n("borderline").alias("borderline"))
    return g.select("doc_id", F.when(F.col("bad") > 0, "fail").when(F.col("borderline") > 0, "warn").otherwise("pass").alias("status"), "items", (F.col("bad") + F.col("borderline")).alias("issues"))


def alt_label(images: DataFrame) -> DataFrame:
    """doc_id, label: any bad text fails, a good share of 0.6 passes, the rest can't be told."""
    alt = text.strip(F.col("alt"))
    q = text.alt_quality(alt, ("automatically generated",))
    n = lambda s: F.sum(F.when(alt != "", (q == s).cast("int")).otherwise(0))
    g = images.groupBy("doc_id").agg(F.sum((alt != "").cast("int")).alias("n"), n("good").alias("good"), n("bad").alias("bad"))
    return g.select("doc_id", F.when(F.col("n") == 0, "not_present").when(F.col("bad") > 0, "failed").when(F.col("good") >= 0.6 * F.col("n"), "passed").otherwise("cannot_tell").alias("label"))


def accuracy(judged: DataFrame) -> DataFrame:
    """task (null: all), n, correct, accuracy of rows (task, gold, predicted)."""
    g = judged.rollup("task").agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("predicted")).cast("int")).alias("correct"))
    return g.select(F.coalesce("task", F.lit("(all)")).alias("task"), "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"))


def confusion_report(judged: DataFrame, labels: list) -> DataFrame:
    """value: for each task of judged (task, gold, predicted) its confusion matrix as a Markdown table under a heading."""
    n = lambda v: F.sum((F.col("predicted") == v).cast("int"))
    rows = judged.groupBy("task", "gold").agg(F.count("*").alias("total"), F.concat_ws(" | ", *(n(v).cast("string") for v in labels)).alias("counts"))
    line = F.concat(F.lit("| "), F.col("gold").cast("string"), F.lit(" | "), F.col("counts"), F.lit(" |"))
    g = rows.groupBy("task").agg(F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("gold", line.alias("line")))).alias("x"))
    head = F.lit("| gold | " + " | ".join(map(str, labels)) + " |\n|" + "---|" * (len(labels) + 1))
    return g.select(F.concat_ws("\n", F.format_string("## %s (%d)", "task", "total"), head, F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("value"))
