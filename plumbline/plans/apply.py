"""Applying a plan: each action gets a status and a detail, and the executed ones change the model.

A plan is a frame of actions (doc_id, seq, action_type, element_id, parameters as a map, status); status ``skipped`` means left out beforehand. Whether an action can be executed
follows from its parameters and from the model as it came, so all actions are judged at once by joins with the elements; what the model becomes is an ordered fold, for each property of an element the
executed action of the highest seq that sets it. One window over an element's actions does that, so no document passes through one task as a whole.

Office documents name elements by place (paragraph_index and drawing_index, slide_index and shape_index, table_index, the number in a link's id), other documents by id.

A model is a dict of frames: ``meta`` (doc_id, format, title, language), ``paragraphs`` (doc_id, id, text, heading_level), ``images`` (doc_id, id, paragraph_index, drawing_index, slide_index, shape_index,
alt, decorative), ``tables`` (doc_id, id, rows, header_rows, first_row_empty), ``links`` (doc_id, id, text), ``math`` (doc_id, id, description, confidence) and ``runs`` (doc_id, paragraph_id, run, fg, size, bold).

Edge cases: a missing parameter is an empty one; an action on a document that isn't there fails; equal seqs of one element are settled by the greater value; null ids match nothing; an empty plan leaves the model as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.colour import digits, passes
from plumbline.functions.repair import repaired

WHITE = "#FFFFFF"
#: What an action type needs and sets. Names of actions and parameters.
ELEMENT = {"set_alt_text": "images", "set_decorative": "images", "set_heading_level": "paragraphs", "mark_header_rows": "tables", "set_link_text": "links", "add_math_description": "math"}
NAMED = {"images": "Image", "paragraphs": "Paragraph", "tables": "Table", "links": "Link", "math": "Math element"}
VALUE = {"set_title": "title", "set_language": "language", "set_alt_text": "alt_text", "set_link_text": "new_text", "add_math_description": "description", "set_heading_level": "level", "mark_header_rows": "header_count"}
EMPTY = {"set_title": "Empty title", "set_language": "Empty language", "set_alt_text": "Empty alt text", "set_link_text": "Empty link text", "add_math_description": "Empty description", "set_heading_level": "Missing level"}
NOT_IN_SLIDES = {"set_heading_level": "Heading levels not modifiable in PPTX", "mark_header_rows": "Table headers not modifiable in PPTX", "set_link_text": "Link text modification not yet supported for PPTX", "fix_all_contrast": "Contrast fix not yet supported for PPTX"}
MODEL_ONLY = "Math descriptions apply to document model only (not docx/pptx)"


def _parameter(name: str) -> Column:
    return F.coalesce(F.element_at("parameters", name), F.lit(""))


def _value() -> Column:
    """The parameter that the action's type sets."""
    found = reduce(lambda c, x: c.when(F.col("action_type") == x[0], _parameter(x[1])), VALUE.items(), F.when(F.lit(False), ""))
    return F.when((F.col("action_type") == "mark_header_rows") & (found == ""), "1").otherwise(F.coalesce(found, F.lit("")))


def _index(name: str) -> Column:
    return _parameter(name).try_cast("int")


def located(plan: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """The plan with format, value, element (the id that the action means, null if there is none) and what its judgement needs of the model."""
    kind = F.col("action_type")
    office = F.col("format").isin("docx", "pptx")
    out = plan.join(model["meta"].select("doc_id", "format"), "doc_id", "left").withColumn("value", _value())
    sizes = [model["paragraphs"].groupBy("doc_id").agg(F.count("*").alias("n_paragraphs")), model["tables"].groupBy("doc_id").agg(F.count("*").alias("n_tables")), model["links"].groupBy("doc_id").agg(F.count("*").alias("n_links"))]
    images = model["images"]
    sizes.append(images.groupBy("doc_id").agg((F.max("slide_index") + 1).alias("n_slides")))
    out = reduce(lambda df, one: df.join(one, "doc_id", "left"), sizes, out).fillna(0, ["n_paragraphs", "n_tables", "n_links", "n_slides"])
    drawings = images.groupBy("doc_id", "paragraph_index").agg(F.count("*").alias("n_drawings"))
    shapes = images.groupBy("doc_id", "slide_index").agg(F.count("*").alias("n_shapes"))
    out = out.withColumn("paragraph_index", _index("paragraph_index")).withColumn("drawing_index", F.coalesce(_index("drawing_index"), F.lit(0))).withColumn("slide_index", _index("slide_index")).withColumn("shape_index", _index("shape_index"))
    out = out.join(drawings, ["doc_id", "paragraph_index"], "left").join(shapes, ["doc_id", "slide_index"], "left").fillna(0, ["n_drawings", "n_shapes"])
    link = F.regexp_extract("element_id", r"^[^_]*_\s*([+-]?\d+)\s*$", 1)
    name = (
        F.when((kind == "set_heading_level") & office, F.concat(F.lit("p_"), F.col("paragraph_index").cast("string")))
        .when((kind == "mark_header_rows") & office, F.concat(F.lit("tbl_"), _index("table_index").cast("string")))
        .when((kind == "set_link_text") & office, F.concat(F.lit("link_"), link.try_cast("int").cast("string")))
        .otherwise(F.col("element_id"))
    )
    out = out.withColumn("link_number", F.when(link != "", link)).withColumn("name", name)
    # one frame of all elements, so that one join finds any of them
    known = [model[k].select("doc_id", F.lit(k).alias("family"), F.col("id").alias("name"), F.col("id").alias("element"), *((F.col(c) if k == "tables" else F.lit(None).cast(t)).alias(c) for c, t in (("rows", "int"), ("first_row_empty", "boolean")))) for k in NAMED]
    places = images.select("doc_id", F.lit("docx").alias("family"), F.concat_ws("/", "paragraph_index", "drawing_index").alias("name"), F.col("id").alias("element"), F.lit(None).cast("int").alias("rows"), F.lit(None).cast("boolean").alias("first_row_empty"))
    slides = images.select("doc_id", F.lit("pptx").alias("family"), F.concat_ws("/", "slide_index", "shape_index").alias("name"), F.col("id").alias("element"), F.lit(None).cast("int").alias("rows"), F.lit(None).cast("boolean").alias("first_row_empty"))
    is_image = kind.isin("set_alt_text", "set_decorative")
    family = reduce(lambda c, x: c.when(kind == x[0], x[1]), ELEMENT.items(), F.when(is_image & office, F.col("format")))
    place = F.when(is_image & (F.col("format") == "docx"), F.concat_ws("/", "paragraph_index", "drawing_index")).when(is_image & (F.col("format") == "pptx"), F.concat_ws("/", "slide_index", "shape_index")).otherwise(F.col("name"))
    out = out.withColumn("family", family).withColumn("name", place)
    return out.join(reduce(DataFrame.unionByName, [*known, places, slides]), ["doc_id", "family", "name"], "left")


def _said(text: str, *parts: str | Column) -> Column:
    return F.format_string(text, *(F.col(p) if isinstance(p, str) else p for p in parts))


def judged(actions: DataFrame) -> DataFrame:
    """located actions with status and detail."""
    kind, value = F.col("action_type"), F.col("value")
    slides, office = F.col("format") == "pptx", F.col("format").isin("docx", "pptx")
    found = F.col("element").isNotNull()
    failed = lambda detail: F.struct(F.lit("failed").alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    skipped = lambda detail: F.struct(F.lit("skipped").alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    done = lambda detail: F.struct(F.lit("executed").alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    is_image = kind.isin("set_alt_text", "set_decorative")
    short = F.substring("value", 1, 80)
    level, count = F.col("value").try_cast("int"), F.col("value").try_cast("int")
    in_docx, in_slides = is_image & (F.col("format") == "docx"), is_image & slides
    out = (
        F.when(F.col("status") == "skipped", skipped("Pre-skipped"))
        .when(F.col("format").isNull(), failed("Document not found"))
        .when(~kind.isin(*ELEMENT, "set_title", "set_language", "fix_all_contrast"), skipped(_said("Unknown action type: %s", "action_type")))
    )
    for name, detail in NOT_IN_SLIDES.items():
        out = out.when(slides & (kind == name), skipped(detail))
    out = out.when(office & (kind == "add_math_description"), skipped(MODEL_ONLY))
    out = out.when((kind == "set_heading_level") & office & F.col("paragraph_index").isNull(), failed("Missing paragraph_index"))
    for name, detail in EMPTY.items():
        out = out.when((kind == name) & (value == ""), F.when(office & (kind == "set_link_text"), failed("Empty new_text")).otherwise(failed(detail)))
    out = (
        out.when(in_slides & (F.col("slide_index").isNull() | F.col("shape_index").isNull()), failed("Missing slide_index or shape_index for pptx"))
        .when(in_slides & (F.col("slide_index") >= F.col("n_slides")), failed(_said("Slide index %d out of range (pres has %d slides)", "slide_index", "n_slides")))
        .when(in_slides & ~found, failed(_said("Shape index %d out of range (slide has %d shapes)", "shape_index", "n_shapes")))
        .when(in_docx & F.col("paragraph_index").isNull(), failed("Missing paragraph_index"))
        .when(in_docx & (F.col("paragraph_index") >= F.col("n_paragraphs")), failed(_said("Paragraph index %d out of range (doc has %d paragraphs)", "paragraph_index", "n_paragraphs")))
        .when(in_docx & ~found, failed(_said("Drawing index %d out of range (paragraph has %d images)", "drawing_index", "n_drawings")))
        .when(office & (kind == "set_heading_level") & ~F.coalesce(level.between(1, 9), F.lit(False)), failed(_said("Invalid heading level: %s", "value")))
        .when(office & (kind == "set_heading_level") & ~found, failed(_said("Paragraph index %d out of range", "paragraph_index")))
        .when(office & (kind == "mark_header_rows") & (_parameter("table_index") == ""), failed("Missing table_index"))
        .when(office & (kind == "mark_header_rows") & ~found, failed(_said("Table index %s out of range (doc has %d tables)", _parameter("table_index"), "n_tables")))
        .when(office & (kind == "mark_header_rows") & (count > F.col("rows")), failed(_said("header_count %s exceeds table row count %d", "value", "rows")))
        .when(office & (kind == "set_link_text") & F.col("link_number").isNull(), failed(_said("Cannot parse link index from: %s", "element_id")))
        .when(office & (kind == "set_link_text") & (F.trim("value") == ""), failed("New text must not be empty"))
        .when(office & (kind == "set_link_text") & ~found, failed(_said("Link index %s out of range (document has %d hyperlinks)", "link_number", "n_links")))
    )
    for family, name in NAMED.items():
        out = out.when((F.col("family") == family) & ~found, failed(_said(f"{name} not found: %s", F.coalesce("element_id", F.lit("None")))))
    out = out.when(~office & (kind == "mark_header_rows") & F.col("first_row_empty") & (count >= 1), skipped("First row is all empty — not marking as header"))
    out = (
        out.when(kind == "set_alt_text", done(_said("Set alt text: %s", short)))
        .when(kind == "set_decorative", done("Marked as decorative"))
        .when(kind == "set_heading_level", done(_said("Set to Heading %s", "value")))
        .when(kind == "mark_header_rows", done(_said("Marked %s header row(s)", "value")))
        .when(kind == "set_title", done(_said("Set title: %s", "value")))
        .when(kind == "set_language", done(_said("Set language: %s", "value")))
        .when(kind == "set_link_text", done(_said("Set link text: %s", short)))
        .when(kind == "add_math_description", done(_said("Set math description: %s", short)))
        .otherwise(done(_said("Fixed %d contrast issues", "n_contrast")))
    )
    return actions.withColumn("outcome", out).withColumn("status", F.col("outcome.status")).withColumn("detail", F.col("outcome.detail")).drop("outcome")


def _mended(runs: DataFrame, plan: DataFrame, formats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with the colour after the document's first fix_all_contrast, and for each such action how many runs it finds failing."""
    asked = plan.where("action_type = 'fix_all_contrast' AND coalesce(status, '') <> 'skipped'").join(formats.where("format <> 'pptx'"), "doc_id")
    ground = F.when(_parameter("default_bg") == "", WHITE).otherwise(_parameter("default_bg"))
    asked = asked.select("doc_id", "seq", ground.alias("bg"), F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("nth"))
    first = asked.where("nth = 1").select("doc_id", "bg")
    fails = lambda c: F.col(c).startswith("#") & digits(F.col(c)).isNotNull() & digits(F.col("bg")).isNotNull() & ~passes(F.col(c), F.col("bg"), F.col("size"), F.col("bold"))
    placed = runs.join(first, "doc_id", "left").withColumn("before", F.col("fg"))
    bad = F.coalesce(fails("before"), F.lit(False))
    pairs = placed.where(bad).select("before", "bg", "size", "bold").distinct()
    pairs = pairs.withColumn("_fixed", repaired("before", "bg", "size", "bold"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("before", "bg", "size", "bold")]
    fixed = placed.where(bad).alias("a").join(pairs.alias("b"), reduce(lambda x, y: x & y, same)).select(*(F.col("b._fixed").alias(c) if c == "fg" else F.col(f"a.{c}") for c in placed.columns))
    mended = placed.where(~bad).unionByName(fixed)
    now = F.when(F.col("nth") == 1, F.col("before")).otherwise(F.col("fg"))
    each = mended.drop("bg").join(asked, "doc_id").withColumn("now", now)
    counts = each.groupBy("doc_id", "seq").agg(F.sum(F.coalesce(fails("now"), F.lit(False)).cast("int")).cast("int").alias("n_contrast"))
    return mended.select(*runs.columns), counts


def _last(done: DataFrame, kinds: list[str], columns: dict[str, Column], key: list[str]) -> DataFrame:
    """For each key the values of the last executed action of these kinds."""
    latest = F.max(F.struct("seq", "value", *(c.alias(n) for n, c in columns.items())))
    return done.where(F.col("action_type").isin(*kinds)).groupBy(*key).agg(latest.alias("x")).select(*key, *(F.col(f"x.{n}").alias(n) for n in columns))


def _set(frame: DataFrame, new: DataFrame, names: dict[str, str], key: list[str]) -> DataFrame:
    """frame with the columns names[new column] replaced where new has a row; null values in new leave the old."""
    kinds = dict(frame.dtypes)
    joined = frame.join(new, key, "left")
    return joined.select(*(F.coalesce(F.col(next(n for n, c in names.items() if c == col)).cast(kinds[col]), F.col(col)).alias(col) if col in names.values() else F.col(col) for col in frame.columns))


def execute(plan: DataFrame, model: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The plan with status and detail, and the model after it."""
    runs, counts = _mended(model["runs"], plan, model["meta"].select("doc_id", "format"))
    actions = judged(located(plan, model).join(counts, ["doc_id", "seq"], "left").fillna(0, ["n_contrast"]))
    done = actions.where("status = 'executed'").select("doc_id", "seq", "action_type", "value", "parameters", F.col("element").alias("id"))
    after = dict(model)
    value = {"_new": F.col("value")}
    one = ["doc_id"]
    both = ["doc_id", "id"]
    after["meta"] = _set(_set(model["meta"], _last(done, ["set_title"], {"_title": F.col("value")}, one), {"_title": "title"}, one), _last(done, ["set_language"], {"_language": F.col("value")}, one), {"_language": "language"}, one)
    after["paragraphs"] = _set(model["paragraphs"], _last(done, ["set_heading_level"], value, both), {"_new": "heading_level"}, both)
    after["tables"] = _set(model["tables"], _last(done, ["mark_header_rows"], value, both), {"_new": "header_rows"}, both)
    after["links"] = _set(model["links"], _last(done, ["set_link_text"], value, both), {"_new": "text"}, both)
    sure = F.when(_parameter("confidence") == "", "0.95").otherwise(_parameter("confidence"))
    after["math"] = _set(model["math"], _last(done, ["add_math_description"], {"_text": F.col("value"), "_sure": sure}, both), {"_text": "description", "_sure": "confidence"}, both)
    alts = _last(done, ["set_alt_text", "set_decorative"], {"_alt": F.when(F.col("action_type") == "set_decorative", "").otherwise(F.col("value"))}, both)
    # an office document has no mark of its own: an image without a text is decorative there
    marks = _last(done.join(model["meta"].select("doc_id", "format"), "doc_id").where("format NOT IN ('docx', 'pptx')"), ["set_decorative"], {"_mark": F.lit(True)}, both)
    after["images"] = _set(_set(model["images"], alts, {"_alt": "alt"}, both), marks, {"_mark": "decorative"}, both)
    after["runs"] = runs
    return actions.select("doc_id", "seq", "action_type", "element_id", "status", "detail"), after


def totals(actions: DataFrame) -> DataFrame:
    """doc_id, executed, failed, skipped."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    return actions.groupBy("doc_id").agg(n("executed"), n("failed"), n("skipped"))
