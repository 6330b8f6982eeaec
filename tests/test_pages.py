"""Markdown, words and regions on hard cases."""

import pytest
from conftest import SF

from plumbline.sources import markdown, ocr

PAGE = """12 SMITH AND JONES

# *Title* with `code` ##
First line\\
hard  
break
===

Plain **bold *both*** and snake_case_name \\*kept\\* ![no](x.png)[Go *now*](http://a.b "t") []( http://c ) [ref][1]
| not | a table
1. one
   goes on
2) two
---
> quoted
lazy
> more

***
| a | b \\| c |
|:--|--:|
| only |
x | y | z
# after

~~~
| f | g |
|---|---|
~~~
-----
[see](tbl-0.md)
[gone](tbl-9.md)

```
open to the end"""


def test_markdown_constructs(spark):
    pages = spark.createDataFrame([("d", 0, PAGE), ("d", 1, "next\r\n\r\npage [x](u)"), ("d", 2, None), ("e", 0, ""), (None, 0, "no key")], "doc_id string, page int, markdown string")
    named = spark.createDataFrame([("d", 0, "tbl-0.md", "h|i\n-|-\n1|2"), ("d", 0, "tbl-0.md", "h|i\n-|-\n1|2"), ("d", 1, "tbl-5.md", "x")], "doc_id string, page int, name string, content string")
    frames = markdown.model(pages, named)
    texts = [(r.id, r.heading_level, r.text) for r in sorted(frames["paragraphs"].where("doc_id = 'd'").collect(), key=lambda r: (r.page, r.block))]
    assert [x[0] for x in texts] == [f"ocr_p_{k}" for k in range(len(texts))]
    assert [x[1:] for x in texts] == [
        (1, "Title with "), (1, "First linehardbreak"), (None, "Plain bold both and snake_case_name *kept* Go now  [ref][1] | not | a table"), (None, "one goes on"), (2, "two"), (None, "quoted lazy"), (None, "more"), (1, "after"), (None, "gone"), (None, "next"), (None, "page x"),
    ]
    cells = {(r.id, r.r, r.c): r.text for r in frames["cells"].collect()}
    assert cells == {("ocr_tbl_0", 0, 0): "a", ("ocr_tbl_0", 0, 1): "b | c", ("ocr_tbl_0", 1, 0): "only", ("ocr_tbl_0", 1, 1): "", ("ocr_tbl_0", 2, 0): "x", ("ocr_tbl_0", 2, 1): "y", ("ocr_tbl_1", 0, 0): "h", ("ocr_tbl_1", 0, 1): "i", ("ocr_tbl_1", 1, 0): "1", ("ocr_tbl_1", 1, 1): "2"}
    assert [(r.id, r.text, r.url, r.paragraph_id) for r in sorted(frames["links"].collect(), key=lambda r: r.id)] == [("ocr_link_0", "Go now", "http://a.b", "ocr_p_2"), ("ocr_link_1", "gone", "tbl-9.md", "ocr_p_8"), ("ocr_link_2", "x", "u", "ocr_p_10")]
    assert [(r.kind, r.id) for r in sorted(frames["order"].where("doc_id = 'd' AND page = 0").collect(), key=lambda r: r.seq)][6:10] == [("paragraph", "ocr_p_6"), ("table", "ocr_tbl_0"), ("paragraph", "ocr_p_7"), ("table", "ocr_tbl_1")]


def test_words_to_blocks(spark):
    rows = [("d", 0, 0, "Hello", 90, 10, 100, 40, 10), ("d", 0, 1, " world ", 80, 60, 102, 50, 12), ("d", 0, 2, "under", 70, 12, 120, 40, 10), ("d", 0, 3, "unsure", 19, 0, 0, 900, 10), ("d", 0, 4, "", 99, 0, 5, 5, 5), ("d", 0, 5, "152", 90, 10, 300, 30, 10), ("d", 0, 6, "MAYER", 90, 50, 300, 30, 10), ("d", 0, 7, "ok", 90, 10, 400, 5, 10), ("d", 0, 8, "last", 90, 10, 500, 5, 10), ("e", 0, 0, "x", 5, 0, 0, 1, 1)]
    words = spark.createDataFrame(rows, "doc_id string, page int, i int, text string, conf int, x int, y int, w int, h int")
    placed = ocr.lines_and_blocks(words.where("conf >= 20 AND trim(text) <> ''"))
    assert {r.i: (r.line, r.block) for r in placed.where("doc_id = 'd'").collect()} == {0: (1, 0), 1: (1, 0), 2: (2, 0), 5: (3, 1), 6: (3, 1), 7: (4, 2), 8: (5, 3)}
    got = [(r.doc_id, r.id, r.text, r.x, r.y, r.w, r.h, r.words) for r in ocr.blocks(placed, ("line", "x")).collect()]
    assert sorted(got) == [("d", 0, "Hello world under", 10, 100, 100, 30, 3), ("d", 1, "last", 10, 500, 5, 10, 1)]


REGION = "doc_id string, page int, region int, reading_order int, type string, block_ids array<int>, heading_level int, bold boolean, italic boolean, size string, headers array<string>, rows array<array<string>>, description string"


def test_regions_name_blocks(spark):
    blocks = spark.createDataFrame([("d", p, k, t) for p in (0, 1) for k, t in enumerate(["zero", " one ", "", "152 MAYER", None])], "doc_id string, page int, id int, text string")
    none = [None] * 7
    rows = [
        ("d", 0, 0, 3, "paragraph", [1, 0, 1, 77], None, True, False, None, None, None, None), ("d", 0, 1, 1, "heading", [0], 9, None, None, None, None, None, None), ("d", 0, 2, 1, "heading", [1], None, *[None] * 6), ("d", 0, 3, 0, "page_footer", [0], *none),
        ("d", 0, 4, 4, "paragraph", [3], *none), ("d", 0, 5, 5, "paragraph", [2, 4], *none), ("d", 0, 6, 6, "table", [0], *none), ("d", 0, 7, 7, "table", [0], None, None, None, None, None, [["a"], ["b", "c"]], None), ("d", 0, 8, 8, "figure", [3], *none),
        ("d", 0, 9, 9, "figure", None, None, None, None, None, None, None, "Said"), ("d", 1, 0, 0, "caption", [0], *none), ("d", 1, 1, 1, "nothing", [0], *none), ("d", 1, 2, 2, None, [0], *none), ("x", 0, 0, 0, "heading", [0], *none),
    ]
    got = ocr.merge(blocks, spark.createDataFrame(rows, REGION))
    assert sorted((r.page, r.id, r.text, r.heading_level, r.bold, r.italic, r.points) for r in got["paragraphs"].collect()) == [
        (0, "ocr_p_0", "zero", 6, True, None, 16.0), (0, "ocr_p_1", "one", 2, True, None, 16.0), (0, "ocr_p_2", "one zero one", None, True, None, 12.0), (0, "ocr_p_3", "zero", None, None, None, None), (1, "ocr_p_4", "zero", None, None, True, 10.0),
    ]
    assert [(r.id, r.rows, r.columns, r.header_rows) for r in got["tables"].collect()] == [("ocr_tbl_0", 2, 2, 0)]
    assert sorted((r.id, r.alt) for r in got["images"].collect()) == [("ocr_img_0", "152 MAYER"), ("ocr_img_1", "Said")]
    assert {(r.r, r.c): r.text for r in got["cells"].collect()} == {(0, 0): "a", (1, 0): "b", (1, 1): "c"}


def test_pseudocode_is_worked_out_once(spark):
    from plumbline.queries import QUERIES

    plan = QUERIES["b33_pseudocode_format"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["a10_blocks", "a10_lines_and_blocks", "a10_words_to_blocks"])
def test_words_are_not_shuffled(spark, name):
    """Texts are dealt out once, before they become words."""
    from plumbline.queries import QUERIES

    assert QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_order_of_markdown_takes_one_pass(spark):
    """Pages and the tables they name are made once each, not for paragraphs and tables apart."""
    from plumbline.queries import QUERIES

    assert QUERIES["a06_markdown_order"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_documents_without_a_page_go_before_their_lines_are_made(spark):
    from plumbline.sources import tables as s

    named = spark.range(5).toDF("doc_id")
    for made in (s.alts(spark, SF, named), s.outlined(spark, SF, named), s.document_tables(spark, SF, named)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert -1 < plan.index("Generate") < plan.index("Join LeftSemi")
        assert {r.doc_id for r in made.select("doc_id").distinct().collect()} <= set(range(5))
