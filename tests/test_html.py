"""The scan over tags against a parser that walks the elements, and on hard pages."""

from html.parser import HTMLParser

import pytest
from conftest import SF
from pyspark.sql import functions as F

from plumbline.functions import latex
from plumbline.sources import html
from plumbline.sources import tables as s

VOID = {"br", "img", "meta", "hr", "input", "link"}


class Walk(HTMLParser):
    """A stack of open elements; paragraphs end at any block's edge, cells hold what no inner table holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts, self.grids, self.block, self.skip, self.on = [], [], [], None, 0, False
        self.open_grids = []

    def edge(self, tag, opens):
        if tag in html.BLOCKS:
            self.block = None
            if opens and (tag == "p" or tag in html.HEADINGS):
                self.block = [tag, []]
                self.texts.append(self.block)
        if not self.open_grids:
            return
        grid = self.open_grids[-1]
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            grid["cell"] = None
        if opens and tag == "tr":
            grid["rows"].append([])
        if opens and tag in ("td", "th"):
            grid["cell"] = []
            grid["rows"][-1].append((grid["cell"], grid["head"]))
        if tag in ("thead", "tbody", "tfoot"):
            grid["head"] = opens and tag == "thead"

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "table":
            self.edge(tag, True)
            self.open_grids.append({"rows": [], "cell": None, "head": False})
            self.grids.append(self.open_grids[-1])
        else:
            self.edge(tag, True)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if tag == "table" and self.open_grids:
            self.open_grids.pop()
        self.edge(tag, False)

    def handle_data(self, data):
        if self.skip:
            return
        if self.block:
            self.block[1].append(data)
        if self.open_grids and self.open_grids[-1]["cell"] is not None:
            self.open_grids[-1]["cell"].append(data)


def body(page):
    return page[page.index("<body>") :]


def test_paragraphs_and_cells_as_a_walk_finds_them(spark):
    pages = {r.page_id: r.html for r in s.rich_pages(spark, SF).collect() if r.page_id % 3 and not r.page_id % 4 == 0 and r.page_id % 4 != 2}
    frames = html.model(s.rich_pages(spark, SF))
    got, cells = {}, {}
    for r in sorted(frames["paragraphs"].collect(), key=lambda r: (r.page_id, r.at)):
        got.setdefault(r.page_id, []).append(r.text)
    for r in sorted(frames["cells"].collect(), key=lambda r: (r.page_id, r["at"], r.r, r.c)):
        cells.setdefault(r.page_id, []).append((r.r, r.c, r.text, r.header))
    assert pages
    for k, page in pages.items():
        plain = page.replace('<math alttext="x_%d" display="inline"><mi>x</mi></math>' % k, "[math_0]")
        for mark in (latex_mark("\\badcmd"), latex_mark("\\sc kept")):
            plain = plain.replace(mark, "" if "bad" in mark else "kept")
        walk = Walk()
        walk.feed(body(plain))
        want = ["".join(x.strip() for x in parts) if tag != "p" else " ".join("".join(parts).strip().split("  ")) for tag, parts in walk.texts]
        assert [x.replace("  ", " ") for x in got[k]] == [x.replace("  ", " ") for x in want if x], k
        flat = []
        for grid in walk.grids:
            rows = [r for r in grid["rows"] if r]
            flat += [(i, j, "".join(x.strip() for x in cell), head) for i, row in enumerate(rows) for j, (cell, head) in enumerate(row)]
        assert cells[k] == flat


def latex_mark(text):
    return f'<span class="ltx_ERROR undefined">{text}</span>'


PAGE = """<!-- <p>no</p> --><html><head><title>T</title><script>"<p>no</p>"</script></head><body><p>outside</p><article class="x ltx_document">
<H2 class='ltx_title'>Big &lt;One&gt;</H2><p>a</b> stray <i>close</i></p></div><p>never closed<h3>next</h3>tail<table><tr><th>1<td>2<tr><td>3</table>
<p></p><p> &nbsp;x</p><img alt='it&#39;s' src="A.PNG"><img></article><p>after</p></body>"""


def test_hard_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tag at all"), (5, "<p>cut <b"), (6, "<p>" + "long " * 50_000 + "</p>"), (None, "<p>no key</p>")], "page_id long, html string")
    frames = html.model(pages)
    got = {(r.page_id, r.id): (r.heading_level, r.text) for r in frames["paragraphs"].collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "p_0"): (2, "Big <One>"), (1, "p_1"): (None, "a stray close"), (1, "p_2"): (None, "never closed"), (1, "p_3"): (3, "next"), (1, "p_4"): (None, got[1, "p_4"][1])}
    assert got[1, "p_4"][1].strip("  ") == "x"
    assert got[5, "p_0"] == (None, "cut") and len(got[6, "p_0"][1]) == 249_999 and got[None, "p_0"] == (None, "no key") and not {k for k in got if k[0] in (2, 3, 4)}
    assert sorted((r.r, r.c, r.text, r.header) for r in frames["cells"].collect()) == [(0, 0, "1", False), (0, 1, "2", False), (1, 0, "3", False)]
    assert sorted((r.id, r.src, r.alt, r.mime) for r in frames["images"].collect()) == [("img_0", "A.PNG", "it's", "image/png"), ("img_1", "", "", "image/png")]
    assert not frames["math"].count()


def test_equations_formulas_and_drawings(spark):
    page = f"""<body><p>Let <math alttext="x"><mi>x</mi></math> be</p><table class="ltx_equation"><tr><td><p>skipped</p><math alttext="E" class="a ltx_math_unparsed"><mi>E</mi></math><math alttext="second"></math></td>
    <td><span class="ltx_tag ltx_tag_equation">(7)</span></td></tr></table><p>{latex_mark("\\node")}[state] (q) {{q}};</p><p>then <math alttext="y" display="block"><mi>y</mi></math></p></body>"""
    frames = html.model(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [(r.id, r.latex, r.display, r.unparsed, r.equation_number) for r in frames["math"].orderBy("at").collect()] == [
        ("math_0", "x", "inline", False, None), ("math_1", "E", "block", True, "(7)"), ("math_tikz_2", "", "block", False, None), ("math_2", "y", "block", False, None),
    ]
    assert [(r.kind, r.id) for r in frames["order"].orderBy("seq").collect()] == [("paragraph", "p_0"), ("math", "math_1"), ("paragraph", "p_1"), ("paragraph", "p_2")]
    assert not frames["tables"].count()


@pytest.mark.parametrize(("source", "tokens"), [("\\State {a {b} c} d}e\n f", ["\\State", "{a {b} c}", "d}e", "f"]), ("{open {x}", ["{open {x}"]), ("", []), (" \n", []), ("\\a\\b*{}", ["\\a", "\\b*", "{}"])])
def test_braces_are_matched(spark, source, tokens):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(source,)], "t string").select(latex.command_tokens(F.col("t")).alias("k"), latex.pseudocode(F.lit(None).cast("string")).alias("p")).first()
    assert row.k == tokens and row.p is None


def test_tasks_grow_in_number_with_the_pages(spark, monkeypatch):
    """What one task sorts is bounded, whatever spark.sql.shuffle.partitions says."""
    monkeypatch.setattr(html, "HTML_PER_TASK", 1000)
    pages = spark.range(300).selectExpr("id page_id", "repeat('<p>some text</p>', 10) html")
    parts = html.nested(html.tokens(pages)).groupBy(F.spark_partition_id()).agg(F.countDistinct("page_id").alias("n")).collect()
    assert len(parts) > 30 and max(p.n for p in parts) < 30


def test_pages_are_cut_once_to_be_written_again(spark):
    """The scan is a table that all parts of the page read, not a plan that each of them runs."""
    from plumbline.queries import QUERIES

    plan = QUERIES["a23_html_of_model"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "<!--" not in plan  # of the pattern that cuts
