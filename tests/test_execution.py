"""Applying plans: order of conflicting actions, and a model left alone by what fails."""

from plumbline.plans import apply

FRAMES = {
    "meta": ([("d", "tex", "old", "en"), ("w", "docx", "old", "en"), ("s", "pptx", "old", "en")], "doc_id string, format string, title string, language string"),
    "paragraphs": ([(d, f"p_{k}", "t", None) for d in "dws" for k in range(2)], "doc_id string, id string, text string, heading_level int"),
    "images": ([(d, f"img_{k}", k, 0, 0, k, "old", False) for d in "dws" for k in range(2)], "doc_id string, id string, paragraph_index int, drawing_index int, slide_index int, shape_index int, alt string, decorative boolean"),
    "tables": ([(d, "tbl_0", 2, 0, d == "d") for d in "dws"], "doc_id string, id string, rows int, header_rows int, first_row_empty boolean"),
    "links": ([(d, "link_0", "old") for d in "dws"], "doc_id string, id string, text string"),
    "math": ([("d", "math_0", "", 1.0)], "doc_id string, id string, description string, confidence double"),
    "runs": ([("d", "p_0", 0, "#AAAAAA", 12.0, False), ("d", "p_0", 1, "#000000", 12.0, False), ("d", "p_0", 2, "AAAAAA", 12.0, False), ("d", "p_0", 3, None, None, None), ("s", "p_0", 0, "#AAAAAA", 12.0, False)], "doc_id string, paragraph_id string, run int, fg string, size double, bold boolean"),
}


def run(spark, actions):
    model = {k: spark.createDataFrame(*v) for k, v in FRAMES.items()}
    rows = [(d, n, kind, element, params, status) for n, (d, kind, element, params, *rest) in enumerate(actions) for status in [rest[0] if rest else "planned"]]
    plan = spark.createDataFrame(rows, "doc_id string, seq int, action_type string, element_id string, parameters map<string,string>, status string")
    judged, after = apply.execute(plan, model)
    return {r.seq: (r.status, r.detail) for r in judged.collect()}, after


def test_the_last_executed_action_counts(spark):
    got, after = run(
        spark,
        [
            ("d", "set_alt_text", "img_0", {"alt_text": "first"}),
            ("d", "set_decorative", "img_0", {}),
            ("d", "set_alt_text", "img_0", {"alt_text": "last"}),
            ("d", "set_alt_text", "img_0", {"alt_text": ""}),
            ("d", "set_alt_text", "img_1", {"alt_text": "x" * 200}),
            ("d", "set_decorative", "img_1", {}),
            ("d", "set_title", None, {"title": "one"}),
            ("d", "set_title", None, {"title": "two"}, "skipped"),
            ("d", "set_heading_level", "p_1", {"level": "3"}),
            ("d", "set_heading_level", "p_9", {"level": "3"}),
            ("d", "mark_header_rows", "tbl_0", {}),
            ("d", "add_math_description", "math_0", {"description": "x squared"}),
            ("d", "fix_all_contrast", None, {}),
            ("d", "fix_all_contrast", None, {"default_bg": "#FFFFFF"}),
            ("gone", "set_title", None, {"title": "t"}),
        ],
    )
    assert [got[k][0] for k in range(15)] == ["executed"] * 3 + ["failed"] + ["executed"] * 3 + ["skipped", "executed", "failed", "skipped", "executed", "executed", "executed", "failed"]
    assert got[4][1] == "Set alt text: " + "x" * 80 and got[9][1] == "Paragraph not found: p_9" and got[12][1] == "Fixed 1 contrast issues" and got[13][1] == "Fixed 0 contrast issues"
    images = {(r.doc_id, r.id): (r.alt, r.decorative) for r in after["images"].collect()}
    assert images["d", "img_0"] == ("last", True) and images["d", "img_1"] == ("", True) and images["w", "img_0"] == ("old", False)
    assert {r.doc_id: r.title for r in after["meta"].collect()} == {"d": "one", "w": "old", "s": "old"}
    assert {(r.id, r.heading_level) for r in after["paragraphs"].collect() if r.doc_id == "d"} == {("p_0", None), ("p_1", 3)}
    assert [(r.description, r.confidence) for r in after["math"].collect()] == [("x squared", 0.95)]
    runs = {(r.doc_id, r.run): r.fg for r in after["runs"].collect()}
    assert runs["d", 0] not in ("#AAAAAA", None) and runs["d", 1] == "#000000" and runs["d", 2] == "AAAAAA" and runs["d", 3] is None and runs["s", 0] == "#AAAAAA" and len(runs) == 5


def test_office_documents_name_elements_by_place(spark):
    got, after = run(
        spark,
        [
            ("w", "set_heading_level", "p_0", {"level": "2"}),
            ("w", "set_heading_level", "p_0", {"level": "2", "paragraph_index": "1"}),
            ("w", "set_heading_level", "p_0", {"level": "12", "paragraph_index": "1"}),
            ("w", "set_link_text", "link_0", {"new_text": "Guide"}),
            ("w", "set_link_text", "nolink", {"new_text": "Guide"}),
            ("w", "mark_header_rows", "tbl_0", {"table_index": "0", "header_count": "3"}),
            ("w", "mark_header_rows", "tbl_0", {"table_index": "0"}),
            ("w", "set_decorative", "img_1", {"paragraph_index": "0"}),
            ("s", "set_link_text", "link_0", {"new_text": "Guide"}),
            ("s", "set_alt_text", "img_0", {"alt_text": "A", "slide_index": "0", "shape_index": "1"}),
            ("s", "set_alt_text", "img_0", {"alt_text": "A", "slide_index": "0", "shape_index": "7"}),
            ("s", "set_alt_text", "img_0", {"alt_text": "A"}),
        ],
    )
    assert [got[k][0] for k in range(12)] == ["failed", "executed", "failed", "executed", "failed", "failed", "executed", "executed", "skipped", "executed", "failed", "failed"]
    assert got[5][1] == "header_count 3 exceeds table row count 2" and got[10][1] == "Shape index 7 out of range (slide has 2 shapes)"
    assert {(r.id, r.alt, r.decorative) for r in after["images"].collect() if r.doc_id == "w"} == {("img_0", "", False), ("img_1", "old", False)}
    assert {(r.id, r.alt) for r in after["images"].collect() if r.doc_id == "s"} == {("img_0", "old"), ("img_1", "A")}
    assert {r.id: r.heading_level for r in after["paragraphs"].collect() if r.doc_id == "w"} == {"p_0": None, "p_1": 2}


def test_an_empty_plan_changes_nothing(spark):
    got, after = run(spark, [])
    assert got == {}
    assert all(sorted(map(repr, after[k].collect())) == sorted(map(repr, spark.createDataFrame(*v).collect())) for k, v in FRAMES.items())
