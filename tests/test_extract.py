import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions.fields import map_header
from ledgerloom.operators import extract, registry

BLOCKS = [{"block_label": "text", "block_content": "ACME Trading Ltd", "block_bbox": [0, 10, 9, 20]}, {"block_label": "table", "block_content": "<table><tr><td>Name</td><td>Qty</td><td>Price</td><td>Total</td></tr><tr><td>Cable</td><td>2</td><td>5</td><td></td></tr><tr><td>Total</td><td></td><td></td><td>10</td></tr></table>"}]


def brief(items):
    return [(i["name"], i["qty"], i["unit_price"], i["total"]) for i in items]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Widget x2 @100", [("Widget", 2, 100, 200), ("Widget x", 2, 100, 200), ("Widget x @", 2, 50, 100)]),
        ("Cable 4 145 580", [("Cable", 4, 145, 580)]), ("Cable 4 145 900", []), ("Cable 580", []), ("- Cable 580", [("Cable", 1, 580, 580)]), ("", []),
    ],
)
def test_text_items(line, expected):
    assert brief(extract.text_items(line)) == expected


def test_headers():
    assert map_header("款号,名称,颜色,数量,单价,金额".split(",")) == {"code": 0, "name": 1, "color": 2, "qty": 3, "unit_price": 4, "total": 5}
    assert map_header(["Item", "Description", "Amount"]) == {"code": 0, "name": 1, "qty": 2}


def test_tables():
    assert extract.html_tables("<table border=1><tr><td colspan=2>a</td><td rowspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>") == [[["a", "", "b"], ["c", "d", "b"]]]
    assert brief(extract.table_items(extract.pipe_tables("|Name|Qty|Price|Total|\n|---|---|---|---|\n|A|2|3|6|\n|Total|||6|\n")[0])) == [("A", 2, 3, 6)]
    assert extract.bands([(10, "a"), (40, "b"), (85, "c"), (200, "d")]) == [["a", "b", "c"], ["d"]]


def test_page_and_wrappers():
    page = {"parsing_res_list": BLOCKS, "model_settings": {}, "layout_det_res": {}}
    for wrapped in (page, {"result": page}, {"data": page}):
        (got,) = extract.page_json("p.json", json.dumps(wrapped))
        assert got["supplier_name"] == "ACME Trading Ltd" and brief(got["items"]) == [("Cable", 2, 5, 10)] and got["calc_total"] == 10
    assert extract.page_json("p.json", "not json") == []


ODD_PAGES = [
    "[" * 200_000, '{"parsing_res_list": [{"block_label": "text", "block_bbox": [5], "block_content": "cable 5"}]}', '{"parsing_res_list": [{"block_label": "text", "block_bbox": ["a", "b"], "block_content": 7}]}',
    '{"parsing_res_list": {"a": 1}}', '{"parsing_res_list": [null, 3, {"block_label": null, "block_content": null}]}', '{"items": 5}', '{"items": [{"name": "x", "qty": "9e999", "total": "' + "9" * 400 + '"}]}', "NaN", "1e999",
]
ODD_TEXTS = [f"<table><tr><td colspan={'9' * 5000} rowspan=٣>a</td></tr><tr><td>b</td></tr></table>", "cable 2 " + "9" * 400, f"cable x{'9' * 400} @ 3", "- cable " + "9" * 400, "total " + "9" * 400, "cable 0.0000000001 " + "9" * 300, "2024年99月99日", "date: 0000-00-00"]


@pytest.mark.parametrize("odd", [*ODD_PAGES, *ODD_TEXTS])
def test_odd_files_are_survived(odd):
    for name in ("a.json", "a.md", "a.txt") if len(odd) < 10_000 else ("a.json",):
        for parse in (extract.page_json, extract.markdown, extract.text_block, extract.model_invoice) if len(odd) < 10_000 else (extract.page_json, extract.text_block):
            made = parse(name, odd)
            assert all(abs(i[k]) < float("inf") for v in made for i in v["items"] for k in ("qty", "unit_price"))
    assert all(len(r) <= extract.MOST_SPAN for t in extract.html_tables(odd) for r in t)


JSON = st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["parsing_res_list", "block_label", "block_content", "block_bbox", "result", "data", "items", "name", "qty", "total", "unit_price"]), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_any_json_is_survived(page):
    text = json.dumps(page)
    for parse in (extract.page_json, extract.text_block, extract.model_invoice):
        parse("a.json", text)
    registry.score_page("a.json", text)
    extract.model_content("a.json", text)


def test_failed_calls_skip_the_file_and_faults_do_not():
    def slow(_):
        raise TimeoutError("too slow")

    with pytest.warns(UserWarning, match="too slow"):
        assert registry.model_parser(slow).parse("a.txt", "x") == []
    with pytest.raises(KeyError):
        registry.model_parser(lambda _: {}["x"]).parse("a.txt", "x")


def test_merged_and_model_answers():
    text = "## Invoice 1\n- cable 5\n## Invoice 2\n- plug 7\n"
    assert [i["source_file"] for i in extract.markdown("f.md", text)] == ["f.md#part0", "f.md#part1"]
    assert extract.model_answer('so {"a": 1} ok') == {"a": 1} and extract.model_answer("no") is None


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_survived(text):
    items = extract.text_items(text)
    assert brief(items) == list(dict.fromkeys(brief(items)))
    extract.markdown("x.md", text)
    extract.html_tables(text)


def test_registry(spark):
    rows = [("r1", 0, "a.json", json.dumps({"parsing_res_list": BLOCKS})), ("r2", 0, "a.md", "| Item | Qty | Price | Total |\n|---|---|---|---|\n| cable | 2 | 5 | 10 |\n"), ("r3", 0, "a.txt", None)]
    files = spark.createDataFrame(rows, "run_id string, pos int, name string, content string")
    reg = registry.Registry()
    assert {r["run_id"]: r["parser_id"] for r in reg.detect(files).collect()} == {"r1": "doc_parser_json", "r2": "generic_markdown", "r3": None}
    assert {r["run_id"]: r["calc_total"] for r in reg.parse(files).collect()} == {"r1": 10, "r2": 10}
    assert [r["run_id"] for r in reg.parse(files, "text_block").collect()] == ["r2"]  # forced: no threshold
    with pytest.raises(ValueError):
        reg.parse(files, "nothing")
    asked = reg.configure_model(lambda _: '{"items": [{"name": "x", "qty": 2, "unit_price": 3}]}')
    assert asked.parse(files.where("run_id = 'r3'"), "llm_assisted").first()["items"][0]["total"] == 6
