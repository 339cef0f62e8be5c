import pytest

from framejobs.llm.html_text import render


@pytest.mark.parametrize(("page", "text"), [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='x'/><text>label</text></svg> b", "label b"),
    ("<map name=m><p>inside</p><area href=x></map>", "inside"),
])
def test_text_that_browsers_show(page, text):
    assert render(page)["text"].strip() == text


@pytest.mark.parametrize("depth", [10, 200, 5000])
@pytest.mark.parametrize("tag", ["font", "div", "b"])
def test_depth_changes_nothing(tag, depth):
    page = f"<{tag}>" * depth + "<div hidden>no<div>no</div>no</div><ul><li>a<ul><li>b</ul></ul><table><tr><td>c<td>d</table><p style='display:none'>no</p>e"
    assert render(page)["text"] == "- a\n  - b\n\nc  d\n\ne"


def test_deep_tables_and_quotes_end():
    assert render("<table><tr><td>" * 400 + "x")["text"] == "x"
    assert render("<blockquote>x" * 5000)["text"].count("x") == 5000
