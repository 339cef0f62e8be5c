import random

import pytest

from framejobs.llm.html_text import page_texts, render

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two</p></p>three", "one\n\ntwo\n\nthree"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<title>T</title><p>x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  3. c\n  4. d\n- e\n\nf"),
    ("<table><tr><th>name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>", "name   n\nalpha  1\nb      22"),
    ("<table><td>no row<td>x</table>", "no row  x"),
    ("<table><tr><td colspan=2>wide cell<td>x</tr><tr><td>a<td>bbbbbbbb<td>y</table>", "wide cell    x\na  bbbbbbbb  y"),
    ("<table><tr><td><p>a</p><p>b</p><td>c</table>", "a  c\nb"),
    ("<script>var t='</p>';</script><style>p{}</style>x<!-- <p>no --><b hidden>no</b><i style='display: none'>no</i>", "x"),
    ("<pre>a  b\n  c\n\nd</pre>", "a  b\n  c\n\nd"),
    ("a < b <3 and <b>bold</b>text </nothing>", "a < b <3 and boldtext"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<details><summary>s</summary>closed</details><details open>o</details>", "s\no"),
    ("<head><title>t<body>x", ""),
    ("<head><title>t</title><p>x", "x"),
    ("<a title='>'>l</a> <a href=x>m</a", "l m"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<textarea> a\n b</textarea><p title=\"a", "a\n b"),
    ("é\xa0ü &nbsp;&copy &#x41;", "é\xa0ü \xa0© A"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    got = render(page)["text"]
    assert "\n".join(line.rstrip() for line in got.split("\n")).strip("\n") == text or got.strip() == text.strip()


def test_blocks_keep_all_visible_words():
    r = random.Random(1)
    tags = ["p", "div", "ul", "li", "table", "tr", "td", "b", "a", "h1", "ol", "dl", "dt", "dd", "blockquote", "span", "option", "th", "tbody"]
    for _ in range(400):
        words, page = [], []
        for k in range(r.randint(1, 60)):
            x = r.random()
            if x < 0.4:
                words.append(f"w{k}x")
                page.append(f" w{k}x ")
            else:
                page.append(f"<{'/' if x > 0.75 else ''}{r.choice(tags)}>")
        assert sorted(w for w in render("".join(page))["text"].split() if w.startswith("w")) == sorted(words)


def test_hostile_pages_end():
    for page in ("<div>" * 20_000 + "x", "<table><tr><td>" * 3000 + "x", "<b>" * 5000 + "</p>" * 5000 + "x", "<a b='" * 3000, "<!--" * 5000, "<" * 50_000, "<li>x" * 20_000):
        render(page)


def test_query(spark):
    df = spark.createDataFrame([(1, "<title>a  b</title>c"), (2, None), (2, ""), (None, "<p>x")], "page_id long, html string").withColumn("text", spark.sql("select 1 x").first().x * __import__("pyspark").sql.functions.lit(1))
    got = sorted(((r.page_id, r.title, r.text) for r in page_texts(df).collect()), key=str)
    assert got == sorted([(1, "a b", "c"), (2, "", ""), (2, "", ""), (None, "", "x")], key=str)
    assert page_texts(df.limit(0)).count() == 0
