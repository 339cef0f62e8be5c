import random
import re

import pytest

from framejobs.llm.html_text import render


@pytest.mark.parametrize(("page", "text"), [
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<p style='visibility:hidden'>no<span>no</span></p>a", "a"),
    ("<ul><li style='visibility:collapse'>no<li>b</ul>", "- b"),
    ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>a", "a"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a  b  c\n   d  e"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><thead><tr><td rowspan=9>a<td>b</thead><tbody><tr><td>c<td>d</tbody></table>", "a  b\nc  d"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>c<td>d</table>", "a  b\nc  d"),
])
def test_visibility_and_spans(page, text):
    assert render(page)["text"] == text


@pytest.mark.parametrize("seed", range(30))
def test_cells_of_one_column_begin_in_one_place(seed):
    """Against a plain grid: each cell takes the first free column of its row and marks all it covers."""
    r = random.Random(seed)
    rows, taken, want = [], set(), []
    for y in range(r.randint(1, 8)):
        cells, x = [], 0
        for k in range(r.randint(1, 6)):
            while (y, x) in taken:
                x += 1
            across, down = r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2, 3])
            name = f"r{y}c{k}" + "x" * r.randint(0, 5)
            cells.append(f"<td colspan={across} rowspan={down}>{name}")
            taken |= {(y + j, x + i) for j in range(down) for i in range(across)}
            want.append((name, y, x))
            x += across
        rows.append("<tr>" + "".join(cells))
    lines = render(f"<table>{''.join(rows)}</table>")["text"].split("\n")
    place = {m[0]: (y, m.start()) for y, line in enumerate(lines) for m in re.finditer(r"\S+", line)}
    begins = {}
    for name, y, x in want:
        assert place[name][0] == y
        begins.setdefault(x, set()).add(place[name][1])
    assert all(len(b) == 1 for b in begins.values())
    order = [next(iter(begins[x])) for x in sorted(begins)]
    assert order == sorted(order)


def plain_words(tree, shown=True):
    """The visible words of a tree of (tag, style, children or text), by the rules alone."""
    out = []
    for child in tree:
        if isinstance(child, str):
            out += child.split() if shown else []
        elif child[1] != "display:none" and child[0] not in ("script", "template", "style"):
            now = {"visibility:hidden": False, "visibility:visible": True}.get(child[1], shown)
            out += plain_words(child[2], now)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_visible_words_against_a_plain_renderer(seed):
    r = random.Random(seed)
    count = iter(range(10_000))

    def grow(depth):
        out = []
        for _ in range(r.randint(0, 4)):
            if depth == 0 or r.random() < 0.4:
                out.append(f" w{next(count)} w{next(count)} ")
            else:
                tag = r.choice(["div", "section", "b", "blockquote", "span", "article", "template", "h2", "math", "svg", "pre"])
                inline = tag in ("b", "span", "math", "svg", "h2", "pre")
                out.append((tag, r.choice(["", "", "", "display:none", "visibility:hidden", "visibility:visible"]), [f" w{next(count)} "] if inline else grow(depth - 1)))
        return out

    def write(tree):
        return "".join(c if isinstance(c, str) else f"<{c[0]} style='{c[1]}'>{write(c[2])}</{c[0]}>" for c in tree)

    tree = grow(6)
    assert render(write(tree))["text"].split() == plain_words(tree)
