from __future__ import annotations

import random
import time
from itertools import product

import pytest

from ringview.llm import html_extraction as html

SENTENCE = "A paragraph of the story, which is long enough to be text."


def pages(rnd, n):
    """Small pages of all kinds of elements, some left open."""
    for _ in range(n):
        parts, open_ = ["<body>"], []
        for _ in range(rnd.randrange(2, 8)):
            kind = rnd.random()
            if kind < 0.35 and len(open_) < 3:
                tag, attributes = rnd.choice([("article", ""), ("div", ' class="comments"'), ("nav", ""), ("div", ' class="content"'), ("div", ""), ("aside", ""), ("ul", "")])
                parts.append(f"<{tag}{attributes}>")
                open_.append(tag)
            elif kind < 0.5 and open_:
                parts.append(f"</{open_.pop()}>")
            else:
                parts.append(rnd.choice([f"<p>{SENTENCE}</p>", "<p>Ok.</p>", "<li><a href=x>Link</a>", "<h2>Title</h2>", "<div>some words of a box</div>", f"<td>{SENTENCE}"]))
        yield "".join(parts)


def test_whole_pages_are_labelled_at_least_cost() -> None:
    rnd, turned, mixed = random.Random(5), 0, 0
    weights = list(html.WEIGHTS.values())
    for page in pages(rnd, 250):
        found = html.blocks(page)
        g = html.graph(found, weights)
        if not found or len(g.gain) > 12:
            continue

        def cost(label, g=g):
            own = sum(-x if x < 0 and c else x if x > 0 and not c else 0 for x, c in zip(g.gain, label, strict=True))
            return own + sum(w for a, b, w in g.edges if label[a] != label[b]) + sum(w for a, b, w in g.arcs if label[a] and not label[b])

        assert cost(html.minimum_cut(g.gain, g.edges, g.arcs)) == pytest.approx(min(map(cost, product([True, False], repeat=len(g.gain)))))
        labels = html.labelled(page, weights)[1]
        turned += sum(c != (z > 0) for c, z in zip(labels, g.own, strict=True))
        mixed += len(set(labels)) > 1
    assert turned > 50 and mixed > 20


def test_flow_on_graphs_that_no_rule_settles() -> None:
    rnd = random.Random(6)
    for _ in range(150):
        n = rnd.randrange(3, 10)
        gain = [rnd.uniform(-1, 1) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0.2, 1.0)) for a in range(n) for b in range(a)]
        arcs = [(a, b, rnd.uniform(0.2, 1.0)) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.3]

        def cost(label, gain=gain, edges=edges, arcs=arcs):
            own = sum(-x if x < 0 and c else x if x > 0 and not c else 0 for x, c in zip(gain, label, strict=True))
            return own + sum(w for a, b, w in edges if label[a] != label[b]) + sum(w for a, b, w in arcs if label[a] and not label[b])

        near = [{b: 0.0 for b in range(n) if b != a} for a in range(n)]
        for a, b, w in [*edges, *((b, a, w) for a, b, w in edges), *arcs]:
            near[a][b] += w
        for label in (html.minimum_cut(gain, edges, arcs), html._flow(list(range(n)), gain, near)):
            assert cost(label) == pytest.approx(min(map(cost, product([True, False], repeat=n))))


def test_neighbours_decide_where_no_element_says_anything() -> None:
    one = f"<div><h2>Title</h2><p>{SENTENCE}</p><p>{SENTENCE}</p><p>Ok</p><p>{SENTENCE}</p></div><div><div><a href=a>Home</a></div><div><a href=b>About us</a></div></div>"
    assert html.extract(one).split("\n") == ["Title", SENTENCE, SENTENCE, "Ok", SENTENCE]
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(12))
    assert html.extract(f"<div class=content><ul>{links}</ul></div>") == ""
    assert html.extract(f"<article>{links}</article>").count("Link") == 12
    comments = "".join(f"<p>{SENTENCE}</p>" for _ in range(30))
    assert html.extract(f"<article><p>{SENTENCE}</p><section class=comments>{comments}</section></article>") == SENTENCE
    threads = f"<div class=post><article><p>{SENTENCE}</p><article><p>{SENTENCE}</p></article></article></div>" * 9
    assert html.extract(f"<main><div class=entry><p>{SENTENCE}</p></div><div id=comments>{threads}</div></main>") == SENTENCE
    assert html.extract(f"<aside><article><p>{SENTENCE}</p></article></aside>") == ""


def test_markup_stands_in_no_text() -> None:
    assert html.extract(f'<main><p class="x>{SENTENCE}</p><p>{SENTENCE}</p></main>') == f"{SENTENCE}\n{SENTENCE}"
    assert html.extract(f'<main><p class="x>{SENTENCE}</p><p class="y">{SENTENCE}</p></main>') == f"{SENTENCE}\n{SENTENCE}"
    assert html.extract(f"<main><p title='a > b'>{SENTENCE}</p><p title=\"<b>x</b>\">{SENTENCE}</p></main>") == f"{SENTENCE}\n{SENTENCE}"
    assert html.extract(f"<main><p>1 < 2 and 3 > 2, <b>{SENTENCE}</b></p><!-- <p>no --><p>x<a") == f"1 < 2 and 3 > 2, {SENTENCE}\nx"
    assert html.extract(f"<main><SCRIPT>'</p>'</SCRIPT ><p>{SENTENCE}</p><style>p{{}}") == SENTENCE


@pytest.mark.parametrize(
    "page",
    ["<a " * 40_000, "<" * 100_000, "<b>" * 40_000 + "</i>" * 40_000, "<div>" * 20_000 + "</p>" * 20_000, '<p class="x>' * 30_000, "<p>" + "<b>" * 20_000 + "<p>x</p>" * 20_000, "<!-" * 40_000, "</" * 40_000, "<div><p>short</p></div>" * 10_000],
)
def test_long_and_odd_pages_take_linear_time(page) -> None:
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 8


def test_a_long_page_is_whole() -> None:
    rnd = random.Random(1)
    words = [f"{SENTENCE} {i}." for i in range(8000)]
    page = "<body>" + "".join(f"<p>{w}</p>" if rnd.random() < 0.7 else f"<div>box {w[-6:]}</div><p>{w}</p>" for w in words)
    got = html.extract(page).split("\n")
    assert [x for x in got if x.startswith("A par")] == words


def test_weights_are_fitted_and_held_by_a_prior(spark) -> None:
    page = f"<nav><p>{SENTENCE}</p><li>{SENTENCE}</li></nav><article><td>{SENTENCE}</td><h1>Title</h1></article><footer><p>{SENTENCE}</p></footer>"
    frame = lambda n, x: spark.createDataFrame([(i, "u", x) for i in range(n)], "page_id long, url string, html string")
    start = list(html.WEIGHTS.values())
    assert html.fit(frame(0, page)) == start and html.fit(frame(3, "<div><p>x</p></div>")) == start
    names = list(html.WEIGHTS)
    few, many = (html.fit(frame(n, page)) for n in (1, 400))
    k = names.index("sentence")
    assert many[k] < few[k] < start[k]
    assert [w for w, name in zip(many, names, strict=True) if name not in html.FITTED] == [html.WEIGHTS[x] for x in names if x not in html.FITTED]
    rows = html.extract_pages(frame(4, page)).collect()
    assert len(rows) == 4 and len({r["text"] for r in rows}) == 1 and rows[0]["n_turned"] >= 0 and rows[0]["n_blocks"] == 5


def test_clashing_columns_nulls_and_repeats(spark) -> None:
    rows = [(1, "u", f"<article><p>{SENTENCE}</p></article>", "t", 5)] * 2 + [(None, None, None, None, None), (2, "v", "  ", "t", 1)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, SENTENCE, len(SENTENCE)), (1, SENTENCE, len(SENTENCE)), (2, "", 0)]
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
