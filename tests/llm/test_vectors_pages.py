"""Vectors and pages against plain versions."""

import math
import random

import numpy as np
import pytest

from tests.llm import plain
from tripweave.llm import near_vectors as nv
from tripweave.llm import page_text
from tripweave.llm.components import components


@pytest.mark.parametrize("block", [512, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nv, "BLOCK", block)
    dice = np.random.default_rng(4)
    base = dice.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + 0.05 * dice.normal(size=16) * (i % 5)).tolist(), int(i % 12) % 2) for i in range(90)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(30)] + [(300, (3 * base[0]).tolist(), 0), (301, base[0].tolist(), None), (302, base[0].tolist(), 1), (5, base[5].tolist(), 1)]
    bad = [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [math.nan] * 16, 0), (404, [None, *base[0][1:].tolist()], 0), (405, [math.inf, *base[0][1:].tolist()], 0), (406, base[0][:8].tolist(), 0)]
    every = [*rows, *bad]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in every], "vec_id long, embedding array<double>, label int, n int, table string")
    unit = [np.array(v) / np.linalg.norm(v) if l is not None and k < len(rows) else None for k, (_, v, l) in enumerate(every)]
    unit[-1] = np.array(every[-1][1]) / np.linalg.norm(every[-1][1])
    link = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and every[i][2] == every[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93
    least = plain.smallest_reachable([r[0] for r in every], link)
    want = sorted((every[i][0], sum(link(i, j) for j in range(len(every))), least[i], least[i] == every[i][0]) for i in range(len(every)))
    got = sorted(tuple(r) for r in nv.near_vectors(vectors).collect())
    assert got == want
    assert nv.near_vectors(vectors.limit(0)).count() == 0


def test_components(spark):
    dice = random.Random(7)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4), (2000, 1060), (2000, 1900)]
    nodes = sorted({x for a, b in links if a is not None and a != b for x in (a, b)})
    near = {frozenset(p) for p in links}
    want = dict(zip(nodes, plain.smallest_reachable(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in near)))
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ARTICLE = "<article><h1>Ti&amp;tle</h1><p>First <b>bold</b>line<br>next &eacute; &#65;<p>Second\n\tpart<div class='ad'>Buy <p>now</p></div><form>mail</form></article>"


def test_markup_decides_where_it_is_plain():
    page = f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li>Home</ul></nav><!-- c -->{ARTICLE}<div id='comments'>nice</div><footer>&copy;</footer><script>var t='</p>';</script></body></html>"
    lines = page_text.page_lines(page)
    text = page_text.main_text([x for x, _ in lines], [p for _, p in lines], None)
    assert text == "Ti&tle First boldline next é A Second part"
    assert page_text.page_lines("") == [] and page_text.page_lines("<p") == [("<p", 0)]


def test_extract(spark):
    menu = "".join(f"<div>entry {i}</div>" for i in range(8))
    site = lambda body: f"<body>{menu}<div>{body}</div><div>about us</div></body>"
    rows = [(i, f"http://h.example/en/a/{i}?q=1", site(f"story number {i} here")) for i in range(6)]
    rows += [(10, "http://alone.example/x", site("lonely")), (11, None, site("no url")), (12, "http://h.example/de/z", None), (13, "http://c.example/1", ARTICLE), (14, "http://c.example/1", ARTICLE), (14, "http://c.example/1", ARTICLE), (15, "http://c.example/2", "")]
    pages = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int").coalesce(1)
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_text.extract(pages).collect())
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert sum(by[i] == f"story number {i} here" for i in range(6)) >= 4  # the ends of a range may be alone
    assert "lonely" in by[10] and by[12] == by[15] == "" and by[13] == by[14] == "Ti&tle First boldline next é A Second part"
    assert page_text.extract(pages.limit(0)).count() == 0


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_subsequence(monkeypatch):
    dice = random.Random(2)
    pairs = [([dice.randint(0, dice.choice([2, 8])) for _ in range(dice.randint(0, 14))], [dice.randint(0, 4) for _ in range(dice.randint(0, 14))]) for _ in range(1000)]
    for exact in (True, False):
        if not exact:
            monkeypatch.setattr(page_text, "ALIGN_CELLS", 4)
        for a, b in pairs:
            kept, rest = page_text.common_lines(a, b), iter(b)
            assert all(a[i] in rest for i in sorted(kept))
            assert len(kept) == _longest(a, b) or not exact and len(kept) <= _longest(a, b)


def _cut(page):
    lines = page_text.page_lines(page)
    return [x for x, _ in lines], [p for _, p in lines]


def test_differencing_decides_beside_and_inside_an_article(spark):
    page = lambda i: f"<body><div>our site menu</div><div>note of day {i}</div><article><p>share this story<p>story {i} is told here at length</article></body>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(3)] + [(9, "http://alone.example/", page(9))]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = "note of day 9 share this story story 9 is told here at length"
    assert got[9] == "our site menu " + own
    for i in range(3):
        lines, parts = _cut(page(i))
        other, others = _cut(page(i + 1))
        assert not page_text.copies(lines, parts, other, others) and page_text.copies(lines, parts, lines, parts)
        assert page_text.main_text(lines, parts, other) == f"note of day {i} story {i} is told here at length"


def test_partners_lie_beyond_copies():
    menu = "".join(f"<div>entry {i}</div>" for i in range(8))
    body = lambda i: f"<body>{menu}<div>the story of number {i} is told here</div></body>"
    host = lambda name, kinds: [(n, "", *_cut(body(k) if k is not None else ""), name, f"/a/{n}") for n, k in enumerate(kinds)]
    rows = [*host("a", [1] * 5 + [2] * 3 + [None, 3, 3]), *host("b", [1, 1, 1]), *host("", [1, 2])]
    found = list(page_text.partners(iter(rows)))
    assert [n for n, _ in found] == rows
    texts = [page_text.main_text(n[2], n[3], p[2] if p else None) for n, p in found]
    story = lambda i: f"the story of number {i} is told here"
    assert texts[:11] == [story(1)] * 5 + [story(2)] * 3 + [""] + [story(3)] * 2
    assert all(p is None for _, p in found[11:]) and texts[11].startswith("entry 0")


def test_large_pages_have_a_longest_subsequence(monkeypatch):
    monkeypatch.setattr(page_text, "ALIGN_CELLS", 4)
    dice = random.Random(3)
    for _ in range(300):
        a, b = ([dice.randint(0, 3) for _ in range(dice.randint(0, 20))] for _ in range(2))
        assert len(page_text.common_lines(a, b)) == _longest(a, b)


@pytest.mark.parametrize("wrapper", ["<form action='/x'>", "<div class='layout with-sidebar'>", "<div class='has-sidebar'>", "<div id='page-with-nav'>", "<div class='no-ads main'>", "<div class='banner'>"])
def test_articles_inside_wrappers_stay(wrapper):
    tag = wrapper[1:].split()[0]
    page = f"<body>{wrapper}<nav>menu</nav><article><div class='post-header'><h1>Title</h1></div><p>Story</article></{tag}><footer>end</footer></body>"
    assert page_text.main_text(*_cut(page), None) == "Title Story"


@pytest.mark.parametrize("wrapper", ["<nav>", "<footer>", "<aside>", "<div class='comments'>", "<div class='wide sidebar'>", "<div role='complementary'>", "<div hidden>"])
def test_articles_beside_the_page_do_not(wrapper):
    tag = wrapper[1:].strip(">").split()[0]
    page = f"<body><main>Story</main>{wrapper}<form><article><p>Teaser</article></form></{tag}><form>mail<div>name</div></form></body>"
    assert page_text.main_text(*_cut(page), None) == "Story"


@pytest.mark.parametrize("opening", [
    '<div style="overflow:hidden"><article>', '<article title="The hidden truth">', '<article data-id="comments">', '<div data-hidden="false"><article>',
    "<div data-note='class=\"sidebar\"'><article>", '<article lang=en data-role="navigation">', '<div aria-label="hidden menu" class="wrap"><article>', "<article data-x=hidden>",
])
def test_only_names_of_attributes_are_read(opening):
    assert (("Kept words", page_text.PROSE) in page_text.page_lines(f"<html><body>{opening}<p>Kept words</p></article></body></html>"))


@pytest.mark.parametrize("opening", ["<div hidden>", "<div hidden=''>", '<div data-x="a"hidden>', "<div class='big sidebar'>", '<div id=comments>', '<div ROLE="navigation">', "<div aria-hidden = true>"])
def test_parts_named_so_are_set_apart(opening):
    lines = page_text.page_lines(f"<body>{opening}<p>Gone</p></div><p>Stays</p></body>")
    assert lines == [("Gone", page_text.BESIDE), ("Stays", page_text.PLAIN)]


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=x><link rel=y><title>T</title></head>", "<head><title>T</title><body>", "<title>T</title>"])
def test_a_head_ends_with_the_first_thing_that_is_not_its(head):
    lines = page_text.page_lines(f"<html>{head}<article><p>Body words</p></article></html>")
    assert ("Body words", page_text.PROSE) in lines
    assert not any("Body" in line and part == page_text.BESIDE for line, part in lines)
    assert ("Loose words", page_text.PLAIN) in page_text.page_lines("<head><title>T</title>\n Loose words<p>More</p>")


def test_many_open_and_stray_tags_take_linear_time():
    import time

    start = time.perf_counter()
    page_text.page_lines("<div>" * 30_000 + "</span></p></x>" * 30_000)
    assert time.perf_counter() - start < 3


def test_ids_of_any_type(spark):
    for kind in ("smallint", "tinyint", "decimal(10,0)", "date", "string"):
        df = spark.sql(f"SELECT CAST({'DATE ' if kind == 'date' else ''}'{'2020-01-01' if kind == 'date' else 7}' AS {kind}) AS page_id, 'http://a/b' AS url, '<article>x</article>' AS html")
        row = page_text.extract(df).first()
        assert row["text"] == "x" and page_text.extract(df).schema["page_id"].dataType == df.schema["page_id"].dataType
