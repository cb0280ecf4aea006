"""Extraction on long, deep and odd pages, and its precision and recall on pages of another shape than the training's."""

import random
import time

import pytest

from triagelake.llm import html_extract as H


@pytest.mark.parametrize("page", ["<div>a" * 60_000, "<p>hello word</p>" * 60_000, "<div>" * 60_000 + "</x>" * 60_000, "<b>x" * 60_000, "<a href='" * 20_000, "<!--" * 20_000])
def test_long_pages_take_linear_time(page):
    def seconds(p):
        start = time.process_time()
        H.leaves(p)
        return time.process_time() - start

    small = max(seconds(page[: len(page) // 4]), 0.05)
    assert seconds(page) < 12 * small


def test_a_deep_page_is_labelled_whole():
    assert len(H.leaves("<div>a" * 30_000)) == 30_000
    assert len(H.trained().label([H.leaves("<p>word here</p>" * 30_000)])[0]) == 30_000


def test_paths_share_rows_but_keep_the_last_element():
    inside = H.leaves("<article><div class='story'><p>text</p></div></article>")[0][0]
    outside = H.leaves("<footer><div class='menu'><p>text</p></div></footer>")[0][0]
    assert inside != outside and len(set(inside)) == len(inside)


def test_empty_tables_repeats_and_clashing_columns(spark):
    shape = "page_id long, url string, html string, text string, n_chars string, _in int"
    assert H.extract(spark.createDataFrame([], shape)).collect() == []
    page = "<html><body><article><h1>A title</h1><p>Some words of an article, long enough to be one.</p></article></body></html>"
    rows = [(1, "u", page, "old", "9", 3), (1, "u", page, "old", "9", 3), (None, None, None, None, None, None), (2, "v", "plain words without markup", "", "", 0)]
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars, r["_in"] or 0) for r in H.extract(spark.createDataFrame(rows, shape)).collect())
    assert got[0] == (0, "", "", 0, 0) and got[1] == got[2] and got[1][2].startswith("A title\nSome words") and got[1][3] == len(got[1][2])


def other_page(r):
    """A page laid out unlike the training pages: tables of the older web, or sections named in another way, in real words."""
    words = "river stone market letter garden winter people music history village question answer morning silver bridge teacher window science travel story".split()
    line = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize()
    good, bad = [], []

    def yes(text):
        good.append(text)
        return text

    def no(text):
        bad.append(text)
        return text

    links = lambda n: " | ".join(f'<a href="/{k}">{no(line(1, 2) + f" {k}")}</a><br>' for k in range(n))
    body = "".join(f"<p>{yes(line(12, 40) + '.')}</p>" if r.random() < 0.8 else f"<h3>{yes(line(2, 5))}</h3>" for _ in range(r.randint(3, 9)))
    crumbs = f'<ol class="breadcrumb">{"".join(f"<li><a href=/>{no(line(1, 1) + str(k))}</a></li>" for k in range(3))}</ol>'
    ads = f'<div class="sponsored-box">{no(line(5, 12) + "!")}</div>'
    talk = f'<section id="comments">{"".join(f"<div class=comment><p>{no(line(6, 20) + chr(46))}</p></div>" for _ in range(r.randint(1, 4)))}</section>'
    foot = f'<footer><div class="row"><p>{no("Copyright " + line(2, 5))}</p></div></footer>'
    bar = f'<aside class="sidebar"><h4>{no(line(1, 3))}</h4>{links(4)}</aside>'
    sign = f'<form class="newsletter"><p>{no(line(4, 9))}</p><button>{no("Send " + line(1, 1))}</button></form>'
    main = f'<main><div class="layout"><article class="post"><div class="body">{body}</div></article></div></main>'
    top = f'<header class="site"><div><span>{no(line(1, 3) + " site")}</span></div><nav>{links(5)}</nav></header>'
    return f"<html><head><title>{no(line(3, 6) + ' page')}</title></head><body>{top}{crumbs}{ads}{main}{r.choice((bar, ''))}{talk}{sign}{foot}</body></html>", good, bad


def test_precision_and_recall_on_pages_of_another_generator():
    r = random.Random(77)
    pages = [other_page(r) for _ in range(120)]
    hit = wrong = want = 0
    for text, (_, good, bad) in zip(H.main_text(H.trained(), [p for p, _, _ in pages]), pages):
        got = set(text.split("\n"))
        want += len(set(good))
        hit += len(got & set(good))
        wrong += len(got - set(good))
    assert hit / want >= 0.95 and hit / (hit + wrong) >= 0.95, (hit, want, wrong)


FLOOD = [
    "The river rose over its banks in the night and the village woke to water in the streets, as it had forty years before.",
    "Nobody was hurt, the mayor said on Tuesday, but the school will stay closed until the end of the month.",
    "Volunteers carried books and chairs to the upper floor while others filled bags with sand.",
]
UNTAGGED = {
    "columns": (
        f'<div class="wrapper"><div class="row"><div class="col-8"><h1>Title here</h1><p>{FLOOD[0]}</p><p>{FLOOD[1]}</p></div>'
        '<div class="col-4"><h3>Related</h3><ul><li><a href="/a">First link</a></li><li><a href="/b">Second link</a></li></ul></div></div></div>',
        ["Title here", FLOOD[0], FLOOD[1]],
    ),
    "section": (f'<section class="news"><h2>Head</h2>{"".join(f"<p>{t}</p>" for t in FLOOD + FLOOD)}</section>', ["Head", *FLOOD, *FLOOD]),
    "breaks": (f"<html><body><div>{FLOOD[0]}<br>{FLOOD[1]}<br><br>{FLOOD[2]}</div></body></html>", FLOOD),
    "body": (f"<html><body>{FLOOD[0]}<br>{FLOOD[1]}<br>{FLOOD[2]}</body></html>", FLOOD),
}


@pytest.mark.parametrize("name", UNTAGGED)
def test_articles_without_an_element_of_their_own_come_out_whole(name):
    page, want = UNTAGGED[name]
    assert H.main_text(H.trained(), [page]) == ["\n".join(want)]


def untagged_page(r):
    """A page without article or main: columns, a section, lines between breaks, a table or the bare body, in real words."""
    words = "harbour winter council bridge doctor orchard theatre engine summer library painter valley machine border island kitchen railway student captain evening".split()
    small = "the of and in to a with for on by from at".split()
    line = lambda a, b: " ".join(r.choice(words if r.random() < 0.6 else small) for _ in range(r.randint(a, b))).capitalize()
    good, bad = [], []

    def yes(text):
        good.append(text)
        return text

    def no(text):
        bad.append(text)
        return text

    text = [yes(line(10, 45) + ".") for _ in range(r.randint(2, 8))]
    title = f"<h1>{yes(line(3, 8))}</h1>"
    paragraphs = title + "".join(f"<p>{t}</p>" for t in text)
    main = [
        f'<div id="site"><div class="flex"><div class="eight columns">{paragraphs}</div>{{}}</div></div>',
        f'<section class="journal">{paragraphs}</section>{{}}',
        f'<div class="t1">{title}{"<br><br>".join(text)}</div>{{}}',
        f"{paragraphs}{{}}",
        f'<table width="100%"><tr><td>{paragraphs}</td><td>{{}}</td></tr></table>',
    ][r.randrange(5)]
    links = "".join(f'<li><a href="/{k}">{no(line(2, 5) + f" {k}")}</a></li>' for k in range(r.randint(2, 6)))
    bar = f'<div class="four columns"><h4>{no(r.choice(("Read next", "Elsewhere", "Top picks")))}</h4><ul>{links}</ul></div>'
    top = f'<div class="top"><ul>{"".join(f"<li><a href=/{k}>{no(line(1, 1) + str(k))}</a></li>" for k in range(5))}</ul></div>'
    foot = f'<div id="footer">{no("Copyright " + line(2, 5))}</div>'
    return f"<html><head><title>{no(line(3, 6) + ' page')}</title></head><body>{top}{main.format(r.choice((bar, '')))}{foot}</body></html>", good, bad


def test_precision_and_recall_on_pages_without_elements_that_tell():
    r = random.Random(78)
    pages = [untagged_page(r) for _ in range(150)]
    hit = wrong = want = 0
    for text, (_, good, bad) in zip(H.main_text(H.trained(), [p for p, _, _ in pages]), pages):
        got = set(text.split("\n"))
        want += len(set(good))
        hit += len(got & set(good))
        wrong += len(got - set(good))
    assert hit / want >= 0.95 and hit / (hit + wrong) >= 0.95, (hit, want, wrong)
