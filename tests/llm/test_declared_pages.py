"""Pages that declare an article are compared as well; a check by the markup follows."""

import pytest

from logweave.llm import html_extract

LETTER = '<div class="subscribe-now"><p>Get our letter</p><p>Every week</p></div>'


def own(i, n=6):
    return [f"Page {i} line {k}" for k in range(n)]


def page(i, part="", lines=None):
    return f"<nav>Menu</nav><article><h1>Title {i}</h1>{''.join(f'<p>{x}</p>' for x in lines or own(i))}{part}</article><p>Beside</p>"


def texts(spark, pages):
    frame = spark.createDataFrame([(i, f"http://h.example/a/{i:03}", x) for i, x in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract_main_text(frame).collect()}


def test_doubtful_parts_of_articles_are_decided_by_neighbours(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", 2)
    pages = [page(i, LETTER) for i in range(5)]
    pages.append(page(5, '<div class="subscribe-now"><p>Get our letter</p><p>of page 5</p></div>'))
    pages.append(page(6, '<div class="subscribe-now"><p>only here</p></div>'))
    got = texts(spark, pages)
    assert all(got[i] == [f"Title {i}", *own(i)] for i in range(5))
    assert got[5][-2:] == ["Get our letter", "of page 5"] and got[6][-1] == "only here"
    assert all("Beside" not in x and "Menu" not in x for x in got.values())


@pytest.mark.parametrize(
    "part",
    [
        "<p>A quotation</p>",
        '<h2 id="related-work">Related work</h2>',
        '<p class="lead">A quotation</p>',
        '<header class="entry-header-top"><h1>Weekly report</h1><p>by A</p></header>',
    ],
)
def test_shared_lines_of_articles_stay(spark, part):
    got = texts(spark, [page(i, part) for i in range(3)])
    assert all(len(got[i]) == 7 + part.count("</p>") + part.count("</h") - part.count("</header>") and got[i][:2] == [f"Title {i}", f"Page {i} line 0"] for i in range(3))


def test_near_copies_keep_their_parts(spark):
    got = texts(spark, [page(0, LETTER), page(1, LETTER, own(0)), page(2, LETTER, own(0)[:5] + ["Changed"])])
    assert all(x[-2:] == ["Get our letter", "Every week"] and len(x) == 9 for x in got.values())


def test_pages_with_and_without_an_article_meet(spark):
    bare = f"<div>Site</div><p>Only here</p><p>Nor there</p>{LETTER.replace('subscribe-now', 'x')}"
    got = texts(spark, [page(0, LETTER), bare])
    assert got[0] == ["Title 0", *own(0)] and got[1] == ["Site", "Only here", "Nor there"]


def test_parts_lie_in_page_order():
    html = '<main><div class="ad-hoc"><p>a</p><div id="menu-1"><p>b</p></div></div><section class="x"><p>c</p></section><div class="social-history">d'
    lines, parts = html_extract.blocks_and_parts(html)
    assert [x for x, _ in lines] == ["a", "b", "c", "d"] and parts == [(0, 2), (1, 2), (3, 4)]
    assert html_extract.frame_lines([1, 2, 3, 4], [[2, 9]], [True] * 4, parts) == [1]
    assert html_extract.frame_lines([1, 2, 3, 4], [[1, 3, 4]], [True] * 4, parts) == []
