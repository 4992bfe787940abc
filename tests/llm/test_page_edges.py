"""Main text of pages whose neighbours lie in other partitions."""

import pytest

from logweave.llm import html_extract


def in_order(rows):
    rows = [(i, h, html_extract.blocks(b)) for i, h, b in rows]
    near = lambda n: [rows[j][2] for j in (n - 1, n + 1) if 0 <= j < len(rows) and rows[j][1] == rows[n][1]]
    hashes = html_extract.line_hashes
    return {i: html_extract.main_text(b, html_extract.frame_lines(hashes(b), [hashes(x) for x in near(n)])) for n, (i, _, b) in enumerate(rows)}


@pytest.mark.parametrize(("partitions", "block"), [(1, 1_000), (7, 1), (40, 7)])
def test_edges_of_partitions_do_not_matter(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", block)
    pages = []
    for i in range(60):
        host = f"h{i // 2 if i < 20 else 50}.example"
        lines = ["Site name", f"Menu {i // 3}", *(f"page {i} line {k}" for k in range(3)), f"Foot {(i + 1) // 2}"]
        pages.append((i, host, "".join(f"<p>{x}</p>" for x in lines)))
    pages.sort(key=lambda x: (x[1], x[0]))
    frame = spark.createDataFrame([(i, f"http://{h}/a/{i:03}", b) for i, h, b in pages], "page_id long, url string, html string").repartition(5)
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(frame).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == in_order(pages)
    frames = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(frame.where("false").unionByName(frame)).collect()}
    assert frames == got and got[30].count("line") == 3 and "Site name" not in got[30] and "Foot" not in got[30]


def test_long_line_lists_align_in_little_memory():
    a = list(range(6_000))
    b = [x for x in a if x % 3] + [-1] * 500
    b[100:100] = range(-900, -100)
    assert html_extract.common_lines(a, b) == {x for x in a if x % 3}


def test_markup_that_is_easily_misread():
    text = lambda html: html_extract.main_text(html_extract.blocks(html), [])
    assert text("<article><p data-x=O'Neil>one</p><p title='a>b' q=\"c'>d\">two</p></article>") == "one\n\ntwo"
    assert text("<article><p>x <math><mi>y</mi></math> <svg><text>z</text></svg> <object>w</object></p><textarea>typed</textarea></article>") == "x y z w"


def test_columns_that_clash_nulls_and_equal_rows(spark):
    rows = [(1, "http://h/a", "<article>A</article>", "x", "y"), (1, "http://h/a", "<article>A</article>", "x", "y"), (None, None, None, None, None), (None, "http://h/b", "", "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, gone string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html_extract.extract_main_text(frame).collect()), key=repr)
    assert got == sorted([(1, "http://h/a", "A"), (1, "http://h/a", "A"), (None, None, ""), (None, "http://h/b", "")], key=repr)
    assert html_extract.extract_main_text(frame.where("false")).count() == 0
