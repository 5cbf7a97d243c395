"""The block labeller on pages by hand, and on odd tables."""

import numpy as np

from quillspark.llm import html_blocks

from .html_pages import PAGES


def test_pages_by_hand(html_model):
    right = found = wanted = whole = 0
    wrong = []
    for html, blocks in PAGES:
        read = html_blocks.leaves(html)
        got = [b[1] for b, ok in zip(read, html_blocks.labelled(html_model, [read])[0]) if ok]
        common = sum(min(got.count(b), blocks.count(b)) for b in set(got))
        right, found, wanted, whole = right + common, found + len(got), wanted + len(blocks), whole + (got == blocks)
        if got != blocks:
            wrong.append((html[:80], got, blocks))
    assert len(PAGES) >= 60 and 2 * right / (found + wanted) >= 0.9, (2 * right / (found + wanted), whole, wrong)


def test_given_pages_keep_their_articles(html_model):
    """On pages with one article element, its blocks are exactly what is found: nothing else is dropped or kept."""
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() + pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        read = html_blocks.leaves(html or "")
        assert html_blocks.labelled(html_model, [read])[0].tolist() == ["<article" in path for path, _, _ in read]


def test_odd_rows(spark, html_model):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a very long page goes on.</p>" for i in range(6000)) + "</article>"
    rows = [(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", long, "x"), (4, "w", "<p", "x"), (5, "w", "<script>no end", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {}
    for r in html_blocks.extract(pages, html_model).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert sorted(map(len, got.values())) == [1, 1, 1, 1, 1, 2] and got[1] == ["\n".join(PAGES[0][1])] * 2
    assert got[2] == got[None] == [""] and len(got[3][0].split("\n")) == 6000
    assert html_blocks.extract(pages.limit(0), html_model).count() == 0


def test_forms_and_ties():
    """A score of just one half isn't main text."""
    model = html_blocks.BiLSTM()
    for v in model.p.values():
        v[:] = 0
    assert not html_blocks.labelled(model, [html_blocks.leaves("<p>one</p>")])[0].any()
    assert np.allclose(model.long_scores(html_blocks.leaves("<p>one</p>")), 0.5)
