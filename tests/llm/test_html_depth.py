"""Deep and broken pages, and blocks by another parser."""

import time
from html.parser import HTMLParser

import pytest

from quillon.llm import html


class Plain(HTMLParser):
    """Texts between tags that end a block."""

    SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.held, self.found = [], [], []

    def flush(self):
        if text := " ".join("".join(t for t, _ in self.held).split()):
            self.found.append((text, self.held[0][1]))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE:
            self.flush()
        if tag not in html.VOID:
            named = [f".{v.lower()}" for k, values in attrs if k in ("class", "id", "role") for v in (values or "").split()]
            self.open.append((tag, *named))

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.flush()
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n[0] in self.SKIPPED for n in self.open):
            self.held.append((data, tuple(x for n in self.open for x in n)))


def test_blocks_of_given_pages_by_another_parser(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert pages
    for page in pages:
        other = Plain()
        other.feed(page)
        other.flush()
        # end tags that may be left out are not this parser's matter, so only the article is looked for in the path
        assert [(b.text, "article" in b.path) for b in html.blocks(page)] == [(t, "article" in p) for t, p in other.found]


def test_vectors_of_paths_are_sums_over_their_tokens():
    import re
    from zlib import crc32

    page = '<div class="a-b x"><ul id=x><li>one<li class="a">two <b>three</b></ul></div><p>four'
    found = html.blocks(page)
    for b, row in zip(found, html.vectors(found, {}), strict=True):
        tokens = set(b.path) | {p for t in b.path for p in re.split(r"[-_.]+", t) if len(p) > 1} | {f"leaf {b.path[-1]}"}
        want = [0] * html.PATH_DIM
        for t in tokens:
            h = crc32(t.encode())
            want[h % html.PATH_DIM] += 1 if h >> 31 else -1
        assert row[: html.PATH_DIM].tolist() == want


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<b>" * 30_000 + "</i>x" * 30_000, "<dd><div>" + "<b>" * 30_000 + "<dt>x" * 30_000, "<a <a " * 50_000, '<a href="x' * 50_000, "<!-- x" * 50_000])
def test_time_is_linear_in_depth(page):
    began = time.perf_counter()
    found = html.blocks(page)
    html.vectors(found, {})
    assert time.perf_counter() - began < 10


def test_result_beside_a_column_of_its_name(spark):
    pages = spark.createDataFrame([(1, "<article><p>a text of the article that is long enough to be one.</p></article>", "x")], "id int, html string, Main string")
    out = html.main_text(pages)
    assert out.columns == ["id", "html", "Main", "_main"] and out.first().Main == "x"


def test_stored_weights_are_those_of_the_training():
    import numpy as np

    made = list(html.synthetic_pages(60, 5))
    pages = [html.vectors(found, {}) for found, _ in made]
    stored, fresh = html.trained().labels(pages), html.train().labels(pages)
    assert np.mean(np.concatenate([a == b for a, b in zip(stored, fresh, strict=True)])) > 0.999  # up to rounding on another machine
