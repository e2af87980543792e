"""Markup that is hard to tell from text: quoted angle brackets, broken tags, unclosed starts."""

import random
import time

import pytest
from test_html_depth import Plain

from quillon.llm import html


def text_of(page):
    return [b.text for b in html.blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p>start</p><img alt="a < b" title="secret">', ["start"]),
        ('<a title="x<y>z" href="/q">link</a>', ["link"]),
        ("<p a='x>y' b=\"<q>\" c = '<i>' >z", ["z"]),
        ("<p title=it's>don't</p>", ["don't"]),
        ('<p class="x>text</p><p>more</p>', ["text", "more"]),
        ("x < y and z > w", ["x < y and z > w"]),
        ("<!--> a <p>b<!-- c <p>d", ["a", "b"]),
        ("<script>if (1<2) '</p>'</script >y<svg/>z<style a='>'>q</style>", ["yz"]),
        ("</ z>q</>r<!doctype html><?php x?>", ["qr"]),
        ('a<a href="x', ["a"]),
        ("a <!-", ["a"]),
    ],
)
def test_what_is_markup(page, want):
    assert text_of(page) == want


def test_random_attributes_against_another_parser():
    rng = random.Random(5)
    bits = ["<", ">", "a", " ", "=", "&amp;", "/", "class", "</p>", "<!--", "1 < 2"]
    for _ in range(2000):
        page = ""
        for _ in range(rng.randrange(1, 6)):
            tag, quote = rng.choice(["p", "div", "b", "a", "li"]), rng.choice("\"'")
            value = "".join(rng.choice([*bits, "'" if quote == '"' else '"']) for _ in range(rng.randrange(8)))
            page += f"<{tag} x={quote}{value}{quote}>word{rng.randrange(9)} </{tag}>"
        other = Plain()
        other.feed(page)
        other.close()
        other.flush()
        assert text_of(page) == [t for t, _ in other.found], page


@pytest.mark.parametrize("start", ["<script ", "<!", "<a \"", '<a ="', "<a ='x", "<a =\" '", "<!--", "</", "<", "<x y=\">", "<a =   "])
@pytest.mark.parametrize("tail", ["", "<>", ">"])
def test_unclosed_starts_take_linear_time(start, tail):
    def seconds(n):
        page, began = start * (n // len(start)) + tail, time.perf_counter()
        assert sum(1 for _ in html.tokens(page)) >= 0
        return time.perf_counter() - began

    assert seconds(1_000_000) < 4  # a quadratic scan takes minutes
