"""Whole license texts, as they stand and edited, in a file of other text."""

import random

import pytest

from quillon.llm import licenses

WORDS = "the river ran past a house of red stone where nobody had lived for years and the door stood open".split()


def around(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_as_it_stands(name):
    rng = random.Random(name)
    text = licenses.TEMPLATES[name]
    n = len(licenses._words(text))
    (found,) = licenses.Index().matches([f"{around(rng, 30)} {text} {around(rng, 30)}"])
    assert (name, 30, 30 + n - 1, n, n) in found


@pytest.mark.parametrize("name", [n for n, t in sorted(licenses.TEMPLATES.items()) if len(t.split()) >= 40])
def test_long_texts_with_some_words_changed(name):
    rng = random.Random(name)
    index = licenses.Index()
    caught = 0
    for _ in range(20):
        words = licenses.TEMPLATES[name].split()
        for at in rng.sample(range(len(words)), len(words) // 12):
            words[at] = rng.choice(WORDS)
        (found,) = index.matches([f"{around(rng, 30)} {' '.join(words)} {around(rng, 30)}"])
        caught += any(m[0] == name or m[4] >= 0.5 * len(words) for m in found)
    assert caught >= 18


def test_names_tell_two_clause_from_three_clause():
    index = licenses.Index()
    for name in ("BSD-2-Clause-text", "BSD-3-Clause-text"):
        assert [m[0] for m in index.matches([licenses.TEMPLATES[name]])[0]] == [name]
