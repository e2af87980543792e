"""Secrets that stand several times, long ones, and blocks of keys."""

import random
import string

import pytest

from quillon.llm import secrets


def random_token(rng, n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choice(letters) for _ in range(n))


def novel(text):
    return [text[a:b] for k, a, b in secrets.all_spans(text) if k == "novel"]


def test_a_secret_on_several_lines_does_not_hide_itself():
    t = random_token(random.Random(1), 40)
    assert novel(f"curl -H 'Authorization: Bearer {t}' a\ncurl -H 'Authorization: Bearer {t}' b\n") == [t, t]
    rest = " of the words that stand between" * 64  # the second stands across the end of the dictionary's window
    assert novel(f"Authorization: Bearer {t}\n{rest[: secrets.AROUND - 40]}\nAuthorization: Bearer {t}") == [t, t]


@pytest.mark.parametrize("n", [32, 128, 512, 4096])
def test_the_bound_goes_by_the_alphabet(n):
    t = random_token(random.Random(n), n, "0123456789ABCDEF")
    assert novel(f"credential {t} end") == [t]


@pytest.mark.parametrize("word", ["X-Api-Key:", "api key:", "access-key", "private key", "auth-key", "signing key"])
def test_words_with_a_space_or_hyphen_between(word):
    t = random_token(random.Random(2), 40)
    assert novel(f"the {word} {t} here") == [t]


@pytest.mark.parametrize("kind", ["PRIVATE KEY", "RSA PRIVATE KEY"])
@pytest.mark.parametrize("closed", [True, False])
def test_all_lines_of_a_key_block(kind, closed):
    rng = random.Random(3)
    lines = [random_token(rng, 64, string.ascii_letters + string.digits + "+/") for _ in range(25)]
    text = f"-----BEGIN {kind}-----\n" + "\n".join(lines) + (f"\n-----END {kind}-----\n" if closed else "\n\nand then prose ") + "word " * 40 + random_token(rng, 40)
    assert novel(text) == lines
