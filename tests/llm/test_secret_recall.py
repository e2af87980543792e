"""What the novelty scan finds of planted secrets, what it leaves alone, and how long it takes."""

import hashlib
import random
import re
import string
import time

import pytest

from quillon.llm import secrets
from quillon.llm.queries import QUERIES

WORDS = "the store keeps a list of things that somebody wrote down on the way to the sea and did not read again".split()
TRIALS = 600
ALPHABETS = {
    "base64": (string.ascii_letters + string.digits + "+/", (12, 16, 24, 40, 64)),
    "lower and digits": (string.ascii_lowercase + string.digits, (12, 16, 24, 40)),
    "letters": (string.ascii_letters, (24, 40)),
    "upper hex": ("0123456789ABCDEF", (32, 64, 512)),
    "lower letters": (string.ascii_lowercase, (24, 40)),
    "digits": (string.digits, (24, 40)),
}
#: Of these fewer have to be found.
SHORT = {"lower letters": (string.ascii_lowercase, (12, 14, 16, 20, 23)), "upper letters": (string.ascii_uppercase, (12, 14, 16, 20, 23)), "digits": (string.digits, (12, 14, 16, 20, 23)), "letters": (string.ascii_letters, (12, 16, 20)), "upper hex": ("0123456789ABCDEF", (12, 16, 20))}


@pytest.mark.parametrize("alphabet,n", [(a, n) for a, (_, sizes) in ALPHABETS.items() for n in sizes])
def test_recall_of_planted_secrets(alphabet, n):
    rng = random.Random(f"{alphabet} {n}")
    found = 0
    for _ in range(TRIALS):
        token = "".join(rng.choice(ALPHABETS[alphabet][0]) for _ in range(n))
        before, after = (" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(2))
        text = f"{before} {rng.choice(('the credential is', 'Authorization: Bearer', 'X-Api-Key:'))} {token} {after}"
        at = text.index(token)
        found += any(a <= at and at + n <= b for _, a, b in secrets.all_spans(text))
    assert found >= 0.95 * TRIALS


@pytest.mark.parametrize("alphabet,n", [(a, n) for a, (_, sizes) in SHORT.items() for n in sizes])
def test_recall_of_short_secrets_of_one_kind_of_characters(alphabet, n):
    rng = random.Random(f"short {alphabet} {n}")
    found = 0
    for _ in range(TRIALS):
        token = "".join(rng.choice(SHORT[alphabet][0]) for _ in range(n))
        before = " ".join(rng.choice(WORDS) for _ in range(40))
        text = f"{before} curl -H 'Authorization: Bearer {token}' a || curl -H 'Authorization: Bearer {token}' b"
        found += sum(k == "novel" and text[a:b] == token for k, a, b in secrets.all_spans(text)) == 2
    assert found >= 0.9 * TRIALS


def test_few_names_of_code_are_reported():
    """Names of this language's own library, none of which the letter model has seen as such."""
    import argparse, ast, asyncio, collections, decimal, email.message, http.client, inspect, logging.handlers, os, socket, ssl, subprocess, tarfile, typing, unittest, urllib.request, zipfile  # noqa: E401

    names: set[str] = set()
    for module in (argparse, ast, asyncio, collections, decimal, email.message, http.client, inspect, logging.handlers, os, socket, ssl, subprocess, tarfile, typing, unittest, urllib.request, zipfile):
        for key, value in vars(module).items():
            names |= {key, *(vars(value) if isinstance(value, type) else ())}
    names = sorted(n for n in names if len(n) >= 12)
    reported = [n for n in names if secrets.all_spans(f"the token {n} is a name")]
    assert len(names) > 1000 and len(reported) <= 0.06 * len(names)


@pytest.mark.parametrize(
    "text",
    [
        "the token getUserNameFromRequest returns a credential_provider_configuration",
        "password rules: see docs/security/passwords/strength-meter.html and section-12.3.1",
        "api key added on 2024-11-02T10 in version2.0.11 of auth-service",
        "the secret Donaudampfschifffahrt of the authorizationProviderFactory",
    ],
)
def test_names_paths_dates_and_versions_are_no_secrets(text):
    assert secrets.all_spans(text) == []


def test_whole_tokens_are_reported():
    rng = random.Random(4)
    token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(150))
    text = f"x {token} then the credential"
    assert secrets.all_spans(text) == [("novel", 2, 152)]


def test_time_is_linear():
    began = time.perf_counter()
    assert secrets.all_spans("token " * 1_000_000) == []
    assert secrets.all_spans("-----BEGIN PRIVATE KEY-----\n" * 50_000) == []
    many = "password=abcdefgh1 " * 100_000
    assert len(secrets.all_spans(many)) == 100_000
    assert time.perf_counter() - began < 30


LETTERS = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
BASE = {
    "assign": rf"""(?:{"|".join(LETTERS.values())}|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}


def brute_base(text):
    least = {"assign": 6, "access": 20, "hex": 24}
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if len(m[1]) >= least[kind]]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_query_against_brute_force_on_all_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute_base(r.text or "") for r in docs.select("doc_id", "text").collect()}
    assert sum(map(len, want.values())) > 0
    for r in QUERIES["op5_secret_scan"](spark, sf_dir).collect():
        base = want[r.doc_id]
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel:")] == named


def test_result_beside_a_column_of_its_name(odd):
    out = secrets.secret_spans(odd)
    assert out.columns == [*odd.columns, "_secrets"]
    assert {r.secrets for r in out.collect()} == {"secrets!"}
