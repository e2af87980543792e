"""Secret scans: base patterns, and tokens that a primed compressor finds novel.

A candidate of the second kind is a whole run of token characters, some of which lie
near a word such as ``password`` or ``credential``. It is compressed with Zstandard
twice over: after a dictionary made of common identifiers and the text around it, and
as the empty string after the same dictionary. The difference are the bytes that the
token adds; a token that repeats its surroundings or is made of identifiers adds few,
a random one nearly as many as it has bits. The surroundings are taken without the
token, so a secret that stands several times does not hide itself. Spans count code
points and end before their end.

A compressor finds any unseen word novel, as it does not gain from the letters of so
short a string. So the order of a run's characters is looked at before: ``surprise``
gives their bits under a small model of letter pairs, trained here on the dictionary's
identifiers and some prose, with a price for each change between cases, letters and
digits. Names, words, paths and versions have few bits a character, whatever their
length; random runs have many, also those of one case. A number is asked about from
``LONG_NUMBER`` digits. In the tests, planted random tokens of 12 characters or more
are found at a rate of at least 0.9 for every alphabet, 0.95 for most.

Null text is an empty one. Very long texts are scanned whole, in time linear in their
length; the dictionary holds a bounded neighbourhood of the candidate, which is the
method's window and not a limit on what is scanned. Other columns pass through; where
the input has a column of the result's name, the result's gets underscores before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free_name, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short as a whole holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_\x20-]?key|credential|authorization|bearer|private[_\x20-]?key|access[_\x20-]?key|auth[_\x20-]?key|signing[_\x20-]?key", re.IGNORECASE | re.ASCII)
#: A block of key lines up to its end, or where that is missing as long as lines of key characters follow.
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----)[\s\S])*(?=-----END )|(?:\\n|[\s\"'+>#*]|[A-Za-z0-9+/=]{16,})*)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")
#: Common identifiers and words of code that the dictionary starts with.
IDENTIFIERS = (
    "abstract application array attribute authentication authorization boolean buffer builder callback "
    "certificate class client column command component config configuration connection const constructor "
    "container content context controller create credential database default delete description document "
    "element environment exception export extends factory false filename filter final format function "
    "handler header identifier implements import index instance integer interface iterator localhost logger "
    "manager message method module namespace number object option override package parameter password path "
    "private property protected provider public query reference register repository request required "
    "resource response result return schema secret select server service session setting static status "
    "storage string struct template throws timestamp token transaction true undefined update username "
    "validate value variable version void example placeholder changeme 0123456789 abcdefghijklmnopqrstuvwxyz"
)
REACH = 96  # characters between the sensitive word and the candidate
AROUND = 2048  # characters of context on each side in the dictionary
LEAST_BITS = 4.5  # marginal bits a character
LEAST_ENTROPY = 1.8  # bits a character of the token alone, below which it is not compressed at all
LEAST_SURPRISE = 5.0  # bits a character of the pair model from which the compressor is asked
CHANGE = 2.0  # bits of a change between letters and digits, or from upper to lower case and back
LONG_NUMBER = 12  # digits from which a number is a candidate
#: What the letter model is trained on beside the identifiers: plain prose of some languages.
PROSE = (
    "the store keeps a list of things that somebody wrote down on the way to the sea and did not read them again because there was no time left "
    "when people work together they share what they know about each other and about the world which makes it easier to find good answers to hard questions "
    "international communication organization development information management administration responsibility characteristic understanding government environmental performance experience knowledge "
    "die Verwaltung der Daten liegt bei den Behoerden und wird durch die Gesellschaft nach den Vorschriften des Landes schnell weiter entwickelt Schifffahrt Zusammenarbeit Rechtsschutz Dampf "
    "le gouvernement pense que les enfants doivent aller au travail pendant la semaine et rester avec leurs parents pour les vacances toujours quelque chose "
    "la ciudad tiene muchas calles con tiendas donde los vecinos compran la comida y hablan de las noticias con sus amigos afortunadamente trabajo"
)

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def marginal_bytes(token: str, around: str) -> int:
    """What the token adds after identifiers and its surroundings."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False).compress
    return len(squeeze(token.encode())) - len(squeeze(b""))


def surroundings(text: str, start: int, end: int) -> str:
    """``AROUND`` characters on each side, without what repeats the token."""
    token, far = text[start:end], AROUND + end - start
    before, after = text[max(0, start - far) : start].replace(token, ""), text[end : end + far].replace(token, "")
    return before[-AROUND:] + "\n" + after[:AROUND]


def bound(token: str, least_bits: float = LEAST_BITS) -> float:
    """Marginal bits a character that a token of its alphabet must add; ``least_bits`` is that of 64 characters."""
    symbols = 16 if _HEX_ONLY.fullmatch(token) else 64
    return least_bits * math.log2(symbols) / 6


_HEX_ONLY = re.compile(r"[0-9A-Fa-f-]+")


@lru_cache(1)
def letter_pairs() -> dict[str, float]:
    """Bits of each letter after another, or at the start of a word (after a space), in lower case."""
    text = f" {IDENTIFIERS} {PROSE} ".lower()
    letters = [c for c in set(text) if c.isalpha()]
    pairs, firsts = Counter(zip(text, text[1:])), Counter(text[:-1])
    return {a + b: -math.log2((pairs[a, b] + 0.05) / (firsts[a] + 0.05 * len(letters))) for a in [" ", *letters] for b in letters}


def surprise(token: str) -> float:
    """Bits of the token's characters; a separator has those of one of 6, a digit of one of 10, or of 36 in a part with letters."""
    bits, pairs = 0.0, letter_pairs()
    for part in _SEPARATORS.split(token):
        digit = math.log2(36 if any(map(str.isalpha, part)) else 10)
        last, kind = " ", " "
        for c in part:
            now = "d" if c.isdigit() else "u" if c.isupper() else "l"
            if now == "d":
                bits += digit
            else:
                begins = kind in " d" or (kind == "l" and now == "u")  # a word begins
                bits += min(pairs.get((" " if begins else last) + c.lower(), 8.0), 8.0)
            if kind != " " and now != kind:
                bits += CHANGE
            last, kind = c.lower(), now
    return bits + math.log2(6) * sum(map(len, _SEPARATORS.findall(token)))


def generated(token: str) -> bool:
    """Whether a run may be no word, name, path, date or version, so that the compressor is asked."""
    number = max(map(len, _NUMBERS.findall(token)), default=0)
    return number >= LONG_NUMBER or surprise(token) >= LEAST_SURPRISE * len(token)


_SEPARATORS = re.compile(r"[._/~+=-]+")
_NUMBERS = re.compile(r"\d+")


def novel_spans(text: str, least_bits: float = LEAST_BITS) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context whose marginal size says that they are random."""
    out = []
    near = contexts(text)
    k = 0
    for m in CANDIDATE.finditer(text) if near else ():
        while k < len(near) and near[k][1] <= m.start():
            k += 1
        if k == len(near):
            break
        if near[k][0] >= m.end():
            continue
        token = m[0]
        if not generated(token) or entropy(token) < LEAST_ENTROPY:
            continue
        if 8 * marginal_bytes(token, surroundings(text, m.start(), m.end())) >= bound(token, least_bits) * len(token):
            out.append((m.start(), m.end(), 3))
    return out


def contexts(text: str) -> list[tuple[int, int]]:
    """Where candidates may lie, as disjoint spans: ``REACH`` characters about sensitive words, and all of a key block."""
    found = [(max(0, s.start() - REACH), s.end() + REACH) for s in SENSITIVE.finditer(text)]
    if "-----BEGIN " in text:
        found += [m.span() for m in BLOCK.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def entropy(token: str) -> float:
    """Bits a character of the token's own characters: a cheap bound before the compressor."""
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in map(token.count, set(token)))


def all_spans(text: str | None, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int]]:
    """Base spans and those of the compressor that no base span covers."""
    if not text:
        return []
    base = base_spans(text)
    added, k, reach = [], 0, 0  # ``reach``: the furthest end of the base spans that begin before a candidate's end
    for x in novel_spans(text, least_bits):
        while k < len(base) and base[k][0] < x[1]:
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= x[0]:
            added.append(x)
    return [(KINDS[k], a, b) for a, b, k in sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1]))]


def secret_spans(docs: DataFrame, text: str = "text", name: str = "secrets", least_bits: float = LEAST_BITS) -> DataFrame:
    """``docs`` with an array of spans (kind, start, end) ordered by start, then kind."""
    name = free_name(docs, name)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, least_bits)] for part in texts(batch) for t in part], pa.list_(_SPAN))

    return docs.withColumn(name, F.arrow_udf(scan, SPANS)(F.col(text)))
