"""Quality rules as a short-circuit cascade.

Each task runs every rule on the first documents that it reads, timing the rules
and counting what they reject. From then on it asks the rules in the order of
rejections per second and stops at the first that rejects. The order decides only
the cost: a document is kept if no rule rejects it, whatever the order.

Null text counts as an empty one. Repeated rows and ties are judged alike, an empty
table gives an empty result, and other columns pass through untouched; where the input
has a column of the result's name, the result's gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from operator import eq
from time import perf_counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free_name, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
#: Documents of each task on which the rules' cost and selectivity are measured.
SAMPLE_ROWS = 200


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at \x20 and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return len(self._lines)

    @cached_property
    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of eight words that the text has twice or more."""
        w = self.words
        windows = list(zip(*(w[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen: set = set()
        again: set = set()
        for x in windows:
            (again if x in seen else seen).add(x)
        covered = end = 0
        for at, x in enumerate(windows):
            if x in again:
                covered += at + WINDOW - max(at, end)
                end = at + WINDOW
        return covered

    @cached_property
    def n_stutters(self) -> int:
        """Words that equal the word before them."""
        return sum(map(eq, self.words, self.words[1:]))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``rejects`` is true of its measures."""

    name: str
    rejects: Callable[[Measures], bool]


#: Integer comparisons only, so that any engine decides alike.
BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("many_symbols", lambda m: 100 * m.n_symbols > 8 * m.word_chars),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("stuttering", lambda m: 100 * m.n_stutters > 30 * m.n_words),
    Rule("shouting", lambda m: 2 * m.n_upper > m.n_letters),
    Rule("long_words", lambda m: m.word_chars > 20 * m.n_words),
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words),
)


class Cascade:
    """The rules, first all of them on a sample, then in the order of rejections per second."""

    def __init__(self, rules: Sequence[Rule], sample_rows: int) -> None:
        self.rules, self.left = list(rules), sample_rows
        self.cost, self.rejected = [0.0] * len(rules), [0] * len(rules)

    def first_rejecting(self, m: Measures) -> str | None:
        if self.left > 0:
            return self._sampled(m)
        return next((r.name for r in self.rules if r.rejects(m)), None)

    def _sampled(self, m: Measures) -> str | None:
        found = None
        for k, rule in enumerate(self.rules):
            fresh, began = Measures(m.text), perf_counter()  # a rule pays for the measures it needs
            if rule.rejects(fresh):
                self.rejected[k] += 1
                found = found or rule.name
            self.cost[k] += perf_counter() - began
        self.left -= 1
        if not self.left:
            rank = sorted(range(len(self.rules)), key=lambda k: (-self.rejected[k] / max(self.cost[k], 1e-9), self.cost[k]))
            self.rules = [self.rules[k] for k in rank]
        return found


def verdicts(rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, measures: Sequence[str] = ()):
    """A column function: text to ``struct<kept, rejected_by, measure...>``.

    ``rejected_by`` names the rule that stopped the cascade; which of several rules
    that is depends on the measured order, ``kept`` does not.
    """
    kind = pa.struct([("kept", pa.bool_()), ("rejected_by", pa.string()), *((k, pa.int64()) for k in measures)])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cascade = Cascade(rules, sample_rows)
        for batch in batches:
            rows = []
            for part in texts(batch):
                for text in part:
                    m = Measures(text)
                    by = cascade.first_rejecting(m)
                    rows.append((by is None, by, *(getattr(m, k) for k in measures)))
            columns = zip(*rows, strict=True) if rows else [()] * len(kind)
            yield pa.StructArray.from_arrays([pa.array(c, kind.field(k).type) for k, c in enumerate(columns)], fields=list(kind))

    returned = "struct<kept:boolean,rejected_by:string" + "".join(f",{k}:bigint" for k in measures) + ">"
    return F.arrow_udf(judge, returned)


def judged(docs: DataFrame, text: str = "text", name: str = "verdict", **options) -> DataFrame:
    """``docs`` with one more column, a struct of the verdict and the asked measures."""
    return docs.withColumn(free_name(docs, name), verdicts(**options)(F.col(text)))


def kept_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that no rule rejects, with the columns they had."""
    name = free_name(docs, "verdict")
    return judged(docs, text, name, **options).where(F.col(f"`{name}`.kept")).drop(name)
