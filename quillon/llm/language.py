"""Language identification with spans of mixed-language texts.

From labelled documents the operator learns how often each language has each
character gram (hashed) and each script. The script of a word's first letter leaves
the languages that use it, and only these are scored: its grams give each of them a
log probability. A Viterbi path over the words of a text, with a penalty for each switch of language, labels spans; the
language with the most letters names the text, and its share of them is the score.

The labelled documents may be a bounded sample: about ``sample`` documents of each
language, chosen by a hash of the id, so the choice depends on nothing else. The
model has a fixed size. Null texts and texts without letters are ``und`` with score
0, and so is every text if nothing was learned. Texts are read whole. A row without an
id is not held out. Other columns pass through (where the input has a column of the
result's name, the result's gets underscores before it), and neither labels nor ids
reach a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free_name, texts

SAMPLE = 3000
GRAMS = 1 << 16
PENALTY = 8.0
#: Part of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
#: Words whose scores a task keeps, and words of a block that is decoded together.
CACHE_WORDS = 500_000
BLOCK_WORDS = 2_000_000
# First code points of ranges in the order of Unicode, and their scripts.
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words of letters: all gram numbers, where each word's begin, the script of each word's first letter."""
    joined = "\n" + "\n".join(words) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes  # of each word in ``joined``
    number = []
    for n in (1, 2, 3):  # grams that end in a word or at the break behind it
        h = np.zeros(len(c), dtype=np.uint64)
        for k in range(n - 1, -1, -1):
            h = (h ^ (np.concatenate((np.zeros(k, np.uint64), c[: len(c) - k])) + np.uint64(1 + n))) * np.uint64(0x9E3779B97F4A7C15)
        number.append((h >> np.uint64(48)).astype(np.int64) % GRAMS)
    stacked = np.stack(number, axis=1)  # one row a character
    # a word owns the rows of its letters and of the break behind it
    own = stacked[1:].reshape(-1)
    starts = 3 * (begin - 1)
    return own, starts, scripts_of(words)


def scripts_of(words: list[str]) -> np.ndarray:
    """The number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_FIRST, first, side="right") - 1]


def _count(langs: list[str]):
    """Sums of gram and script counts by language, one row for each that is not zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), GRAMS + len(_NAMES)), dtype=np.int64)
        for batch in batches:
            langs_ = batch.column("lang").to_pylist()
            at = 0
            for part in texts(batch.column("text")):
                for text in part:
                    words = [w for w in map(_letters, (text or "").lower().split()) if w]
                    if words:
                        own, _, script = features(words)
                        row = sums[langs.index(langs_[at])]
                        row[:GRAMS] += np.bincount(own, minlength=GRAMS)
                        row[GRAMS:] += np.bincount(script, minlength=len(_NAMES))
                    at += 1
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(sums[lang, bucket])], names=["lang", "bucket", "n"])

    return count


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: np.ndarray  # log probability by gram and language
    scripts: np.ndarray  # 0 where a language has a script, else the great loss that stands for its score

    def parts(self) -> tuple:
        return self.langs, self.grams, self.scripts

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by word and language, and the letters of each word; no letters, no preference."""
        plain = [_letters(w.lower()) for w in words]
        letters = np.fromiter(map(len, plain), np.int64, len(plain))
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        some = np.flatnonzero(letters)
        script = scripts_of([plain[k] for k in some])
        for of in np.unique(script).tolist():
            mine = some[script == of]
            own, starts, _ = features([plain[k] for k in mine])
            out[mine] = self.scripts[of]
            for k in np.flatnonzero(self.scripts[of] == 0):
                out[mine, k] = np.add.reduceat(self.grams[:, k][own], starts)
        return out, letters


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows, or about ``sample`` of each language where there are more."""
    given = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in given.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model((), np.zeros((GRAMS, 0), np.float32), np.zeros((len(_NAMES), 0), np.float32))
    million = 1_000_000
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(million, -(-million * sample // counts[k])))))
    chosen = given.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(million)) < share[F.col("lang")])
    rows = chosen.select("text", "lang").repartition(8).mapInArrow(_count(langs), "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((GRAMS + len(_NAMES), len(langs)))
    sums[rows["bucket"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    grams, scripts = sums[:GRAMS], sums[GRAMS:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * GRAMS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    loss = np.where(uses | ~uses.any(axis=1, keepdims=True), 0.0, -1e4)
    return Model(tuple(langs), logs.astype(np.float32), loss.astype(np.float32))


def viterbi(scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best path of each text (``sizes`` words each, ``ids`` into ``scores``), all texts at once, word by word."""
    n_langs = scores.shape[1]
    kind = np.int8 if n_langs < 128 else np.int32
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    best = np.zeros((len(sizes), n_langs), dtype=np.float32)
    came = np.zeros((len(ids), n_langs), dtype=kind)
    lang = np.arange(n_langs, dtype=kind)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more words than t
    for t in range(longest):
        k = active[t]
        now, at = best[:k], starts[:k] + t
        top = now.argmax(axis=1)
        moved = now[np.arange(k), top] - penalty
        stay = now >= moved[:, None]
        came[at] = np.where(stay, lang, top[:, None])
        best[:k] = np.where(stay, now, moved[:, None]) + scores[ids[at]]
    path = np.zeros(len(ids), dtype=kind)
    label = best.argmax(axis=1).astype(kind)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = label[:k]
        label[:k] = came[at, label[:k]]
    return path


class Labeller:
    """Labels texts with a model, keeping the scores of words it has seen."""

    def __init__(self, parts: tuple) -> None:
        self.model = Model(*parts)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for each word; the scores of new words are added."""
        get = self.known.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        if (ids < 0).any():
            new = list(dict.fromkeys(words[k] for k in np.flatnonzero(ids < 0).tolist()))
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            scores, letters = self.model.score(new)
            self.pending.append((scores, letters))
            ids = np.fromiter(map(get, words), np.int64, len(words))
        return ids

    def labelled(self, docs: list[str | None]) -> list[dict]:
        """For each text: language, score, and spans of (language, first word, end)."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        split = [(d or "").split() for d in docs]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        if not self.model.langs or not sizes.sum():
            return [{"lang": "und", "score": 0.0, "spans": []} for _ in docs]
        ids = self.numbers([w for words in split for w in words])
        self.scores = np.concatenate([self.scores, *(p[0] for p in self.pending)])
        self.letters = np.concatenate([self.letters, *(p[1] for p in self.pending)])
        path = viterbi(self.scores, ids, sizes)
        n_langs = len(self.model.langs)
        doc = np.repeat(np.arange(len(docs)), sizes)
        weight = np.bincount(doc * n_langs + path, weights=self.letters[ids], minlength=len(docs) * n_langs).reshape(len(docs), n_langs)
        total, top = weight.sum(axis=1), weight.argmax(axis=1)
        begin = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))))
        out = [{"lang": self.model.langs[k] if n else "und", "score": float(w[k] / n) if n else 0.0, "spans": []} for k, n, w in zip(top.tolist(), total.tolist(), weight, strict=True)]
        first = np.cumsum(sizes) - sizes
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(path)], strict=True):
            d = int(doc[a])
            if total[d]:
                out[d]["spans"].append({"lang": self.model.langs[path[a]], "start": a - int(first[d]), "end": b - int(first[d])})
        return out


KIND = "struct<lang:string,score:double,spans:array<struct<lang:string,start:bigint,end:bigint>>>"
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def predicted(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column: language, score, spans of words (split at white space)."""
    known = docs.sparkSession.sparkContext.broadcast(model.parts())  # of a fixed size a language
    name = free_name(docs, name)

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(known.value)
        for batch in batches:
            rows, held, size = [], [], 0
            for part in texts(batch):
                for t in part:
                    held.append(t)
                    size += len(t or "") // 4
                    if size > BLOCK_WORDS:
                        rows += labeller.labelled(held)
                        held, size = [], 0
            yield pa.array(rows + labeller.labelled(held), _KIND)

    return docs.withColumn(name, F.arrow_udf(label, KIND)(F.col(text)))
