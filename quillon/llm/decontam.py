"""Benchmark decontamination by a broadcast set of the benchmark's word windows.

Words are runs of ASCII letters, digits and any other than ASCII characters, in
lower case (A-Z only). A window is ``width`` consecutive words of a benchmark item;
a shorter item is one window. Each task turns the words of its documents into the
numbers that the benchmark's words have, hashes all windows of all documents at
once, looks the hashes up in the broadcast set, and verifies each hit word by word.

Only the benchmark is broadcast, in blocks of at most ``block_words`` words (some 60
bytes each, and their vocabulary); an item beyond that goes in pieces that overlap by a
window. A benchmark of one block is one scan. With more, each block is broadcast,
scanned for and released before the next: what it hits is written under the number of
its row, and joined to the rows at the end, so no task holds two blocks.

Null text has no words. Repeated documents are judged alike; repeated items count once
an ``item_id``; empty tables give no hits. Other columns pass through; where the input
has a column of the result's name, the result's gets underscores before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.llm.shared import byte_texts, free_name

WIDTH = 10
#: Bound of one broadcast block of the benchmark.
BLOCK_WORDS = 1_000_000
_TO_SPACE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_TO_SPACE).split()


class WindowSet:
    """The windows of some benchmark items: for each width their hashes in order, the words of each, and the items that have it."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH) -> None:
        self.number: dict[bytes, int] = {}
        self.names = list(dict.fromkeys(name for name, _ in items))
        at = {name: k for k, name in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], dtype=np.int32)
            if n := min(width, len(ids)):
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), at[name]))
        self.windows = {n: _indexed(of, n) for n, of in found.items()}

    def parts(self) -> tuple:
        """What to broadcast: plain values, as executors may lack this module."""
        return self.number, self.names, self.windows

    @classmethod
    def of(cls, parts: tuple) -> WindowSet:
        out = cls([])
        out.number, out.names, out.windows = parts
        return out

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str | None]]]:
        """For each document the windows that it has, as word spans, and their items."""
        out: list[tuple[list[tuple[int, int]], set[str | None]]] = [([], set()) for _ in docs]
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        total = int(sizes.sum())
        if not total or not self.windows:
            return out
        get = self.number.get
        ids = np.fromiter((get(w, -1) for d in docs for w in d), dtype=np.int32, count=total)
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(docs)), sizes)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, (hashes, ids_of, first, owners) in self.windows.items():
            if total < n:
                continue
            at = np.flatnonzero((known[n:] - known[:-n] == n) & (doc[n - 1 :] == doc[: total - n + 1]))
            if not len(at):
                continue
            own = ids[at[:, None] + np.arange(n)]
            h = _hash(own, n)
            near = np.searchsorted(hashes, h)
            open_ = np.flatnonzero(near < len(hashes))
            while len(open_):  # windows of one hash stand behind each other
                open_ = open_[hashes[near[open_]] == h[open_]]
                same = (ids_of[near[open_]] == own[open_]).all(axis=1)  # verified word by word
                for k in open_[same].tolist():
                    i, w = int(at[k]), near[k]
                    spans, seen = out[doc[i]]
                    spans.append((i - int(starts[doc[i]]), i - int(starts[doc[i]]) + n))
                    seen.update(self.names[o] for o in owners[first[w] : first[w + 1]].tolist())
                open_ = open_[~same]
                near[open_] += 1
                open_ = open_[near[open_] < len(hashes)]
        return out


def _indexed(of: list[tuple[np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of ``n`` words with their items: distinct hashes in order, words, where the items of each begin, and the items."""
    windows = np.concatenate([w for w, _ in of])
    owner = np.repeat(np.array([o for _, o in of], dtype=np.int32), [len(w) for w, _ in of])
    h = _hash(windows, n)
    order = np.lexsort((owner, *(windows[:, k] for k in range(n - 1, -1, -1)), h))
    windows, owner, h = windows[order], owner[order], h[order]
    new = np.concatenate(([True], (windows[1:] != windows[:-1]).any(axis=1)))
    fresh = new | np.concatenate(([True], owner[1:] != owner[:-1]))  # an item counts once a window
    at = np.flatnonzero(new[fresh])
    return h[new], np.ascontiguousarray(windows[new]), np.append(at, int(fresh.sum())), owner[fresh]


def _hash(windows: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(windows), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ (windows[:, k].astype(np.uint64) + np.uint64(1))) * _FACTOR
            h ^= h >> np.uint64(29)
    return h


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int, width: int = WIDTH) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time. A long item goes in pieces that have all its windows."""
    rows, size = [], 0
    most = max(block_words, 2 * width)
    for name, value in benchmark.select(F.col(item).cast("string"), text).where(F.col(text).isNotNull()).toLocalIterator():
        split = words(value.encode())
        for at in range(0, max(1, len(split) - width + 1), most - width + 1):
            piece = split[at : at + most]
            if rows and size + len(piece) > block_words:
                yield rows
                rows, size = [], 0
            rows.append((name, b" ".join(piece)))
            size += len(piece)
    yield rows


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS, name: str = "hits") -> DataFrame:
    """``docs`` with a struct column: word count, disjoint hit word spans, items whose windows occur.

    Items are named by ``item`` as text, in no order; a null ``item_id`` is left out
    of the names, its windows are hit all the same.
    """
    context, name = docs.sparkSession.sparkContext, free_name(docs, name)
    given = blocks(benchmark, item, item_text, block_words, width)
    block, following = next(given), next(given, None)
    if following is None:
        known = context.broadcast(WindowSet(block, width).parts())
        return docs.withColumn(name, _scanner(known)(F.col(text)))
    row = free_name(docs, "row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    found: DataFrame | None = None
    for block in chain([block, following], given):
        known = context.broadcast(WindowSet(block, width).parts())
        hit = numbered.select(F.col(row).alias("row"), _scanner(known)(F.col(text)).alias("h")).where(F.size("h.spans") > 0)
        hit = durable(hit.select("row", "h.spans", "h.items"))
        known.destroy()  # what it has hit is written
        found = hit if found is None else found.unionByName(hit)
    merged_ = found.groupBy("row").agg(_joined(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged_ = merged_.select(F.col("row").alias(free_name(numbered, "hit_row")), F.struct("spans", "items").alias(free_name(numbered, "hit")))
    key, of = merged_.columns
    empty = HITS.replace("struct<n_words:bigint,", "struct<")
    both = F.coalesce(F.col(of), F.struct(F.array().alias("spans"), F.array().alias("items")).cast(empty))
    out = numbered.join(merged_, F.col(row) == F.col(key), "left")
    return out.withColumn(name, F.struct(_counted(F.col(text)).alias("n_words"), both["spans"].alias("spans"), both["items"].alias("items"))).drop(row, key, of)


def _counted(text: Column) -> Column:
    return F.arrow_udf(_count, "bigint")(text)


def _count(text: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for part in byte_texts(text) for t in part], pa.int64())


def _scanner(known):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = WindowSet.of(known.value)
        for batch in batches:
            rows = []
            for part in byte_texts(batch):
                split = [words(t) for t in part]
                for w, (spans, items) in zip(split, windows.scan(split), strict=True):
                    rows.append({"n_words": len(w), "spans": [{"start": a, "end": b} for a, b in merged(spans)], "items": list(items - {None})})
            yield pa.array(rows, _HITS)

    return F.arrow_udf(scan, HITS)


def _joined(spans):
    return F.arrow_udf(_join, "array<struct<start:bigint,end:bigint>>")(spans)


def _join(spans: pa.Array) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in row])] for row in spans.to_pylist()], pa.list_(_SPAN))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans; what lay between the words of a span goes too."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, data[end:]]).decode()


def without_spans(text, spans):
    """Texts without the hit spans, for a use that keeps the rest of a contaminated document."""
    return F.arrow_udf(_cut_all, "string")(text, spans)


def _cut_all(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([None if t is None else cut(t, [(s["start"], s["end"]) for s in of or ()]) for t, of in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``) or without the hit words (``'spans'``)."""
    name = free_name(docs, "hits")
    found = hits(docs, benchmark, text, name=name, **options)
    if remove == "documents":
        return found.where(F.size(F.col(name)["spans"]) == 0).drop(name)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    return found.withColumn(text, F.when(F.size(F.col(name)["spans"]) > 0, without_spans(F.col(text), F.col(name)["spans"])).otherwise(F.col(text))).drop(name)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
