"""Removal of passages that an earlier document has, by suffix arrays over shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
of a smaller id. To bring equal strings together without shipping the corpus, each
window of ``length`` bytes is filed under its minimizer, the least hash of the
``GRAM``-byte strings in it; equal windows have equal minimizers. A run of windows
with one minimizer is a segment.

1. Every task cuts its documents into segments and sends on a segment's hashes and
   its place, packed into one block for each receiving partition. Of equal segments
   within the task only that of the least document goes on; the others are decided,
   their bytes go.
2. A receiving task decides equal segments of different tasks in the same way: those
   whose minimizer, length and two hashes (64 and 31 bits) are equal, without comparing
   their bytes, as those would have to be sent. The hashes are polynomials of two bases
   drawn anew for each call, so neither texts made to collide nor a weakness of one base
   has bytes removed. What is left are differing segments with one minimizer, for each
   the first document that has it; they may share windows all the same. Their texts are
   fetched.
3. These texts, dealt by minimizer, are the shards. A shard's suffix array is built by
   prefix doubling, or induced sorting if long strings repeat, with the permuted common prefixes; neighbours that agree in
   ``length`` bytes are equal windows, and all but those of the least document go.
   Where very many segments share a minimizer, their windows are dealt by it and what
   stands before or behind it; where very many share that, one by one under the
   hash of the whole window, so no task gets them all. Equal texts of a shard are
   decided before it is sorted.

Null text is empty. Matches within one document, or between rows with one id, remove
nothing. Rows without an id keep all bytes and remove none. Texts shorter than
``length`` keep all bytes. An empty table stays empty. Only spans go back to the
documents; other columns pass through, and where the input has a column of the
result's name, the result's gets underscores before it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.llm.shared import free_name, stored_bytes
from quillon.llm.suffix import permuted_lcp, suffix_array

LENGTH = 50
GRAM = 24
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 1 << 19
#: Segments that a task holds before it sends them on.
HELD = 1 << 18
#: Differing segments of one minimizer beyond which single windows are dealt.
HOT = 2048
#: Bytes of a suffix array's text, but for a minimizer with more.
SHARD_BYTES = 1 << 20
#: Bytes of stored input for each of the partitions, which are read whole; there are as many as shuffle partitions at least.
PART_BYTES = 16 << 20
#: Bits of a place's last number that are the segment's size; until segments are decided a second hash stands above them.
_SIZE = (1 << 32) - 1

#: Bits of a minimizer that segments are filed under, and of its place in a slice.
_FILED, _AT = 38, 26
#: Bits of the hash of what surrounds a minimizer on either side; windows for each minimizer up to which its place is sent as well.
_SIDE, _WIDEST = 28, 128
#: doc, start, bytes of a segment, and the hashes it is filed under.
#: and of what surrounds the minimizer: two windows that share one agree on half of the rest, before or behind it.
_PLACE = np.dtype([("group", "<u8"), ("same", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("bytes", "<i8")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def drawn_base() -> int:
    """A base whose powers modulo 2**64 repeat as late as any."""
    return int.from_bytes(os.urandom(8), "little") & ~7 | 5


class Powers:
    """Powers of a hash's base and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factors = np.full(max(n, SLICE_BYTES), self.base, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = np.uint64(pow(self.base, -1, 1 << 64))
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


def _totals(data: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The polynomial of each prefix of the data."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64)))


def segments(texts: list[bytes], docs: np.ndarray, length: int, powers: Powers, second: Powers) -> np.ndarray:
    """The segments of some documents, as ``_PLACE`` rows in the order of the text, a second hash above their sizes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=_PLACE)
    up, down = powers.upto(n + 1)
    total = _totals(data, down)
    low = _mixed((total[GRAM:] - total[:-GRAM]) * up[: n - GRAM + 1]) >> np.uint64(64 - _FILED) << np.uint64(_AT)
    placed = n < 1 << _AT  # else a text of its own, whose runs of equal minimizers are not told apart
    if placed:
        low |= np.arange(len(low), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    # low[p]: the minimizer of the window at p and its place; windows that run into the next document are none
    windows = np.maximum(sizes - length + 1, 0)
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[doc]
    if not len(at):
        return np.zeros(0, dtype=_PLACE)
    of = low[at]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]))))
    start = at[first]
    stop = start + np.diff(np.append(first, len(at))) - 1 + length
    out = np.empty(len(first), dtype=_PLACE)
    out["group"] = of[first] >> np.uint64(_AT)
    out["same"] = _first_hash(total, up, start, stop)
    out["doc"] = docs[doc[first]]
    out["start"] = start - begins[doc[first]]
    up_2, down_2 = second.upto(n + 1)
    out["bytes"] = stop - start | _second_hash(_totals(data, down_2), up_2, start, stop)
    out["around"] = _EITHER
    if placed and width <= _WIDEST:
        gram = (of[first] & np.uint64((1 << _AT) - 1)).astype(np.int64)
        half = width // 2
        before, behind = gram - half, gram + GRAM + half
        left = np.where(before >= start, _hash_of(total, up, np.maximum(before, 0), gram + GRAM) >> np.uint64(64 - _SIDE) | np.uint64(1), np.uint64(0))
        right = np.where(behind <= stop, _hash_of(total, up, gram, np.minimum(behind, n)) >> np.uint64(64 - _SIDE) | np.uint64(1), np.uint64(0))
        out["around"] = left << np.uint64(64 - _SIDE) | right << np.uint64(64 - 2 * _SIDE) | (gram - start).astype(np.uint64) << np.uint64(1)
    return out


#: Of a segment that may match on either side, whatever the hashes.
_EITHER = np.uint64(1)


def _around(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes before and behind the minimizer (0 where no window has as much), and where in the segment it begins."""
    a, side = p["around"], np.uint64((1 << _SIDE) - 1)
    return a >> np.uint64(64 - _SIDE), a >> np.uint64(64 - 2 * _SIDE) & side, (a >> np.uint64(1) & np.uint64(_WIDEST - 1)).astype(np.int64)


def _hash_of(total: np.ndarray, up: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _mixed((total[stop] - total[start]) * up[start] + (stop - start).astype(np.uint64))


def _first_hash(total: np.ndarray, up: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _hash_of(total, up, start, stop)


def _second_hash(total: np.ndarray, up: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """31 bits, at their place above the size."""
    return (_hash_of(total, up, start, stop) >> np.uint64(33) << np.uint64(32)).astype(np.int64)


def _sized(places: np.ndarray) -> np.ndarray:
    """Decided places, with their sizes alone."""
    places["bytes"] &= _SIZE
    return places


def may_match(p: np.ndarray) -> np.ndarray:
    """Which places, sorted by group, agree around the minimizer with one of another document."""
    left, right, _ = _around(p)
    out = p["around"] == _EITHER
    if out.any():  # then all of such a group
        return np.isin(p["group"], p["group"][out]) | _shared(p, left) | _shared(p, right)
    return _shared(p, left) | _shared(p, right)


def filed(p: np.ndarray, length: int, hot: int) -> np.ndarray:
    """The texts to be fetched, under ``group``; ``same`` says whether their windows are dealt one by one.

    A segment goes whole, under its minimizer. Where more than ``hot`` share that, its windows
    with half of the rest or more before the minimizer, and those with as much behind it, go
    under the minimizer and that half, if another document has it. Only where as many
    share this too are windows dealt one by one.
    """
    many = _count(p["group"]) > hot
    whole, of = p[~many], p[many]
    either = np.isin(of["group"], of["group"][of["around"] == _EITHER])
    single, of = of[either], of[~either]
    whole["same"], single["same"] = 0, 1
    out = [whole, single]
    left, right, at = _around(of)
    half = (length - GRAM + 1) // 2
    gram, stop = of["start"] + at, of["start"] + of["bytes"]
    first = (of["start"], np.maximum(of["start"], gram + GRAM + half - length))
    end = (np.minimum(stop, gram - half + length), stop)
    for k, side in enumerate((left, right)):
        some = _shared(of, side)
        more = of[some]
        more["group"] = _mixed(more["group"] ^ _mixed(side[some] << np.uint64(1) | np.uint64(k)))
        more["same"] = _count(more["group"]) > hot
        more["start"], more["bytes"] = first[k][some], (end[k] - first[k])[some]
        out.append(more)
    out = np.concatenate(out)
    out["around"] = 0
    return out


def _count(key: np.ndarray) -> np.ndarray:
    """How often each value is there."""
    _, run, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[run]


def _shared(p: np.ndarray, side: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), dtype=bool)
    some = np.flatnonzero(side > 0)
    if not len(some):
        return out
    order = some[np.lexsort((side[some], p["group"][some]))]
    group, key, doc = p["group"][order], side[order], p["doc"][order]
    new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))))
    many = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new)
    out[order] = np.repeat(many, np.diff(np.append(new, len(order))))
    return out


def firsts_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments those of the least document, and those of other documents, whose bytes go.

    Segments count as equal if their minimizers, lengths and hashes are, of which the
    second stands above the length; the first hash alone sorts them unless two of it
    differ in the others.
    """
    if not len(places):
        return places, places
    order = np.argsort(places["same"])
    same, alike = _runs_of_equals(places, order)
    if (same > alike).any():
        order = np.lexsort((places["bytes"], places["group"], places["same"]))
        _, alike = _runs_of_equals(places, order)
    doc = places["doc"][order]
    new = np.concatenate(([True], ~alike))
    at = np.flatnonzero(new)
    first = doc == np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(order))))
    kept = places[order[first]]
    # a document may have a segment at several places, and a place comes again with a repeated row
    again = np.concatenate(([False], kept["same"][1:] == kept["same"][:-1]))
    if again.any():
        some = again | np.append(again[1:], False)
        more = kept[some]
        more = more[np.lexsort((more["start"], more["doc"], more["same"]))]
        once = np.concatenate(([True], (more["same"][1:] != more["same"][:-1]) | (more["doc"][1:] != more["doc"][:-1]) | (more["start"][1:] != more["start"][:-1])))
        kept = np.concatenate((kept[~some], more[once]))
    return kept, places[order[~first]]


def _runs_of_equals(places: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place but the first has the hash of the one before it, and whether it has its minimizer and length as well."""
    same = places["same"][order]
    same = same[1:] == same[:-1]
    alike = same.copy()
    for field in ("group", "bytes"):
        x = places[field][order]
        alike &= x[1:] == x[:-1]
    return same, alike


def _runs(places: np.ndarray) -> np.ndarray:
    """The same bytes as disjoint places, by document and start."""
    if not len(places):
        return places
    p = places[np.lexsort((places["start"], places["doc"]))]
    new, end = merged(p["doc"], p["start"], p["start"] + p["bytes"])
    out = p[new]
    out["bytes"] = end - out["start"]
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans joined; spans are sorted by document and start. Gives where each begins, and its end."""
    order = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    reach = np.maximum.accumulate(end + order * (int(end.max()) + 1)) - order * (int(end.max()) + 1)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))))
    return new, reach[np.append(new[1:], len(doc)) - 1]


_BLOCK = "part int, places binary, spans binary, wanted binary"
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("places", pa.binary()), ("spans", pa.binary()), ("wanted", pa.binary())])
_DOC = "doc bigint, spans binary, wanted binary"
_DOC_SCHEMA = pa.schema([("doc", pa.int64()), ("spans", pa.binary()), ("wanted", pa.binary())])


def _dealt(places: np.ndarray, key: np.ndarray, parts: int) -> list[bytes | None]:
    """Packed places for each partition, by a hash of the key."""
    part = (_mixed(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((places["start"], places["doc"], part))
    sorted_ = places[order]
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    doc = np.diff(sorted_["doc"], prepend=0)
    some = cuts[:-1][cuts[:-1] < len(places)]
    doc[some] = sorted_["doc"][some]
    sorted_["doc"] = doc
    pack = zstandard.ZstdCompressor(level=1).compress
    table = sorted_.view(np.uint8).reshape(len(places), _PLACE.itemsize)
    return [_packed(table[a:b], pack) if a < b else None for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def _blocks(parts: int, places: np.ndarray | None = None, spans: np.ndarray | None = None, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """A block for each partition: places go by minimizer, spans and wanted segments by document."""
    nothing = [None] * parts
    columns = [nothing if p is None else _dealt(p, p[k].view(np.uint64), parts) for p, k in ((places, "group"), (spans, "doc"), (wanted, "doc"))]
    rows = [(k, *r) for k, r in enumerate(zip(*columns, strict=True)) if any(r)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)


def _gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All places, spans and wanted segments of a partition's blocks."""
    held: list[list[np.ndarray]] = [[np.zeros(0, _PLACE)] for _ in range(3)]
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k, name in enumerate(("places", "spans", "wanted")):
            held[k] += [_unpacked(b, unpack) for b in batch.column(name).drop_null().to_pylist()]
    return [np.concatenate(h) for h in held]


def _packed(table: np.ndarray, pack: Callable[[bytes], bytes]) -> bytes:
    """The bytes of places in order, documents as differences, byte by byte, for the shuffle to compress."""
    return pack(np.ascontiguousarray(table.T))


def _unpacked(data: bytes, unpack: Callable[[bytes], bytes]) -> np.ndarray:
    table = np.frombuffer(unpack(data), dtype=np.uint8).reshape(_PLACE.itemsize, -1)
    out = table.T.copy().view(_PLACE).reshape(-1)
    out["doc"] = np.cumsum(out["doc"])
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents in slices of bounded size, but for a longer one, which is a slice."""
    docs: list[int] = []
    held: list[bytes] = []
    size = 0
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for at in range(0, len(column), 64):
            for d, t in zip(ids.slice(at, 64).to_pylist(), column.slice(at, 64).cast(pa.binary()).to_pylist(), strict=True):
                if size and size + len(t or b"") > SLICE_BYTES:
                    yield np.array(docs, dtype=np.int64), held
                    docs, held, size = [], [], 0
                docs.append(d)
                held.append(t or b"")
                size += len(t or b"")
    if docs:
        yield np.array(docs, dtype=np.int64), held


def _cutter(length: int, parts: int, bases: tuple[int, int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, second = map(Powers, bases)
        found: list[np.ndarray] = []
        for docs, held in _sliced(batches):
            found.append(segments(held, docs, length, powers, second))
            if sum(map(len, found)) > HELD:
                yield send(found)
                found = []
        if found:
            yield send(found)

    def send(found: list[np.ndarray]) -> pa.RecordBatch:
        first, gone = firsts_of(np.concatenate(found))
        return _blocks(parts, places=first, spans=_runs(_sized(gone)))

    return cut


def _decider(length: int, parts: int, hot: int):
    """Joins the tasks' segments; sends spans to the documents, and asks for the texts of differing segments with one minimizer."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, spans, _ = _gathered(batches)
        first, gone = map(_sized, firsts_of(places))
        del places
        wanted = first
        if len(first):
            first = first[np.argsort(first["group"])]
            new = np.concatenate(([True], first["group"][1:] != first["group"][:-1]))
            run, at = np.cumsum(new) - 1, np.flatnonzero(new)
            count = np.diff(np.append(at, len(first)))
            ask = (count > 1) & (np.maximum.reduceat(first["doc"], at) != np.minimum.reduceat(first["doc"], at))
            wanted = first[ask[run]]
            wanted = filed(wanted[may_match(wanted)], length, hot)
        yield _blocks(parts, spans=_runs(np.concatenate((spans, gone))), wanted=wanted)

    return decide


def _by_doc(p: np.ndarray) -> dict[int, np.ndarray]:
    p = p[np.lexsort((p["start"], p["doc"]))]
    cut = np.flatnonzero(np.concatenate(([True], p["doc"][1:] != p["doc"][:-1]))) if len(p) else []
    return {int(of["doc"][0]): of for of in np.split(p, cut[1:])} if len(p) else {}


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the partition: its spans (start, end) and its wanted segments."""
    _, spans, wanted = _gathered(batches)
    by_doc, asked = _by_doc(_runs(spans)), _by_doc(wanted)
    docs = sorted(by_doc.keys() | asked.keys())
    for at in range(0, len(docs), 4096):
        some = docs[at : at + 4096]
        pairs = [None if (p := by_doc.get(d)) is None else np.stack([p["start"], p["start"] + p["bytes"]], axis=1).astype("<i8").tobytes() for d in some]
        texts = [None if (p := asked.get(d)) is None else p.tobytes() for d in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(pairs, pa.binary()), pa.array(texts, pa.binary())], schema=_DOC_SCHEMA)


_SEGMENT = "part int, doc bigint, key binary, start bigint, text binary"
_SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("text", pa.binary())])


def _fetcher(length: int, parts: int):
    """Cuts the wanted segments out of their documents.

    Of equal windows within a batch those of the least document go on; the others are
    decided, and go on as places in a row without a key.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            windows: dict[bytes, list[tuple[int, int]]] = {}
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for doc, text, wanted in zip(some.column("doc").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(), some.column("wanted").to_pylist(), strict=True):
                    for group, split, _, _, start, n in np.frombuffer(wanted, dtype=_PLACE).tolist():
                        if not split:
                            out.append((group % parts, doc, group.to_bytes(8, "big"), start, text[start : start + n]))
                            continue
                        for k in range(start, start + n - length + 1):
                            windows.setdefault(text[k : k + length], []).append((doc, k))
            gone: list[tuple[int, int]] = []
            for window, places in windows.items():
                key = hashlib.blake2b(window, digest_size=8).digest()
                least = min(places)[0]
                out += [(int.from_bytes(key, "big") % parts, doc, key, k, window) for doc, k in places if doc == least]
                gone += [place for place in places if place[0] > least]
            if gone:
                spans = _runs(_as_places(*np.array(gone, dtype=np.int64).T, length))
                out.append((gone[0][0] % parts, None, None, None, spans.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT_SCHEMA, strict=True)], schema=_SEGMENT_SCHEMA)

    return fetch


def shard_spans(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The windows of a shard's segments that a smaller document of the shard has, as places.

    Each text is sorted once. It stands for the least document that has it; what other
    documents have of it goes, and all places of that document lose the same.
    """
    code, texts = _coded(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int32)
    by_code = np.argsort(code, kind="stable")
    least = np.minimum.reduceat(docs[by_code], np.searchsorted(code[by_code], np.arange(len(texts))))
    again = docs > least[code]
    decided = _as_places(docs[again], starts[again], sizes[code[again]])
    decided = decided[decided["bytes"] >= length]
    if (least == least[0]).all():
        return decided
    data = np.frombuffer(b"\0".join(texts), dtype=np.uint8).astype(np.int16) + 1
    begins = (np.cumsum(sizes + 1) - (sizes + 1)).astype(np.int32)
    data[(begins[1:] - 1)] = 0  # between texts, below any byte
    order = suffix_array(data)
    segment = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)[: len(data)]
    room = np.repeat(begins + sizes, sizes + 1)[: len(data)] - np.arange(len(data), dtype=np.int32)
    agree = permuted_lcp(np.maximum(data - 1, 0), order, length)[order] >= length
    whole = room[order] >= length
    order, agree = order[whole], agree[whole]  # what stands between two equal windows begins as they do
    if not len(order):
        return decided
    new = np.flatnonzero(np.concatenate(([True], ~agree[1:])))
    owner = least[segment[order]]
    earlier = np.repeat(np.minimum.reduceat(owner, new), np.diff(np.append(new, len(order))))
    gone = order[owner > earlier]
    # the places of each window's text in its least document
    held = by_code[~again[by_code]]
    first = np.searchsorted(code[held], np.arange(len(texts) + 1))
    of = segment[gone]
    many = np.diff(first)[of]
    place = held[np.repeat(first[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    return np.concatenate((decided, _as_places(docs[place], starts[place] + np.repeat(gone - begins[of], many), length)))


def _coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each text, and the differing texts."""
    coded = pa.array(texts, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _as_places(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(docs), dtype=_PLACE)
    out["doc"], out["start"], out["bytes"] = docs, starts, sizes
    return out


def _sharder(length: int, parts: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        whole = pa.Table.from_batches(read)
        lone = whole["key"].is_null()
        found = [np.frombuffer(b, dtype=_PLACE) for b in whole["text"].filter(lone).to_pylist()]
        whole = whole.filter(pc.invert(lone)).sort_by("key").combine_chunks()
        keys = whole["key"].to_pylist()
        texts, docs, starts = whole["text"].to_pylist(), whole["doc"].to_numpy(), whole["start"].to_numpy()
        at = 0
        while at < len(keys):
            end, size = at, 0
            while end < len(keys) and (size < SHARD_BYTES or keys[end] == keys[end - 1]):
                size += len(texts[end])
                end += 1
            found.append(shard_spans(texts[at:end], docs[at:end], starts[at:end], length))
            at = end
        if found:
            yield _blocks(parts, spans=_runs(np.concatenate(found)))

    return solve


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc, spans``: packed pairs of byte offsets to remove, in one or more rows a document."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(docs) // PART_BYTES))
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    cut = given.mapInArrow(_cutter(length, parts, (drawn_base(), drawn_base())), _BLOCK).repartitionById(parts, F.col("part"))
    decided = durable(cut.mapInArrow(_decider(length, parts, hot), _BLOCK).repartitionById(parts, F.col("part")).mapInArrow(_collect, _DOC))
    asked = given.join(decided.where("wanted IS NOT NULL").select("doc", "wanted"), "doc").select("doc", "text", "wanted")
    shards = asked.mapInArrow(_fetcher(length, parts), _SEGMENT).repartitionById(parts, F.col("part")).mapInArrow(_sharder(length, parts), _BLOCK)
    found = durable(shards.repartitionById(parts, F.col("part")).mapInArrow(_collect, _DOC))
    return decided.unionByName(found).where("spans IS NOT NULL").select("doc", "spans")


def _union(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    if not blobs:
        return []
    pairs = np.frombuffer(b"".join(blobs), dtype="<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    new, end = merged(np.zeros(len(pairs), dtype=np.int64), pairs[:, 0], pairs[:, 1])
    return list(zip(pairs[new, 0].tolist(), end.tolist(), strict=True))


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "spans", **options) -> DataFrame:
    """``docs`` with an array column of the packed spans, null where nothing goes."""
    key, name = free_name(docs, "doc"), free_name(docs, name)
    spans = removed_spans(docs, doc_id, text, **options).groupBy("doc").agg(F.collect_list("spans").alias(name)).withColumnRenamed("doc", key)
    return docs.join(spans, F.col(doc_id) == F.col(key), "left").drop(key)


_DIGEST = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digests(text: Column, spans: Column) -> Column:
    """Of each text: bytes, removed bytes, removed runs, SHA-256 of what is kept."""

    def digest(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 64):
            for t, blobs in zip(texts.slice(at, 64).cast(pa.binary()).to_pylist(), spans_.slice(at, 64).to_pylist(), strict=True):
                t, gone = t or b"", _union(blobs)
                rows.append({"n_bytes": len(t), "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": hashlib.sha256(_kept(t, gone)).hexdigest()})
        return pa.array(rows, _DIGEST)

    return F.arrow_udf(digest, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")(text, spans)


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, end = [], 0
    for a, b in gone:
        out.append(text[end:a])
        end = b
    return b"".join([*out, text[end:]])


def kept_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "kept", **options) -> DataFrame:
    """``docs`` with the bytes that stay, as binary: a cut may fall inside a character."""

    def keep(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.array([_kept(t or b"", _union(blobs)) for t, blobs in zip(texts.cast(pa.binary()).to_pylist(), spans_.to_pylist(), strict=True)], pa.binary())

    spans, name = free_name(docs, "spans"), free_name(docs, name)
    out = with_spans(docs, doc_id, text, spans, **options)
    return out.withColumn(name, F.arrow_udf(keep, "binary")(F.col(text), F.col(spans))).drop(spans)
