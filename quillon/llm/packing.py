"""Best-fit packing of token pieces by a configuration linear program.

A document's ids are cut into pieces of at most ``capacity`` ids, the first piece
being the shorter one. How pieces fill sequences depends only on the histogram of
their lengths, which has ``capacity`` bins whatever the corpus. The program has a
variable for each multiset of lengths that fits one sequence (a configuration); it
is solved by multiplicative weights: lengths that are covered too little weigh
more, a knapsack by dynamic programming finds the configuration of the greatest
weight, and that one is used some more. The fractions are rounded down, what is
left over goes best fit, the longest first, into the room that is left and into new
sequences. Rounding tries several parts of the solution, as best fit needs enough
short pieces to close gaps, and keeps the result of the fewest sequences.

The driver holds the histogram and the configurations. Pieces get their places from
their length and their rank among pieces of that length; the rank is counted in
salted groups of bounded size, so a length that many pieces have is no hot spot.

Null text is an empty one: a piece that holds the end id alone. Rows that are
repeated are packed as often as they come, rows without an id as well. An empty table
gives no pieces. A row of the result is a piece, so of the input's columns only the id
goes on, whatever the others are named.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quillon.durable import durable
from quillon.llm.shared import texts

CAPACITY = 1024
END_ID = 2
#: Pieces of one length and salt that are ranked together.
SALT_ROWS = 1_000
ROUNDS = 400
#: The split into words that the vocabulary was made with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of white space in a row that ``tiktoken`` is not given (it bears some 900,000).
LONG_SPACE = 100_000
_SPACE = re.compile(r"\s{1000,}")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that ``tokenizers`` gives by a byte-level BPE file, through ``tiktoken`` at several times the speed.

    ``tiktoken`` knows no added tokens and overflows its stack on long runs of white
    space; texts that hold either go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        self.added = [t["content"] for t in read.get("added_tokens", [])]
        ranks = {bytes(byte_of[c] for c in word): number for word, number in read["model"]["vocab"].items() if word not in self.added and all(c in byte_of for c in word)}
        self.path = path
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole: Tokenizer | None = None

    def encode_ordinary(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or (len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACE.finditer(text))):
            self.whole = self.whole or Tokenizer.from_file(self.path)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    Ids are little-endian unsigned 32-bit numbers. Without them only their CRC-32 leaves
    the task that makes them.
    """
    path = vocabulary or public_vocabulary()
    names = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"} | ({"ids": "binary"} if with_ids else {})

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(path)
        types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        kind = pa.list_(pa.struct([(n, types[t]) for n, t in names.items()]))
        for batch in batches:
            made = [pa.array([_cut(bpe.encode_ordinary(t or ""), capacity, end_id, with_ids) for t in part], kind) for part in texts(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    kind = f"array<struct<{','.join(f'{n}:{t}' for n, t in names.items())}>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.arrow_udf(cut, kind)(F.col(text))).alias("p")).select("doc_id", "p.*")


def _cut(ids: list[int], capacity: int, end_id: int, with_ids: bool) -> list[dict]:
    ids.append(end_id)
    data = memoryview(np.array(ids, dtype="<u4").tobytes())
    first = (len(ids) - 1) % capacity + 1
    out = []
    for k, (a, b) in enumerate(pairwise([0, *range(first, len(ids) + 1, capacity)])):
        own = data[4 * a : 4 * b]
        out.append({"piece": k, "start": a, "length": b - a, "ids_crc32": crc32(own)} | ({"ids": bytes(own)} if with_ids else {}))
    return out


@dataclass
class Plan:
    """Kinds of sequences: how many of each kind, and the lengths that each holds, longest first."""

    capacity: int
    kinds: list[tuple[int, tuple[int, ...]]]
    lower_bound: float

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.kinds)

    def tables(self) -> dict[int, np.ndarray]:
        """For each length rows of (first rank, pieces in a sequence, first sequence, offset of the first), by rank."""
        out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        base = 0
        for n, lengths in self.kinds:
            offset = 0
            for length in dict.fromkeys(lengths):
                k = lengths.count(length)
                out[length].append((used[length], k, base, offset))
                used[length] += n * k
                offset += k * length
            base += n
        return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def best_pattern(weights: np.ndarray, lengths: np.ndarray, limit: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of lengths within the capacity of the greatest weight, how often each is taken, and that weight.

    Dynamic programming over the capacity; pieces of a length beyond its ``limit``
    are given back after it.
    """
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fit = np.searchsorted(lengths, room, side="right")
        if fit:
            with_one = value[room - lengths[:fit]] + weights[:fit]
            k = int(with_one.argmax())
            if with_one[k] > value[room] + 1e-15:
                value[room], taken[room] = with_one[k], k
    counts = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    while room:
        if taken[room] < 0:
            room -= 1
            continue
        counts[taken[room]] += 1
        room -= int(lengths[taken[room]])
    return np.minimum(counts, limit), float(value[capacity])


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Packs ``histogram`` (length: count) into as few sequences as the program, rounded, needs."""
    if not histogram:
        return Plan(capacity, [], 0.0)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    left = need.astype(float)
    found: dict[bytes, tuple[np.ndarray, float]] = {}
    lower = float((lengths * need).sum() / capacity)
    size = (lengths / capacity) ** CONVEX
    weights = size
    for _ in range(rounds):
        open_ = left >= 1
        if not open_.any():
            break
        price = np.where(open_, weights, 0.0)
        pattern, most_price = best_pattern(price, lengths, left.astype(np.int64), capacity)
        # prices under which no configuration costs more than 1 bound the sequences from below
        lower = max(lower, float(price @ need) / most_price)
        if not pattern.any():
            break
        in_use = pattern > 0
        most = (left[in_use] / pattern[in_use]).min()
        step = max(1.0, np.floor(most * STEP)) if most >= 1 else 0.0
        if not step:
            break
        key = pattern.tobytes()
        found[key] = (pattern, found.get(key, (pattern, 0.0))[1] + step)
        left = left - step * pattern
        share = left / need  # what is covered least gains weight
        weights = size * np.exp(ETA * (share - share.mean()))
    best: Plan | None = None
    for part in PARTS:
        kinds = [(n, pattern) for pattern, x in found.values() if (n := int(part * x))]
        rest = need - sum((n * pattern for n, pattern in kinds), np.zeros_like(need))
        plan = Plan(capacity, _best_fit(kinds, lengths, rest, capacity), lower)
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best


#: The part of a configuration's largest possible use that one round adds.
STEP = 0.5
#: Parts of the program's solution that the rounding tries to keep before best fit packs the rest.
PARTS = (1.0, 0.9, 0.75, 0.5, 0.25, 0.0)
#: How strongly a length that is covered too little gains weight.
ETA = 0.2
#: Above 1: of configurations that fill a sequence, the one of longer pieces, as short ones fill gaps later.
CONVEX = 1.1


def _best_fit(kinds: list[tuple[int, np.ndarray]], lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """What the rounding left over, the longest first, each into the tightest room that takes it; alike sequences at once."""
    rooms: dict[int, list[list]] = defaultdict(list)  # room: [count, lengths]
    for n, pattern in kinds:
        held = tuple(int(x) for x in np.repeat(lengths, pattern)[::-1])
        rooms[capacity - sum(held)].append([n, held])
    for k in range(len(lengths) - 1, -1, -1):
        length, count = int(lengths[k]), int(left[k])
        while count:
            room = min((r for r, of in rooms.items() if r >= length and of), default=None)
            if room is None:
                fit = capacity // length
                whole, rest = divmod(count, fit)
                if whole:
                    rooms[capacity - fit * length].append([whole, (length,) * fit])
                if rest:
                    rooms[capacity - rest * length].append([1, (length,) * rest])
                break
            n, held = rooms[room].pop()
            fit = min(room // length, count)
            uses = min(n, count // fit)
            if n > uses:
                rooms[room].append([n - uses, held])
            rooms[room - fit * length].append([uses, (*held, *(length,) * fit)])
            count -= uses * fit
    return [(n, tuple(sorted(held, reverse=True))) for of in rooms.values() for n, held in of if n]


def placed(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``cut`` (pieces with ``doc_id, piece, length`` and more) with ``sequence_id`` and ``offset``.

    ``cut`` is read several times: pass a frame that is written.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row a length
    tables = solve(histogram, capacity, rounds).tables()
    salts = [max(1, -(-histogram.get(n, 0) // salt_rows)) for n in range(capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.lit(salts), F.col("length").cast("int"))).cast("int")
    salted = cut.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + rank - 1)

    def place(length: pa.Array, rank_: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank_.to_numpy(zero_copy_only=False)
        seq, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for value in np.unique(n):
            mine = n == value
            rows = tables[int(value)]
            row = rows[np.searchsorted(rows[:, 0], r[mine], side="right") - 1]
            k = r[mine] - row[:, 0]
            seq[mine], offset[mine] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * value
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(offset)], names=["sequence_id", "offset"])

    at = F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")(F.col("length"), F.col("rank"))
    return ranked.withColumn("at", at).select(*cut.columns, "at.*")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` with their places; with their ids, or for less to write without them."""
    return placed(durable(pieces(docs, doc_id, text, capacity, vocabulary, with_ids=with_ids)), capacity)


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, for a trainer to read; a sequence has a bounded size."""
    return placed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p")).select("sequence_id", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"))
