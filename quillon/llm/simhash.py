"""SimHash fingerprints, and their near-duplicate join by binary tries.

A fingerprint has a bit set if over half of the hashes of a text's word shingles
have it. Two fingerprints link if they differ in at most ``budget`` bits; documents
belong together if links lead from one to the other.

Equal fingerprints are one class, so copies are not compared. Of the ``parts``
parts of a fingerprint, two that differ in ``budget`` bits have at least
``parts - budget`` alike; for each choice of so many parts, fingerprints with these
parts alike meet in one bucket, and a bucket is joined with itself by a trie over
the other bits: pairs of trie nodes descend together, their differing bits add up,
and a pair goes when the sum passes the budget. From each task only a spanning
forest of the links goes on. The number of parts grows with the logarithm of the
classes, so that a bucket of unrelated fingerprints stays small at any size.

Null text and text without words have the fingerprint zero and link like any other.
Rows with one doc_id are one document if their texts are; rows without one link as
well, but name no group unless it has no other rows. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.llm.shared import byte_texts, free_name
from quillon.operators.components import components

WIDTH = 4
SEED = 42
BITS = 64
BUDGET = 4
#: Pairs of trie nodes that a task holds at a time.
FRONTIER = 1 << 18
#: Classes of unrelated texts that a bucket may hold on average.
BUCKET = 64
#: Rows of a partition of buckets.
PART_ROWS = 1_000_000


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t, width) for part in byte_texts(batch) for t in part], dtype=np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(free_name(docs, name), F.arrow_udf(scan, "bigint")(F.col(text)))


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int, frontier: int = FRONTIER) -> np.ndarray:
    """Index pairs (later, earlier) of a spanning forest of the links within groups.

    ``values`` are distinct within a group, and both arrays are sorted by group,
    then value; each group is a trie whose nodes are ranges of the array. A pair of
    nodes is (start, end, start, end, bits that differ so far, bit to look at).
    """
    n = len(values)
    forest = Forest(n)
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.concatenate((cuts[1:], [n]))
    many = ends - cuts > 1
    roots = np.stack([cuts[many], ends[many], cuts[many], ends[many], np.zeros(many.sum(), np.int64), np.full(many.sum(), BITS - 1)], axis=1)
    stack = [roots[at : at + frontier] for at in range(0, len(roots), frontier)]
    while stack:
        pairs = stack.pop()
        if not len(pairs):
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        forest.link(*_leaf_links(values, pairs[small], budget))
        pairs = pairs[~small]
        same = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        pairs = forest.undecided(pairs, same)
        down = _descend(values, pairs, budget)
        stack += [down[at : at + frontier] for at in range(0, len(down), frontier)]
    return forest.edges()


#: Pairs of values below which two nodes are compared value by value.
LEAF = 64


def _descend(values: np.ndarray, pairs: np.ndarray, budget: int) -> np.ndarray:
    a0, a1, b0, b1, diff, bit = pairs.T
    same = (a0 == b0) & (a1 == b1)
    am, bm = _middle(values, a0, a1, bit), _middle(values, b0, b1, bit)
    next_bit = bit - 1
    out = []
    for (x0, x1), (y0, y1), more, of in (((a0, am), (b0, bm), 0, None), ((am, a1), (bm, b1), 0, None), ((a0, am), (bm, b1), 1, None), ((am, a1), (b0, bm), 1, ~same)):
        keep = (x1 > x0) & (y1 > y0) & (diff + more <= budget)
        if of is not None:  # the mirror of the third pair, where the two nodes are one
            keep &= of
        out.append(np.stack([x0, x1, y0, y1, diff + more, next_bit], axis=1)[keep])
    return np.concatenate(out)


def _middle(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where, in each range of values that agree above ``bit``, those with the bit set begin."""
    low, high = start.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        is_set = (values[np.minimum(mid, len(values) - 1)] >> bit.astype(np.uint64)) & np.uint64(1) == 1
        high = np.where(open_ & is_set, mid, high)
        low = np.where(open_ & ~is_set, mid + 1, low)
    return low


def _leaf_links(values: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    a0, a1, b0, b1 = pairs[:, :4].T
    width = b1 - b0
    count = (a1 - a0) * width
    of = np.repeat(np.arange(len(pairs)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    i, j = a0[of] + k // width[of], b0[of] + k % width[of]
    near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    return i[near], j[near]


class Forest:
    """Union-find over the values of a task; the root is the least index."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            r = self.roots()
            a, b = np.maximum(r[i], r[j]), np.minimum(r[i], r[j])
            open_ = a != b
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            np.minimum.at(self.parent, a[open_], b[open_])

    def undecided(self, pairs: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Pairs of nodes whose values are not all in one component yet."""
        if not len(pairs):
            return pairs
        r = self.roots()
        breaks = np.concatenate(([0], np.cumsum(r[1:] != r[:-1]))) if len(r) else r
        uniform = (breaks[pairs[:, 1] - 1] == breaks[pairs[:, 0]]) & (breaks[pairs[:, 3] - 1] == breaks[pairs[:, 2]])
        return pairs[~(uniform & (r[pairs[:, 0]] == r[pairs[:, 2]]))]

    def edges(self) -> np.ndarray:
        r = self.roots()
        child = np.flatnonzero(r != np.arange(len(r)))
        return np.stack([child, r[child]], axis=1)


def parts_for(classes: int, budget: int) -> int:
    """So many parts that alike parts hold enough bits to part unrelated classes."""
    need = math.log2(max(2, classes / BUCKET))
    for parts in range(budget + 1, 2 * budget + 9):
        if (BITS // parts) * (parts - budget) >= need:
            return parts
    return 2 * budget + 8


def masks(parts: int, budget: int) -> list[int]:
    """For each choice of parts that may be alike, the mask of their bits."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[k] for k in of) for of in combinations(range(parts), parts - budget)]


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``src, dst``: a spanning forest of the links between distinct fingerprints."""
    n_classes = classes.count()
    choice = masks(parts_for(n_classes, budget), budget)

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    keyed = classes.select("fingerprint", F.posexplode(F.array(*(F.lit(signed(m)) for m in choice))).alias("choice", "mask")).select("choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("alike"), "fingerprint")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        whole = pa.Table.from_batches(read)
        choice_, alike, value = (whole[c].to_numpy() for c in ("choice", "alike", "fingerprint"))
        value = value.view(np.uint64) if value.dtype == np.int64 else value.astype(np.uint64)
        order = np.lexsort((value, alike, choice_))
        choice_, alike, value = choice_[order], alike[order], value[order]
        group = np.cumsum(np.concatenate(([0], (choice_[1:] != choice_[:-1]) | (alike[1:] != alike[:-1]))))
        found = value[trie_links(value, group, budget)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["src", "dst"])

    # a task reads its partition whole; beyond the session's number there are as many as the classes ask for
    parts = -(-n_classes * len(choice) // PART_ROWS)
    dealt = keyed.repartition("choice", "alike") if parts <= int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else keyed.repartition(parts, "choice", "alike")
    return dealt.mapInArrow(join, "src bigint, dst bigint").distinct()


def node(least: str = "least", key: str = "fingerprint") -> Column:
    """A class as a node of the graph: by its least doc_id, so that the least node of a component names it."""
    return F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(key).alias("key"))


def named_by_least(classes: DataFrame, linked: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``classes`` (``key, least``) with ``component_id``: the least doc_id that links (``src, dst``, both of ``key``) lead to."""
    nodes = classes.select(key, node("least", key).alias("node"))
    ends = [nodes.withColumnsRenamed({key: end, "node": f"{end}_node"}) for end in ("src", "dst")]
    edges = linked.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    found = components(durable(edges))
    return nodes.join(found, "node", "left").select(key, F.coalesce("component", "node")["least"].alias("component_id"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` (the least doc_id of the group) for each row."""
    marked = durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width).drop("text"))
    classes = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    names = durable(named_by_least(classes, links(classes, budget)))
    return marked.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the first of their group, with the columns they had."""
    first = grouped(docs, doc_id, text, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(free_name(docs, "first"))).distinct()
    name = first.columns[0]
    return docs.join(first, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
