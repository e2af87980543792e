"""Near copies: documents whose five-word shingles have a Jaccard index of at least 4/5, by SimHash.

Words are runs of bytes other than ASCII white space, in lower case. A fingerprint has
``LANES`` times 64 bits, each set if over half of the hashes of a text's different
shingles have it. At a Jaccard index of 4/5 two fingerprints differ in a bit with a
probability of acos(8/9) / pi = 0.152 (fewer than 0.19 for the shortest texts). Bits
enough for that index are more than tries descend through (10 of 64 at the median, up
to 21), so the tries of ``simhash`` settle what is close and bands of bits find the rest:

1. Equal texts are one class, so exact copies are not compared.
2. Classes whose first 64 bits differ in at most ``simhash.BUDGET`` are linked by tries.
3. Texts that have all bits of a band in common meet in a bucket, and are compared by
   ``LANES_SENT`` lanes, across the components of step 2 only. A band is a choice of bits;
   its width grows with the logarithm of the classes, so that buckets of unrelated texts
   stay small, and there are as many bands as reach a pair at 4/5 nine times on average.

Lanes allow four standard deviations at that index. Whatever is linked is verified on the
shingles themselves, so no two documents are linked that are not near copies.

Documents belong together if links lead from one to the other. Null text and texts
without words are alike; an empty table stays empty. Rows with one doc_id are one
document if their texts are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable
from quillon.llm import simhash
from quillon.llm.shared import byte_texts, free_name
from quillon.operators.components import components

WIDTH = 5
SIMILAR = (4, 5)
LANES = 8
BITS = 64 * LANES
#: Lanes that go to the buckets, and the bits in which they may differ: of 128, 19 at an index of 4/5, and four standard deviations.
LANES_SENT = 2
DIFFER_SENT = 36
#: The same of all lanes: 78 of 512.
DIFFER = 112
#: The probability that a bit is alike at an index of 4/5, and how many bands reach such a pair on average.
ALIKE = 1 - math.acos(8 / 9) / math.pi
REACHED = 9.2
#: Bits of a band at least, and classes of unrelated texts that a bucket may hold on average.
BAND = 16
BUCKET = 64
#: Shingles that are counted at a time; so many fit a byte.
CHUNK = 255

_RNG = np.random.default_rng(42)
_XOR = np.concatenate(([0], _RNG.integers(0, 1 << 64, LANES - 1, dtype=np.uint64))).astype(np.uint64)
_TIMES = np.concatenate(([1], _RNG.integers(0, 1 << 64, LANES - 1, dtype=np.uint64) | np.uint64(1))).astype(np.uint64)
_SKETCH = pa.struct([("n", pa.int64()), ("bits", pa.list_(pa.int64()))])


def shingles(text: bytes | None, width: int = WIDTH) -> list[bytes]:
    """The runs of ``width`` words; of a shorter text all its words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    return [joined[a:b] for a, b in zip(starts, last, strict=True)]


def sketch(text: bytes | None) -> dict:
    """How many different shingles, and the lanes of the fingerprint; the first is made of the plain hashes."""
    h = xxhash.xxh64_intdigest
    own = np.fromiter({h(s, simhash.SEED) for s in shingles(text)}, np.uint64)
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(own), CHUNK):
        mixed = (own[at : at + CHUNK, None] ^ _XOR) * _TIMES
        mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(32)
        mixed[:, 1:] *= np.uint64(0x9E3779B97F4A7C15)
        count += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return {"n": len(own), "bits": np.packbits(2 * count > len(own)).view(np.int64)}


def bands(classes: int) -> np.ndarray:
    """The bits of each band."""
    width = max(BAND, math.ceil(math.log2(max(1, classes / BUCKET))))
    rng = np.random.default_rng(43)
    return np.stack([rng.permutation(BITS)[:width] for _ in range(math.ceil(REACHED / ALIKE**width))])


def near_pairs(at: np.ndarray, component: np.ndarray, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of pairs within a run of ``at`` (sorted) that are of several components and near by their lanes."""
    cuts = np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True]))) + 1 if len(at) else np.zeros(0, np.int64)
    end = np.repeat(cuts, np.diff(cuts, prepend=0))
    i, step = np.arange(len(at)), 1
    while len(i := i[i + step < end[i]]):
        j = i + step
        near = component[i] != component[j]
        x, y = i[near], j[near]
        near = np.bitwise_count(lanes[:, x] ^ lanes[:, y]).sum(axis=0, dtype=np.int64) <= DIFFER_SENT
        if near.any():
            yield x[near], y[near]
        step += 1


def alike(a: bytes | None, b: bytes | None, similar: tuple[int, int] = SIMILAR) -> bool:
    """Whether the Jaccard index of the shingles is at least ``similar``."""
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) * sum(similar) >= similar[0] * (len(x) + len(y))


def _sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([sketch(t) for part in byte_texts(batch) for t in part], _SKETCH)


def _alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for x, y in batches:
        yield pa.array([alike(a, b) for p, q in zip(byte_texts(x), byte_texts(y), strict=True) for a, b in zip(p, q, strict=True)], pa.bool_())


def _possible(similar: tuple[int, int] = SIMILAR) -> str:
    """What the numbers of shingles and the fingerprints of x and y allow."""
    num, den = similar
    differ = " + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(LANES))
    return f"{den} * x.n >= {num} * y.n AND {den} * y.n >= {num} * x.n AND {differ} <= {DIFFER}"


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``src, dst`` of those pairs (of ids of classes) that are near copies."""
    x, y = (classes.select("id", "key", "n", "bits").alias(side) for side in "xy")
    near = pairs.join(x, F.col("src") == F.col("x.id")).join(y, F.col("dst") == F.col("y.id")).where(_possible())
    near = durable(near.select("src", "dst", F.col("x.key").alias("a_key"), F.col("y.key").alias("b_key")))
    wanted = near.select(F.explode(F.array("a_key", "b_key")).alias("key")).distinct()
    some = durable(texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    both = near.join(some.withColumnsRenamed({"key": "a_key", "text": "a"}), "a_key").join(some.withColumnsRenamed({"key": "b_key", "text": "b"}), "b_key")
    return durable(both.where(F.arrow_udf(_alike, "boolean")(F.col("a"), F.col("b"))).select("src", "dst"))


def _close(classes: DataFrame) -> DataFrame:
    """``src, dst``: a forest of the classes whose first lanes are equal or linked by tries."""
    prints = classes.select("id", F.col("bits")[0].alias("fingerprint"))
    least = durable(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    equal = prints.join(least, "fingerprint").where("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    ends = [least.withColumnsRenamed({"fingerprint": end, "least": f"{end}_id"}) for end in ("src", "dst")]
    tries = simhash.links(least.select("fingerprint")).join(ends[0], "src").join(ends[1], "dst")
    return equal.unionByName(tries.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))


def _met(named: DataFrame, choice: np.ndarray, n_classes: int) -> DataFrame:
    """``src, dst``: classes (id, component, bits) of several components that meet in a band's bucket and are near by the lanes sent."""
    lanes = [f"lane{k}" for k in range(LANES_SENT)]
    schema = f"at bigint, id bigint, component bigint, {', '.join(f'{c} bigint' for c in lanes)}"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(choice.shape[1], dtype=np.int64)
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                own = part["bits"].flatten().to_numpy().reshape(-1, LANES)
                bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1)
                at = np.stack([bits[:, of] @ powers + (b << choice.shape[1]) for b, of in enumerate(choice)], axis=1)
                rest = [part["id"].to_numpy(), part["component"].to_numpy(), *own.T[:LANES_SENT]]
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), *(pa.array(np.repeat(c, len(choice))) for c in rest)], names=["at", "id", "component", *lanes])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        whole = pa.Table.from_batches(read)
        order = np.argsort(whole["at"].to_numpy(), kind="stable")
        at, ident, component, *own = (whole[c].to_numpy()[order] for c in ("at", "id", "component", *lanes))
        for i, j in near_pairs(at, component, np.stack(own).view(np.uint64)):  # of signed numbers, magnitudes would be counted
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ident[i], ident[j])), pa.array(np.minimum(ident[i], ident[j]))], names=["src", "dst"])

    # a task reads its partition whole, as in simhash
    parts = max(-(-n_classes * len(choice) // simhash.PART_ROWS), int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = named.select("id", "component", "bits").mapInArrow(keys, schema)
    return rows.repartition(parts, "at").mapInArrow(join, "src bigint, dst bigint").distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, component_id`` (the least doc_id of the group) for each row."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = given.select("doc_id", F.md5("text").alias("key"), "text")
    marked = texts.withColumn("s", F.arrow_udf(_sketches, "struct<n:bigint,bits:array<bigint>>")(F.col("text"))).select("doc_id", "key", "s.*")
    marked = durable(marked)
    classes = marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()))
    texts = texts.select("key", "text")

    first = _verified(_close(classes), classes, texts)
    ends = components(first).withColumnRenamed("node", "id")
    named = durable(classes.join(ends, "id", "left").withColumn("component", F.coalesce("component", "id")))
    n_classes = named.count()
    second = _verified(durable(_met(named, bands(n_classes), n_classes)), classes, texts)

    # the first links as stars, so that one run over both gives the components of all
    stars = named.where("component <> id").select(F.col("id").alias("src"), F.col("component").alias("dst"))
    names = durable(simhash.named_by_least(classes.select("id", "least"), stars.unionByName(second), "id"))
    return marked.select("doc_id", "key").join(classes.select("key", "id"), "key").join(names, "id").select("doc_id", "key", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their group, with the columns they had."""
    name = free_name(docs, "first")
    first = grouped(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
