"""Hard negatives by exact inner products, pruned in a rotated space.

Vectors become whole numbers; an orthogonal rotation to principal axes keeps their
inner products but moves most of each vector into its first components. Scores are
summed over leading components first. What the rest can add is at most the product of
the residual norms, plus slack for rounding, so most pairs are dropped early; pairs
that remain are scored anew as products of whole numbers. Which axes are used changes
the cost, never the result.

Anchors are taken a bounded block at a time and sent to all tasks; each task scans its
rows in slices against the block. So a row meets every anchor without a join, and no
label, however frequent, is collected in one place.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part, and neither do rows whose squared norm is 2^60 or more after
scaling, whose scores would not fit a long. Shorter vectors count as followed by zeros.
Rows of one id and score count once for an anchor; anchors that are alike in all
respects are one anchor. An empty table, or one without anchors, has no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.durable import ensure_checkpoint_dir

#: A component is multiplied by this and rounded down.
SCALE = 256
#: Positives an anchor has, and negatives a positive has, at most.
TOP = 5
#: Numbers of a block of anchors that is sent to all tasks, 8 bytes each.
BLOCK_NUMBERS = 1 << 20
#: Numbers of rows that the axes are fitted on; a bounded sample, as they decide the cost only.
FIT_NUMBERS = 1 << 20
#: Components that are rotated at most; any further ones follow as they are, which keeps the rotation orthogonal.
ROTATED = 1024
#: Pairs of an anchor and a row that are summed at a time, and found pairs that are kept before they are ranked.
PAIRS, PENDING = 1 << 20, 1 << 18
#: Squared norms stay below this, so that five times a score fits a long.
LARGEST = float(1 << 60)
#: Stands for "no score yet".
NONE = -(1 << 62)
#: Bound of the relative error of a product of rotated vectors, far above that of doubles.
SLACK = 1e-9
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Of pairs that remain, the part under which they are summed one by one.
SPARSE = 1 / 8


def prepared(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, q`` (whole numbers) of the rows that take part."""
    v = F.col("embedding")
    q = F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    limit = LARGEST**0.5 / SCALE
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = embeddings.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    return kept.select("vec_id", "label", q.alias("q")).where(norm < LARGEST)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones followed by zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def axes(sample: np.ndarray, width: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes of the sample, the heaviest first."""
    n = min(width, ROTATED)
    x = sample[:, :n].astype(np.float64)
    q = np.eye(width)
    if len(x):
        q[:n, :n] = np.linalg.eigh(x.T @ x / len(x))[1][:, ::-1]
    return q


class Rotated:
    """Rows along the axes, with the norms of what lies behind each cut."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray, cuts: tuple[int, ...]) -> None:
        self.whole = whole
        self.along = whole.astype(np.float64) @ rotation
        squares = self.along**2
        self.norm = np.sqrt(squares.sum(1))
        self.rest = [np.sqrt(squares[:, c:].sum(1)) for c in cuts]

    def __getitem__(self, at) -> Rotated:
        out = object.__new__(Rotated)
        out.whole, out.along, out.norm, out.rest = self.whole[at], self.along[at], self.norm[at], [r[at] for r in self.rest]
        return out


def cuts_of(width: int) -> tuple[int, ...]:
    """Where partial sums are judged: after an eighth, a quarter, half and all of the components."""
    return tuple(sorted({-(-width // k) for k in (8, 4, 2, 1)}))


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a and j of b, a bounded number of components at a time."""
    out = np.zeros(len(i), a.dtype)
    step = max(1, PAIRS // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        p = slice(at, at + step)
        out[p] = np.einsum("pc,pc->p", a[i[p]], b[j[p]])
    return out


def survivors(a: Rotated, b: Rotated, least: np.ndarray, most: np.ndarray | None, cuts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) and their whole-number scores with ``least[i] <= score``, and ``<= most[i]`` where given.

    Partial sums grow cut by cut. A pair goes as soon as its sum and the product of both
    residual norms cannot reach the bound.
    """
    most = np.full(len(least), -NONE) if most is None else most
    error = SLACK * a.norm[:, None] * b.norm[None, :] + SLACK
    sums, i, j, begin = np.zeros((len(a.norm), len(b.norm))), None, None, 0
    for k, end in enumerate(cuts):
        if i is None:
            sums += a.along[:, begin:end] @ b.along[:, begin:end].T
            slack = np.multiply.outer(a.rest[k], b.rest[k]) + error
            mask = (sums + slack >= least[:, None]) & (sums - slack <= most[:, None])
            if np.count_nonzero(mask) < SPARSE * mask.size or end == cuts[-1]:
                i, j = np.nonzero(mask)
                sums = sums[i, j]
        else:
            sums += products(a.along[:, begin:end], b.along[:, begin:end], i, j)
            slack = a.rest[k][i] * b.rest[k][j] + error[i, j]
            stay = (sums + slack >= least[i]) & (sums - slack <= most[i])
            i, j, sums = i[stay], j[stay], sums[stay]
        if i is not None and not len(i):
            break
        begin = end
    if i is None:
        i = j = np.zeros(0, np.int64)  # vectors without components
        if not cuts:
            i, j = (x.ravel() for x in np.indices((len(a.norm), len(b.norm))))
    score = products(a.whole, b.whole, i, j)
    ok = (score >= least[i]) & (score <= most[i])
    return i[ok], j[ok], score[ok]


class Best:
    """The first ``TOP`` rows of each of n lists, by falling score and rising id; rows alike in both count once."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.kept = [np.zeros(0, np.int64) for _ in range(3)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.pending = 0
        self.least = np.full(n, NONE)  # a row under it is not among the first

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(which):
            self.new.append((which, ids, scores))
            self.pending += len(which)
        if self.pending >= PENDING:
            self.settle()

    def settle(self) -> None:
        which, ids, scores = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -scores, which))
        which, ids, scores = which[order], ids[order], scores[order]
        again = np.zeros(len(which), bool)
        again[1:] = (which[1:] == which[:-1]) & (ids[1:] == ids[:-1]) & (scores[1:] == scores[:-1])
        which, ids, scores = which[~again], ids[~again], scores[~again]
        first = np.searchsorted(which, np.arange(self.n))
        place = np.arange(len(which)) - first[which]
        full = place == TOP - 1
        self.least[which[full]] = scores[full]
        top = place < TOP
        self.kept, self.new, self.pending = [which[top], ids[top], scores[top]], [], 0


@dataclass
class Block:
    """A bounded number of anchors, ordered by label, and what is known of their lists."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: Rotated
    rotation: np.ndarray
    cuts: tuple[int, ...]
    #: Scores of each anchor's positives, a row each; NONE where it has fewer.
    positives: np.ndarray | None = None
    #: From the block's own rows: under these a row is not among the first.
    least: np.ndarray | None = None

    def rows(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, best: Best, negatives: bool) -> None:
        """Scores rows against the anchors and adds what may be among the first to ``best``."""
        order = np.argsort(labels, kind="stable")
        ids, labels, rows = ids[order], labels[order], Rotated(whole[order], self.rotation, self.cuts)
        mine, start = np.unique(self.labels, return_index=True)
        for label, lo, hi in zip(mine, start, [*start[1:], len(self.labels)], strict=True):
            a, b = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            for at, to in ((0, a), (b, len(labels))) if negatives else ((a, b),):
                step = max(1, PAIRS // max(1, to - at))
                for i in range(lo, hi, step) if to > at else ():
                    part = slice(i, min(i + step, hi))
                    (self._negatives if negatives else self._positives)(part, rows[at:to], ids[at:to], best)

    def _positives(self, part: slice, rows: Rotated, ids: np.ndarray, best: Best) -> None:
        least = best.least if self.least is None else np.maximum(best.least, self.least)
        i, j, score = survivors(self.vectors[part], rows, least[part], None, self.cuts)
        i = i + part.start
        other = ids[j] != self.ids[i]
        best.add(i[other], ids[j[other]], score[other])

    def _negatives(self, part: slice, rows: Rotated, ids: np.ndarray, best: Best) -> None:
        """A row counts for each positive with 4 p <= 5 n <= 5 p, which none below zero has."""
        p = self.positives[part]
        least = best.least.reshape(-1, TOP)[part]
        if self.least is not None:
            least = np.maximum(least, self.least.reshape(-1, TOP)[part])
        low = np.where(p >= 0, np.maximum(-(-4 * p // 5), least), -NONE).min(1)
        high = p.max(1)
        some = np.flatnonzero(high >= 0)
        if not len(some):
            return
        i, j, score = survivors(self.vectors[part][some], rows, low[some], high[some], self.cuts)
        i = some[i]
        for k in range(TOP):
            top = p[i, k]
            fits = (top >= 0) & (4 * top <= 5 * score) & (score <= top) & (score >= least[i, k])
            best.add((i[fits] + part.start) * TOP + k, ids[j[fits]], score[fits])


def _block(rows: list, width: int, rotation: np.ndarray, cuts: tuple[int, ...]) -> Block:
    rows = sorted(rows, key=lambda r: (r["label"], r["vec_id"]))
    whole = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        whole[k, : len(r["q"])] = r["q"]
    return Block(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), Rotated(whole, rotation, cuts), rotation, cuts)


def _seeded(block: Block, negatives: bool) -> Block:
    """Bounds from the block's own rows, which are among all rows; one row of an id, as its rows may count once."""
    best = Best(len(block.ids) * (TOP if negatives else 1))
    _, one = np.unique(block.ids, return_index=True)
    for at in range(0, len(one), 512):
        some = one[at : at + 512]
        block.rows(block.ids[some], block.labels[some], block.vectors.whole[some], best, negatives)
    best.settle()
    block.least = best.least
    return block


def _best_rows(rows: DataFrame, block: Block, width: int, negatives: bool) -> DataFrame:
    """``which, vec_id, score`` of the first rows of each list: those of each task, then those of all."""
    sent = rows.sparkSession.sparkContext.broadcast((block.ids, block.labels, block.vectors.whole, block.rotation, block.cuts, block.positives, block.least))
    slice_rows = max(64, min(2048, PAIRS // max(1, width)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, whole, axes_, cuts, positives, least = sent.value
        mine = Block(ids, labels, Rotated(whole, axes_, cuts), axes_, cuts, positives, least)
        best = Best(len(mine.ids) * (TOP if negatives else 1))
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                mine.rows(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width), best, negatives)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.kept], ["which", "vec_id", "score"])

    found = rows.mapInArrow(scan, "which long, vec_id long, score long")
    place = F.dense_rank().over(Window.partitionBy("which").orderBy(F.desc("score"), "vec_id"))  # rows alike share a place
    return found.withColumn("place", place).where(F.col("place") <= TOP).distinct()


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id, label, q`` as of ``prepared``.

    An anchor's positives are its first rows of its label with another id; a positive's
    negatives the first rows of other labels whose score s has 0.8 p <= s <= p for the
    positive's score p.
    """
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    key = F.struct("vec_id", "label", "q")
    rows.where(is_anchor).distinct().write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    cuts = cuts_of(width) if width else ()
    fit = max(1, FIT_NUMBERS // max(1, width))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // fit))) == 0).select("q").limit(fit)
    sample = np.zeros((fit, width))
    for k, (q,) in enumerate(chosen.collect()):
        sample[k, : len(q)] = q
    rotation = axes(sample, width)
    size = max(1, BLOCK_NUMBERS // max(1, width))
    last = None
    while some := (anchors if last is None else anchors.where(key > last)).orderBy(key).limit(size).collect():
        last = F.struct(F.lit(some[-1]["vec_id"]).alias("vec_id"), F.lit(some[-1]["label"]).alias("label"), F.array(*map(F.lit, some[-1]["q"])).cast("array<long>").alias("q"))
        block = _block(some, width, rotation, cuts)
        positives = _best_rows(rows, _seeded(block, False), width, False).collect()
        block.positives, block.least = np.full((len(block.ids), TOP), NONE), None
        for which, _, score, place in positives:
            block.positives[which, place - 1] = score
        found = _best_rows(rows, _seeded(block, True), width, True)
        names = spark.createDataFrame([(int(r[0]) * TOP + r[3] - 1, int(block.ids[r[0]]), r[1], r[2]) for r in positives], "which long, anchor_id long, positive_id long, positive_score long")
        named = found.join(F.broadcast(names), "which")  # at most five rows an anchor of the block
        named.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(f"{folder}/found")
    return spark.createDataFrame([], RESULT) if last is None else spark.read.schema(RESULT).parquet(f"{folder}/found")


def mined(spark: SparkSession, embeddings: DataFrame, relabel_every: int = 7, labels: int = 10, anchor_every: int = 100) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``anchor_every``; a label first moves on by one where the id is divisible by ``relabel_every``."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return hard_negatives(prepared(embeddings.select("vec_id", "embedding", "label"), moved), F.col("vec_id") % anchor_every == 0)
