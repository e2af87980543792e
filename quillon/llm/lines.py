"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's tokens are the distinct runs of characters other than U+0020 in its lower
case. Two lines are similar if the Jaccard index of their token sets is at least
``similar`` (a fraction, 4/5 unless told otherwise). Documents are ordered by id,
lines within them by number; a line is removed if any earlier line of the input is
similar to it, whether or not that one is removed too. Lines of fewer than
``min_tokens`` tokens stay and remove nothing; unless told otherwise, these are lines
without any.

1. Tokens are counted over the whole corpus in a table of fixed size, by hash, and
   each line's tokens are sorted from rare to frequent. Hash collisions only change
   that order, which any fixed order of tokens may have.
2. Lines with one token set form a class that its first line stands for, so copies
   are never compared. Sets are told apart by a digest of 128 bits over the hashes of
   their tokens (56 bits each), their size and a bitmap; tokens are not looked at again.
3. A class is compared first with the earliest class of each of a few tokens of its
   prefix, chosen by hash, that ``MANY`` classes or more have among theirs, and of these
   with the one that it shares most with. A large group of near copies so costs about as
   many comparisons as it has lines; small groups are left to the join.
4. Only classes that this leaves open are joined with all others: two classes are
   candidates if a token of the larger one's prefix is in that of the smaller one,
   which need be only as long as for a class of its own size, and if they pass the
   length, the positional and a bitmap filter. Lines that are near each other but not
   similar stay open, and pass the filters in part.
5. Candidates are verified on the tokens of their lines.

Null text has no lines and stays null; an empty table stays empty; rows that share
a doc_id are taken for one place in the order and do not remove each other's lines
of the same number. Other columns pass through; where the input has a column of the
result's name, the result's gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import durable, release
from quillon.llm.shared import free_name

MIN_TOKENS = 1
SIMILAR = (4, 5)
#: Counters of token frequency; the table is of this size whatever the corpus.
BUCKETS = 1 << 18
#: Tokens from which a line has a bitmap of 128 bits, as 64 tell long lines apart badly.
WIDE = 80
#: Tokens of a prefix by which a class looks for an earlier one that settles it.
FEW = 4
#: Classes of a token from which they are first compared with its earliest one; fewer are left to the join.
MANY = 32
#: Bits of a table of what a join's other side holds; the table is of this size whatever the corpus.
SIEVE_BITS = 1 << 22
_HASH_BITS = 56
#: The size of a task's map of sums, which is kept by generated code up to that size; its default holds a quarter of the counters.
_MAP_BITS = ("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "19")


def _split(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), " "), "")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """For each hash bucket, a class that grows with the logarithm of its tokens' count.

    The empty token, which stands between two separators, is counted as well: no line
    has it, so it only adds to its bucket's count.
    """
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    tokens = lines.select(F.explode(F.split(F.lower("line"), " ")).alias("t"))
    counts = (
        tokens.groupBy(F.expr(f"cast(xxhash64(t) & {buckets - 1} as int)").alias("bucket"))
        .count()
        .select("bucket", F.least(F.floor(6 * F.log2("count")), F.lit(127)).cast("int").alias("class"))
    )
    counted = _summed(counts)
    classes = np.zeros(buckets, dtype=np.int64)
    classes[counted["bucket"].to_numpy()] = counted["class"].to_numpy()
    return classes


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; it is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _summed(sums: DataFrame) -> pa.Table:
    """The rows of an aggregation of many groups."""
    with _set(sums.sparkSession, *_MAP_BITS):
        return sums.toArrow()


def _hashes(line: Column) -> Column:
    """The hashes of a line's distinct tokens."""
    hashes = F.transform(F.split(F.lower(line), " "), lambda t: F.xxhash64(t))
    return F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))


def _keys(hashes: Column, classes: np.ndarray) -> Column:
    """A key for each token, in ascending order: rarity class above, 56 bits of the hash below."""
    ranks = F.from_json(F.lit("[" + ",".join(map(str, classes.tolist())) + "]"), "array<tinyint>")
    nothing = F.lit(0).cast("tinyint")  # no element is null, so that arrays of them are sorted as plain numbers

    def key(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(len(classes) - 1)).cast("int")), nothing)
        return F.shiftleft(rank.cast("long"), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))

    return F.sort_array(F.transform(hashes, key))


def prefix_size(n: Column, num: int, den: int) -> Column:
    """Tokens of a set of ``n`` of which one at least is in any set with which it has ``num / den`` of its own in common."""
    return n - F.floor((n * num + den - 1) / den).cast("int") + 1


def _described(docs: DataFrame, doc_id: str, text: str, classes: np.ndarray, similar: tuple[int, int]) -> DataFrame:
    """Each line's place, the hash of its token set, its size, bitmaps and prefix; lines without tokens as well.

    Nothing is filtered here, as a filter would go below the projection and sort the
    tokens a second time.
    """
    hashed = _lines(docs, doc_id, text).select("doc", "line_no", _hashes(F.col("line")).alias("hashes"))
    # what is used twice stays a projection of its own: within a lambda's operand Spark interprets all functions
    keyed = hashed.select("doc", "line_no", "hashes", F.size("hashes").alias("n"), _keys(F.col("hashes"), classes).alias("keys"))
    n = F.col("n")
    bitmap = F.aggregate("hashes", F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(_bit(k)))
    half = F.aggregate("hashes", F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(_bit(k, F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long")))))
    # 32 bits of a key are enough to bring lines together; keys that share them only add candidates
    prefix = F.transform(F.slice("keys", F.lit(1), prefix_size(n, *similar)), lambda k: F.hash(k))
    return keyed.select("doc", "line_no", F.xxhash64("keys").alias("set"), F.xxhash64(F.lit(1), "keys").alias("set2"), "n", bitmap.alias("bits"), F.when(n >= WIDE, half).alias("half"), prefix.alias("prefix"))


def _bit(k: Column, value: Column | None = None) -> Column:
    """The bit of a token in the 64-bit bitmap; not set where ``value``, 0 or 1, is 0."""
    return F.call_function("shiftleft", F.lit(1).cast("long") if value is None else value, k.bitwiseAND(F.lit(63)).cast("int"))


def _bits_allow(similar: tuple[int, int]) -> str:
    """Whether the bitmaps of x and y differ in no more bits than similar sets have tokens in one of them alone.

    Sets of nx and ny tokens reach the index num/den only if they have at least
    num * (nx + ny) / (num + den) tokens in common, so at most
    (den - num) * (nx + ny) / (num + den) in one of them alone. ``half`` is the part of
    a long line's bitmap that half of its tokens make, the rest is made by the others.
    """
    num, den = similar
    most = f"{den - num} * (x.n + y.n)"
    halves = f"{num + den} * (bit_count(x.half ^ y.half) + bit_count(x.half ^ y.half ^ x.bits ^ y.bits)) <= {most}"
    return f"{num + den} * bit_count(x.bits ^ y.bits) <= {most} AND coalesce({halves}, true)"


def _lengths_allow(similar: tuple[int, int]) -> str:
    num, den = similar
    return f"{den} * y.n >= {num} * x.n AND {den} * x.n >= {num} * y.n"


def _sieve(wanted: DataFrame, bits: int = SIEVE_BITS) -> Callable[..., Column]:
    """A condition that is true for all rows of ``wanted``, and for few others while these are few beside ``bits``.

    Put before a join with ``wanted`` it saves rows the shuffle, and decides nothing.
    """
    at = F.xxhash64(*wanted.columns).bitwiseAND(F.lit(bits - 1))
    set_ = wanted.select(F.shiftright(at, 6).alias("word"), _bit(at).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    set_ = _summed(set_)
    words = np.zeros(max(1, bits // 64), dtype=np.int64)
    words[set_["word"].to_numpy()] = set_["bits"].to_numpy()
    table = F.from_json(F.lit("[" + ",".join(map(str, words.tolist())) + "]"), "array<bigint>")

    def may_hold(*columns: Column) -> Column:
        h = F.xxhash64(*columns).bitwiseAND(F.lit(bits - 1))
        return F.coalesce(F.get(table, F.shiftright(h, 6).cast("int")), F.lit(0)).bitwiseAND(_bit(h)) != 0

    return may_hold


def _tokens(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, line_no, tokens``: the token sets of all lines that stand in pairs, as strings."""
    places = pairs.selectExpr("x_doc AS doc", "x_line AS line_no").unionByName(pairs.selectExpr("y_doc AS doc", "y_line AS line_no"))
    wanted = places.groupBy("doc").agg(F.collect_set("line_no").alias("wanted"))
    in_pairs = _sieve(places.select("doc"))
    return durable(
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .where(in_pairs(F.col("id")))
        .join(wanted, F.col("id").eqNullSafe(F.col("doc")))
        .select("doc", "wanted", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))  # so that a text is split once
        .where(F.array_contains("wanted", F.col("line_no")))
        .select("doc", "line_no", F.array_distinct(_split(F.col("line"))).alias("tokens"))
    )  # rows that share a doc_id give a line twice, which changes nothing below


def _verified(pairs: DataFrame, tokens: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The places of x of those pairs whose token sets are similar."""
    num, den = similar
    x = tokens.select(F.col("doc").alias("x_doc"), F.col("line_no").alias("x_line"), F.col("tokens").alias("tx"))
    y = tokens.select(F.col("doc").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("tokens").alias("ty"))
    common = F.size(F.array_intersect("tx", "ty"))
    both = _joined(_joined(pairs, x, ["x_doc", "x_line"]), y, ["y_doc", "y_line"])
    return both.where(common * (num + den) >= (F.size("tx") + F.size("ty")) * num).select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line_no")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """One pair a line: that of the most shared tokens."""
    most = F.max(F.struct("shared", "y_doc", "y_line")).alias("y")
    return pairs.groupBy("x_doc", "x_line").agg(most).select("x_doc", "x_line", "y.y_doc", "y.y_line")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which the first may be null."""
    other = right.withColumnsRenamed({k: f"{k}_2" for k in keys})
    on = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_2")) & (F.col(keys[1]) == F.col(f"{keys[1]}_2"))
    return left.join(other, on, how).drop(*(f"{k}_2" for k in keys))


_FIRST = "struct(y.doc, y.line_no) < struct(x.doc, x.line_no)"


def _shared(pairs: DataFrame, later: str = "x", earlier: str = "y") -> DataFrame:
    """Each pair of lines once, with the number of tokens that brought it together."""
    named = pairs.select(*(F.expr(f"{side}.{c}").alias(f"{name}_{short}") for side, name in ((later, "x"), (earlier, "y")) for c, short in (("doc", "doc"), ("line_no", "line"))))
    return named.groupBy("x_doc", "x_line", "y_doc", "y_line").agg(F.count("*").alias("shared"))


def _settling(firsts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """One candidate for each class: the earliest one of some of its tokens, the least by hash of its prefix."""
    rows = firsts.select("doc", "line_no", "n", "bits", "half", F.explode("few").alias("token"))
    frequent = _sieve(rows.groupBy("token").count().where(F.col("count") >= MANY).select("token"))
    rows = rows.where(frequent(F.col("token")))
    first = F.min(F.struct("doc", "line_no", "n", "bits", "half")).alias("p")
    # written first, so that both sides of the join come from a shuffle and a skewed token is split
    earliest = durable(rows.groupBy("token").agg(first, F.count("*").alias("classes")).where(F.col("classes") >= MANY).select("token", "p.*"))
    pairs = rows.alias("x").join(earliest.alias("y"), "token").where(F.expr(f"{_lengths_allow(similar)} AND {_bits_allow(similar)} AND {_FIRST}"))
    return _best(_shared(pairs))


def _marked(firsts: DataFrame, done: DataFrame) -> DataFrame:
    """The classes with ``open``, which is 0 if they are settled and 1 if not."""
    settled = _sieve(done.select("doc", "line_no"))(F.col("doc"), F.col("line_no"))
    some = _joined(firsts.where(settled), done.withColumn("done", F.lit(1)), ["doc", "line_no"], "left")
    return firsts.where(~settled).withColumn("open", F.lit(1)).unionByName(some.withColumn("open", 1 - F.coalesce("done", F.lit(0))).drop("done"))


def _candidates(marked: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs of classes of which the later one is open, the larger one being x.

    A set of m tokens that is similar to one of n >= m has at least
    2 * num / (num + den) of its own tokens in common with it, which is more than the
    index asks for, so its prefix is shorter.
    """
    num, den = similar
    place = ["doc", "line_no", "n", "bits", "half", "open"]
    # the largest set that is similar if token i (from 0) is the first in common, so that a pair needs no arithmetic
    reach = F.expr(f"cast(({num + den} * (n - i) - {num} * n) div {num} AS int) AS reach")
    x = marked.select(*place, F.posexplode("prefix").alias("i", "token")).select(*place, reach, "token").alias("x")
    small = F.slice("prefix", F.lit(1), prefix_size(F.col("n"), 2 * num, num + den))
    y = marked.select(*place, F.posexplode(small).alias("i", "token")).select(*place, reach, "token").alias("y")
    size = "x.n >= y.n AND y.reach >= x.n AND x.reach >= y.n"
    open_ = f"IF({_FIRST}, x.open, IF(x.n = y.n, 0, y.open)) = 1"  # of two that are as large the later one is x
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where(F.expr(f"{size} AND {_bits_allow(similar)} AND {open_}"))
    swapped = F.expr(_FIRST)
    sides = [F.when(swapped, F.struct("x.doc", "x.line_no")).otherwise(F.struct("y.doc", "y.line_no")).alias("later"), F.when(swapped, F.struct("y.doc", "y.line_no")).otherwise(F.struct("x.doc", "x.line_no")).alias("earlier")]
    return _shared(pairs.select(*sides), "later", "earlier")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row for each line to remove: doc, line_no (from 0)."""
    every = durable(_described(docs, doc_id, text, rarity(docs, text), similar))
    described = every.where(F.col("n") >= min_tokens)
    same = ["set", "set2", "n", "bits"]
    classes = durable(described.groupBy(*same).agg(F.min(F.struct("doc", "line_no")).alias("place"), F.count("*").alias("lines"), F.first("half").alias("half"), F.first("prefix").alias("prefix")).select(*same, "place.*", "lines", "half", "prefix", F.slice(F.sort_array("prefix"), 1, FEW).alias("few")))
    first = classes.where(F.col("lines") > 1).select(*(F.col(c).alias(f"{c}_1") for c in (*same, "doc", "line_no")))
    # a set of n tokens reaches n / (n + 1) at most with another one, so short ones are settled by their hash
    firsts = classes.where(F.col("n") * (similar[1] - similar[0]) >= similar[0])
    on = (F.col("set") == F.col("set_1")) & (F.col("set2") == F.col("set2_1")) & (F.col("n") == F.col("n_1")) & (F.col("bits") == F.col("bits_1"))
    repeats = durable(described.join(first, on).where(~(F.col("doc").eqNullSafe(F.col("doc_1")) & (F.col("line_no") == F.col("line_no_1")))).select("doc", "line_no"))
    release(every)

    near = durable(_settling(firsts, similar))
    done = durable(_verified(near, _tokens(near, docs, doc_id, text), similar))
    marked = durable(_marked(firsts.drop("set", "set2", "lines", "few"), done))
    release(classes)
    pairs = durable(_candidates(marked, similar))
    release(marked)
    more = durable(_verified(pairs, _tokens(pairs, docs, doc_id, text), similar))
    return repeats.unionByName(done).unionByName(more)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed", **options) -> DataFrame:
    """``docs`` with the lines removed from ``text`` and their numbers in an array column."""
    removed = free_name(docs, removed)
    gone = removed_lines(docs, doc_id, text, **options).groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias(removed))
    key = free_name(docs, "doc")
    out = docs.join(gone.withColumnRenamed("doc", key), F.col(doc_id).eqNullSafe(F.col(key)), "left").drop(key)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(F.col(removed), i)), "\n")
    return out.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept)).withColumn(removed, F.coalesce(F.col(removed), F.array().cast("array<int>")))


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without repeated lines; a document that loses all its lines goes."""
    name = free_name(docs, "removed")
    out = deduplicated(docs, doc_id, text, name, **options)
    return out.where((F.size(name) == 0) | (F.trim(F.col(text)) != "") | F.col(text).isNull()).drop(name)
