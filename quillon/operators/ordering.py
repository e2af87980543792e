"""Operators that need an order within groups: naming, first and last wins, halving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.durable import durable


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "number", first: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (first - 1))


def callsite_names(sites: DataFrame, group: list[str], order: list[str], method: str, name: str = "slice_name") -> DataFrame:
    """The method's name where a group has one site, else numbered ones from 0; one shuffle and sort for both windows."""
    w = Window.partitionBy(*group)
    site = F.row_number().over(w.orderBy(*order)) - 1
    many = F.count("*").over(w)
    return sites.withColumn(name, F.when(many == 1, F.col(method)).otherwise(F.concat(F.col(method), F.lit("__callsite_"), site.cast("string"))))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row; minima combine before the shuffle, so a hot key is no hot spot."""
    rest = [c for c in df.columns if c not in key]
    ordered = [c for c in order if c not in key]
    least = F.min(F.struct(*ordered, *(c for c in rest if c not in ordered)))
    return df.groupBy(*key).agg(least.alias("r")).select(*key, *(F.col(f"r.{c}") for c in rest))


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    ordered = [c for c in order if c not in key]
    most = F.max(F.struct(*ordered, *(c for c in rest if c not in ordered)))
    return df.groupBy(*key).agg(most.alias("r")).select(*key, *(F.col(f"r.{c}") for c in rest))


def ordered_distinct(df: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Keys in the order of their first row, each once; at most ``limit`` of them."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    out = df.groupBy(key).agg(F.min(F.struct(*order)).alias("first")).orderBy("first", key).select(key)
    return out if limit is None else out.limit(limit)


def halved(items: DataFrame, group: list[str], order: list[str], name: str = "half") -> DataFrame:
    """Each group's first half, the larger if they differ, as ``L``, the rest as ``R``."""
    w = Window.partitionBy(*group)
    at, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return items.withColumn(name, F.when(at <= F.ceil(n / 2), "L").otherwise("R"))


def batched_by_budget(items: DataFrame, group: list[str], order: list[str], size: str, budget: int, overhead: int = 0, rounds: int = 40, shared: tuple[str, str] | None = None, oversize: str | None = None) -> DataFrame:
    """Halves groups until each batch's sizes, with an overhead, fit the budget; adds ``batch``, a path of L and R.

    ``shared`` names a column and another with the size of what each of its values adds
    once to every batch that has items of it. Batches in the order of their paths keep
    the items' order. A batch of one item that does not fit is an error or, where
    ``oversize`` names a column, is marked there and left as it is. Each round works on
    the batches that are still too large, all others are done.
    """
    done = None
    todo = items.withColumn("batch", F.lit(""))
    for _ in range(rounds):
        w = Window.partitionBy(*group, "batch")
        whole = F.col(size)
        if shared is not None:
            first = F.row_number().over(Window.partitionBy(*group, "batch", shared[0]).orderBy(*order)) == 1
            todo = todo.withColumn("__more", F.when(first, F.col(shared[1])).otherwise(0))
            whole = whole + F.col("__more")
        marked = durable(todo.withColumns({"__sum": F.sum(whole).over(w) + overhead, "__n": F.count("*").over(w)}).drop("__more"))
        over = marked.where(F.col("__sum") > budget)
        if oversize is not None:
            ended = marked.where((F.col("__sum") <= budget) | (F.col("__n") < 2)).withColumn(oversize, F.col("__sum") > budget)
            over = over.where("__n > 1")
        else:
            ended = marked.where(F.col("__sum") <= budget)
            if over.where("__n < 2").limit(1).count():
                raise ValueError("one item alone exceeds the budget")
        ended = ended.drop("__sum", "__n")
        done = ended if done is None else done.unionByName(ended)
        if not over.limit(1).count():
            return done
        todo = halved(over.drop("__sum", "__n"), [*group, "batch"], order, "__half").withColumn("batch", F.concat("batch", "__half")).drop("__half")
    raise RuntimeError("the groups are not small enough after all rounds")
