"""Backward slices of methods, and their walk through callers.

A program is given as tables: ``unit`` (method_id, unit_id, ordinal, kind, invoked, text),
``ref`` (unit_id, role def, use or arg, ordinal, value, is_local, base) and
``cfg`` (method_id, src, dst, ordinal), ``method`` (method_id, class, name, signature,
n_params, has_body) and ``calls`` (src, dst, ordinal). Kinds are assign, identity, invoke, if,
goto, switch and return. The walk within a method depends on the order of its
control-flow edges and visits each unit once, so it is done on whole methods, each
packed into one row; a method has a bounded size.
"""

from __future__ import annotations

import re
import time
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.durable import durable, ensure_checkpoint_dir, remove
from quillon.functions.scalars import signature_key
from quillon.operators.ordering import callsite_names, numbered

ELIGIBLE = re.compile(r"\$?[a-z]\d+|parameter\d+")
BRANCHES = frozenset({"if", "goto", "switch"})
DEFINITIONS = frozenset({"assign", "identity"})


def is_eligible(name: str) -> bool:
    """Short register names and parameters; the length bound holds for registers only."""
    return bool(ELIGIBLE.fullmatch(name)) and (len(name) <= 4 or name.startswith("parameter"))


class Method:
    """One method's units, references and control flow; walks that pass ``deadline`` (of a monotonic clock) are given up."""

    def __init__(self, units, refs, cfg, deadline: float = float("inf")) -> None:
        self.deadline = deadline
        self.kind = {u["unit_id"]: u["kind"] for u in sorted(units, key=lambda u: u["ordinal"])}
        self.refs: dict[str, dict[int, list]] = {"def": {}, "use": {}, "arg": {}}
        for r in sorted(refs, key=lambda r: r["ordinal"]):
            self.refs[r["role"]].setdefault(r["unit_id"], []).append(r)
        self.before: dict[int, list[int]] = {}
        self.after: dict[int, list[int]] = {}
        for e in sorted(cfg, key=lambda e: e["ordinal"]):
            self.after.setdefault(e["src"], []).append(e["dst"])
            self.before.setdefault(e["dst"], []).append(e["src"])

    def named(self, role: str, unit: int) -> list[str]:
        return [r["value"] for r in self.refs[role].get(unit, ())]

    def locals_of(self, role: str, unit: int) -> list[str]:
        return sorted({r["value"] for r in self.refs[role].get(unit, ()) if r["is_local"]})

    def touches(self, unit: int, names: set[str]) -> bool:
        """Whether a unit bears on the names, by containment of their text."""
        kind = self.kind[unit]
        if kind in BRANCHES:
            return True
        texts = self.named("def" if kind == "assign" else "use", unit)
        return any(n in t for t in texts for n in names)

    def flowing(self, target: int) -> tuple[dict[int, set[str]], set[tuple[str, tuple[str, ...]]]]:
        """The names that matter at each unit reached backward from the target, and the relations found on the way."""
        live: dict[int, set[str]] = {}
        relations: set[tuple[str, tuple[str, ...]]] = set()
        direct: set[str] = set()
        queue, seen = deque([target]), {target}
        while queue:
            self._in_time()
            unit = queue.popleft()
            if unit == target:
                names = direct = {n for n in self.named("use", unit) if is_eligible(n)}
                names = set(names)
                relations |= {("Direct", (n,)) for n in direct}
                together = self.locals_of("arg", unit)
            else:
                names = set().union(*(live.get(s, ()) for s in self.after.get(unit, ())))
                together = []
            if len(together) > 1:
                relations.add(("Parallel", tuple(together)))
            if self.touches(unit, names):
                self._absorb(unit, unit == target, names, direct, relations)
            live[unit] = names
            if names:
                for p in self.before.get(unit, ()):
                    if p not in seen:
                        seen.add(p)
                        queue.append(p)
        return live, relations

    def _absorb(self, unit: int, is_target: bool, names: set[str], direct: set[str], relations: set) -> None:
        defined = self.refs["def"].get(unit, [])
        if not is_target and self.kind[unit] in DEFINITIONS and len(sources := self.locals_of("use", unit)) > 1:
            relations.add(("Parallel", tuple(sources)))
        names.difference_update(d["value"] for d in defined)
        for used in filter(is_eligible, self.named("use", unit)):
            names.add(used)
            if self.kind[unit] in BRANCHES:
                relations.add(("Conditional", (used,)))
            elif used not in direct:
                relations.add(("Transitive", (used,)))
                owners = {d["base"] or d["value"] for d in defined}
                relations.update(("Derived", (o, used)) for o in owners if o != used)

    def _in_time(self) -> None:
        if time.monotonic() > self.deadline:
            raise TimeoutError("the time for a method is over")

    def slice_of(self, target: int, live: dict[int, set[str]]) -> list[int]:
        """The units before the target that define or use a live name, or branch, last visited first, and the target; exact names here."""
        kept = [target]
        queue, seen = deque(self.before.get(target, ())), {target}
        while queue:
            self._in_time()
            unit = queue.popleft()
            seen.add(unit)
            names = set().union(*(live.get(s, ()) for s in self.after.get(unit, ())))
            if not names:
                continue
            kind = self.kind[unit]
            if kind in DEFINITIONS:
                keep = any(d["value"] in names or d["base"] in names for d in self.refs["def"].get(unit, ()))
            else:
                keep = kind in BRANCHES or not names.isdisjoint(self.named("use", unit))
            if keep and unit not in kept:
                kept.append(unit)
            for p in self.before.get(unit, ()):
                if p not in seen:
                    seen.add(p)
                    queue.append(p)
        return kept[::-1]

    def slice_graph(self, kept: list[int]) -> list[tuple[int, int]]:
        """Pairs of kept units that a path through units that are not kept joins."""
        within, edges = set(kept), []
        for unit in kept:
            queue, seen = deque(self.after.get(unit, ())), set()
            while queue:
                self._in_time()
                at = queue.popleft()
                if at in seen:
                    continue
                seen.add(at)
                if at in within:
                    edges.append((unit, at))
                else:
                    queue.extend(self.after.get(at, ()))
        return edges

    @property
    def head(self) -> int | None:
        return next(iter(self.kind), None)


def packed_methods(unit: DataFrame, ref: DataFrame, cfg: DataFrame) -> DataFrame:
    """One row a method: arrays of its units, references and edges. References that name their ``method_id`` need no join."""
    owned = ref if "method_id" in ref.columns else ref.join(unit.select("unit_id", "method_id"), "unit_id")
    units = unit.groupBy("method_id").agg(F.collect_list(F.struct("unit_id", "ordinal", "kind")).alias("units"))
    refs = owned.groupBy("method_id").agg(F.collect_list(F.struct("unit_id", "role", "ordinal", "value", "is_local", "base")).alias("refs"))
    flow = cfg.groupBy("method_id").agg(F.collect_list(F.struct("src", "dst", "ordinal")).alias("cfg"))
    return units.join(refs, "method_id", "left").join(flow, "method_id", "left")


_SLICED = "method_id long, target long, relations array<struct<kind:string,variables:array<string>>>, slice array<long>, graph array<struct<src:long,dst:long>>, open boolean, seconds double, error string"


def _plain(values: pa.Array) -> list:
    """Python values of a flat array, converted as a whole where that keeps them as they are."""
    if values.null_count and not pa.types.is_string(values.type):
        return values.to_pylist()
    return values.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.ListArray) -> Iterator[list[dict]]:
    """The structs of each list as dictionaries; a null list is empty. Fields are converted a batch at a time, not struct by struct."""
    inner = column.flatten()
    names = [f.name for f in inner.type]
    rows = zip(*(_plain(f) for f in inner.flatten()), strict=True)
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield [dict(zip(names, next(rows), strict=True)) for _ in range(n)]


def _nested(lists, inner: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32()), inner)


def sliced(methods: DataFrame, targets: DataFrame, timeout: float | None = None) -> DataFrame:
    """For each target (method_id, target): its relations, slice and slice graph, and whether the method's head has live names.

    A method that is malformed, or takes more than ``timeout`` seconds, has an
    ``error`` in place of a slice. ``seconds`` is the time that it took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for units, refs, cfg, target in zip(*(_lists(batch[c]) for c in ("units", "refs", "cfg")), batch["target"].to_pylist(), strict=True):
                began = time.monotonic()
                try:
                    m = Method(units, refs, cfg, began + timeout if timeout else float("inf"))
                    live, relations = m.flowing(target)
                    kept = m.slice_of(target, live)
                    edges = m.slice_graph(kept)
                    is_open = m.kind.get(m.head) == "identity" and bool(live.get(m.head))
                    found.append((sorted(relations), kept, edges, is_open, time.monotonic() - began, None))
                except Exception as e:
                    found.append(([], [], [], False, time.monotonic() - began, f"{type(e).__name__}: {e}"))
            relations, kept, edges, is_open, seconds, error = zip(*found, strict=True) if found else ([],) * 6
            flat = [r for of in relations for r in of]
            named = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.list_(pa.string()))], ["kind", "variables"])
            pairs = [e for of in edges for e in of]
            graph = pa.StructArray.from_arrays([pa.array([e[k] for e in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])
            columns = [batch["method_id"], batch["target"], _nested(relations, named), pa.array(kept, pa.list_(pa.int64())), _nested(edges, graph), pa.array(is_open, pa.bool_()), pa.array(seconds, pa.float64()), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["method_id", "target", "relations", "slice", "graph", "open", "seconds", "error"])

    return targets.select("method_id", "target").join(methods, "method_id").mapInArrow(run, _SLICED)


def callsites(unit: DataFrame, searched: DataFrame) -> DataFrame:
    """``method_id, target, signature``: units that invoke a searched signature, overloads apart."""
    return unit.select("method_id", F.col("unit_id").alias("target"), F.col("invoked").alias("signature")).join(searched.select("signature"), "signature", "left_semi")


def interface_roots(features: DataFrame, method: DataFrame, unit: DataFrame, calls: DataFrame, by: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """Where slices of listed interfaces begin: ``*by, api_index, instance, method_id, signature``.

    ``features``: api_index, class, name. Of the methods of that class and name, the
    target of the first call (by ``ordinal``) is searched; callers of any overload
    are looked at if they have a body whose text holds the name. Those that call the
    searched one are instances, numbered from 0 without gaps within an application
    (``by``, columns of ``method``) and interface.
    """
    key = [*by, "api_index"]
    target = method.select(*by, F.col("method_id").alias("dst"), "class", "name", "signature").join(features.select("api_index", "class", "name"), ["class", "name"])
    found = calls.select("src", "dst", "ordinal").join(target, "dst")
    first = found.groupBy(*key).agg(F.min(F.struct("ordinal", "dst", "src", "signature")).alias("f")).select(*key, F.col("f.signature").alias("signature"))
    bodies = method.where("has_body").select(F.col("method_id").alias("src"))
    callers = found.select(*key, "name", "src").distinct().join(bodies, "src", "left_semi")
    called = unit.select(F.col("method_id").alias("src"), "text", F.col("invoked").alias("signature"))
    named = callers.join(called.select("src", "text"), "src").where(F.contains("text", "name")).select(*key, "src").distinct()
    successful = named.join(first, key).join(called.where("signature IS NOT NULL").select("src", "signature").distinct(), ["src", "signature"], "left_semi")
    return numbered(successful, key, ["src"], "instance", first=0).select(*key, "instance", F.col("src").alias("method_id"), "signature")


@dataclass
class Program:
    """A program laid out for the walk: both tables bucketed by ``method_id``, so that a round shuffles its frontier alone.

    ``methods``: a method's packed parts, its call sites (target, at, searched), signature,
    key, n_params. ``callers``: for each called method its callers with a body, and their keys.
    """

    methods: DataFrame
    callers: DataFrame
    folder: str
    names: tuple[str, str]

    def gone(self) -> None:
        """Forgets the tables and deletes their files, once nothing reads them."""
        spark = self.methods.sparkSession
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, self.folder)


def stored_program(methods: DataFrame, unit: DataFrame, method: DataFrame, calls: DataFrame) -> Program:
    """Writes the program once, in as many buckets as shuffles have partitions; the tables' names are unique."""
    spark = methods.sparkSession
    ident = uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/program-{ident}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sites = unit.where("invoked IS NOT NULL").groupBy("method_id").agg(F.collect_list(F.struct(F.col("unit_id").alias("target"), F.col("ordinal").alias("at"), F.col("invoked").alias("searched"))).alias("sites"))
    info = method.select("method_id", "signature", signature_key(F.col("signature")).alias("key"), "n_params")
    whole = info.join(methods, "method_id", "left").join(sites, "method_id", "left")
    caller = method.where("has_body").select(F.col("method_id").alias("caller"), signature_key(F.col("signature")).alias("caller_key"))
    callers = calls.select(F.col("src").alias("caller"), F.col("dst").alias("method_id")).distinct().join(caller, "caller")
    names = (f"program_methods_{ident}", f"program_callers_{ident}")
    for name, rows in zip(names, (whole, callers), strict=True):
        rows.repartition(buckets, "method_id").write.format("parquet").bucketBy(buckets, "method_id").sortBy("method_id").option("path", f"{folder}/{name}").saveAsTable(name)
    return Program(spark.table(names[0]), spark.table(names[1]), folder, names)


def call_sites(program: Program, frontier: DataFrame) -> DataFrame:
    """The rows of the frontier (method_id, searched) with each call site (target, at) of what is searched."""
    here = frontier.join(program.methods.select("method_id", "sites"), "method_id")
    site = F.explode(F.filter("sites", lambda s: s["searched"] == F.col("searched")))
    return here.withColumn("__site", site).select(*frontier.columns, "__site.target", "__site.at")


def backward(methods: DataFrame, unit: DataFrame, method: DataFrame, calls: DataFrame, roots: DataFrame, hops: int = 1, rounds: int = 1000, timeout: float | None = None, owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Slices of the roots' call sites and of their callers' ones.

    ``roots``: instance, method_id, signature (searched). While a method has
    parameters and its head has live names, its callers are resolved at no cost;
    otherwise a hop is spent, and resolving ends. A method enters an instance's call
    graph, under its signature without parameters, if it has a call site of the
    searched method, and does so once; the edge to the method that it calls is drawn
    then, and also if it is in the graph already. Gives slices (instance, method_id,
    key, target, name, relations, slice, graph, seconds, error), named by their method
    and, if it has several, the number of the call site; and call-graph edges
    (instance, src, dst). ``timeout`` bounds the seconds of a method and, where ``owner``
    says whose an instance is, those of all the owner's slices: an owner that has used
    them up goes no further, others do. The walk is by rounds over sets, so where several paths lead
    to a method the one with the most hops left counts.
    """
    program = stored_program(methods, unit, method, calls)
    try:
        return _walk(program, roots, hops, rounds, timeout, owner)
    finally:
        program.gone()  # slices and edges are in durable frames


def _walk(program: Program, roots: DataFrame, hops: int, rounds: int, timeout: float | None, owner: Column | None) -> tuple[DataFrame, DataFrame]:
    info = program.methods.select("method_id", "signature", "key", "n_params")
    packed = program.methods.select("method_id", "units", "refs", "cfg")
    frontier = durable(roots.select("instance", "method_id", F.col("signature").alias("searched"), F.lit(hops).alias("hops"), F.lit(True).alias("resolving")).distinct().join(info.select("method_id", "key"), "method_id"))
    slices = edges = nodes = spent = None
    for step in range(rounds):
        sites = durable(call_sites(program, frontier))
        best = F.max(F.struct("resolving", "hops", "searched", "method_id"))
        taken = durable(sites.groupBy("instance", "key").agg(best.alias("t")).select("instance", "key", "t.method_id", "t.searched"))
        named = callsite_names(sites.join(taken, ["instance", "key", "method_id", "searched"], "left_semi"), ["instance", "method_id"], ["at", "target"], "key", "name")
        done = durable(named.join(sliced(packed, named.select("method_id", "target").distinct(), timeout), ["method_id", "target"]))
        found = done.select("instance", "method_id", "key", "target", "name", "relations", "slice", "graph", "seconds", "error")
        slices = found if slices is None else slices.unionByName(found)
        entered = taken.select("instance", "key")
        if step:  # the roots call what is searched, which is no node
            drawn = frontier.join(entered, ["instance", "key"], "left_semi").select("instance", F.col("key").alias("src"), signature_key(F.col("searched")).alias("dst"))
            edges = edges.unionByName(drawn)
        nodes = durable(entered if nodes is None else nodes.unionByName(entered))
        state = done.groupBy("instance", "method_id", "hops", "resolving").agg(F.max("open").alias("open")).join(info, "method_id")
        free = F.col("resolving") & F.col("open") & (F.col("n_params") > 0)
        onward = state.withColumn("resolving", free).withColumn("hops", F.when(free, F.col("hops")).otherwise(F.col("hops") - 1)).where("hops >= 0")
        up = durable(onward.join(program.callers, "method_id").select("instance", F.col("caller").alias("method_id"), F.col("caller_key").alias("key"), F.col("signature").alias("searched"), "hops", "resolving"))
        known = up.join(nodes, ["instance", "key"], "left_semi").select("instance", F.col("key").alias("src"), signature_key(F.col("searched")).alias("dst"))
        edges = known if edges is None else edges.unionByName(known)
        new = up.join(nodes, ["instance", "key"], "left_anti")
        if timeout and owner is not None:
            used = done.select(owner.alias("owner"), "seconds")
            spent = durable((used if spent is None else spent.unionByName(used)).groupBy("owner").agg(F.sum("seconds").alias("seconds")))
            new = new.withColumn("owner", owner).join(spent.where(F.col("seconds") > timeout).select("owner"), "owner", "left_anti").drop("owner")
        frontier = durable(new.groupBy("instance", "method_id", "key", "searched").agg(F.max(F.struct("resolving", "hops")).alias("s")).select("instance", "method_id", "key", "searched", "s.hops", "s.resolving"))
        if frontier.isEmpty():
            return slices, edges.distinct()
    raise RuntimeError("the callers do not end within the rounds")
