"""Command line: ``python -m quillon.cli VERB``."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import shutil
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import durable, exists
from quillon.functions.relations import RELATION, parsed_text, set_of_lines, static_problem
from quillon.functions.scalars import percent
from quillon.operators import verdict as V
from quillon.operators.coverage import status_counts
from quillon.operators.evaluation import confusion, require_complete
from quillon.session import session
from quillon.sources import artefacts, predictions, sinks, splits
from quillon.sources.tree import write_tree


def _targets(verb: argparse.ArgumentParser) -> None:
    which = verb.add_mutually_exclusive_group()
    which.add_argument("--sha256", nargs="*", default=[], help="applications by hash")
    which.add_argument("--split", help="the applications of a split, in its order")
    which.add_argument("--all", action="store_true", help="every application that is there, which is the default")
    verb.add_argument("--limit", type=int, help="at most so many of them")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon")
    verbs = out.add_subparsers(dest="verb", required=True)

    analyze = verbs.add_parser("analyze", help="verdicts for the applications of an artefact tree")
    analyze.add_argument("--graphs", required=True, help="an artefact tree, or the tables that slice writes")
    analyze.add_argument("--catalog", required=True)
    analyze.add_argument("--output", required=True)
    _targets(analyze)
    analyze.add_argument("--splits", nargs="*", default=[], help="labelled splits; the targets, in their order, where none are named")
    analyze.add_argument("--split-folder", help="a folder whose splits of the usual names are taken in place of --splits")
    analyze.add_argument("--split-names", nargs="*", default=[], help="further names of splits in that folder, after the usual ones")
    analyze.add_argument("--mode", default="full", choices=("full", "flat", "no-verification"))
    analyze.add_argument("--model", default="rule", help="rule, or module:name of a factory of models")
    analyze.add_argument("--threshold", type=float, default=0.5)
    analyze.add_argument("--budget", type=int, default=120_000, help="tokens of a prompt")
    analyze.add_argument("--concurrency", type=int, default=5, help="requests at a time")
    analyze.add_argument("--interval", type=float, default=0.0, help="seconds between the starts of any two requests")
    analyze.add_argument("--timeout", type=float, default=120.0, help="seconds of a request")
    analyze.add_argument("--overwrite", action="store_true", help="compute again what has a result of this configuration")
    analyze.add_argument("--refuse-others", action="store_true", help="end with an error if a target has a result of another configuration, in place of replacing it")

    walk = verbs.add_parser("slice", help="backward slices from program tables")
    walk.add_argument("--program", required=True, help="a folder with the Parquet tables method, unit, ref, cfg and calls; and roots, unless interfaces are listed")
    walk.add_argument("--output", required=True)
    walk.add_argument("--api-list", help="a list of interfaces, one class;->name a line: slices of all their callers, as the tables that analyze reads")
    _targets(walk)
    walk.add_argument("--hops", "--k", type=int, default=1, help="callers' callers after all variables are resolved")
    walk.add_argument("--timeout", type=float, default=900.0, help="seconds of a sample")
    walk.add_argument("--neighbourhoods", action="store_true", help="with --api-list: the call graphs within so many hops of each interface in place of slices")
    walk.add_argument("--export", help="a folder for the files of the slices, one by one")
    walk.add_argument("--overwrite", action="store_true")

    inspect = verbs.add_parser("inspect", help="counts of an artefact tree")
    inspect.add_argument("--graphs", required=True)
    inspect.add_argument("--catalog", required=True)

    evaluate = verbs.add_parser("evaluate", help="scores of stored verdicts on a split")
    evaluate.add_argument("--split", required=True)
    given = evaluate.add_mutually_exclusive_group(required=True)
    given.add_argument("--results")
    given.add_argument("--logs")
    evaluate.add_argument("--allow-missing", action="store_true")
    evaluate.add_argument("--json", action="store_true", help="JSON alone")

    verbs.add_parser("doctor", help="checks of the environment")
    return out


def _chosen(spark: SparkSession, a: argparse.Namespace, there: DataFrame) -> DataFrame:
    """The keys to work on, as ``sha256``: those that are named, or those of ``there``."""
    if a.sha256:
        return splits.targets(spark.createDataFrame(list(enumerate(a.sha256)), "ordinal int, sha256 string"), limit=a.limit)
    paths = [a.split] if a.split else getattr(a, "splits", [])
    if paths and not a.all:
        keys = None
        for k, path in enumerate(paths):
            rows = splits.read_split(spark, path, ordinal="place").select("sha256", F.struct(F.lit(k).alias("split"), "place").alias("ordinal"))
            keys = rows if keys is None else keys.unionByName(rows)
        return splits.targets(keys, limit=a.limit)
    return splits.targets(there.select("sha256", F.col("sha256").alias("ordinal")), limit=a.limit)


def _labelled(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """The splits of a run, by name or from a folder."""
    if not a.split_folder:
        return a.splits
    if a.splits:
        raise ValueError("splits are named or come from a folder, not both")
    found = splits.existing(spark, a.split_folder, (*splits.SPLIT_NAMES, *a.split_names))
    if not found:
        raise ValueError(f"{a.split_folder} has no splits")
    return found


def _factory(name: str) -> Callable[[], V.Model]:
    if name == "rule":
        return V.RuleModel
    module, _, attribute = name.partition(":")
    try:
        found = importlib.import_module(module)
        cloudpickle.register_pickle_by_value(found)  # tasks need not have it installed
        return getattr(found, attribute)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no model {name!r}: rule or module:name is needed") from e


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if an application failed; failures are in ``failures`` beside the results.

    Applications with a result of this configuration keep it, and slices that have been
    summarised are taken from the cache, unless all is computed anew.
    """
    began, started = time.monotonic(), datetime.now(timezone.utc)
    settings = V.Settings(threshold=a.threshold, mode=a.mode, budget=a.budget, interval=a.interval, timeout=a.timeout, concurrency=a.concurrency)
    model = _factory(a.model)
    a.splits = _labelled(spark, a)
    files = artefacts.read_artefacts(spark, a.graphs, [k.strip() for k in a.sha256] or None)
    keys = durable(_chosen(spark, a, files.select("sha256").distinct()))
    config = {"model": a.model, "mode": a.mode, "threshold": a.threshold, "prompt_version": V.PROMPT_VERSION}
    results, kept_slices = f"{a.output}/results", f"{a.output}/cache"
    if exists(spark, f"{results}/sha256=*"):
        done = spark.read.schema("sha256 string, " + ", ".join(f"{k} {'double' if k == 'threshold' else 'string'}" for k in config)).json(results)
        if not a.refuse_others:
            for k, v in config.items():
                done = done.where(F.col(k) == v)
        keys = durable(predictions.to_do(keys, done, config, a.overwrite))
    files, catalog = files.join(keys, "sha256", "left_semi"), splits.read_catalog(spark, a.catalog)
    found = artefacts.contexts(files, catalog, strict=False)
    broken = None
    if a.mode == "full":  # other modes read no relations
        found = found.withColumn("__lines", F.when(F.col("relations").isNotNull(), parsed_text(F.col("relations"))))
        broken = found.select("sha256", static_problem(F.col("__lines")).alias("problem"))
        found = found.withColumn("expected", set_of_lines(F.col("__lines"))).drop("__lines")
    else:
        found = found.withColumn("expected", F.lit(None).cast(f"array<{RELATION}>"))
    unfit = durable(artefacts.unfit(files, catalog, broken))
    found = found.join(unfit, "sha256", "left_anti")
    if a.mode == "flat":
        verdicts = V.flat(found, model, settings)
        by_status = None
    else:
        numbered = found.withColumn("ordinal", F.struct("instance", "source", "name"))
        cache = None if a.overwrite else sinks.read_cache(spark, kept_slices)
        functions = durable(V.with_cache(numbered, cache, lambda s: V.functions_tier(s, model, settings), settings, a.model))
        sinks.append_cache(functions.select("fingerprint", "summary", "selected", "invalid", "metrics", "status", "usage", "error", "cached"), kept_slices)
        verdicts = V.applications_tier(V.interfaces_tier(functions, model, settings), model, settings)
        failed_slices = functions.groupBy("sha256").agg(F.max("error").alias("slice_error"), F.count_if("cached").alias("cache_hits"))
        verdicts = verdicts.join(failed_slices, "sha256", "left").withColumn("error", F.coalesce("slice_error", "error")).drop("slice_error")
        by_status = status_counts(functions, ["sha256"]).select("sha256", F.struct("passed", "revised", "unavailable", "disabled").alias("verification_counts"))
    if by_status is not None:
        verdicts = verdicts.join(by_status, "sha256", "left")
    labels = a.splits or ([a.split] if a.split else [])
    if labels:
        verdicts = verdicts.join(splits.read_labels(spark, labels).withColumnRenamed("label", "true_label"), "sha256", "left")
    total = F.struct(F.col("usage.input").alias("input_tokens"), F.col("usage.output").alias("output_tokens"), (F.col("usage.input") + F.col("usage.output")).alias("total_tokens"))
    verdicts = durable(verdicts.withColumn("token_usage", total).drop("usage").withColumns({"schema_version": F.lit(1), **{k: F.lit(v) for k, v in config.items()}}))
    none = keys.join(verdicts.select("sha256"), "sha256", "left_anti").withColumn("error", F.lit("no contexts that could be analyzed"))
    none = none.join(unfit, "sha256", "left_anti")
    failed = V.dead_letters(verdicts).unionByName(unfit).unionByName(none)
    run = {"started_at": F.lit(started.isoformat()), "duration_seconds": F.lit(round(time.monotonic() - began, 3))}  # of the run, in which all applications are judged together
    sinks.write_results(verdicts.where("error IS NULL").drop("error").withColumns(run), results)
    sinks.write_dead_letters(failed, f"{a.output}/failures")
    return int(not failed.isEmpty())


def slice_(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 if a sample failed; the report says which, and what became of the others."""
    from quillon.operators import contexts, slicing
    from quillon.operators.neighbourhoods import neighbourhood_files

    if a.hops < 0:
        raise ValueError("hops are not negative")
    if a.timeout <= 0:
        raise ValueError("the timeout is positive")
    if a.neighbourhoods and not a.api_list:
        raise ValueError("neighbourhoods need a list of interfaces")
    names = ["method", "unit", "ref", "cfg", "calls", *([] if a.api_list else ["roots"])]
    t = {n: spark.read.parquet(f"{a.program}/{n}") for n in names}
    if not a.api_list:
        slices, edges = slicing.backward(slicing.packed_methods(t["unit"], t["ref"], t["cfg"]), t["unit"], t["method"], t["calls"], t["roots"], a.hops, timeout=a.timeout)
        slices.write.mode("overwrite").parquet(f"{a.output}/slices")
        edges.write.mode("overwrite").parquet(f"{a.output}/call_graph")
        return 0
    method = t["method"].withColumn("sha256", F.upper("sha256"))
    keys = durable(_chosen(spark, a, method.select("sha256").distinct()))
    root = f"{a.output}/artefacts"
    done = artefacts.read_artefacts(spark, root).select("sha256").distinct() if exists(spark, f"{root}/sha256=*") else keys.limit(0)
    wanted = durable(predictions.to_do(keys, done, overwrite=a.overwrite))
    features = splits.read_api_list(spark, a.api_list).withColumnsRenamed({"method": "name"})
    if a.neighbourhoods:
        made = neighbourhood_files(method.join(keys, "sha256", "left_semi"), t["unit"], t["calls"], features, a.hops)
        made.files.write.mode("overwrite").partitionBy("sha256").parquet(f"{a.output}/neighbourhoods")
        sinks.write_report(made.report.withColumnRenamed("sha256", "apk"), f"{a.output}/slicing-report")
        print(json.dumps({r["status"]: r["count"] for r in made.report.groupBy("status").count().collect()}, sort_keys=True))
        return 0
    made = contexts.contexts(method.join(wanted, "sha256", "left_semi"), t["unit"], t["ref"], t["cfg"], t["calls"], features, a.hops, a.timeout)
    skipped = keys.join(wanted, "sha256", "left_anti").withColumns({"status": F.lit("skipped"), "slice_count": F.lit(None).cast("long"), "duration_seconds": F.lit(0.0), "error": F.lit("there is a result")})
    missing = wanted.join(method.select("sha256"), "sha256", "left_anti").withColumns({"status": F.lit("error"), "slice_count": F.lit(None).cast("long"), "duration_seconds": F.lit(0.0), "error": F.lit("no such program")})
    report = durable(made.report.unionByName(skipped).unionByName(missing))
    sinks.write_artefacts(made.files, report, root)
    sinks.write_report(report.withColumnRenamed("sha256", "apk"), f"{a.output}/slicing-report")
    if a.export:
        write_tree(artefacts.read_artefacts(spark, root).join(wanted, "sha256", "left_semi"), a.export)
    counts = {r["status"]: r["count"] for r in report.groupBy("status").count().collect()}
    print(json.dumps(counts, sort_keys=True))
    return int(bool(counts.get("error")))


def inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    found = artefacts.contexts(artefacts.read_artefacts(spark, a.graphs), splits.read_catalog(spark, a.catalog))
    counts = artefacts.inspection(found).first().asDict()
    print(json.dumps(counts))
    return int(not counts["apis"])


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    said = predictions.read_results(spark, a.results) if a.results else predictions.read_logs(spark, a.logs)
    report = confusion(splits.read_split(spark, a.split), said, "sha256")
    row = require_complete(report, a.allow_missing).withColumns({f"{c}_text": percent(F.col(c)) for c in ("f1", "fpr", "fnr")}).first().asDict()
    said = {c: row.pop(f"{c}_text") for c in ("f1", "fpr", "fnr")}
    if not a.json:
        print(f"n={row['evaluated']}/{row['total_expected']}  F1={said['f1']}  FPR={said['fpr']}  FNR={said['fnr']}")
    print(json.dumps(row, sort_keys=True))
    return 0


def doctor() -> int:
    """0 if all that a run needs is there."""
    checks = {"java": shutil.which("java") is not None} | {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "numpy")}
    for name, ok in checks.items():
        print(f"{'ok     ' if ok else 'missing'} {name}")
    return int(not all(checks.values()))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "doctor":
        return doctor()
    verb = {"analyze": analyze, "slice": slice_, "inspect": inspect, "evaluate": evaluate}[a.verb]
    try:
        return verb(session("quillon"), a)
    except (ValueError, RuntimeError, PySparkException) as e:  # an input that cannot be read, or a job that failed
        print(f"error: {str(e).strip().splitlines()[0]}", file=sys.stderr)
        return 2
    except Py4JJavaError as e:
        print(f"error: {str(e.java_exception.getMessage()).strip().splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
