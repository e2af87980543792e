"""Tiered verdicts: function, interface and application level answers of a model.

A model is any object with ``complete(prompt, json_mode)``; a factory makes one for
each task. Prompts are columns, answers are columns, and what happens between two
calls (parsing, verification, routing) is plain SQL. Equal prompts of one stage are
asked once. Rows that fail keep the error instead of ending the job.
"""

from __future__ import annotations

import concurrent.futures
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import relations as R
from quillon.functions.scalars import fingerprint, token_estimate, unfenced
from quillon.operators.coverage import routed
from quillon.operators.ordering import batched_by_budget


class Model(Protocol):
    def complete(self, prompt: str, json_mode: bool) -> str: ...


@dataclass(frozen=True)
class Recorded:
    """Answers that were recorded, in place of a model: ``fingerprint`` (of the prompt, by ``prompt_key``), ``answer`` and, where known, ``input`` and ``output`` tokens.

    They are joined, so a run on them needs no Python and no network, and a rerun of a
    study gives the same results at any size. Of several answers to a prompt the least counts.
    """

    answers: DataFrame


def prompt_key(prompt: Column, json_mode: bool = False) -> Column:
    """What a recorded answer is found by: the prompt and whether JSON is asked for."""
    return fingerprint(prompt, F.lit("json" if json_mode else "text"))


class TransientError(Exception):
    """What a model raises for an error that may pass."""


@dataclass(frozen=True)
class Settings:
    """Limits and switches of an analysis; a wrong one is refused when it is made."""

    threshold: float = 0.5
    mode: str = "full"  # or "flat", "no-verification"
    budget: int = 120_000
    attempts: int = 6
    least_wait: float = 1.0
    most_wait: float = 60.0
    interval: float = 0.0  # seconds between the starts of any two requests, whichever task makes them
    timeout: float | None = 120.0  # seconds of one request
    concurrency: int | None = 5  # tasks that ask at a time, one request each

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold lies between 0 and 1")
        if self.mode not in ("full", "flat", "no-verification"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.budget < 1 or self.attempts < 1 or self.interval < 0 or not 0 <= self.least_wait <= self.most_wait:
            raise ValueError("budget and attempts are positive, waits are in order")
        if self.interval and not self.concurrency:
            raise ValueError("an interval between requests needs a number of tasks")
        if (self.timeout is not None and self.timeout <= 0) or (self.concurrency is not None and self.concurrency < 1):
            raise ValueError("timeout and concurrency are positive")


class RuleModel:
    """A model without a network: it answers from the words of the prompt."""

    def __init__(self, suspicious: tuple[str, ...] = ("sendTextMessage", "getDeviceId", "exec", "DexClassLoader")) -> None:
        self.suspicious = suspicious

    def complete(self, prompt: str, json_mode: bool) -> str:
        hits = [w for w in self.suspicious if w in prompt]
        if not json_mode:
            return "Uses " + (", ".join(hits) or "nothing of note")
        if "TASK: function" in prompt:
            return json.dumps({"functionPurpose": f"Touches {len(hits)} listed calls", "controlFlowAnalysis": f"{prompt.count('if ')} branches", "relationships": []})
        label = "MALWARE" if hits else "BENIGN"
        return json.dumps({"prediction": label, "malware_type": "listed calls" if hits else None, "application_purpose": "unknown", "key_findings": [f"{len(hits)} listed calls", f"{len(prompt)} characters seen"], "conclusion": label.lower()})


#: Changes with the wording of the prompts, so that results of another wording are not taken for these.
PROMPT_VERSION = "relations-2"
USAGE = "struct<input:bigint,output:bigint>"
#: Answers that go back at a time.
AT_A_TIME = 64


def answered(df: DataFrame, prompt: str, answer: str, factory: Callable[[], Model] | Recorded, settings: Settings = Settings(), json_mode: bool = False) -> DataFrame:
    """``df`` with the model's answer to each prompt, ``<answer>_error`` where there is none, and ``<answer>_usage``.

    A ``factory`` makes a model for each task, or is a table of recorded answers. Null prompts are not asked. A prompt over the budget is not sent. Transient errors
    and requests that take too long are tried again after a random, growing wait; an
    empty answer is an error. The calls of one task are one after another, so the
    number of tasks bounds how many run at a time. With an interval, time is divided
    into slots of that length, of which each task has every n-th: so any two requests
    start an interval apart without the tasks knowing of each other, as long as their
    clocks agree. The usage is what the model says of its last call (``usage``: tokens
    in and out), else an estimate.
    """
    error, usage = f"{answer}_error", f"{answer}_usage"

    if isinstance(factory, Recorded):
        return _recalled(df, prompt, answer, factory.answers, settings, json_mode)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        pace = Pace(settings.interval, TaskContext.get().partitionId(), settings.concurrency or 1)
        for batch in batches:
            for begin in range(0, len(batch), AT_A_TIME):
                # prompts are long: one at a time is a Python string, and they go back without a copy
                prompts = batch["prompt"].slice(begin, AT_A_TIME)
                said = [_ask(model, p.as_py(), json_mode, settings, pace) for p in prompts]
                columns = [pa.array([s[k] for s in said], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([prompts, *columns], names=["prompt", answer, error, "input", "output"])

    asked = df.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct()
    sent = asked.where(token_estimate(F.col("prompt")) <= settings.budget)
    if settings.concurrency:
        sent = sent.repartition(settings.concurrency)
    within = sent.mapInArrow(ask, f"prompt string, `{answer}` string, `{error}` string, input long, output long")
    used = F.struct(F.coalesce("input", token_estimate(F.col("prompt"))).alias("input"), F.coalesce("output", token_estimate(F.col(answer)), F.lit(0)).cast("bigint").alias("output"))
    within = within.select("prompt", answer, error, F.when(F.col(answer).isNotNull(), used).cast(USAGE).alias(usage))
    over = asked.where(token_estimate(F.col("prompt")) > settings.budget).select("prompt", F.lit(None).cast("string").alias(answer), F.lit("prompt exceeds the budget").alias(error), F.lit(None).cast(USAGE).alias(usage))
    return df.join(within.unionByName(over).withColumnRenamed("prompt", "__asked"), F.col(prompt) == F.col("__asked"), "left").drop("__asked")


def _recalled(df: DataFrame, prompt: str, answer: str, answers: DataFrame, settings: Settings, json_mode: bool) -> DataFrame:
    """``df`` with recorded answers; a prompt without one, or with an empty one, has an error.

    Rows meet answers by the prompt's fingerprint, so no prompt is shuffled. Rows without
    one have a key of their own texts, as null keys would all go to one task.
    """
    tokens = [(F.col(c) if c in answers.columns else F.lit(None)).cast("long").alias(c) for c in ("input", "output")]
    known = answers.select("fingerprint", F.struct(F.col("answer"), *tokens).alias("a")).groupBy("fingerprint").agg(F.min("a").alias("__said")).withColumnRenamed("fingerprint", "__known")
    size = token_estimate(F.col(prompt))
    spread = F.concat(F.lit("none "), F.xxhash64(F.lit(0), *(F.col(f.name) for f in df.schema if f.dataType.typeName() == "string")).cast("string"))
    keyed = df.withColumns({"__size": F.when(F.col(prompt).isNotNull(), size), "__key": F.coalesce(F.when(size <= settings.budget, prompt_key(F.col(prompt), json_mode)), spread)})
    text = F.nullif(F.col("__said.answer"), F.lit(""))
    over = F.when(F.col("__size") > settings.budget, "prompt exceeds the budget")
    said = F.when(F.col("__said").isNull(), "no recorded answer").when(text.isNull(), "empty answer")
    used = F.struct(F.coalesce("__said.input", "__size").alias("input"), F.coalesce("__said.output", token_estimate(text), F.lit(0)).cast("bigint").alias("output"))
    found = keyed.join(known, F.col("__key") == F.col("__known"), "left")
    return found.select(*df.columns, text.alias(answer), F.when(F.col("__size").isNotNull(), F.coalesce(over, said)).alias(f"{answer}_error"), F.when(text.isNotNull(), used).cast(USAGE).alias(f"{answer}_usage"))


class Pace:
    """Lets a task start a request in its own slots only: those whose number has the task's remainder."""

    def __init__(self, interval: float, task: int, tasks: int) -> None:
        self.interval, self.task, self.tasks, self.last = interval, task % tasks, tasks, -1

    def next_slot(self, now: float) -> int:
        """The first own slot that has not begun before ``now`` and not been used."""
        slot = max(math.ceil(now / self.interval), self.last + 1)
        return slot + (self.task - slot) % self.tasks

    def wait(self) -> None:
        if self.interval:
            self.last = self.next_slot(time.time())
            time.sleep(max(0.0, self.last * self.interval - time.time()))


def _ask(model: Model, prompt: str, json_mode: bool, settings: Settings, pace: Pace) -> tuple[str | None, str | None, int | None, int | None]:
    for attempt in range(settings.attempts):
        try:
            pace.wait()
            if text := _timely(lambda: model.complete(prompt, json_mode), settings.timeout):
                tokens = getattr(model, "usage", None) or (None, None)
                return text, None, *tokens
            return None, "empty answer", None, None
        except (TransientError, TimeoutError) as e:
            if attempt + 1 == settings.attempts:
                return None, str(e) or type(e).__name__, None, None
            time.sleep(random.uniform(0, min(settings.most_wait, settings.least_wait * 2**attempt)))
        except Exception as e:
            return None, f"{type(e).__name__}: {e}", None, None
    return None, "no attempt", None, None


def _timely(call: Callable[[], str], seconds: float | None) -> str:
    """What ``call`` gives, or TimeoutError; a call that is given up ends by itself."""
    if seconds is None:
        return call()
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    except concurrent.futures.TimeoutError as e:
        raise TimeoutError(f"no answer in {seconds} seconds") from e
    finally:
        pool.shutdown(wait=False)


def summed_usage(*parts: Column) -> Column:
    """The sum of usages, of which some may be null."""
    none = F.lit(0).cast("bigint")
    return F.struct(*(sum((F.coalesce(u[f], none) for u in parts), none).alias(f) for f in ("input", "output"))).cast(USAGE)


def _total_usage(usage: str) -> Column:
    """The same as an aggregate."""
    return F.struct(*(F.coalesce(F.sum(F.col(usage)[f]), F.lit(0).cast("bigint")).alias(f) for f in ("input", "output"))).cast(USAGE)


def function_prompt(graph: Column, signature: Column) -> Column:
    return F.concat(F.lit("TASK: function\nCALL: "), signature, F.lit("\nRETURN: JSON with functionPurpose, controlFlowAnalysis, relationships\nCODE:\n"), graph)


def summary_prompt(graph: Column, signature: Column) -> Column:
    return F.concat(F.lit("TASK: summary\nCALL: "), signature, F.lit("\nRETURN: two short paragraphs\nCODE:\n"), graph)


def revision_prompt(graph: Column, signature: Column, summary: Column, expected: Column) -> Column:
    return F.concat(F.lit("TASK: revise\nCALL: "), signature, F.lit("\nSUMMARY:\n"), summary, F.lit("\nFACTS:\n"), R.file_text(expected), F.lit("\nCODE:\n"), graph)


_ANSWER = f"functionPurpose string, function_purpose string, controlFlowAnalysis string, control_flow_analysis string, relationships array<{R.MODEL_ITEM}>"
_SINGLE = f"relationships {R.MODEL_ITEM}"
_INVALID = "array<struct<index:int,value:string,error:string>>"
_METRICS = "struct<matches:bigint,selected:bigint,expected:bigint,drc:double,recall:double,f1:double>"


def functions_tier(slices: DataFrame, factory: Callable[[], Model], settings: Settings = Settings()) -> DataFrame:
    """``slices`` (graph, signature, expected: null where there is no relation file) with summary, status and metrics.

    Of an answer that is no JSON the fallback summary is revised if relations are
    known; other answers are verified, and revised once below the threshold or with
    malformed relations. Metrics are those before a revision. Without verification there
    are neither relations nor metrics.
    """
    graph, signature = F.col("graph"), F.col("signature")
    if settings.mode == "no-verification":
        out = answered(slices.withColumn("__p", summary_prompt(graph, signature)), "__p", "summary", factory, settings)
        none = {"selected": f"array<{R.RELATION}>", "invalid": _INVALID, "metrics": _METRICS}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"status": F.lit("disabled"), "error": F.col("summary_error"), "usage": summed_usage(F.col("summary_usage"))})
        return out.select(*slices.columns, "summary", *none, "status", "usage", "error")
    first = answered(slices.withColumn("__p", function_prompt(graph, signature)), "__p", "__a", factory, settings, json_mode=True)
    text = unfenced(F.col("__a"))
    parsed = first.withColumn("__json", F.try_parse_json(text)).withColumn("__j", F.from_json(text, _ANSWER)).withColumn("__one", F.from_json(text, _SINGLE))
    items = F.coalesce(F.col("__j.relationships"), F.when(F.col("__one.relationships").isNotNull(), F.array("__one.relationships")), F.array().cast(f"array<{R.MODEL_ITEM}>"))
    purpose = F.trim(F.coalesce("__j.functionPurpose", "__j.function_purpose", F.lit("")))
    flow = F.trim(F.coalesce("__j.controlFlowAnalysis", "__j.control_flow_analysis", F.lit("")))
    truncated = F.col("__a").isNotNull() & F.col("__json").isNull()
    parsed = parsed.withColumns(
        {
            "truncated": truncated,
            "selected": F.when(truncated, F.array().cast(f"array<{R.RELATION}>")).otherwise(R.model_set(items)),
            "invalid": R.model_invalid(items),
            "__summary": F.when((purpose != "") & (flow != ""), F.concat(purpose, F.lit("\n\n"), flow)),
            "__fall": F.when(truncated, summary_prompt(graph, signature)),
        }
    )
    fell = answered(parsed, "__fall", "__f", factory, settings)
    verified = fell.withColumns(
        {
            "metrics": F.when(F.col("expected").isNotNull(), R.coverage(F.col("selected"), F.col("expected"))),
            "n_invalid": F.size("invalid") + F.when(F.col("truncated"), 1).otherwise(0),
            "available": F.col("expected").isNotNull(),
            "__summary": F.coalesce("__f", "__summary"),
        }
    )
    checked = routed(verified.withColumn("drc", F.col("metrics.drc")), settings.threshold)
    asked = checked.withColumn("__r", F.when(F.col("status") == "revised", revision_prompt(graph, signature, F.coalesce("__summary", F.lit("")), F.col("expected"))))
    revised = answered(asked, "__r", "__v", factory, settings)
    error = F.coalesce("__a_error", "__f_error", "__v_error", F.when(F.col("__summary").isNull(), F.lit("the answer lacks its purpose or its control flow")))
    return revised.select(*slices.columns, F.trim(F.coalesce("__v", "__summary")).alias("summary"), "selected", "invalid", "metrics", "status", summed_usage(*(F.col(f"__{k}_usage") for k in "afv")).alias("usage"), error.alias("error"))


def with_cache(slices: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame], settings: Settings = Settings(), model_name: str = "rule") -> DataFrame:
    """Results from the cache by a fingerprint of all that decides them; the rest is computed. Append what is new to keep it.

    That is the slice's name and interface, its first prompt and the version of all of
    them, its relations, the model, the mode and the threshold. An entry without a
    summary is none.
    """
    expected = F.coalesce(R.file_text(F.col("expected")), F.lit("none"))
    graph, signature = F.col("graph"), F.col("signature")
    prompt = summary_prompt(graph, signature) if settings.mode == "no-verification" else function_prompt(graph, signature)
    place = F.concat_ws("/", *(F.col(c).cast("string") for c in ("api_index", "instance", "name") if c in slices.columns))
    keyed = slices.withColumn("fingerprint", fingerprint(place, signature, prompt, F.lit(PROMPT_VERSION), expected, F.lit(model_name), F.lit(settings.mode), F.lit(settings.threshold)))
    if cache is None:
        return compute(keyed).withColumn("cached", F.lit(False))
    known = cache.where("summary IS NOT NULL").dropDuplicates(["fingerprint"])
    results = [c for c in known.columns if c not in keyed.columns and c != "cached"]
    hit = keyed.join(known.select("fingerprint", *results), "fingerprint").withColumn("cached", F.lit(True))
    miss = compute(keyed.join(known.select("fingerprint"), "fingerprint", "left_anti")).withColumn("cached", F.lit(False))
    return miss.unionByName(hit, allowMissingColumns=True)


def interfaces_tier(functions: DataFrame, factory: Callable[[], Model], settings: Settings = Settings(), overhead: int = 200) -> DataFrame:
    """One analysis for each application and interface, in batches that fit the budget, joined in order.

    ``functions``: sha256, api_index, signature, ordinal, summary, and where known name,
    permissions, instance and its call_graph. A batch shows the call graph of each
    instance that it has functions of, with these functions below it. A hot interface is
    split into batches like any other; its summaries meet as one answer a batch. One
    function that is too large alone, with its call graph, is not asked about and is an
    error of its interface.
    """
    group = ["sha256", "api_index"]
    given = functions.columns
    instance = F.col("instance").cast("string") if "instance" in given else F.lit("")
    calls = F.coalesce("call_graph", F.lit("")) if "call_graph" in given else F.lit("")
    name = F.coalesce(F.col("name"), F.lit("")) if "name" in given else F.lit("")
    permissions = F.coalesce(F.array_join("permissions", ", "), F.lit("")) if "permissions" in given else F.lit("")
    plain = functions.select(*group, "signature", permissions.alias("__needs"), instance.alias("__instance"), calls.alias("__calls"), name.alias("__name"), "ordinal", F.coalesce("summary", F.lit("")).alias("summary"), "usage" if "usage" in given else F.lit(None).cast(USAGE).alias("usage"))
    sized = plain.withColumn("__size", token_estimate(F.concat("__name", "summary")) + 8).withColumn("__shared", F.when(F.col("__calls") != "", token_estimate(F.col("__calls")) + 8).otherwise(0))
    batched = batched_by_budget(sized, group, ["ordinal"], "__size", settings.budget, overhead, shared=("__instance", "__shared"), oversize="__oversize")
    function = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__name", "summary"))), lambda x: F.concat(F.lit("#"), x["ordinal"].cast("string"), F.lit(" "), x["__name"], F.lit("\n"), x["summary"]))
    sections = batched.groupBy(*group, "signature", "__needs", "batch", "__instance").agg(F.min("ordinal").alias("first"), F.first("__calls").alias("calls"), F.array_join(function, "\n\n").alias("text"), F.bool_or("__oversize").alias("oversize"), _total_usage("usage").alias("usage"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("first", "calls", "text"))), lambda x, i: F.concat(F.when(x["calls"] != "", F.concat(F.lit("-- Context "), (i + 1).cast("string"), F.lit("\nCALL GRAPH:\n"), x["calls"], F.lit("\n"))).otherwise(""), F.lit("FUNCTIONS:\n"), x["text"]))
    needs = F.when(F.col("__needs") != "", F.concat(F.lit("PERMISSIONS: "), F.col("__needs"), F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("TASK: interface\nCALL: "), F.col("signature"), F.lit("\n"), needs, F.col("shown"))
    prompts = sections.groupBy(*group, "signature", "__needs", "batch").agg(F.array_join(shown, "\n\n").alias("shown"), F.bool_or("oversize").alias("oversize"), _total_usage("usage").alias("before")).withColumn("__p", F.when(~F.col("oversize"), prompt))
    said = answered(prompts, "__p", "__a", factory, settings).withColumn("usage", summed_usage(F.col("before"), F.col("__a_usage")))
    said = said.withColumn("__a_error", F.when(F.col("oversize"), "one function alone exceeds the budget").otherwise(F.col("__a_error")))
    analyses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "__a"))), lambda x, i: F.concat(F.lit("== Batch "), (i + 1).cast("string"), F.lit(" ==\n"), F.trim(F.coalesce(x["__a"], F.lit(""))))), "\n\n")
    return said.groupBy(*group, "signature").agg(analyses.alias("analysis"), F.count("*").alias("batches"), _total_usage("usage").alias("usage"), F.max("__a_error").alias("error"))


_FINAL = "prediction string, malware_type string, application_purpose string, key_findings array<string>, conclusion string"


def validated_final(df: DataFrame, answer: str) -> DataFrame:
    """Columns of the final answer, and ``error`` for one that does not keep to its form; a benign verdict has no type."""
    j = F.from_json(unfenced(F.col(answer)), _FINAL)
    prediction = F.upper(F.trim(j["prediction"]))
    findings = F.transform(j["key_findings"], lambda x: F.trim(x))
    blank = F.exists(findings, lambda x: F.coalesce(x, F.lit("")) == "")
    error = (
        F.when(~F.coalesce(prediction.isin("MALWARE", "BENIGN"), F.lit(False)), "invalid prediction")
        .when(~F.coalesce(F.size(findings).between(2, 3) & ~blank, F.lit(False)), "two or three findings are needed")
        .when((F.trim(F.coalesce(j["application_purpose"], F.lit(""))) == "") | (F.trim(F.coalesce(j["conclusion"], F.lit(""))) == ""), "purpose or conclusion is missing")
    )
    ok = error.isNull()
    return df.withColumns(
        {
            "prediction": F.when(ok, prediction),
            "malware_type": F.when(ok & (prediction == "MALWARE"), j["malware_type"]),
            "application_purpose": F.when(ok, F.trim(j["application_purpose"])),
            "key_findings": F.when(ok, findings),
            "conclusion": F.when(ok, F.trim(j["conclusion"])),
            "error": F.coalesce(F.col("error"), error) if "error" in df.columns else error,
        }
    )


def applications_tier(interfaces: DataFrame, factory: Callable[[], Model], settings: Settings = Settings()) -> DataFrame:
    """One verdict an application; a prompt over the budget fails it, as there are no batches here, and so does an interface with an error."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("api_index", "signature", "analysis"))), lambda x: F.concat(F.lit("## "), x["signature"], F.lit("\n"), x["analysis"])), "\n\n")
    given = interfaces if "usage" in interfaces.columns else interfaces.withColumn("usage", F.lit(None).cast(USAGE))
    prompts = given.groupBy("sha256").agg(F.concat(F.lit("TASK: application\nANALYSES:\n"), body).alias("__p"), _total_usage("usage").alias("before"), F.max("error").alias("error") if "error" in given.columns else F.lit(None).cast("string").alias("error"))
    prompts = prompts.withColumn("__p", F.when(F.col("error").isNull(), F.col("__p")))
    said = answered(prompts, "__p", "__a", factory, settings, json_mode=True).withColumn("error", F.coalesce("error", "__a_error")).withColumn("usage", summed_usage(F.col("before"), F.col("__a_usage")))
    return validated_final(said, "__a").drop("__p", "__a", "__a_error", "__a_usage", "before")


def flat(contexts: DataFrame, factory: Callable[[], Model], settings: Settings = Settings()) -> DataFrame:
    """The verdict from raw graphs in one prompt, without tiers.

    ``contexts``: sha256, api_index, signature, graph, and where known permissions,
    instance and its call_graph, which stands once before the slices of its instance.
    """
    given = contexts.columns
    instance = F.col("instance").cast("string") if "instance" in given else F.lit("")
    calls = F.coalesce("call_graph", F.lit("")) if "call_graph" in given else F.lit("")
    permissions = F.coalesce(F.array_join("permissions", ", "), F.lit("")) if "permissions" in given else F.lit("")
    key = ["sha256", "api_index", "signature", "__needs", "__instance"]
    sections = contexts.select("sha256", "api_index", "signature", permissions.alias("__needs"), instance.alias("__instance"), calls.alias("__calls"), "graph").groupBy(*key).agg(F.first("__calls").alias("calls"), F.array_join(F.array_sort(F.collect_list("graph")), "\n\n").alias("graphs"))
    one = F.concat(F.lit("## "), F.col("signature"), F.when(F.col("__needs") != "", F.concat(F.lit("\nPERMISSIONS: "), F.col("__needs"))).otherwise(""), F.when(F.col("calls") != "", F.concat(F.lit("\nCALL GRAPH:\n"), F.col("calls"))).otherwise(""), F.lit("\n"), F.col("graphs"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("api_index", "__instance", "section"))), lambda x: x["section"]), "\n\n")
    prompts = sections.withColumn("section", one).groupBy("sha256").agg(F.concat(F.lit("TASK: application\nGRAPHS:\n"), body).alias("__p"))
    said = answered(prompts, "__p", "__a", factory, settings, json_mode=True).withColumn("error", F.col("__a_error")).withColumn("usage", summed_usage(F.col("__a_usage")))
    return validated_final(said, "__a").drop("__p", "__a", "__a_error", "__a_usage")


def dead_letters(results: DataFrame, key: str = "sha256") -> DataFrame:
    return results.where(F.col("error").isNotNull()).select(key, "error")
