"""Variable-dependency relations: parsing, canonical form, text, and JSON.

A relation is ``struct<kind string, variables array<string>>``. Derived relations
hold target and source in this order, parallel ones two or more names in
lexicographic order without repeats, all others one name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.scalars import VARIABLE

# The names that files and models give the kinds, and a line of a relation file, kind and body.
KINDS = {
    "direct": "Direct",
    "transitive": "Transitive",
    "conditional": "Conditional",
    "parallel": "Parallel",
    "inheritance": "Derived",
    "derived": "Derived",
}
LINE = r"^\s*\[([^]]+)]\s*(.*?)\s*$"
MODEL_ITEM = "struct<type:string,variable:string,variables:array<string>,target:string,source:string,left:string,right:string>"
RELATION = "struct<kind:string,variables:array<string>>"


def canonical_kind(name: Column) -> Column:
    """The kind of any spelling, null if it is unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.lower(F.trim(name)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is referred to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def relation(kind: Column, variables: Column) -> Column:
    """A canonical relation, or null if the kind is unknown, a name is none, or their number is wrong."""

    def checked(r: Column) -> Column:
        names = r["variables"]
        valid = F.forall(names, lambda v: v.isNotNull() & v.rlike(f"^(?:{VARIABLE})$"))
        size = F.size(names)
        fits = F.when(r["kind"] == "Parallel", size >= 2).when(r["kind"] == "Derived", size == 2).otherwise(size == 1)
        return F.when(r["kind"].isNotNull() & valid & fits, r)

    def ordered(g: Column) -> Column:
        return F.struct(g["kind"].alias("kind"), F.when(g["kind"] == "Parallel", F.array_sort(F.array_distinct(g["names"]))).otherwise(g["names"]).alias("variables"))

    given = F.struct(kind.alias("kind"), F.transform(variables, lambda v: F.trim(v)).alias("names"))
    return _bound(_bound(given, ordered), checked)


def parsed_lines(lines: Column) -> Column:
    """A relation from each line such as ``[Derived] a <- b``; null for a malformed line.

    Kind and body are looked up once a line and then only referred to.
    """
    parts = F.transform(lines, lambda t: F.struct(canonical_kind(F.regexp_extract(t, LINE, 1)).alias("kind"), F.regexp_extract(t, LINE, 2).alias("body")))
    named = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), _names(p["kind"], p["body"]).alias("names")))
    return F.transform(named, lambda x: relation(x["kind"], x["names"]))


def _names(kind: Column, body: Column) -> Column:
    together = F.regexp_replace(body, r"(?i)\s+work\s+together\s*$", "")
    return F.when(kind == "Derived", F.split(body, "<-", 2)).when(kind == "Parallel", F.split(together, r"\s+and\s+")).otherwise(F.array(body))


def parsed_line(line: Column) -> Column:
    """A relation from one line; null if the line is malformed."""
    return F.get(parsed_lines(F.array(line)), F.lit(0))


def parsed_text(text: Column) -> Column:
    """All lines of a relation file: ``array<struct<line, text, relation>>``, blank lines left out.

    A null relation marks a malformed line; strict readers refuse a file with one.
    """
    lines = F.split(text, r"\r\n|\n|\r")
    both = F.zip_with(lines, parsed_lines(lines), lambda t, r: F.struct(t.alias("text"), r.alias("relation")))
    numbered = F.transform(both, lambda x, i: F.struct((i + 1).alias("line"), x["text"].alias("text"), x["relation"].alias("relation")))
    return F.filter(numbered, lambda x: F.trim(x["text"]) != "")


def static_problem(lines: Column) -> Column:
    """What is wrong with the lines of a relation file, of ``parsed_text``: its first malformed one, or null."""
    bad = F.filter(lines, lambda x: x["relation"].isNull())
    return F.when(F.size(bad) > 0, F.concat(F.lit("malformed relation at line "), F.get(bad, F.lit(0))["line"].cast("string")))


def set_of_lines(lines: Column) -> Column:
    """The relations of well-formed lines, of ``parsed_text``, as a sorted set."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(lines, lambda x: x["relation"].isNotNull()), lambda x: x["relation"])))


def static_set(text: Column) -> Column:
    """The relations of a file as a sorted set; raises on a malformed line."""
    lines = parsed_text(text)
    problem = static_problem(lines)
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.lit(True))
    return F.when(checked.cast("boolean"), set_of_lines(lines))


def model_item(item: Column) -> Column:
    """A relation from one object of a model's answer; null if it is malformed."""
    pair = F.when(F.coalesce(F.size(item["variables"]), F.lit(0)) > 0, item["variables"]).otherwise(F.array(item["left"], item["right"]))

    def of_kind(kind: Column) -> Column:
        return relation(kind, F.when(kind == "Derived", F.array(item["target"], item["source"])).when(kind == "Parallel", pair).otherwise(F.array(item["variable"])))

    return _bound(canonical_kind(item["type"]), of_kind)


def model_set(items: Column) -> Column:
    """The valid relations of a model's answer as a sorted set."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, model_item), lambda r: r.isNotNull())))


def model_set_strict(items: Column) -> Column:
    """The relations of a model's answer as a sorted set; raises on the first malformed object."""

    def read(marked: Column) -> Column:
        first = F.get(F.filter(marked, lambda m: m["relation"].isNull()), F.lit(0))
        said = F.concat(F.lit("malformed relationship "), first["index"].cast("string"), F.lit(": "), _problem(first["item"]))
        checked = F.when(F.exists(marked, lambda m: m["relation"].isNull()), F.raise_error(said)).otherwise(F.lit(True))
        return F.when(checked.cast("boolean"), F.array_sort(F.array_distinct(F.transform(marked, lambda m: m["relation"]))))

    return _bound(F.transform(items, lambda x, i: F.struct(i.alias("index"), x.alias("item"), model_item(x).alias("relation"))), read)


def model_invalid(items: Column) -> Column:
    """Its malformed objects with their index from 0, their JSON, and what is wrong with them."""
    marked = F.transform(items, lambda x, i: F.struct(i.alias("index"), F.to_json(x).alias("value"), _problem(x).alias("error"), model_item(x).isNull().alias("bad")))
    return F.transform(F.filter(marked, lambda x: x["bad"]), lambda x: F.struct(x["index"], x["value"], x["error"]))


def _problem(item: Column) -> Column:
    """Why an object that is no relation is none."""
    kind = canonical_kind(item["type"])
    unknown = F.concat(F.lit("unknown kind "), F.coalesce(item["type"], F.lit("null")))
    number = F.when(kind == "Parallel", "two or more different variables are needed").when(kind == "Derived", "a target and a source are needed").otherwise("one variable is needed")
    return F.when(item.isNull(), "no object").when(kind.isNull(), unknown).otherwise(number)


def formatted(relation_: Column) -> Column:
    """A relation as a line of a relation file."""
    kind, names = relation_["kind"], relation_["variables"]
    return (
        F.when(kind == "Derived", F.concat(F.lit("[Derived] "), F.get(names, F.lit(0)), F.lit(" <- "), F.get(names, F.lit(1))))
        .when(kind == "Parallel", F.concat(F.lit("[Parallel] "), F.array_join(names, " and "), F.lit(" work together")))
        .otherwise(F.concat(F.lit("["), kind, F.lit("] "), F.get(names, F.lit(0))))
    )


def file_text(relations: Column) -> Column:
    """A set of relations as the text of a file: sorted lines, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(relations, formatted))), "\n")


def as_json(relation_: Column) -> Column:
    """A relation as JSON, by kind: target and source, variables, or variable."""

    def fields(r: Column) -> Column:
        kind, names = r["kind"], r["variables"]
        return F.struct(
            kind.alias("type"),
            F.when(~kind.isin("Derived", "Parallel"), F.get(names, F.lit(0))).alias("variable"),
            F.when(kind == "Parallel", names).alias("variables"),
            F.when(kind == "Derived", F.get(names, F.lit(0))).alias("target"),
            F.when(kind == "Derived", F.get(names, F.lit(1))).alias("source"),
        )

    return F.to_json(_bound(relation_, fields))


def coverage(selected: Column, expected: Column) -> Column:
    """``struct<matches, selected, expected, drc, recall, f1>`` of two sets given as arrays.

    Of an empty selection the coverage is 1 if nothing was expected, else 0.
    """
    return metrics(F.size(F.array_intersect(selected, expected)).cast("long"), F.size(F.array_distinct(selected)).cast("long"), F.size(F.array_distinct(expected)).cast("long"))


def metrics(matches: Column, selected: Column, expected: Column) -> Column:
    drc = F.when(selected > 0, matches / selected).when(expected == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    recall = F.when(expected > 0, matches / expected).otherwise(F.lit(1.0))
    f1 = F.when(drc + recall > 0, 2 * drc * recall / (drc + recall)).otherwise(F.lit(0.0))
    return F.struct(matches.alias("matches"), selected.alias("selected"), expected.alias("expected"), drc.alias("drc"), recall.alias("recall"), f1.alias("f1"))
