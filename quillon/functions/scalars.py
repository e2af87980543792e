"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a hash, and as a variable (as a whole).
HASH = r"^[0-9a-fA-F]{64}$"
VARIABLE = r"\$?[A-Za-z_][A-Za-z0-9_]*(?:\[(?:\d+|\$?[A-Za-z_][A-Za-z0-9_]*)\])*"


def cleaned(value: Column) -> Column:
    """A cell without outer white space; null becomes empty."""
    return F.coalesce(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def sha_key(value: Column) -> Column:
    """A 64-digit hash in upper case, null for anything else."""
    key = F.upper(cleaned(value))
    return F.when(key.rlike(HASH), key)


def binary_label(value: Column) -> Column:
    """0 or 1 from text such as ``1.0``; null for anything else."""
    number = cleaned(value).try_cast("double")
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor((F.octet_length(text) + 2) / 3))


def without_node_suffix(text: Column) -> Column:
    """Graph text without the numbers that keep equal node names apart."""
    return F.regexp_replace(F.regexp_replace(text, r"---\d+", ""), r"^\s+|\s+$", "")


def signature_key(signature: Column) -> Column:
    """A method signature up to its parameters, so overloads share it."""
    return F.substring_index(F.regexp_replace(signature, "^<", ""), "(", 1)


def dotted(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("."))


def stem(path: Column) -> Column:
    """A file name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def last_integer(text: Column) -> Column:
    """The last line that is an integer, null if there is none."""
    return _last(F.regexp_extract_all(text, F.lit(r"(?m)^\s*([+-]?\d+)\s*$"), F.lit(1))).cast("long")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """What ``group`` of the last match holds, null if nothing matches."""
    return _last(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def permission_list(cell: Column) -> Column:
    """A permission cell as an array: a list literal, a quoted scalar, or bare text as the one member.

    A cell that looks like a list but does not parse is one member as it stands;
    blank members are dropped and the prefix ``Permission:`` goes.
    """
    text = cleaned(cell)
    as_list = text.rlike(r"^[\[(].*[\])]$")
    inside = F.regexp_extract(text, r"^[\[(](.*)[\])]$", 1)
    quoted = r"""\s*(?:'[^']*'|"[^"]*")\s*"""
    parses = inside.rlike(rf"^({quoted}(,{quoted})*,?\s*|\s*)$")
    members = F.transform(F.regexp_extract_all(inside, F.lit(r"""'[^']*'|"[^"]*\""""), F.lit(0)), _unquoted)
    one = F.array(F.when(text.rlike(r"""^('[^']*'|"[^"]*")$"""), _unquoted(text)).otherwise(text))
    values = F.when(as_list & parses, members).when(text == "", F.array().cast("array<string>")).otherwise(one)
    return F.transform(F.filter(values, lambda v: F.trim(v) != ""), lambda v: F.trim(F.regexp_replace(v, "^Permission:", "")))


def _unquoted(text: Column) -> Column:
    return text.substr(F.lit(2), F.length(text) - 2)


def unfenced(answer: Column) -> Column:
    """A model's answer without the Markdown fence around its JSON."""
    text = F.trim(answer)
    inside = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), F.trim(inside)).otherwise(text)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields, kept apart by a separator; null and empty are the same."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)
