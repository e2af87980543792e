"""What the jobs share: configuration, logging, and columns both of them derive from a text."""

from __future__ import annotations

import json
import logging
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = logging.getLogger("quillon.jobs")


def configured(job: str, path: str | None = None) -> dict:
    """The job's configuration file, with those of its values replaced that another file names; an unknown name is an error."""
    own = Path(__file__).with_name(f"{job}.json")
    config = json.loads(own.read_text(encoding="utf-8"))
    if path is not None:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        if unknown := set(given) - set(config):
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        config |= given
    return config


def hits(text: Column, terms: list[str]) -> Column:
    """How often listed terms stand in a text, in any case."""
    if not terms:
        return F.lit(0).cast("long")
    return F.coalesce(F.regexp_count(F.lower(text), F.lit("|".join(map(re.escape, terms)))), F.lit(0)).cast("long")


def logged() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
