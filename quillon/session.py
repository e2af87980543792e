"""Session factory: settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quillon", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and, if no cluster is named, a local master."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        n = cpus or os.cpu_count() or 1
        defaults |= {"spark.master": f"local[{n}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(n)}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
