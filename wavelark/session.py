"""One place for the session settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "wavelark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def local(cpus: int | None = None, **conf: str) -> SparkSession:
    n = cpus or os.cpu_count() or 1
    return session(master=f"local[{n}]", **({"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | conf))
