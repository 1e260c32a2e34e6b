"""A session with the settings that the operators count on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def get_session(name: str = "kairoscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is used only where the session names none and runs on one machine, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/kairoscope-shared"
    return f"{folder.rstrip('/')}/kairoscope-{name}-{uuid.uuid4().hex}"
