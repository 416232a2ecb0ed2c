"""Session settings that every entry point of the package shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "ledgerloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC as its zone. A cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    elif cores is not None:
        builder = builder.master(f"local[{cores}]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
