"""Publication: tables under a batch id, made visible together by one append to a batch log.

Each batch is written to paths of its own. Readers find the latest batch in the log, which gets its row only
after every table is complete, so a failure at any table leaves readers on the batch before, and
rolling back is deleting what was staged.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.connection import Connection
from ledgerloom.plans.contracts import PUBLISHED, CONTRACTS, require
from ledgerloom.shared import delete_path

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LOG_SCHEMA = "batch_id string, loaded_at timestamp, run_seq long"


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


@dataclass
class Summary:
    status: str = "not_started"
    batch_id: str | None = None
    rollback_status: str = "not_applicable"
    rows: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The batch log, empty if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/lakehouse_batch_log")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/lakehouse_batch_log")


def latest_batch(log: DataFrame) -> DataFrame:
    """The batch of the highest run number, one row or none."""
    return log.groupBy().agg(F.max_by("batch_id", "run_seq").alias("batch_id"), F.max("run_seq").alias("run_seq")).filter("run_seq is not null")


def claim_run(spark: SparkSession, root: str) -> int:
    """The next run number, held by no one else: the file that claims it can be created only once."""
    last = latest_batch(read_log(spark, root)).collect()
    number = (last[0].run_seq if last else 0) + 1
    jvm = spark.sparkContext._jvm
    while True:
        claim = jvm.org.apache.hadoop.fs.Path(f"{root}/_run_claims/{number}")
        if claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(claim):
            return number
        number += 1


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    found = latest_batch(read_log(spark, root)).collect()
    return spark.read.parquet(f"{root}/{check_identifier(table)}/batch_id={found[0].batch_id}") if found else None


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, batch_id: str | None = None, connection: Connection | None = None) -> Summary:
    """Stage every table, then append to the log; on failure delete what was staged and raise with the summary.

    With a ``connection`` the staged rows also go to a database, stamped with the batch, before the log has it; its readers
    take the batch that the log names.
    """
    if connection is not None:
        connection.check()
    summary = Summary(batch_id=batch_id or uuid.uuid4().hex)
    staged: list[str] = []
    try:
        for name in PUBLISHED:
            path = f"{root}/{check_identifier(name)}/batch_id={summary.batch_id}"
            staged.append(path)
            require(tables[name], name).select(*CONTRACTS[name]).write.mode("overwrite").parquet(path)
            summary.rows[name] = spark.read.parquet(path).count()
            if connection is not None:
                connection.write(spark.read.parquet(path), name, summary.batch_id)
        entry = [(summary.batch_id, datetime.now(timezone.utc), claim_run(spark, root))]
        spark.createDataFrame(entry, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/lakehouse_batch_log")
        summary.status = "success"
        summary.rollback_status = "clean"
    except Exception as error:
        summary.status, summary.error = "failed", str(error)
        summary.rollback_status = "rolled_back"
        for path in staged:
            try:
                delete_path(spark, path)
            except Exception:  # the log still points to the batch before
                summary.rollback_status = "partial_rollback_failed"
        error.publish_summary = summary  # type: ignore[attr-defined]
        raise
    return summary
