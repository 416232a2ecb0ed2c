"""Layered tables on disk and in the catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MART = "owner_infrastructure_exposure_snapshot"
PREDICTIONS = "asset_lifecycle_predictions"
# The analytics database, and the table behind each of its views.
ANALYTICS = "main_analytics"
PROJECTIONS = {
    PREDICTIONS: f"ml_{PREDICTIONS}",
    "entity_master_current": "dw_entity_master_current",
    MART: f"mart_{MART}",
    "ownership_current": "dw_ownership_current",
}


def write_layer(tables: dict[str, DataFrame], root: str, done: list[str] | None = None) -> dict[str, str]:
    """Write each table as Parquet under ``root``; returns their paths, and adds each to ``done`` once it is complete."""
    paths = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        paths[name] = f"{root}/{name}"
        if done is not None:
            done.append(paths[name])
    return paths


def registered_name(table: str) -> str:
    """``mart_`` for the mart, ``ml_`` for predictions, ``dw_`` for all others."""
    return {MART: "mart_", PREDICTIONS: "ml_"}.get(table, "dw_") + table


def register(spark: SparkSession, paths: dict[str, str], catalog: bool = False) -> list[str]:
    """Name written tables: views of this session, or tables of the catalog that outlive it where it has a metastore."""
    names = []
    for table, path in paths.items():
        name = registered_name(table)
        if catalog:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.catalog.createTable(name, path=path, source="parquet")
        else:
            spark.read.parquet(path).createOrReplaceTempView(name)
        names.append(name)
    return names


def publish_analytics(spark: SparkSession, database: str = ANALYTICS) -> list[str]:
    """Views in a database of their own, each with the columns of its contract only."""
    from ledgerloom.plans.contracts import CONTRACTS

    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for view, table in PROJECTIONS.items():
        have = spark.table(table).columns
        columns = ", ".join(c for c in have if c in CONTRACTS[view] or view == "entity_master_current")
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{view} AS SELECT {columns} FROM {spark.catalog.currentDatabase()}.{table}")
        names.append(f"{database}.{view}")
    return names


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """Pretty JSON, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = json.dumps(report, indent=2, sort_keys=True, default=str) + "\n"
    out = store.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
