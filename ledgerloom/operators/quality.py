"""Data-quality checks; each returns the failing rows, so an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def not_accepted(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values, with counts, that are not among the accepted; nulls pass, as they have a check of their own."""
    return df.filter(~F.col(column).isin(list(accepted))).groupBy(column).agg(F.count("*").alias("n_rows"))


def out_of_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad: Column = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.filter(bad)


def gold_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks of the published tables: (check_name, failing_rows)."""
    mart, current = tables["owner_infrastructure_exposure_snapshot"], tables["ownership_current"]
    master, predictions = tables["entity_master_current"], tables.get("asset_lifecycle_predictions")
    stages = ("planning", "construction", "operating", "decommissioning", "retired")
    checks = {
        "mart_grain": not_unique(mart, ["snapshot_date", "owner_entity_id", "asset_country", "asset_sector"]),
        "mart_capacity": out_of_range(mart, "owned_capacity_mw", low=0),
        "mart_pct": out_of_range(mart, "average_ownership_pct", low=0, high=100),
        "current_sk_unique": not_unique(current, ["ownership_sk"]),
        "current_one_open": not_unique(current.filter("is_current_flag = 'Y'"), ["business_key_hash"]),
        "current_flag": not_accepted(current, "is_current_flag", ["Y", "N"]),
        "master_unique": not_unique(master, ["entity_id"]),
    }
    for name, df, columns in (
        ("mart", mart, ("owner_entity_id", "snapshot_date", "owned_capacity_mw")),
        ("current", current, ("ownership_sk", "owner_entity_id", "asset_id")),
        ("master", master, ("entity_id", "entity_name", "country_code")),
    ):
        for column in columns:
            checks[f"{name}_{column}_not_null"] = is_null(df, column)
    if predictions is not None:
        checks["predictions_unique"] = not_unique(predictions, ["asset_id"])
        checks["predictions_stage"] = not_accepted(predictions, "predicted_lifecycle_stage", stages)
        for column in ("asset_id", "lifecycle_stage_confidence", "model_version"):
            checks[f"predictions_{column}_not_null"] = is_null(predictions, column)
    rows = None
    for name, failing in checks.items():
        one = failing.agg(F.count("*").alias("failing_rows")).select(F.lit(name).alias("check_name"), "failing_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows
