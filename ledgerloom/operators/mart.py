"""The exposure mart: what each owner holds, by country and sector, at each snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.history import as_of, snapshot_diff

KEY = ("owner_entity_id", "asset_country", "asset_sector")
METRICS = ("asset_count", "controlled_asset_count", "owned_capacity_mw", "average_ownership_pct", "relationship_count")
#: Decimals of the two averages and sums, so that equal content compares equal whatever the order of summing.
DECIMALS = 6


def exposure(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """Metrics of each owner, country and sector at each snapshot, with the calendar's columns."""
    held = as_of(history, calendar)
    pct, capacity = F.col("ownership_pct"), F.col("capacity_mw")
    return (
        held.groupBy(*KEY, "seq", "snapshot_date", "snapshot_version", "is_latest", "last_seq")
        .agg(
            F.countDistinct("asset_id").alias("asset_count"),
            F.sum((pct >= 50).cast("long")).alias("controlled_asset_count"),
            F.round(F.sum(capacity * pct / 100.0), DECIMALS).alias("owned_capacity_mw"),
            F.round(F.avg(pct), DECIMALS).alias("average_ownership_pct"),
            F.count("ownership_sk").alias("relationship_count"),
        )
    )


def exposure_mart(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """Metrics with their change against the snapshot before; what vanishes gets one row of zeros."""
    zeros = {c: F.lit(0).cast("long") for c in ("asset_count", "controlled_asset_count", "relationship_count")}
    zeros |= {c: F.lit(0.0) for c in ("owned_capacity_mw", "average_ownership_pct")}
    compared = snapshot_diff(exposure(history, calendar), calendar, KEY, METRICS, "change_status_vs_prior_snapshot", zeros)
    return compared.select("snapshot_date", *KEY, *METRICS, "change_status_vs_prior_snapshot")
