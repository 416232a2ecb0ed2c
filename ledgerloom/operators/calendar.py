"""The snapshot calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import snapshot_label


def snapshot_calendar(observations: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """(snapshot_date, seq, snapshot_version, is_latest, last_seq), one row per distinct date.

    The window without a key runs over the distinct dates only.
    """
    dates = observations.select(F.col(date_col).alias("snapshot_date")).distinct()
    every = Window.orderBy("snapshot_date")
    numbered = dates.withColumn("seq", F.row_number().over(every).cast("long"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return numbered.withColumn("last_seq", F.max("seq").over(whole)).select(
        "snapshot_date",
        "seq",
        snapshot_label(F.col("seq")).alias("snapshot_version"),
        (F.col("seq") == F.col("last_seq")).alias("is_latest"),
        "last_seq",
    )
