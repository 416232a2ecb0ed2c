"""Histories of keyed observations over a calendar of snapshots.

All operators window by the observation's key. A calendar has one row per snapshot date, so joins with
it are left to the optimizer, which broadcasts it by its measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import stable_id


def last_of_snapshot(observations: DataFrame, key: Sequence[str], order: Sequence[str], seq: str = "snapshot_date") -> DataFrame:
    """One row per key and snapshot: the one that comes last in ``order``."""
    place = Window.partitionBy(*key, seq).orderBy(*[F.col(c).desc() for c in order])
    return observations.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def with_calendar(observations: DataFrame, calendar: DataFrame) -> DataFrame:
    return observations.join(calendar, "snapshot_date")


def snapshot_diff(rows: DataFrame, calendar: DataFrame, key: Sequence[str], compare: Sequence[str], status: str, drop_values: dict[str, Column] | None = None) -> DataFrame:
    """Compare each key with the snapshot just before, and add one DROPPED row where a key goes missing.

    ``rows`` has one row per key and snapshot and the calendar's columns. A key that was absent from the
    snapshot before is NEW, with equal ``compare`` columns UNCHANGED, else CHANGED. The dropped row
    copies the last one at the next snapshot's date, with ``drop_values`` put in; it comes once per gap.
    """
    own = Window.partitionBy(*key).orderBy("seq")
    before, after = F.lag("seq").over(own), F.lead("seq").over(own)
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(own))
    marked = rows.withColumns(
        {
            status: F.when(before.isNull() | (before < F.col("seq") - 1), "NEW").when(same, "UNCHANGED").otherwise("CHANGED"),
            "goes_missing": (F.col("seq") < F.col("last_seq")) & (after.isNull() | (after > F.col("seq") + 1)),
        }
    )
    # one pass: a row whose key goes missing becomes two, and the calendar gives both their dates
    turns = F.when(F.col("goes_missing"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = (
        marked.drop(*[c for c in calendar.columns if c != "seq"])
        .withColumn("is_dropped", F.explode(turns))
        .withColumn("seq", F.col("seq") + F.col("is_dropped").cast("long"))
        .withColumn(status, F.when(F.col("is_dropped"), "DROPPED").otherwise(F.col(status)))
        .join(calendar, "seq")
    )
    for name, value in (drop_values or {}).items():
        both = both.withColumn(name, F.when(F.col("is_dropped"), value).otherwise(F.col(name)))
    return both.select(*rows.columns, status, "is_dropped")


def forward_status(rows: DataFrame, key: Sequence[str], hash_col: str, status: str) -> DataFrame:
    """What comes next for each row, dropped rows among them: CURRENT, CHANGED, DROPPED or ABSENCE."""
    own = Window.partitionBy(*key).orderBy("seq")
    next_dropped, next_hash = F.lead("is_dropped").over(own), F.lead(hash_col).over(own)
    return rows.withColumn(
        status,
        F.when(F.lead("seq").over(own).isNull(), F.when(F.col("is_dropped"), "ABSENCE").otherwise("CURRENT"))
        .when(next_dropped, "DROPPED")
        .when(F.col(hash_col) != next_hash, "CHANGED")
        .otherwise("CURRENT"),
    )


def event_log(scd4: DataFrame, entity: str = "entity_id", status: str = "change_status_backward") -> DataFrame:
    """One event per entity and snapshot: an active CHANGED before NEW before UNCHANGED; DROPPED if none is active."""
    active = ~F.col("is_dropped")
    return (
        scd4.groupBy(entity, "snapshot_date", "seq")
        .agg(
            F.bool_or(active & (F.col(status) == "CHANGED")).alias("changed"),
            F.bool_or(active & (F.col(status) == "NEW")).alias("new"),
            F.bool_or(active).alias("active"),
        )
        .select(
            entity,
            "snapshot_date",
            F.col("seq").alias("snapshot_sequence_number"),
            F.when(F.col("changed"), "CHANGED").when(F.col("new"), "NEW").when(F.col("active"), "UNCHANGED").otherwise("DROPPED").alias("event_type"),
        )
    )


def current_rows(scd4: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The first row of each entity, in ``order``, in the latest snapshot."""
    place = Window.partitionBy(entity).orderBy(*order)
    live = scd4.filter(F.col("is_latest") & ~F.col("is_dropped"))
    return live.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def lifecycle(scd4: DataFrame, key: Sequence[str], source: str | None = None) -> DataFrame:
    """Presence, gaps, runs, reliability and status of each key over its active snapshots.

    A run is an island of consecutive numbers. Reliability uses the presence before rounding.
    """
    active = scd4.filter(~F.col("is_dropped")).select(*key, "seq", "snapshot_version", "last_seq").distinct()
    own = Window.partitionBy(*key).orderBy("seq")
    islands = active.withColumn("island", F.col("seq") - F.row_number().over(own))
    runs = islands.groupBy(*key, "island").agg(
        F.count("*").alias("run"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.min("snapshot_version").alias("first_version"),
        F.max("snapshot_version").alias("last_version"),
        F.max("last_seq").alias("last_seq"),
    )
    per_key = runs.groupBy(*key).agg(
        F.min("first").alias("first_appearance_sequence"),
        F.max("last").alias("last_appearance_sequence"),
        F.min("first_version").alias("first_appearance_version"),
        F.max("last_version").alias("last_appearance_version"),
        F.sum("run").alias("total_appearances"),
        F.max("run").alias("max_consecutive_appearances"),
        F.max_by("run", "last").alias("last_run"),
        F.max("last_seq").alias("last_seq"),
    )
    first, last, seen = F.col("first_appearance_sequence"), F.col("last_appearance_sequence"), F.col("total_appearances")
    span = last - first + 1
    live = last == F.col("last_seq")
    presence = seen / span
    gaps = span - seen
    score = presence * F.when(live, 1.0).otherwise(0.8) * F.greatest(F.lit(0.0), 1.0 - 0.1 * gaps)
    out = per_key.select(
        *key,
        "first_appearance_version",
        "first_appearance_sequence",
        "last_appearance_version",
        "last_appearance_sequence",
        "total_appearances",
        span.alias("total_snapshots_available"),
        F.round(presence, 3).alias("presence_rate"),
        F.when(live, F.col("last_run")).otherwise(0).cast("long").alias("consecutive_appearances_current"),
        "max_consecutive_appearances",
        gaps.alias("gap_periods"),
        F.round(score, 3).alias("reliability_score"),
        F.when(live & (seen == 1), "NEW").when(live & (gaps == 0), "ACTIVE").when(live, "INTERMITTENT").otherwise("DROPPED").alias("lifecycle_status"),
    )
    if source is None:
        return out
    sources = scd4.groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("s"))
    return out.join(sources, list(key)).withColumn("observation_sources", F.array_join("s", ",")).withColumn("source_count", F.size("s").cast("long")).drop("s")


def scd2(rows: DataFrame, calendar: DataFrame, key: str, payload: Sequence[str], sk_prefix: str = "osk") -> DataFrame:
    """Versions of each key: a new one where the key comes back after a gap or its payload changes.

    A version stays open across a gap until the next one begins; the last one of a key that never comes back
    expires at the first snapshot that lacks it. Attributes are those of the version's first row.
    """
    own = Window.partitionBy(key).orderBy("seq")
    before = F.lag("seq").over(own)
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(own))
    gap = before.isNotNull() & (F.col("seq") - before > 1)
    marked = rows.withColumns(
        {
            "change_reason": F.when(before.isNull(), "NEW").when(gap, "REOPENED").when(differs, "CHANGED"),
            "key_last_seq": F.max("seq").over(Window.partitionBy(key)),
        }
    )
    breaks = marked.filter(F.col("change_reason").isNotNull())
    numbered = breaks.withColumn("version_number", F.row_number().over(own).cast("long")).withColumn("next_date", F.lead("snapshot_date").over(own))
    after = calendar.select((F.col("seq") - 1).alias("key_last_seq"), F.col("snapshot_date").alias("gone_date"))
    dated = numbered.join(after, "key_last_seq", "left")
    return (
        dated.withColumn("effective_date", F.col("snapshot_date"))
        .withColumn("expiry_date", F.coalesce("next_date", "gone_date", F.lit("")))
        .withColumn("is_current_flag", F.when(F.col("expiry_date") == "", "Y").otherwise("N"))
        .withColumn("ownership_sk", stable_id(sk_prefix, F.col(key), F.col("version_number")))
        .withColumn("dw_batch_id", F.col("snapshot_version"))
        .drop("next_date", "gone_date", "key_last_seq")
    )


def as_of(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every version that is in effect at each snapshot date.

    Dates become snapshot numbers and each version is exploded over the snapshots it spans, so the
    range join is an explode and no pair outside a range is formed.
    """
    begin = calendar.select(F.col("snapshot_date").alias("effective_date"), F.col("seq").alias("from_seq"), F.col("last_seq").alias("to_last"))
    end = calendar.select(F.col("snapshot_date").alias("expiry_date"), (F.col("seq") - 1).alias("until"))
    spans = history.drop("seq", "snapshot_date", "snapshot_version", "is_latest", "last_seq").join(begin, "effective_date").join(end, "expiry_date", "left")
    until = F.coalesce("until", "to_last")
    steps = F.when(until >= F.col("from_seq"), F.sequence("from_seq", until)).otherwise(F.array().cast("array<bigint>"))
    return spans.withColumn("seq", F.explode(steps)).drop("from_seq", "to_last", "until").join(calendar, "seq")
