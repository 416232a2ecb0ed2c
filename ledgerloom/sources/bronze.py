"""Bronze envelopes: five typed fields, a load id, and the rest of a row as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import stable_id

TYPED = ("source_record_id", "source_business_key", "record_type", "entity_name", "country_code")


def _json_string(value: Column) -> Column:
    """A JSON string in ASCII: control characters and all above ASCII escaped, in UTF-16 units."""
    quoted = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    inner = F.regexp_replace(F.substring(quoted, 6, 1 << 30), r"\}$", "")
    units = F.transform(
        F.split(inner, ""),
        lambda c: F.when(F.octet_length(c) < 2, c).otherwise(
            F.concat(F.lit("\\u"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), r"(.{4})(?=.)", "$1\\\\u"))
        ),
    )
    return F.when(F.octet_length(inner) == F.length(inner), inner).otherwise(F.array_join(units, ""))  # ASCII as it is


def payload(columns: Sequence[str]) -> Column:
    """The columns as one JSON object with sorted keys, ``", "`` and ``": "`` between."""
    parts = []
    for i, name in enumerate(sorted(columns)):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{name}": '), _json_string(F.col(name))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def bronze_records(rows: DataFrame, source: str) -> DataFrame:
    """One envelope per source row; typed fields that a source lacks are blank."""
    rest = [c for c in rows.columns if c not in TYPED and c != "snapshot_date"]
    typed = [(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in TYPED]
    record = F.col("source_record_id") if "source_record_id" in rows.columns else F.lit("")
    return rows.select(
        stable_id("load", F.lit(source), F.col("snapshot_date"), record).alias("load_id"),
        "snapshot_date",
        F.lit(source).alias("source_name"),
        *typed,
        payload(rest).alias("raw_payload"),
    )


def write_bronze(records: DataFrame, path: str) -> None:
    """Parquet partitioned by source and snapshot date."""
    copies = records.withColumns({"source": F.col("source_name"), "snapshot": F.col("snapshot_date")})
    copies.withColumnRenamed("snapshot_date", "observed_date").withColumnRenamed("snapshot", "snapshot_date").write.mode("overwrite").partitionBy("source", "snapshot_date").parquet(path)
