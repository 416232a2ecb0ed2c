"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is in the fold that no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def one_label(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """One row (label_id, label) for each id; conflicting labels of an id go by majority, ties to the larger."""
    return (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def bounded_rows(rows: DataFrame, key: str, bound: int) -> list:
    """At most ``bound`` rows at the driver, chosen by a hash of ``key`` (one row of each): same rows in every run.

    The rows are counted first and only those under the matching share of the hash's range are sent, so what
    reaches the driver is about ``bound`` rows however many tasks there are.
    """
    total = rows.count()
    wide = 1 << 31
    order = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(wide))
    if total > bound:
        rows = rows.filter(order < int(min(1.0, 1.1 * bound / total) * wide))
    found = rows.withColumn("sample_order", order).collect()
    found.sort(key=lambda r: (r["sample_order"], str(r[key])))
    return found[:bound]
