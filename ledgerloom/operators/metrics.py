"""Evaluation metrics and the cost model."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n) for every pair that occurs."""
    return scored.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class; where a class is never predicted or never present the measure is 0."""
    cells = confusion(scored, label, predicted)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
    )).alias("s")).select("s.*")
    summed = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    both = F.col("called") + F.col("support")
    return summed.select("class", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0), 6).alias("f1"))


def accuracy(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    right = F.sum((F.col(label) == F.col(predicted)).cast("long"))
    return scored.agg(F.count("*").alias("n"), F.round(right / F.count("*"), 6).alias("accuracy"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """``is_test`` for the first share of each class in an order by hash: exact counts, the same in every run.

    The first digits of the hash deal a class into buckets in that same order; bucket counts give each bucket's
    offset, so rows are only ordered within a bucket and no class meets in one task.
    """
    hashed = rows.withColumn("split_hash", F.sha1(F.col(key).cast("string"))).withColumn("split_bucket", F.substring("split_hash", 1, 3))
    sizes = hashed.groupBy(label, "split_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(label).orderBy("split_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(label).alias("split_label"),
        F.col("split_bucket").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
        F.ceil(F.sum("n").over(Window.partitionBy(label)) * share).alias("wanted"),
    )
    order = Window.partitionBy(label, "split_bucket").orderBy("split_hash", key)
    placed = hashed.withColumn("split_place", F.row_number().over(order))
    joined = placed.join(offsets, placed[label].eqNullSafe(F.col("split_label")) & (F.col("split_bucket") == F.col("b")))
    return joined.withColumn("is_test", F.col("split_place") + F.col("ahead") <= F.col("wanted")).select(*rows.columns, "is_test")


# Default rates in USD per hour and samples that share a training.
DEFAULT_RATES = {"BENCHMARK_SKLEARN_USD_PER_HOUR": 0.20, "BENCHMARK_LORA_TRAIN_USD_PER_HOUR": 1.00, "BENCHMARK_LORA_INFER_USD_PER_HOUR": 1.00}
DEFAULT_AMORTIZATION = ("BENCHMARK_LORA_AMORTIZATION_SAMPLES", 10_000)


def load_rates(env: Mapping[str, str] | None = None) -> dict[str, float]:
    """Rates from the environment; anything not a positive finite number is an error."""
    env = os.environ if env is None else env
    out: dict[str, float] = {}
    for name, default in [*DEFAULT_RATES.items(), DEFAULT_AMORTIZATION]:
        raw = env.get(name, str(default))
        value = int(raw) if name == DEFAULT_AMORTIZATION[0] else float(raw)
        if not 0 < value < float("inf"):
            raise ValueError(f"{name} must be a positive number, not {raw!r}")
        out[name] = value
    return out


def cost_proxy(seconds: float) -> float:
    """Compute seconds as the report gives them."""
    return round(seconds, 4)


def estimated_cost(seconds: float, usd_per_hour: float) -> float:
    return round(seconds / 3600 * usd_per_hour, 8)


def cost_per_sample(cost: float, samples: int) -> float | None:
    return round(cost / samples, 10) if samples > 0 else None


def amortized_cost(training: float, per_sample: float | None, samples: int) -> float:
    if samples <= 0:
        raise ValueError("samples must be positive")
    return training / samples + (per_sample or 0.0)
