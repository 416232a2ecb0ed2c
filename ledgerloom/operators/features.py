"""Asset features: geography, sector and ownership signals joined on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import encode_by_map

# Codes of territorial types, and what an unknown country or asset gets.
TERRITORIAL = {"island": 1, "coastal": 2, "mixed": 3, "inland": 4}
TERRITORIAL_DEFAULT = 3
UNKNOWN_COUNTRY = {"territorial_type": "mixed", "economic_level": "upper_middle"}
NO_HISTORY = {"total_appearances": 1, "presence_rate": 1.0, "reliability_score": 0.5, "consecutive_appearances_current": 1}
# The model's features, in order.
FEATURES = (
    "capacity_mw", "sector_encoded", "latitude", "longitude", "altitude_avg_m", "territorial_type_encoded", "gdp_tier",
    "solar_irradiance_kwh_m2_yr", "wind_speed_avg_ms", "regulatory_stability_score", "total_appearances", "presence_rate",
    "reliability_score", "typical_lifespan_years",
)
_GEO = {"latitude": "latitude_centroid", "longitude": "longitude_centroid"} | {
    c: c for c in ("altitude_avg_m", "gdp_tier", "solar_irradiance_kwh_m2_yr", "wind_speed_avg_ms", "regulatory_stability_score")
}


def medians(countries: DataFrame) -> DataFrame:
    """One row: the median of every numeric column, the tier cut to a whole number."""
    cells = [F.median(F.col(source).cast("double")).alias(f"median_{name}") for name, source in _GEO.items()]
    return countries.agg(*cells).withColumn("median_gdp_tier", F.col("median_gdp_tier").cast("int"))


def sector_codes(sectors: DataFrame) -> DataFrame:
    """Sectors with their rank in the alphabet, from 1."""
    return sectors.withColumn("sector_encoded", F.dense_rank().over(Window.orderBy("sector")).cast("long"))


def best_lifecycle(lifecycle: DataFrame) -> DataFrame:
    """Per asset the signals of its most reliable owner; ties go to the first lifecycle key."""
    rank = F.struct(-F.col("reliability_score"), "lifecycle_key")
    return lifecycle.groupBy("asset_id").agg(F.min_by(F.struct(*NO_HISTORY), rank).alias("signal")).select(F.col("asset_id").alias("signal_asset"), "signal.*")


def enrich(assets: DataFrame, lifecycle: DataFrame, countries: DataFrame, sectors: DataFrame) -> DataFrame:
    """Assets with all features; an unknown country gets medians, an unknown sector is an error."""
    coded = sector_codes(sectors).select(F.col("sector").alias("dim_sector"), "sector_encoded", F.col("typical_lifespan_years").cast("double").alias("typical_lifespan_years"))
    geo = countries.select(F.col("country_code").alias("dim_country"), "territorial_type", "economic_level", *[F.col(s).cast("double").alias(n) for n, s in _GEO.items()])
    joined = (
        assets.join(geo, F.col("asset_country") == F.col("dim_country"), "left")
        .join(coded, F.col("asset_sector") == F.col("dim_sector"), "left")
        .join(best_lifecycle(lifecycle), F.col("asset_id") == F.col("signal_asset"), "left")
        .crossJoin(F.broadcast(medians(countries)))  # one row
    )
    problem = F.concat(F.lit("Unsupported asset sector '"), F.coalesce("asset_sector", F.lit("")), F.lit("'"))
    filled: dict[str, Column] = {n: F.coalesce(F.col(n), F.col(f"median_{n}").cast("double")) for n in _GEO}
    filled |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in {**UNKNOWN_COUNTRY, **NO_HISTORY}.items()}
    filled["gdp_tier"] = filled["gdp_tier"].cast("long")
    filled["sector_encoded"] = F.coalesce("sector_encoded", F.raise_error(problem).cast("long"))
    out = joined.withColumns(filled).withColumn("territorial_type_encoded", encode_by_map(F.col("territorial_type"), TERRITORIAL, TERRITORIAL_DEFAULT))
    return out.select(
        "asset_id", "asset_name", "asset_country", "asset_sector", "territorial_type", "economic_level", *[F.col(c) for c in FEATURES]
    )


def prompt(features: tuple[str, ...] = FEATURES) -> Column:
    """The features of a row as an instruction for a text model."""
    # The wording of the instruction.
    head = (
        "Classify the lifecycle stage of the following energy infrastructure asset.\n"
        "Respond with exactly one of: planning, construction, operating, decommissioning, retired.\n\nAsset features:"
    )
    lines = [F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in features]
    return F.concat_ws("\n", F.lit(head), *lines, F.lit(""), F.lit("Lifecycle stage:"))


def instructions(training: DataFrame) -> DataFrame:
    """(prompt, completion) pairs, ready for ``write.json``."""
    return training.select(prompt().alias("prompt"), F.col("lifecycle_stage").alias("completion"))
