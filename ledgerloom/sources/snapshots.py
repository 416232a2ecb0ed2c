"""CSV snapshots: a directory per family, a file per date, all columns strings, blanks ``""``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYS = ("source_record_id", "source_business_key", "record_type", "entity_name", "country_code")
# The columns of each family's files.
FAMILIES = {
    "registry_entities": (*_KEYS, "registry_entity_id", "lei", "entity_type"),
    "entity_hierarchy": (*_KEYS, *[f"{side}_{c}" for side in ("parent", "child") for c in ("name", "country_code", "registry_entity_id", "lei", "source_entity_id")]),
    "infrastructure_assets": (
        *_KEYS, "asset_source_id", "asset_name", "asset_country", "asset_sector", "capacity_mw", "owner_name", "owner_country_code", "owner_source_entity_id",
        "owner_lei", "operator_name", "operator_country_code", "operator_source_entity_id", "operator_lei", "ownership_pct",
    ),
}


def read_family(spark: SparkSession, root: str, family: str) -> DataFrame:
    """All snapshots of a family, the date taken from the file's name; the schema is fixed, so nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FAMILIES[family]])
    reader = spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", "*.csv").schema(schema)
    rows = reader.csv(f"{root}/{family}").select("*", F.regexp_extract("_metadata.file_name", r"([^/]+)\.csv$", 1).alias("snapshot_date"))
    return rows.na.fill("")


def _listed(spark: SparkSession, folder: str):
    """What a folder holds, in order of name, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path), key=lambda s: s.getPath().getName())


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a file's first line, as Spark's reader sees them."""
    return tuple(spark.read.option("header", True).csv(path).columns)


def read_any_snapshots(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every family below ``root`` with every column its files have, all strings, blanks ``""``.

    Files of one family may differ in columns: those of equal header are read together, and the groups are united
    by name. The driver reads one line of each file.
    """
    families = {}
    for folder in _listed(spark, root):
        if not folder.isDirectory():
            continue
        by_header: dict[tuple[str, ...], list[str]] = {}
        for file in _listed(spark, folder.getPath().toString()):
            if file.isFile() and file.getPath().getName().endswith(".csv"):
                by_header.setdefault(_header(spark, file.getPath().toString()), []).append(file.getPath().toString())
        rows = None
        for names, paths in by_header.items():
            schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
            part = spark.read.option("header", True).schema(schema).csv(paths)
            part = part.select("*", F.regexp_extract("_metadata.file_name", r"([^/]+)\.csv$", 1).alias("snapshot_date"))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is not None:
            families[folder.getPath().getName()] = rows.na.fill("")
    return families


def read_snapshots(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {family: read_family(spark, root, family) for family in FAMILIES}


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference dimension with its declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


# The schemas of the reference dimensions.
COUNTRY_SCHEMA = (
    "country_code string, country_name string, latitude_centroid double, longitude_centroid double, altitude_avg_m long, territorial_type string, "
    "economic_level string, gdp_tier long, solar_irradiance_kwh_m2_yr long, wind_speed_avg_ms double, regulatory_stability_score long"
)
SECTOR_SCHEMA = (
    "sector string, typical_lifespan_years long, min_lifespan_years long, max_lifespan_years long, construction_years long, decommissioning_years long, "
    "base_capacity_factor double, irradiance_sensitivity double, wind_sensitivity double, altitude_sensitivity double, economic_level_bonus_high double, "
    "economic_level_bonus_upper_middle double, economic_level_bonus_lower_middle double, economic_level_bonus_low double, training_weight double"
)
