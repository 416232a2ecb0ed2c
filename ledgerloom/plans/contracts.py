"""Output contracts: the columns a table must have, and two validators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": (T.StringType,),
    "number": (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType),
    "integer": (T.LongType, T.IntegerType, T.ShortType),
    "boolean": (T.BooleanType,),
}


# Required columns of every published table and their kinds.
_TABLES = {
    "bronze_source_record": (
        "load_id string, snapshot_date string, source_name string, source_record_id string, source_business_key string, record_type string, entity_name string, "
        "country_code string, raw_payload string"
    ),
    "entity_observations": (
        "entity_observation_id string, entity_id string, observation_key string, observation_key_hash string, entity_name string, normalized_name string, "
        "country_code string, entity_type string, observation_source string, source_record_id string, source_business_key string, snapshot_date string, "
        "source_version string, entity_resolution_method string, source_priority integer"
    ),
    "entity_master": (
        "entity_id string, entity_name string, normalized_name string, country_code string, entity_type string, registry_entity_id string, lei string, "
        "source_systems string, match_basis string, first_seen_snapshot string, last_seen_snapshot string, is_current boolean"
    ),
    "asset_master": (
        "asset_id string, asset_name string, asset_country string, asset_sector string, capacity_mw number, operator_entity_id string, source_systems string, "
        "first_seen_snapshot string, last_seen_snapshot string, is_current boolean"
    ),
    "ownership_observations": (
        "ownership_observation_id string, owner_entity_id string, owner_entity_name string, asset_id string, asset_name string, asset_country string, "
        "asset_sector string, capacity_mw number, ownership_pct number, lifecycle_key string, observation_key string, observation_key_hash string, "
        "observation_source string, source_record_id string, source_business_key string, snapshot_date string, observation_date string, source_version string, "
        "row_hash string"
    ),
    "relationship_edges": (
        "relationship_id string, from_node_type string, from_node_id string, to_node_type string, to_node_id string, relationship_type string, "
        "ownership_pct number, asset_role string, source_name string, snapshot_date string, evidence_key string, change_status string"
    ),
    "entity_master_comprehensive_scd4": (
        "entity_id string, entity_name string, snapshot_date string, snapshot_version string, snapshot_sequence_number integer, is_latest_snapshot boolean, "
        "change_status_backward string, is_dropped boolean"
    ),
    "entity_master_current": (
        "entity_id string, entity_name string, normalized_name string, country_code string, entity_type string, current_observation_source string, "
        "current_snapshot_date string, entity_resolution_method string"
    ),
    "entity_master_event_log": (
        "entity_id string, snapshot_date string, snapshot_sequence_number integer, event_type string"
    ),
    "ownership_comprehensive_scd4": (
        "owner_entity_id string, asset_id string, observation_key string, row_hash string, snapshot_date string, snapshot_version string, "
        "snapshot_sequence_number integer, is_latest_snapshot boolean, change_status_backward string, row_change_status_backward string, is_dropped boolean, "
        "change_status_forward string, row_change_status_forward string"
    ),
    "ownership_lifecycle": (
        "lifecycle_key string, owner_entity_id string, asset_id string, observation_sources string, source_count integer, first_appearance_version string, "
        "first_appearance_sequence integer, last_appearance_version string, last_appearance_sequence integer, total_appearances integer, "
        "total_snapshots_available integer, presence_rate number, consecutive_appearances_current integer, max_consecutive_appearances integer, "
        "gap_periods integer, reliability_score number, lifecycle_status string"
    ),
    "ownership_history_scd2": (
        "ownership_sk string, business_key_hash string, owner_entity_id string, owner_entity_name string, asset_id string, asset_name string, "
        "asset_country string, asset_sector string, capacity_mw number, ownership_pct number, observation_source string, effective_date string, "
        "expiry_date string, is_current_flag string, version_number integer, change_reason string, dw_batch_id string"
    ),
    "owner_infrastructure_exposure_snapshot": (
        "snapshot_date string, owner_entity_id string, asset_country string, asset_sector string, asset_count integer, controlled_asset_count integer, "
        "owned_capacity_mw number, average_ownership_pct number, relationship_count integer, change_status_vs_prior_snapshot string"
    ),
    "asset_lifecycle_predictions": (
        "asset_id string, asset_name string, asset_country string, asset_sector string, capacity_mw number, latitude number, longitude number, "
        "altitude_avg_m number, territorial_type string, economic_level string, gdp_tier integer, solar_irradiance_kwh_m2_yr number, wind_speed_avg_ms number, "
        "regulatory_stability_score number, typical_lifespan_years number, predicted_lifecycle_stage string, lifecycle_stage_confidence number, "
        "estimated_retirement_year integer, estimated_commissioning_year integer, predicted_remaining_years number, predicted_capacity_factor_pct number, "
        "model_version string"
    ),
}
CONTRACTS = {table: dict(column.split(" ") for column in columns.split(", ")) for table, columns in _TABLES.items()}
CONTRACTS["ownership_current"] = CONTRACTS["ownership_history_scd2"]

#: Tables that are published, in order.
PUBLISHED = ("entity_master_current", "ownership_current", "owner_infrastructure_exposure_snapshot")


@dataclass
class Validation:
    table: str
    ok: bool
    problems: list[str]


def validate(df: DataFrame, table: str) -> Validation:
    """Required columns are there with a fitting type; more columns may follow. Reads the schema only."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [f"missing column {c}" for c in CONTRACTS[table] if c not in have]
    problems += [
        f"column {c} is {have[c].simpleString()}, not {kind}" for c, kind in CONTRACTS[table].items() if c in have and not isinstance(have[c], _KINDS[kind])
    ]
    return Validation(table, not problems, problems)


def require(df: DataFrame, table: str) -> DataFrame:
    result = validate(df, table)
    if not result.ok:
        raise ValueError(f"{table}: {'; '.join(result.problems)}")
    return df


def exact(df: DataFrame, table: str) -> DataFrame:
    """The strict form: exactly the contract's columns, in its order."""
    require(df, table)
    extra = sorted(set(df.columns) - set(CONTRACTS[table]))
    if extra:
        raise ValueError(f"{table}: unexpected columns {', '.join(extra)}")
    return df.select(*[F.col(c) for c in CONTRACTS[table]])


def validate_published(tables: dict[str, DataFrame]) -> list[Validation]:
    """All published tables are looked at, whatever the first ones show."""
    out = []
    for name in PUBLISHED:
        out.append(validate(tables[name], name) if name in tables else Validation(name, False, ["missing table"]))
    return out
