"""From source rows to observations, assets, ownership and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import blank_if_falsy, encode_by_map, normalize_name, stable_id
from ledgerloom.operators.resolve import lookup

# Precedence of the sources.
SOURCE_PRIORITY = {"registry_entities": 1, "entity_hierarchy": 2, "infrastructure_assets": 3}
UNKNOWN_PRIORITY = 99
_IDENTITY = ("entity_name", "country_code", "registry_entity_id", "lei", "source_entity_id")


def unpivot_roles(rows: DataFrame, source: str, roles: dict[str, dict[str, Column | str]]) -> DataFrame:
    """One observation for each row and role; a role maps identity columns to expressions, blank where left out."""
    blank = F.lit("")
    shaped = []
    for role, parts in roles.items():
        record = F.concat_ws("|", "source_record_id", F.lit(role)) if role else F.col("source_record_id")
        shaped.append(
            F.struct(
                record.alias("source_record_id"),
                *[F.coalesce(_column(parts.get(c, blank)), blank).alias(c) for c in _IDENTITY],
                _column(parts["entity_type"]).alias("entity_type"),
            )
        )
    return rows.select("snapshot_date", "source_business_key", F.explode(F.array(*shaped)).alias("o")).select(
        F.lit(source).alias("observation_source"), "snapshot_date", "source_business_key", "o.*"
    )


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def observations_of(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources' observations in one shape, with normalised names and the source's precedence."""
    identity = {c: c for c in ("entity_name", "country_code", "registry_entity_id", "lei", "entity_type")}
    owner = {"entity_name": "owner_name", "country_code": "owner_country_code", "lei": "owner_lei", "source_entity_id": "owner_source_entity_id", "entity_type": F.lit("company")}
    operator = {k: (v.replace("owner", "operator") if isinstance(v, str) else F.lit("operator")) for k, v in owner.items()}

    def kin(side: str) -> dict[str, Column | str]:
        return {c: f"{side}_{c}" for c in _IDENTITY if c != "entity_name"} | {"entity_name": f"{side}_name", "entity_type": F.lit("company")}

    parts = [
        unpivot_roles(frames["registry_entities"], "registry_entities", {"": identity}),
        unpivot_roles(frames["infrastructure_assets"], "infrastructure_assets", {"owner": owner, "operator": operator}),
        unpivot_roles(frames["entity_hierarchy"], "entity_hierarchy", {"parent": kin("parent"), "child": kin("child")}),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("normalized_name", normalize_name(F.col("entity_name"))).withColumn(
        "source_priority", encode_by_map(F.col("observation_source"), SOURCE_PRIORITY, UNKNOWN_PRIORITY)
    )


def asset_master(assets: DataFrame, index: DataFrame) -> DataFrame:
    """One row per asset: attributes of its first row, its span, and whether the latest snapshot has it."""
    latest = assets.agg(F.max("snapshot_date").alias("latest"))
    rolled = assets.groupBy("asset_source_id").agg(
        F.min_by(
            F.struct("asset_name", "asset_country", "asset_sector", F.col("capacity_mw").cast("double").alias("capacity_mw"), "operator_source_entity_id"),
            F.struct("snapshot_date", "source_record_id"),
        ).alias("first"),
        F.min("snapshot_date").alias("first_seen_snapshot"),
        F.max("snapshot_date").alias("last_seen_snapshot"),
    )
    flat = rolled.select("asset_source_id", "first.*", "first_seen_snapshot", "last_seen_snapshot").crossJoin(F.broadcast(latest))  # one row
    named = lookup(flat, index, "SOURCE_ENTITY_ID", "operator_source_entity_id", "operator_entity_id", required=False)
    return named.select(
        stable_id("ast", F.col("asset_source_id")).alias("asset_id"),
        "asset_name",
        "asset_country",
        "asset_sector",
        "capacity_mw",
        "operator_entity_id",
        F.lit("infrastructure_assets").alias("source_systems"),
        "first_seen_snapshot",
        "last_seen_snapshot",
        (F.col("last_seen_snapshot") == F.col("latest")).alias("is_current"),
    )


def ownership_observations(assets: DataFrame, index: DataFrame) -> DataFrame:
    """One row per source row, with the keys and the hash that decide about change."""
    named = lookup(assets, index, "SOURCE_ENTITY_ID", "owner_source_entity_id", "owner_entity_id")
    pct = F.bround(F.col("ownership_pct").cast("double"), 2)
    asset = stable_id("ast", F.col("asset_source_id"))
    keyed = named.withColumn("pct", pct).withColumn("asset_id", asset).withColumn("lifecycle_key", F.concat_ws("|", "owner_entity_id", "asset_id"))
    key = F.concat_ws("|", "lifecycle_key", F.lit("infrastructure_assets"))
    return keyed.select(
        stable_id("oobs", F.col("snapshot_date"), F.col("source_record_id")).alias("ownership_observation_id"),
        "owner_entity_id",
        F.col("owner_name").alias("owner_entity_name"),
        "asset_id",
        "asset_name",
        "asset_country",
        "asset_sector",
        F.col("capacity_mw").cast("double").alias("capacity_mw"),
        F.col("pct").alias("ownership_pct"),
        "lifecycle_key",
        key.alias("observation_key"),
        stable_id("ohsh", key).alias("observation_key_hash"),
        F.lit("infrastructure_assets").alias("observation_source"),
        "source_record_id",
        "source_business_key",
        "snapshot_date",
        F.col("snapshot_date").alias("observation_date"),
        F.col("snapshot_date").alias("source_version"),
        stable_id("orow", *[F.col(c) for c in ("owner_entity_id", "asset_id", "asset_name", "asset_country", "asset_sector")], blank_if_falsy(F.col("pct"))).alias("row_hash"),
    )


def _edge(rows: DataFrame, start: str, end: str, end_type: str, kind: str, pct: Column, role: str, source: str, evidence: Column) -> DataFrame:
    return rows.select(
        stable_id("rel", F.col("snapshot_date"), F.col(start), F.col(end), F.lit(kind)).alias("relationship_id"),
        F.lit("entity").alias("from_node_type"),
        F.col(start).alias("from_node_id"),
        F.lit(end_type).alias("to_node_type"),
        F.col(end).alias("to_node_id"),
        F.lit(kind).alias("relationship_type"),
        pct.alias("ownership_pct"),
        F.lit(role).alias("asset_role"),
        F.lit(source).alias("source_name"),
        "snapshot_date",
        evidence.alias("evidence_key"),
    )


def first_seen(edges: DataFrame) -> DataFrame:
    """Mark the first edge of each signature NEW, all later ones UNCHANGED."""
    order = Window.partitionBy("from_node_id", "to_node_id", "relationship_type", "ownership_pct").orderBy("snapshot_date", "relationship_type", "relationship_id")
    return edges.withColumn("change_status", F.when(F.row_number().over(order) == 1, "NEW").otherwise("UNCHANGED"))


def relationship_edges(assets: DataFrame, hierarchy: DataFrame, index: DataFrame) -> DataFrame:
    """Owners, operators (once per snapshot, operator and asset) and parents as edges."""
    both = lookup(assets, index, "SOURCE_ENTITY_ID", "owner_source_entity_id", "owner_id")
    both = lookup(both, index, "SOURCE_ENTITY_ID", "operator_source_entity_id", "operator_id").withColumn("asset_id", stable_id("ast", F.col("asset_source_id")))
    kin = lookup(hierarchy, index, "REGISTRY_ENTITY_ID", "parent_registry_entity_id", "parent_id")
    kin = lookup(kin, index, "REGISTRY_ENTITY_ID", "child_registry_entity_id", "child_id")
    operated = both.select("snapshot_date", "operator_id", "asset_id").distinct()
    evidence = stable_id("evidence", F.col("snapshot_date"), F.col("operator_id"), F.col("asset_id"))
    whole = F.lit(100.0)
    owns = _edge(both, "owner_id", "asset_id", "asset", "OWNS_ASSET", F.bround(F.col("ownership_pct").cast("double"), 2), "owner", "infrastructure_assets", F.col("source_business_key"))
    operates = _edge(operated, "operator_id", "asset_id", "asset", "OPERATES_ASSET", whole, "operator", "infrastructure_assets", evidence)
    parents = _edge(kin, "parent_id", "child_id", "entity", "PARENT_OF_ENTITY", whole, "parent", "entity_hierarchy", F.col("source_business_key"))
    return first_seen(owns.unionByName(operates).unionByName(parents))
