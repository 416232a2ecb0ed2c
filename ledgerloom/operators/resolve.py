"""Entity resolution by an ordered identifier cascade.

Observations arrive in order; each takes the id that the latest earlier observation left on its strongest
identifier already seen, or starts a new one, and then leaves its id on all its identifiers. As every
observation overwrites all its identifiers, the id on an identifier is that of the latest earlier
observation carrying it: a ``lag`` per identifier gives each observation's predecessor, and pointer
jumping along predecessors gives the observation that started the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import key_variants, stable_id, strongest_key
from ledgerloom.shared import materialize

ORDER = ("snapshot_date", "source_priority", "source_record_id")
_TIES = ("observation_source", "entity_name", "country_code", "registry_entity_id", "lei", "source_entity_id")


def number_observations(observations: DataFrame) -> DataFrame:
    """Add the identifier variants and a number that names a row; fixed by writing the rows.

    Numbers follow the order of arrival, equal places by content, whatever the partitions of the input.
    """
    ties = [c for c in _TIES if c in observations.columns]
    observations = observations.orderBy(*ORDER, *ties)
    numbered = observations.withColumn(
        "variants", key_variants(F.col("registry_entity_id"), F.col("lei"), F.col("source_entity_id"), F.col("normalized_name"), F.col("country_code"))
    ).withColumn("obs_no", F.monotonically_increasing_id())
    return materialize(numbered, "observations")


def _predecessors(numbered: DataFrame) -> DataFrame:
    """(obs_no, parent, method): the predecessor through the strongest identifier seen before."""
    keys = numbered.select("obs_no", *ORDER, F.explode("variants").alias("v")).select("obs_no", *ORDER, "v.*")
    earlier = Window.partitionBy("key_name", "key_value").orderBy(*ORDER, "obs_no")
    found = keys.withColumn("parent", F.lag("obs_no").over(earlier)).filter(F.col("parent").isNotNull())
    return found.groupBy("obs_no").agg(F.min_by(F.struct("parent", "key_name"), "prio").alias("best")).select(
        "obs_no", F.col("best.parent").alias("parent"), F.col("best.key_name").alias("method")
    )


def resolve(numbered: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``numbered`` with entity_id and entity_resolution_method.

    Each round doubles the distance covered, so chains as long as 2**n observations take n rounds.
    """
    links = materialize(_predecessors(numbered), "predecessors")
    hops = materialize(
        numbered.select("obs_no").join(links, "obs_no", "left").select("obs_no", F.coalesce("parent", "obs_no").alias("root"), F.col("parent").isNull().alias("settled")), "hops"
    )
    # a row is settled once its root is a start; settled rows are only looked up from then on
    settled, going = hops.filter("settled"), hops.filter("not settled")
    for _ in range(most_rounds):
        if not going.limit(1).count():
            break
        ahead = settled.unionByName(going).select(F.col("obs_no").alias("root"), F.col("root").alias("far"), "settled")
        moved = materialize(going.select("obs_no", "root").join(ahead, "root").select("obs_no", F.col("far").alias("root"), "settled"), "hops")
        settled, going = settled.unionByName(moved.filter("settled")), moved.filter("not settled")
    hops = settled.select("obs_no", "root")
    starts = numbered.select(
        F.col("obs_no").alias("root"),
        stable_id("ent", F.element_at("variants", 1)["key_name"], F.element_at("variants", 1)["key_value"]).alias("entity_id"),
    )
    return (
        numbered.join(hops, "obs_no")
        .join(starts, "root")
        .join(links.select("obs_no", "method"), "obs_no", "left")
        .withColumn("entity_resolution_method", F.coalesce("method", F.lit("INITIAL_ASSIGNMENT")))
        .drop("root", "method")
    )


def entity_observations(resolved: DataFrame) -> DataFrame:
    """The observation table with its keys and ids."""
    key = strongest_key(F.col("variants"))
    return resolved.select(
        stable_id("eobs", F.col("snapshot_date"), F.col("observation_source"), F.col("source_record_id")).alias("entity_observation_id"),
        "entity_id",
        key.alias("observation_key"),
        stable_id("obsh", key, F.col("observation_source")).alias("observation_key_hash"),
        "entity_name",
        "normalized_name",
        "country_code",
        "entity_type",
        "registry_entity_id",
        "lei",
        "source_entity_id",
        "observation_source",
        "source_record_id",
        "source_business_key",
        "snapshot_date",
        F.col("snapshot_date").alias("source_version"),
        "entity_resolution_method",
        F.col("source_priority").cast("long").alias("source_priority"),
    )


def entity_master(resolved: DataFrame) -> DataFrame:
    """One row per entity: first attributes, first non-blank identifiers, longest name, span and sources."""
    order = F.struct(*ORDER, "obs_no")
    first_key = F.element_at("variants", 1)["key_name"]
    last = resolved.agg(F.max("snapshot_date").alias("latest"))
    rolled = resolved.groupBy("entity_id").agg(
        # the longest name, the earliest of equally long ones
        F.min_by(F.struct("entity_name", "normalized_name"), F.struct(-F.length("entity_name"), order)).alias("named"),
        F.min_by(F.struct("country_code", "entity_type", first_key.alias("basis")), order).alias("first"),
        F.min_by("registry_entity_id", F.when(F.col("registry_entity_id") != "", order)).alias("registry_entity_id"),
        F.min_by("lei", F.when(F.col("lei") != "", order)).alias("lei"),
        F.array_join(F.array_sort(F.collect_set("observation_source")), "|").alias("source_systems"),
        F.min("snapshot_date").alias("first_seen_snapshot"),
        F.max("snapshot_date").alias("last_seen_snapshot"),
    )
    return rolled.crossJoin(F.broadcast(last)).select(  # one row
        "entity_id",
        "named.entity_name",
        "named.normalized_name",
        "first.country_code",
        "first.entity_type",
        F.coalesce("registry_entity_id", F.lit("")).alias("registry_entity_id"),
        F.coalesce("lei", F.lit("")).alias("lei"),
        "source_systems",
        F.lower("first.basis").alias("match_basis"),
        "first_seen_snapshot",
        "last_seen_snapshot",
        (F.col("last_seen_snapshot") == F.col("latest")).alias("is_current"),
    )


def identifier_index(resolved: DataFrame) -> DataFrame:
    """(key_name, key_value, entity_id) as the last observation left it."""
    keys = resolved.select("entity_id", F.struct(*ORDER, "obs_no").alias("ord"), F.explode("variants").alias("v"))
    return keys.groupBy("v.key_name", "v.key_value").agg(F.max_by("entity_id", "ord").alias("entity_id"))


def lookup(rows: DataFrame, index: DataFrame, key_name: str, value_col: str, out: str, required: bool = True) -> DataFrame:
    """Put in the entity of an identifier; a missing one is an error if required, else blank."""
    of_kind = index.filter(F.col("key_name") == key_name).select(F.col("key_value").alias("found_value"), F.col("entity_id").alias("found_id"))
    joined = rows.join(of_kind, F.col(value_col) == F.col("found_value"), "left")
    value = F.coalesce("found_id", F.lit(""))
    if required:
        value = F.coalesce("found_id", F.raise_error(F.concat(F.lit(f"no entity for {key_name} "), F.coalesce(value_col, F.lit("")))).cast("string"))
    return joined.withColumn(out, value).drop("found_value", "found_id")
