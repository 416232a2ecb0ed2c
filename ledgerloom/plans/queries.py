"""Every operator as a query over the star-schema tables, with equivalent SQL.

Suppliers stand for owners, brands for assets, quarters of shipping for snapshots; customers' yearly orders
stand for entity observations with identifiers that collide on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import encode_by_map, key_variants, normalize_name, observation_key, stable_id, strongest_key
from ledgerloom.operators import entity_index, features, history, mart, metrics, ml, quality, resolve, search, silver
from ledgerloom.operators.calendar import snapshot_calendar
from ledgerloom.shared import materialize
from ledgerloom.sources.bronze import bronze_records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SEARCH = "the that with onand thtion"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Ownership ------------------------------------------------------------------------------------------------------

def ownership_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per quarter, supplier and brand: what an owner holds of an asset."""
    quarter = F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyy-MM-dd")
    lines = table(spark, sf_dir, "lineitem").select(quarter.alias("snapshot_date"), "l_suppkey", "l_partkey", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    owners = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    cells = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("snapshot_date", "l_suppkey", "p_brand")
        .agg(F.max("p_size").cast("double").alias("capacity_mw"), F.round(F.max("l_discount") * 1000).cast("long").alias("pct"))
        .join(owners, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    owner = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    sector = F.concat(F.lit("S"), (F.regexp_extract("p_brand", r"([0-9]+)$", 1).cast("int") % 5).cast("string"))
    shaped = cells.select(
        "snapshot_date", owner.alias("owner_entity_id"), F.col("p_brand").alias("asset_id"), F.col("n_name").alias("asset_country"), sector.alias("asset_sector"),
        "capacity_mw", "pct", F.col("pct").cast("double").alias("ownership_pct"),
    )
    return shaped.withColumns(
        {
            "observation_key": observation_key(F.col("owner_entity_id"), F.col("asset_id")),
            "row_hash": stable_id("orow", *[F.col(c) for c in ("owner_entity_id", "asset_id", "asset_country", "asset_sector", "pct")]),
        }
    )


def cells_and_calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells, with the calendar's columns, and the calendar; both written once, so lineitem is read once."""
    cells = materialize(ownership_cells(spark, sf_dir), "cells")
    calendar = materialize(snapshot_calendar(cells), "calendar")
    return history.with_calendar(cells, calendar), calendar


CELLS = """
cells AS (
  SELECT strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') AS snapshot_date, 's' || l_suppkey AS owner_entity_id, p_brand AS asset_id,
         n_name AS asset_country, 'S' || (CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 5) AS asset_sector,
         CAST(max(p_size) AS DOUBLE) AS capacity_mw, CAST(round(max(l_discount) * 1000) AS BIGINT) AS pct
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4, 5),
cal AS (
  SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS seq, count(*) OVER () AS last_seq FROM (SELECT DISTINCT snapshot_date FROM cells)),
obs AS (
  SELECT cells.*, seq, last_seq, owner_entity_id || '|' || asset_id AS observation_key,
         'orow_' || substr(sha1(owner_entity_id || '||' || asset_id || '||' || asset_country || '||' || asset_sector || '||' || pct), 1, 12) AS row_hash
  FROM cells JOIN cal USING (snapshot_date))"""

DIFF = CELLS + """,
marked AS (
  SELECT obs.*, lag(seq) OVER w AS before, lag(row_hash) OVER w AS before_hash, lead(seq) OVER w AS next_seq FROM obs WINDOW w AS (PARTITION BY observation_key ORDER BY seq)),
scd4 AS (
  SELECT observation_key, owner_entity_id, asset_id, seq, snapshot_date, row_hash,
         CASE WHEN before IS NULL OR before < seq - 1 THEN 'NEW' WHEN before_hash = row_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status_backward, FALSE AS is_dropped, last_seq
  FROM marked
  UNION ALL
  SELECT observation_key, owner_entity_id, asset_id, m.seq + 1, cal.snapshot_date, row_hash, 'DROPPED', TRUE, m.last_seq
  FROM marked m JOIN cal ON cal.seq = m.seq + 1 WHERE m.seq < m.last_seq AND (next_seq IS NULL OR next_seq > m.seq + 1))"""

SCD2 = CELLS + """,
steps AS (
  SELECT obs.*, lag(seq) OVER w AS before, lag(row_hash) OVER w AS before_hash, max(seq) OVER (PARTITION BY observation_key) AS key_last
  FROM obs WINDOW w AS (PARTITION BY observation_key ORDER BY seq)),
breaks AS (
  SELECT *, CASE WHEN before IS NULL THEN 'NEW' WHEN seq - before > 1 THEN 'REOPENED' ELSE 'CHANGED' END AS change_reason
  FROM steps WHERE before IS NULL OR seq - before > 1 OR row_hash <> before_hash),
numbered AS (
  SELECT *, row_number() OVER w AS version_number, lead(snapshot_date) OVER w AS next_date FROM breaks WINDOW w AS (PARTITION BY observation_key ORDER BY seq)),
hist AS (
  SELECT 'osk_' || substr(sha1(observation_key || '||' || version_number), 1, 12) AS ownership_sk, observation_key, owner_entity_id, asset_id, asset_country, asset_sector,
         capacity_mw, CAST(pct AS DOUBLE) AS ownership_pct, numbered.snapshot_date AS effective_date, coalesce(next_date, gone.snapshot_date, '') AS expiry_date,
         CASE WHEN coalesce(next_date, gone.snapshot_date, '') = '' THEN 'Y' ELSE 'N' END AS is_current_flag, version_number, change_reason,
         printf('SNAPSHOT_%03d', numbered.seq) AS dw_batch_id
  FROM numbered LEFT JOIN cal gone ON gone.seq = key_last + 1)"""

HISTORY_COLUMNS = [
    "ownership_sk", "observation_key", "owner_entity_id", "asset_id", "asset_country", "asset_sector", "capacity_mw", "ownership_pct", "effective_date", "expiry_date",
    "is_current_flag", "version_number", "change_reason", "dw_batch_id",
]
_HISTORY = ", ".join(HISTORY_COLUMNS)


def scd4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, calendar = cells_and_calendar(spark, sf_dir)
    return history.snapshot_diff(rows, calendar, ["observation_key"], ["row_hash"], "change_status_backward"), calendar


def scd2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, calendar = cells_and_calendar(spark, sf_dir)
    return history.scd2(rows, calendar, "observation_key", ["row_hash"]).select(*HISTORY_COLUMNS), calendar


@register("snapshot_calendar", f"WITH {CELLS} SELECT snapshot_date, seq, printf('SNAPSHOT_%03d', seq) AS snapshot_version, seq = last_seq AS is_latest, last_seq FROM cal")
def q_calendar(spark, sf_dir):
    quarter = F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyy-MM-dd")
    return snapshot_calendar(table(spark, sf_dir, "lineitem").select(quarter.alias("snapshot_date")))


@register("ownership_observations", f"WITH {CELLS} SELECT snapshot_date, owner_entity_id, asset_id, asset_country, asset_sector, capacity_mw, pct, observation_key, row_hash FROM obs")
def q_ownership(spark, sf_dir):
    return ownership_cells(spark, sf_dir).drop("ownership_pct")


@register("scd4_backward", f"WITH {DIFF} SELECT observation_key, snapshot_date, seq, row_hash, change_status_backward, is_dropped FROM scd4")
def q_scd4(spark, sf_dir):
    return scd4(spark, sf_dir)[0].select("observation_key", "snapshot_date", "seq", "row_hash", "change_status_backward", "is_dropped")


@register(
    "scd4_forward",
    f"""WITH {DIFF} SELECT observation_key, seq, is_dropped,
      CASE WHEN lead(seq) OVER w IS NULL THEN CASE WHEN is_dropped THEN 'ABSENCE' ELSE 'CURRENT' END WHEN lead(is_dropped) OVER w THEN 'DROPPED'
           WHEN lead(row_hash) OVER w <> row_hash THEN 'CHANGED' ELSE 'CURRENT' END AS change_status_forward
      FROM scd4 WINDOW w AS (PARTITION BY observation_key ORDER BY seq)""",
)
def q_forward(spark, sf_dir):
    rows = history.forward_status(scd4(spark, sf_dir)[0], ["observation_key"], "row_hash", "change_status_forward")
    return rows.select("observation_key", "seq", "is_dropped", "change_status_forward")


@register(
    "event_log",
    f"""WITH {DIFF} SELECT owner_entity_id AS entity_id, snapshot_date, seq AS snapshot_sequence_number,
      CASE WHEN bool_or(NOT is_dropped AND change_status_backward = 'CHANGED') THEN 'CHANGED' WHEN bool_or(NOT is_dropped AND change_status_backward = 'NEW') THEN 'NEW'
           WHEN bool_or(NOT is_dropped) THEN 'UNCHANGED' ELSE 'DROPPED' END AS event_type
      FROM scd4 GROUP BY 1, 2, 3""",
)
def q_events(spark, sf_dir):
    return history.event_log(scd4(spark, sf_dir)[0].withColumnRenamed("owner_entity_id", "entity_id"))


@register(
    "current_master",
    f"""WITH {DIFF}, live AS (SELECT *, row_number() OVER (PARTITION BY owner_entity_id ORDER BY asset_id) AS place FROM scd4 WHERE seq = last_seq AND NOT is_dropped)
      SELECT owner_entity_id, asset_id, row_hash, snapshot_date FROM live WHERE place = 1""",
)
def q_current_master(spark, sf_dir):
    rows = history.current_rows(scd4(spark, sf_dir)[0], "owner_entity_id", ["asset_id"])
    return rows.select("owner_entity_id", "asset_id", "row_hash", "snapshot_date")


LIFECYCLE = DIFF + """,
isl AS (SELECT observation_key, owner_entity_id, asset_id, seq, last_seq, seq - row_number() OVER (PARTITION BY observation_key ORDER BY seq) AS island FROM scd4 WHERE NOT is_dropped),
runs AS (SELECT observation_key, owner_entity_id, asset_id, island, count(*) AS run, min(seq) AS f, max(seq) AS l, max(last_seq) AS n FROM isl GROUP BY ALL),
per AS (SELECT observation_key, owner_entity_id, asset_id, min(f) AS f, max(l) AS l, CAST(sum(run) AS BIGINT) AS apps, max(run) AS longest, arg_max(run, l) AS tail, max(n) AS n FROM runs GROUP BY ALL),
life AS (
  SELECT observation_key, owner_entity_id, asset_id, printf('SNAPSHOT_%03d', f) AS first_appearance_version, f AS first_appearance_sequence, printf('SNAPSHOT_%03d', l) AS last_appearance_version,
         l AS last_appearance_sequence, apps AS total_appearances, l - f + 1 AS total_snapshots_available, round(CAST(apps AS DOUBLE) / (l - f + 1), 3) AS presence_rate,
         CASE WHEN l = n THEN tail ELSE 0 END AS consecutive_appearances_current, longest AS max_consecutive_appearances, l - f + 1 - apps AS gap_periods,
         round(CAST(apps AS DOUBLE) / (l - f + 1) * (CASE WHEN l = n THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) * greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (l - f + 1 - apps)), 3) AS reliability_score,
         CASE WHEN l = n AND apps = 1 THEN 'NEW' WHEN l = n AND l - f + 1 = apps THEN 'ACTIVE' WHEN l = n THEN 'INTERMITTENT' ELSE 'DROPPED' END AS lifecycle_status
  FROM per)"""


def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lifecycle(scd4(spark, sf_dir)[0], ["observation_key", "owner_entity_id", "asset_id"])


@register("lifecycle", f"WITH {LIFECYCLE} SELECT * FROM life")
def q_lifecycle(spark, sf_dir):
    return lifecycles(spark, sf_dir)


@register("scd2_history", f"WITH {SCD2} SELECT {_HISTORY} FROM hist")
def q_scd2(spark, sf_dir):
    return scd2(spark, sf_dir)[0]


@register("scd2_current", f"WITH {SCD2} SELECT {_HISTORY} FROM hist WHERE is_current_flag = 'Y'")
def q_scd2_current(spark, sf_dir):
    return scd2(spark, sf_dir)[0].filter("is_current_flag = 'Y'")


@register("asof_join", f"WITH {SCD2} SELECT ownership_sk, owner_entity_id, asset_id, cal.snapshot_date, cal.seq FROM hist JOIN cal ON effective_date <= cal.snapshot_date AND (expiry_date = '' OR expiry_date > cal.snapshot_date)")
def q_asof(spark, sf_dir):
    versions, calendar = scd2(spark, sf_dir)
    return history.as_of(versions, calendar).select("ownership_sk", "owner_entity_id", "asset_id", "snapshot_date", "seq")


EXPOSURE = SCD2 + """,
expo AS (
  SELECT cal.snapshot_date, cal.seq, cal.last_seq, owner_entity_id, asset_country, asset_sector, count(DISTINCT asset_id) AS asset_count,
         CAST(sum(CASE WHEN ownership_pct >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS controlled_asset_count, round(sum(capacity_mw * ownership_pct / 100.0::DOUBLE), 6) AS owned_capacity_mw,
         round(avg(ownership_pct), 6) AS average_ownership_pct, count(ownership_sk) AS relationship_count
  FROM hist JOIN cal ON effective_date <= cal.snapshot_date AND (expiry_date = '' OR expiry_date > cal.snapshot_date) GROUP BY 1, 2, 3, 4, 5, 6)"""
_METRICS = ", ".join(mart.METRICS)
MART_SQL = f"""WITH {EXPOSURE},
m AS (
  SELECT *, lag(seq) OVER w AS before, lead(seq) OVER w AS next_seq, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in mart.METRICS)}
  FROM expo WINDOW w AS (PARTITION BY owner_entity_id, asset_country, asset_sector ORDER BY seq))
SELECT snapshot_date, owner_entity_id, asset_country, asset_sector, {_METRICS},
       CASE WHEN before IS NULL OR before < seq - 1 THEN 'NEW' WHEN {' AND '.join(f'{c} = p_{c}' for c in mart.METRICS)} THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status_vs_prior_snapshot
FROM m
UNION ALL
SELECT cal.snapshot_date, owner_entity_id, asset_country, asset_sector, 0, 0, 0.0, 0.0, 0, 'DROPPED'
FROM m JOIN cal ON cal.seq = m.seq + 1 WHERE m.seq < m.last_seq AND (next_seq IS NULL OR next_seq > m.seq + 1)"""


@register("exposure_aggregate", f"WITH {EXPOSURE} SELECT snapshot_date, owner_entity_id, asset_country, asset_sector, {_METRICS} FROM expo")
def q_exposure(spark, sf_dir):
    versions, calendar = scd2(spark, sf_dir)
    return mart.exposure(versions, calendar).select("snapshot_date", *mart.KEY, *mart.METRICS)


@register("exposure_mart", MART_SQL)
def q_mart(spark, sf_dir):
    versions, calendar = scd2(spark, sf_dir)
    return mart.exposure_mart(versions, calendar)


def asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source row per quarter, supplier and brand, in the shape of the assets' files; operators are the suppliers of a brand's number."""
    cells = ownership_cells(spark, sf_dir)
    operator = F.concat(F.lit("s"), (F.regexp_extract("asset_id", r"([0-9]+)$", 1).cast("int") % 7 + 1).cast("string"))
    return cells.select(
        "snapshot_date", F.concat_ws("|", "asset_id", "owner_entity_id").alias("source_record_id"), F.concat_ws("|", "asset_id", "owner_entity_id").alias("source_business_key"),
        F.col("asset_id").alias("asset_source_id"), F.concat(F.lit("Brand "), "asset_id").alias("asset_name"), "asset_country", "asset_sector",
        F.col("capacity_mw").cast("string").alias("capacity_mw"), F.col("owner_entity_id").alias("owner_source_entity_id"), F.lower("owner_entity_id").alias("owner_name"),
        operator.alias("operator_source_entity_id"), F.when(F.col("pct") % 3 == 0, "0").otherwise(F.col("pct").cast("string")).alias("ownership_pct"),
    )


def identifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the identifiers of entities, and nations as registered parents and children of regions."""
    ids = table(spark, sf_dir, "supplier").select(F.lit("SOURCE_ENTITY_ID").alias("key_name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key_value"))
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("key_value")).union(table(spark, sf_dir, "nation").select("n_name"))
    every = ids.unionByName(names.select(F.lit("REGISTRY_ENTITY_ID").alias("key_name"), "key_value"))
    return every.withColumn("entity_id", F.concat(F.lit("e:"), "key_value"))


ASSET_ROWS = CELLS + """,
src AS (
  SELECT obs.*, asset_id || '|' || owner_entity_id AS record_id, 'ast_' || substr(sha1(asset_id), 1, 12) AS aid, 'e:' || owner_entity_id AS owner,
         'e:s' || (CAST(regexp_extract(asset_id, '([0-9]+)$', 1) AS INTEGER) % 7 + 1) AS operator, CASE WHEN pct % 3 = 0 THEN 0.0 ELSE CAST(pct AS DOUBLE) END AS share FROM obs)"""


@register(
    "asset_master",
    f"""WITH {ASSET_ROWS}, last AS (SELECT max(snapshot_date) AS latest FROM src)
      SELECT aid AS asset_id, 'Brand ' || asset_id AS asset_name, first(asset_country ORDER BY snapshot_date, record_id) AS asset_country, first(asset_sector ORDER BY snapshot_date, record_id) AS asset_sector,
      first(capacity_mw ORDER BY snapshot_date, record_id) AS capacity_mw, first(operator ORDER BY snapshot_date, record_id) AS operator_entity_id, 'infrastructure_assets' AS source_systems,
      min(snapshot_date) AS first_seen_snapshot, max(snapshot_date) AS last_seen_snapshot, max(snapshot_date) = max(latest) AS is_current FROM src, last GROUP BY aid, asset_id""",
)
def q_assets(spark, sf_dir):
    return silver.asset_master(asset_rows(spark, sf_dir), identifier_rows(spark, sf_dir))


@register(
    "silver_ownership",
    f"""WITH {ASSET_ROWS} SELECT 'oobs_' || substr(sha1(snapshot_date || '||' || record_id), 1, 12) AS ownership_observation_id, owner AS owner_entity_id, owner_entity_id AS owner_entity_name, aid AS asset_id,
      'Brand ' || asset_id AS asset_name, asset_country, asset_sector, capacity_mw, share AS ownership_pct, owner || '|' || aid AS lifecycle_key, owner || '|' || aid || '|infrastructure_assets' AS observation_key,
      'ohsh_' || substr(sha1(owner || '|' || aid || '|infrastructure_assets'), 1, 12) AS observation_key_hash, 'infrastructure_assets' AS observation_source, record_id AS source_record_id,
      record_id AS source_business_key, snapshot_date, snapshot_date AS observation_date, snapshot_date AS source_version,
      'orow_' || substr(sha1(owner || '||' || aid || '||Brand ' || asset_id || '||' || asset_country || '||' || asset_sector || '||' || CASE WHEN share = 0 THEN '' ELSE CAST(share AS VARCHAR) END), 1, 12) AS row_hash
      FROM src""",
)
def q_silver_ownership(spark, sf_dir):
    return silver.ownership_observations(asset_rows(spark, sf_dir), identifier_rows(spark, sf_dir))


@register(
    "last_of_snapshot",
    "SELECT o_custkey, year(o_orderdate) AS y, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
)
def q_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y"), "o_orderkey")
    return history.last_of_snapshot(rows, ["o_custkey"], ["o_orderkey"], "y")


@register("lookup", "SELECT n_nationkey, coalesce('e:' || r_name, '') AS parent_id FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey % 2 = 0")
def q_lookup(spark, sf_dir):
    some = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    index = some.filter("r_regionkey % 2 = 0").select(F.lit("REGION").alias("key_name"), F.col("r_name").alias("key_value"), F.concat(F.lit("e:"), "r_name").alias("entity_id"))
    rows = table(spark, sf_dir, "nation").join(some, F.col("n_regionkey") == F.col("r_regionkey"))
    return resolve.lookup(rows, index, "REGION", "r_name", "parent_id", required=False).select("n_nationkey", "parent_id")


REL = "'rel_' || substr(sha1(snapshot_date || '||' || owner_entity_id || '||' || asset_id || '||OWNS_ASSET'), 1, 12)"


@register(
    "edge_first_seen",
    f"""WITH {CELLS}, e AS (SELECT {REL} AS relationship_id, snapshot_date, owner_entity_id AS from_node_id, asset_id AS to_node_id, CAST(pct AS DOUBLE) AS ownership_pct FROM obs)
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY from_node_id, to_node_id, ownership_pct ORDER BY snapshot_date, relationship_id) = 1 THEN 'NEW' ELSE 'UNCHANGED' END AS change_status FROM e""",
)
def q_first_seen(spark, sf_dir):
    cells = ownership_cells(spark, sf_dir)
    edges = cells.select(
        stable_id("rel", F.col("snapshot_date"), F.col("owner_entity_id"), F.col("asset_id"), F.lit("OWNS_ASSET")).alias("relationship_id"),
        "snapshot_date", F.col("owner_entity_id").alias("from_node_id"), F.col("asset_id").alias("to_node_id"), "ownership_pct", F.lit("OWNS_ASSET").alias("relationship_type"),
    )
    return silver.first_seen(edges).drop("relationship_type")


def _edge_sql(start: str, end: str, end_type: str, kind: str, pct: str, role: str, source: str, date: str, evidence: str, rows: str) -> str:
    return (
        f"SELECT 'rel_' || substr(sha1({date} || '||' || {start} || '||' || {end} || '||{kind}'), 1, 12) AS relationship_id, 'entity' AS from_node_type, {start} AS from_node_id, '{end_type}' AS to_node_type,"
        f" {end} AS to_node_id, '{kind}' AS relationship_type, {pct} AS ownership_pct, '{role}' AS asset_role, '{source}' AS source_name, {date} AS snapshot_date, {evidence} AS evidence_key FROM {rows}"
    )


EDGES = f"""{ASSET_ROWS}, ops AS (SELECT DISTINCT snapshot_date, operator, aid FROM src),
e AS ({_edge_sql('owner', 'aid', 'asset', 'OWNS_ASSET', 'share', 'owner', 'infrastructure_assets', 'snapshot_date', 'record_id', 'src')}
  UNION ALL {_edge_sql('operator', 'aid', 'asset', 'OPERATES_ASSET', '100.0', 'operator', 'infrastructure_assets', 'snapshot_date', "'evidence_' || substr(sha1(snapshot_date || '||' || operator || '||' || aid), 1, 12)", 'ops')}
  UNION ALL {_edge_sql("'e:' || r_name", "'e:' || n_name", 'entity', 'PARENT_OF_ENTITY', '100.0', 'parent', 'entity_hierarchy', "'2000-01-01'", "r_name || '>' || n_name", 'region JOIN nation ON n_regionkey = r_regionkey')})"""


@register(
    "edge_union",
    f"""WITH {EDGES} SELECT *, CASE WHEN row_number() OVER (PARTITION BY from_node_id, to_node_id, relationship_type, ownership_pct ORDER BY snapshot_date, relationship_type, relationship_id) = 1
      THEN 'NEW' ELSE 'UNCHANGED' END AS change_status FROM e""",
)
def q_edge_union(spark, sf_dir):
    kin = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    hierarchy = kin.select(
        F.lit("2000-01-01").alias("snapshot_date"), F.concat_ws(">", "r_name", "n_name").alias("source_business_key"),
        F.col("r_name").alias("parent_registry_entity_id"), F.col("n_name").alias("child_registry_entity_id"),
    )
    return silver.relationship_edges(asset_rows(spark, sf_dir), hierarchy, identifier_rows(spark, sf_dir))


# Entities -------------------------------------------------------------------------------------------------------

def yearly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per customer and year, with identifiers shared by some customers."""
    bought = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey").distinct()
    rows = bought.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k, y = F.col("c_custkey"), F.col("y")
    source = F.element_at(F.array(F.lit("registry_entities"), F.lit("entity_hierarchy"), F.lit("infrastructure_assets")), (k % 3 + 1).cast("int"))
    shaped = rows.select(
        y.cast("string").alias("snapshot_date"),
        source.alias("observation_source"),
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("source_record_id"),
        k.cast("string").alias("source_business_key"),
        F.concat("c_name", F.when(y % 2 == 0, " Ltd").otherwise("")).alias("entity_name"),
        F.col("c_nationkey").cast("string").alias("country_code"),
        F.lit("company").alias("entity_type"),
        F.when(k % 3 == 0, F.concat(F.lit("R"), (k % 97).cast("string"))).otherwise("").alias("registry_entity_id"),
        F.when((k + y) % 4 != 0, F.concat(F.lit("L"), (k % 211).cast("string"))).otherwise("").alias("lei"),
        F.when(k % 2 == 0, F.concat(F.lit("S"), (k % 503).cast("string"))).otherwise("").alias("source_entity_id"),
        (k % 3 + 1).cast("long").alias("source_priority"),
    )
    return shaped.withColumn("normalized_name", F.trim(F.regexp_replace(F.lower("entity_name"), "[^a-z0-9]+", " ")))


OBSERVATIONS = """
o AS (
  SELECT CAST(y AS VARCHAR) AS snapshot_date, ['registry_entities', 'entity_hierarchy', 'infrastructure_assets'][c_custkey % 3 + 1] AS observation_source,
         'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS source_record_id, c_name || CASE WHEN y % 2 = 0 THEN ' Ltd' ELSE '' END AS entity_name,
         CAST(c_nationkey AS VARCHAR) AS country_code, CASE WHEN c_custkey % 3 = 0 THEN 'R' || (c_custkey % 97) ELSE '' END AS registry_entity_id,
         CASE WHEN (c_custkey + y) % 4 <> 0 THEN 'L' || (c_custkey % 211) ELSE '' END AS lei, CASE WHEN c_custkey % 2 = 0 THEN 'S' || (c_custkey % 503) ELSE '' END AS source_entity_id,
         c_custkey % 3 + 1 AS source_priority
  FROM (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey),
n AS (
  SELECT *, trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, row_number() OVER (ORDER BY snapshot_date, source_priority, source_record_id) AS ord FROM o),
k AS (
  SELECT ord, 1 AS prio, 'REGISTRY_ENTITY_ID' AS key_name, registry_entity_id AS key_value FROM n WHERE registry_entity_id <> ''
  UNION ALL SELECT ord, 2, 'LEI', lei FROM n WHERE lei <> '' UNION ALL SELECT ord, 3, 'SOURCE_ENTITY_ID', source_entity_id FROM n WHERE source_entity_id <> ''
  UNION ALL SELECT ord, 4, 'NAME_COUNTRY', normalized_name || '|' || country_code FROM n),
p AS (SELECT ord, prio, key_name, lag(ord) OVER (PARTITION BY key_name, key_value ORDER BY ord) AS parent FROM k),
best AS (SELECT ord, arg_min(parent, prio) AS parent, arg_min(key_name, prio) AS method FROM p WHERE parent IS NOT NULL GROUP BY ord),
strong AS (SELECT ord, arg_min(key_name, prio) AS key_name, arg_min(key_value, prio) AS key_value FROM k GROUP BY ord),
walk AS (
  SELECT ord, ord AS root FROM n WHERE ord NOT IN (SELECT ord FROM best)
  UNION ALL SELECT best.ord, walk.root FROM best JOIN walk ON best.parent = walk.ord),
r AS (
  SELECT n.*, 'ent_' || substr(sha1(s.key_name || '||' || s.key_value), 1, 12) AS entity_id, coalesce(method, 'INITIAL_ASSIGNMENT') AS entity_resolution_method,
         own.key_name AS own_key, own.key_name || ':' || own.key_value AS observation_key
  FROM n JOIN walk USING (ord) JOIN strong s ON s.ord = walk.root JOIN strong own ON own.ord = n.ord LEFT JOIN best ON best.ord = n.ord)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(resolve.number_observations(yearly_observations(spark, sf_dir)))


@register("entity_resolution", f"WITH RECURSIVE {OBSERVATIONS} SELECT snapshot_date, source_record_id, entity_id, entity_resolution_method, observation_key FROM r")
def q_resolution(spark, sf_dir):
    return resolve.entity_observations(resolved(spark, sf_dir)).select("snapshot_date", "source_record_id", "entity_id", "entity_resolution_method", "observation_key")


@register(
    "entity_master",
    f"""WITH RECURSIVE {OBSERVATIONS} SELECT entity_id, first(entity_name ORDER BY -length(entity_name), ord) AS entity_name, first(normalized_name ORDER BY -length(entity_name), ord) AS normalized_name,
      first(country_code ORDER BY ord) AS country_code, 'company' AS entity_type,
      coalesce(first(registry_entity_id ORDER BY ord) FILTER (registry_entity_id <> ''), '') AS registry_entity_id, coalesce(first(lei ORDER BY ord) FILTER (lei <> ''), '') AS lei,
      string_agg(DISTINCT observation_source, '|' ORDER BY observation_source) AS source_systems, lower(first(own_key ORDER BY ord)) AS match_basis, min(snapshot_date) AS first_seen_snapshot,
      max(snapshot_date) AS last_seen_snapshot, max(snapshot_date) = (SELECT max(snapshot_date) FROM r) AS is_current FROM r GROUP BY entity_id""",
)
def q_master(spark, sf_dir):
    return resolve.entity_master(resolved(spark, sf_dir))


@register("identifier_index", f"WITH RECURSIVE {OBSERVATIONS} SELECT key_name, key_value, arg_max(entity_id, ord) AS entity_id FROM k JOIN r USING (ord) GROUP BY 1, 2")
def q_index(spark, sf_dir):
    return resolve.identifier_index(resolved(spark, sf_dir))


@register(
    "key_cascade",
    f"WITH {OBSERVATIONS.split('p AS (')[0].rstrip().rstrip(',')}, s AS (SELECT ord, arg_min(key_name || ':' || key_value, prio) AS strongest, count(*) AS n_variants FROM k GROUP BY ord) SELECT snapshot_date, source_record_id, strongest, n_variants FROM n JOIN s USING (ord)",
)
def q_cascade(spark, sf_dir):
    rows = yearly_observations(spark, sf_dir).withColumn("v", key_variants(*[F.col(c) for c in ("registry_entity_id", "lei", "source_entity_id", "normalized_name", "country_code")]))
    return rows.select("snapshot_date", "source_record_id", strongest_key(F.col("v")).alias("strongest"), F.size("v").cast("long").alias("n_variants"))


@register(
    "role_unpivot",
    """SELECT o_orderkey || '|owner' AS source_record_id, CAST(year(o_orderdate) AS VARCHAR) AS snapshot_date, 'company' AS entity_type, 'C' || o_custkey AS entity_name FROM orders
       UNION ALL SELECT o_orderkey || '|operator', CAST(year(o_orderdate) AS VARCHAR), 'operator', o_orderpriority FROM orders""",
)
def q_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("source_record_id"), F.year("o_orderdate").cast("string").alias("snapshot_date"), F.lit("").alias("source_business_key"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderpriority").alias("operator"),
    )
    roles = {"owner": {"entity_name": "owner", "entity_type": F.lit("company")}, "operator": {"entity_name": "operator", "entity_type": F.lit("operator")}}
    return silver.unpivot_roles(rows, "orders", roles).select("source_record_id", "snapshot_date", "entity_type", "entity_name")


# Scalars and sources --------------------------------------------------------------------------------------------

@register("stable_id", "SELECT c_custkey, 'ent_' || substr(sha1(c_name || '||' || c_nationkey || '||' || c_mktsegment), 1, 12) AS id FROM customer")
def q_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", stable_id("ent", F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("id"))


@register(
    "normalize_name",
    r"SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents",
)
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_name(F.col("text"))).alias("digest"))


@register(
    "bronze_envelope",
    """SELECT 'load_' || substr(sha1('customer||2025-01-01||' || c_custkey), 1, 12) AS load_id, '2025-01-01' AS snapshot_date, 'customer' AS source_name, CAST(c_custkey AS VARCHAR) AS source_record_id,
       '' AS source_business_key, '' AS record_type, c_name AS entity_name, CAST(c_nationkey AS VARCHAR) AS country_code,
       '{"c_nationkey": "' || c_nationkey || '", "segment": "' || c_mktsegment || '"}' AS raw_payload FROM customer""",
)
def q_bronze(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("source_record_id"), F.col("c_name").alias("entity_name"), F.col("c_nationkey").cast("string").alias("country_code"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("c_nationkey"), F.lit("2025-01-01").alias("snapshot_date"),
    )
    return bronze_records(rows, "customer")


@register("dictionary_encode", "SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END, 99) AS code FROM orders")
def q_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", encode_by_map(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}, 99).alias("code"))


# Quality --------------------------------------------------------------------------------------------------------

@register("dq_grain", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_grain(spark, sf_dir):
    return quality.not_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dq_range", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09")
def q_range(spark, sf_dir):
    return quality.out_of_range(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.01, 0.09)


@register("dq_accepted", "SELECT o_orderpriority, count(*) AS n_rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def q_accepted(spark, sf_dir):
    return quality.not_accepted(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("dq_not_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def q_not_null(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    joined = table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return quality.is_null(joined.select("c_custkey", "o_orderkey"), "o_orderkey")


# Search ---------------------------------------------------------------------------------------------------------

_WORDS = ", ".join(f"'{w}'" for w in sorted(set(SEARCH.split())))
BM25 = rf"""
t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z_]{{2,}}') AS tokens FROM documents),
s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
c AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM t),
f AS (SELECT id, dl, token, count(*) AS tf FROM c WHERE token IN ({_WORDS}) GROUP BY 1, 2, 3),
d AS (SELECT token, count(*) AS df FROM f GROUP BY 1),
b AS (
  SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM f JOIN d USING (token), s GROUP BY id)"""
VECTOR = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS score FROM embeddings, q)"""


def _ranked(source: str, k: int) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} WHERE score > 0 ORDER BY score DESC, id LIMIT {k}" if source == "b" else f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} ORDER BY score DESC, id LIMIT {k}"


def keyword_list(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.bm25_top_k(search.tokenised(table(spark, sf_dir, "documents"), "doc_id", "text"), SEARCH, k)


def vector_list(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select("embedding").first()
    return search.vector_top_k(vectors, "vec_id", "embedding", query[0] if query else [], k)


@register("bm25_topk", f"WITH {BM25} {_ranked('b', 20)}")
def q_bm25(spark, sf_dir):
    return keyword_list(spark, sf_dir, 20)


@register("vector_topk", f"WITH {VECTOR} {_ranked('v', 20)}")
def q_vector(spark, sf_dir):
    return vector_list(spark, sf_dir, 20)


FUSED = f"""WITH {BM25}, {VECTOR}, l1 AS ({_ranked('b', 40)}), l2 AS ({_ranked('v', 40)}),
fused AS (
  SELECT coalesce(l1.id, l2.id) AS id, l1.rank AS bm25_rank, l2.rank AS vector_rank,
         round(coalesce(1.0::DOUBLE / (60 + l1.rank), 0) + coalesce(1.0::DOUBLE / (60 + l2.rank), 0), 6) AS rrf_score
  FROM l1 FULL OUTER JOIN l2 ON l1.id = l2.id)"""


@register("rrf_fuse", f"{FUSED} SELECT id, bm25_rank, vector_rank, rrf_score FROM fused")
def q_rrf(spark, sf_dir):
    fused = search.rrf_fuse(keyword_list(spark, sf_dir, 40), vector_list(spark, sf_dir, 40))
    return fused.select("id", "bm25_rank", "vector_rank", F.round("rrf_score", 6).alias("rrf_score"))


@register("hybrid_search", f"{FUSED} SELECT id, bm25_rank, vector_rank, rrf_score, lang, source FROM (SELECT * FROM fused ORDER BY rrf_score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, id LIMIT 10) JOIN documents ON doc_id = id")
def q_hybrid(spark, sf_dir):
    k = 10
    wide = search.candidate_count(k)
    attributes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    best = search.hybrid(keyword_list(spark, sf_dir, wide), vector_list(spark, sf_dir, wide), attributes, k)
    return best.select("id", "bm25_rank", "vector_rank", "rrf_score", "lang", "source")


ENTITY_SEARCH = "customer 12 building"
_INDEX_WORDS = ", ".join(f"'{w}'" for w in sorted(set(ENTITY_SEARCH.split())))


@register(
    "entity_index",
    rf"""WITH txt AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, trim(c_name || ' ' || lower(c_name) || ' ' || c_nationkey || ' ' || c_mktsegment) AS text FROM customer),
      t AS (SELECT id, regexp_extract_all(lower(text), '[0-9a-z_]{{2,}}') AS tokens FROM txt),
      s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
      c AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM t),
      f AS (SELECT id, dl, token, count(*) AS tf FROM c WHERE token IN ({_INDEX_WORDS}) GROUP BY 1, 2, 3),
      d AS (SELECT token, count(*) AS df FROM f GROUP BY 1),
      b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM f JOIN d USING (token), s GROUP BY id),
      r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b WHERE score > 0 ORDER BY score DESC, id LIMIT 15)
      SELECT id, score, rank, c_name AS entity_name FROM r JOIN txt USING (id)""",
)
def q_entity_index(spark, sf_dir):
    """Customers as current entities: the index is stored, and the query reads its postings."""
    entities = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("entity_name"), F.lower("c_name").alias("normalized_name"),
        F.col("c_nationkey").cast("string").alias("country_code"), F.col("c_mktsegment").alias("entity_type"), F.lit("").alias("lei"),
    )
    index, _ = entity_index.build(entities)
    names = index.table("attributes").select(F.col("entity_id").alias("id"), "entity_name")
    return index.keyword(ENTITY_SEARCH, 15).join(names, "id").select("id", "score", "rank", "entity_name")


@register("search_text", "SELECT c_custkey, trim(c_name || ' ' || lower(c_name) || ' ' || c_nationkey || ' ' || c_mktsegment) AS text FROM customer")
def q_search_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", search.search_text(F.col("c_name"), F.lower("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.lit("")).alias("text"))


_PARTS = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR)" for i in range(8))


@register("corpus_fingerprint", f"WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), text)) AS d FROM documents) SELECT sha256(concat_ws('|', 'model-1', count(*), {_PARTS})) AS fingerprint FROM h")
def q_fingerprint(spark, sf_dir):
    return search.corpus_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text", "model-1")


# Features and metrics -------------------------------------------------------------------------------------------

def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as assets, most nations as known countries, five sectors."""
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    countries = nations.filter(n % 4 != 0).select(
        F.col("n_name").alias("country_code"), (n * 3.0).alias("latitude_centroid"), (n * -2.0).alias("longitude_centroid"), (n * 10).alias("altitude_avg_m"),
        F.element_at(F.array(*[F.lit(x) for x in ("island", "coastal", "mixed", "inland")]), (n % 4 + 1).cast("int")).alias("territorial_type"),
        F.element_at(F.array(*[F.lit(x) for x in ("high", "upper_middle", "lower_middle", "low")]), (n % 4 + 1).cast("int")).alias("economic_level"),
        (n % 5 + 1).alias("gdp_tier"), (n * 20 + 1000).alias("solar_irradiance_kwh_m2_yr"), (n * 0.25 + 4.0).alias("wind_speed_avg_ms"), (n % 10).alias("regulatory_stability_score"),
    )
    i = F.col("id")
    sectors = spark.range(5).select(
        F.concat(F.lit("S"), i.cast("string")).alias("sector"), (i * 3 + 15).alias("typical_lifespan_years"), (i * 3 + 10).alias("min_lifespan_years"), (i * 3 + 22).alias("max_lifespan_years"),
        (i % 3 + 1).alias("construction_years"), (i % 2 + 1).alias("decommissioning_years"), (i * 0.05 + 0.15).alias("base_capacity_factor"), F.lit(0.0001).alias("irradiance_sensitivity"),
        F.lit(0.02).alias("wind_sensitivity"), F.lit(0.00002).alias("altitude_sensitivity"), F.lit(0.02).alias("economic_level_bonus_high"), F.lit(0.01).alias("economic_level_bonus_upper_middle"),
        F.lit(0.0).alias("economic_level_bonus_lower_middle"), F.lit(-0.01).alias("economic_level_bonus_low"), F.lit(0.2).alias("training_weight"),
    )
    owners = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == n)
    assets = owners.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("asset_id"), F.col("s_name").alias("asset_name"), F.col("n_name").alias("asset_country"),
        F.concat(F.lit("S"), (F.col("s_suppkey") % 5).cast("string")).alias("asset_sector"), F.col("s_acctbal").alias("capacity_mw"),
    )
    return assets, countries, sectors


COUNTRIES = """
countries AS (
  SELECT n_name AS country_code, n_nationkey * 3.0::DOUBLE AS latitude, n_nationkey * -2.0::DOUBLE AS longitude, CAST(n_nationkey * 10 AS DOUBLE) AS altitude_avg_m,
         ['island', 'coastal', 'mixed', 'inland'][n_nationkey % 4 + 1] AS territorial_type, ['high', 'upper_middle', 'lower_middle', 'low'][n_nationkey % 4 + 1] AS economic_level,
         CAST(n_nationkey % 5 + 1 AS DOUBLE) AS gdp_tier, CAST(n_nationkey * 20 + 1000 AS DOUBLE) AS solar_irradiance_kwh_m2_yr, n_nationkey * 0.25::DOUBLE + 4.0 AS wind_speed_avg_ms,
         CAST(n_nationkey % 10 AS DOUBLE) AS regulatory_stability_score
  FROM nation WHERE n_nationkey % 4 <> 0)"""
_GEO = ("latitude", "longitude", "altitude_avg_m", "gdp_tier", "solar_irradiance_kwh_m2_yr", "wind_speed_avg_ms", "regulatory_stability_score")
_MEDIANS = ", ".join(f"CAST(trunc(median({c})) AS INTEGER) AS median_{c}" if c == "gdp_tier" else f"median({c}) AS median_{c}" for c in _GEO)


@register("feature_medians", f"WITH {COUNTRIES} SELECT {_MEDIANS} FROM countries")
def q_medians(spark, sf_dir):
    return features.medians(dimensions(spark, sf_dir)[1])


_FILLED = ", ".join(f"CAST(coalesce({c}, median_{c}) AS {'BIGINT' if c == 'gdp_tier' else 'DOUBLE'}) AS {c}" for c in _GEO)
FEATURE_SQL = f"""WITH {LIFECYCLE}, {COUNTRIES},
med AS (SELECT {_MEDIANS} FROM countries),
sig AS (
  SELECT owner_entity_id, first(total_appearances ORDER BY -reliability_score, observation_key) AS total_appearances, first(presence_rate ORDER BY -reliability_score, observation_key) AS presence_rate,
         first(reliability_score ORDER BY -reliability_score, observation_key) AS reliability_score,
         first(consecutive_appearances_current ORDER BY -reliability_score, observation_key) AS consecutive_appearances_current
  FROM life GROUP BY 1),
enriched AS (
  SELECT 's' || s_suppkey AS asset_id, s_name AS asset_name, n_name AS asset_country, 'S' || (s_suppkey % 5) AS asset_sector, coalesce(territorial_type, 'mixed') AS territorial_type,
         coalesce(economic_level, 'upper_middle') AS economic_level, s_acctbal AS capacity_mw, s_suppkey % 5 + 1 AS sector_encoded, {_FILLED},
         CASE coalesce(territorial_type, 'mixed') WHEN 'island' THEN 1 WHEN 'coastal' THEN 2 WHEN 'mixed' THEN 3 WHEN 'inland' THEN 4 ELSE 3 END AS territorial_type_encoded,
         coalesce(total_appearances, 1) AS total_appearances, coalesce(presence_rate, 1.0) AS presence_rate, coalesce(reliability_score, 0.5) AS reliability_score,
         CAST((s_suppkey % 5) * 3 + 15 AS DOUBLE) AS typical_lifespan_years
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN countries ON country_code = n_name LEFT JOIN sig ON owner_entity_id = 's' || s_suppkey, med)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, countries, sectors = dimensions(spark, sf_dir)
    signals = lifecycles(spark, sf_dir).select(F.col("owner_entity_id").alias("asset_id"), F.col("observation_key").alias("lifecycle_key"), *features.NO_HISTORY)
    return features.enrich(assets, signals, countries, sectors)


@register("feature_enrich", f"{FEATURE_SQL} SELECT * FROM enriched")
def q_enrich(spark, sf_dir):
    return enriched(spark, sf_dir)


_PROMPT = (
    "'Classify the lifecycle stage of the following energy infrastructure asset.' || chr(10) || 'Respond with exactly one of: planning, construction, operating, decommissioning, retired.'"
    " || chr(10) || chr(10) || 'Asset features:' || chr(10) || "
    + " || chr(10) || ".join(f"'  {c}: ' || {c}" for c in features.FEATURES)
    + " || chr(10) || chr(10) || 'Lifecycle stage:'"
)


@register("prompt_text", f"{FEATURE_SQL} SELECT asset_id, md5({_PROMPT}) AS prompt_md5 FROM enriched")
def q_prompt(spark, sf_dir):
    return enriched(spark, sf_dir).select("asset_id", F.md5(features.prompt()).alias("prompt_md5"))


@register("synthetic_training")
def q_synthetic(spark, sf_dir):
    _, countries, sectors = dimensions(spark, sf_dir)
    return ml.synthetic_training(countries, sectors)


@register("ml_predict")
def q_predict(spark, sf_dir):
    _, countries, sectors = dimensions(spark, sf_dir)
    return ml.predict(enriched(spark, sf_dir), ml.train(ml.synthetic_training(countries, sectors)))


JUDGED = "judged AS (SELECT CAST(quality AS VARCHAR) AS label, CASE WHEN toxic = 1 THEN '0' ELSE '1' END AS predicted FROM labels)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("label"), F.when(F.col("toxic") == 1, "0").otherwise("1").alias("predicted"))


@register("eval_confusion", f"WITH {JUDGED} SELECT label, predicted, count(*) AS n FROM judged GROUP BY 1, 2")
def q_confusion(spark, sf_dir):
    return metrics.confusion(judged(spark, sf_dir), "label", "predicted")


@register("eval_accuracy", f"WITH {JUDGED} SELECT count(*) AS n, round(CAST(sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS accuracy FROM judged")
def q_accuracy(spark, sf_dir):
    return metrics.accuracy(judged(spark, sf_dir), "label", "predicted")


@register(
    "eval_per_class",
    f"""WITH {JUDGED}, cls AS (SELECT label AS class FROM judged UNION SELECT predicted FROM judged),
      t AS (SELECT class, CAST(sum(CASE WHEN label = class AND predicted = class THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS support,
                   sum(CASE WHEN predicted = class THEN 1 ELSE 0 END) AS called FROM cls, judged GROUP BY class)
      SELECT class, CAST(support AS BIGINT) AS support, round(CASE WHEN called > 0 THEN tp / called ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
             round(2 * tp / (called + support), 6) AS f1 FROM t""",
)
def q_per_class(spark, sf_dir):
    return metrics.per_class(judged(spark, sf_dir), "label", "predicted")


@register(
    "stratified_split",
    """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1(CAST(o_orderkey AS VARCHAR)), o_orderkey)
         <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2::DOUBLE) AS is_test FROM orders""",
)
def q_split(spark, sf_dir):
    return metrics.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@register("batch_latest", "SELECT arg_max(o_orderkey, o_orderkey) AS batch_id, max(o_orderkey) AS run_seq FROM orders")
def q_batch(spark, sf_dir):
    from ledgerloom.plans.publish import latest_batch

    return latest_batch(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("run_seq")))
