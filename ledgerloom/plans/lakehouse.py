"""The whole lakehouse: snapshots to bronze, silver and gold tables, predictions, publication, report."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import features, history, mart, ml, resolve, silver
from ledgerloom.operators.calendar import snapshot_calendar
from ledgerloom.operators.quality import gold_checks
from ledgerloom.plans.contracts import require, validate_published
from ledgerloom.plans.publish import Summary, publish
from ledgerloom.shared import materialize, release
from ledgerloom.sources import bronze_records, read_any_snapshots, read_dimension, read_snapshots, register, write_bronze, write_layer
from ledgerloom.sources.snapshots import COUNTRY_SCHEMA, SECTOR_SCHEMA
from ledgerloom.sources.tables import publish_analytics, write_report

MODES = ("commit", "dry_run")
_SCD4_NAMES = {"seq": "snapshot_sequence_number", "is_latest": "is_latest_snapshot"}


class WorkingTables:
    """Writes intermediate tables, and deletes them when all that reads them is done."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(materialize(df, name))
        return self.held[-1]

    def release(self) -> None:
        for df in self.held:
            release(df)
        self.held = []


def build_silver(frames: dict[str, DataFrame], scratch: WorkingTables | None = None) -> dict[str, DataFrame]:
    keep = (scratch or WorkingTables()).keep
    numbered = resolve.number_observations(silver.observations_of(frames))
    resolved = keep(resolve.resolve(numbered), "resolved")
    index = keep(resolve.identifier_index(resolved), "identifiers")
    assets, hierarchy = frames["infrastructure_assets"], frames["entity_hierarchy"]
    tables = {
        "entity_observations": resolve.entity_observations(resolved),
        "entity_master": resolve.entity_master(resolved),
        "asset_master": silver.asset_master(assets, index),
        "ownership_observations": silver.ownership_observations(assets, index),
        "relationship_edges": silver.relationship_edges(assets, hierarchy, index),
    }
    return {name: require(df, name) for name, df in tables.items()}


def entity_scd4(observations: DataFrame, calendar: DataFrame) -> DataFrame:
    """Entities by source and snapshot, with change and one dropped row per gap."""
    key = ["entity_id", "observation_source"]
    rows = history.with_calendar(history.last_of_snapshot(observations, key, ["source_record_id"]), calendar)
    return history.snapshot_diff(rows, calendar, key, ["observation_key_hash", "entity_name"], "change_status_backward", {"source_version": F.col("snapshot_date")})


def ownership_scd4(observations: DataFrame, calendar: DataFrame) -> DataFrame:
    key = ["observation_key"]
    rows = history.with_calendar(history.last_of_snapshot(observations, key, ["source_record_id"]), calendar)
    dates = {"observation_date": F.col("snapshot_date"), "source_version": F.col("snapshot_date")}
    both = history.snapshot_diff(rows, calendar, key, ["row_hash"], "change_status_backward", dates)
    ahead = history.forward_status(both, key, "row_hash", "change_status_forward")
    return ahead.withColumns({"row_change_status_backward": F.col("change_status_backward"), "row_change_status_forward": F.col("change_status_forward")})


def ownership_scd2(scd4: DataFrame, calendar: DataFrame) -> DataFrame:
    payload = ["owner_entity_id", "asset_id", "asset_name", "asset_country", "asset_sector", "ownership_pct"]
    active = scd4.filter(~F.col("is_dropped"))
    versions = history.scd2(active, calendar, "observation_key_hash", payload)
    return versions.select(
        "ownership_sk", F.col("observation_key_hash").alias("business_key_hash"), "owner_entity_id", "owner_entity_name", "asset_id", "asset_name", "asset_country",
        "asset_sector", "capacity_mw", "ownership_pct", "observation_source", "effective_date", "expiry_date", "is_current_flag", "version_number", "change_reason", "dw_batch_id",
    )


def build_gold(silver_tables: dict[str, DataFrame], scratch: WorkingTables | None = None) -> dict[str, DataFrame]:
    keep = (scratch or WorkingTables()).keep
    entities = silver_tables["entity_observations"]
    owned = silver_tables["ownership_observations"]
    entities, owned = keep(entities, "entity-observations"), keep(owned, "ownership-observations")
    entity_calendar = keep(snapshot_calendar(entities), "entity-calendar")
    calendar = keep(snapshot_calendar(owned), "ownership-calendar")
    by_entity = keep(entity_scd4(entities, entity_calendar), "entity-scd4")
    by_owner = keep(ownership_scd4(owned, calendar), "ownership-scd4")
    versions = keep(ownership_scd2(by_owner, calendar), "ownership-scd2")
    current = history.current_rows(by_entity, "entity_id", ["source_priority", "entity_name", "entity_observation_id"])
    lifecycles = history.lifecycle(by_owner, ["lifecycle_key", "owner_entity_id", "asset_id"], "observation_source")
    tables = {
        "entity_master_comprehensive_scd4": by_entity.withColumnsRenamed(_SCD4_NAMES).drop("last_seq"),
        "entity_master_current": current.select(
            "entity_id", "entity_name", "normalized_name", "country_code", "entity_type", "registry_entity_id", "lei", "source_entity_id",
            F.col("observation_source").alias("current_observation_source"), F.col("snapshot_date").alias("current_snapshot_date"), "entity_resolution_method",
        ),
        "entity_master_event_log": history.event_log(by_entity),
        "ownership_comprehensive_scd4": by_owner.withColumnsRenamed(_SCD4_NAMES).drop("last_seq"),
        "ownership_lifecycle": lifecycles,
        "ownership_history_scd2": versions,
        "ownership_current": versions.filter("is_current_flag = 'Y'"),
        "owner_infrastructure_exposure_snapshot": mart.exposure_mart(versions, calendar),
    }
    return {name: require(df, name) for name, df in tables.items()}


def build_predictions(assets: DataFrame, lifecycles: DataFrame, countries: DataFrame, sectors: DataFrame, trees: int = 200) -> DataFrame:
    models = ml.train(ml.synthetic_training(countries, sectors), trees=trees)
    return require(ml.predict(features.enrich(assets, lifecycles, countries, sectors), models), "asset_lifecycle_predictions")


#: Paths below someone's own folder, which published files shouldn't name.
PRIVATE_PATHS = ("/Users/[^/]+/Documents/", "/home/[^/]+/[^/]+/")
#: Files whose text is looked at.
TEXT_FILES = "*.{py,md,txt,toml,json,jsonl,yml,yaml,sql,csv,cfg,ini,sh}"


def scan_public_safety(spark: SparkSession, root: str, banned: Sequence[str] = (), patterns: Sequence[str] = PRIVATE_PATHS, files: str = TEXT_FILES) -> list[str]:
    """What the text files below ``root`` hold of banned words and private paths, one line for each file and rule.

    The files are read by Spark, each as one row; hidden ones are passed over, as its readers do.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", files)
    texts = reader.text(root).select(F.col("_metadata.file_path").alias("file"), "value")
    rules = [F.when(F.contains("value", F.lit(word)), F.lit(f"banned word {word!r}")) for word in banned]
    rules += [F.when(F.col("value").rlike(pattern), F.lit(f"private path like {pattern}")) for pattern in patterns]
    found = texts.select("file", F.explode(F.array_compact(F.array(*rules))).alias("rule")).orderBy("file", "rule")
    return [f"{row.file}: {row.rule}" for row in found.collect()]  # findings only


def run_lakehouse(
    spark: SparkSession,
    sample_root: str,
    reference_root: str,
    output_root: str,
    publish_mode: str = "commit",
    report_path: str | None = None,
    sink_root: str | None = None,
    safety_root: str | None = None,
    trees: int = 200,
    catalog: bool = False,
) -> dict[str, int]:
    """Run all layers; returns row counts. ``dry_run`` computes and validates all but of its results writes only the report.

    Working tables go to the shared folder in both modes and are deleted at the end. The safety scan, of ``safety_root``,
    runs before anything is written. The report is written on success and on failure, and names the
    artifacts that were complete by then; that it can't be written is an error in a dry run only.
    """
    if publish_mode not in MODES:
        raise ValueError(f"publish_mode must be one of {', '.join(MODES)}, not {publish_mode!r}")
    commit = publish_mode == "commit"
    report: dict = {
        "schema_version": "1", "publish_mode": publish_mode, "status": "failed", "started_at": datetime.now(timezone.utc).isoformat(), "row_counts": {},
        "artifacts": [], "validation": [], "quality": {}, "sink": {"status": "skipped", "rollback_status": "not_applicable"}, "safety_findings": [], "error": None,
    }
    scratch = WorkingTables()
    try:
        if safety_root:
            report["safety_findings"] = scan_public_safety(spark, safety_root)
            if report["safety_findings"]:
                raise ValueError(f"public safety: {report['safety_findings'][0]}")
        frames = read_snapshots(spark, sample_root)
        bronze = None
        for family, rows in read_any_snapshots(spark, sample_root).items():
            records = require(bronze_records(rows, family), "bronze_source_record")
            bronze = records if bronze is None else bronze.unionByName(records)
        silver_tables = build_silver(frames, scratch)
        gold_tables = build_gold(silver_tables, scratch)
        countries = read_dimension(spark, f"{reference_root}/country_attributes.csv", COUNTRY_SCHEMA)
        sectors = read_dimension(spark, f"{reference_root}/sector_lifecycle.csv", SECTOR_SCHEMA)
        lifecycles = gold_tables["ownership_lifecycle"]
        predictions = build_predictions(silver_tables["asset_master"], lifecycles, countries, sectors, trees)
        gold_tables["asset_lifecycle_predictions"] = predictions
        checks = {r.check_name: r.failing_rows for r in gold_checks(gold_tables).collect()}  # one row per check
        report["quality"] = checks
        found = validate_published(gold_tables)
        report["validation"] = [vars(v) for v in found]
        if any(checks.values()) or not all(v.ok for v in found):
            raise ValueError("quality checks or schemas failed")
        counted = {"entity_master": silver_tables["entity_master"], "asset_master": silver_tables["asset_master"], "relationship_edges": silver_tables["relationship_edges"]}
        counted |= {"owner_infrastructure_exposure_snapshot": gold_tables["owner_infrastructure_exposure_snapshot"], "asset_lifecycle_predictions": predictions}
        if commit:
            write_bronze(bronze, f"{output_root}/bronze")
            done: list[str] = report["artifacts"]  # grows table by table, so a failure leaves the list of what is complete
            paths = write_layer(silver_tables, f"{output_root}/silver", done)
            gold_paths = write_layer(gold_tables, f"{output_root}/gold", done)
            done.sort()
            register(spark, gold_paths, catalog=catalog)
            if catalog:
                publish_analytics(spark)
            if sink_root:
                report["sink"] = vars(publish(spark, {n: spark.read.parquet(p) for n, p in gold_paths.items()}, sink_root))
            counted = {name: spark.read.parquet({**paths, **gold_paths}[name]) for name in counted}
        elif sink_root:
            report["sink"] = vars(Summary(status="dry_run_validated"))
        report["row_counts"] = {name: df.count() for name, df in counted.items()}
        report["status"] = "success"
        return report["row_counts"]
    except Exception as error:
        report["error"] = str(error)
        if hasattr(error, "publish_summary"):
            report["sink"] = vars(error.publish_summary)
        raise
    finally:
        scratch.release()
        if report_path:
            try:
                write_report(spark, report, report_path)
            except Exception:
                if not commit:
                    raise
                logging.getLogger(__name__).warning("the report could not be written to %s", report_path, exc_info=True)


def main(argv: list[str] | None = None) -> int:
    from ledgerloom.session import get_session

    parser = argparse.ArgumentParser(description="Build the entity and ownership lakehouse from CSV snapshots.")
    parser.add_argument("--samples", required=True)
    parser.add_argument("--reference-data", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--sink")
    parser.add_argument("--publish-mode", choices=MODES, default="commit")
    parser.add_argument("--report-path")
    parser.add_argument("--safety-root", default=".", help="folder whose text files are scanned first; empty for none")
    parser.add_argument("--catalog", action="store_true", help="register tables in the session's catalog, with analytics views")
    args = parser.parse_args(argv)
    counts = run_lakehouse(get_session(), args.samples, args.reference_data, args.output, args.publish_mode, args.report_path, args.sink, args.safety_root or None, catalog=args.catalog)
    for name, count in counts.items():
        print(f"{name}: {count}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
