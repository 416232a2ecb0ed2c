from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.entity_index import build
from ledgerloom.operators.quality import gold_checks
from ledgerloom.plans.contracts import exact, validate, validate_published
from ledgerloom.plans import search_app
from ledgerloom.plans.lakehouse import build_gold, build_silver, run_lakehouse, scan_public_safety
from ledgerloom.plans.publish import claim_run, latest_batch, publish, read_log, read_published
from ledgerloom.sources import bronze_records, publish_analytics, read_any_snapshots, read_snapshots, register, write_bronze, write_layer
from tests.sample import write_dimensions, write_samples


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    root = write_samples(tmp_path_factory.mktemp("samples"))
    frames = read_snapshots(spark, str(root))
    silver = build_silver(frames)
    gold = build_gold(silver)
    return frames, {k: v.cache() for k, v in silver.items()}, {k: v.cache() for k, v in gold.items()}


def tally(df, column):
    return dict(Counter(r[0] for r in df.select(column).collect()))


def test_counts(layers):
    frames, silver, gold = layers
    assert {k: v.count() for k, v in frames.items()} == {"registry_entities": 18, "entity_hierarchy": 6, "infrastructure_assets": 19}
    assert {k: v.count() for k, v in silver.items()} == {
        "entity_observations": 68, "entity_master": 6, "asset_master": 5, "ownership_observations": 19, "relationship_edges": 37,
    }
    assert {k: v.count() for k, v in gold.items()} == {
        "entity_master_comprehensive_scd4": 47, "entity_master_current": 6, "entity_master_event_log": 18, "ownership_comprehensive_scd4": 21,
        "ownership_lifecycle": 8, "ownership_history_scd2": 15, "ownership_current": 7, "owner_infrastructure_exposure_snapshot": 21,
    }


def test_silver_statuses(layers):
    _, silver, _ = layers
    assert tally(silver["entity_observations"], "entity_resolution_method") == {"INITIAL_ASSIGNMENT": 6, "REGISTRY_ENTITY_ID": 24, "LEI": 38}
    assert tally(silver["relationship_edges"], "relationship_type") == {"OWNS_ASSET": 19, "OPERATES_ASSET": 12, "PARENT_OF_ENTITY": 6}
    assert tally(silver["relationship_edges"], "change_status") == {"NEW": 18, "UNCHANGED": 19}
    assert tally(silver["asset_master"], "is_current") == {True: 4, False: 1}
    names = {r.registry_entity_id: r.entity_name for r in silver["entity_master"].collect()}
    assert names["REG-001"].endswith("plc")  # equally long names don't replace the first


def test_gold_statuses(layers):
    _, _, gold = layers
    scd4 = gold["ownership_comprehensive_scd4"]
    assert tally(scd4, "change_status_backward") == {"NEW": 9, "CHANGED": 6, "UNCHANGED": 4, "DROPPED": 2}
    assert tally(scd4, "change_status_forward") == {"CHANGED": 6, "DROPPED": 2, "ABSENCE": 1, "CURRENT": 12}
    assert tally(gold["ownership_lifecycle"], "lifecycle_status") == {"ACTIVE": 6, "INTERMITTENT": 1, "DROPPED": 1}
    assert tally(gold["ownership_history_scd2"], "change_reason") == {"NEW": 8, "CHANGED": 6, "REOPENED": 1}
    assert tally(gold["ownership_history_scd2"], "is_current_flag") == {"Y": 7, "N": 8}
    assert tally(gold["owner_infrastructure_exposure_snapshot"], "change_status_vs_prior_snapshot") == {"NEW": 8, "CHANGED": 6, "UNCHANGED": 6, "DROPPED": 1}
    events = Counter((r.snapshot_sequence_number, r.event_type) for r in gold["entity_master_event_log"].collect())
    assert events == {(1, "NEW"): 6, (2, "CHANGED"): 2, (2, "UNCHANGED"): 4, (3, "NEW"): 1, (3, "UNCHANGED"): 5}
    scores = sorted((r.reliability_score, r.presence_rate, r.gap_periods, r.consecutive_appearances_current) for r in gold["ownership_lifecycle"].collect())
    assert scores[:2] == [(0.6, 0.667, 1, 1), (0.8, 1.0, 0, 0)]


def test_versions_span_gaps(layers):
    _, silver, gold = layers
    owners = {r.registry_entity_id: r.entity_id for r in silver["entity_master"].collect()}
    rows = [(r.effective_date, r.expiry_date, r.change_reason) for r in gold["ownership_history_scd2"].filter(f"owner_entity_id = '{owners['REG-004']}'").orderBy("version_number").collect()]
    assert rows == [("2025-01-01", "2025-09-01", "NEW"), ("2025-09-01", "", "REOPENED")]
    mart = {(r.snapshot_date, r.asset_country): r for r in gold["owner_infrastructure_exposure_snapshot"].filter(f"owner_entity_id = '{owners['REG-004']}'").collect()}
    gap = mart["2025-06-01", "DE"]
    assert (gap.asset_count, gap.owned_capacity_mw, gap.average_ownership_pct, gap.change_status_vs_prior_snapshot) == (1, 36.0, 40.0, "UNCHANGED")
    gone = gold["owner_infrastructure_exposure_snapshot"].filter("change_status_vs_prior_snapshot = 'DROPPED'").collect()[0]
    assert (gone.snapshot_date, gone.asset_country, gone.asset_count, gone.owned_capacity_mw) == ("2025-06-01", "FR", 0, 0.0)


def test_quality_and_contracts(layers):
    _, _, gold = layers
    assert not any(r.failing_rows for r in gold_checks(gold).collect())
    assert all(v.ok for v in validate_published(gold))
    broken = gold | {"ownership_current": gold["ownership_current"].drop("asset_id")}
    assert [v.ok for v in validate_published(broken)] == [True, False, True]
    assert not validate(gold["ownership_current"].selectExpr("*", "cast(capacity_mw as string) as c").drop("capacity_mw").withColumnRenamed("c", "capacity_mw"), "ownership_current").ok
    with pytest.raises(ValueError, match="unexpected columns"):
        exact(gold["ownership_current"].selectExpr("*", "1 as more"), "ownership_current")


def test_bronze(layers):
    frames, _, _ = layers
    row = bronze_records(frames["registry_entities"], "registry_entities").orderBy("snapshot_date", "source_record_id").first()
    payload = json.loads(row.raw_payload)
    assert row.raw_payload == json.dumps(payload, ensure_ascii=True, sort_keys=True)
    assert set(payload) == {"registry_entity_id", "lei", "entity_type"}


def test_publication_rolls_back(spark, layers, tmp_path):
    _, _, gold = layers
    root = f"file://{tmp_path}/sink"
    first = publish(spark, gold, root)
    assert first.status == "success" and latest_batch(read_log(spark, root)).first().batch_id == first.batch_id
    broken = dict(gold, owner_infrastructure_exposure_snapshot=gold["owner_infrastructure_exposure_snapshot"].drop("asset_count"))
    with pytest.raises(ValueError) as caught:
        publish(spark, broken, root)
    assert caught.value.publish_summary.rollback_status == "rolled_back"
    assert latest_batch(read_log(spark, root)).first().batch_id == first.batch_id
    assert read_published(spark, root, "ownership_current").count() == 7


def test_dry_run_writes_only_the_report(spark, tmp_path):
    samples, dims = write_samples(tmp_path / "in"), write_dimensions(tmp_path / "dims")
    counts = run_lakehouse(spark, str(samples), str(dims), str(tmp_path / "out"), "dry_run", str(tmp_path / "report.json"), trees=8)
    assert counts == {"entity_master": 6, "asset_master": 5, "relationship_edges": 37, "owner_infrastructure_exposure_snapshot": 21, "asset_lifecycle_predictions": 5}
    assert not (tmp_path / "out").exists()
    assert json.loads((tmp_path / "report.json").read_text())["status"] == "success"


def test_commit(spark, tmp_path):
    samples, dims = write_samples(tmp_path / "in"), write_dimensions(tmp_path / "dims")
    run_lakehouse(spark, str(samples), str(dims), str(tmp_path / "out"), "commit", str(tmp_path / "report.json"), f"file://{tmp_path}/sink", trees=8)
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["sink"]["status"] == "success" and len(report["artifacts"]) == 14
    rows = spark.read.parquet(str(tmp_path / "out/gold/asset_lifecycle_predictions")).collect()
    assert all(2025 <= r.estimated_retirement_year <= 2080 and 1 <= r.predicted_capacity_factor_pct <= 80 for r in rows)
    assert all(r.estimated_commissioning_year < r.estimated_retirement_year for r in rows)


def test_safety_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("see /" + "home/someone/work/notes")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/b.md").write_text("clean, but says forbidden")
    (tmp_path / "c.txt").write_text("clean")
    found = scan_public_safety(spark, str(tmp_path), ("forbidden",))
    assert [f.rsplit("/", 1)[-1].split(":")[0] for f in found if "banned" in f] == ["b.md"] and len(found) == 2
    assert any("a.txt: private path" in f for f in found)


def test_unsafe_text_stops_the_run(spark, tmp_path):
    samples, dims = write_samples(tmp_path / "in"), write_dimensions(tmp_path / "dims")
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo/a.md").write_text("/" + "Users/someone/Documents/x/")
    with pytest.raises(ValueError, match="public safety"):
        run_lakehouse(spark, str(samples), str(dims), str(tmp_path / "out"), "commit", str(tmp_path / "report.json"), safety_root=str(tmp_path / "repo"))
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["status"] == "failed" and report["artifacts"] == [] and not (tmp_path / "out").exists()


def test_catalog_and_views(spark, layers, tmp_path):
    _, _, gold = layers
    some = {n: gold[n] for n in ("entity_master_current", "ownership_current", "owner_infrastructure_exposure_snapshot")}
    some["asset_lifecycle_predictions"] = spark.createDataFrame([("a", "b")], "asset_id string, extra string")
    done: list[str] = []
    paths = write_layer(some, f"{tmp_path}/gold", done)
    assert done == list(paths.values())
    names = register(spark, paths, catalog=True)
    assert names[2:] == ["mart_owner_infrastructure_exposure_snapshot", "ml_asset_lifecycle_predictions"]
    views = publish_analytics(spark, "analytics_of_test")
    assert spark.table(views[0]).columns == ["asset_id"] and spark.table("analytics_of_test.ownership_current").count() == 7
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_any_family_and_bronze_read_back(spark, tmp_path):
    root = write_samples(tmp_path / "in")
    (root / "more").mkdir()
    (root / "more/2025-01-01.csv").write_text("source_record_id,note\nX1,\u00e9\n")
    (root / "more/2025-06-01.csv").write_text("source_record_id,other\nX2,\n")
    families = read_any_snapshots(spark, str(root))
    assert sorted(families) == ["entity_hierarchy", "infrastructure_assets", "more", "registry_entities"]
    rows = {r.source_record_id: r for r in families["more"].collect()}
    assert (rows["X1"].note, rows["X1"].other, rows["X1"].snapshot_date, rows["X2"].note) == ("\u00e9", "", "2025-01-01", "")
    write_bronze(bronze_records(families["more"], "more"), f"{tmp_path}/bronze")
    back = {r.source_record_id: r for r in spark.read.parquet(f"{tmp_path}/bronze").collect()}
    assert json.loads(back["X1"].raw_payload) == {"note": "\u00e9", "other": ""} and str(back["X2"].snapshot_date) == "2025-06-01" and back["X1"].source == "more"


def test_search_over_current_entities(spark, layers, tmp_path):
    _, _, gold = layers
    folder = f"file://{tmp_path}/index"
    index, fresh = build(gold["entity_master_current"], folder)
    assert fresh and not build(gold["entity_master_current"], folder)[1]  # an equal fingerprint skips the work
    found = search_app.results(index, "north cape", 3)
    assert found[0]["rank"] == 1 and {f["entity_name"][:10] for f in found[:2]} == {"North Cape"} and found[0]["bm25_rank"] in (1, 2)
    renamed = gold["entity_master_current"].withColumn("entity_name", F.upper("entity_name"))
    assert build(renamed, folder)[1] and build(gold["entity_master_current"], folder, model="other")[1]
    assert search_app.answer(index, "/search?q=soleada&top_k=2")[1]["results"][0]["country_code"] == "ES"
    assert [search_app.answer(None, t)[0] for t in ("/health", "/search?q=x", "/search?q=", "/search?q=x&top_k=51", "/y")] == [200, 503, 422, 422, 404]
    assert "entity_name" in search_app.table_text(found)


def test_two_publishers_get_two_numbers(spark, tmp_path):
    root = f"file://{tmp_path}/sink"
    assert [claim_run(spark, root) for _ in range(3)] == [1, 2, 3]
