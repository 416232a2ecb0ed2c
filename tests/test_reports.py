from __future__ import annotations

import json

import numpy as np
import pytest

from ledgerloom.operators import features, scoring
from ledgerloom.operators.history import last_of_snapshot
from ledgerloom.plans import evaluation
from ledgerloom.plans.connection import Connection, is_private
from ledgerloom.sources.tables import write_jsonl

RATES = {"BENCHMARK_SKLEARN_USD_PER_HOUR": 0.2, "BENCHMARK_LORA_TRAIN_USD_PER_HOUR": 1.0, "BENCHMARK_LORA_INFER_USD_PER_HOUR": 1.0, "BENCHMARK_LORA_AMORTIZATION_SAMPLES": 10_000}


def test_report_without_an_adapter(tmp_path):
    found = evaluation.report(evaluation.Run(0.82, {"operating": 0.9}, 1.0, 0.4, healthy=True), evaluation.Run(), 60, RATES)
    assert found["sklearn"]["training_estimated_cost_usd"] == round(1 / 3600 * 0.2, 8) and found["sklearn"]["cost_proxy"] == 0.4
    assert found["lora"]["available"] is False and found["lora"]["cost_per_sample_usd"] is None and set(found["comparison"].values()) == {None}
    assert "adapter absent" in found["quality_latency_tradeoff_summary"]
    evaluation.write(found, tmp_path / "a/report.json")
    assert json.loads((tmp_path / "a/report.json").read_text())["schema_version"] == "2"


def test_report_with_an_adapter_and_with_a_failed_one():
    plain = evaluation.Run(0.8, {}, 1.0, 0.5)
    tuned = evaluation.Run(0.9, {}, 3600.0, 5.0, 2.0, True, True, 58, 2, {"train_usd_per_hour": 2.0})
    found = evaluation.report(plain, tuned, 60, RATES)
    assert found["comparison"] == {"accuracy_delta_lora_minus_sklearn": 0.1, "runtime_ratio_lora_to_sklearn": 10.0, "cost_ratio_lora_to_sklearn": pytest.approx(50, rel=0.01)}
    assert found["lora"]["effective_train_usd_per_hour"] == 2.0 and found["lora"]["amortized_cost_per_sample_usd"] == pytest.approx(2 / 10_000 + 5 / 3600 / 60, abs=1e-6)
    failed = evaluation.report(plain, evaluation.Run(None, None, 10.0, 5.0, present=True, healthy=False), 60, RATES)
    assert failed["lora"]["estimated_cost_usd"] is not None and set(failed["comparison"].values()) == {None} and "inference failed" in failed["quality_latency_tradeoff_summary"]


def test_failed_rows_are_left_out_of_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", None)], "y string, p string")
    assert evaluation.score(rows, "y", "p") == {"accuracy": 0.5, "f1_per_class": {"a": 0.666667, "b": 0.0}, "succeeded": 2, "failed": 1}
    assert evaluation.score(rows.filter("p is null"), "y", "p")["accuracy"] is None


def make_scorer():
    def scorer(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("a row the model can't take")
        return np.array([[float("good" in p), 0.0] if "odd" not in p else [np.nan, 0.0] for p in prompts])

    return scorer


def test_label_scores(spark):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["good", "bad", "plain", "odd", None])], "asset_id string, prompt string").coalesce(1)
    got = {r.asset_id: (r.stage, r.confidence) for r in scoring.score_labels(rows, ["yes", "no"], make_scorer, chunk=3).collect()}
    assert got["0"] == ("yes", pytest.approx(np.e / (1 + np.e))) and got["1"] == got["3"] == (None, None) and got["2"] == ("yes", 0.5) and got["4"][0] == "yes"


def test_adapter_check(tmp_path):
    root, outside = tmp_path / "models", tmp_path / "outside"
    for folder in (root / "a", outside):
        folder.mkdir(parents=True)
        (folder / "adapter_config.json").write_text(json.dumps({"base_model_name_or_path": "base"}))
        (folder / "adapter_metadata.json").write_text(json.dumps({"revision": "r1"}))
    assert scoring.check_adapter(root / "a", root, "base", "r1") == (root / "a").resolve()
    (root / "link").symlink_to(outside)
    for folder, base, revision, says in [
        (root / "link", "base", "r1", "outside"), (root / "..", "base", "r1", "outside"), (root / "none", "base", "r1", "no folder"),
        (root / "a", "other", "r1", "pinned"), (root / "a", "base", "r2", "pinned"),
    ]:
        with pytest.raises(ValueError, match=says):
            scoring.check_adapter(folder, root, base, revision)
    (root / "a/adapter_metadata.json").write_text("{")
    with pytest.raises(ValueError, match="unreadable"):
        scoring.check_adapter(root / "a", root, "base", "r1")


def test_connection_policy():
    names = {"inner": ["10.1.2.3"], "mixed": ["10.1.2.3", "8.8.8.8"], "v6": ["fd00::1"], "none": []}
    assert [is_private(h, names.get) for h in names] == [True, False, True, False]
    Connection("jdbc:x://localhost/db", "localhost").check()
    Connection("jdbc:x://far/db", "far", secure=True).check()
    Connection("jdbc:x://inner/db", "inner", allow_private_plaintext=True).check(names.get)
    for bad in (Connection("jdbc:x://inner/db", "inner"), Connection("jdbc:x://mixed/db", "mixed", allow_private_plaintext=True)):
        with pytest.raises(ValueError, match="TLS"):
            bad.check(names.get)


def test_last_of_snapshot_takes_the_last_row(spark):
    rows = spark.createDataFrame([("k", "d1", "r1", 1), ("k", "d1", "r2", 2), ("k", "d2", "r0", 3)], "key string, snapshot_date string, source_record_id string, v int")
    got = {(r.snapshot_date, r.v) for r in last_of_snapshot(rows, ["key"], ["source_record_id"]).collect()}
    assert got == {("d1", 2), ("d2", 3)}


def test_instructions_as_json_lines(spark, tmp_path):
    values = {c: (None if c == "latitude" else 1.5) for c in features.FEATURES}
    row = spark.createDataFrame([(*values.values(), "operating")], ", ".join(f"{c} double" for c in features.FEATURES) + ", lifecycle_stage string")
    write_jsonl(features.instructions(row), f"{tmp_path}/out")
    found = [json.loads(line) for file in (tmp_path / "out").glob("*.json") for line in file.read_text().splitlines()]
    assert len(found) == 1 and found[0]["completion"] == "operating" and "  latitude: unknown\n" in found[0]["prompt"] and found[0]["prompt"].endswith("Lifecycle stage:")
