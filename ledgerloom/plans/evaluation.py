"""Evaluation reports: two backends side by side, in quality, time and cost."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import metrics

# Names in the report.
PRICING_PROFILE = "benchmark_local_equivalent_v1"
COST_UNIT = "compute_seconds"
COST_METHOD = "equivalent_cloud_rate_card"
FAILURE_POLICY = "exclude_failed"
NOTES = "Equivalent benchmark rates for local runs; not actual billed cloud cost."


@dataclass
class Run:
    """What was measured of a backend; None where it was not."""

    accuracy: float | None = None
    f1_per_class: dict[str, float] | None = None
    training_s: float | None = None
    inference_s: float | None = None
    load_s: float | None = None
    present: bool = False
    healthy: bool | None = None
    succeeded: int | None = None
    failed: int | None = None
    stored: Mapping[str, object] = field(default_factory=dict)

    @property
    def available(self) -> bool:
        return self.accuracy is not None


def score(predicted: DataFrame, label: str, guess: str) -> dict:
    """Accuracy and F1 by class over rows that have a prediction, and how many had one or none."""
    scored = predicted.filter(F.col(guess).isNotNull())
    counts = predicted.agg(F.count(guess).alias("ok"), F.count("*").alias("n")).first()
    if not counts.ok:
        return {"accuracy": None, "f1_per_class": None, "succeeded": 0, "failed": counts.n}
    by_class = metrics.per_class(scored, label, guess).collect()  # one row per class
    return {
        "accuracy": metrics.accuracy(scored, label, guess).first().accuracy,
        "f1_per_class": {r["class"]: r.f1 for r in sorted(by_class, key=lambda r: r["class"])},
        "succeeded": counts.ok,
        "failed": counts.n - counts.ok,
    }


def _costs(run: Run, train_rate: float, infer_rate: float, samples: int) -> dict:
    """Costs of whatever time was spent, also where no prediction came of it."""
    out: dict[str, float | None] = {}
    for name, seconds, rate in (("training_", run.training_s, train_rate), ("", run.inference_s, infer_rate)):
        out[f"{name}cost_proxy"] = None if seconds is None else metrics.cost_proxy(seconds)
        out[f"{name}estimated_cost_usd"] = None if seconds is None else metrics.estimated_cost(seconds, rate)
    spent = out["estimated_cost_usd"]
    out["cost_per_sample_usd"] = None if spent is None else metrics.cost_per_sample(spent, samples)
    return out


def _rounded(value: float | None) -> float | None:
    return None if value is None else round(value, 4)


def baseline_section(run: Run, rates: Mapping[str, float], samples: int) -> dict:
    rate = rates["BENCHMARK_SKLEARN_USD_PER_HOUR"]
    measured = {"accuracy": _rounded(run.accuracy), "f1_per_class": run.f1_per_class, "training_runtime_s": run.training_s, "runtime_s": run.inference_s}
    return measured | _costs(run, rate, rate, samples)


def adapter_section(run: Run, rates: Mapping[str, float], samples: int) -> dict:
    train_rate = float(run.stored.get("train_usd_per_hour", rates["BENCHMARK_LORA_TRAIN_USD_PER_HOUR"]))
    share = int(rates["BENCHMARK_LORA_AMORTIZATION_SAMPLES"])
    costs = _costs(run, train_rate, rates["BENCHMARK_LORA_INFER_USD_PER_HOUR"], samples)
    trained, each = costs["training_estimated_cost_usd"], costs["cost_per_sample_usd"]
    return {
        "adapter_present": run.present,
        "inference_healthy": run.healthy,
        "successful_predictions": run.succeeded,
        "failed_predictions": run.failed,
        "partial_failure_scoring_policy": FAILURE_POLICY,
        "available": run.available,
        "accuracy": _rounded(run.accuracy),
        "f1_per_class": run.f1_per_class,
        "training_runtime_s": run.training_s,
        "model_load_s": _rounded(run.load_s),
        "runtime_s": run.inference_s,
        **costs,
        "amortized_cost_per_sample_usd": None if trained is None or each is None else round(metrics.amortized_cost(trained, each, share), 10),
        "training_amortization_samples": share,
        "effective_train_usd_per_hour": train_rate,
    }


def _ratio(top: float | None, bottom: float | None) -> float | None:
    return round(top / bottom, 4) if top is not None and bottom else None


def summary(baseline: dict, adapter: dict, comparison: dict) -> str:
    """The trade-off in one sentence."""
    if not adapter["available"]:
        why = "present but " + ("inference failed" if adapter["inference_healthy"] is False else "unknown") if adapter["adapter_present"] else "absent"
        each = baseline["cost_per_sample_usd"]
        price = "" if each is None else f", ${each:.6f} a sample"
        return f"baseline only: accuracy {baseline['accuracy']:.4f}, inference {baseline['runtime_s']:.4f} s{price}; adapter {why}."
    change = comparison["accuracy_delta_lora_minus_sklearn"]
    parts = [f"the adapter {'improved' if change >= 0 else 'decreased'} accuracy by {abs(change):.4f}"]
    for name, key in (("time", "runtime_ratio_lora_to_sklearn"), ("cost a sample", "cost_ratio_lora_to_sklearn")):
        if comparison[key] is not None:
            parts.append(f"{name} {comparison[key]:.1f} times the baseline's")
    return "; ".join(parts) + "."


def report(baseline: Run, adapter: Run, samples: int, rates: Mapping[str, float] | None = None, schema_valid: bool = True) -> dict:
    """The nested report. Ratios are given only where the adapter's predictions are there to compare."""
    rates = metrics.load_rates() if rates is None else rates
    plain, tuned = baseline_section(baseline, rates, samples), adapter_section(adapter, rates, samples)
    there = adapter.available
    comparison = {
        "accuracy_delta_lora_minus_sklearn": round(adapter.accuracy - baseline.accuracy, 4) if there else None,
        "runtime_ratio_lora_to_sklearn": _ratio(adapter.inference_s, baseline.inference_s) if there else None,
        "cost_ratio_lora_to_sklearn": _ratio(tuned["cost_per_sample_usd"], plain["cost_per_sample_usd"]) if there else None,
    }
    return {
        "schema_version": "2",
        "report_timestamp": datetime.now(timezone.utc).isoformat(),
        "test_samples": samples,
        "cost_estimate_method": COST_METHOD,
        "pricing_profile": PRICING_PROFILE,
        "pricing_assumptions": {
            "sklearn_usd_per_hour": rates["BENCHMARK_SKLEARN_USD_PER_HOUR"],
            "lora_train_usd_per_hour": tuned["effective_train_usd_per_hour"],
            "lora_infer_usd_per_hour": rates["BENCHMARK_LORA_INFER_USD_PER_HOUR"],
            "lora_amortization_samples": tuned["training_amortization_samples"],
            "notes": NOTES,
            "stored_pricing_profile": adapter.stored.get("pricing_profile"),
            "stored_pricing_notes": adapter.stored.get("pricing_notes"),
        },
        "cost_proxy_unit": COST_UNIT,
        "sklearn": plain,
        "lora": tuned,
        "comparison": comparison,
        "quality_latency_tradeoff_summary": summary(plain, tuned, comparison),
        "schema_valid": schema_valid,
    }


def write(found: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, indent=2), encoding="utf-8")
