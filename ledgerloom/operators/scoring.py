"""Labels by a language model's likelihoods, behind a seam that any scorer fits.

A scorer is a function from prompts to one row of log-likelihoods for each, a column per label. Prompts
go to it in chunks; a chunk that fails is tried again row by row, and a row that fails alone has no label. No
model is part of this package, so scorers are the caller's, checked first by :func:`check_adapter`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[Sequence[str]], np.ndarray]
CHUNK = 32


def softmax(rows: np.ndarray) -> np.ndarray:
    e = np.exp(rows - rows.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_chunk(prompts: Sequence[str], labels: Sequence[str], scorer: Scorer) -> list[tuple[str, float] | None]:
    """Best label and its share of the likelihood for each prompt; None where scoring fails or isn't finite."""

    def attempt(some: Sequence[str]) -> list[tuple[str, float] | None]:
        found = np.asarray(scorer(some), dtype=float)
        if found.shape != (len(some), len(labels)):
            raise ValueError(f"the scorer gave {found.shape} for {len(some)} prompts and {len(labels)} labels")
        ok = np.isfinite(found).all(axis=1)
        share = softmax(np.where(ok[:, None], found, 0.0))
        return [(labels[int(row.argmax())], float(row.max())) if good else None for row, good in zip(share, ok, strict=True)]

    try:
        return attempt(prompts)
    except Exception:  # whatever a model raises; each row gets a try of its own
        out: list[tuple[str, float] | None] = []
        for prompt in prompts:
            try:
                out += attempt([prompt])
            except Exception:
                out.append(None)
        return out


def score_labels(prompts: DataFrame, labels: Sequence[str], load: Callable[[], Scorer], id_col: str = "asset_id", prompt_col: str = "prompt", chunk: int = CHUNK) -> DataFrame:
    """(id, stage, confidence) of every row of ``prompts``; ``load`` makes the scorer, once in each task. Failed rows have nulls."""
    kind = prompts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            found: list[tuple[str, float] | None] = []
            texts = batch[prompt_col].fillna("").tolist()
            for at in range(0, len(texts), chunk):
                found += score_chunk(texts[at : at + chunk], labels, scorer)
            yield pd.DataFrame({id_col: batch[id_col], "stage": [f and f[0] for f in found], "confidence": [f and f[1] for f in found]})

    return prompts.select(id_col, prompt_col).mapInPandas(run, f"{id_col} {kind}, stage string, confidence double")


def check_adapter(folder: str | Path, trusted_root: str | Path, base_model: str, revision: str) -> Path:
    """The real folder of an adapter that may be loaded; anything doubtful is an error.

    It must lie below the trusted root once links are followed, be made for the pinned base model, and hold metadata
    that names the pinned revision.
    """
    root, real = Path(trusted_root).resolve(), Path(folder).resolve()
    if not root.is_dir():
        raise ValueError(f"no trusted folder at {root}")
    if real == root or not real.is_relative_to(root):
        raise ValueError(f"{folder} leads outside the trusted folder {root}")
    if not real.is_dir():
        raise ValueError(f"{real} is no folder")

    def read(name: str) -> dict:
        try:
            found = json.loads((real / name).read_text(encoding="utf-8"))
        except (OSError, ValueError) as error:
            raise ValueError(f"{name} of {real} is missing or unreadable: {error}") from error
        if not isinstance(found, dict):
            raise ValueError(f"{name} of {real} holds no object")
        return found

    for name, field, pinned in (("adapter_config.json", "base_model_name_or_path", base_model), ("adapter_metadata.json", "revision", revision)):
        held = read(name).get(field)
        if held != pinned:
            raise ValueError(f"{name} names {field} {held!r}, not the pinned {pinned!r}")
    return real
