"""Configuration: dataclasses, loaded from YAML or JSON with a deep-merged override."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Features:
    raw: tuple[str, ...] = ()
    residual_targets: tuple[str, ...] = ()
    residual_inputs: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    residual_weight_ratio: float = 0.5
    column_aliases: dict[str, str] = field(default_factory=dict)
    plan_center_cols: tuple[str, ...] = ()
    load_col: str = "load"
    eff_col: str = "eff"
    date_col: str = "date"

    @property
    def residuals(self) -> tuple[str, ...]:
        return tuple(f"resid_{t}" for t in self.residual_targets)

    @property
    def similarity(self) -> tuple[str, ...]:
        """Columns of the similarity vector, in order."""
        return self.raw + self.residuals


@dataclass(frozen=True)
class Matching:
    d_weight_s: float = 1.0
    d_weight_e: float = 0.0
    top_k: int = 5
    plan_center_mode: int = 2
    topk_avg_method: str = "weighted"
    low_sim_fallback_threshold: float = 0.75
    enable_low_sim_fallback: bool = True
    allow_fallback_nearest_load: bool = False


@dataclass(frozen=True)
class Gate:
    enable: bool = True
    mode: str = "absolute"
    abs_threshold: float = 15.0
    rel_threshold: float = 0.05


@dataclass(frozen=True)
class Continuity:
    enable_rate_limit: bool = False
    rate_limits: dict[str, float] = field(default_factory=dict)
    reset_on_time_gap: bool = True
    max_gap_minutes: float = 5.0


@dataclass(frozen=True)
class Training:
    filter_cols: tuple[str, ...] = ()
    filter_q_low: float = 0.02
    filter_q_high: float = 0.98
    filter_bins: int = 15
    max_bad_features: int = 2
    strata_bins: dict[str, int] = field(default_factory=dict)
    train_ratio: float = 0.70
    valid_ratio: float = 0.15
    oof_n_splits: int = 5
    seed: int = 42
    reg_lambda: float = 1e-6
    #: linear, or trees with the parameters after it.
    model: str = "linear"
    max_iter: int = 200
    learning_rate: float = 0.05
    max_depth: int = 6
    min_samples_leaf: int = 20
    l2: float = 1.0


@dataclass(frozen=True)
class Sequence:
    ref_days: float = 3.0
    query_len: int = 5
    candidate_len: int = 6
    slide_step: int = 1
    prefilter_step: int = 1
    top_k: int = 5
    band: int = 2
    min_coverage: int = 4
    prefilter: bool = True
    load_threshold: float = 15.0
    sim_threshold: float = 0.7


@dataclass(frozen=True)
class Config:
    features: Features = Features()
    matching: Matching = Matching()
    gate: Gate = Gate()
    continuity: Continuity = Continuity()
    training: Training = Training()
    sequence: Sequence = Sequence()
    time_col: str | None = None


def deep_merge(base: Mapping[str, Any], override: Mapping[str, Any]) -> dict[str, Any]:
    """``override`` laid over ``base``; mappings merge, everything else replaces."""
    out = dict(base)
    for key, value in override.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = deep_merge(out[key], value) if both else value
    return out


def _build(kind: type, values: Mapping[str, Any]):
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    made = {}
    for key, value in values.items():
        default = getattr(kind(), key)
        if is_dataclass(default):
            value = _build(type(default), value or {})
        elif isinstance(default, tuple):
            value = tuple(value or ())
        made[key] = value
    return kind(**made)


# The names that shipped configuration files use for sections and keys, by ours. A key
# with "" and a section of SKIPPED hold nothing that a plan depends on: paths, worker counts, weight searches.
SECTIONS = {"flow_gate": "gate", "train": "training", "dtw_query": "sequence"}
SKIPPED = ("paths", "optimize", "optimize_genetic", "optimize_v2")
KEYS = {
    "features": {"raw_features": "raw", "heat_value_col": ""},
    "training": {"filter_n_bins": "filter_bins", "filter_max_bad_features": "max_bad_features", "test_ratio": "", "input_parquet": "", "output_dir": "", "enable_stratified_split": "", "l2_regularization": "l2", "random_state": "seed"},
    "sequence": {"query_seq_len": "query_len", "dtw_max_len": "candidate_len", "dtw_min_len": "", "sakoe_chiba_w": "band", "resid_cache_parquet": "", "dtw_feature_weights": "", "n_workers": ""},
}


def translated(values: Mapping[str, Any]) -> dict[str, Any]:
    """A configuration with our names for one with the shipped names; our own names stay."""
    out: dict[str, Any] = {}
    for section, content in values.items():
        if section in SKIPPED:
            continue
        name = SECTIONS.get(section, section)
        if isinstance(content, Mapping):
            content = dict(content)
            if name == "training":
                content |= content.pop("residual_model_params", None) or {}
                if not content.pop("enable_filter", True):
                    content["filter_cols"] = ()
            if name == "sequence" and isinstance(before := content.get("prefilter"), Mapping):
                content |= {"prefilter": before.get("enable", True), "prefilter_step": before.get("slide_step", 1)} | {k: before[k] for k in ("load_threshold", "sim_threshold") if k in before}
            if name == "continuity" and "rate_limit_abs" in content:
                limits = content.pop("rate_limit_abs") or {}
                content["rate_limits"] = {c: limits[c] for c in content.pop("rate_limit_features", limits) if c in limits}
            names = KEYS.get(name, {})
            content = {names.get(k, k): v for k, v in content.items() if names.get(k, k)}
        out[name] = content
    return out


def load_config(path: str | None = None, override: Mapping[str, Any] | None = None) -> Config:
    """Reads YAML (needs PyYAML) or JSON, with our names or the shipped ones; without a path the defaults.
    ``override`` wins. A section or key that is neither known nor listed as skipped is an error."""
    values: dict[str, Any] = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            values = json.loads(text)
        else:
            import yaml

            values = yaml.safe_load(text) or {}
    config = _build(Config, deep_merge(translated(values), translated(override or {})))
    validate(config)
    return config


def validate(config: Config) -> None:
    """Raises ValueError with all violated rules."""
    f, m, problems = config.features, config.matching, []
    if not m.d_weight_s and not m.d_weight_e:
        problems.append("d_weight_s and d_weight_e are both 0")
    if extra := set(f.plan_center_cols) - set(f.raw) - {f.load_col}:
        problems.append(f"plan centre columns that are no features: {sorted(extra)}")
    if extra := set(f.residual_targets) - set(f.raw):
        problems.append(f"residual targets that are no features: {sorted(extra)}")
    if config.gate.mode not in ("absolute", "relative"):
        problems.append(f"unknown gate mode {config.gate.mode!r}")
    if m.plan_center_mode not in (1, 2) or m.topk_avg_method not in ("mean", "weighted"):
        problems.append("unknown plan centre mode or averaging method")
    if any(limit < 0 for limit in config.continuity.rate_limits.values()):
        problems.append("a rate limit is negative")
    if problems:
        raise ValueError("; ".join(problems))


def feature_weights(features: Features) -> dict[str, float]:
    """Weights of the similarity columns: a residual has its target's weight times the ratio."""
    own = {c: float(features.weights.get(c, 0.0)) for c in features.raw}
    return own | {f"resid_{t}": own.get(t, 0.0) * features.residual_weight_ratio for t in features.residual_targets}


def weight_vector(columns, weights: Mapping[str, float]) -> list[float]:
    """Weights in column order, negative ones as 0, with sum 1. Raises ValueError if all are 0."""
    clipped = [max(0.0, float(weights.get(c, 0.0))) for c in columns]
    if sum(clipped) <= 1e-12:
        raise ValueError("all weights are 0")
    return [w / sum(clipped) for w in clipped]
