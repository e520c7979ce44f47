"""Defaults, and overrides from JSON, TOML or YAML files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Binning:
    n_bins: int = 5
    buckets: int = 10
    epsilon: float = 1e-8


@dataclass(frozen=True)
class Filtering:
    iv_threshold: float = 0.02
    missing_threshold: float = 0.9
    corr_threshold: float = 0.8
    psi_threshold: float = 0.25
    vif_threshold: float = 10.0


@dataclass(frozen=True)
class Modeling:
    p_enter: float = 0.05
    p_remove: float = 0.10
    threshold: float = 0.5


@dataclass(frozen=True)
class Points:
    pdo: float = 20.0
    base_score: float = 600.0
    base_odds: float = 1.0


@dataclass(frozen=True)
class Spark:
    stretches: int = 64
    max_values: int = 2_000_000


@dataclass(frozen=True)
class Config:
    binning: Binning = Binning()
    filtering: Filtering = Filtering()
    modeling: Modeling = Modeling()
    points: Points = Points()
    spark: Spark = Spark()


def load_conf(path: str, base: Config | None = None) -> Config:
    """base (or the defaults) with the file's sections; unknown sections and keys are errors."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if kind == ".json":
        held = json.loads(text)
    elif kind == ".toml":
        held = tomllib.loads(text)
    elif kind in (".yaml", ".yml"):
        import yaml

        held = yaml.safe_load(text) or {}
    else:
        raise ValueError(f"unknown kind of configuration: {kind!r}")
    out = base or Config()
    for section, values in held.items():
        if section not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown section {section!r}")
        own = getattr(out, section)
        unknown = set(values) - {f.name for f in fields(own)}
        if unknown:
            raise ValueError(f"unknown keys in {section!r}: {sorted(unknown)}")
        out = replace(out, **{section: replace(own, **values)})
    return out
