"""Settings as dataclasses, read from YAML or JSON files that override the defaults member by member."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any

from .operators.traces import ProjectionConfig


@dataclass(frozen=True)
class FieldMap:
    task_id: str = "task_id"
    intent: str = "intent"
    spans: str = "spans"
    app_name: str = "app_name"
    success: str = "success"
    score: str = "score"
    tools_used: str = "tools_used"
    agent_name: str = "agent_name"
    action: str = "action"
    observation: str = "observation"
    thoughts: str = "thoughts"


@dataclass(frozen=True)
class GateConfig:
    max_spans: int = 200
    require_success: bool = True


@dataclass(frozen=True)
class DatasetConfig:
    sampler: str = "random"
    negative_ratio: int = 3
    hard_ratio: float = 0.5
    weights: tuple[float, ...] = (0.4, 0.3, 0.3)
    seed: str = "neg"
    test_share: float = 0.2
    n_splits: int = 10


@dataclass(frozen=True)
class ModelConfig:
    kind: str = "gbt"
    encoder: str = "tfidf"
    max_terms: int = 5000
    top_k: int = 7
    holdout: float = 0.1  # of the rows, to stop boosting early by
    gbt: dict = field(default_factory=lambda: {"maxIter": 300, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 3, "seed": 42})
    forest: dict = field(default_factory=lambda: {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5, "seed": 42})
    logistic: dict = field(default_factory=lambda: {"c": 1.0, "maxIter": 1000})


@dataclass(frozen=True)
class RuntimeConfig:
    idle_s: float = 30.0
    settle_s: float = 2.0
    max_age_s: float = 300.0
    max_spans: int = 500
    remember_s: float = 600.0  # a closed trace's spans count as late for so long
    prefix: str = ""  # of the collector's own keys


@dataclass(frozen=True)
class Config:
    fields: FieldMap = FieldMap()
    projection: ProjectionConfig = ProjectionConfig()
    gate: GateConfig = GateConfig()
    dataset: DatasetConfig = DatasetConfig()
    model: ModelConfig = field(default_factory=ModelConfig)
    runtime: RuntimeConfig = RuntimeConfig()


def _names(base: Any) -> set[str]:
    return {f.name for f in fields(base)}


def merged(base: Any, over: dict) -> Any:
    """``base`` with the members in ``over``; nested dataclasses and dictionaries are merged, unknown members raise."""
    if isinstance(base, dict):
        return base | {k: merged(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}
    if unknown := set(over) - _names(base):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for k, v in over.items():
        old = getattr(base, k)
        if isinstance(v, dict) and (is_dataclass(old) or isinstance(old, dict)):
            v = merged(old, v)
        elif isinstance(old, tuple) and isinstance(v, list):
            v = tuple(v)
        new[k] = v
    return replace(base, **new)


def load(path: str | None = None) -> Config:
    if not path:
        return Config()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return merged(Config(), json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need PyYAML; JSON settings don't") from e
    return merged(Config(), yaml.safe_load(text) or {})


def dump(config: Config) -> dict:
    return asdict(config)
