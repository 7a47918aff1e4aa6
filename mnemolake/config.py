"""Engine configuration: one frozen value, passed explicitly."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Defaults, overridden by a TOML file, overridden by environment variables (MNEMOLAKE_<FIELD>)."""

    dim: int = 384
    recency_half_life_days: float = 90.0
    surprise_weight: float = 0.4
    recency_weight: float = 0.35
    access_weight: float = 0.25
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    solution_query_boost: float = 0.08
    cooccurrence_boost: float = 1.10
    cooccurrence_min_count: int = 2
    dedup_similarity: float = 0.95
    cluster_similarity: float = 0.78
    min_cluster_size: int = 2
    max_cluster_episodes: int = 20
    topic_similarity: float = 0.84
    topic_title_overlap: float = 0.34
    topic_force_similarity: float = 0.9
    contradiction_similarity: float = 0.7
    contradiction_pairs: int = 24
    silent_drop_similarity: float = 0.5
    supersession_similarity: float = 0.5
    topic_threshold: float = 0.25
    record_threshold: float = 0.3
    claim_threshold: float = 0.3
    coherence_weight: float = 0.6
    surprise_confidence_weight: float = 0.4
    surprise_min: float = 0.1
    surprise_max: float = 1.0
    surprise_boost_per_access: float = 0.02
    surprise_boost_most: float = 0.15
    surprise_decay: float = 0.05
    surprise_idle_days: float = 7.0
    max_attempts: int = 5
    prune_days: int = 30
    challenge_ttl_hours: int = 168
    challenge_batch: int = 200
    keep_versions: int = 5
    model_attempts: int = 3
    model_failures: int = 3
    model_seconds: float = 1800.0
    index_from: int = 10_000
    index_probes: int = 8
    index_refit: float = 4.0
    compact_ratio: float = 0.2
    journal_openers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        if abs(self.vector_weight + self.keyword_weight - 1.0) > 1e-9:
            raise ValueError("vector_weight and keyword_weight must add up to 1")
        if not 0 <= self.surprise_min <= self.surprise_max <= 1:
            raise ValueError("surprise bounds must lie in order within 0 and 1")

    @classmethod
    def load(cls, path: str | Path | None = None, env: dict[str, str] | None = None) -> EngineConfig:
        """Defaults, then the file's [engine] table, then the environment."""
        env = dict(os.environ) if env is None else env
        found: dict[str, object] = {}
        if path is not None:
            found |= tomllib.loads(Path(path).read_text()).get("engine", {})
        kinds = {f.name: type(f.default) for f in fields(cls)}
        unknown = set(found) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, kind in kinds.items():
            if (raw := env.get(f"MNEMOLAKE_{name.upper()}")) is not None:
                found[name] = raw.split(";") if kind is tuple else kind(raw)
        return cls(**{k: kinds[k](v) for k, v in found.items()})

    def override(self, **changes: object) -> EngineConfig:
        return replace(self, **changes)


DEFAULTS = EngineConfig()
