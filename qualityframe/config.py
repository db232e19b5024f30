"""All thresholds and switches, with presets and a reproducible hash.

The numbers below are fixed values: results only agree with the established
behaviour when the defaults stay as they are.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field, replace

ADVISORY, HUMAN, AUTOMATIC = "advisory", "human", "automatic"
MODES = (ADVISORY, HUMAN, AUTOMATIC)


class ConfigError(ValueError):
    """A combination of settings that cannot be run."""


@dataclass(frozen=True)
class Profiling:
    text_mean_length: int = 50
    categorical_unique_count: int = 100
    categorical_unique_ratio: float = 0.1
    min_rows_numeric_behavior: int = 5
    outlier_iqr_multiplier: float = 1.5
    rare_category_threshold: float = 0.01
    semantic_min_confidence: float = 0.4
    semantic_weight_pattern: float = 0.7
    semantic_weight_keyword: float = 0.3
    semantic_sample_size: int | None = None  # None: the whole column
    min_rows_anomaly_detection: int = 20
    anomaly_contamination: str | float = "auto"
    anomaly_n_estimators: int = 50
    anomaly_tree_rows: int = 256  # sub-sample that grows a tree; every row is scored
    min_numeric_cols_for_correlation: int = 2
    global_seed: int = 42
    enable_ml: bool = True
    enable_correlation: bool = True
    correlation_method: str = "pearson"
    rounding: int = 4
    sample_correlation: bool = False  # False: correlate all rows
    sampling_threshold: int = 50000
    sample_size: int = 10000
    exact_distinct: bool = True  # False: HyperLogLog estimates
    exact_quantiles: bool = True  # False: Greenwald-Khanna estimates


@dataclass(frozen=True)
class Detection:
    missing: float = 0.2
    constant: float = 1.0
    duplicate: float = 0.1
    imbalance: float = 0.9
    skewness: float = 1.0
    correlation: float = 0.9
    pattern: float = 0.8
    outlier_ratio: float = 0.05
    zero_value: float = 0.3
    rare_category: float = 0.01
    min_value: float | None = None
    max_value: float | None = None
    drift: float = 0.2
    quasi_id: float = 0.8
    pii_confidence: float = 0.6
    bias: float = 0.9
    enable_ml: bool = True
    whole_word_keywords: bool = False
    boolean_imbalance: bool = False


@dataclass(frozen=True)
class Planning:
    issue_overrides: dict = field(default_factory=dict)  # issue type -> action type
    stop_on_block: bool = True
    zeros_as_null: bool = False
    flag_pattern_violations: bool = False


@dataclass(frozen=True)
class Config:
    mode: str = ADVISORY
    tracing: bool = False
    lineage: bool = False
    ml_enabled: bool = False
    profiling: Profiling = Profiling()
    detection: Detection = Detection()
    weights: dict = field(default_factory=dict)
    planning: Planning = Planning()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ConfigError(f"unknown mode {self.mode!r}; choose one of {MODES}")
        needs_trace = [
            name
            for name, on in (
                ("lineage", self.lineage),
                ("automatic mode", self.mode == AUTOMATIC),
                ("human mode", self.mode == HUMAN),
            )
            if on and not self.tracing
        ]
        if needs_trace:
            raise ConfigError(f"{', '.join(needs_trace)} needs tracing=True")

    def snapshot(self) -> dict:
        return dataclasses.asdict(self)

    def hash(self) -> str:
        text = json.dumps(self.snapshot(), sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def with_detection(self, **changes) -> Config:
        return replace(self, detection=replace(self.detection, **changes))

    def with_profiling(self, **changes) -> Config:
        return replace(self, profiling=replace(self.profiling, **changes))


def strict() -> Config:
    return Config(mode=AUTOMATIC, tracing=True, lineage=True, ml_enabled=True)


def advisory() -> Config:
    return Config(mode=ADVISORY, tracing=True, lineage=True, ml_enabled=True)


def fast() -> Config:
    return Config(profiling=Profiling(enable_ml=False, enable_correlation=False))
