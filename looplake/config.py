"""Frozen configuration.

Every knob the reference reads from its environment becomes a field here.

Fixed values: the defaults below must equal the reference's defaults for the
results to match (thresholds, weights, tiers, gates, cooldown formula).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # --- fixed values: training trigger / scope ---
    min_feedback_for_training: int = 10
    feedback_window_days: int = 30
    auto_batch_size: int = 10
    auto_batch_enabled: bool = True

    # --- fixed values: promotion guardrail ---
    promote_min_samples: int = 20
    promote_min_delta: float = 0.0
    promote_primary_metric: str = "cv_mean_f1_weighted"
    promote_max_cv_std: float = 999.0
    promote_require_baseline: bool = False

    # --- fixed values: cooldown after failures ---
    cooldown_base_seconds: int = 30
    cooldown_max_exponent: int = 5
    cooldown_cap_seconds: int = 900

    # --- fixed values: dataset size tiers ---
    tier_tiny: int = 20
    tier_small: int = 50
    tier_medium: int = 200
    tier_large: int = 1000

    # --- fixed values: quality threshold ---
    quality_fallback_threshold: float = 0.7
    quality_percentile: int = 25
    quality_min_threshold: float = 0.5

    # --- fixed values: feedback weighting ---
    feedback_delta_max: float = 0.4
    feedback_accept_strength: float = 1.0
    feedback_reject_strength: float = 1.0
    feedback_positive_max_weight: float = 2.0
    feedback_negative_min_weight: float = 0.51

    # --- fixed values: core memory mix and class completion ---
    core_memory_ratio: float = 0.2
    core_memory_quality_score: float = 0.2
    core_memory_max_rows: int = 5000
    completion_per_missing_class: int = 1
    completion_quality_score: float = 0.1

    # --- fixed values: validation, calibration, cross validation ---
    validation_strategy: str = "random"
    time_aware_min_samples: int = 30
    calibration_method: str = "none"
    calibration_min_samples: int = 50
    cv_max_folds: int = 5
    cv_repeats: int = 3

    # --- fixed values: warm start ---
    fine_tune: bool = True
    fine_tune_extra_trees: int = 20

    # --- fixed values: gates ---
    regression_tolerance: float = 0.01
    regression_min_feedback: int = 20
    regression_high_baseline: float = 0.99
    regression_high_tolerance: float = 0.35
    feedback_gate_tolerance: float = 0.05

    # --- fixed values: model parameters by tier ---
    n_estimators_small: int = 50
    n_estimators_medium: int = 100
    n_estimators_large: int = 200
    n_estimators_xlarge: int = 300
    max_depth_small: int = 5
    max_depth_medium: int = 8
    max_depth_large: int = 15
    min_split_small: int = 2
    min_split_medium: int = 5
    min_split_large: int = 10
    min_leaf_small: int = 1
    min_leaf_medium: int = 2
    min_leaf_large: int = 4
    max_feature_count: int = 100

    # --- fixed values: feature typing ---
    missing_value_threshold: float = 0.5
    max_unique_for_categorical: int = 20
    unique_ratio_threshold: float = 0.05

    # --- fixed values: monitoring ---
    reliable_metrics_min_samples: int = 80
    job_timeout_seconds: int = 300

    # --- fixed values: bootstrap CSV ---
    bootstrap_min_rows: int = 10

    seed: int = 42

    @classmethod
    def cluster(cls) -> "Config":
        """Overrides used by the reference's cluster training job.

        Fixed values: delta 0.25, strengths 0.8, max weight 1.5, min weight
        0.7, tolerances 0.02 / 0.25 / 0.03.
        """
        return replace(
            cls(),
            feedback_delta_max=0.25,
            feedback_accept_strength=0.8,
            feedback_reject_strength=0.8,
            feedback_positive_max_weight=1.5,
            feedback_negative_min_weight=0.7,
            regression_tolerance=0.02,
            regression_high_tolerance=0.25,
            feedback_gate_tolerance=0.03,
        )

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


# The fixed feature row, in order, and the label column.
FEATURES = (
    "animal_type",
    "gender",
    "age_months",
    "weight_kg",
    "temperature",
    "heart_rate",
    "current_season",
    "vaccination_status",
    "medical_history",
    "symptom_duration",
    "symptoms_list",
)
LABEL = "target_diagnosis"
NUMERIC_FEATURES = ("age_months", "weight_kg", "temperature", "heart_rate", "symptom_duration")
CATEGORICAL_FEATURES = ("animal_type", "gender", "current_season", "vaccination_status", "medical_history")

DEFAULT = Config()
