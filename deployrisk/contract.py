"""The feature contract, fixed values and table schemas.

The word lists, medians, weights and limits below are fixed values: results only
match when they are exactly these.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- the ten features, in contract order (fixed values) ---------------------
FEATURES = [
    "diff_size",
    "files_changed",
    "hour_of_day",
    "day_of_week",
    "recent_failure_rate",
    "test_pass_rate",
    "is_hotfix",
    "deployer_exp",
    "days_since_deploy",
    "build_time_delta",
]

INT_FEATURES = [
    "diff_size",
    "files_changed",
    "hour_of_day",
    "day_of_week",
    "is_hotfix",
    "deployer_exp",
]

CLOCK_FEATURES = ["hour_of_day", "day_of_week"]

# --- medians used when a tenant has no usable history (fixed values) --------
TRAINING_MEDIANS = {
    "diff_size": 105.0,
    "files_changed": 4.0,
    "hour_of_day": 13.0,
    "day_of_week": 3.0,
    "recent_failure_rate": 0.261,
    "test_pass_rate": 0.819,
    "is_hotfix": 0.0,
    "deployer_exp": 27.0,
    "days_since_deploy": 2.7,
    "build_time_delta": 0.011,
}

# --- accepted ranges per feature; None means open (fixed values) ------------
RANGES = {
    "diff_size": (0, 50000),
    "files_changed": (0, 1000),
    "hour_of_day": (0, 23),
    "day_of_week": (0, 6),
    "recent_failure_rate": (0, 1),
    "test_pass_rate": (0, 1),
    "is_hotfix": (0, 1),
    "deployer_exp": (0, None),
    "days_since_deploy": (0, None),
}

# --- display names (fixed values) -------------------------------------------
CONTRACT_LABELS = {
    "diff_size": "Diff size (lines changed)",
    "files_changed": "Files changed",
    "hour_of_day": "Hour of day",
    "day_of_week": "Day of week",
    "recent_failure_rate": "Recent failure rate",
    "test_pass_rate": "Test pass rate",
    "is_hotfix": "Hotfix / emergency branch",
    "deployer_exp": "Deployer experience",
    "days_since_deploy": "Days since last deploy",
    "build_time_delta": "Build time delta",
}

DISPLAY_LABELS = {
    "diff_size": "Diff size (lines changed)",
    "files_changed": "Files changed",
    "hour_of_day": "Time of deploy",
    "day_of_week": "Day of week",
    "recent_failure_rate": "Recent failure rate",
    "test_pass_rate": "Test pass rate",
    "is_hotfix": "Hotfix branch",
    "deployer_exp": "Deployer experience",
    "days_since_deploy": "Days since last deploy",
    "build_time_delta": "Build time delta",
}

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- label provenance (fixed values) ----------------------------------------
LABEL_WEIGHTS = {
    "sentinel_degraded": 1.0,
    "sentinel_healthy": 1.0,
    "rollback": 1.0,
    "manual": 0.9,
    "ci_failure": 0.7,
    "ci_success": 0.6,
    "assumed_ok": 0.4,
    "synthetic": 1.0,
}
OBSERVED_SOURCES = ["sentinel_degraded", "sentinel_healthy", "rollback"]
LABEL_ALIASES = {
    "failure": "ci_failure",
    "success": "ci_success",
    "safe": "ci_success",
    "risky": "ci_failure",
    "seed": "synthetic",
    "synthetic": "synthetic",
}
DEFAULT_LABEL_SOURCE = "manual"
DEFAULT_LABEL_WEIGHT = 0.5

# --- thresholds and limits (fixed values) -----------------------------------
YELLOW = 40
RED = 70
HISTORY_RUNS = 10          # CI runs a history feature looks back over
MEDIAN_HISTORY = 50        # newest builds behind a tenant median
MEDIAN_MIN_ROWS = 8        # fewer usable values: no tenant median
MIN_BUILDS = 200           # labelled builds before a tenant is trained
MIN_TEST_ROWS = 40
MIN_TEST_RISKY = 5
MIN_PRECISION_LIFT = 1.5
MIN_PRECISION_ABS = 0.10
MIN_AUC = 0.70
MIN_RISKY_RATIO = 0.05
INCUMBENT_SLACK = 0.05
TRAIN_WINDOW_DAYS = 90
HOLDOUT_SHARE = 0.20
TRAIN_THROUGH_YEAR = 2016
DRIFT_RUN = 30             # builds on each side of the drift comparison
DRIFT_P_VALUE = 0.05
DRIFT_MIN_FEATURES = 3
RATE_LIMIT_PER_MINUTE = 120
DEFAULT_PHASE = "base"
DEFAULT_PRECISION = 0.851

# --- word lists (fixed values) ----------------------------------------------
HOTFIX_WORDS = ["hotfix", "urgent", "emergency", "revert", "rollback", "patch"]
HOTFIX_WORDS_V1 = ["hotfix", "hotfix/", "fix/", "patch/", "revert/", "emergency"]
OUTCOME_BRANCH_WORDS = ["hotfix", "fix/", "patch/", "revert/"]
OUTCOME_COMMIT_WORDS = ["revert", "rollback", "undo", "hotfix"]
CREDENTIAL_WORDS = [
    "api_key", "apikey", "secret", "password", "passwd",
    "token", "authorization", "cookie", "hash", "webhook",
]
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# --- schemas ----------------------------------------------------------------
BUILD_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("build_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("diff_size", T.IntegerType()),
    T.StructField("files_changed", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("recent_failure_rate", T.DoubleType()),
    T.StructField("test_pass_rate", T.DoubleType()),
    T.StructField("is_hotfix", T.IntegerType()),
    T.StructField("deployer_exp", T.IntegerType()),
    T.StructField("days_since_deploy", T.DoubleType()),
    T.StructField("build_time_delta", T.DoubleType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("branch_name", T.StringType()),
    T.StructField("triggered_by", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("predicted_score", T.IntegerType()),
    T.StructField("imputed", T.ArrayType(T.StringType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("label_source", T.StringType()),
    T.StructField("sample_weight", T.DoubleType()),
    T.StructField("label_observed", T.BooleanType()),
    T.StructField("labelled_at", T.LongType()),
])

COMMIT_COLUMNS = ["la", "ld", "nf", "fix", "aexp", "age", "buggy", "author_date", "project", "year"]
