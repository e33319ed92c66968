"""Names, bounds, schemas and fixed numbers shared by every module."""

from pyspark.sql import types as T

# The seven metrics in payload order, each with its allowed range (None = unbounded).
METRIC_BOUNDS = {
    "cpu_usage": (0, 100),
    "memory_usage": (0, 100),
    "request_latency_ms": (0, None),
    "requests_per_sec": (0, None),
    "error_rate": (0, 1),
    "db_connections": (0, None),
    "disk_usage": (0, 100),
}
METRICS = list(METRIC_BOUNDS)

# Window lengths, split ratios and cut-offs.
HISTORY_ROWS = 10
FLAT_STD = 1e-4
SEQUENCE_ROWS = 20
TREND_ROWS = 5
TRAIN_RATIO = 0.80
EARLY_PROGRESS = 0.5
RESOLVE_AFTER_SECONDS = 120.0
SUMMARY_WINDOW = "5 minutes"
TOP_METRICS = 3
SEVERITY_BY_PROBABILITY = {"CRITICAL": 0.50, "WARNING": 0.20}
SEVERITIES = ["INFO", "WARNING", "CRITICAL"]
INTENSITY_MILD_BELOW = 0.62
INTENSITY_MODERATE_BELOW = 0.85
OFF_HOURS_BELOW = 0.55

# The labelled scenario catalogue, name by category.
SCENARIOS = {
    "spike": ["cpu_spike", "error_burst"],
    "plateau": ["cpu_exhaustion", "db_pool_exhaustion", "disk_full"],
    "trend": ["memory_leak", "disk_filling", "latency_creep"],
    "cliff": ["memory_exhaustion"],
    "dip": ["traffic_drop", "network_packet_loss"],
    "flatline": ["service_flatline"],
    "variance": ["noisy_neighbor", "intermittent_failure"],
    "level_shift": ["deployment_regression"],
    "correlation_break": ["slow_query_storm", "cache_failure", "zombie_process"],
    "surge": ["traffic_surge", "ddos_attack", "retry_storm"],
    "contextual": ["off_hours_surge"],
    "transient": ["cold_start"],
}

# The phrase used for a feature that pushed a prediction up or down.
REASONS = {
    "votes": (
        "an unusually high number of detectors agreed something was wrong",
        "only a few detectors flagged anything unusual",
    ),
    "zscore_value": (
        "the readings were far outside their normal statistical range",
        "the readings stayed close to their normal statistical range",
    ),
    "iforest_score": (
        "the overall combination of metrics looked highly unusual to the pattern-detection model",
        "the overall combination of metrics looked fairly typical",
    ),
    "lstm_error": (
        "the recent sequence of readings didn't match any normal pattern the system has learned",
        "the recent sequence of readings still resembled normal patterns",
    ),
}

# The parts of an explanation sentence.
SENTENCE_START = "This incident looks "
SENTENCE_VERDICTS = ("likely to become severe", "unlikely to become severe")
SENTENCE_CONFIDENCE = (" (", " confidence)")
SENTENCE_REASONS = (", mainly because ", ", and ", ". A smaller factor: ")
SENTENCE_END = "."

# The daily load curve, its lowest value and its peak hour (UTC).
LOAD_FLOOR = 0.3
LOAD_PEAK_HOUR = 14.0

# Settings of the detectors and of the escalation classifier.
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.10
BOOSTED_TREES = 100
BOOSTED_DEPTH = 3
BOOSTED_STEP = 0.1
SEED = 42
ZSCORE_GRID = (1.0, 6.0, 0.25)
FOREST_GRID_POINTS = 40
SEQUENCE_GRID = (60, 50.0, 99.5)

# Inputs of the escalation classifier, in order.
ESCALATION_FEATURES = ["votes", "ensemble_score", "zscore_value", "iforest_score", "lstm_error"]

DERIVED = ["rolling_avg", "z_score", "rate_of_change"]
FEATURES = [name for m in METRICS for name in (m, *(f"{m}_{d}" for d in DERIVED))]
Z_SCORES = [f"{m}_z_score" for m in METRICS]

PAYLOAD = T.StructType([
    T.StructField("service_name", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("metrics", T.StructType([
        T.StructField(m, T.LongType() if m == "db_connections" else T.DoubleType()) for m in METRICS
    ])),
])

TRUTH = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("intensity", T.DoubleType()),
    T.StructField("progress", T.DoubleType()),
    T.StructField("episode_id", T.StringType()),
    T.StructField("hour_utc", T.DoubleType()),
    T.StructField("tod_factor", T.DoubleType()),
])


def scenario_catalogue(spark):
    """The scenario catalogue as a DataFrame (name, category)."""
    rows = [(name, category) for category, names in SCENARIOS.items() for name in names]
    return spark.createDataFrame(rows, "name string, category string")
