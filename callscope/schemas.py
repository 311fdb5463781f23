"""Table schemas, model feature order and other fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TENANTS = _struct(("id", _S), ("name", _S), ("status", _S), ("created_at", _TS), ("updated_at", _TS))

API_CLIENTS = _struct(
    ("id", _S),
    ("tenant_id", _S),
    ("name", _S),
    ("api_key_prefix", _S),
    ("api_key_hash", _S),
    ("status", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("last_used_at", _TS),
)

GATEWAY_ROUTES = _struct(
    ("id", _S),
    ("tenant_id", _S),
    ("name", _S),
    ("gateway_path", _S),
    ("upstream_url", _S),
    ("allowed_methods", T.ArrayType(_S)),
    ("timeout_ms", _I),
    ("authentication_required", _B),
    ("active", _B),
    ("created_at", _TS),
    ("updated_at", _TS),
)

RATE_LIMIT_POLICIES = _struct(
    ("id", _S),
    ("tenant_id", _S),
    ("api_client_id", _S),
    ("route_id", _S),
    ("bucket_capacity", _D),
    ("refill_rate", _D),
    ("enabled", _B),
    ("created_at", _TS),
    ("updated_at", _TS),
)

REQUEST_LOGS = _struct(
    ("id", _S),
    ("request_id", _S),
    ("tenant_id", _S),
    ("client_id", _S),
    ("route_id", _S),
    ("method", _S),
    ("status_code", _I),
    ("latency_ms", _L),
    ("blocked", _B),
    ("created_at", _TS),
)

KNOWLEDGE_CHUNKS = _struct(
    ("id", _L),
    ("tenant_id", _S),
    ("source_type", _S),
    ("source_id", _S),
    ("source_name", _S),
    ("section", _S),
    ("content", _S),
    ("chunk_index", _I),
    ("metadata", T.MapType(_S, _S)),
    ("embedding", T.ArrayType(T.FloatType())),
    ("content_hash", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
)

FEATURE_KEYS = ("tenant_id", "client_id", "route_id")
FEATURE_SCHEMA_VERSION = "traffic-v1"
FORECAST_SCHEMA_VERSION = "forecast-v1"

# The ordered model inputs.
MODEL_FEATURES = (
    "requests_per_minute",
    "success_count",
    "error_rate",
    "401_rate",
    "403_rate",
    "429_rate",
    "5xx_rate",
    "blocked_count",
    "average_latency_ms",
    "p50_latency_ms",
    "p95_latency_ms",
    "max_latency_ms",
    "unique_methods",
    "request_rate_change",
)

# Scenario labels (0 normal, 1 anomalous).
SCENARIO_LABELS = {
    "NORMAL": 0,
    "TRAFFIC_SPIKE": 1,
    "HIGH_401_RATE": 1,
    "HIGH_429_RATE": 1,
    "HIGH_5XX_RATE": 1,
    "HIGH_LATENCY": 1,
    "SINGLE_CLIENT_BURST": 1,
    "MIXED_ANOMALY": 1,
}

TRAINING_DATASET = T.StructType(
    [T.StructField(name, _D, True) for name in MODEL_FEATURES]
    + [
        T.StructField("scenario", _S, True),
        T.StructField("is_synthetic", _B, True),
        T.StructField("is_anomaly", _B, True),
        T.StructField("split", _S, True),
        T.StructField("window_start", _S, True),
    ]
)

FORECAST_SERIES = _struct(("tenant_id", _S), ("window_start", _TS), ("request_count", _L))

# Forecast horizons (minutes), lags and trailing windows.
HORIZONS = (5, 15)
LAGS = (1, 5, 15)
TRAILING = (5, 15)

# HTTP methods a route may allow, and those used when none are given.
VALID_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
DEFAULT_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")


def require_columns(df, columns) -> None:
    """Plan-time check that a frame has the columns an operator needs; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
