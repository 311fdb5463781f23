"""Registered queries: imputation, standardising, detectors and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.functions.columns import iso_minute, time_text
from callscope.operators import datasets, detect, features, forecast, iforest, lof, matrix, registry, series, traffic
from callscope.plans.features import FEATURE_SQL
from callscope.plans.series import BASE as SERIES_BASE
from callscope.plans.series import SPLIT_SQL, WINDOWS_SQL
from callscope.plans.traffic import ORACLES as TRAFFIC_ORACLES
from callscope.schemas import MODEL_FEATURES
from callscope.session import materialise, scratch_dir
from callscope.sources import adapters as A
from callscope.sources import tables
from callscope.sources.versions import VersionedTable

QUERIES, ORACLES = {}, {}

KEYS = ("tenant_id", "client_id", "route_id", "window_start")

# Some cells are emptied by a rule, so that imputation has something to do.
HOLES = {"p95_latency_ms": 5, "unique_methods": 7, "429_rate": 4}


def _windows(spark, sf_dir, holes: bool = False):
    rows = features.minute_features(A.request_logs(spark, sf_dir)).withColumn("window_start", time_text("window_start"))
    if holes:
        rows = rows.withColumns(
            {c: F.when(F.col("request_count") % n != 0, F.col(f"`{c}`").cast("double")) for c, n in HOLES.items()}
        )
    return A.spread(materialise(matrix.model_matrix(rows, KEYS), "windows"))


def _holes_sql(holes: bool) -> str:
    cells = []
    for c in MODEL_FEATURES:
        n = HOLES.get(c) if holes else None
        value = f'CAST("{c}" AS DOUBLE)'
        cells.append((f"CASE WHEN request_count % {n} <> 0 THEN {value} END" if n else value) + f' AS "{c}"')
    return f"""matrix AS (SELECT tenant_id, client_id, route_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  {", ".join(cells)} FROM features)"""


def _scaled_sql(digits: int) -> str:
    med = ", ".join(f'quantile_cont("{c}", 0.5) AS "{c}"' for c in MODEL_FEATURES)
    fill = ", ".join(f'coalesce(m."{c}", d."{c}") AS "{c}"' for c in MODEL_FEATURES)
    stats = ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in MODEL_FEATURES)
    z = ", ".join(
        f'round((f."{c}" - s."m_{c}") / CASE WHEN s."s_{c}" = 0 THEN 1.0 ELSE s."s_{c}" END, {digits}) + 0.0 AS "{c}"'
        for c in MODEL_FEATURES
    )
    return f"""medians AS (SELECT {med} FROM matrix),
filled AS (SELECT m.tenant_id, m.client_id, m.route_id, m.window_start, {fill} FROM matrix m, medians d),
stats AS (SELECT {stats} FROM filled),
scaled AS (SELECT f.tenant_id, f.client_id, f.route_id, f.window_start, {z} FROM filled f, stats s)"""


def impute_standardise(spark, sf_dir):
    rows = _windows(spark, sf_dir, holes=True)
    return rows.select(*KEYS, *matrix.fit_scaler(rows).columns(6))


QUERIES["impute_standardise"] = impute_standardise
ORACLES["impute_standardise"] = A.with_ctes(A.sql_logs(), FEATURE_SQL, _holes_sql(True), _scaled_sql(6), "SELECT * FROM scaled")


def _vectors(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    scaler = matrix.fit_scaler(rows)
    return rows.select(*KEYS, F.concat_ws("|", *KEYS).alias("id"), scaler.vector().alias("v"))


def lof_scores(spark, sf_dir):
    """Factor of every window against all others; small buckets, so that several are searched."""
    rows = _vectors(spark, sf_dir)
    model = lof.fit_lof(rows, bucket_rows=256, split_rows=200)
    return lof.training_factors(model, rows).select(*KEYS, F.round("lof", 6).alias("lof"))


QUERIES["lof_scores"] = lof_scores
_V = ", ".join(f'"{c}"' for c in MODEL_FEATURES)
_D = " + ".join(f"(a.v[{i}] - b.v[{i}]) ** 2" for i in range(1, len(MODEL_FEATURES) + 1))
ORACLES["lof_scores"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    _holes_sql(False),
    _scaled_sql(9),
    f"""points AS MATERIALIZED (SELECT *, tenant_id || '|' || client_id || '|' || route_id || '|' || window_start AS id, [{_V}] AS v,
    min(tenant_id || '|' || client_id || '|' || route_id || '|' || window_start) OVER (PARTITION BY {_V}) AS pid FROM scaled),
links AS MATERIALIZED (SELECT a.id, b.id AS other, round(sqrt({_D}), 8) AS d FROM points a JOIN points b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt({_D}), 8), b.pid, b.id) <= 20),
reach AS (SELECT id, max(d) AS k_distance FROM links GROUP BY 1),
density AS MATERIALIZED (SELECT l.id, 1 / (avg(greatest(l.d, r.k_distance)) + 1e-10) AS lrd FROM links l JOIN reach r ON r.id = l.other GROUP BY 1),
factors AS (SELECT l.id, avg(o.lrd) / any_value(m.lrd) AS lof FROM links l JOIN density o ON o.id = l.other JOIN density m ON m.id = l.id GROUP BY 1)
SELECT tenant_id, client_id, route_id, window_start, round(lof, 6) AS lof FROM points JOIN factors USING (id)""",
)


def _labelled(spark, sf_dir):
    return materialise(datasets.labelled_windows(features.minute_features(A.request_logs(spark, sf_dir))), "labelled")


def labelled_windows(spark, sf_dir):
    count = F.col("requests_per_minute").alias("request_count")
    return _labelled(spark, sf_dir).select("id", count, "scenario", "is_anomaly", "split", "window_start")


RULES_SQL = f"""ruled AS (SELECT *, CASE WHEN "5xx_rate" >= {datasets.SHARE} THEN 'HIGH_5XX_RATE' WHEN "429_rate" >= {datasets.SHARE} THEN 'HIGH_429_RATE'
    WHEN "401_rate" >= {datasets.SHARE} THEN 'HIGH_401_RATE' WHEN average_latency_ms >= {datasets.SLOW_MS} THEN 'HIGH_LATENCY'
    WHEN request_rate_change >= {datasets.CHANGE} THEN 'TRAFFIC_SPIKE' ELSE 'NORMAL' END AS scenario,
  (['train', 'test', 'train', 'train'])[CAST((epoch_us(window_start) // 60000000) % 4 AS INTEGER) + 1] AS split FROM features)"""

QUERIES["labelled_windows"] = labelled_windows
ORACLES["labelled_windows"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    RULES_SQL,
    """SELECT sha256(tenant_id || '|' || client_id || '|' || route_id || '|' || epoch_us(window_start) // 1000000) AS id, CAST(request_count AS DOUBLE) AS request_count,
  scenario, scenario <> 'NORMAL' AS is_anomaly, split, strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start FROM ruled""",
)


def isolation_forest(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    model = iforest.fit_forest(rows)
    return iforest.score_forest(model, rows).select(*KEYS, F.round("isolation", 6).alias("isolation"))


_HEIGHT = iforest.height_of(iforest.SAMPLE)


def _depth_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n} END"


def forest_sql(train: str, target: str) -> str:
    """CTEs that grow the forest on ``train`` (id, v), level by level, and score ``target`` (id, v): forest_scores (id, isolation)."""
    prime, factor, trees = iforest.PRIME, iforest.FACTOR, iforest.TREES
    sides = lambda f: "[" + ", ".join(f"{f}(v[{i}])" for i in range(1, len(MODEL_FEATURES) + 1)) + "]"
    drawn = lambda which: f"((t * 1009 + node) * {iforest.STEP} + {which * iforest.SALT + iforest.SEED}) % {prime} * {factor} % {prime}"
    parts = [
        f"""forest_base AS (SELECT id, v, CAST('0x' || md5(id)[1:8] AS BIGINT) % {prime} AS base FROM {train})""",
        f"""forest_rows0 AS MATERIALIZED (SELECT t, id, v, 1::BIGINT AS node FROM (SELECT t, id, v, row_number() OVER (PARTITION BY t
  ORDER BY (base * ((t + 1) * {factor} % {prime}) + {iforest.SEED} * (t + 1)) % {prime}, id) AS r FROM forest_base, range({trees}) x(t)) WHERE r <= {iforest.SAMPLE})""",
    ]
    for k in range(_HEIGHT + 1):
        parts.append(f"forest_nodes{k} AS MATERIALIZED (SELECT t, node, count(*) AS n, {sides('min')} AS lo, {sides('max')} AS hi FROM forest_rows{k} GROUP BY t, node)")
        if k < _HEIGHT:
            parts.append(f"""forest_splits{k} AS MATERIALIZED (SELECT t, node, pick, lo[pick] + (hi[pick] - lo[pick]) * ((1 + {drawn(2)} % {iforest.SHARES}) / {iforest.SHARES + 2}::DOUBLE) AS cut
  FROM (SELECT *, usable[1 + {drawn(1)} % len(usable)] AS pick FROM (SELECT *, list_filter(range(1, {len(MODEL_FEATURES) + 1}), lambda i: hi[i] > lo[i]) AS usable
    FROM forest_nodes{k} WHERE n >= 2) WHERE len(usable) > 0))""")
            parts.append(f"""forest_rows{k + 1} AS MATERIALIZED (SELECT t, id, v, 2 * node + CASE WHEN v[pick] < cut THEN 0 ELSE 1 END AS node
  FROM forest_rows{k} JOIN forest_splits{k} USING (t, node))""")
    union = lambda name, last: " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(last + 1))
    parts.append(f"forest_splits AS MATERIALIZED ({union('forest_splits', _HEIGHT - 1)})")
    parts.append(f"forest_nodes AS MATERIALIZED (SELECT t, node, n FROM ({union('forest_nodes', _HEIGHT)}))")
    parts.append(f"forest_walk0 AS MATERIALIZED (SELECT id, v, t, 1::BIGINT AS node FROM {target}, range({trees}) x(t))")
    for k in range(_HEIGHT):
        parts.append(f"""forest_walk{k + 1} AS MATERIALIZED (SELECT id, v, w.t, CASE WHEN pick IS NULL THEN w.node WHEN v[pick] < cut THEN 2 * w.node ELSE 2 * w.node + 1 END AS node
  FROM forest_walk{k} w LEFT JOIN forest_splits s ON s.t = w.t AND s.node = w.node)""")
    parts.append(f"forest_size AS (SELECT least({iforest.SAMPLE}, count(*)) AS m FROM {train})")
    parts.append(f"""forest_scores AS MATERIALIZED (SELECT id, round(pow(2.0::DOUBLE, -(sum(length(bin(w.node)) - 1 + {_depth_sql('coalesce(n, 0)')}) / {trees}) / any_value({_depth_sql('m')})), {iforest.DIGITS}) AS isolation
  FROM forest_walk{_HEIGHT} w LEFT JOIN forest_nodes f ON f.t = w.t AND f.node = w.node, forest_size GROUP BY id)""")
    return ",\n".join(parts)


QUERIES["isolation_forest"] = isolation_forest
ORACLES["isolation_forest"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    _holes_sql(False),
    _scaled_sql(9),
    f"points AS MATERIALIZED (SELECT *, tenant_id || '|' || client_id || '|' || route_id || '|' || window_start AS id, [{_V}] AS v FROM scaled)",
    forest_sql("points", "points"),
    "SELECT tenant_id, client_id, route_id, window_start, round(isolation, 6) AS isolation FROM points JOIN forest_scores USING (id)",
)


def detector_comparison(spark, sf_dir):
    """Both detectors trained on normal windows and measured on the held-out ones."""
    metrics, _ = detect.compare_detectors(_labelled(spark, sf_dir), version="traffic", synthetic=False)
    return metrics


QUERIES["detector_comparison"] = detector_comparison


def detector_comparison_counts(spark, sf_dir):
    """What the confusion counts of every detector must add up to."""
    m = detector_comparison(spark, sf_dir)
    return m.select(
        "algorithm", "sample_count", (F.col("tp") + F.col("fn")).alias("anomalous"), (F.col("tn") + F.col("fp")).alias("normal")
    )


QUERIES["detector_comparison_counts"] = detector_comparison_counts
ORACLES["detector_comparison_counts"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    RULES_SQL,
    f"""SELECT algorithm, count(*) AS sample_count, count(*) FILTER (WHERE scenario <> 'NORMAL') AS anomalous, count(*) FILTER (WHERE scenario = 'NORMAL') AS normal
FROM ruled, (VALUES {", ".join(f"('{a}')" for a in detect.ALGORITHMS)}) v(algorithm) WHERE split = 'test' GROUP BY 1""",
)


def traffic_detector(spark, sf_dir):
    """A forest trained on the normal windows of the log."""
    return detect.train_detector(matrix.training_rows(_labelled(spark, sf_dir), synthetic=False), version="traffic-isolation_forest")


def shown_anomalies(found):
    return found.withColumns({"score": F.round("score", 6), "window_start": time_text("window_start")})


def recent_anomalies(spark, sf_dir):
    """Anomalous windows of the log under a forest trained on normal windows."""
    rows = features.minute_features(A.request_logs(spark, sf_dir))
    return shown_anomalies(detect.anomalies(detect.score(traffic_detector(spark, sf_dir), rows)))


def _trained_sql() -> str:
    """CTEs up to forest_scores of all windows and the threshold, by a forest fitted on normal training windows."""
    stats = ", ".join(f'quantile_cont(CAST("{c}" AS DOUBLE), 0.5) AS "d_{c}", avg(CAST("{c}" AS DOUBLE)) AS "m_{c}", stddev_pop(CAST("{c}" AS DOUBLE)) AS "s_{c}"' for c in MODEL_FEATURES)
    z = ", ".join(f'round((CAST("{c}" AS DOUBLE) - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1.0 ELSE "s_{c}" END, 9) + 0.0' for c in MODEL_FEATURES)
    return f"""{RULES_SQL},
normal AS (SELECT * FROM ruled WHERE split = 'train' AND scenario = 'NORMAL'),
stats AS (SELECT {stats} FROM normal),
points AS MATERIALIZED (SELECT tenant_id, client_id, route_id, window_start, split, scenario,
  sha256(tenant_id || '|' || client_id || '|' || route_id || '|' || epoch_us(window_start) // 1000000) AS id, [{z}] AS v FROM ruled, stats),
trained AS (SELECT id, v FROM points WHERE split = 'train' AND scenario = 'NORMAL'),
{forest_sql("trained", "points")},
threshold AS (SELECT -quantile_cont(-isolation, {detect.CONTAMINATION}) AS edge FROM trained JOIN forest_scores USING (id)),
judged AS (SELECT points.*, isolation - edge AS score FROM points JOIN forest_scores USING (id), threshold)"""


_ANOMALIES_SQL = f"""SELECT tenant_id, client_id, route_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, 'ML DETECTION' AS severity,
  round(score, 6) AS score, '{detect.SEMANTICS}' AS score_semantics, 'traffic-isolation_forest' AS model_version FROM judged WHERE score > 0"""

QUERIES["recent_anomalies"] = recent_anomalies
RECENT_ANOMALIES_SQL = A.with_ctes(A.sql_logs(), FEATURE_SQL, _trained_sql(), _ANOMALIES_SQL)
ORACLES["recent_anomalies"] = RECENT_ANOMALIES_SQL


def anomaly_status(spark, sf_dir):
    """Anomaly counts per tenant under the forest."""
    rows = features.minute_features(A.request_logs(spark, sf_dir))
    detector = traffic_detector(spark, sf_dir)
    return detect.anomaly_status(A.tenants(spark, sf_dir), detect.anomalies(detect.score(detector, rows)), detector.version)


QUERIES["anomaly_status"] = anomaly_status
ORACLES["anomaly_status"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    _trained_sql(),
    """SELECT tenant_id, count(*) FILTER (WHERE score > 0) AS anomaly_count, 'AVAILABLE' AS status, 'traffic-isolation_forest' AS model_version,
  CAST(NULL AS VARCHAR) AS detail FROM judged GROUP BY 1""",
)


def forest_confusion(spark, sf_dir):
    """Confusion cells of the forest on the held-out windows. The labels are thresholds on the features
    that the forest sees, so these figures say how well it finds such thresholds, no more."""
    found = detect.score(traffic_detector(spark, sf_dir), matrix.evaluation_rows(_labelled(spark, sf_dir), synthetic=False))
    return detect.confusion(found).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


QUERIES["forest_confusion"] = forest_confusion
ORACLES["forest_confusion"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    _trained_sql(),
    """cells AS (SELECT count(*) AS sample_count, count(*) FILTER (WHERE scenario <> 'NORMAL' AND score > 0) AS tp, count(*) FILTER (WHERE scenario = 'NORMAL' AND score <= 0) AS tn,
  count(*) FILTER (WHERE scenario = 'NORMAL' AND score > 0) AS fp, count(*) FILTER (WHERE scenario <> 'NORMAL' AND score <= 0) AS fn FROM judged WHERE split = 'test')
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM cells""",
)


def detector_metrics(spark, sf_dir):
    """Binary metrics on the label table: toxic as truth, low quality as prediction."""
    rows = A.table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 4).alias("part"),
        (F.col("toxic") == 1).alias("is_anomaly"),
        (F.col("quality") == 0).alias("is_anomaly_predicted"),
    )
    return detect.confusion(rows, "part").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


METRICS_SQL = """cells AS (SELECT doc_id % 4 AS part, count(*) AS sample_count, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp,
  count(*) FILTER (WHERE toxic <> 1 AND quality <> 0) AS tn, count(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS fp,
  count(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS fn FROM labels GROUP BY 1),
metrics AS (SELECT *, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM cells)"""

QUERIES["detector_metrics"] = detector_metrics
ORACLES["detector_metrics"] = f"WITH {METRICS_SQL} SELECT * FROM metrics"


def model_selection(spark, sf_dir):
    rows = detector_metrics(spark, sf_dir).withColumn("algorithm", F.concat(F.lit("part-"), F.col("part").cast("string")))
    return detect.select_model(rows)


QUERIES["model_selection"] = model_selection
ORACLES["model_selection"] = f"""WITH {METRICS_SQL} SELECT 'part-' || CAST(part AS VARCHAR) AS recommended_candidate
FROM metrics ORDER BY f1 DESC, precision DESC, 1 LIMIT 1"""


def split_assignment(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", datasets.split_of(F.col("event_id")).alias("split"))


QUERIES["split_assignment"] = split_assignment
ORACLES["split_assignment"] = """SELECT event_id, (['train', 'test', 'train', 'train'])[CAST(event_id % 4 AS INTEGER) + 1] AS split FROM events"""


def _even_labelled(spark, sf_dir):
    """Half of the windows as labelled rows (a rule on the count), in the dataset's shape."""
    rows = features.minute_features(A.request_logs(spark, sf_dir))
    busy = F.col("request_count") > 7
    return rows.select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in MODEL_FEATURES],
        F.when(busy, "TRAFFIC_SPIKE").otherwise("NORMAL").alias("scenario"),
        F.lit(True).alias("is_synthetic"),
        busy.alias("is_anomaly"),
        datasets.split_of(F.minute("window_start")).alias("split"),
        iso_minute("window_start").alias("window_start"),
    ), rows


LABELLED_SQL = """labelled AS (SELECT CASE WHEN request_count > 7 THEN 'TRAFFIC_SPIKE' ELSE 'NORMAL' END AS scenario, true AS is_synthetic,
  request_count > 7 AS is_anomaly, (['train', 'test', 'train', 'train'])[CAST(minute(window_start) % 4 AS INTEGER) + 1] AS split FROM features
UNION ALL SELECT 'HISTORICAL_UNLABELED', false, NULL, 'unlabeled' FROM features)"""


def training_union(spark, sf_dir):
    labelled, rows = _even_labelled(spark, sf_dir)
    out = datasets.composition(datasets.training_union(labelled, rows), "split")
    return out.withColumn("scenarios", F.array_join("scenarios", ","))


QUERIES["training_union"] = training_union
ORACLES["training_union"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    LABELLED_SQL,
    """SELECT split, count(*) AS row_count, count(*) FILTER (WHERE is_synthetic) AS synthetic_count,
  count(*) FILTER (WHERE NOT is_synthetic) AS historical_count, array_to_string(list_sort(list(DISTINCT scenario)), ',') AS scenarios
FROM labelled GROUP BY 1""",
)


def train_test_selection(spark, sf_dir):
    labelled, rows = _even_labelled(spark, sf_dir)
    dataset = datasets.training_union(labelled, rows)
    count = lambda df, name: df.groupBy("scenario").agg(F.count(F.lit(1)).alias("row_count")).withColumn("selection", F.lit(name))
    return count(matrix.training_rows(dataset), "train").unionByName(count(matrix.evaluation_rows(dataset), "test"))


QUERIES["train_test_selection"] = train_test_selection
ORACLES["train_test_selection"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    LABELLED_SQL,
    """SELECT scenario, count(*) AS row_count, 'train' AS selection FROM labelled WHERE split = 'train' AND scenario = 'NORMAL' AND is_synthetic GROUP BY 1
UNION ALL SELECT scenario, count(*), 'test' FROM labelled WHERE split = 'test' AND is_synthetic AND is_anomaly IS NOT NULL GROUP BY 1""",
)


def _forecast_windows(spark, sf_dir):
    return series.supervised_windows(series.minute_series(A.request_logs(spark, sf_dir, 60)))


def forecast_metrics(spark, sf_dir):
    """MAE and RMSE of the forests next to persistence, per horizon."""
    _, errors = forecast.train_forecaster(_forecast_windows(spark, sf_dir), short="mark")
    return errors


def forecast_latest(spark, sf_dir):
    windows = _forecast_windows(spark, sf_dir)
    model, _ = forecast.train_forecaster(windows, short="mark")
    return forecast.forecast(model, windows)


QUERIES["forecast_metrics"] = forecast_metrics
QUERIES["forecast_latest"] = forecast_latest


def forecast_status(spark, sf_dir):
    return forecast.no_forecast(A.tenants(spark, sf_dir))


QUERIES["forecast_status"] = forecast_status
ORACLES["forecast_status"] = A.with_ctes(
    A.sql_logs(),
    """SELECT DISTINCT tenant_id, 'UNAVAILABLE' AS status, CAST(NULL AS VARCHAR) AS model_version,
  'The forecasting model is trained and evaluated offline; no live forecast artifact is activated.' AS note FROM request_logs""",
)


def overview_with_model(spark, sf_dir):
    """The overview with the anomalous windows of its hour."""
    logs = A.request_logs(spark, sf_dir)
    found = detect.anomalies(detect.score(traffic_detector(spark, sf_dir), features.minute_features(logs)))
    newest = logs.agg((F.max("created_at") - F.expr("interval 1 hour")).alias("_from"))
    hour = found.join(newest, F.col("window_start") > F.col("_from"))
    out = traffic.overview(A.tenants(spark, sf_dir), logs, hour)
    return out.withColumns({c: F.array_join(c, "|") for c in ("observed", "forecast")})


QUERIES["overview_with_model"] = overview_with_model
ORACLES["overview_with_model"] = f"""SELECT o.* REPLACE (coalesce(a.n, 0) AS anomaly_count, 'available' AS model_status) FROM ({TRAFFIC_ORACLES['overview_without_model']}) o
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM ({A.with_ctes(A.sql_logs(), FEATURE_SQL, _trained_sql(), "SELECT tenant_id FROM judged WHERE score > 0 AND window_start > (SELECT max(created_at) FROM request_logs) - INTERVAL 1 HOUR")}) GROUP BY 1) a USING (tenant_id)"""


def model_promotion(spark, sf_dir):
    """Two forests saved, registered and promoted one after the other in a versioned registry; a damaged candidate is refused."""
    training = materialise(matrix.training_rows(_labelled(spark, sf_dir), synthetic=False), "normal")
    folder = scratch_dir(spark, "models")
    for version in ("one", "two", "damaged"):
        detector = detect.train_detector(training, version=version, trees=10)
        registry.save_detector(detector, f"{folder}/{version}")
        rows = detector.training_rows
    spark.read.parquet(f"{folder}/one/model").write.mode("overwrite").parquet(f"{folder}/damaged/model")
    spark.createDataFrame([(99, [-1, -1], [0.0, 0.0], [0.0, 0.0])], iforest.TREE_SCHEMA).write.mode("append").parquet(f"{folder}/damaged/model")
    listed = [(v, "isolation_forest", f"{folder}/{v}", "candidate") for v in ("one", "two", "damaged")]
    table = VersionedTable.create(spark.createDataFrame(listed, registry.STATUS), scratch_dir(spark, "registry"), ["model_version"], 1)
    registry.promote_committed(table, "one")
    registry.promote_committed(table, "two", replace=True)
    try:
        registry.promote_committed(table, "damaged", replace=True)
        refused = False
    except ValueError:
        refused = True
    active = registry.active_detector(spark, table.read())
    states = [table.read(v).select(F.lit(v).alias("version"), "model_version", "status") for v in table.versions()]
    out = reduce(lambda a, b: a.unionByName(b), states)
    return out.select("*", F.lit(refused).alias("refused"), F.lit(active.version).alias("active"), F.lit(rows).cast("bigint").alias("training_rows"))


QUERIES["model_promotion"] = model_promotion
ORACLES["model_promotion"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    RULES_SQL,
    """SELECT version, model_version, status, true AS refused, 'two' AS active, (SELECT count(*) FROM ruled WHERE split = 'train' AND scenario = 'NORMAL') AS training_rows
FROM (VALUES (0, 'one', 'candidate'), (0, 'two', 'candidate'), (0, 'damaged', 'candidate'), (1, 'one', 'active'), (1, 'two', 'candidate'), (1, 'damaged', 'candidate'),
  (2, 'one', 'backup'), (2, 'two', 'active'), (2, 'damaged', 'candidate')) v(version, model_version, status)""",
)


def training_round_trip(spark, sf_dir):
    """The training dataset written in its order and read back, as Parquet and CSV."""
    labelled, rows = _even_labelled(spark, sf_dir)
    dataset = materialise(datasets.training_union(labelled, rows), "dataset")
    out = []
    for source in ("parquet", "csv"):
        path = scratch_dir(spark, f"training-{source}")
        tables.write_training(dataset, path, source)
        back = tables.read_training(spark, path, source).withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
        order = F.struct("split", "scenario", "window_start")
        before = F.lag(order).over(Window.partitionBy("_file").orderBy("_row"))
        marked = back.withColumn("_wrong", (before > order).cast("bigint"))
        counts = marked.groupBy("split", "scenario").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_wrong"), F.lit(0)).alias("out_of_order"))
        out.append(counts.withColumn("source", F.lit(source)))
    return out[0].unionByName(out[1])


QUERIES["training_round_trip"] = training_round_trip
ORACLES["training_round_trip"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    LABELLED_SQL,
    "SELECT source, split, scenario, count(*) AS n, 0::BIGINT AS out_of_order FROM labelled, (VALUES ('parquet'), ('csv')) v(source) GROUP BY 1, 2, 3",
)


def evaluation_report(spark, sf_dir):
    """The report of a comparison, written as JSON and read back."""
    metrics = detector_metrics(spark, sf_dir).withColumn("algorithm", F.concat(F.lit("part-"), F.col("part").cast("string"))).drop("part")
    labelled, rows = _even_labelled(spark, sf_dir)
    data = datasets.composition(datasets.training_union(labelled, rows), "split")
    path = scratch_dir(spark, "report")
    tables.write_report(metrics, detect.select_model(metrics), data, path)
    report = spark.read.json(path)
    names = [f.name for f in report.schema["models"].dataType.fields]
    f1 = F.explode(F.array(*[F.struct(F.lit(n).alias("algorithm"), F.col(f"models.`{n}`.f1").alias("f1")) for n in names])).alias("m")
    datasets_ = F.size("datasets").cast("bigint").alias("datasets")
    return report.select("recommended_candidate", datasets_, f1).select("recommended_candidate", "datasets", "m.algorithm", "m.f1")


QUERIES["evaluation_report"] = evaluation_report
ORACLES["evaluation_report"] = A.with_ctes(A.sql_logs(), FEATURE_SQL, LABELLED_SQL, METRICS_SQL, """best AS (SELECT 'part-' || CAST(part AS VARCHAR) AS recommended_candidate FROM metrics ORDER BY f1 DESC, precision DESC, 1 LIMIT 1)
SELECT recommended_candidate, (SELECT count(DISTINCT split) FROM labelled) AS datasets, 'part-' || CAST(part AS VARCHAR) AS algorithm, f1 FROM metrics, best""")


def feature_sink(spark, sf_dir):
    """Minute features written in order: rows, and rows before their predecessor inside or between files."""
    path = scratch_dir(spark, "feature-sink")
    tables.write_features(features.minute_features(A.request_logs(spark, sf_dir)), path)
    key = F.struct(*features.WINDOW_KEYS)
    back = spark.read.parquet(path).select(key.alias("key"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    inside = back.withColumn("before", F.lag("key").over(Window.partitionBy("file").orderBy("row")))
    files = inside.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") > F.col("key")).alias("wrong"), F.min("key").alias("low"), F.max("key").alias("high"))
    # One row per file; files must follow each other by their names.
    files = files.withColumn("last", F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("file")))
    return files.agg(F.sum("n").alias("row_count"), F.sum(F.col("wrong") + F.coalesce((F.col("last") > F.col("low")).cast("bigint"), F.lit(0))).alias("out_of_order"))


QUERIES["feature_sink"] = feature_sink
ORACLES["feature_sink"] = A.with_ctes(A.sql_logs(), FEATURE_SQL, "SELECT count(*) AS row_count, 0::BIGINT AS out_of_order FROM features")


def forecast_checked(spark, sf_dir):
    """What must hold of the forests' errors: samples, exact persistence errors, MAE at most RMSE, and the comparison."""
    errors = materialise(forecast_metrics(spark, sf_dir), "forecast-errors")
    beats = series.beats_persistence(errors)
    flags = errors.select(
        "horizon_minutes", "sample_count", F.round("naive_mae", 6).alias("naive_mae"), F.round("naive_rmse", 6).alias("naive_rmse"),
        ((F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse") + 1e-9)).alias("mae_fits"), "mae",
        F.min(F.col("mae") < F.col("naive_mae")).over(Window.partitionBy(F.lit(1))).alias("all_better"),
    )
    out = flags.join(beats, F.lit(True))
    return out.select("horizon_minutes", "sample_count", "naive_mae", "naive_rmse", "mae_fits", (F.col("all_better") == F.col("model_beats_naive_all_horizons")).alias("comparison_fits"))


def forecast_rows(spark, sf_dir):
    """Forecast rows with what can be checked of them: times, counts at the origin, and bounds of what a forest can say."""
    windows = materialise(_forecast_windows(spark, sf_dir), "forecast-windows")
    model, _ = forecast.train_forecaster(windows, short="mark")
    # A forest's answer is a mean of targets it has seen.
    most = windows.agg(F.greatest(*[F.max(f"target_{h}m") for h in series.HORIZONS]).alias("most"))
    out = forecast.forecast(model, windows).join(most, F.lit(True))
    fits = F.col("predicted_requests").between(0, F.col("most")) & (F.col("naive_persistence_requests") == F.col("observed_at_origin"))
    return out.select("tenant_id", "horizon_minutes", time_text("forecast_time").alias("forecast_time"), F.col("observed_at_origin").cast("double").alias("observed_at_origin"), fits.alias("fits"), "value_kind")


QUERIES["forecast_checked"] = forecast_checked
QUERIES["forecast_rows"] = forecast_rows
_SPLITS = (*SERIES_BASE, WINDOWS_SQL, SPLIT_SQL)
ORACLES["forecast_checked"] = A.with_ctes(
    *_SPLITS,
    "\nUNION ALL ".join(
        f"""SELECT CAST({h} AS INTEGER) AS horizon_minutes, count(*) AS sample_count, round(avg(abs(target_{h}m - observed_count)), 6) AS naive_mae,
  round(sqrt(avg(pow(target_{h}m - observed_count, 2))), 6) AS naive_rmse, true AS mae_fits, true AS comparison_fits FROM splits WHERE split = 'test'"""
        for h in series.HORIZONS
    ),
)
ORACLES["forecast_rows"] = A.with_ctes(
    *SERIES_BASE,
    WINDOWS_SQL,
    f"""newest AS (SELECT * FROM complete QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY complete.origin_time DESC) = 1)
SELECT tenant_id, CAST(h AS INTEGER) AS horizon_minutes, strftime(origin_time + h * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS forecast_time,
  CAST(observed_count AS DOUBLE) AS observed_at_origin, true AS fits, 'model_prediction' AS value_kind
FROM newest, (VALUES {", ".join(f"({h})" for h in series.HORIZONS)}) v(h)""",
)
