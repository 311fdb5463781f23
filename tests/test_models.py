import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.operators import datasets, detect, features, iforest, lof, matrix, neighbours, quantiles, registry
from callscope.schemas import MODEL_FEATURES
from callscope.sources import adapters as A
from callscope.sources import tables


def vectors(spark, rows):
    return spark.createDataFrame([(f"{i:05}", [float(x) for x in v]) for i, v in enumerate(rows)], "id string, v array<double>")


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, p):
    rng = random.Random(5)
    data = [(rng.choice([None, rng.gauss(0, 1)]), float(rng.randint(0, 3)), None) for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], p)
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx(np.percentile([r[i] for r in data if r[i] is not None], 100 * p), abs=1e-12)
    assert got["c"] is None


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [[rng.choice([0, 1, rng.gauss(0, 2)]), rng.choice([0, rng.random()])] for _ in range(400)] + [[0.0, 0.0]] * 50
    points = neighbours.merge_equal(vectors(spark, rows))
    held = points.collect()
    k = 7
    out = neighbours.nearest(points, points.select(F.col("pid").alias("qid"), "v"), k, exclude_self=True, bucket_rows=20, split_rows=15)
    got = {}
    for r in out.collect():
        got.setdefault(r["qid"], []).append((r["d"], r["pid"], r["w"]))
    assert len(got) == len(held)
    for q in held:
        near = sorted((round(math.dist(q["v"], r["v"]), 8), r["pid"], r["w"] - (r["pid"] == q["pid"])) for r in held)
        want, left = [], k
        for d, pid, w in near:
            if w > 0 and left > 0:
                want.append((d, pid, min(w, left)))
                left -= min(w, left)
        assert sorted(got[q["pid"]]) == want


def brute_lof(rows, k):
    n = len(rows)
    d = np.round(np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2)), 8)
    near = [[j for j in np.argsort(d[i], kind="stable") if j != i][:k] for i in range(n)]
    reach = np.array([d[i, near[i][-1]] for i in range(n)])
    lrd = np.array([1 / (np.mean([max(d[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(lrd[near[i]]) / lrd[i] for i in range(n)])


def test_lof_equals_brute_force_and_scores_new_rows(spark):
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(120, 3)), [[8, 8, 8]]])
    df = vectors(spark, rows)
    model = lof.fit_lof(df, max_neighbours=10, bucket_rows=25)
    got = np.array([r["lof"] for r in lof.training_factors(model, df).orderBy("id").collect()])
    assert got == pytest.approx(brute_lof(rows, 10), rel=1e-9)
    fresh = lof.score_lof(model, vectors(spark, [[0, 0, 0], [30, 30, 30], [0, 0, 0]])).orderBy("id").collect()
    assert fresh[0]["lof"] == fresh[2]["lof"] < 1.5 < fresh[1]["lof"]


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(4)
    df = vectors(spark, np.vstack([rng.normal(size=(600, 4)), [[9, 9, 9, 9]]]))
    model = iforest.fit_forest(df, trees=60)
    assert model.trees.count() == 60
    out = iforest.score_forest(model, df).orderBy(F.col("isolation").desc()).collect()
    assert out[0]["id"] == "00600" and all(0 < r["isolation"] < 1 for r in out)
    again = iforest.score_forest(iforest.fit_forest(df.repartition(5), trees=60), df)
    assert {(r["id"], r["isolation"]) for r in again.collect()} == {(r["id"], r["isolation"]) for r in out}


def test_forest_sample_is_bounded_for_large_tables(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("v"))
    per_tree = iforest.sample_rows(df, 20_000, 10, 64, 42).groupBy("tree_id").count().collect()
    assert len(per_tree) == 10 and all(r["count"] == 64 for r in per_tree)


def test_model_matrix(spark):
    row = {c: "1" for c in MODEL_FEATURES} | {"tenant_id": "t"}
    row["error_rate"], row["p50_latency_ms"] = "bad", "Infinity"
    out = matrix.model_matrix(spark.createDataFrame([row])).first()
    assert list(out.asDict()) == list(MODEL_FEATURES)
    assert out["error_rate"] is None and out["p50_latency_ms"] is None and out["success_count"] == 1.0
    empty = spark.createDataFrame([{c: "x" for c in MODEL_FEATURES}])
    with pytest.raises(Exception, match="no usable numeric"):
        matrix.model_matrix(empty).collect()
    assert matrix.model_matrix(empty, on_empty="drop").count() == 0 and matrix.unusable_rows(empty).count() == 1
    with pytest.raises(ValueError):
        matrix.model_matrix(empty.drop("error_rate"))


def test_quantiles_of_columns_with_nan_end(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (float("nan"), None)], "a double, b double")
    assert quantiles.exact_quantiles(df, ["a", "b"], 0.5) == {"a": 1.5, "b": None}


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return datasets.labelled_windows(features.minute_features(A.request_logs(spark, sf_dir))).cache()


def test_scenarios_are_covered_and_repeatable(spark, sf_dir, labelled):
    rows = labelled.collect()
    assert "NORMAL" in {r["scenario"] for r in rows} and len({r["scenario"] for r in rows}) > 1
    assert all(r["is_anomaly"] == (r["scenario"] != "NORMAL") for r in rows)
    assert {r["split"] for r in rows} == {"train", "test"}
    assert not {"tenant_id", "client_id", "route_id"} & set(labelled.columns)
    again = datasets.labelled_windows(features.minute_features(A.request_logs(spark, sf_dir).repartition(3)))
    assert sorted(again.collect()) == sorted(rows)


def test_history_stays_unlabelled(spark, sf_dir, labelled):
    history = features.minute_features(A.request_logs(spark, sf_dir))
    rows = datasets.training_union(labelled, history).where("is_anomaly is null").limit(5).collect()
    assert {(r["scenario"], r["split"], r["is_anomaly"]) for r in rows} == {("HISTORICAL_UNLABELED", "unlabeled", None)}


def test_comparison_registry_and_promotion(spark, labelled, tmp_path):
    metrics, detectors = detect.compare_detectors(labelled, version="v1", synthetic=False, isolation_forest={"trees": 40})
    rows = {r["algorithm"]: r for r in metrics.collect()}
    held_out = matrix.evaluation_rows(labelled, synthetic=False).count()
    for r in rows.values():
        assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == r["sample_count"] == held_out
    assert detect.select_model(metrics).first()[0] in detect.ALGORITHMS
    tables.write_report(metrics, detect.select_model(metrics), datasets.composition(labelled, "split"), str(tmp_path / "report"))
    assert set(spark.read.json(str(tmp_path / "report")).first()["models"].asDict()) == set(detect.ALGORITHMS)

    state = None
    for name, detector in detectors.items():
        path = registry.save_detector(detector, str(tmp_path / name))
        loaded = registry.load_detector(spark, path)
        one = {(r["id"], round(r["score"], 9)) for r in detect.score(detector, labelled).collect()}
        assert one == {(r["id"], round(r["score"], 9)) for r in detect.score(loaded, labelled).collect()}
        row = registry.candidate(spark, detector.version, name, path)
        state = row if state is None else state.unionByName(row)
    first, second = (d.version for d in detectors.values())
    state = registry.promote(state, first)
    assert registry.active_detector(spark, state).version == first
    with pytest.raises(ValueError, match="replace"):
        registry.promote(state, second)
    state = registry.promote(state, second, replace=True)
    assert {r["model_version"]: r["status"] for r in state.collect()} == {first: "backup", second: "active"}
    third = state.unionByName(registry.candidate(spark, "v3", "isolation_forest", "x"))
    with pytest.raises(ValueError, match="backup"):
        registry.promote(third, "v3", replace=True)


def test_tampered_model_is_refused(spark, labelled, tmp_path):
    detector = detect.train_detector(matrix.training_rows(labelled, synthetic=False), version="v", trees=5)
    path = registry.save_detector(detector, str(tmp_path / "m"))
    spark.read.parquet(f"{path}/model").limit(1).write.mode("append").parquet(f"{path}/model")
    with pytest.raises(ValueError, match="checksum"):
        registry.load_detector(spark, path)


def test_detector_arguments(spark, labelled):
    with pytest.raises(ValueError):
        detect.train_detector(labelled, algorithm="other", version="v")
    with pytest.raises(ValueError):
        detect.train_detector(labelled, version="v", contamination=0.6)
    with pytest.raises(Exception, match="labelled"):
        detect.confusion(labelled.withColumns({"is_anomaly": F.lit(None).cast("boolean"), "is_anomaly_predicted": F.lit(True)})).collect()


@pytest.mark.parametrize("source", ["parquet", "csv"])
def test_dataset_round_trip(spark, labelled, tmp_path, source):
    tables.write_training(labelled, str(tmp_path / source), source)
    back = tables.read_training(spark, str(tmp_path / source), source)
    assert back.count() == labelled.count() and back.columns == [*MODEL_FEATURES, "scenario", "is_synthetic", "is_anomaly", "split", "window_start"]
    assert back.agg(F.sum("success_count")).first() == labelled.agg(F.sum("success_count")).first()


def test_forecaster_round_trip(spark, tmp_path):
    from callscope.operators import forecast, series

    counts = spark.range(300).select(
        F.lit("t").alias("tenant_id"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 60).alias("window_start"),
        (10 + F.pmod("id", F.lit(7)) + F.pmod("id", F.lit(3))).alias("request_count"),
    )
    windows = series.supervised_windows(counts).cache()
    model, errors = forecast.train_forecaster(windows, trees=5, depth=5)
    rows = errors.collect()
    assert {r["horizon_minutes"] for r in rows} == {5, 15} and all(r["mae"] >= 0 for r in rows)
    assert series.beats_persistence(errors).count() == 1
    registry.save_forecaster(model, str(tmp_path / "f"))
    back = registry.load_forecaster(spark, str(tmp_path / "f"))
    one = forecast.forecast(model, windows).orderBy("horizon_minutes").collect()
    assert one == forecast.forecast(back, windows).orderBy("horizon_minutes").collect()
    assert [r["horizon_minutes"] for r in one] == [5, 15] and all(r["predicted_requests"] >= 0 for r in one)
    spark.read.parquet(str(tmp_path / "f" / "horizon-5" / "data")).limit(2).write.mode("append").parquet(str(tmp_path / "f" / "horizon-5" / "data"))
    with pytest.raises(ValueError, match="checksum"):
        registry.load_forecaster(spark, str(tmp_path / "f"))


def test_anomaly_status(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "id string")
    found = spark.createDataFrame([("a",), ("a",)], "tenant_id string")
    got = {r["tenant_id"]: (r["anomaly_count"], r["status"]) for r in detect.anomaly_status(tenants, found, "v").collect()}
    assert got == {"a": (2, "AVAILABLE"), "b": (0, "AVAILABLE")}
    assert {(r["anomaly_count"], r["status"]) for r in detect.anomaly_status(tenants).collect()} == {(None, "UNAVAILABLE")}


def test_log_append_sink(spark, sf_dir, tmp_path):
    rows = A.request_logs(spark, sf_dir).withColumn("client_id", F.when(F.col("client_id") == "client-0", "").otherwise(F.col("client_id")))
    for _ in range(2):
        tables.append_logs(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 * rows.count() and back.where("client_id = ''").count() == 0
    assert back.where("client_id is null").count() == 2 * rows.where("client_id = ''").count()


def test_committed_promotion_verifies_the_candidate(spark, labelled, tmp_path):
    from callscope.sources.versions import ConflictError, VersionedTable

    detector = detect.train_detector(matrix.training_rows(labelled, synthetic=False), version="good", trees=4)
    registry.save_detector(detector, str(tmp_path / "good"))
    listed = [("good", "isolation_forest", str(tmp_path / "good"), "candidate"), ("gone", "isolation_forest", str(tmp_path / "gone"), "candidate")]
    table = VersionedTable.create(spark.createDataFrame(listed, registry.STATUS), str(tmp_path / "registry"), ["model_version"], 1)
    with pytest.raises(Exception):  # noqa: B017
        registry.promote_committed(table, "gone")
    assert table.versions() == [0]
    registry.promote_committed(table, "good")
    assert registry.active_detector(spark, table.read()).version == "good"
    assert {r["status"] for r in table.read(0).collect()} == {"candidate"}
    with pytest.raises(ValueError):
        registry.promote_committed(table, "good")
    with pytest.raises(ConflictError):
        table.rewrite(lambda rows: rows, base=0)


def test_sketches_merge_within_their_error(spark):
    from callscope.operators import sketches

    rows = spark.range(20_000).selectExpr(
        "'t' as tenant_id", "'c' as client_id", "'r' as route_id", "'GET' as method", "200 as status_code", "cast(pow(id, 2) % 9973 as bigint) as latency_ms",
        "false as blocked", "timestamp_seconds(1704067200 + id) as created_at",
    )
    minutes = sketches.minute_sketches(rows)
    whole = sketches.quantiles(sketches.roll_up(minutes, "tenant_id"), {"p50": 0.5, "p99": 0.99}).first()
    values = sorted(r[0] for r in rows.select("latency_ms").collect())
    assert whole["request_count"] == 20_000
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        below, upto = np.searchsorted(values, whole[name], "left") / 20_000, np.searchsorted(values, whole[name], "right") / 20_000
        assert below - sketches.RANK_ERROR <= q <= upto + sketches.RANK_ERROR


def test_pivots_compare_few_pairs(spark):
    """Clustered points: only a small share of all pairs is compared, and the answer is that of all pairs."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 6)) * 20
    rows = centers[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 6))
    points = neighbours.merge_equal(vectors(spark, rows))
    asked = points.select(F.col("pid").alias("qid"), "v")
    _, (_, visited) = neighbours.visits(points, asked, 5, exclude_self=True, bucket_rows=30, split_rows=1000)
    compared = visited.agg(F.sum("points")).first()[0]
    assert compared < 0.1 * 3000 * 3000
    held = {r["pid"]: np.array(r["v"]) for r in points.collect()}
    found = {}
    for r in neighbours.nearest(points, asked, 5, exclude_self=True, bucket_rows=30, split_rows=1000).collect():
        found.setdefault(r["qid"], []).append(r["d"])
    ids, matrix_ = list(held), np.vstack(list(held.values()))
    for q in ids[:200]:
        d = np.sort(np.sqrt(((matrix_ - held[q]) ** 2).sum(axis=1)))[1:6]
        assert sorted(found[q]) == pytest.approx(d.tolist(), abs=1e-7)
