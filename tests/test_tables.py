import pytest
from pyspark.sql import functions as F

from callscope import session
from callscope.operators import quality, scan, series, upsert
from callscope.schemas import GATEWAY_ROUTES, REQUEST_LOGS
from callscope.sources import adapters as A
from callscope.sources import tables


def test_point_lookups_and_listing_hide_secrets(spark, sf_dir):
    clients = A.api_clients(spark, sf_dir)
    keys = spark.createDataFrame([("tenant-0", "client-0"), ("tenant-1", "client-0"), ("tenant-0", "client-0")], "tenant_id string, id string")
    assert [r["id"] for r in scan.lookup(clients, keys).collect()] == ["client-0"]
    listed = scan.dimension_scan(clients, "tenant-1")
    assert "api_key_hash" not in listed.columns and {r["tenant_id"] for r in listed.collect()} == {"tenant-1"}


def test_deleting_a_tenant_takes_its_rows(spark, sf_dir):
    left = A.tenants(spark, sf_dir).where("id = 'tenant-0'")
    out = upsert.cascade_tenants({"clients": A.api_clients(spark, sf_dir), "logs": A.request_logs(spark, sf_dir)}, left)
    assert all({r[0] for r in df.select("tenant_id").distinct().collect()} == {"tenant-0"} for df in out.values())


def test_conflicts(spark, sf_dir):
    routes = A.gateway_routes(spark, sf_dir)
    fresh = routes.withColumn("gateway_path", F.concat("gateway_path", F.lit("/new")))
    key = ("tenant_id", "gateway_path")
    assert quality.conflicts(routes, routes, key).count() == routes.count() and quality.conflicts(fresh, routes, key).count() == 0


def test_null_keys_match_in_a_merge(spark):
    schema = "k string, v int, created_at int, at int"
    stored = spark.createDataFrame([(None, 1, 10, 0), ("a", 1, 10, 0)], schema)
    batch = spark.createDataFrame([(None, 2, 20, 1), (None, 3, 30, 2), ("b", 9, 40, 0)], schema)
    out = upsert.merge_latest(stored, batch, ["k"], order=("at",))
    assert {tuple(r) for r in out.collect()} == {(None, 3, 10, 2), ("a", 1, 10, 0), ("b", 9, 40, 0)}


def test_change_feed_starts_anew_after_a_delete(spark):
    stored = spark.createDataFrame([("t", "1", "old", "active")], "tenant_id string, id string, name string, status string")
    feed = spark.createDataFrame(
        [("t", "1", None, None, "delete", 1), ("t", "1", "new", None, "create", 2)],
        "tenant_id string, id string, name string, status string, op string, at int",
    ).withColumn("changed_at", F.timestamp_seconds("at")).drop("at")
    assert [tuple(r) for r in upsert.apply_changes(stored, feed).collect()] == [("t", "1", "new", None)]
    assert upsert.apply_changes(stored, feed.where("op = 'delete'")).count() == 0


def test_change_feed_settles_ties_and_sets_null(spark):
    stored = spark.createDataFrame([("t", "1", "old", "active")], "tenant_id string, id string, name string, status string")
    rows = [("t", "1", "x", None, "update", 5, 2, None), ("t", "1", "y", None, "update", 5, 1, None), ("t", "1", None, None, "update", 6, 3, ["status"])]
    feed = spark.createDataFrame(
        rows, "tenant_id string, id string, name string, status string, op string, at int, sequence int, nulled array<string>"
    ).withColumn("changed_at", F.timestamp_seconds("at")).drop("at")
    for part in (feed, feed.orderBy("sequence"), feed.orderBy(F.desc("sequence"))):
        assert [tuple(r) for r in upsert.apply_changes(stored, part).collect()] == [("t", "1", "x", None)]


@pytest.mark.parametrize("source", ["parquet", "json", "csv", "orc"])
def test_table_sources(spark, sf_dir, tmp_path, source):
    # Text formats keep milliseconds.
    routes = A.gateway_routes(spark, sf_dir).withColumns({c: F.date_trunc("second", c) for c in ("created_at", "updated_at")})
    routes = routes.select(*[f.name for f in GATEWAY_ROUTES])
    path = str(tmp_path / source)
    flat = routes.withColumn("allowed_methods", F.to_json("allowed_methods")) if source == "csv" else routes
    writer = flat.write.option("header", True) if source == "csv" else flat.write
    writer.format(source).save(path)
    back = tables.read_table(spark, path, GATEWAY_ROUTES, source)
    key = lambda r: (r["tenant_id"], r["id"], r["allowed_methods"], r["timeout_ms"], r["active"], r["created_at"])
    assert sorted(map(key, back.collect())) == sorted(map(key, routes.collect()))
    with pytest.raises(ValueError):
        tables.read_table(spark, path, REQUEST_LOGS, "avro")


@pytest.mark.parametrize("source", ["parquet", "csv"])
def test_series_round_trip(spark, sf_dir, tmp_path, source):
    rows = series.minute_series(A.request_logs(spark, sf_dir))
    tables.write_series(rows, str(tmp_path / source), source)
    assert sorted(tables.read_series(spark, str(tmp_path / source), source).collect()) == sorted(rows.select("tenant_id", "window_start", "request_count").collect())


def test_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_dir(Session(), "x")
    Session.conf = Conf({"spark.checkpoint.dir": "hdfs://shared/tmp/"})
    assert session.scratch_dir(Session(), "x").startswith("hdfs://shared/tmp/x-")
