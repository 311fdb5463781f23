import random

import pytest
from pyspark.sql import functions as F

from callscope.functions import bucket as B
from callscope.operators import admission, quality, resolve
from callscope.operators.bucket import bucket_segments, replay

REQ = "id string, tenant_id string, client_id string, route_id string, at double, bucket_capacity double, refill_rate double, initial_tokens double"


def requests(spark, rows):
    return spark.createDataFrame(rows, REQ).withColumn("created_at", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))).drop("at")


def burst(times, capacity, initial, refill):
    return [(f"{i:04}", "t", "c", "r", float(t), float(capacity), float(refill), None if initial is None else float(initial)) for i, t in enumerate(times)]


@pytest.mark.parametrize(
    "times,capacity,initial,refill,want",
    [
        ([0], 5, 2, 2, [(True, 1.0, 0)]),
        ([0], 1, 0, 0, [(False, 0.0, 10**9)]),
        ([0, 1.5], 5, 0, 1, [(False, 0.0, 10**9), (True, 0.5, 0)]),
        ([0], 5, 10, 4, [(True, 4.0, 0)]),
    ],
)
def test_bucket_cases(spark, times, capacity, initial, refill, want):
    out = replay(requests(spark, burst(times, capacity, initial, refill))).orderBy("id").collect()
    assert [(r["allowed"], r["remaining"], r["retry_after_ns"]) for r in out] == want


def test_one_token_serves_one_of_twenty(spark):
    out = replay(requests(spark, burst([0] * 20, 5, 1, 5))).collect()
    assert sum(r["allowed"] for r in out) == 1


def test_large_capacity_and_small_refill(spark):
    out = replay(requests(spark, burst([0, 1], 10_000_000, None, 5))).orderBy("id").collect()
    assert [(r["allowed"], r["remaining"]) for r in out] == [(True, 9_999_999.0), (True, 9_999_999.0)]
    for variant in ("local", "shared"):
        out = replay(requests(spark, burst([0, 0], 1, None, 4e-7)), variant=variant).orderBy("id").collect()
        assert [r["allowed"] for r in out] == [True, False] and out[1]["retry_after_ns"] == 2_500_000 * 10**9


def fold(rows, shared):
    """The reference answer: one bucket, one row after the other."""
    tokens = seen = None
    out = []
    for us, capacity, refill in rows:
        if tokens is None:
            tokens, seen = capacity, us
        tokens += B.gain(us - seen, refill, shared)
        seen = us
        tokens, ok, left, wait = B.take(tokens, capacity, refill, shared)
        out.append((ok, left, wait))
    return out


@pytest.mark.parametrize("variant", ["local", "shared"])
def test_hot_buckets_equal_the_plain_fold(spark, variant):
    rng = random.Random(7)
    rows, wants = [], {}
    for k in range(6):
        capacity, refill = rng.choice([1, 2, 3.5, 20]), rng.choice([0, 0.1, 0.7, 3])
        at, times = 0.0, []
        for _ in range(400):
            at += rng.choice([0, 0.01, 0.3, 2, 30])
            times.append(round(at, 6))
        rows += [(f"{i:04}", "t", f"c{k}", "r", t, float(capacity), float(refill), None) for i, t in enumerate(times)]
        wants[f"c{k}"] = fold([(int(t * 1_000_000), int(capacity * B.TOKEN), int(refill * 10**12)) for t in times], variant == "shared")
    df = requests(spark, rows)
    for seconds in (5, 60, 10**6):
        out = replay(df, variant=variant, chunk_seconds=seconds).orderBy("client_id", "id").collect()
        got = {}
        for r in out:
            got.setdefault(r["client_id"], []).append((r["allowed"], r["remaining"], r["retry_after_ns"]))
        assert got == wants


def test_transfer_equals_replay():
    rng = random.Random(3)
    for _ in range(300):
        capacity, refill = rng.choice([1, 2, 5]) * B.TOKEN + rng.choice([0, B.TOKEN // 3]), rng.choice([0, 150_000 * 10**6, 900_000 * 10**6])
        gaps = [0] + [rng.choice([0, 10**5, 10**6, 5 * 10**6]) for _ in range(rng.randint(0, 12))]
        run = B.Transfer()
        for gap in gaps:
            run.request(B.gain(gap, refill, False), capacity)
        starts, slopes, offsets = zip(*run.pieces)
        assert len(run.pieces) <= 20
        for start in [0, B.TOKEN - 1, B.TOKEN, capacity, *(rng.randrange(capacity) for _ in range(5))]:
            tokens = start
            for gap in gaps:
                tokens = B.take(tokens + B.gain(gap, refill, False), capacity, refill, False)[0]
            assert B.apply_pieces(starts, slopes, offsets, start) == tokens


def test_segments_start_full(spark):
    df = requests(spark, burst([0, 1, 2, 70, 71, 200], 3, None, 1))
    out = bucket_segments(df).orderBy("created_at").collect()
    assert [r["segment"] for r in out] == [0, 0, 0, 1, 1, 2]


ROUTE = "id string, tenant_id string, name string, gateway_path string, upstream_url string, allowed_methods array<string>, timeout_ms int, authentication_required boolean, active boolean"


def route(i, path, methods=("GET",), auth=True, active=True, tenant="tenant-a"):
    return (i, tenant, i, path, "https://x.example.com", list(methods), 5000, auth, active)


def test_longest_active_path_wins(spark):
    routes = spark.createDataFrame(
        [route("a", "/a"), route("ab", "/a/b"), route("abs", "/a/b/"), route("abc", "/a/b/c", active=False), route("pct", "/p%"), route("b", "/b", tenant="tenant-b")],
        ROUTE,
    )
    paths = ["/a", "/a/x", "/a/b", "/a/b/", "/a/b/c", "/ab", "/p%", "/pq", "/b"]
    asked = spark.createDataFrame([("tenant-a", p) for p in paths], "tenant_id string, path string")
    got = {r["path"]: r["route"]["id"] if r["route"] else None for r in resolve.resolve_routes(asked, routes).collect()}
    assert got == {"/a": "a", "/a/x": "a", "/a/b": "ab", "/a/b/": "abs", "/a/b/c": "abs", "/ab": None, "/p%": "pct", "/pq": None, "/b": None}


POLICY = "id string, tenant_id string, api_client_id string, route_id string, bucket_capacity double, refill_rate double, enabled boolean"


def test_policy_specificity(spark):
    policies = spark.createDataFrame(
        [("cr", "t", "c", "r", 1.0, 0.0, True), ("c", "t", "c", None, 1.0, 0.0, True), ("r", "t", None, "r", 1.0, 0.0, True),
         ("t", "t", None, None, 1.0, 0.0, True), ("off", "t", "d", "r", 1.0, 0.0, False), ("blank", "t", "e", "", 1.0, 0.0, True)],
        POLICY,
    )
    keys = spark.createDataFrame([("t", c, r) for c in "cdex" for r in "rs"] + [("u", "c", "r")], "tenant_id string, client_id string, route_id string")
    got = {(r["tenant_id"], r["client_id"], r["route_id"]): r["policy"]["id"] if r["policy"] else None for r in resolve.resolve_policies(keys, policies).collect()}
    assert got == {
        ("t", "c", "r"): "cr", ("t", "c", "s"): "c", ("t", "d", "r"): "r", ("t", "d", "s"): "t", ("t", "e", "r"): "blank",
        ("t", "e", "s"): "blank", ("t", "x", "r"): "r", ("t", "x", "s"): "t", ("u", "c", "r"): None,
    }


def test_second_request_is_refused(spark):
    key = "key_test_0000001_secret"
    clients = spark.createDataFrame([("client-a", "tenant-a", key[:16], "active")], "id string, tenant_id string, api_key_prefix string, status string").withColumn("api_key_hash", F.sha2(F.lit(key), 256))
    routes = spark.createDataFrame([route("route-a", "/gateway"), route("open", "/open", auth=False)], ROUTE)
    policies = spark.createDataFrame([("p", "tenant-a", "client-a", None, 1.0, 0.0, True)], POLICY)
    rows = [("1", "/gateway", "GET", key), ("2", "/gateway", "GET", key), ("3", "/gateway", "POST", key), ("4", "/gateway", "GET", "wrong"), ("5", "/none", "GET", key), ("6", "/open", "GET", "")]
    asked = spark.createDataFrame([("tenant-a", *r) for r in rows], "tenant_id string, id string, path string, method string, api_key string").withColumn(
        "created_at", F.timestamp_seconds(F.col("id").cast("bigint"))
    )
    out = {r["id"]: r for r in admission.admission_audit(asked, clients, routes, policies).collect()}
    assert {i: r["status"] for i, r in out.items()} == {"1": 200, "2": 429, "3": 405, "4": 401, "5": 404, "6": 200}
    assert (out["2"]["rate_limit"], out["2"]["rate_remaining"], out["2"]["rate_reset_seconds"]) == (1.0, 0.0, 1)
    assert (out["1"]["rate_remaining"], out["1"]["rate_reset_seconds"], out["6"]["rate_limit"]) == (0.0, 0, None)


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://localhost:80/x", "loopback"), ("http://[::1]/", "loopback"), ("http://[fd00::1]:8080/", "private"),
        ("http://[fe80::1]/", "link-local"), ("http://[::ffff:10.0.0.1]/", "private"), ("https://172.32.0.1/", None),
        ("https://user@192.168.0.1/", "private"), ("https://example.com/", None), ("http://[2001:db8::1]/", None), ("http://300.1.1.1/", None),
        ("http://[::ffff:7f00:1]/", "loopback"), ("http://[0:0:0:0:0:ffff:10.0.0.1]/", "private"), ("http://[::ffff:a9fe:a9fe]/", "metadata"),
        ("http://[::]/", None), ("http://[FE80::1%25eth0]/", "link-local"), ("http://[::127.0.0.1]/", None), ("http://[::ffff:10.0.0.999]/", None),
    ],
)
def test_unsafe_upstreams(spark, url, want):
    assert spark.range(1).select(quality.unsafe_upstream(F.lit(url)).alias("u")).first()["u"] == want
