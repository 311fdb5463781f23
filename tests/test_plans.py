"""Physical plans: exchanges, pushed filters, and no nested-loop joins."""

import re

import pytest
from pyspark.sql import functions as F

from callscope.operators import features, scan, traffic
from callscope.plans import queries
from callscope.schemas import REQUEST_LOGS
from callscope.sources import adapters as A


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def logs(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs") / "t")
    A.request_logs(spark, sf_dir).write.parquet(path)
    return spark.read.schema(REQUEST_LOGS).parquet(path)


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_minute_features_take_two_exchanges(logs):
    assert exchanges(plan(features.minute_features(logs))) == 2


def test_tenant_and_time_reach_the_scan(logs):
    from datetime import datetime, timezone

    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    text = details(features.minute_features(scan.range_scan(logs, "tenant-1", at(1), at(3))))
    assert "EqualTo(tenant_id,tenant-1)" in text and "GreaterThanOrEqual(created_at" in text
    assert "request_id" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_bounded_scan_takes_ordered(logs):
    from datetime import datetime, timezone

    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    assert "TakeOrderedAndProject" in plan(scan.bounded_scan(logs, "tenant-1", at(1), at(3), limit=10))


def test_newest_rows_are_limited_below_the_shuffle(logs):
    text = plan(scan.recent_logs(logs))
    assert text.count("WindowGroupLimit") >= 2


def test_panels_read_the_log_once(spark, sf_dir, logs):
    text = plan(traffic.traffic_panels(logs, A.api_clients(spark, sf_dir), A.gateway_routes(spark, sf_dir)))
    assert len(re.findall(r"FileScan parquet .*latency_ms", text)) == 1


LAZY = [
    "tenant_summary", "traffic_panels", "dashboard_summary", "recent_logs", "minute_features", "supervised_windows", "chronological_split",
    "key_lookup", "route_resolution", "policy_resolution", "token_bucket_replay", "admission_audit", "bucket_segments", "referential_audit",
    "uniqueness_audit", "policy_upsert", "client_feed_apply", "chunk_replace", "clean_documents", "redaction", "assistant_answers",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_python_only_where_declared(spark, sf_dir):
    for name in set(LAZY) - {"token_bucket_replay", "admission_audit"}:
        text = plan(queries()[name](spark, sf_dir))
        assert "InPandas" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text, name
