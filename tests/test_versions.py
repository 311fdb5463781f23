import pytest
from pyspark.sql import functions as F

from callscope.operators import upsert
from callscope.sources.versions import ConflictError, VersionedTable, bucket_of

KIND = "tenant_id string, source_type string, source_id string, content_hash string, chunk_index int, body string, id long, created_at timestamp, updated_at timestamp"


def chunks(spark, rows, at):
    made = [("t", "document", s, h, i, body, n, None, None) for n, (s, h, i, body) in enumerate(rows)]
    when = F.timestamp_micros(F.lit(at * 10**6))
    return spark.createDataFrame(made, KIND).withColumns({"created_at": when, "updated_at": when})


def seen(df):
    return {(r["source_id"], r["content_hash"], r["chunk_index"]): (r["body"], r["created_at"].second, r["updated_at"].second) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"s{n % 40}", f"h{n}", n % 3, "old") for n in range(200)]
    return VersionedTable.create(chunks(spark, rows, 1), str(tmp_path / "chunks"), upsert.CHUNK_KEY, 16)


def test_merge_touches_few_buckets_and_keeps_versions(spark, table):
    batch = chunks(spark, [("s3", "h3", 0, "new"), ("s3", "fresh", 9, "new")], 5)
    before, files = seen(table.read()), table.files()
    done = table.merge(batch, upsert.upsert_chunks)
    assert done.version == 1 and 1 <= done.touched <= 2 and done.kept == len(files) - done.touched
    want = before | {("s3", "h3", 0): ("new", 1, 5), ("s3", "fresh", 9): ("new", 5, 5)}
    assert seen(table.read()) == want and seen(table.read(0)) == before
    assert sum(table.files()[b] != f for b, f in files.items()) <= done.touched


def test_only_touched_files_are_read(spark, table):
    batch = chunks(spark, [("s3", "h3", 0, "new")], 5)
    scanned = []

    def rule(stored, incoming):
        scanned.extend(stored.inputFiles())
        return upsert.upsert_chunks(stored, incoming)

    table.merge(batch, rule)
    bucket = batch.select(bucket_of(upsert.CHUNK_KEY, 16)).first()[0]
    assert scanned and all(f"_bucket={bucket}/" in f for f in scanned)


def test_second_writer_is_refused(spark, table):
    one, two = (chunks(spark, [("s3", "h3", 0, who)], 5) for who in ("one", "two"))
    table.merge(one, upsert.upsert_chunks, base=0)
    with pytest.raises(ConflictError):
        table.merge(two, upsert.upsert_chunks, base=0)
    assert table.versions() == [0, 1] and seen(table.read())[("s3", "h3", 0)][0] == "one"
    table.merge(two, upsert.upsert_chunks)
    assert seen(table.read())[("s3", "h3", 0)][0] == "two"


def test_replacing_sources_can_empty_buckets(spark, tmp_path):
    rows = chunks(spark, [(f"s{n % 4}", f"h{n}", n, "old") for n in range(40)], 1)
    table = VersionedTable.create(rows, str(tmp_path / "t"), upsert.SOURCE_KEY, 64)
    table.merge(chunks(spark, [("s1", "only", 0, "new")], 7), upsert.replace_sources)
    assert [r["content_hash"] for r in table.read().where("source_id = 's1'").collect()] == ["only"]
    assert table.read().count() == 31
    table.merge(chunks(spark, [("s1", "only", 0, "new")], 7), lambda stored, incoming: upsert.delete_by_source(stored, incoming))
    assert table.read().count() == 30 and len(table.files()) == 3
    table.rewrite(lambda stored: stored.where("false"))
    assert table.read().count() == 0 and table.files() == {} and table.read(1).count() == 31


def test_empty_and_unknown_tables(spark, tmp_path):
    empty = VersionedTable.create(chunks(spark, [], 1), str(tmp_path / "none"), upsert.CHUNK_KEY)
    assert empty.read().count() == 0
    assert empty.merge(chunks(spark, [], 1), upsert.upsert_chunks).touched == 0
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "missing")).read()
    with pytest.raises(ConflictError):
        VersionedTable.create(chunks(spark, [], 1), str(tmp_path / "none"), upsert.CHUNK_KEY)
