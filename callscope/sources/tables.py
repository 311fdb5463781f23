"""Table, log-line, dataset and document sources and sinks, all with explicit schemas."""

from __future__ import annotations

import os
import re
import shutil
import unicodedata
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.columns import blank_to_null
from callscope.operators.datasets import dataset_order
from callscope.operators.features import WINDOW_KEYS
from callscope.operators.upsert import append_logs
from callscope.schemas import FORECAST_SERIES, TRAINING_DATASET, require_columns

__all__ = [
    "access_log",
    "append_logs",
    "markdown_corpus",
    "read_jdbc",
    "read_series",
    "read_table",
    "read_training",
    "write_corpus",
    "write_report",
    "write_series",
    "write_training",
]


def read_table(spark: SparkSession, path: str, schema: T.StructType, source: str = "parquet", **options) -> DataFrame:
    """A Parquet, CSV, JSON or ORC table with the given schema; nothing is inferred."""
    if source not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unsupported source: {source}")
    if source == "csv":
        options = {"header": True, **options}
        flat = T.StructType(
            [T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.ArrayType, T.MapType)) else f.dataType) for f in schema]
        )
        rows = spark.read.schema(flat).options(**options).csv(path)
        nested = {f.name: F.from_json(f.name, f.dataType) for f in schema if f.dataType != flat[f.name].dataType}
        return rows.withColumns(nested) if nested else rows
    return spark.read.schema(schema).options(**options).format(source).load(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, lower: str, upper: str, partitions: int, column: str = "created_at", **properties
) -> DataFrame:
    """A database table, read in parallel by ranges of a time column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **properties
    ).load()


# The fields of a gateway log line, and the message that marks a request.
REQUEST_MESSAGE = "gateway_request"
LOG_LINE = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("response_status", T.IntegerType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("rate_limited", T.BooleanType()),
        # the older form of the line
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("gateway_route", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(request-log rows, corrupt lines) from JSON log lines; other messages are left out.

    Works on batch and streaming text. The path goes to ``route_path``: a line names no
    route id, which route resolution can add.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_l", F.from_json(column, LOG_LINE, options))
    bad = parsed.where(F.col("_l").isNull() | F.col("_l._corrupt").isNotNull()).select(F.col(column).alias("line"))
    good = parsed.where(F.col("_l._corrupt").isNull() & (F.col("_l.msg") == REQUEST_MESSAGE)).select("_l.*")
    return good.select(
        F.col("request_id").alias("id"),
        "request_id",
        "tenant_id",
        blank_to_null("client_id").alias("client_id"),
        F.lit(None).cast("string").alias("route_id"),
        "method",
        F.col("response_status").alias("status_code"),
        "latency_ms",
        F.col("rate_limited").alias("blocked"),
        F.coalesce("timestamp", "time").alias("created_at"),
        F.coalesce("route", F.regexp_extract("gateway_route", r"^\S+ (.*)$", 1)).alias("route_path"),
        F.nullif("client_name", F.lit("unknown")).alias("client_name"),
    ), bad


def access_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path))


# --- datasets and reports ---------------------------------------------------------


def write_training(dataset: DataFrame, path: str, source: str = "parquet") -> None:
    """The labelled dataset in its column order, sorted by split, scenario and window."""
    names = [f.name for f in TRAINING_DATASET]
    require_columns(dataset, names)
    writer = dataset_order(dataset.select(*names)).write.mode("errorifexists")
    writer.csv(path, header=True) if source == "csv" else writer.parquet(path)


def read_training(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return read_table(spark, path, TRAINING_DATASET, source)


def write_features(features: DataFrame, path: str) -> None:
    """Minute features in order of tenant, client, route and window, over all files."""
    features.orderBy(*WINDOW_KEYS).write.mode("errorifexists").parquet(path)


def write_series(series: DataFrame, path: str, source: str = "parquet") -> None:
    names = [f.name for f in FORECAST_SERIES]
    require_columns(series, names)
    writer = series.select(*names).write.mode("errorifexists")
    writer.csv(path, header=True) if source == "csv" else writer.parquet(path)


def read_series(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return read_table(spark, path, FORECAST_SERIES, source)


def write_report(metrics: DataFrame, chosen: DataFrame, composition: DataFrame, path: str) -> None:
    """One JSON row: metrics per model, the recommended candidate and the data behind them.

    The inputs are a few rows each (one per model or split).
    """
    models = metrics.select(F.col("algorithm").alias("k"), F.struct(*[c for c in metrics.columns if c != "algorithm"]).alias("v"))
    packed = models.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("models"))
    data = composition.agg(F.collect_list(F.struct(*composition.columns)).alias("datasets"))
    one = lambda df: df.withColumn("_j", F.lit(1))
    report = one(packed).join(one(data), "_j").join(one(chosen), "_j").drop("_j")
    report.withColumn("promotion", F.lit("not performed; inspect the evidence before deployment")).coalesce(1).write.mode(
        "errorifexists"
    ).json(path)


# --- documents ---------------------------------------------------------------------

#: Paths listed, and bytes of files read, before they leave a task's hands.
LISTED_PATHS = 10_000
READ_BYTES = 4 << 20


def _qualified(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)


def _mounted(spark: SparkSession, folder: str) -> bytes | None:
    """The path of a folder on a local or mounted file system, which tasks reach without Spark's file source."""
    uri = _qualified(spark, folder).toUri()
    return os.fsencode(uri.getPath()) if uri.getScheme() == "file" else None


def write_corpus(rows: DataFrame, folder: str, key: str, text: str) -> None:
    """Texts as files below a new folder: rows of one key in one task make one file, a line each.

    On a local or mounted file system tasks write the files themselves, into a folder of
    their own that gets its name when it is whole: Hadoop starts several processes a file
    there, to set permissions. Elsewhere Spark writes a folder for each key.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias(key), F.col(text).alias("value"))
    root = _mounted(spark, folder)
    if root is None:
        # Tasks move their files themselves; otherwise the driver would move the folders one by one.
        rows.write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
        return
    os.makedirs(root)
    named = rows.select(F.col(key).cast("string"), F.col("value").cast("binary"))
    named.mapInArrow(_written(root, key), "files long").write.format("noop").mode("overwrite").save()


def _written(root: bytes, key: str):
    def run(batches):
        own, n = os.path.join(root, b"_part-" + uuid.uuid4().hex.encode()), 0
        try:
            for batch in batches:
                if batch.num_rows:
                    os.makedirs(own, exist_ok=True)
                for value, text in zip(*(column.to_pylist() for column in batch.columns)):
                    name = "__HIVE_DEFAULT_PARTITION__" if value is None else _as_uri(value).replace("/", "%2F")
                    with open(os.path.join(own, f"{key}={name}.txt".encode()), "ab") as file:
                        file.write((text or b"") + b"\n")
                    n += 1
            if n:
                _named(own, os.path.join(root, b"part-%05d" % TaskContext.get().partitionId()))
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def _named(own: bytes, final: bytes) -> None:
    """A whole folder gets its name; another attempt of the task that was first keeps its own."""
    try:
        os.rename(own, final)
    except OSError:
        if not os.path.isdir(final):
            raise
        shutil.rmtree(own, ignore_errors=True)


def markdown_corpus(spark: SparkSession, folder: str, tenant_id: str, *, pattern: str = "*.md") -> DataFrame:
    """Markdown files below a folder as source documents; the id is the path inside it.

    On a local or mounted file system tasks list and read the files, so no list of them
    reaches the driver; elsewhere Spark's file source does. Both leave out empty files and
    hidden ones.
    """
    root = _mounted(spark, folder)
    if root is not None and os.path.isdir(root) and not set(folder) & set("{}[]*?\\") and _plain(spark, pattern):
        files = _read_by_tasks(spark, root, pattern)
    else:
        files = _read_by_spark(spark, folder, pattern)
    return files.select(
        F.lit(tenant_id).alias("tenant_id"),
        F.lit("document").alias("source_type"),
        "source_id",
        "source_name",
        "content",
    )


def _read_by_spark(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    base = _qualified(spark, folder).toString().rstrip("/") + "/"
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    prefix = base.replace("file:///", "file:/")
    inside = F.substr(path, F.lit(len(prefix) + 1))
    return files.select(inside.alias("source_id"), F.col("_metadata.file_name").alias("source_name"), F.col("value").alias("content"))


def _read_by_tasks(spark: SparkSession, root: bytes, pattern: str) -> DataFrame:
    shape = "inside binary, folder boolean"
    # The tree is dealt out by what lies in its root, the files found are dealt out again.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    top = spark.range(1, numPartitions=1).select(F.lit(b"").alias("inside"), F.lit(True).alias("folder"))
    top = top.mapInArrow(_listed(root, wanted, whole=False), shape).repartition(parts, "inside")
    paths = top.mapInArrow(_listed(root, wanted, whole=True), shape).select("inside").repartition(parts, "inside")
    files = paths.mapInArrow(_contents(root), "source_id string, source_name string, content binary")
    return files.withColumn("content", F.col("content").cast("string"))


def _plain(spark: SparkSession, pattern: str) -> bool:
    """Whether every file that a pattern names has an ending, and none of a compressed file."""
    end = re.split(r"[]{}*?\\[]", pattern)[-1]
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return "." in end and codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(f"x{end}")) is None


def _entries(root: bytes, inside: bytes):
    """(path inside the root, whether it is a folder) of what lies in a folder and is not hidden from Spark."""
    with os.scandir(os.path.join(root, inside)) as found:
        for entry in found:
            name, folder = entry.name, entry.is_dir()
            hidden = name.startswith(b".") or name.endswith(b"._COPYING_") or (name.startswith(b"_") and b"=" not in name)
            if hidden and not (folder and name.startswith((b"_metadata", b"_common_metadata"))):
                continue
            if folder or not entry.is_symlink() or os.path.exists(entry.path):
                yield os.path.join(inside, name), folder


def _listed(root: bytes, wanted: str, whole: bool):
    """Folders give way to what lies in them, or to all the files below them; files are passed on."""

    def run(batches):
        match = re.compile(wanted, re.DOTALL).fullmatch
        out = []
        for batch in batches:
            for inside, folder in zip(*(column.to_pylist() for column in batch.columns)):
                if not folder:
                    out.append((inside, folder))
                todo = [inside] if folder else []
                while todo:
                    for entry in _entries(root, todo.pop()):
                        if entry[1] and whole:
                            todo.append(entry[0])
                        elif entry[1] or match(os.path.basename(entry[0]).decode("utf-8", "replace")):
                            out.append(entry)
                        if len(out) >= LISTED_PATHS:
                            yield _paths(out)
                            out = []
        yield _paths(out)

    return run


def _paths(entries: list) -> pa.RecordBatch:
    inside, folder = zip(*entries) if entries else ((), ())
    return pa.RecordBatch.from_pydict({"inside": pa.array(inside, pa.binary()), "folder": pa.array(folder, pa.bool_())})


def _contents(root: bytes):
    """Ids, names and bytes of the files that have any."""

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for inside in batch.column(0).to_pylist():
                with open(os.path.join(root, inside), "rb") as file:
                    text = file.read()
                if not text:
                    continue
                ids.append(_as_uri(inside.decode("utf-8", "replace")))
                texts.append(text)
                size += len(text)
                if size >= READ_BYTES:
                    yield _texts(ids, texts)
                    ids, texts, size = [], [], 0
        yield _texts(ids, texts)

    return run


def _texts(ids: list[str], texts: list[bytes]) -> pa.RecordBatch:
    names = [i.rpartition("/")[2] for i in ids]
    return pa.RecordBatch.from_pydict(
        {"source_id": pa.array(ids, pa.string()), "source_name": pa.array(names, pa.string()), "content": pa.array(texts, pa.binary())}
    )


def _as_uri(path: str) -> str:
    """A path as Spark's file source names it: characters that no URI holds as bytes in hexadecimal."""

    def stands(found):
        c = found[0]
        if ord(c) > 0x9F and unicodedata.category(c) not in ("Zs", "Zl", "Zp"):
            return c
        return "".join(f"%{b:02X}" for b in c.encode())

    return re.sub(r"[^A-Za-z0-9_.!~*'():@&=+$,;/-]", stands, path)
