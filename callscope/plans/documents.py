"""Registered queries: document ingest and text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import text
from callscope.functions.columns import norm
from callscope.operators import assistant, documents, retrieval, scan, traffic, upsert
from callscope.plans.traffic import SUMMARY_SQL
from callscope.session import materialise, scratch_dir
from callscope.sources import adapters as A
from callscope.sources.versions import BUCKETS, ConflictError, VersionedTable

QUERIES, ORACLES = {}, {}

_BREAK, _EDGE = documents.LINE_BREAK, documents.EDGE_SPACE
CLEAN_SQL = f"""cleaned AS MATERIALIZED (SELECT doc_id, tenant_id, source_id,
  array_to_string(list_filter(list_transform(string_split_regex(content, '{_BREAK}'), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)) AS content
  FROM source_documents)"""


def clean_documents(spark, sf_dir):
    docs = A.source_documents(spark, sf_dir)
    return docs.select("doc_id", documents.clean_text("content").alias("content"))


QUERIES["clean_documents"] = clean_documents
ORACLES["clean_documents"] = A.with_ctes(A.SQL_DOCUMENTS, CLEAN_SQL, "SELECT doc_id, content FROM cleaned")


def chunk_documents(spark, sf_dir):
    docs = A.source_documents(spark, sf_dir).withColumn("content", documents.clean_text("content"))
    return documents.chunk_documents(docs, ["doc_id"])


def chunk_hash(spark, sf_dir):
    """Chunk rows of accepted documents: key, section and content hash."""
    good, _ = documents.split_documents(A.source_documents(spark, sf_dir))
    return documents.chunk_rows(good).select("tenant_id", "source_id", "section", "chunk_index", "content_hash")


# The packing as two recursions: over the parts of a long line, then over a document's parts.
CHUNK_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(content, chr(10) || chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS n FROM cleaned WHERE content <> ''),
parts AS (
  SELECT doc_id, n, 0 AS part, CAST(NULL AS VARCHAR) AS piece, line AS rest FROM lines
  UNION ALL
  SELECT doc_id, n, part + 1, regexp_replace(substr(rest, 1, cut), '{_EDGE}', '', 'g'), regexp_replace(substr(rest, cut + 1), '{_EDGE}', '', 'g')
  FROM (SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN space < 900 THEN 1800 ELSE space END AS cut
    FROM (SELECT *, length(regexp_extract(substr(rest, 1, 1801), '(?s)^(.*) ', 1)) AS space FROM parts WHERE rest <> ''))),
pieces AS MATERIALIZED (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY n, part) AS n FROM parts WHERE part > 0),
packed AS (
  SELECT doc_id, n, piece AS held, CAST(NULL AS VARCHAR) AS done FROM pieces WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN length(held) + 2 + length(piece) <= 1800 THEN held || chr(10) || chr(10) || piece
      WHEN tail = '' THEN piece ELSE tail || chr(10) || chr(10) || piece END,
    CASE WHEN length(held) + 2 + length(piece) <= 1800 THEN NULL ELSE held END
  FROM (SELECT k.doc_id, p.n, k.held, p.piece,
      CASE WHEN length(regexp_replace(right(k.held, 240), '{_EDGE}', '', 'g')) <= 1798 - length(p.piece) THEN regexp_replace(right(k.held, 240), '{_EDGE}', '', 'g')
        ELSE regexp_replace(right(regexp_replace(right(k.held, 240), '{_EDGE}', '', 'g'), greatest(0, 1798 - length(p.piece))), '{_EDGE}', '', 'g') END AS tail
    FROM packed k JOIN pieces p ON p.doc_id = k.doc_id AND p.n = k.n + 1)),
finished AS (SELECT doc_id, n, done AS content FROM packed WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, n + 1, held FROM packed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index, 'Document' AS section, content FROM finished)"""


def _recursive(*parts: str) -> str:
    return A.with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES["chunk_documents"] = chunk_documents
ORACLES["chunk_documents"] = _recursive(
    A.SQL_DOCUMENTS, CLEAN_SQL, CHUNK_SQL, "SELECT doc_id, chunk_index, section, content FROM chunks"
)
QUERIES["chunk_hash"] = chunk_hash
ORACLES["chunk_hash"] = _recursive(
    A.SQL_DOCUMENTS,
    CLEAN_SQL,
    CHUNK_SQL,
    """SELECT c.tenant_id, c.source_id, k.section, k.chunk_index, sha256(k.content) AS content_hash FROM chunks k JOIN cleaned c USING (doc_id)""",
)


def rejected_documents(spark, sf_dir):
    """Documents whose ids or text were damaged by a rule on the id."""
    d = F.col("doc_id")
    docs = A.source_documents(spark, sf_dir).withColumns(
        {
            "source_id": F.when(d % 7 == 1, F.concat(F.lit("../"), "source_id")).when(d % 7 == 2, " ").otherwise(F.col("source_id")),
            "content": F.when(d % 7 == 3, "\n \r\n").otherwise(F.concat(F.lit("x "), F.col("content"))),
            "tenant_id": F.when(d % 7 == 4, " ").otherwise(F.col("tenant_id")),
        }
    )
    _, bad = documents.split_documents(docs)
    return bad.select("doc_id", "problem")


QUERIES["rejected_documents"] = rejected_documents
ORACLES["rejected_documents"] = """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'unsafe source_id' WHEN 2 THEN 'source_id is required'
  WHEN 3 THEN 'document content is empty' ELSE 'tenant_id is required' END AS problem FROM documents WHERE doc_id % 7 IN (1, 2, 3, 4)"""


def _source_batches(spark, sf_dir):
    """Documents as chunks, and a batch in which sources of odd number come in again with half of their documents and new text."""
    docs = A.source_documents(spark, sf_dir)
    at = lambda s: F.timestamp_micros(F.lit(A.BASE_MICROS + s * 10**6))
    shape = lambda df, s: documents.with_hash(df).select(
        "tenant_id",
        "source_type",
        F.col("source_name").alias("source_id"),
        F.col("doc_id").cast("int").alias("chunk_index"),
        "content",
        "content_hash",
        F.col("doc_id").alias("id"),
        at(s).alias("created_at"),
        at(s).alias("updated_at"),
    )
    odd = F.pmod(F.ascii(F.substring("source_name", -1, 1)), F.lit(2)) == 1
    again = docs.where(odd & (F.col("doc_id") % 4 < 2)).withColumn("content", F.concat("content", F.lit(" again")))
    return shape(docs, 0), materialise(shape(again, 60), "batch")


def chunk_replace(spark, sf_dir):
    """The batch replaces its sources in a committed version of the chunk table."""
    stored, batch = _source_batches(spark, sf_dir)
    table = VersionedTable.create(stored, scratch_dir(spark, "chunks"), upsert.SOURCE_KEY)
    table.merge(batch, upsert.replace_sources)
    return table.read().select("tenant_id", "source_id", "chunk_index", "content_hash", F.date_format("updated_at", "mm:ss").alias("updated_at"))


QUERIES["chunk_replace"] = chunk_replace
ORACLES["chunk_replace"] = A.with_ctes(
    A.SQL_DOCUMENTS,
    """SELECT tenant_id, source_name AS source_id, CAST(doc_id AS INTEGER) AS chunk_index, sha256(content) AS content_hash, '00:00' AS updated_at
FROM source_documents d WHERE NOT EXISTS (SELECT 1 FROM source_documents e WHERE e.tenant_id = d.tenant_id AND e.source_name = d.source_name
  AND ascii(right(e.source_name, 1)) % 2 = 1 AND e.doc_id % 4 < 2)
UNION ALL SELECT tenant_id, source_name, CAST(doc_id AS INTEGER), sha256(content || ' again'), '01:00' FROM source_documents
WHERE ascii(right(source_name, 1)) % 2 = 1 AND doc_id % 4 < 2""",
)


def chunk_versions(spark, sf_dir):
    """What every version holds, and what its commit wrote and left alone; a merge from an old version is refused."""
    stored, batch = _source_batches(spark, sf_dir)
    table = VersionedTable.create(stored, scratch_dir(spark, "chunks"), upsert.SOURCE_KEY)
    first = table.files()
    commits = [table.merge(batch, upsert.replace_sources), table.merge(batch, upsert.delete_by_source)]
    try:
        table.merge(batch, upsert.replace_sources, base=0)
        refused = False
    except ConflictError:
        refused = True
    written = [(c.version, c.touched, c.kept, sum(table.files(c.version).get(b) == f for b, f in first.items())) for c in commits]
    facts = spark.createDataFrame([(0, len(first), 0, len(first)), *written], "version int, touched int, kept int, first_files int")
    held = reduce(
        lambda a, b: a.unionByName(b),
        [table.read(v).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.date_format("updated_at", "mm:ss") == "01:00").alias("new_rows")).withColumn("version", F.lit(v)) for v in table.versions()],
    )
    return facts.join(held, "version").withColumn("refused", F.lit(refused))


_BUCKET_SQL = f"CAST('0x' || md5(concat_ws(chr(31), tenant_id, source_type, source_name))[1:8] AS BIGINT) % {BUCKETS}"

QUERIES["chunk_versions"] = chunk_versions
ORACLES["chunk_versions"] = A.with_ctes(
    A.SQL_DOCUMENTS,
    f"""docs AS (SELECT tenant_id, source_type, source_name, doc_id, {_BUCKET_SQL} AS bucket,
  ascii(right(source_name, 1)) % 2 = 1 AND doc_id % 4 < 2 AS again FROM source_documents),
sources AS (SELECT tenant_id, source_type, source_name, any_value(bucket) AS bucket, count(*) AS n, count(*) FILTER (WHERE again) AS news FROM docs GROUP BY ALL),
buckets AS (SELECT bucket, bool_or(news > 0) AS touched FROM sources GROUP BY 1),
totals AS (SELECT CAST(count(*) AS INTEGER) AS all_, CAST(count(*) FILTER (WHERE touched) AS INTEGER) AS hit,
  CAST(count(*) FILTER (WHERE NOT touched) AS INTEGER) AS rest FROM buckets),
held AS (SELECT sum(n) AS rows0, sum(CASE WHEN news > 0 THEN news ELSE n END) AS rows1, sum(news) AS news, sum(n) FILTER (WHERE news = 0) AS rows2 FROM sources)
SELECT version, touched, kept, first_files, CAST(row_count AS BIGINT) AS row_count, CAST(new_rows AS BIGINT) AS new_rows, true AS refused FROM (
  SELECT 0 AS version, all_ AS touched, 0 AS kept, all_ AS first_files, rows0 AS row_count, 0 AS new_rows FROM totals, held
  UNION ALL SELECT 1, hit, rest, rest, rows1, news FROM totals, held
  UNION ALL SELECT 2, hit, rest, rest, rows2, 0 FROM totals, held)""",
)


def chunk_upsert(spark, sf_dir):
    """A batch that repeats every stored chunk twice (later name wins) and adds a new one each, committed as a version."""
    docs = documents.with_hash(A.source_documents(spark, sf_dir))
    at = lambda s: F.timestamp_micros(F.lit(A.BASE_MICROS + s * 10**6))
    shape = lambda index, name, s: docs.select(
        "tenant_id",
        "source_type",
        "source_id",
        F.lit(index).alias("chunk_index"),
        F.lit(name).alias("source_name"),
        "content_hash",
        F.col("doc_id").alias("id"),
        at(s).alias("created_at"),
        at(s).alias("updated_at"),
    )
    batch = shape(0, "second", 2).unionByName(shape(0, "third", 3)).unionByName(shape(1, "fresh", 4))
    table = VersionedTable.create(shape(0, "first", 1), scratch_dir(spark, "chunks"), upsert.CHUNK_KEY, 16)
    table.merge(materialise(batch, "batch"), upsert.upsert_chunks)
    return table.read().select("source_id", "chunk_index", "source_name", F.date_format("created_at", "ss").alias("made"), F.date_format("updated_at", "ss").alias("changed"))


QUERIES["chunk_upsert"] = chunk_upsert
ORACLES["chunk_upsert"] = A.with_ctes(
    A.SQL_DOCUMENTS,
    """SELECT source_id, CAST(0 AS INTEGER) AS chunk_index, 'third' AS source_name, '01' AS made, '03' AS changed FROM source_documents
UNION ALL SELECT source_id, CAST(1 AS INTEGER), 'fresh', '04', '04' FROM source_documents""",
)


def embedded_documents(spark, sf_dir):
    """Default vectors of whole documents: dimension, norm and filled places."""
    out = documents.embed(A.source_documents(spark, sf_dir), "content")
    filled = F.size(F.filter("embedding", lambda x: x != 0))
    words = F.array_remove(F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{N}]+")), "")
    fits = (filled <= F.size(words)) & ((filled > 0) == (F.size(words) > 0))
    return out.select("doc_id", F.size("embedding").alias("dimension"), F.round(norm("embedding"), 4).alias("norm"), F.coalesce(fits, F.lit(True)).alias("filled_fits"))


QUERIES["embedded_documents"] = embedded_documents
ORACLES["embedded_documents"] = """SELECT doc_id, CAST(384 AS INTEGER) AS dimension,
  CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, true AS filled_fits FROM documents"""


def question_embedding(spark, sf_dir):
    """Questions embedded with their instruction by a given embedder: the vectors of the texts with the instruction before them."""

    def letters(texts):
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    docs = A.source_documents(spark, sf_dir).where(F.col("content").rlike("[a-z]"))
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "tenant_id", F.col("content").alias("question"))
    stored = docs.withColumn("said", F.concat(F.lit(documents.QUERY_INSTRUCTION), "content"))
    chunks = documents.embed(stored, "said", embedder=letters)
    questions = documents.embed(asked, "question", embedder=letters, instruction=documents.QUERY_INSTRUCTION, alias="vector")
    same = questions.join(chunks.select("tenant_id", F.col("doc_id").alias("query_id"), "embedding"), ["tenant_id", "query_id"])
    return same.select("query_id", (F.col("vector") == F.col("embedding")).alias("same_vector"), F.size("vector").alias("dimension"))


QUERIES["question_embedding"] = question_embedding
ORACLES["question_embedding"] = """SELECT doc_id AS query_id, true AS same_vector, CAST(26 AS INTEGER) AS dimension FROM documents
WHERE doc_id % 20 = 0 AND regexp_matches(text, '[a-z]')"""


# --- text rules -------------------------------------------------------------------

SECRETS = (
    "Authorization: Bearer abc.{n}",
    "X-API-Key: sk-test-{n}",
    "bearer tok{n} and api_key={n}xyz",
    "password = hunter{n}, next",
    "postgresql://user:pw{n}@db.example:5432/main",
    "DATABASE_URL=postgres://u:p{n}@h/x",
    "-----BEGIN RSA PRIVATE KEY-----\nMII{n}\n-----END RSA PRIVATE KEY-----",
    "nothing secret {n}",
)


def _secret_parts():
    return [s.split("{n}") for s in SECRETS]


def redaction(spark, sf_dir):
    """Documents with a secret added by a rule on the id, after redaction."""
    n = F.col("doc_id").cast("string")
    lines = F.array(*[F.concat(*[p for i, part in enumerate(parts) for p in ([n] if i else []) + [F.lit(part)]]) for parts in _secret_parts()])
    secret = F.element_at(lines, (F.col("doc_id") % len(SECRETS) + 1).cast("int"))
    docs = A.source_documents(spark, sf_dir).withColumn("dirty", F.concat("content", F.lit("\n"), secret))
    return docs.select("doc_id", text.redact("dirty").alias("clean"), text.redaction_count("dirty").alias("hits"))


def _redact_sql(column: str) -> str:
    out = column
    for pattern, put in text.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return out


def _hits_sql(column: str) -> str:
    terms, out = [], column
    for pattern, put in text.REDACTIONS:
        terms.append(f"len(regexp_extract_all({out}, '{pattern}'))")
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return " + ".join(terms)


_LINES = ", ".join("'" + s.replace("{n}", "' || doc_id || '").replace("\n", "' || chr(10) || '") + "'" for s in SECRETS)
QUERIES["redaction"] = redaction
ORACLES["redaction"] = A.with_ctes(
    A.SQL_DOCUMENTS,
    f"""dirty AS (SELECT doc_id, content || chr(10) || ([{_LINES}])[CAST(doc_id % {len(SECRETS)} AS INTEGER) + 1] AS t FROM source_documents)
SELECT doc_id, {_redact_sql("t")} AS clean, CAST({_hits_sql("t")} AS INTEGER) AS hits FROM dirty""",
)


def question_routing(spark, sf_dir):
    return assistant.route_questions(A.questions(spark, sf_dir)).select("question_id", "route")


def _route_sql(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{'|'.join(p)}') THEN '{name}'" for name, p in text.ROUTES.items())
    return f"CASE {cases} ELSE '{text.DEFAULT_ROUTE}' END"


QUERIES["question_routing"] = question_routing
ORACLES["question_routing"] = A.with_ctes(
    A.sql_questions(), f"SELECT question_id, {_route_sql('question')} AS route FROM questions WHERE trim(question) <> ''"
)


def assistant_answers(spark, sf_dir):
    """Answers over the last hour of every tenant's log."""
    summary = traffic.dashboard_summary(scan.last_hours(A.request_logs(spark, sf_dir), 1))
    out = assistant.answer_questions(A.questions(spark, sf_dir), summary)
    joined = [F.array_join(c, "|").alias(c) for c in ("sources", "observed", "interpretation", "recommended_actions")]
    return out.select("question_id", "tenant_id", "route", "answer", *joined)


QUERIES["assistant_answers"] = assistant_answers
ORACLES["assistant_answers"] = A.with_ctes(
    A.sql_last_hours(1),
    SUMMARY_SQL,
    A.sql_questions(),
    f"""rows AS (SELECT q.*, {_route_sql('question')} AS route, s.tenant_id IS NOT NULL AS has, s.requests, s.blocked_requests, s.error_requests,
    s.server_error_requests, s.most_used_route FROM questions q LEFT JOIN summary s ON s.tenant_id = q.tenant_id WHERE trim(question) <> '')
SELECT question_id, tenant_id, route,
  CASE WHEN route = 'traffic' AND NOT has THEN 'Tenant request telemetry is currently unavailable, so I cannot summarize live traffic.'
    WHEN route = 'traffic' THEN 'The last-hour request logs contain ' || requests || ' requests, ' || blocked_requests || ' blocked requests, and ' || error_requests || ' HTTP 4xx/5xx responses. The most-used route in those logs is ' || most_used_route || '.'
    WHEN route = 'anomaly' THEN 'This assistant request does not run anomaly inference. Check the Recent anomalies panel for model-scored results and the model version.'
    WHEN route = 'incident' AND NOT has THEN 'Tenant request telemetry is unavailable; incident observations cannot be produced.'
    WHEN route = 'incident' THEN 'The last-hour request logs contain ' || blocked_requests || ' blocked requests and ' || server_error_requests || ' HTTP 5xx responses. The logs do not establish an incident cause.'
    WHEN route = 'forecast' THEN 'Forecasting is implemented and evaluated offline, but no live forecast model is activated for this tenant. No future request counts are available.'
    ELSE 'For rate-limit behavior, inspect the route policy and the response''s retry-after information. This rule-based assistant is not an external LLM and does not change gateway configuration.' END AS answer,
  CASE WHEN route IN ('traffic', 'incident') THEN CASE WHEN has THEN 'request_logs: tenant-scoped, last hour' ELSE '' END WHEN route = 'anomaly' THEN 'dashboard:recent-anomalies'
    WHEN route = 'forecast' THEN 'docs/ai-architecture.md' ELSE 'docs/rate-limits.md|docs/ai-security.md' END AS sources,
  CASE WHEN has THEN 'Requests in the last hour: ' || requests || '|Blocked requests: ' || blocked_requests || '|HTTP 4xx/5xx responses: ' || error_requests
    || '|HTTP 5xx responses: ' || server_error_requests ELSE 'Tenant request telemetry is unavailable.' END AS observed,
  CASE WHEN route = 'forecast' THEN 'Offline evaluation is not a live forecast.' ELSE '' END AS interpretation,
  CASE WHEN route = 'incident' AND has THEN concat_ws('|',
    CASE WHEN blocked_requests > 0 THEN 'Compare blocked requests with the configured tenant rate-limit policy.' END,
    CASE WHEN server_error_requests > 0 THEN 'Inspect upstream health and route-level logs for the observed HTTP 5xx responses.' END,
    CASE WHEN blocked_requests = 0 AND server_error_requests = 0 THEN 'No blocked requests or HTTP 5xx responses were observed in the queried window; continue monitoring.' END) ELSE '' END AS recommended_actions
FROM rows""",
)


def structured_responses(spark, sf_dir):
    """Event properties read as strict JSON, some of them damaged by a rule on the id."""
    e = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 11 == 0, F.concat(F.lit("broken "), "props"))
        .when(e % 13 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "more": 1}')))
        .when(e % 17 == 0, "{}")
        .otherwise(F.col("props"))
        .alias("text"),
    )
    good, bad = assistant.parse_responses(rows, T.StructType([T.StructField("k", T.LongType())]))
    return good.withColumn("problem", F.lit(None).cast("string")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), "problem")
    )


QUERIES["structured_responses"] = structured_responses
ORACLES["structured_responses"] = """SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0
    THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 11 = 0 THEN 'malformed JSON' WHEN event_id % 13 = 0 THEN 'extra field' WHEN event_id % 17 = 0 THEN 'missing field' END AS problem FROM events"""


def metadata_values(spark, sf_dir):
    """JSON text to a map; every seventh text is damaged and gives an empty map."""
    e = A.table(spark, sf_dir, "events")
    m = retrieval.metadata_map(F.when(F.col("event_id") % 7 == 0, "{oops").otherwise(F.col("props")))
    return e.select("event_id", m["k"].alias("k"), F.size(m).alias("entries"))


QUERIES["metadata_values"] = metadata_values
ORACLES["metadata_values"] = """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k,
  CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE len(json_keys(props)) END AS INTEGER) AS entries FROM events"""


def chunk_sections(spark, sf_dir):
    """Every text under a heading whose number follows from its id, after an opening line; sections fit one chunk."""
    docs = A.source_documents(spark, sf_dir)
    text = documents.clean_text("content")
    number = F.pmod("doc_id", F.lit(7)).cast("string")
    headed = F.concat(F.lit("Opening line\r\n  ### Section "), number, F.lit(" ##  \n"), text)
    cut = documents.chunk_documents(docs.withColumn("content", headed), ["doc_id"], max_chars=1_000_000, overlap=0)
    return cut.select("doc_id", "chunk_index", "section", F.sha2("content", 256).alias("content_hash"))


QUERIES["chunk_sections"] = chunk_sections
ORACLES["chunk_sections"] = A.with_ctes(
    A.SQL_DOCUMENTS,
    CLEAN_SQL,
    """SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, 'Document' AS section, sha256('Opening line') AS content_hash FROM cleaned
UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'Section ' || doc_id % 7, sha256(trim('### Section ' || doc_id % 7 || ' ##' || chr(10) || content, chr(10))) FROM cleaned""",
)
