"""The registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import digest, html, language, licenses, packing, phrases, quality, secrets, simhash, suffixes, trie, urls, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.chained(_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents that are not held out, predicted for all."""
    docs = _table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    docs = docs.withColumn("held_out", F.coalesce(part == 1, F.lit(False)))
    learn = docs.where("not held_out").select("text", "lang", F.xxhash64("doc_id", "text").alias("row_hash"))
    return language.predicted(docs.select("doc_id", "held_out", "text"), language.fit(learn))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [urls.host_rule(*r) for r in HOST_RULES] + urls.common_rules()
    return urls.judged(_table(spark, sf_dir, "pages"), urls.rules(spark, listed))


def _either(rules: tuple[str, ...]) -> str:
    return "|".join(rule.replace(" ", "[^a-zA-Z0-9]") for rule in rules)


OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(rule, h, p, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) AS place
  FROM urls, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, parts.host, parts.path, rule,
       coalesce(action, CASE WHEN regexp_matches(parts.host, '(^|[^a-zA-Z0-9])({_either(urls.BLOCKED_HOSTS)})([^a-zA-Z0-9]|$)')
         OR regexp_matches(parts.path, '[^a-zA-Z0-9]({_either(urls.BLOCKED_PATHS)})([^a-zA-Z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path AND place = 1
"""


def op9_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.encoded(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a 400-byte string goes, the first one too; repeated passages from ``PASSAGE`` bytes on are told, and stay."""
    docs = _table(spark, sf_dir, "documents")
    found = suffixes.cut(docs, keep_first=False, passage=suffixes.PASSAGE, passage_anchor=suffixes.PASSAGE_ANCHOR)
    spans = F.size("spans").cast("long").alias("n_spans")
    told = F.aggregate("passages", F.lit(0).cast("long"), lambda size, span: size + span[1] - span[0])
    return found.select(
        "doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"), told.alias("n_passage_bytes"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, lists = trie.trie(_table(spark, sf_dir, "conversations"))
    found = nodes.join(trie.list_digests(lists), trie.NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


OP11_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
digits AS (SELECT c, seq, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT) AS bytes FROM own),
heads AS (
  SELECT c, seq, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))),
    4294967295) % 6 AS h
  FROM digits),
built AS (
  SELECT heads.c, list_concat(coalesce(base.seq[1:h], []), heads.seq[h + 1:]) AS seq
  FROM heads LEFT JOIN own base ON base.c = heads.c - heads.c % 100),
starts AS (SELECT c, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM starts GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.p, count(*) FILTER (kids.p IS NULL) AS n_leaves,
         sum((b.n_convs - 1) * CASE WHEN b.d = 0 THEN 0 ELSE length(b.p[b.d].text) END)::BIGINT AS saved_tokens
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.p[1:a.d] = a.p LEFT JOIN kids ON kids.p = b.p GROUP BY a.p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1] LEFT JOIN kids ON kids.p = n.p JOIN below ON below.p = n.p
"""


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(_table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op13_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
lengths AS (SELECT unnest(range(1, 6)) AS k),
starts AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, lengths WHERE len(ws) >= k),
counts AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM starts GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f FROM counts WHERE k > 1 AND f >= 100),
free AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f
                    AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM free) c
  JOIN counts l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(ws[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(ws[cut + 1:], ' ')
  JOIN sizes ON sizes.lang = c.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_quartile_digest": op3_quartile_digest,
    "op4_secret_scans": op4_secret_scans,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_wrapper_induction": op7_wrapper_induction,
    "op8_url_filters": op8_url_filters,
    "op9_word_table_bpe": op9_word_table_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_templates": op12_license_templates,
    "op13_toivonen_phrases": op13_toivonen_phrases,
}
#: SQL twins, where SQL can express the method.
ORACLES: dict[str, str] = {"op8_url_filters": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_toivonen_phrases": OP13_SQL}
