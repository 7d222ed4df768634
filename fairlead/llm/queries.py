"""The registered queries of the operators: the given tables mapped to the library's records, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm import archive, exact_dedup, line_dedup, manifest_tree, ngram_join, packing, pseudo_likelihood, quality
from fairlead.llm import sentencepiece_codec, token_counts, token_files, url_rules, whitening
from fairlead.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def notices(documents: DataFrame) -> DataFrame:
    """Documents as facility readings: the text is the notice, the source its provider."""
    return documents.select(
        F.col("doc_id").alias("metric_id"), F.col("text").alias("construction_notice"), F.col("source").alias("provider_id"),
        F.col("lang").alias("display_name"),
    )


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark.read.parquet(f"{d}/documents.parquet"))


@_query
def op1_sentencepiece(spark, d):
    model = _tokenizer("piece_bpe_32k.model")
    decoded = sentencepiece_codec.decode_notices(sentencepiece_codec.encode_notices(_readings(spark, d), model), model)
    return decoded.select(
        F.col("metric_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


@_query
def op2_token_counts(spark, d):
    import public_tokenizers

    counted = token_counts.token_counts(
        _readings(spark, d), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        fields=("provider_id", "display_name", "construction_notice"),
    )
    return counted.withColumnRenamed("metric_id", "doc_id")


@_query
def op3_exact_dedup(spark, d):
    found = exact_dedup.exact_duplicates(_readings(spark, d))
    return found.select(
        F.col("metric_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


@_query
def op4_pseudo_likelihood(spark, d):
    return pseudo_likelihood.notice_scores(_readings(spark, d)).withColumnRenamed("metric_id", "doc_id")


@_query
def op5_token_files(spark, d):
    path = shared_dir(spark, "token-files")
    token_files.write_token_files(_readings(spark, d), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    read = token_files.read_token_files(spark, path)
    return read.select(F.col("metric_id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@_query
def op6_ngram_jaccard(spark, d):
    return ngram_join.similar_notices(_readings(spark, d)).withColumnRenamed("metric_id", "doc_id")


# The rules of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op7_url_rules(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("metric_id"), F.col("url").alias("record_ref"))
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as t(host, path, verdict)")
    return url_rules.reference_verdicts(pages, rules).withColumnRenamed("metric_id", "page_id")


@_query
def op8_line_dedup(spark, d):
    found = line_dedup.line_groups(_readings(spark, d))
    return found.select(F.col("metric_id").alias("doc_id"), "line_no", "group_id", "group_size", "kept")


@_query
def op9_compression_bands(spark, d):
    judged = quality.notice_quality(_readings(spark, d))
    return judged.withColumnRenamed("metric_id", "doc_id")


@_query
def op10_pack_sequences(spark, d):
    placed = packing.pack_pieces(packing.checked_pieces(_readings(spark, d), _tokenizer("word_bpe_49k.json")))
    return placed.select(
        F.col("metric_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@_query
def op11_warc_archive(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(
        F.col("page_id").alias("metric_id"), F.col("url").alias("record_ref"), F.col("html").alias("construction_notice")
    )
    path = shared_dir(spark, "archive")
    archive.write_archive(pages, path, media_type="text/html; charset=utf-8")
    return archive.read_archive(spark, path).select(
        F.col("metric_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_query
def op12_merkle_manifest(spark, d):
    documents = spark.read.parquet(f"{d}/documents.parquet")
    readings = documents.select(
        F.col("doc_id").alias("metric_id"), F.col("source").alias("provider_id"), F.col("lang").alias("display_name"),
        F.col("n_chars").alias("notice_chars"), F.col("text").alias("construction_notice"),
    )
    tampered = F.crc32(F.col("metric_id").cast("string").cast("binary")) % 7 == 0
    chars = F.col("notice_chars").cast("decimal(20,0)")
    found = manifest_tree.merkle_manifest(
        readings, part="display_name", fields=("metric_id", "provider_id", "display_name", "notice_chars", "construction_notice"),
        claimed={"notice_chars": F.when(tampered, chars + 1).otherwise(chars)},
    )
    return found.select(F.col("metric_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@_query
def op13_whitening(spark, d):
    return whitening.whitened_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""WITH d AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

_SIMILAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id, n.n"""

_RULED = rf"""WITH p AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, q, v) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT page_id, h || q AS rule, v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""


# The response of each payload of 1000 bytes or more is its largest page.
_ARCHIVED = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM keep THEN NULL ELSE keep END AS refers_to FROM g"""


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ["doc_id", "source", "lang", chars, "text"])) + ")"


# crc32 of the decimal doc_id, bit by bit; the divisor is the fixed polynomial of the checksum.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda ch: list_transform(range(8), lambda k: (ord(ch) >> k) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""

_TREE = f"""WITH RECURSIVE hashed AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
  {_leaf_sql(f"CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
node(lang, n, l, i, h) AS (SELECT lang, n, 0, r, leaf FROM leaves
  UNION ALL SELECT lang, n, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE ((n - 1) >> l) > 0 GROUP BY lang, n, l, i // 2),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM node WHERE ((n - 1) >> l) = 0),
top(n, l, i, h) AS (SELECT n, 0, r, h FROM sub
  UNION ALL SELECT n, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE ((n - 1) >> l) > 0 GROUP BY n, l, i // 2),
walk(doc_id, lang, leaf, n, i, l, proof, found) AS (SELECT doc_id, lang, leaf, n, r, 0, '', claimed FROM leaves
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.n, w.i // 2, w.l + 1, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN s.h IS NULL THEN found WHEN w.i % 2 = 1 THEN s.h || found ELSE found || s.h END)
  FROM walk w LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM w.lang AND s.l = w.l AND s.i = xor(w.i, 1) WHERE ((w.n - 1) >> w.l) > 0),
climb(doc_id, leaf, subroot, n, i, l, proof, found) AS (SELECT doc_id, leaf, sub.h, sub.n, sub.r, 0, proof, found
    FROM walk w JOIN sub ON sub.lang IS NOT DISTINCT FROM w.lang WHERE ((w.n - 1) >> w.l) = 0
  UNION ALL SELECT c.doc_id, c.leaf, c.subroot, c.n, c.i // 2, c.l + 1, c.proof || coalesce(s.h, ''),
    sha256(CASE WHEN s.h IS NULL THEN found WHEN c.i % 2 = 1 THEN s.h || found ELSE found || s.h END)
  FROM climb c LEFT JOIN top s ON s.l = c.l AND s.i = xor(c.i, 1) WHERE ((c.n - 1) >> c.l) > 0)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, found AS folded_root, found = t.h AS verified
FROM climb c, (SELECT h FROM top WHERE ((n - 1) >> l) = 0) t WHERE ((c.n - 1) >> c.l) = 0"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express on whole tables.

    The others need a tokenizer, a compressor, a trained model or SimHash and are tested
    against brute force.
    """
    return {
        "op3_exact_dedup": _EXACT, "op6_ngram_jaccard": _SIMILAR, "op7_url_rules": _RULED, "op11_warc_archive": _ARCHIVED,
        "op12_merkle_manifest": _TREE,
    }
