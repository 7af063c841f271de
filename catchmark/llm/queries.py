"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.llm import fingerprints, html_extract, language_id, mixing, ngram_join, piece_codec, secret_scan, spelling, token_files, url_filter, vector_dedup, warc, whitening
from catchmark.llm.shipping import ship
from catchmark.operators.lineage import shared_folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RANKS, WORD_BPE, PIECES = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest_columns(secret_scan.with_spans(docs, vocabulary(RANKS)).drop("text"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), listed)


URL_SQL = """
WITH p AS (SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, url, max_by(struct_pack(rule := h || q, v := v), length(h || q)) AS b
    FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, url)
SELECT p.page_id, p.url, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id IS NOT DISTINCT FROM best.page_id AND p.url IS NOT DISTINCT FROM best.url"""


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), folder)
    return token_files.read(spark, folder)


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.summary(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out("doc_id"))
    profiles = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_copies")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("url")


QUERIES: dict[str, Query] = {
    "op1_secret_scans": Query(secrets),
    "op2_url_filters": Query(url_filters, URL_SQL),
    "op3_ngram_jaccard_join": Query(ngram_jaccard_join),
    "op4_token_id_output": Query(token_id_files),
    "op5_sentencepiece": Query(sentencepiece),
    "op6_language_id": Query(language),
    "op7_document_fingerprints": Query(document_fingerprints),
    "op8_source_mixing": Query(source_mix, mixing.mixed_sql()),
    "op9_html_extraction": Query(html_text),
    "op10_embedding_near_dedup": Query(embedding_dedup),
    "op11_embedding_whitening": Query(embedding_whitening),
    "op12_spelling_variants": Query(spelling_variants, spelling.variants_sql()),
    "op13_warc_revisits": Query(warc_revisits, warc.DIGEST_SQL),
}
