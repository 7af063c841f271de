"""A corpus pipeline over documents: each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read by the next.

1. language: documents without any letter, and those unlike every language learned from the labelled ones, go. The less text there is, the
   less alike it must be, by one formula for all lengths.
2. near_duplicates: of each group of near copies the document with the smallest id stays.
3. secrets: secrets are masked in the text; no document goes.
4. mixing: documents are repeated so that all sources get equal weight, and shuffled.
5. tokens: texts become SentencePiece ids.

Cases: null and empty texts have no letter and go first; a null lang teaches nothing; without any labelled text no language is known and no document
stays; a null source is a source of its own; documents with a null id are told apart by their rows and all stay; of rows that repeat an id one stays;
an empty table gives an empty result with the same columns. Other columns are carried through the first four stages, whatever their
names, and left out by the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.llm import language_id, mixing, ngram_join, piece_codec, secret_scan
from catchmark.llm.queries import PIECES, RANKS, vocabulary
from catchmark.llm.shipping import ship
from catchmark.operators.lineage import shared_folder

#: A text of n characters whose cosine with every language is lower than LEAST_SCORE - SLACK / sqrt(n) is in none of them: what a
#: short text says about its letters varies as one over the root of its length.
LEAST_SCORE, SLACK = 0.10, 0.25
#: Rows of an Arrow batch and bytes of a Parquet row group: a worker and a writer hold one each, of whole texts.
BATCH_ROWS, GROUP_BYTES = 250, 8 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    profiles = language_id.learn(docs.filter(~language_id.held_out("doc_id")))
    said = language_id.predict(docs.select(F.struct(*docs.columns).alias("_row"), "text"), profiles)
    foreign = said.score < LEAST_SCORE - SLACK / F.sqrt(F.length("text"))
    return said.filter((said.lang_pred != language_id.UNDETERMINED) & ~foreign).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.redact(docs, vocabulary(RANKS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.replicate(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source")).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    encoded = piece_codec.encode(docs.select(*COLUMNS), vocabulary(PIECES), to="_said")
    return encoded.select(*COLUMNS, encoded["_said.ids"].alias("ids"), encoded["_said.parity"].alias("parity"), encoded["_said.round_trip"].alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixed), ("tokens", tokens)]
#: Vocabulary, profiles and components are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each from what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            path = f"{folder}/{name}"
            stage(spark, docs, sf_dir).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return docs
