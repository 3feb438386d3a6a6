"""A corpus pipeline of five stages over `documents`. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between two
stages the rows are written as Parquet to the shared folder and read back, so a stage restarts from its predecessor's table.

Null, empty and repeated rows have the results that the operators' docstrings define; extra columns pass through all stages but
the last, which returns doc_id, lang, source, n_tokens and digests of the ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.llm import bpe, language, mixing, secrets, simhash
from pingmill.llm.common import discard, fresh, new_path, table

#: A text of which less than this share of its letter n-grams is in its best language is in none of the learned ones.
LEAST_LANGUAGE_SHARE = 0.1


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts in none of the languages learned from the labelled rows."""
    label, score = fresh(docs, "lang_pred", "score")
    out = language.identify(docs, language.learn(language.training_rows(docs)))
    return out.filter((F.col(label) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; keeps every document."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target has it, in training order."""
    return mixing.schedule(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), *bpe.vocabulary())


STAGES = [
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe_round_trip", tokenize),
]

#: The first, second and fifth stage learn, hash and tokenize beyond what SQL can say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return docs
