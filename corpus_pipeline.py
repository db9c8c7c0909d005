"""The training-data pipeline over documents; each stage takes (spark, docs, sf_dir) and returns a DataFrame.

quality rules -> MinHash near-dedup -> secret scans -> mixing sources -> BPE. All but the last return the columns of
documents. Columns beside them are not carried, whatever their names; nulls in any of them are kept as each operator
says, and empty input gives empty output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import bpe, line_quality, near_duplicates, secret_scan, source_mix
from trialspark.llm.common import scratch, table

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another column as text, and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their boilerplate lines; null texts fail them."""
    kept = line_quality.quality_rules(docs.select(*DOCUMENTS)).where("kept")
    return _with_text(kept, "clean_text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id."""
    return near_duplicates.keep_one(docs.select(*DOCUMENTS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by the name of its kind."""
    return _with_text(secret_scan.find_secrets(docs.select(*DOCUMENTS), redact=True), "redacted")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document of which it takes all its words twice comes twice."""
    return source_mix.mixed_documents(docs.select(*DOCUMENTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, decoded_sha256): the tokens of each document and a digest of what they decode to."""
    ids = bpe.bpe_columns(docs.select(*DOCUMENTS), public_tokenizers.path("byte_bpe_50k.json"), ("ids", "n_tokens", "decoded_sha256"))
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]
#: Near-duplicate sketches and BPE have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next.

    What a stage stores on its way goes when it is written, and its own table when all but the last stage are done.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as last:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as own:
                docs = own.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        last.paths |= own.paths
    return STAGES[-1][1](spark, docs, sf_dir)
