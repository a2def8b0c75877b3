"""A training-data pipeline over the documents table: identified, deduplicated, decontaminated, redacted, tokenized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, minhash, secrets
from tessera.llm.common import materialize, read_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts that are null or without a letter go; a null language becomes the predicted one.

    Long texts are read whole, repeated rows are judged alike. No rows in: no rows out.
    """
    return langid.keep_identified(docs, langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup over shingles of five words: of each group of near copies one row stays, that with the least id.

    Null ids come last; of rows with the least id that with the least digest of its text stays, and of rows
    that agree in both, one. Texts without words all stay. No rows in: no rows out.
    """
    return minhash.deduplicated(docs, words=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike; null items are passed over. An
    empty benchmark takes nothing, no rows in: no rows out.
    """
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are masked, all documents stay, null and empty texts as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of each text, and the digest of what they decode to; null and empty texts have no ids."""
    return bpe.encode_decode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("minhash_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("secret_scan", redact),
    ("byte_bpe", tokenize),
]
#: SQL has neither the sketches nor the vocabulary; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
