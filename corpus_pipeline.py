"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet in the shared folder and read again.

Nulls, empty texts, repeated rows and empty tables get what the operators define: a null text counts as empty; rows that
repeat a doc_id with an equal text leave one at exact dedup; an empty table gives an empty result. Extra columns of
documents, whatever their names, pass through up to packing; n_chars follows the text where documents have it. Texts are
read whole at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm import exact_dedup, packing, secrets, simhash, toxicity
from driftmesh.llm.common import discard, fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score from the threshold on go; the machine learns from labels that are not held out."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    score = fresh("score", docs)
    scored = docs.withColumn(score, toxicity.scorer(model)(F.col("text")))
    return scored.filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then that of the least doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over shingles of five words, the least doc_id stays."""
    return simhash.drop_similar(docs, shingle=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars, if there is one, follows."""
    spans = fresh("spans", docs)
    found = secrets.with_spans(docs, secrets.calibrate(docs), "text", spans)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: A trained model and fingerprint components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), name)
        if k:  # the stage before is written and has been read for the last time
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
