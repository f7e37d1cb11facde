"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, SentencePiece ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything the one before kept; ``run`` writes
each stage's rows as Parquet below the shared scratch folder and reads them back.  All stages but the
last return the columns of ``documents``.

Each stage handles nulls, empty and very long texts, repeated rows, empty tables and further columns as
its operator's docstring says; further columns pass through.  SQL cannot express the learned stages, so
there is no oracle; tests compare near-duplicate groups with all pairs, and follow long ids, edge rows and
kept rows through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, pieces, secrets, simhash, toxicity
from offerlens.session import scratch_path

ORACLE_SQL = None


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed``; the count of characters follows where there is one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose score reaches one half go."""
    model = toxicity.train_on_labels(docs, _read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs).select(*docs.columns)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out of the text; texts that keep no words go, unless they had none before."""
    return _with_text(docs, decontaminate.remove_spans(docs, _read(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _with_text(docs, secrets.redact(docs, secrets.train(docs)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the check that decoding gives the text back."""
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model, decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("secret_scan", mask_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
