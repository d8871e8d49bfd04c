"""A corpus from raw documents to token ids in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from lexlake.llm.common import documents, labels, materialise


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, labels(spark, sf_dir), keep=toxicity.teaches())
    scored = toxicity.score(docs, model, names=("toxicity score", "toxicity verdict"))
    return scored.where("`toxicity verdict` = 0").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines one occurrence stays; documents of nothing else go."""
    return line_dedup.deduplicate_lines(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicate(docs, near_dedup.Settings(words=5, percent=80))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of at least 1: every document stays, and those of domains short of their target come more than once."""
    settings = mixing.Settings(least_rate=1.0)
    _, fit, model = mixing.mix(docs.select("doc_id", "text"), mixing.labelled_rows(docs, labels(spark, sf_dir)), settings)
    return mixing.repeated(docs, model, fit, settings)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids instead of the texts, and whether they decode to them."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(docs, path, decoded=True)
    return rows.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", toxic_documents_out),
    ("line dedup", repeated_lines_out),
    ("MinHash near-dedup", near_duplicates_out),
    ("mixing to target weights", mixed_to_targets),
    ("SentencePiece encoding", encoded),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
