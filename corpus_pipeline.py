"""Corpus pipeline: stages that turn ``documents`` into token ids, one operator each.

Rows with a null id or text, repeated rows and empty tables go through as the operators' own
docstrings say. Columns beyond those of ``documents`` are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, mixing, near_copies, pieces, toxicity
from knotwork.llm.common import cut
from knotwork.llm.queries import MIX_WEIGHTS, PIECES, quality_weights, toxic_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the pattern grammar, learned from the labelled documents, scores 0.7 or more."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, toxic_labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text, that with the largest id."""
    return exact_dedup.exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles of similarity 0.8 or more link, that with the smallest id."""
    return near_copies.drop_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does, so also not at all; an id that repeats, as often as its most taken row."""
    taken = mixing.mix(docs, quality_weights(spark, sf_dir), MIX_WEIGHTS).groupBy(F.col("doc_id").alias("id")).agg(F.max("epochs").alias("epochs")).filter("epochs > 0")
    times = F.sequence(F.lit(1), F.col("epochs").cast("int"))
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("id"))).withColumn("epoch", F.explode(times)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and a digest of the text that decoding them gives."""
    model = pieces.load(PIECES)
    coded = pieces.decode(pieces.encode(docs, model), model)
    return coded.select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned scores, near copies and piece paths aren't SQL. The tests compare the near-copy stage with brute force over
#: all pairs and the exact stage with the set of texts; the others by the tests of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are materialised in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
