"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; of each group of near duplicates one stays; words inside passages that repeat across documents go;
sources are mixed to target weights, a row for each time the mix takes a document; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import best_fit_packing, jaccard_join, mixing, substring_dedup, toxicity
from graphloom.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones, doesn't reject. Null and empty texts stay,
    repeated rows too; null ids are never trained on. An empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.training_rows(docs, labels))
    scored = toxicity.score_documents(docs, model, keep=tuple(COLUMNS))
    return scored.filter("predicted = 0").select(COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles.

    Repeated rows are one group. Documents without words, null texts among them, are linked with nothing and all stay.
    """
    return jaccard_join.one_of_each_group(docs.select(COLUMNS), num=80, den=100, width=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that occur again; n_chars is that of the new text.

    A null text stays null, and one that isn't cut stays as it is; a document all of whose words go stays, empty.
    """
    cut = substring_dedup.without_repeats(docs.select(COLUMNS), size=50)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; documents without words are never taken."""
    mixed = mixing.mix(docs.select(COLUMNS), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.filter("taken > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and its place there. A null or empty text is its end token
    alone; repeated rows are packed each."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't train the model of the first stage or do the packing of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's result isn't written here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
