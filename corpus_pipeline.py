"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing and packing, stage by stage.

Each stage takes the documents that the one before it kept and looks at all of them. In
every stage null texts count as empty, a null doc_id, lang, source or n_chars is a value
like any other, further columns are kept as they are, whatever they are called, and an
empty table stays empty; what else is defined is said at the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import exact, mixing, packing, simhash, toxicity
from wardline.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on labels scores under 0.7; rows are judged each by its whole text.

    Without labels of both classes every text has the same score and all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are the same without white space, the row with the most characters, then the smallest doc_id.

    A null doc_id comes last; of rows alike in all of this, one stays.
    """
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8, the row with the smallest doc_id.

    Texts without words are one group. In groups without any doc_id, and of rows that
    share theirs, that with the least hash of its text stays; of rows alike in both, one.
    """
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weight takes them, 0 to 3 times; a null source is one of its own.

    Rows alike in doc_id and text are taken equally often; the choice is the same on every run.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their places in sequences of 2,048; each row is packed for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, SimHash trees and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if i:  # what the stage before wrote has been read
            spark.range(0).write.mode("overwrite").parquet(f"{folder}/{i - 1}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
