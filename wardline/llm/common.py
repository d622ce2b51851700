"""What the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words here.
SPACE = rb" \t\n\x0b\x0c\r".decode("unicode_escape").encode()
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which driver and executors share.

    A folder of our own is used only in a local session where spark.checkpoint.dir is unset, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="wardline-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """Tables of one run in the cluster's shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def empty(self, name: str) -> None:
        """Take away what name holds, once it has been read for the last time."""
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/{name}")


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that whole texts are not all held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def combine(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A hash of two 64-bit hashes, in their order; all bits of the result depend on both."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= b if isinstance(b, np.ndarray) else np.uint64(b)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hash_words(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text, 8 bytes at a time."""
    lanes = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))  # the 8 bytes from each place on
    out = combine(lengths.astype(np.uint64), 1)
    at, left, which = starts, lengths, None
    while len(at):
        lane = lanes[at]
        short = np.flatnonzero(left < 8)
        lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        if which is None:
            out = combine(out, lane)
            which = np.flatnonzero(left > 8)
            at, left = at[which] + 8, left[which] - 8
        else:
            out[which] = combine(out[which], lane)
            more = left > 8
            at, left, which = at[more] + 8, left[more] - 8, which[more]
    return out


def kept_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the rows let go, columns unchanged.

    decided: doc_id, text_hash (xxhash64 of the text), kept; a row for each row of docs. Of
    rows alike in doc_id and text one stays where one or more of them are kept. Only keys of which
    a row goes are joined with docs: sent to all tasks while they are few enough for
    Spark to do so, by a shuffle beyond that.
    """
    key, hashed, any_kept = fresh(docs, "id", "text_hash", "any_kept")
    by_key = decided.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).agg(F.max("kept").alias(any_kept), F.count("*").alias("n"))
    changed = settle(by_key.filter(~F.col(any_kept) | (F.col("n") > 1)).drop("n"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed))
    marked = docs.join(changed, same, "left")
    out = marked.filter(F.col(any_kept).isNull()).select(*docs.columns)
    if changed.filter(any_kept).isEmpty():
        return out
    alike = docs.join(changed.filter(any_kept), same).dropDuplicates([key, hashed])
    return out.union(alike.select(*docs.columns))
