"""What the operators on embeddings share: rows of integer components, in files of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are held to this size, or no long could hold what is summed of their products.
MOST = 1 << 27
ROWS = "rid long, vec_id long, label long, v binary"


def _integers(scale: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, vec_id, label, lists = b.columns
            flat = lists.flatten()  # without what lies under null lists
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            wrong = np.append(0, np.cumsum(~np.isfinite(values)))
            good = (wrong[ends] == wrong[ends - lengths]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -MOST, MOST).astype("<i4")
            kept = np.flatnonzero(good)
            bytes_of = [whole[ends[i] - lengths[i] : ends[i]].tobytes() for i in kept]
            at = pa.array(kept)
            yield pa.record_batch([rid.take(at), vec_id.take(at), label.take(at), pa.array(bytes_of, pa.binary())], names=["rid", "vec_id", "label", "v"])

    return run


def whole_rows(embeddings: DataFrame, scale: int) -> DataFrame:
    """rid (a number of one's own for each row), vec_id, label, v: floor(scale * x) of each component as 4 bytes.

    Rows whose vector is null or holds a null or non-finite component are left out. An
    empty vector is one of zeros. Components beyond MOST in size count as MOST.
    """
    rows = embeddings.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_integers(scale), ROWS)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row of int32 for each value; vectors shorter than width are filled up with zeros."""
    held = column.to_pylist()
    if all(len(x) == 4 * width for x in held):
        return np.frombuffer(b"".join(held), "<i4").reshape(len(held), width)
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in held), "<i4").reshape(len(held), width)
