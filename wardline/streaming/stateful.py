"""Streaming forms of the change detector and the rate windows; the cache is in cache.py, a source in feed.py.

The first keeps a key's last status in state. The windows are event-time windows with a
watermark, which is how Spark says what the counters with a processing-time clock meant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_CHANGES = "key string, status string, previous string, at timestamp"


def _detect(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (last,) = state.get if state.exists else (None,)
    out = []
    rows = pd.concat(list(parts)).sort_values("at", kind="stable")
    for status, at in zip(rows["status"], rows["at"]):
        status = (status or "").strip()
        if last is not None and status != last:
            out.append((key[0], status, last, at))
        last = status
    state.update((last,))
    yield pd.DataFrame(out, columns=["key", "status", "previous", "at"])


def status_changes(stream: DataFrame) -> DataFrame:
    """key, status, at: rows whose trimmed status differs from the key's last; the first sighting is silent."""
    rows = stream.select(F.col("key").cast("string"), F.col("status").cast("string"), F.col("at").cast("timestamp"))
    return rows.groupBy("key").applyInPandasWithState(_detect, _CHANGES, "last string", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(stream: DataFrame, key: str, at: str, length: str, late: str = "10 minutes", least: int = 1) -> DataFrame:
    """Hits of each key in fixed windows, from least up."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).select(key, F.col("window.start").alias("began"), "n")


def sliding_counts(stream: DataFrame, key: str, at: str, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(at, late).groupBy(F.window(at, length, step), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.end").alias("ended"), "n")


def session_counts(stream: DataFrame, key: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counters that each hit re-arms."""
    counted = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("began"), "n")


def positions(messages: DataFrame, value: str = "value") -> DataFrame:
    """Ship positions from JSON messages, under any of the names that trackers use; without coordinates none."""
    roots = ("position", "geometry", "vessel", "data", "result")
    # a message is parsed once, its inner objects are looked up once, and names only in those that are there
    once = lambda df, c: df.select("raw", F.explode(F.array(c)).alias("v"))
    read = once(messages.select(F.col(value).cast("string").alias("raw")), F.try_parse_json("raw"))
    objects = once(read, F.struct(F.col("v").alias("message"), *[F.try_variant_get("v", f"$.{r}", "variant").alias(r) for r in roots]))
    probe = lambda names, kind: F.coalesce(*[F.try_variant_get(f"v.{r}", f"$.{n}", kind) for r in ("message", *roots) for n in names])
    found = F.struct(
        probe(("mmsi", "MMSI"), "string").alias("mmsi"),
        probe(("name", "shipname"), "string").alias("name"),
        probe(("lat", "latitude"), "double").alias("lat"),
        probe(("lon", "lng", "longitude"), "double").alias("lon"),
        probe(("speed", "sog"), "double").alias("speed"),
    )
    rows = once(objects, found).select("v.*", "raw")
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL")
