"""A cache of answers in state: entries are set and got by a stream of requests and expire by time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds that entries for points and addresses live, others by default, decimals of a point's key.
TTL_POINT, TTL_ADDRESS, TTL_OTHER, DIGITS = 2_592_000, 604_800, 3_600, 5
#: Groups of keys that share a row of state and a call of Python, of which each has its price; fixed for a checkpoint.
BUCKETS = 1 << 12
# Of a key's requests at one time, which come first. What is held already comes before all.
HELD, DROP, SET, GET = -1, 0, 1, 2
_ANSWERS = "key string, op string, us long, hit boolean, value string"
_ENTRIES = "entries string"  # JSON: key to value, time of expiry in seconds, watermark in ms after which it goes


def address_key(address: Column, version: str = "v1") -> Column:
    """Key of a normalised address. Another version makes all keys new, which drops what older ones hold."""
    return F.concat(F.lit(f"{version}:addr:"), F.sha2(F.trim(F.coalesce(address, F.lit(""))), 256))


def point_key(lat: Column, lon: Column, version: str = "v1") -> Column:
    return F.concat_ws(":", F.lit(version), F.lit("coord"), F.round(lat, DIGITS).cast("string"), F.round(lon, DIGITS).cast("string"))


def lifetime(key: Column, given: Column | None = None, fallback: int = TTL_OTHER) -> Column:
    """Seconds that an entry lives: as given, else by what its key is for; 0 for ever."""
    by_key = F.when(F.contains(key, F.lit(":coord:")), TTL_POINT).when(F.contains(key, F.lit(":addr:")), TTL_ADDRESS).otherwise(fallback)
    return by_key if given is None else F.coalesce(given, by_key)


def _take(rows: pd.DataFrame, held: dict) -> tuple[pd.DataFrame, dict]:
    """Answers to a batch's requests of some keys, and what is then held for each: value and expiry, or None."""
    codes, names = pd.factorize(rows["key"])
    before = [(i, *held[k][:2]) for i, k in enumerate(names) if k in held]
    m = len(before)
    both = lambda first, then, kind: np.concatenate([np.array(first, kind), np.asarray(then, kind)])
    code = both([b[0] for b in before], codes, "int64")
    us = both([np.iinfo("int64").min] * m, rows["us"], "int64")
    turn = both([HELD] * m, np.select([rows["op"] == "drop", rows["op"] == "set"], [DROP, SET], GET), "int64")
    order = np.lexsort((turn, us, code))
    value = both([b[1] for b in before], rows["value"], object)[order]
    op = both([None] * m, rows["op"], object)[order]
    expires = both([b[2] for b in before], np.where(rows["ttl_s"] != 0, rows["us"] / 1e6 + rows["ttl_s"], 0.0), "float64")[order]
    code, us, turn = code[order], us[order], turn[order]
    place, first = np.arange(len(code)), np.append(True, code[1:] != code[:-1])
    start = np.maximum.accumulate(np.where(first, place, 0))
    last = np.maximum.accumulate(np.where(turn < GET, place, -1))  # what was set, dropped or held last, also by the row itself
    over = (0 < expires[last]) & (expires[last] < us / 1e6) & (last < place)
    hit = (last >= start) & (turn[last] != DROP) & ~over
    value = np.where(hit, value[last], None)
    asked, end = turn == GET, np.append(first[1:], True)
    answers = pd.DataFrame({"key": np.asarray(names, object)[code[asked]], "op": op[asked], "us": us[asked], "hit": hit[asked], "value": value[asked]})
    return answers, {names[c]: (v, e) if h else None for c, v, e, h in zip(code[end], value[end], expires[last][end].tolist(), hit[end])}


def _serve(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {}
    watermark, taken = state.getCurrentWatermarkMs(), {}
    if not state.hasTimedOut:
        answers, taken = _take(pd.concat(list(parts)), held)
        if len(answers):
            yield answers
    rest = {k: e for k, e in held.items() if k not in taken}
    gone = [(k, "expire", round(expires * 1e6), False, value) for k, (value, expires, due) in rest.items() if due and due < watermark]
    if gone:
        yield pd.DataFrame(gone, columns=["key", "op", "us", "hit", "value"])
    kept = {k: e for k, e in rest.items() if not e[2] or e[2] >= watermark}
    # an entry that the watermark has passed already goes with the next one
    kept |= {k: (e[0], e[1], max(int(e[1] * 1000), watermark + 1) if e[1] else 0) for k, e in taken.items() if e}
    if kept:
        state.update((json.dumps(kept),))
        due = min((e[2] for e in kept.values() if e[2]), default=None)
        if due is not None:
            state.setTimeoutTimestamp(due)
    elif state.exists:
        state.remove()


def serve(requests: DataFrame, late: str = "1 minute", fallback: int = TTL_OTHER) -> DataFrame:
    """Answers to a stream of requests: key, op (set, get, drop), value, ttl_s, at.

    Each get has an answer: hit, and the value that was set last, if it has not been dropped or
    expired by the get's own time. Where a key's requests come together they are taken in
    the order of at, of equal times drops first, then sets. Once the watermark has passed the
    time of an entry it leaves the state, with an answer of op "expire". ttl_s is by default what the
    key is for; 0 keeps an entry until it is dropped. Requests without key or time are none.

    Keys share rows of state by hash, so that a call of Python serves many; a batch rewrites the rows of its keys' buckets.
    """
    at = F.col("at").cast("timestamp")
    rows = requests.filter("key IS NOT NULL AND at IS NOT NULL").select(
        F.col("key").cast("string"), F.col("op").cast("string"), F.col("value").cast("string"), lifetime(F.col("key"), F.col("ttl_s"), fallback).cast("double").alias("ttl_s"), at.alias("at"), F.unix_micros(at).alias("us")
    )
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    served = rows.withColumn("bucket", bucket).withWatermark("at", late).groupBy("bucket").applyInPandasWithState(_serve, _ANSWERS, _ENTRIES, "append", GroupStateTimeout.EventTimeTimeout)
    return served.select("key", "op", F.timestamp_micros("us").alias("at"), "hit", "value")
