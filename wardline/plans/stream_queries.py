"""The streaming operators over whole tables: read as a stream, run to the end, and what was written read again.

Times are a minute for each event's number, so that no two are equal.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.shared import shared_folder
from wardline.streaming import cache, stateful

from .registry import Tables, query


def _stream(t: Tables) -> DataFrame:
    # a pattern, as a stream's path is else taken for a folder
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    return events.withColumn("at", F.timestamp_seconds(F.col("event_id") * 60))


def _run(t: Tables, stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    written = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    written.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


# A window is complete once the latest event is ten minutes past its end.
PAST = "(SELECT max(event_id) * 60 - 600 FROM events)"


@query(f"SELECT user_id, event_id * 60 // 3600 * 3600 AS began, count(*) AS n FROM events WHERE (event_id * 60 // 3600 + 1) * 3600 <= {PAST} GROUP BY ALL HAVING count(*) >= 2")
def q_stream_tumbling(t: Tables) -> DataFrame:
    counted = _run(t, stateful.tumbling_counts(_stream(t), "user_id", "at", "1 hour", least=2))
    return counted.select("user_id", F.unix_seconds("began").alias("began"), "n")


@query(
    f"""SELECT user_id, (event_id * 60 // 1800 + 1 + i) * 1800 AS ended, count(*) AS n FROM events, range(2) r(i)
WHERE (event_id * 60 // 1800 + 1 + i) * 1800 <= {PAST} GROUP BY ALL"""
)
def q_stream_sliding(t: Tables) -> DataFrame:
    counted = _run(t, stateful.sliding_counts(_stream(t), "user_id", "at", "1 hour", "30 minutes"))
    return counted.select("user_id", F.unix_seconds("ended").alias("ended"), "n")


@query(
    f"""WITH g AS (SELECT user_id, event_id * 60 AS s, CASE WHEN event_id * 60 - lag(event_id * 60) OVER (PARTITION BY user_id ORDER BY event_id) <= 7200 THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS nth FROM g)
SELECT user_id, min(s) AS began, count(*) AS n FROM k GROUP BY user_id, nth HAVING max(s) + 7200 <= {PAST}"""
)
def q_stream_sessions(t: Tables) -> DataFrame:
    counted = _run(t, stateful.session_counts(_stream(t), "user_id", "at", "2 hours"))
    return counted.select("user_id", F.unix_seconds("began").alias("began"), "n")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS key, event_type AS status, event_id * 60 AS "at", lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events WHERE user_id IS NOT NULL)
SELECT key, status, previous, "at" FROM e WHERE previous <> status"""
)
def q_stream_changes(t: Tables) -> DataFrame:
    """Changes of status, with the last one of each key in state."""
    rows = _stream(t).filter("user_id IS NOT NULL").select(F.col("user_id").alias("key"), F.concat(F.lit(" "), "event_type").alias("status"), "at")
    return _run(t, stateful.status_changes(rows)).select("key", "status", "previous", F.unix_seconds("at").alias("at"))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS key, event_id, event_id % 5 AS kind FROM events WHERE user_id IS NOT NULL),
w AS (SELECT *, max(CASE WHEN kind IN (0, 1, 2) THEN event_id END) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
SELECT key, event_id AS asked, coalesce(last % 5 < 2 AND event_id - last <= 500, false) AS hit, CASE WHEN last % 5 < 2 AND event_id - last <= 500 THEN last::VARCHAR END AS value FROM w WHERE kind > 2"""
)
def q_stream_cache(t: Tables) -> DataFrame:
    """Entries set, dropped and got again, which live 500 minutes."""
    k = F.col("event_id") % 5
    op = F.when(k < 2, "set").when(k == 2, "drop").otherwise("get")
    rows = _stream(t).select(F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("event_id").cast("string").alias("value"), F.lit(30_000).alias("ttl_s"), "at")
    served = _run(t, cache.serve(rows)).filter("op = 'get'")
    return served.select("key", F.floor(F.unix_seconds("at") / 60).alias("asked"), "hit", "value")
