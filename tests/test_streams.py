"""The cache in state, the feed source, and the functions for SQL."""

import datetime
import json
import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from wardline.functions import ranges, sql, text
from wardline.streaming import cache, feed, stateful

REQUESTS = "key string, op string, value string, ttl_s int, at timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)


def serve(spark, tmp_path, parts, name):
    source = tmp_path / name
    for part in parts:
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = cache.serve(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return [(r.key, r.op, r.hit, r.value) for r in spark.table(name).orderBy("at", "key", "op").collect()]


def test_entries_expire_by_time(spark, tmp_path):
    parts = [
        [("k", "get", None, None, at(0)), ("k", "set", "1", 600, at(1)), ("k", "get", None, None, at(2)), ("never", "set", "x", 0, at(1))],
        [("k", "get", None, None, at(10)), ("other", "set", "y", 60, at(10))],
        [("k", "get", None, None, at(12)), ("k", "set", "2", 600, at(13)), ("k", "get", None, None, at(14)), ("k", "drop", None, None, at(15)), ("k", "get", None, None, at(16))],
        [("z", "set", "late", 60, at(500)), (None, "get", None, None, at(1))],
        [("never", "get", None, None, at(501)), ("other", "get", None, None, at(501)), ("z", "get", None, None, at(503))],
    ]
    got = serve(spark, tmp_path, parts, "served")
    assert [g for g in got if g[0] == "k"] == [("k", "get", False, None), ("k", "get", True, "1"), ("k", "get", True, "1"), ("k", "get", False, None), ("k", "get", True, "2"), ("k", "get", False, None)]
    assert ("other", "expire", False, "y") in got and ("other", "get", False, None) in got  # gone from state by the watermark
    assert ("never", "get", True, "x") in got and ("z", "get", False, None) in got


def test_keys_share_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKETS", 3)
    draw = random.Random(5)
    batch = lambda b: {(f"k{draw.randrange(30)}", draw.choice(["set", "get", "get", "drop"]), at(100 * b + draw.randrange(100))): (draw.choice([None, str(draw.random())]), draw.choice([0, 120, 900, None])) for _ in range(400)}
    parts, want, held = [batch(b) for b in range(3)], [], {}
    for part in parts:
        for (key, op, when), (value, ttl) in sorted(part.items(), key=lambda r: (r[0][2], ["drop", "set", "get"].index(r[0][1]))):
            if op == "get":
                given, until = held.get(key, (None, at(-1)))
                want.append((key, "get", until >= when, given if until >= when else None))
            elif op == "drop":
                held.pop(key, None)
            else:
                held[key] = (value, at(10_000) if ttl == 0 else when + datetime.timedelta(seconds=ttl or 3600))
    got = serve(spark, tmp_path, [[(key, op, *rest, when) for (key, op, when), rest in part.items()] for part in parts], "shared")
    assert [r for r in got if r[1] == "get" and r[0] == "k1"] == [w for w in want if w[0] == "k1"]
    assert sorted((r for r in got if r[1] == "get"), key=str) == sorted(want, key=str) and sum(r[2] for r in got) > 50


def test_a_row_of_state_for_each_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BUCKETS", 3)
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit("set").alias("op"), F.col("id").cast("string").alias("value"), F.lit(0).alias("ttl_s"), F.lit(at(1)).alias("at"))
    rows.union(rows.withColumns({"op": F.lit("get"), "at": F.lit(at(2))})).write.parquet(str(tmp_path / "rows"))
    query = cache.serve(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "rows"))).writeStream.format("memory").queryName("by_bucket").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress} == {3}
    got = spark.table("by_bucket").collect()
    assert len(got) == 200 and all(r.hit and r.value == r.key for r in got)


def test_keys_and_lifetimes(spark):
    df = spark.range(1).select(
        cache.address_key(F.lit(" a "), "v2").alias("a"), cache.point_key(F.lit(55.1234567), F.lit(37.0)).alias("p"),
        cache.lifetime(F.lit("v1:addr:x")).alias("la"), cache.lifetime(F.lit("v1:coord:x")).alias("lp"), cache.lifetime(F.lit("x"), F.lit(None).cast("int")).alias("lo"), cache.lifetime(F.lit("x"), F.lit(5)).alias("lg"),
    ).first()
    assert df.a.startswith("v2:addr:ca978112") and df.p == "v1:coord:55.12346:37.0" and (df.la, df.lp, df.lo, df.lg) == (604_800, 2_592_000, 3_600, 5)


class Server(threading.Thread):
    """Sends each line once, as far as it may, to whoever is connected, and never again."""

    def __init__(self, lines):
        super().__init__(daemon=True)
        self.lines, self.may, self.listening = lines, 0, socket.create_server(("127.0.0.1", 0))
        self.port = self.listening.getsockname()[1]

    def run(self):
        at = 0
        while True:
            peer, _ = self.listening.accept()
            peer.setblocking(False)
            gone = False
            while not gone:
                try:
                    gone = peer.recv(1) == b""
                except BlockingIOError:
                    if at < self.may:
                        peer.sendall((self.lines[at] + "\n").encode())
                        at += 1
                    time.sleep(0.01)
                except OSError:
                    gone = True


def run_feed(spark, tmp_path, options, fails=False, until=None):
    seen = str(tmp_path / "out")

    def keep(df, batch):
        if fails:
            raise RuntimeError("the sink is away")
        df.write.mode("overwrite").parquet(f"{seen}/batch={batch}")

    stream = spark.readStream.format("wardline_feed").options(**options).load()
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    end = time.time() + 60
    while time.time() < end and query.isActive:
        done = [str(p.parent) for p in (tmp_path / "out").glob("batch=*/_SUCCESS")]
        if until is not None and done and spark.read.schema("n long, value string").parquet(*done).count() >= until:
            break
        time.sleep(0.3)
    query.stop()
    return query.exception()


def test_a_feed_is_read_on_after_a_failure_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(feed.FeedSource)
    lines = [json.dumps({"mmsi": i, "lat": 1.0, "lon": 2.0}) for i in range(60)]
    server = Server(lines)
    server.start()
    options = {"port": str(server.port), "host": "127.0.0.1", "log": str(tmp_path / "log"), "max_messages": "50", "wait": "0.3"}
    server.may = 1
    run_feed(spark, tmp_path, options, fails=True)  # a message was taken from the feed and not kept
    assert feed.Log(options["log"]).size() == 1 and not (tmp_path / "out").exists()
    server.may = 20
    run_feed(spark, tmp_path, options, until=20)  # stopped on the way
    server.may = 60
    run_feed(spark, tmp_path, options, until=50)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.n, r.value) for r in got.collect()) == list(enumerate(lines))[:50]  # stopped after N
    assert stateful.positions(got).count() == 50


def test_sql_functions_give_what_columns_give(spark):
    sql.register(spark)
    cells = ["1-9 нечет", "2, 4, 6, 8", "5", "1-3, 7–9; 15 и 20", "нет", "", None, "3, 3, 5", "10-20 чётные 7"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    df.createOrReplaceTempView("cells")
    got = spark.sql("SELECT i, r.* FROM cells, LATERAL house_ranges(cell) r").collect()
    want = df.select("i", F.explode(ranges.house_ranges(F.col("cell"))).alias("r")).select("i", "r.*").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 8
    said = ["Улицы: Мира, дома 1-9 нечет; ул. Ленина 2-8. ", "Гагарина 5а, 7а. 77. Садовая", None, ""]
    df = spark.createDataFrame(list(enumerate(said)), "i int, said string")
    df.createOrReplaceTempView("statutes")
    got = spark.sql("SELECT i, r.* FROM statutes, LATERAL statute_rules(said) r").collect()
    want = df.select("i", F.posexplode(ranges.statute_rules(F.col("said"))).alias("pos", "r")).select("i", "pos", "r.street", "r.houses.*").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) == 4
    words = spark.createDataFrame([("Ёлкина",), (None,), ("Октябрьской",)], "w string")
    words.createOrReplaceTempView("words")
    got = spark.sql("SELECT ru_lower(w) AS low, ru_stem(w) AS stem FROM words").collect()
    assert got == words.select(text.ru_lower(F.col("w")).alias("low"), text.stem(F.col("w")).alias("stem")).collect()


@pytest.mark.parametrize("n", [0, 1])
def test_an_empty_log_has_no_messages(tmp_path, n):
    log = feed.Log(str(tmp_path / "none"))
    assert log.size() == 0 and list(log.read(0, 5)) == []
    if n:
        log.append(["a", "b"])
        log.append(["c"])
        assert list(log.read(1, 3)) == [(1, "b"), (2, "c")]


def test_messages_of_positions_are_parsed_once(spark):
    from wardline.streaming import stateful

    said = ['{"position": {"lat": 1, "lng": 2}, "data": {"lat": 5, "MMSI": "m"}}', '{"lat": null, "vessel": {"latitude": 3, "longitude": 4, "mmsi": 7}}', '{"lat": 1}', "ping", None]
    got = stateful.positions(spark.createDataFrame([(s,) for s in said], "value string"))
    assert sorted((r.lat, r.lon, r.mmsi) for r in got.collect()) == [(1.0, 2.0, "m"), (3.0, 4.0, "7")]
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 1
