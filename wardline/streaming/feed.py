"""A stream source for feeds of JSON lines that can't be read twice, such as ship positions.

What a feed sends is written to a log of numbered segments in a shared folder before Spark
hears of it; offsets count the messages of the log. A batch that failed, or a query that
starts again from its checkpoint, reads the same messages from the log, and the feed goes on
from where it is. Executors read segments, only the driver is connected.

    spark.dataSource.register(FeedSource)
    spark.readStream.format("wardline_feed").options(host=..., port=..., log=..., max_messages=...).load()
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Digits in a segment's name, messages that one task reads, seconds that a look at the feed may take.
DIGITS, EACH, WAIT = 15, 10_000, 1.0


class Log:
    """Segments of lines, named by the number of their first message, in a folder of any file system."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def segments(self) -> list[tuple[int, int]]:
        """First message and messages of each segment, in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        names = [f.base_name.removesuffix(".jsonl").split("-") for f in found if f.base_name.endswith(".jsonl")]
        return sorted((int(first), int(n)) for first, n in names)

    def size(self) -> int:
        return max((first + n for first, n in self.segments()), default=0)

    def append(self, lines: list[str]) -> None:
        """Write a segment under a passing name and give it its own: it is there whole or not at all."""
        name = f"{self.path}/{self.size():0{DIGITS}d}-{len(lines)}.jsonl"
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{name}.part") as out:
            out.write(("".join(line + "\n" for line in lines)).encode())
        self.fs.move(f"{name}.part", name)

    def read(self, begin: int, end: int) -> Iterator[tuple[int, str]]:
        """The messages begin..end - 1 with their numbers."""
        for first, n in self.segments():
            if first < end and first + n > begin:
                with self.fs.open_input_stream(f"{self.path}/{first:0{DIGITS}d}-{n}.jsonl") as part:
                    for i, line in enumerate(part.read().decode().split("\n")[:n], first):
                        if begin <= i < end:
                            yield i, line


class Feed:
    """Lines from a socket, connected on the first look and again when the connection is lost."""

    def __init__(self, host: str, port: int):
        self.address, self.socket, self.rest = (host, port), None, b""

    def lines(self, most: int, wait: float) -> list[str]:
        """What the feed sends within the time, at most so many lines; a line that isn't whole yet waits."""
        until, out = time.time() + wait, []
        while len(out) < most and time.time() < until:
            try:
                if self.socket is None:
                    self.socket, self.rest = socket.create_connection(self.address, timeout=wait), b""
                self.socket.settimeout(max(0.01, until - time.time()))
                got = self.socket.recv(1 << 16)
            except TimeoutError:
                break
            except OSError:
                self.socket = None
                time.sleep(min(0.1, wait))
                continue
            if not got:
                self.socket = None
                break
            *whole, self.rest = (self.rest + got).split(b"\n")
            out += [x.decode("utf-8", "replace").strip() for x in whole]
        return [x for x in out if x]


class Part(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = options["log"]
        self.feed = Feed(options.get("host", "localhost"), int(options["port"])) if "port" in options else None
        self.most, self.wait = int(options.get("max_messages", 0)) or None, float(options.get("wait", WAIT))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        log = Log(self.log)
        n = log.size()
        if self.feed and (self.most is None or n < self.most):
            # lines that came with the last ones wanted are kept too: a feed doesn't send twice
            if lines := self.feed.lines(EACH, self.wait):
                log.append(lines)
                n += len(lines)
        return {"n": n if self.most is None else min(n, self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Part(at, min(at + EACH, end["n"])) for at in range(start["n"], end["n"], EACH)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from Log(self.log).read(partition.begin, partition.end)

    def commit(self, end: dict) -> None:
        """Segments stay: another query may read the same log from its beginning."""


class FeedSource(DataSource):
    """Options: log (a folder that driver and executors share), host and port of the feed (none: the log alone is read), max_messages (stop after so many), wait (seconds of a look)."""

    @classmethod
    def name(cls) -> str:
        return "wardline_feed"

    def schema(self) -> str:
        return "n long, value string"

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))
