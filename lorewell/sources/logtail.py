"""A stream source that follows growing JSONL files by byte offset; a last line without its end waits for the next batch."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, path: str, block: int = 1 << 16) -> int:
        """The place after the last line's end, looked for from the end of the file."""
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at:
                at = max(0, at - block)
                f.seek(at)
                end = f.read(block).rfind(b"\n")
                if end >= 0:
                    return at + end + 1
        return 0

    def read(self, start: dict):
        end = {p: self._whole(p) for p in sorted(glob.glob(self.pattern))}
        # A file that has shrunk was rewritten and is read from its start; one that is gone keeps its place.
        begun = {p: n if n <= end.get(p, n) else 0 for p, n in start.items()}
        return self.readBetweenOffsets(begun, start | end), start | end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        for p, n in sorted(end.items()):
            a = start.get(p, 0) if start.get(p, 0) <= n else 0
            if a < n and os.path.exists(p):
                with open(p, "rb") as f:
                    f.seek(a)
                    data = f.read(n - a)
                for line in data.split(b"\n")[:-1]:
                    rows.append((p, a, line.decode("utf-8", "replace")))
                    a += len(line) + 1
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").option("path", "/logs/*.jsonl")``: path, byte_offset, line."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, byte_offset long, line string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonlTail)


