"""Append-only logs: folders of line files that writers go on appending to.

The source keeps a byte offset for each file, always at the end of a whole line: a last line without its newline waits until it is
ended. Large files are read in ranges, each by a task of its own; a line belongs to the range in which it begins. A stream goes on from
the offsets in its checkpoint, so each line is read once; a batch reads what whole lines there are.

Files that shrink were cut or replaced, which offsets can't follow: that is an error. Paths may be anything that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.plans import Catalog
from tessera.plans.bind import MESSAGES, messages
from tessera.plans.loop import folder

catalog = Catalog()

SCHEMA = "file string, offset long, line string"
#: Bytes that one task reads, and that are read at a time to find a newline.
RANGE, STEP = 32 << 20, 1 << 16


class Files:
    """The files of a folder, with the ends of their whole lines."""

    def __init__(self, path: str, suffix: str) -> None:
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.path, self.suffix = self.path.rstrip("/"), suffix

    def ends(self, done: dict[str, int]) -> dict[str, int]:
        """By file, the end of its last whole line; looks only at what follows `done`."""
        from pyarrow import fs

        found = dict(done)
        sizes = {f.path[len(self.path) + 1 :]: f.size for f in self.system.get_file_info(fs.FileSelector(self.path, recursive=True)) if f.is_file and f.path.endswith(self.suffix)}
        for name, at in done.items():
            if sizes.get(name, 0) < at:
                raise ValueError(f"{name} is shorter than what was read of it: {sizes.get(name, 0)} of {at} bytes")
        for name, size in sizes.items():
            at = done.get(name, 0)
            if size > at and (end := self._last_newline(name, at, size)) > at:
                found[name] = end
        return found

    def _last_newline(self, name: str, low: int, high: int) -> int:
        with self.system.open_input_file(f"{self.path}/{name}") as file:
            while high > low:
                start = max(low, high - STEP)
                file.seek(start)
                at = file.read(high - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                high = start
        return low

    def lines(self, name: str, low: int, high: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Lines that begin in [low, high), with the byte at which each begins; `end` is the end of a line, and so is low unless it is in the middle of a file's range."""
        with self.system.open_input_file(f"{self.path}/{name}") as file:
            if low > 0:
                file.seek(low - 1)
                at, rest = low - 1, b""
                skip = True  # up to and with the newline at or before the first own line
            else:
                at, rest, skip = 0, b"", False
            where = at
            while at < high or rest:
                data = file.read(min(1 << 20, end - where))
                where += len(data)
                *whole, rest = (rest + data).split(b"\n")
                for line in whole:
                    if skip:
                        skip = False
                    elif at < high:
                        yield at, line
                    at += len(line) + 1
                if not data or at >= high:
                    return


class LogRange(InputPartition):
    def __init__(self, name: str, low: int, high: int, end: int) -> None:
        self.name, self.low, self.high, self.end = name, low, high, end


def ranges(start: dict[str, int], end: dict[str, int], size: int) -> list[LogRange]:
    return [LogRange(name, low, min(low + size, end[name]), end[name]) for name in sorted(end) for low in range(start.get(name, 0), end[name], size)]


class _Reader:
    def __init__(self, options: dict) -> None:
        self.options, self.size = dict(options), int(options.get("range", RANGE))

    def files(self) -> Files:
        return Files(self.options["path"], self.options.get("suffix", ""))

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        names = ["file", "offset", "line"]
        for at, line in self.files().lines(partition.name, partition.low, partition.high, partition.end):
            rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(rows)), *map(pa.array, zip(*rows))], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(rows)), *map(pa.array, zip(*rows))], names)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[LogRange]:
        return ranges({}, self.files().ends({}), self.size) or [LogRange("", 0, 0, 0)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.name else iter(())


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are {file: bytes read}; Spark keeps them in the checkpoint."""

    seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        self.seen = self.files().ends(self.seen)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        begun, ended = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {**ended, **{k: v for k, v in self.seen.items() if v > ended.get(k, 0)}}
        return ranges(begun, ended, self.size)

    def commit(self, end: dict) -> None:
        pass


class AppendLog(DataSource):
    """spark.read / spark.readStream .format("append_log").option("suffix", ".jsonl").load(folder): file, offset, line."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read_log(spark: SparkSession, path: str, stream: bool = False, suffix: str = ".jsonl", **options: str) -> DataFrame:
    """file, offset, line of a folder of logs, as a table or as a stream."""
    spark.dataSource.register(AppendLog)
    return (spark.readStream if stream else spark.read).format("append_log").options(suffix=suffix, **options).load(path)


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """file, offset, the schema's fields and `quarantined`: the line itself where it is no object with fields of these types, else null. Blank lines are left out."""
    full = lines.filter(F.trim("line") != "")
    x = full.withColumn("x", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    names = [f.name for f in x.schema["x"].dataType.fields if f.name != "_corrupt"]
    bad = F.col("x").isNull() | F.col("x._corrupt").isNotNull() | ~F.trim("line").startswith("{")
    return x.select("file", "offset", *[F.when(~bad, F.col(f"x.{n}")).alias(n) for n in names], F.when(bad, F.col("line")).alias("quarantined"))


def write_log(m: DataFrame, corrupt: str) -> str:
    """Messages as JSON lines under spark.checkpoint.dir, each row for which `corrupt` holds without its last brace; returns the folder."""
    path = f"{folder(m.sparkSession)}/log-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("id", "type", "agent_id", "value"))
    m.select(F.when(F.expr(corrupt), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    return path


catalog.add("log_records", f"WITH {MESSAGES} SELECT CASE WHEN id % 97 <> 0 THEN id END AS id, CASE WHEN id % 97 <> 0 THEN type END AS type, CASE WHEN id % 97 <> 0 THEN agent_id END AS agent_id, id % 97 = 0 AS quarantined FROM messages")(
    lambda s, d: parsed(read_log(s, write_log(messages(s, d), "id % 97 = 0"), suffix=".txt"), "id long, type string, agent_id long, value double").select("id", "type", "agent_id", F.col("quarantined").isNotNull().alias("quarantined"))
)
