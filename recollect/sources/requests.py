"""Chat requests as a Spark source, batch and streaming: ``spark.read.format("chat_requests")``.

A request log is a folder of files with one JSON object a line: ``{"path": .., "sent": .., "body": {"user": .., "messages":
[{"role": .., "content": ..}, ..]}}``. Requests to other paths, malformed lines and requests without messages are not read. A
row is one request: its user as the namespace (``default`` if it names none), when it was sent, and the messages.

Files are read by the tasks, one partition each; the driver lists names only. A stream's offset is the number of files
in the order of their names, so files have to be added under later names, as writers of logs do; a restart goes on from
the offset in its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ENDPOINT = "/v1/chat/completions"
REQUESTS = "namespace string, sent bigint, messages array<struct<role:string,content:string>>"


def names_in(path: str) -> list[str]:
    """The log files of a folder, by name; hidden ones and markers left out."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    files = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return sorted(f.path for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


def parsed(line: bytes, endpoint: str = ENDPOINT) -> tuple | None:
    """A row of a request's line, or None for what is no chat request."""
    try:
        request = json.loads(line)
        body = request["body"]
        if request["path"] != endpoint or not body["messages"]:
            return None
        return str(body.get("user") or "default"), int(request["sent"]), [(m.get("role"), m.get("content")) for m in body["messages"]]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


def read(partition: File | None) -> Iterator[tuple]:
    from pyarrow import fs

    if partition is None:  # a folder without files
        return
    system = fs.FileSystem.from_uri(partition.path)[0] if ":" in partition.path else fs.LocalFileSystem()
    with system.open_input_stream(partition.name) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from (row for row in map(parsed, lines) if row)
        if row := parsed(rest):
            yield row


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(self.path, name) for name in names_in(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        return read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(names_in(self.path))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(self.path, name) for name in names_in(self.path)[start["files"] : end["files"]]]

    def read(self, partition: File) -> Iterator[tuple]:
        return read(partition)


class ChatRequests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_requests"

    def schema(self) -> str:
        return REQUESTS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """spark, which knows the source from now on."""
    spark.dataSource.register(ChatRequests)
    return spark
