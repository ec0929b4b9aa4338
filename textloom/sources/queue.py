"""The queue as a streaming source whose offsets count messages, not files.

A queue is a folder of JSON lines, a message each; a file is complete when it appears, as Spark's writers
leave it. The planner numbers messages as it finds files: what it finds goes into an index beside
them (`_index/<number of the first message>.json`: names and counts), so a file that appears late
follows what has been numbered before, whatever its time. An offset is a number of messages: a batch
may end within a file and the next goes on there. Batches hold at most `max_messages` messages. Offsets also
have the time at which the reader began, so that a restarted query runs a batch even if nothing new has come:
the timers of what it holds run from then on.

    spark.dataSource.register(QueueSource)
    spark.readStream.format("textloom_queue").option("path", queue).load()

The folder is one that pyarrow's file systems reach (a path or a URI such as hdfs:// or s3://), from the
driver's planner and from the executors; one query reads it. With `clean` files go when the batch after
their last message has begun. A line that isn't a JSON object is a message without fields: the consumer
leaves it out, as any that isn't valid.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from textloom.schemas import MESSAGE

#: Messages of a batch.
MAX_MESSAGES = 5
INDEX = "_index"


class Folder:
    """The queue's files, by names within it."""

    def __init__(self, path: str) -> None:
        self.store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = root.rstrip("/")

    def names(self, sub: str = "") -> list[str]:
        """Of all files below, hidden ones apart; oldest first."""
        top = f"{self.root}/{sub}".rstrip("/")
        infos = self.store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        inside = [(i.mtime_ns or 0, i.path[len(top) :].strip("/")) for i in infos if i.type == fs.FileType.File]
        return [n for _, n in sorted(inside) if not any(part.startswith(("_", ".")) for part in n.split("/"))]

    def lines(self, name: str) -> list[str]:
        with self.store.open_input_stream(f"{self.root}/{name}") as f:
            return [x for x in f.read().decode("utf-8", "replace").split("\n") if x.strip()]

    def write(self, name: str, text: str) -> None:
        """All at once: under a hidden name first."""
        at, last = f"{self.root}/{name}".rsplit("/", 1)
        self.store.create_dir(at)
        with self.store.open_output_stream(f"{at}/.{last}") as f:
            f.write(text.encode())
        self.store.move(f"{at}/.{last}", f"{at}/{last}")

    def delete(self, name: str) -> None:
        if self.store.get_file_info(f"{self.root}/{name}").type == fs.FileType.File:
            self.store.delete_file(f"{self.root}/{name}")


class Part(InputPartition):
    """The messages from `start` up to `end` of a file."""

    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


class QueueReader(DataSourceStreamReader):
    """Offsets: {messages, began}, how many have been read, and by a reader of which time."""

    def __init__(self, path: str, schema: StructType, max_messages: int, clean: bool) -> None:
        self.path, self.schema, self.max_messages, self.clean = path, schema, max_messages, clean
        self.at: int | None = None
        self.began = time.time_ns()
        #: (number of its first message, name, count) of each file found
        self.found: list[tuple[int, str, int]] | None = None

    def _index(self) -> list[tuple[int, str, int]]:
        if self.found is None:
            folder, self.found = Folder(self.path), []
            for name in sorted(folder.names(INDEX)):
                first = int(name.removesuffix(".json"))
                for file, count in json.loads("".join(folder.lines(f"{INDEX}/{name}"))):
                    self.found.append((first, file, count))
                    first += count
        return self.found

    def _find(self, until: int) -> int:
        """Numbers the messages of new files until there are so many, or no more; how many there are."""
        found, folder = self._index(), Folder(self.path)
        total = found[-1][0] + found[-1][2] if found else 0
        if total < until:
            known, new, first = {n for _, n, _ in found}, [], total
            for name in folder.names():
                if name not in known and total < until:
                    new.append((name, len(folder.lines(name))))
                    found.append((total, *new[-1]))
                    total += new[-1][1]
            if new:
                folder.write(f"{INDEX}/{first:020d}.json", json.dumps(new))
        return total

    def initialOffset(self) -> dict:
        found = self._index()
        return {"messages": found[0][0] if found else 0, "began": 0}

    def latestOffset(self) -> dict:
        # Spark asks once a batch. After a restart it plans the last batch it knows of before, which says where to go on
        if self.at is None:
            self.at = self.initialOffset()["messages"]
        self.at = max(self.at, min(self.at + self.max_messages, self._find(self.at + self.max_messages)))
        return {"messages": self.at, "began": self.began}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, z = start["messages"], end["messages"]
        self.at = max(z, self.at or 0)
        return [Part(name, max(0, a - first), min(count, z - first)) for first, name, count in self._index() if a < z and first < z and first + count > a]

    def commit(self, end: dict) -> None:
        if self.clean:
            folder, found = Folder(self.path), self._index()
            for _, name, _ in [f for f in found if f[0] + f[2] <= end["messages"]]:
                folder.delete(name)
            # an index file stays while it is the last or has messages that aren't read
            starts = sorted(int(n.removesuffix(".json")) for n in folder.names(INDEX))
            for first, following in zip(starts, starts[1:], strict=False):
                if following <= end["messages"]:
                    folder.delete(f"{INDEX}/{first:020d}.json")

    def read(self, partition: Part) -> Iterator[tuple]:
        for line in Folder(self.path).lines(partition.name)[partition.start : partition.end]:
            try:
                body = json.loads(line)
            except ValueError:
                body = None
            body = body if isinstance(body, dict) else {}
            yield tuple(_cast(body.get(f.name), f.dataType.typeName()) for f in self.schema.fields)


def _cast(value: object, kind: str) -> object:
    """A JSON value as Spark's own reader gives it for this type; null where it doesn't fit."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


class QueueSource(DataSource):
    """Options: path; max_messages (5); clean (false). Schema: MESSAGE."""

    @classmethod
    def name(cls) -> str:
        return "textloom_queue"

    def schema(self) -> StructType:
        return MESSAGE

    def streamReader(self, schema: StructType) -> QueueReader:
        clean = self.options.get("clean", "false").lower() == "true"
        return QueueReader(self.options["path"], schema, int(self.options.get("max_messages", MAX_MESSAGES)), clean)
