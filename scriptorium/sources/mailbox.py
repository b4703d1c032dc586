"""A mailbox as a Spark source: a folder of messages, one JSON object a file, read in batch or polled as a stream.

A message is id, threadId, labelIds, snippet, internalDate (milliseconds as text) and
payload, as mail servers deliver it; the folder stands for the server, and another
`fetch` may take its place. A stream's offset is the newest time read, and each
poll takes at most `count` newer messages, oldest first, with all of the last one's time,
so none is skipped; a message that arrives with an older time than that is read in batch
only. `after` and `before` bound the times of a batch: before the oldest known, older mail
is pulled. Unreadable files are passed over; a missing time counts as 0 and is
read in batch only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, thread_id string, label_ids array<string>, snippet string, internal_date string, payload string"


def message_time(message: dict) -> int:
    try:
        return int(message.get("internalDate") or 0)
    except (TypeError, ValueError):
        return 0


def listed(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*.json"))


def fetch(paths: list[str]) -> Iterator[dict]:
    for path in paths:
        try:
            message = json.loads(Path(path).read_text(encoding="utf-8"))
        except ValueError:
            continue
        if isinstance(message, dict) and message.get("id"):
            yield message


def row(message: dict) -> tuple:
    payload = message.get("payload")
    date = message.get("internalDate")
    return (
        str(message["id"]), message.get("threadId"), message.get("labelIds"), message.get("snippet"),
        None if date is None else str(date), None if payload is None else json.dumps(payload, ensure_ascii=False),
    )


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """The folder is listed once, by the driver; each partition reads its own files."""

    def __init__(self, options: dict):
        self.folder, self.parts = options["path"], int(options.get("partitions", 4))
        self.after, self.before = int(options.get("after", -1)), int(options.get("before", 2**63 - 1))

    def partitions(self) -> list[_Part]:
        paths = listed(self.folder)
        return [_Part(paths[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for message in fetch(partition.paths):
            if self.after < message_time(message) < self.before:
                yield row(message)


class _Poll(SimpleDataSourceStreamReader):
    """Keeps the time of each file it has read, so that a poll parses only new files and those it returns."""

    def __init__(self, options: dict):
        self.folder, self.count = options["path"], int(options.get("count", 100))
        self.times: dict[str, int] = {}

    def _known(self) -> list[tuple[int, str]]:
        for path in listed(self.folder):
            if path not in self.times:
                self.times[path] = next((message_time(m) for m in fetch([path])), 0)
        return sorted((at, path) for path, at in self.times.items())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"newest": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        newer = [x for x in self._known() if x[0] > start["newest"]]
        if not newer:
            return iter([]), start
        newest = newer[min(self.count, len(newer)) - 1][0]
        return self.readBetweenOffsets(start, {"newest": newest}), {"newest": newest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        paths = [path for at, path in self._known() if start["newest"] < at <= end["newest"]]
        return iter([row(m) for m in fetch(paths)])


class MailboxSource(DataSource):
    """spark.dataSource.register(MailboxSource); spark.read.format("mailbox").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> _Poll:  # noqa: N802
        return _Poll(self.options)
