"""Packet folders as a data source: ``spark.read.format("packets")`` and ``spark.readStream.format("packets")``.

Under ``path`` each case has a folder with a document and, if it has one, a side file.  A batch read deals the
folders to tasks, ``folders_a_task`` each; only their names are listed.  A stream reads each folder once, by the
time at which its document got its name; what is younger than ``settle_ms`` waits for the next batch, so that
writers whose clocks differ by less lose nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from packwright.operators.documents import PACKET_JSON, PACKET_TEXT
from packwright.sources.files import filesystem

SCHEMA = "case_id string, markdown string, packet_json string"


@dataclass
class Folders(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


class _Packets:
    def __init__(self, options: dict):
        self.root, self.size, self.settle = _uri(options["path"]).rstrip("/"), int(options.get("folders_a_task", 256)), int(options.get("settle_ms", 2000))

    def arrivals(self) -> list[tuple[int, str]]:
        """(nanoseconds, name) of each folder whose document is there."""
        from pyarrow import fs

        system, path = filesystem(self.root)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        return sorted((int(f.mtime_ns or 0), f.path.rsplit("/", 2)[1]) for f in found if f.type == fs.FileType.File and f.base_name == PACKET_TEXT)

    def dealt(self, names: list[str]) -> list[Folders]:
        names = sorted(names)
        return [Folders(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [Folders([])]

    def rows(self, partition: Folders) -> Iterator[tuple]:
        system, path = filesystem(self.root)

        def text(name: str) -> str | None:
            if system.get_file_info(name).type.name != "File":
                return None
            with system.open_input_file(name) as f:
                return f.read().decode(errors="replace")

        for name in partition.names:
            side = text(f"{path}/{name}/{PACKET_JSON}")
            yield name, text(f"{path}/{name}/{PACKET_TEXT}"), "{}" if side is None else side


class PacketReader(_Packets, DataSourceReader):
    def partitions(self) -> list[Folders]:
        return self.dealt([name for _, name in self.arrivals()])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)


class PacketStream(_Packets, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        old_enough = time.time_ns() - self.settle * 1_000_000
        return {"until": max((t for t, _ in self.arrivals() if t <= old_enough), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.dealt([name for t, name in self.arrivals() if start["until"] < t <= end["until"]])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PacketReader:
        return PacketReader(self.options)

    def streamReader(self, schema) -> PacketStream:  # noqa: N802
        return PacketStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketSource)
