"""Numbered snapshots of a table: small JSON files that appear whole or not at all."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published the same number."""


@dataclass
class Snapshots:
    """Snapshots below a folder of any Hadoop file system; the one of the highest number holds.

    A snapshot is written beside its place and renamed into it. Where a file system renames in steps (object
    stores), writers must take turns; readers are safe with any number of writers elsewhere.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        fs, folder, _ = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def read(self, number: int) -> dict:
        fs, _, path = self._fs()
        stream = fs.open(path(f"{self.path}/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(0, {}) where nothing was published."""
        have = self.numbers()
        return (have[-1], self.read(have[-1])) if have else (0, {})

    def publish(self, number: int, content: dict) -> None:
        fs, folder, path = self._fs()
        fs.mkdirs(folder)
        beside, place = path(f"{self.path}/.{number:012d}.tmp"), path(f"{self.path}/{number:012d}.json")
        stream = fs.create(beside, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if fs.exists(place) or not fs.rename(beside, place):
            raise Conflict(f"snapshot {number} of {self.path} is there already")

    def forget_before(self, number: int) -> None:
        fs, _, path = self._fs()
        for n in self.numbers():
            if n < number:
                fs.delete(path(f"{self.path}/{n:012d}.json"), False)

    def folders(self, parent: str) -> set[str]:
        fs, _, path = self._fs()
        return {f.getPath().getName() for f in fs.listStatus(path(parent)) if f.isDirectory()} if fs.exists(path(parent)) else set()

    def delete_folders(self, parent: str, keep: set[str]) -> None:
        """Deletes the folders in parent that are not to be kept."""
        fs, _, path = self._fs()
        if fs.exists(path(parent)):
            for f in fs.listStatus(path(parent)):
                if f.isDirectory() and f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)
