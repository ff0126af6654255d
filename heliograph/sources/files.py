"""Small files and folders beside Spark's tables, through the file system that Spark itself uses."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    """One folder on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder, self._hadoop = folder.rstrip("/"), spark._jvm.org.apache.hadoop
        self._copy = spark._jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        """What lies in a sub-folder; nothing if there is none."""
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._copy(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file under another name first, so that nobody ever reads half of it."""
        draft = f"{name}.draft"
        stream = self._fs.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._path(name), False)
        if not self._fs.rename(self._path(draft), self._path(name)):
            raise OSError(f"cannot write {self.folder}/{name}")


class Commits:
    """Marks of finished micro-batches in `_commits` under a table's folder. What a mark doesn't name does
    not exist for readers, so a batch written by half is invisible."""

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = Files(spark, f"{folder}/_commits")

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.files.names() if n.lstrip("-").isdigit())

    def last(self, before: int | None = None) -> dict:
        """The mark of the last batch, or of the last one before a batch; empty if there is none."""
        found = [n for n in self.numbers() if before is None or n < before]
        return json.loads(self.files.read(str(found[-1]))) if found else {}

    def add(self, batch_id: int, mark: dict) -> None:
        """Commit a batch. Only the last marks stay: the one before is what a repeated batch starts from."""
        self.files.replace(str(batch_id), json.dumps(mark))
        for n in self.numbers()[: -self.KEPT]:
            self.files.delete(str(n))
