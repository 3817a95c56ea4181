"""Small text files below a folder of any file system that Spark knows: a registry, a run's metrics, its log."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession


class Folder:
    """A folder by Hadoop's file systems, so that driver and executors, and later sessions, see the same files."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.root, self._spark = root.rstrip("/"), spark

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.active()

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def place(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def read(self, name: str) -> str | None:
        """A file's text, or nothing where there is no file."""
        files, path = self._at(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file in whole: a reader sees the old text or the new one, and never a part."""
        files, path = self._at(name)
        _, fresh = self._at(f"{name}.new")
        stream = files.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(path):
            files.delete(path, False)
        if not files.rename(fresh, path):
            raise OSError(f"cannot write {path}")

    def names(self, pattern: str) -> list[tuple[str, int]]:
        """Names (below the folder) that fit a glob pattern, in order, with their times in milliseconds."""
        files, path = self._at(pattern)
        found = files.globStatus(path) or []
        top = files.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(self.root)).toString()
        return sorted((x.getPath().toString().removeprefix(f"{top}/"), x.getModificationTime()) for x in found)


class FolderHandler(logging.Handler):
    """A run's log as one file of a folder; a run has some hundred lines, so each record writes it anew."""

    def __init__(self, folder: Folder, name: str):
        super().__init__()
        self.folder, self.name, self.lines = folder, name, [folder.read(name) or ""]

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record) + "\n")
        self.folder.write(self.name, "".join(self.lines))
