"""Files and folders that driver and executors share, over Spark's file systems."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, at = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: readers see the old one or the new one."""
    fs, at = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"cannot write {path}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is missing, a local session takes a temporary folder (driver and tasks are
    one process), any other one a folder in the warehouse, which all machines of a cluster reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlake-") if local else f"{warehouse}/_flowlake")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Manifest:
    """Numbered JSON documents in a folder, of which the last is current and the one before is kept for readers.

    There is one writer at a time. A document is written whole before its number is seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        return sorted(int(c[:-5]) for c in children(self.spark, self.path) if re.fullmatch(r"\d+\.json", c))

    def history(self) -> list[dict]:
        """The documents that are kept, the current one last."""
        return [json.loads(read_text(self.spark, f"{self.path}/{n:012}.json")) for n in self._numbers()[-2:]]

    def current(self) -> dict:
        return (self.history() or [{}])[-1]

    def commit(self, document: dict) -> None:
        numbers = self._numbers()
        write_text(self.spark, f"{self.path}/{(numbers or [0])[-1] + 1:012}.json", json.dumps(document))
        for n in numbers[:-1]:
            remove(self.spark, f"{self.path}/{n:012}.json")
