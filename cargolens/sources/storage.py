"""File-system steps around Spark jobs, through the Hadoop client Spark uses itself."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _handle(spark, path)
    return fs.exists(target)


def same_place(spark: SparkSession, left: str, right: str) -> bool:
    (fs_left, a), (fs_right, b) = _handle(spark, left), _handle(spark, right)
    return fs_left.makeQualified(a).equals(fs_right.makeQualified(b))


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _handle(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, old = _handle(spark, source)
    new = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"Não foi possível mover {source} para {target}")


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, target = _handle(spark, path)
    return fs.getContentSummary(target).getLength()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``, or in the warehouse where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/cargolens-{name}-{uuid.uuid4().hex}"


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    fs, target = _handle(spark, pattern)
    return sorted(status.getPath().toString() for status in (fs.globStatus(target) or []))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file where there is none; False, and nothing written, where there is one."""
    fs, target = _handle(spark, path)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of a small file."""
    fs, source = _handle(spark, path)
    stream = fs.open(source)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """The beginning of a file."""
    fs, source = _handle(spark, path)
    stream = fs.open(source)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def list_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of each file in a folder, folders below it aside."""
    fs, target = _handle(spark, path)
    return [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(target) if f.isFile()]
