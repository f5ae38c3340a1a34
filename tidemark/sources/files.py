"""Paths on whatever Hadoop file system they name."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = file_system(spark, path)
    return bool(fs.exists(hadoop_path))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote, if it is there."""
    hadoop_path, fs = file_system(spark, path)
    fs.delete(hadoop_path, True)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it does not exist."""
    hadoop_path, fs = file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def named_below(spark: SparkSession, path: str, wanted: Callable[[str], bool]) -> list[str]:
    """Names of files and folders below `path` that are wanted, empty ones too, sorted.

    It does not look into a wanted folder, nor at hidden ones.
    """
    waiting, found = [path], []
    while waiting:
        hadoop_path, fs = file_system(spark, waiting.pop())
        for status in fs.listStatus(hadoop_path):
            name = status.getPath().getName()
            if wanted(name):
                found.append(name)
            elif status.isDirectory() and not name.startswith((".", "_")):
                waiting.append(status.getPath().toString())
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop_path, fs = file_system(spark, path)
    stream = fs.create(hadoop_path, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    hadoop_path, fs = file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder unless the target is there already; whether it was done.

    One rename of the file system decides, so of several writers one wins.
    """
    jvm = spark._jvm
    old, fs = file_system(spark, source)
    new, _ = file_system(spark, target)
    fs.mkdirs(new.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(old), fs.makeQualified(new), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            return False
        raise
    return True
