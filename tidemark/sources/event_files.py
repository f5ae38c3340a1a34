"""Event files under the names they were given, one file per row.

Tasks write into a folder of their own attempt below a staging folder, so a failed or
repeated task leaves nothing behind that counts. Once all have ended, the files of the
attempts that count are moved to their names, each in one rename that replaces what bore
the name before; if a task fails, the staging folder goes and nothing has changed.

What such files cost is not their bytes but their number, so work is cut by it: files
are written, moved and read by as many tasks as a shuffle has. The driver learns one
folder per task and never a file's name: a folder is listed by one task, name by name,
and the names are dealt out from there. Spark's own file readers, and the partitions of
a data source, list a folder in the driver.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What runs in tasks travels with them, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names that a task lists before it goes on with them.
NAMES_AT_A_TIME = 1 << 14
# Characters that a task has read before it hands them on.
READ_AT_A_TIME = 1 << 22


def _open(path: str):
    """(file system, path on it); a path without a scheme is a local or mounted one."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _names(folder: str) -> Iterator[str]:
    """Names of the files in a folder; of a local or mounted one they are never held together."""
    import os

    from pyarrow import fs

    files, place = _open(folder)
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(place) as found:
            yield from (entry.name for entry in found if entry.is_file())
    else:
        yield from (info.base_name for info in files.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.File)


def _delete(folder: str) -> None:
    files, place = _open(folder)
    if files.get_file_info(place).type.name != "NotFound":
        files.delete_dir(place)


def _writer(staging: str) -> Callable[[Iterator], Iterator]:
    """Rows (file_name, fragment) to files; the task returns the folder of its attempt."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        folder = f"{staging}/{TaskContext.get().taskAttemptId()}"
        files, place = _open(folder)
        files.create_dir(place, recursive=True)
        for batch in batches:
            for name, fragment in zip(batch.column("file_name").to_pylist(), batch.column("fragment").to_pylist()):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"no file can be called {name!r}")
                with files.open_output_stream(f"{place}/{name}") as out:
                    out.write((fragment or "").encode("utf-8"))
        yield pa.RecordBatch.from_pydict({"folder": [folder]})

    return write


def _mover(directory: str) -> Callable[[str], None]:
    """Moves what a folder holds to `directory`; done again, it finds what is left."""

    def move(folder: str) -> None:
        files, place = _open(folder)
        _, target = _open(directory)
        # A listing is not gone on with after its folder has changed.
        while some := list(islice(_names(folder), NAMES_AT_A_TIME)):
            for name in some:
                try:
                    files.move(f"{place}/{name}", f"{target}/{name}")
                except FileNotFoundError:
                    # Another attempt of this task may have been faster.
                    if files.get_file_info(f"{target}/{name}").type.name == "NotFound":
                        raise

    return move


def _lister(directory: str) -> Callable[[Iterator], Iterator]:
    """Names of the `.xdl` files of a folder that are not hidden as Spark's readers take it."""

    def names(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _ in batches:
            shown = (
                name for name in _names(directory)
                if name.endswith(".xdl") and not name.startswith(".") and not (name.startswith("_") and "=" not in name)
            )
            while some := list(islice(shown, NAMES_AT_A_TIME)):
                yield pa.RecordBatch.from_pydict({"file_name": some})

    return names


def _reader(directory: str) -> Callable[[Iterator], Iterator]:
    """Names to (file_name, fragment) of the files that are not empty."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def filled(names: list[str], texts: list[str]):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file_name", "fragment"])

        files, place = _open(directory)
        for batch in batches:
            names, texts, size = [], [], 0
            for name in batch.column("file_name").to_pylist():
                with files.open_input_stream(f"{place}/{name}") as held:
                    text = held.read().decode("utf-8")
                if text:
                    names.append(name)
                    texts.append(text)
                    size += len(text)
                if size >= READ_AT_A_TIME:
                    yield filled(names, texts)
                    names, texts, size = [], [], 0
            yield filled(names, texts)

    return read


def _tasks(spark: SparkSession) -> int:
    """A given number of partitions, which adaptive execution does not join by their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def export_events(named: DataFrame, directory: str) -> None:
    """One file per event in `directory`, called `file_name`, replacing what bore that name.

    Of events that share a name the latest is kept, as a later write would replace an
    earlier one. An event without a name fails the export, which then changes nothing.
    """
    spark = named.sparkSession
    name = F.coalesce("file_name", F.raise_error("an event has no file name"))
    latest = named.withColumn("file_name", name).groupBy("file_name").agg(
        F.max_by("fragment", F.struct("event_time", "event_id")).alias("fragment")
    )
    # By a hash of the name: rows already lie by name, so a repartition by it would be left out.
    spread = latest.select("file_name", "fragment").repartition(_tasks(spark), F.xxhash64("file_name"))
    directory = directory.rstrip("/")
    staging = f"{directory}/.staged-{uuid.uuid4().hex}"
    try:
        # One row per task, of the attempt that counts.
        folders = [row.folder for row in spread.mapInArrow(_writer(staging), "folder string").collect()]
        spark.sparkContext.parallelize(folders, len(folders)).foreach(_mover(directory))
    finally:
        _delete(staging)


def read_event_files(spark: SparkSession, directory: str) -> DataFrame:
    """(file_name, fragment) of the event files in a folder; empty files are left out."""
    directory = directory.rstrip("/")
    listed = spark.range(1, numPartitions=1).mapInArrow(_lister(directory), "file_name string")
    dealt = listed.repartition(_tasks(spark), "file_name")
    return dealt.mapInArrow(_reader(directory), "file_name string, fragment string")
