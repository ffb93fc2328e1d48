"""The folder that all executors share, and what the library writes there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_inner: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else what ``SparkContext.setCheckpointDir`` set, else a fresh folder.

    The last only where driver and executors are one process: on a cluster a folder of one machine
    would lose its rows, so there the setting must be there.
    """
    if _inner:
        return _inner[-1]
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own[0]


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there, and a lost executor costs only the tasks it ran.

    ``codec``: how the files are compressed, if not as the session says; ``zstd`` halves digests in text, which ``snappy`` leaves as they are.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _place(spark: SparkSession, path: str) -> tuple:
    """A path of whatever file system, and that file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if it is not there."""
    place, fs = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: it is there whole or not at all, and an error if it is there already."""
    jvm = spark.sparkContext._jvm
    place, fs = _place(spark, path)
    own, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, place, options)
    except Exception:
        fs.delete(own, False)
        raise


#: Shuffle files go when the job that wrote them is through, and not when the driver's memory is next cleaned up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(*sessions: SparkSession) -> Iterator[None]:
    """Inside the ``with`` every query's shuffle files are removed at its end. For jobs in a row none of which runs the plan of an earlier one again."""
    was = [s.conf.get(_CLEANUP, None) for s in sessions]
    for s in sessions:
        s.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for s, value in zip(sessions, was, strict=True):
            if value is None:
                s.conf.unset(_CLEANUP)
            else:
                s.conf.set(_CLEANUP, value)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder for intermediate tables, removed at the end with all that was written inside the ``with``.

    Rows that are still needed then must have been written elsewhere.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _inner.append(path)
    try:
        yield path
    finally:
        _inner.remove(path)
        delete(spark, path)
