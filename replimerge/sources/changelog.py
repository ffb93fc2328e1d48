"""A change log that is compacted while streams write and readers read it.

``changes/batch_id=N/folder=F`` has what micro-batch N changed, ``base/version=V/folder=F`` the folder's
rows as of some compaction, and ``manifest/V`` says of each compacted folder which base counts and up to
which micro-batch it goes. A manifest is written once and never changed; the highest is the pointer.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inventory import last_changes, write_changes
from .shared import delete, exists, names, publish, read_text


@dataclass(frozen=True)
class Manifest:
    """``folders``: of each compacted folder the version of its base and the last micro-batch in it."""

    version: int
    folders: dict[str, tuple[int, int]]


def append(changes: DataFrame, directory: str, batch_id: int) -> None:
    """The changes of a micro-batch, for ``foreachBatch``; one that runs again replaces its own files."""
    write_changes(changes, directory, batch_id)


def manifests(spark: SparkSession, directory: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{directory}/manifest") if n.isdigit())


def current(spark: SparkSession, directory: str) -> Manifest:
    """The manifest that counts now. What is read with it stays the same whatever is compacted meanwhile."""
    have = manifests(spark, directory)
    if not have:
        return Manifest(-1, {})
    told = json.loads(read_text(spark, f"{directory}/manifest/{have[-1]}"))
    return Manifest(have[-1], {f: (v, b) for f, v, b in told})


def _full(schema: T.StructType, part: str) -> T.StructType:
    rest = [f for f in schema.fields if f.name not in (part, "folder")]
    return T.StructType([*rest, T.StructField(part, T.LongType()), T.StructField("folder", T.StringType())])


def _batches(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """What whole micro-batches changed; one that is being written does not count yet. Micro-batches are written one after the other."""
    whole = [int(n.removeprefix("batch_id=")) for n in names(spark, f"{directory}/changes") if n.startswith("batch_id=") and exists(spark, f"{directory}/changes/{n}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], _full(schema, "batch_id"))
    return spark.read.schema(_full(schema, "batch_id")).parquet(f"{directory}/changes").where(F.col("batch_id") <= max(whole))


def _folders(spark: SparkSession, m: Manifest) -> DataFrame:
    return spark.createDataFrame([(f, v, b) for f, (v, b) in m.folders.items()], "__f string, __v long, __b long")


def read(spark: SparkSession, directory: str, schema: T.StructType, keys: list[str], order: str = "at", manifest: Manifest | None = None) -> DataFrame:
    """The table after all changes, as of ``manifest`` and what streams have appended since.

    Of each key the last change by micro-batch, then ``order``, then the hash of the row, so that ties
    have one winner; without removed ones. ``schema`` is that of the changes. A folder's rows are
    its base and the micro-batches beyond it, both found by partition.
    """
    m = manifest or current(spark, directory)
    told = F.broadcast(_folders(spark, m))
    late = _batches(spark, directory, schema).join(told, F.col("folder") == F.col("__f"), "left").where(F.col("__b").isNull() | (F.col("batch_id") > F.col("__b"))).drop("__f", "__v", "__b")
    rows = late.withColumn("nth", F.struct("batch_id", order)).drop("batch_id")
    if m.folders:
        versions = sorted({v for v, _ in m.folders.values()})
        base = spark.read.schema(_full(schema, "version")).option("basePath", f"{directory}/base").parquet(*[f"{directory}/base/version={v}" for v in versions])
        base = base.join(told, (F.col("folder") == F.col("__f")) & (F.col("version") == F.col("__v")), "left_semi")
        first = F.struct(F.lit(-(1 << 63)).cast("long").alias("batch_id"), F.col(order).alias(order))
        rows = rows.unionByName(base.withColumn("nth", first).drop("version"))
    last = last_changes(rows, keys, "nth")
    return last.where(~F.col("removed")).select(*[f.name for f in schema.fields if f.name not in ("removed", order)])


def compact(spark: SparkSession, directory: str, schema: T.StructType, keys: list[str], order: str = "at") -> Manifest:
    """Write a base of every folder that changed since its own, and point to it.

    Only these folders' rows are read and written. Streams may append meanwhile, as a base goes up to
    the last micro-batch that was there at its start; readers keep the manifest they have. Of two
    compactions at a time the second to finish fails, as a manifest is never replaced, and its
    files are of no account.
    """
    was = current(spark, directory)
    top = _batches(spark, directory, schema).groupBy("folder").agg(F.max("batch_id").alias("b")).collect()  # a row a folder
    changed = {r.folder: r.b for r in top if r.b > was.folders.get(r.folder, (-1, -(1 << 62)))[1]}
    if not changed:
        return was
    version = was.version + 1
    names_ = F.broadcast(spark.createDataFrame([(f,) for f in changed], "folder string"))
    rows = read(spark, directory, schema, keys, order, was).join(names_, "folder", "left_semi")
    # What streams append meanwhile counts again on top of the base: the last change of a key wins either way.
    rows.withColumn("removed", F.lit(False)).withColumn(order, F.lit(None).cast(schema[order].dataType)).write.mode("overwrite").partitionBy("folder").parquet(f"{directory}/base/version={version}")
    now = Manifest(version, was.folders | {f: (version, b) for f, b in changed.items()})
    publish(spark, f"{directory}/manifest/{version}", json.dumps([[f, v, b] for f, (v, b) in sorted(now.folders.items())]))
    return now


def vacuum(spark: SparkSession, directory: str, keep: int = 2) -> None:
    """Remove manifests but the last ``keep``, and bases that none of these names. Readers of an older one must be through."""
    have = manifests(spark, directory)
    kept = have[-keep:]
    used = {v for n in kept for _, v, _ in json.loads(read_text(spark, f"{directory}/manifest/{n}"))}
    for n in have[:-keep]:
        delete(spark, f"{directory}/manifest/{n}")
    for name in names(spark, f"{directory}/base"):
        v = name.removeprefix("version=")
        if v.isdigit() and int(v) not in used and int(v) <= kept[-1]:
            delete(spark, f"{directory}/base/{name}")
