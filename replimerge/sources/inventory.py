"""Listings and state tables as Parquet, partitioned by folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EMPTY


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, size, mtime_ns`` of the files beneath ``root``, on any file system that Spark reads.

    Spark's listing leaves out empty files and names that begin with ``.`` or ``_``, and tells no
    directories, links, exec bits and ctimes: it is for trees that have none. The full form is a
    manifest as Parquet (:func:`load_table`); do not diff an index of such files against this one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file:").strip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{base}\E/+", "")
    return files.select(path.alias("path"), F.lit("file").alias("kind"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def content_hash(content: Column, kind: Column) -> Column:
    """SHA-256 of a file's bytes or of a link's target; ``EMPTY`` for directories."""
    return F.when(kind == "dir", EMPTY).otherwise(F.sha2(content, 256))


def hash_content(files: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Adds ``hash`` to ``path, kind, content``; rows whose stat moved between the listings ``before`` and ``after`` are left out.

    The stats are compared first, so the content of files that moved is not hashed.
    """
    if before is not None and after is not None:
        stat = ["path", "size", "mtime_ns", "ctime_ns"]
        files = files.join(before.select(*stat).intersect(after.select(*stat)).select("path"), "path", "left_semi")
    return files.withColumn("hash", content_hash(F.col("content"), F.col("kind"))).drop("content")


def valid_entry() -> Column:
    """S3: the field rules of a record. Nulls in a rule's fields break it."""
    gone = F.col("deleted")
    plain = F.col("kind") == "file"
    hex_ = F.col("hash").rlike("^[0-9a-f]{64}$")
    bare = (F.col("size") == 0) & (F.col("hash") == EMPTY) & ~F.col("exec")
    ok = hex_ & F.col("kind").isin("file", "dir", "symlink") & (F.col("size") >= 0) & (F.col("seq") >= 0)
    ok = ok & (~gone | bare) & (plain | gone | (~F.col("exec") & (F.col("mtime_ns") == 0))) & ((F.col("kind") != "dir") | bare)
    return F.coalesce(ok, F.lit(False))


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: a state table by its schema; columns that the files lack are null, others are not read."""
    return spark.read.schema(schema).parquet(path)


def split_valid(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: sound records and corrupt ones; none is silently nulled or lost."""
    marked = entries.withColumn("__ok", valid_entry())
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")


def _record_key(batches: DataFrame) -> Column:
    """Digest of all of a batch's row, its entries included, nulls and separators told apart."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in batches.columns]), {"ignoreNullFields": "false"}), 256)


def history_rows(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each recorded batch (ids may repeat; ``record``, the digest of the whole row, only with the row) and its entries by ``position``."""
    rows = batches.withColumn("record", _record_key(batches))
    entries = rows.select("record", "folder", "source", "batch", F.posexplode("entries").alias("position", "e")).select("record", "folder", "source", "batch", "position", "e.*")
    return rows.drop("entries"), entries


def append_history(batches: DataFrame, directory: str) -> None:
    """Append both tables beneath ``directory``."""
    heads, entries = history_rows(batches)
    heads.write.mode("append").partitionBy("folder").parquet(f"{directory}/batches")
    entries.write.mode("append").partitionBy("folder").parquet(f"{directory}/batch_entries")


def last_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key by ``order``; of changes that tie, the one whose row has the greatest hash, so reruns agree."""
    rest = [c for c in changes.columns if c not in keys]
    at = F.struct(F.col(order), F.xxhash64(*[F.to_json(F.struct(*[F.col(c).alias(c) for c in rest]))]))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("z")).select(*keys, "z.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """``table`` after ``changes``: a change replaces the row of its key, or removes it if ``removed``."""
    rest = [c for c in table.columns if c not in keys]
    c = last_changes(changes, keys, order).select(*keys, "removed", F.struct(*rest).alias("__n"), F.lit(True).alias("__c"))
    j = table.select(*keys, F.struct(*rest).alias("__o")).join(c, keys, "full_outer")
    return j.where("not coalesce(removed, false)").select(*keys, F.when(F.col("__c"), F.col("__n")).otherwise(F.col("__o")).alias("__r")).select(*keys, "__r.*")


def write_changes(changes: DataFrame, directory: str, batch_id: int) -> None:
    """The changes of a micro-batch, for ``foreachBatch``: only they are written, by folder, whatever the table's size.

    A micro-batch that runs again replaces its own files.
    """
    changes.write.mode("overwrite").partitionBy("folder").parquet(f"{directory}/changes/batch_id={batch_id}")


def read_state(spark: SparkSession, directory: str, schema: T.StructType, keys: list[str], order: str = "at") -> DataFrame:
    """The table after all changes: of each key the last change (by micro-batch, then ``order``), without removed ones.

    ``schema`` is that of the changes. A folder's rows are pruned by its partition. :func:`compact` keeps the number of files small.
    """
    full = T.StructType([*[f for f in schema.fields if f.name not in ("batch_id", "folder")], T.StructField("batch_id", T.LongType()), T.StructField("folder", T.StringType())])
    every = spark.read.schema(full).parquet(f"{directory}/changes")
    last = last_changes(every.withColumn("nth", F.struct("batch_id", order)), keys, "nth")
    return last.where(~F.col("removed")).select(*[f.name for f in schema.fields if f.name not in ("removed", order)])


def compact(spark: SparkSession, directory: str, target: str, schema: T.StructType, keys: list[str], order: str = "at") -> None:
    """A new directory ``target`` of the same form with one change a key: all that ``directory`` has now, as micro-batch -1."""
    state = read_state(spark, directory, schema, keys, order)
    write_changes(state.withColumn("removed", F.lit(False)).withColumn(order, F.lit(0).cast(schema[order].dataType)), target, -1)


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, ``side`` a or b, repeats counted."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("a")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("b")))


def first_difference(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> str | None:
    """The name of the first part, in the order of ``a``, that differs between two states."""
    for name in a:
        if not table_diff(a[name], b[name]).isEmpty():
            return name
    return None


def snapshot_since(entries: DataFrame, after: int) -> DataFrame:
    """Records with a ``seq`` above ``after`` by folder and path; the range is pushed down to the Parquet reader."""
    return entries.where(F.col("seq") > after).orderBy("folder", "path")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
