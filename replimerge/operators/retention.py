"""Trash, restore, history and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import is_live, is_tracked
from ..functions.paths import name_of, parent_of, tagged_name
from ..schema import TRASH_BYTES, TRASH_DAYS
from .ordered import row_number, running

_DAY_NS = 86_400_000_000_000


def trash_day(ns: Column) -> Column:
    """``YYYY-MM-DD`` in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / F.lit(1_000_000_000))), "yyyy-MM-dd")


def trash_places(moves: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Adds ``trashed_path``: day, then the path; the n-th taking of a name that day has ``~n`` before the extension.

    ``taken`` (``folder, day, path, n``): how often names went there before.
    """
    day = trash_day(F.col("trashed_at_ns"))
    w = Window.partitionBy("folder", "day", "path").orderBy("trashed_at_ns", "arrival")
    m = moves.withColumn("day", day).withColumn("__n", F.row_number().over(w) - 1)
    if taken is not None:
        m = m.join(taken.select("folder", "day", "path", F.col("n").alias("__t")), ["folder", "day", "path"], "left").withColumn("__n", F.col("__n") + F.coalesce("__t", F.lit(0))).drop("__t")
    name = name_of(F.col("path"))
    numbered = F.when(F.col("__n") == 0, name).otherwise(tagged_name(name, F.concat(F.lit("~"), F.col("__n")), F.col("kind") == "dir"))
    place = F.concat_ws("/", F.col("day"), parent_of(F.col("path")), numbered)
    return m.withColumn("trashed_path", place).drop("__n")


def prune_trash(trash: DataFrame, now_ns: Column, days: int = TRASH_DAYS, size: int = TRASH_BYTES) -> DataFrame:
    """Adds ``prune``: older than ``days``, or among the oldest that keep the folder's total above ``size``.

    Old rows are a prefix of the order, so one running sum does for both rules. A large folder is summed in ranges.
    """
    summed = running(trash, ["folder"], ["trashed_at_ns", "trashed_path"], F.col("size"), "__before", "__total")
    old = now_ns - F.col("trashed_at_ns") > days * _DAY_NS
    return summed.withColumn("prune", old | (F.col("__total") - F.col("__before") > size)).drop("__before", "__total")


def reconcile_trash(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """T4: ``folder, trashed_path, action, original_path``: drop rows without a file, add files without a row (original: the path less its day)."""
    a = rows.select("folder", "trashed_path", "original_path", F.lit(True).alias("__row"))
    b = listing.select("folder", "trashed_path", F.lit(True).alias("__file"))
    j = a.join(b, ["folder", "trashed_path"], "full_outer")
    action = F.when(F.col("__file").isNull(), "drop").when(F.col("__row").isNull(), "add").otherwise("keep")
    original = F.coalesce("original_path", F.regexp_replace("trashed_path", "^[^/]*/", ""))
    return j.select("folder", "trashed_path", action.alias("action"), original.alias("original_path"))


def restore_candidates(trash: DataFrame, day: str | None = None) -> DataFrame:
    """T5: the newest copy of each original path, or the newest of that day."""
    t = trash if day is None else trash.where(trash_day(F.col("trashed_at_ns")) == day)
    best = F.max(F.struct("trashed_at_ns", "trashed_path", "hash", "size")).alias("z")
    return t.groupBy("folder", "original_path").agg(best).select("folder", "original_path", "z.*")


def batch_history(batches: DataFrame) -> DataFrame:
    """Batches in recorded order, with ``nth`` within their folder. A large folder is numbered in ranges."""
    return row_number(batches, ["folder"], ["recorded_at", "batch"], "nth")


def path_history(batch_entries: DataFrame, path: str | None = None) -> DataFrame:
    """What happened to a path (or each path), across sources, with the hash before each step."""
    rows = batch_entries if path is None else batch_entries.where(F.col("path") == path)
    w = Window.partitionBy("folder", "path").orderBy("recorded_at", "source", "seq")
    return rows.withColumn("step_no", F.row_number().over(w)).withColumn("hash_before", F.lag("hash").over(w))


def folder_status(entries: DataFrame, pending: DataFrame, held: DataFrame, paused: DataFrame, deferred: DataFrame, skipped: DataFrame) -> DataFrame:
    """``folder, node, files, bytes, tombstones, pending, held, paused, deferred, deferred_reasons, skipped``.

    A row for every folder and node that any of the tables names: one without an entry has 0 files.
    ``deferred`` has ``folder, node, reason``; its reasons are listed as ``reason:n``, by name.
    """
    keys = ["folder", "node"]
    e = entries.groupBy(*keys).agg(
        F.count_if(is_tracked()).alias("files"), F.sum(F.when(is_live(), F.col("size")).otherwise(0)).alias("bytes"), F.count_if(~is_live()).alias("tombstones")
    )
    d = deferred.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
    named = F.transform(F.sort_array(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat_ws(":", x["reason"], x["n"]))
    parts = [
        pending.groupBy(*keys).agg(F.count(F.lit(1)).alias("pending")),
        held.groupBy(*keys).agg(F.count_distinct("batch").alias("held")),
        paused.select(*keys).distinct().withColumn("paused", F.lit(True)),
        d.agg(F.sum("n").alias("deferred"), F.array_join(named, ",").alias("deferred_reasons")),
        skipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped")),
    ]
    for p in parts:
        e = e.join(p, keys, "full_outer")
    return e.fillna(0, ["files", "bytes", "tombstones", "pending", "held", "deferred", "skipped"]).fillna(False, ["paused"]).fillna("", ["deferred_reasons"])


def change_rollup(history: DataFrame) -> DataFrame:
    """Adds, mods, dels and bytes by folder, source and day, with subtotals."""
    n = lambda s: F.count_if(F.col("step") == s)
    return history.rollup("folder", "source", "day").agg(n("add").alias("adds"), n("modify").alias("mods"), n("delete").alias("dels"), F.sum("size").alias("bytes"))
