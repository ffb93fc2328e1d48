"""Paths: validity, ancestors, names of conflict copies, Unicode forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_NAME_BYTES, MAX_PATH_BYTES

#: First components that the library keeps for itself.
RESERVED = (".replimerge",)


def path_error(path: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    """Why a path is rejected, null if it is valid. Reasons are checked in this order."""
    parts = F.split(path, "/")
    checks = [
        ("empty", path == ""),
        ("nul", F.instr(path, "\0") > 0),
        ("absolute", F.startswith(path, F.lit("/"))),
        ("too long", F.octet_length(path) > MAX_PATH_BYTES),
        ("trailing slash", F.endswith(path, F.lit("/"))),
        ("empty component", F.instr(path, "//") > 0),
        ("dot", F.array_contains(parts, ".")),
        ("dot dot", F.array_contains(parts, "..")),
        ("long component", F.exists(parts, lambda p: F.octet_length(p) > MAX_NAME_BYTES)),
        ("reserved", F.get(parts, 0).isin(*reserved)),
    ]
    out = F.lit(None).cast("string")
    for reason, bad in reversed(checks):
        out = F.when(bad, reason).otherwise(out)
    return F.when(path.isNull(), "empty").otherwise(out)


def validate_paths(df: DataFrame, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """Adds ``valid`` and ``reason``."""
    return df.withColumn("reason", path_error(F.col("path"), reserved)).withColumn("valid", F.col("reason").isNull())


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def parent_of(path: Column) -> Column:
    """The directory above; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", ""))


def ancestors(path: Column) -> Column:
    """Array of the directories above, top first. Joins on them are equi-joins where ``LIKE 'dir/%'`` is a nested loop."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def subtree(df: DataFrame, directory: str) -> DataFrame:
    """Rows beneath ``directory``, as a range that the Parquet reader prunes by. ``0`` is the character after ``/``."""
    return df.where((F.col("path") > f"{directory}/") & (F.col("path") < f"{directory}0"))


def _ascii(name: Column) -> Column:
    return name.rlike(r"\A[\x00-\x7F]*\z")


@F.pandas_udf(T.StringType())
def _nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: s if s is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).lower()))


def _non_ascii(df: DataFrame, column: str, out: str, plain: Column, udf) -> DataFrame:
    """Only rows beyond ASCII reach Python: others are nulls in the batch."""
    hard = udf(F.when(~_ascii(F.col(column)), F.col(column)))
    return df.withColumn("__u", hard).withColumn(out, F.coalesce("__u", plain)).drop("__u")


def normalise_names(df: DataFrame, disk: str = "disk_path") -> DataFrame:
    """Adds ``path`` (NFC of the name on disk), ``differs`` and ``reason`` where the result is no valid path."""
    out = _non_ascii(df, disk, "path", F.col(disk), _nfc)
    return out.withColumn("differs", F.col("path") != F.col(disk)).withColumn("reason", path_error(F.col("path")))


def folded(df: DataFrame, column: str = "path", out: str = "folded") -> DataFrame:
    """M9: adds the case-folded NFC form."""
    return _non_ascii(df, column, out, F.lower(column), _fold)


def coinciding_names(df: DataFrame) -> DataFrame:
    """Adds ``coincides``: several names on disk in one folder have this index path. They are all to be skipped."""
    twice = df.groupBy("folder", "path").agg(F.count_distinct("disk_path").alias("__n")).where("__n > 1").select("folder", "path", F.lit(True).alias("__c"))
    return df.join(twice, ["folder", "path"], "left").withColumn("coincides", F.coalesce("__c", F.lit(False))).drop("__c")


def utc_stamp(ns: Column) -> Column:
    """``YYYYMMDD-HHMMSS`` in UTC; nanoseconds floor, before 1970 too."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / F.lit(1_000_000_000))), "yyyyMMdd-HHmmss")


def _cut(text: Column, room: Column) -> Column:
    """As many whole characters of ``text`` as have ``room`` bytes at most."""
    fits = F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda n: F.octet_length(F.substr(text, F.lit(1), n)) <= room)
    return F.substr(text, F.lit(1), F.coalesce(F.array_max(fits), F.lit(0)))


def _fit(stem: Column, tag: Column, ext: Column) -> Column:
    """Stem cut at a character boundary so that stem + tag + extension has 255 bytes at most; then the extension."""
    room = F.lit(MAX_NAME_BYTES) - F.octet_length(tag)
    end = _cut(ext, room)
    return F.concat(_cut(stem, room - F.octet_length(end)), tag, end)


def tagged_name(name: Column, tag: Column, whole: Column) -> Column:
    """``tag`` before the last extension (after the whole name if ``whole``, or for a dotfile), cut to 255 bytes.

    The two functions bind what they name several times, so that the plan has each argument once.
    """

    def parts(x: Column) -> Column:
        has_ext = ~x["whole"] & (F.instr(F.substr(x["name"], F.lit(2)), ".") > 0)
        stem = F.when(has_ext, F.regexp_replace(x["name"], r"\.[^.]*\z", "")).otherwise(x["name"])
        return F.struct(stem.alias("stem"), x["tag"].alias("tag"), F.when(has_ext, F.regexp_extract(x["name"], r"\.[^.]*\z", 0)).otherwise("").alias("ext"))

    def joined(p: Column) -> Column:
        plain = F.concat(p["stem"], p["tag"], p["ext"])
        return F.when(F.octet_length(plain) > MAX_NAME_BYTES, _fit(p["stem"], p["tag"], p["ext"])).otherwise(plain)

    named = F.transform(F.array(F.struct(name.alias("name"), tag.alias("tag"), whole.alias("whole"))), parts)
    return F.get(F.transform(named, joined), 0)


def conflict_copy_name(path: Column, kind: Column, mtime_ns: Column, host: Column, node: Column) -> Column:
    """M6: ``<stem>.conflict-<UTC time>-<host><ext>`` beside the path; without a host the first 8 of the node id."""
    who = F.when(F.coalesce(host, F.lit("")) == "", F.substring(node, 1, 8)).otherwise(host)
    tag = F.concat(F.lit(".conflict-"), utc_stamp(mtime_ns), F.lit("-"), who)
    named = tagged_name(name_of(path), tag, kind == "dir")
    return F.when(parent_of(path).isNotNull(), F.concat(parent_of(path), F.lit("/"), named)).otherwise(named)
