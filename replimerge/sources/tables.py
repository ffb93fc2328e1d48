"""S3: the state tables as data: their columns, what each column must be, and what must hold across columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entries import valid_host
from ..functions.paths import path_error
from ..schema import EMPTY
from .shared import fresh


@dataclass(frozen=True)
class Field:
    """A column: its Spark type, the name of what it must be (see :func:`_faults`), and whether it may be null."""

    name: str
    type: str
    rule: str
    optional: bool = False


@dataclass(frozen=True)
class Table:
    """Columns, the columns of which no two rows have the same values, and ``(reason, SQL that sound rows satisfy)``."""

    fields: tuple[Field, ...]
    key: tuple[str, ...]
    rules: tuple[tuple[str, str], ...] = ()


def _fields(*lines: str) -> tuple[Field, ...]:
    """From lines ``name type rule``; ``?`` after the rule marks a column that may be null."""
    out = []
    for line in lines:
        name, kind, rule = line.split(" ", 2)
        out.append(Field(name, kind, rule.rstrip("?"), rule.endswith("?")))
    return tuple(out)


_ENTRY = _fields(
    "path string path", "kind string file|dir|symlink", "size bigint count", "mtime_ns bigint time", "stamp bigint time", "exec boolean flag", "hash string hash", "prev_hash string hash",
    "version map<string,bigint> vector", "deleted boolean flag", "modified_by string id", "author_host string host",
)
_ENTRY_RULES = (
    ("a tombstone with content", f"not deleted or (size = 0 and hash = '{EMPTY}' and not exec)"),
    ("a directory with content", f"kind <> 'dir' or (size = 0 and hash = '{EMPTY}' and not exec)"),
    ("a link or directory with exec or mtime", "kind = 'file' or deleted or (not exec and mtime_ns = 0)"),
)
_WHOSE = _fields("folder string id", "node string id")

#: Every state table. Names, alternatives and rules.
TABLES: dict[str, Table] = {
    "entries": Table((*_WHOSE, *_ENTRY, *_fields("seq bigint count")), ("folder", "node", "path"), _ENTRY_RULES),
    "pending": Table((*_WHOSE, *_fields("path string path", "announced_seq bigint count?", "announced_hash string hash?", "exempt boolean flag")), ("folder", "node", "path"), (("a half announced record", "(announced_seq is null) = (announced_hash is null)"),)),
    "batches": Table(
        _fields("record string text", "batch string id", "folder string id", "source string id", "role string sent|received|paused", "created_at bigint time", "seq_low bigint count", "seq_high bigint count", "adds bigint count", "mods bigint count", "dels bigint count", "bytes bigint count", "decision string accepted|held?", "held_reason string text?", "recorded_at bigint time"),
        ("record",),
        (("an empty range", "seq_low <= seq_high"), ("a decision and reason that do not fit", "coalesce(decision = 'held', false) = (held_reason is not null)")),
    ),
    "batch_entries": Table((*_fields("record string text", "position bigint count"), *_ENTRY), ("record", "position"), _ENTRY_RULES),
    "held_items": Table((*_WHOSE, *_fields("batch string id", "source string id", "seq_high bigint count", "held_at_ns bigint time", "reason string text", "state string held|denied", "denied_at bigint count?")), ("folder", "node", "batch", "state", "denied_at"), (("a denial without its time, or a time without one", "(state = 'denied') = (denied_at is not null)"),)),
    "held_versions": Table((*_WHOSE, *_fields("batch string id", "path string path", "version map<string,bigint> vector", "stamp bigint time", "arrival bigint count")), ("folder", "node", "batch", "path", "arrival")),
    "deferred": Table((*_WHOSE, *_ENTRY, *_fields("batch string id", "source string id", "seq_high bigint count", "reason string frozen|changed underneath|no source|too large", "arrival bigint count")), ("folder", "node", "path", "source", "arrival"), _ENTRY_RULES),
    "wants": Table((*_WHOSE, *_ENTRY, *_fields("mode string fetch|direct|metadata only|index only|trash", "state string wanted|fetching|ready|committing|retry|deferred", "deadline_ns bigint time?", "fetched boolean flag", "local_retries bigint count")), ("folder", "node", "path"), _ENTRY_RULES),
    "want_sources": Table((*_WHOSE, *_fields("path string path", "source string id", "refused_until bigint time?", "excluded_until bigint time?", "strikes bigint count")), ("folder", "node", "path", "source")),
    "received_ranges": Table((*_WHOSE, *_fields("peer string id", "seq_low bigint count", "seq_high bigint count")), ("folder", "node", "peer", "seq_low", "seq_high"), (("an empty range", "seq_low < seq_high"),)),
    "acks": Table((*_WHOSE, *_fields("peer string id", "ack bigint count")), ("folder", "node", "peer"), (("an ack of its own", "peer <> node"),)),
    "folder_state": Table((*_WHOSE, *_fields("last_seq bigint count", "announced_seq bigint count", "announced_tracked bigint count", "paused boolean flag")), ("folder", "node"), (("announced beyond the last", "announced_seq <= last_seq"),)),
    "folders": Table(_fields("folder string id", "name string text", "created_by string id", "meta_version bigint count"), ("folder",)),
    "rules": Table(_fields("folder string id", "hold_count bigint count", "hold_pct bigint count", "hold_size bigint count", "direct_limit bigint count", "relay_limit bigint count", "slots_per_peer bigint count", "slots_per_folder bigint count"), ("folder",)),
    "members": Table((*_WHOSE, *_fields("path string text", "mode string two-way", "joined_at bigint time")), ("folder", "node")),
    "machines": Table(_fields("node string id", "hostname string host", "stable_id string text", "user string text"), ("node",)),
    "trash": Table(_fields("folder string id", "trashed_path string text", "original_path string path", "hash string hash", "trashed_at_ns bigint time", "size bigint count"), ("folder", "trashed_path")),
    "mtime_shim": Table(_fields("folder string id", "path string path", "requested_ns bigint time", "stored_ns bigint time"), ("folder", "path")),
    "disk_names": Table(_fields("folder string id", "path string path", "disk_name string text"), ("folder", "path"), (("a name that is the path's own", "disk_name <> substring_index(path, '/', -1)"),)),
}


def _faults(field: Field, hex_ids: bool) -> Column:
    """True where the column breaks its rule; null is for the caller to judge."""
    c = F.col(field.name)
    if field.rule == "path":
        return path_error(c).isNotNull()
    if field.rule == "hash":
        return ~c.rlike(r"\A[0-9a-f]{64}\z")
    if field.rule == "id":
        return ~c.rlike(r"\A[0-9a-f]{32}\z") if hex_ids else c == ""
    if field.rule == "host":
        return ~valid_host(c)
    if field.rule == "count":
        return c < 0
    if field.rule == "vector":  # canonical: no zero is stored
        return F.exists(F.map_entries(c), lambda e: e["value"].isNull() | (e["value"] <= 0) | (e["key"] == ""))
    if field.rule in ("time", "flag", "text"):
        return F.lit(False)
    return ~c.isin(*field.rule.split("|"))


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{f.name}` {f.type}" for f in TABLES[name].fields))


def row_fault(name: str, hex_ids: bool = False) -> Column:
    """Why a row of the table is corrupt, columns first, in their order: ``<column>: null``, ``<column>: <rule>`` or a reason; null if it is sound."""
    out = F.lit(None).cast("string")
    for reason, holds in reversed(TABLES[name].rules):
        out = F.when(~F.coalesce(F.expr(holds), F.lit(False)), reason).otherwise(out)
    for f in reversed(TABLES[name].fields):
        bad = F.when(F.coalesce(_faults(f, hex_ids), F.lit(False)), f"{f.name}: not {f.rule}").otherwise(out)
        out = F.when(F.col(f.name).isNull(), out if f.optional else F.lit(f"{f.name}: null")).otherwise(bad)
    return out


def split_rows(rows: DataFrame, name: str, hex_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sound rows of a table, and corrupt ones with their ``fault``; none is silently nulled or lost.

    Of sound rows that share a key all are ``a repeated key``, as none is known to be right: two rows
    are numbered in a window over the key, so a key of many rows is one task's to sort.
    """
    why = fresh(rows, "__fault")
    told = rows.withColumn(why, row_fault(name, hex_ids))
    twice = F.count(F.when(F.col(why).isNull(), 1)).over(Window.partitionBy(*TABLES[name].key)) > 1
    told = told.withColumn(why, F.when(F.col(why).isNull() & twice, "a repeated key").otherwise(F.col(why)))
    return told.where(F.col(why).isNull()).drop(why), told.where(F.col(why).isNotNull()).withColumnRenamed(why, "fault")


def load_state(spark: SparkSession, path: str, name: str, hex_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: a state table from Parquet by its schema, split by :func:`split_rows`. Columns that the files lack are null, others are not read."""
    return split_rows(spark.read.schema(table_schema(name)).parquet(path), name, hex_ids)
