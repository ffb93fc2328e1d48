"""Table schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Content hash of a directory or tombstone.
EMPTY = "0" * 64
#: File < directory < symlink: alphabetical order would be wrong.
KIND_RANK = {"file": 0, "dir": 1, "symlink": 2}
TIER_RANK = {"lan": 0, "direct": 1, "relay": 2}

GIB, MIB = 1 << 30, 1 << 20
#: Limits and defaults.
BATCH_ENTRIES, BATCH_BYTES, ENTRY_OVERHEAD = 10_000, 4 * MIB, 256
QUIET_S, CAP_S = 2, 10
BRAKE_COUNT, BRAKE_PERCENT, BRAKE_BYTES = 50, 25, 20 * GIB
DIRECT_LIMIT, RELAY_LIMIT = GIB, 50 * MIB
SLOTS_PER_PEER, SLOTS_PER_FOLDER = 4, 16
BACKOFF_FIRST_S, BACKOFF_MAX_S, REFUSAL_S, STALL_S, COMMIT_S = 60, 3600, 3600, 60, 30
TRASH_DAYS, TRASH_BYTES = 30, 10 * GIB
SETTLE_NS = 2_000_000_000
LIVENESS_S = 45
MAX_PATH_BYTES, MAX_NAME_BYTES = 4096, 255

ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("stamp", T.LongType()),
        T.StructField("exec", T.BooleanType()),
        T.StructField("hash", T.StringType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("version", T.MapType(T.StringType(), T.LongType())),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("modified_by", T.StringType()),
        T.StructField("author_host", T.StringType()),
    ]
)
ENTRIES = T.StructType([T.StructField("folder", T.StringType()), T.StructField("node", T.StringType()), *ENTRY.fields, T.StructField("seq", T.LongType())])
OBSERVATIONS = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("bracket_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("exec", T.BooleanType()),
        T.StructField("hash", T.StringType()),
        T.StructField("at_ns", T.LongType()),
    ]
)
