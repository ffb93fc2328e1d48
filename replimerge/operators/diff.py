"""Change detection: one scan of a tree against the index of a machine.

Everything joins on ``(folder, node, path)``, never on ``folder`` alone, so a giant folder is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import is_live, is_tracked, next_stamp, normalise_observation, unchanged_by_stat
from ..functions.paths import ancestors
from ..functions.vectors import vv_increment
from ..schema import EMPTY
from .ordered import row_number

KEY = ["folder", "node", "path"]


def covered_by_skip(records: DataFrame, skips: DataFrame) -> DataFrame:
    """Adds ``covered``: the path or a directory above it was skipped in the same folder and node."""
    above = F.explode(F.concat(ancestors(F.col("path")), F.array("path")))
    places = records.select(*KEY).distinct().select(*KEY, above.alias("__at"))
    skip = skips.select("folder", "node", F.col("path").alias("__at")).distinct()
    hit = places.join(skip, ["folder", "node", "__at"], "left_semi").select(*KEY).distinct().withColumn("__c", F.lit(True))
    return records.join(hit, KEY, "left").withColumn("covered", F.coalesce("__c", F.lit(False))).drop("__c")


def implied_ancestors(observations: DataFrame, entries: DataFrame) -> DataFrame:
    """``folder, node, path`` of directories above present paths that no live directory record has, top first by path."""
    present = observations.where(F.col("state").isin("observed", "unchanged"))
    wanted = present.select("folder", "node", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    known = entries.where(is_live() & (F.col("kind") == "dir")).select(*KEY)
    return wanted.join(known, KEY, "left_anti")


def drop_stale(observations: DataFrame, reports: DataFrame) -> DataFrame:
    """C4: adds ``stale``: older than the path's last commit report, than a newer observation that
    arrived before it, or (``unchanged`` only) than the record's last write. Stale rows still count as seen."""
    last = reports.groupBy(*KEY).agg(F.max("reported_ns").alias("__r"), F.max("written_ns").alias("__w"))
    before = Window.partitionBy(*KEY).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = observations.withColumn("__m", F.max("at_ns").over(before)).join(last, KEY, "left")
    older = lambda c: F.coalesce(F.col("at_ns") < F.col(c), F.lit(False))
    return seen.withColumn("stale", older("__r") | older("__m") | ((F.col("state") == "unchanged") & older("__w"))).drop("__r", "__m", "__w")


def root_guard(observations: DataFrame, brackets: DataFrame) -> DataFrame:
    """Adds ``may_delete``: the marker was there before and after and the root was listed; without it nothing is taken as deleted."""
    sound = brackets.where("marker_start and marker_end and listed").select("folder", "node", "bracket_id").distinct()
    marked = sound.withColumn("__ok", F.lit(True))
    return observations.join(marked, ["folder", "node", "bracket_id"], "left").withColumn("may_delete", F.coalesce("__ok", F.lit(False))).drop("__ok")


def snapshot_diff(entries: DataFrame, observations: DataFrame, hosts: DataFrame | None = None, sound: DataFrame | None = None, now_ns: Column | None = None) -> DataFrame:
    """Every path of the index or the scan with its ``change`` and the entry that results.

    ``change``: add, modify, touch, chmod, delete, unchanged or skipped. Observations are one a path
    (``state``: observed, unchanged, skipped, absent) and taken by the field rules of their kind. A
    live record that the scan did not see becomes a tombstone unless a skip covers it, or ``sound``
    (folder, node) lacks its tree (see :func:`root_guard`); it is dated by the observation that found
    the path absent, else ``now_ns``, the end of the scan (by default the time of the query). Entries
    are columns; the new one has prefix ``new_``. Its ``prev_hash`` is ``announced_hash`` of the record
    if that column is there, else the record's hash.
    """
    now = F.unix_micros(F.current_timestamp()) * 1000 if now_ns is None else now_ns
    e = entries if "announced_hash" in entries.columns else entries.withColumn("announced_hash", F.col("hash"))
    skips = observations.where("state = 'skipped'")
    e = covered_by_skip(e, skips)
    fields = [c for c in e.columns if c not in KEY]
    old = e.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in fields], F.lit(True).alias("__has"))
    obs = normalise_observation(observations).select(*KEY, *[F.col(c).alias(f"obs_{c}") for c in ("state", "kind", "size", "mtime_ns", "exec", "hash", "at_ns")])
    j = obs.join(old, KEY, "full_outer")
    live = F.coalesce(~F.col("old_deleted"), F.lit(False))
    if sound is not None:
        j = j.join(sound.select("folder", "node").distinct().withColumn("__sound", F.lit(True)), ["folder", "node"], "left")
        guarded = F.coalesce("__sound", F.lit(False))
    else:
        guarded = F.lit(True)
    seen = F.col("obs_state") == "observed"
    gone = F.col("obs_state").isNull() | (F.col("obs_state") == "absent")
    other = (F.col("obs_kind") != F.col("old_kind")) | (F.col("obs_hash") != F.col("old_hash"))
    change = (
        F.when(gone & live & F.coalesce("old_covered", F.lit(False)), "skipped")
        .when(gone & live & guarded, "delete")
        .when(F.col("obs_state") == "skipped", "skipped")
        .when(gone | (F.col("obs_state") == "unchanged"), "unchanged")
        .when(seen & ~live, "add")
        .when(seen & unchanged_by_stat("obs_", "old_") & ~other, "unchanged")
        .when(seen & other, "modify")
        .when(seen & (F.col("obs_kind") == "file") & (F.col("obs_exec") != F.col("old_exec")), "chmod")
        .when(seen & (F.col("obs_kind") == "file") & (F.col("obs_mtime_ns") != F.col("old_mtime_ns")), "touch")
        .otherwise("unchanged")
    )
    j = j.withColumn("change", change).where(F.col("obs_state").isNotNull() | live)
    dele, written = F.col("change") == "delete", F.col("change").isin("add", "modify", "touch", "chmod", "delete")
    take = lambda c, gone_value: F.when(dele, gone_value).otherwise(F.col(f"obs_{c}"))
    before = F.coalesce("old_announced_hash", F.lit(EMPTY))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    new = {
        "new_kind": take("kind", F.col("old_kind")),
        "new_size": take("size", F.lit(0)).cast("long"),
        "new_mtime_ns": take("mtime_ns", F.coalesce(F.col("obs_at_ns"), now)).cast("long"),
        "new_exec": take("exec", F.lit(False)),
        "new_hash": take("hash", F.lit(EMPTY)),
        "new_deleted": dele,
        "new_prev_hash": before,
        "new_version": vv_increment(F.coalesce("old_version", nothing), F.col("node")),
        "new_stamp": next_stamp(F.col("old_stamp"), F.col("obs_kind"), F.col("obs_mtime_ns"), ~dele & (F.col("obs_hash") != before)).cast("long"),
        "new_modified_by": F.col("node"),
    }
    if hosts is not None:
        j = j.join(hosts.select("node", F.col("host").alias("__host")), "node", "left")
        new["new_author_host"] = F.col("__host")
    out = j.withColumns({k: F.when(written, v) for k, v in new.items()})
    return out.select(*KEY, "change", *new)


def apply_mtime_shim(observations: DataFrame, shim: DataFrame) -> DataFrame:
    """Report the requested mtime while the disk still has the one that was stored for it."""
    keys = [k for k in KEY if k in shim.columns]
    s = shim.select(*keys, "requested_ns", "stored_ns")
    fixed = F.when(F.col("mtime_ns") == F.col("stored_ns"), F.col("requested_ns")).otherwise(F.col("mtime_ns"))
    return observations.join(s, keys, "left").withColumn("mtime_ns", fixed).drop("requested_ns", "stored_ns")


def shim_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``folder, path, action``, and ``node`` where both tables have it: keep, move (other times), add or remove."""
    keys = [k for k in KEY if k in before.columns and k in after.columns]
    a = before.select(*keys, F.struct("requested_ns", "stored_ns").alias("a"))
    b = after.select(*keys, F.struct("requested_ns", "stored_ns").alias("b"))
    action = F.when(F.col("b").isNull(), "remove").when(F.col("a").isNull(), "add").when(F.col("a") == F.col("b"), "keep").otherwise("move")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def scan_report(observations: DataFrame) -> DataFrame:
    """``folder, state, skip_reason, n``."""
    return observations.groupBy("folder", "state", "skip_reason").agg(F.count(F.lit(1)).alias("n"))


def fill_by_hash(wanted: DataFrame, entries: DataFrame, trash: DataFrame) -> DataFrame:
    """Adds ``fill_from`` and ``fill_path`` where wanted content is at hand: the same path, else
    the first live path by name, else the trash. ``EMPTY`` serves nothing.

    Holders are first reduced to one a hash, so content that very many paths share costs one row.
    """
    live = entries.where(is_tracked() & (F.col("hash") != EMPTY)).select("folder", "path", "hash")
    here = live.distinct().withColumn("__here", F.lit(True))
    first = live.groupBy("folder", "hash").agg(F.min("path").alias("__path"))
    bin_ = trash.where(F.col("hash") != EMPTY).groupBy("folder", "hash").agg(F.min("trashed_path").alias("__trash"))
    j = wanted.join(here, ["folder", "path", "hash"], "left").join(first, ["folder", "hash"], "left").join(bin_, ["folder", "hash"], "left")
    origin = F.when(F.col("__here"), "same path").when(F.col("__path").isNotNull(), "entry").when(F.col("__trash").isNotNull(), "trash")
    place = F.when(F.col("__here"), F.col("path")).otherwise(F.coalesce("__path", "__trash"))
    return j.withColumn("fill_from", origin).withColumn("fill_path", place).drop("__here", "__path", "__trash")


def announced_hash(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """V6: adds ``announced_hash``: the hash of the last version that peers could have seen."""
    p = pending.select(*KEY, F.lit(True).alias("__p"), F.col("announced_hash").alias("__a"))
    seen = F.when(F.col("__p"), F.coalesce("__a", F.lit(EMPTY))).otherwise(F.coalesce("hash", F.lit(EMPTY)))
    return entries.join(p, KEY, "left").withColumn("announced_hash", seen).drop("__p", "__a")


def assign_seq(changes: DataFrame, last: DataFrame) -> DataFrame:
    """V7: adds ``seq``, dense for each folder and node by time, then path, beyond ``last_seq``.

    A large folder is numbered in ranges of its order.
    """
    l_ = last.select("folder", "node", "last_seq")
    numbered = row_number(changes, ["folder", "node"], ["at", "path"], "__n")
    return numbered.join(l_, ["folder", "node"], "left").withColumn("seq", F.col("__n") + F.coalesce("last_seq", F.lit(0))).drop("__n", "last_seq")


def two_looks(looks: DataFrame, gap_ns: int = 2_000_000_000) -> DataFrame:
    """Adds ``settled`` for paths whose ctime is in the future: the look before on the same machine, two seconds or more earlier, saw the same ctime."""
    w = Window.partitionBy(*[k for k in KEY if k in looks.columns]).orderBy("looked_ns")
    same = (F.lag("ctime_ns").over(w) == F.col("ctime_ns")) & (F.col("looked_ns") - F.lag("looked_ns").over(w) >= gap_ns)
    aged = F.col("looked_ns") - F.col("ctime_ns") >= gap_ns
    return looks.withColumn("settled", aged | F.coalesce(same, F.lit(False)))
