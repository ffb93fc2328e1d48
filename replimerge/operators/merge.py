"""Classify and merge: what a received entry means for the index, and what replicas converge to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entries import is_live, next_stamp, rank, same_content, winner_key
from ..functions.paths import ancestors, conflict_copy_name, folded
from ..functions.vectors import vv_compare, vv_dominates_or_equals, vv_increment, vv_merge, vv_merge_agg
from ..schema import EMPTY, KIND_RANK
from .diff import assign_seq

FIELDS = ["kind", "size", "mtime_ns", "stamp", "exec", "hash", "prev_hash", "deleted", "modified_by", "author_host"]


def merge_replicas(entries: DataFrame, keys: tuple[str, ...] = ("folder", "path")) -> DataFrame:
    """M5: what the replicas of each path converge to, in one pass.

    The content is that of the greatest entry by the winner rule, the vector the component-wise
    maximum of all. Sound while stamps grow along every chain of versions (audits A7 and A10).
    Both sums combine before the shuffle on the keys.
    """
    one = F.max(F.struct(winner_key().alias("w"), F.struct(*FIELDS).alias("e"))).alias("z")
    content = entries.groupBy(*keys).agg(one, F.count(F.lit(1)).alias("replicas")).select(*keys, "z.e.*", "replicas")
    return content.join(vv_merge_agg(entries, list(keys)), list(keys))


def pick_winner(a: str, b: str) -> Column:
    """M3: true if the entry with prefix ``a`` wins over ``b``."""
    return winner_key(a) >= winner_key(b)


def merge_pair(a: str, b: str) -> dict[str, Column]:
    """M4: the winner's fields under the merged vector, with no increment."""
    first = pick_winner(a, b)
    out = {c: F.when(first, F.col(f"{a}{c}")).otherwise(F.col(f"{b}{c}")) for c in FIELDS}
    return out | {"version": vv_merge(F.col(f"{a}version"), F.col(f"{b}version"))}


def decided_late(a: str, b: str) -> Column:
    """The two differ in nothing that ranks before the hash, so the winner is arbitrary."""
    same = [F.col(f"{a}stamp") == F.col(f"{b}stamp"), F.col(f"{a}deleted") == F.col(f"{b}deleted")]
    same.append((F.col(f"{a}hash") != F.col(f"{a}prev_hash")) == (F.col(f"{b}hash") != F.col(f"{b}prev_hash")))
    same += [F.col(f"{a}mtime_ns") == F.col(f"{b}mtime_ns"), F.col(f"{a}modified_by") == F.col(f"{b}modified_by")]
    out = F.lit(True)
    for s in same:
        out = out & s
    return out


def paired(incoming: DataFrame, local: DataFrame, keys: tuple[str, ...] = ("folder", "path")) -> DataFrame:
    """Incoming entries (prefix ``in_``) beside the local record of the path (prefix ``own_``, null if there is none)."""
    rest = [c for c in incoming.columns if c not in (*keys, "version", *FIELDS)]
    a = incoming.select(*keys, *rest, *[F.col(c).alias(f"in_{c}") for c in (*FIELDS, "version")])
    b = local.select(*keys, *[F.col(c).alias(f"own_{c}") for c in (*FIELDS, "version")], F.lit(True).alias("own_known"))
    return a.join(b, list(keys), "left")


def apply_mode(a: str = "in_", b: str = "own_") -> Column:
    """M2: ``fetch``, ``direct`` (nothing to fetch), ``metadata only`` or ``index only`` (same content)."""
    same = F.coalesce(F.col(f"{b}known") & same_content(a, b), F.lit(False))
    gone = F.col(f"{a}deleted")
    plain = F.when(gone | (F.col(f"{a}kind") == "dir"), "direct").otherwise("fetch")
    return F.when(same & (F.col(f"{a}kind") == "file") & ~gone, "metadata only").when(same, "index only").otherwise(plain)


def classify_batch(incoming: DataFrame, local: DataFrame, keys: tuple[str, ...] = ("folder", "path")) -> DataFrame:
    """M1: :func:`paired` with ``relation``, ``decision`` and ``mode``.

    ``decision``: apply (newer or unknown), ignore (equal or older), merge (concurrent, same
    content), conflict (concurrent, other content). One left join: within a batch the index stands still.
    """
    j = paired(incoming, local, keys)
    relation = F.when(F.col("own_known"), vv_compare(F.col("in_version"), F.col("own_version"))).otherwise("absent")
    j = j.withColumn("relation", relation)
    decision = (
        F.when(F.col("relation").isin("absent", "dominates"), "apply")
        .when(F.col("relation").isin("equal", "dominated"), "ignore")
        .when(same_content("in_", "own_"), "merge")
        .otherwise("conflict")
    )
    j = j.withColumn("decision", decision).withColumn("incoming_wins", (F.col("decision") == "conflict") & pick_winner("in_", "own_"))
    merged_mode = F.when(F.col("in_deleted") | (F.col("in_kind") == "dir"), "direct").otherwise("fetch")
    mode = F.when(F.col("decision") == "apply", apply_mode()).when(F.col("decision") == "merge", apply_mode())
    return j.withColumn("mode", mode.when(F.col("incoming_wins"), merged_mode).when(F.col("decision") == "conflict", "index only"))


def conflict_copies(classified: DataFrame, entries: DataFrame, node: str, host: str = "") -> DataFrame:
    """M7: where the local side of a conflict lost and was live: the entry of its copy at ``copy_path``, or ``to_trash`` if something live is there.

    A copy is a change of ``node`` like any other: it goes on from the record at the copy path,
    tombstone or none, in vector, stamp and ``prev_hash`` (its ``announced_hash`` if the column is there).
    """
    lost = classified.where((F.col("decision") == "conflict") & F.col("incoming_wins") & ~F.col("own_deleted"))
    name = conflict_copy_name(F.col("path"), F.col("own_kind"), F.col("own_mtime_ns"), F.col("own_author_host"), F.col("own_modified_by"))
    seen = F.col("announced_hash") if "announced_hash" in entries.columns else F.col("hash")
    there = entries.select("folder", F.col("path").alias("copy_path"), F.struct("version", "stamp", "deleted", seen.alias("seen")).alias("there"))
    j = lost.withColumn("copy_path", name).join(there, ["folder", "copy_path"], "left")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return j.select(
        "folder", "path", "copy_path",
        F.coalesce(~F.col("there.deleted"), F.lit(False)).alias("to_trash"),
        *[F.col(f"own_{c}").alias(c) for c in ("kind", "size", "mtime_ns", "exec", "hash")],
        next_stamp(F.col("there.stamp"), F.col("own_kind"), F.col("own_mtime_ns"), F.lit(True)).cast("long").alias("stamp"),
        F.coalesce("there.seen", F.lit(EMPTY)).alias("prev_hash"),
        vv_increment(F.coalesce("there.version", nothing), F.lit(node)).alias("version"),
        F.lit(False).alias("deleted"),
        F.lit(node).alias("modified_by"),
        F.lit(host).alias("author_host"),
    )


def adopt(entries: DataFrame, committed: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M8: committed entries taken over: (entries, pending changes, refused entries) afterwards.

    A committed entry (``folder, node, path``, one a path) is taken over unchanged if it dominates or
    equals the record it lands on: it replaces that record under a new ``seq`` of its folder and node,
    in the order of paths, and clears the path's pending change. Others are refused and change nothing.
    """
    keys = ["folder", "node", "path"]
    j = paired(committed.select(*keys, *FIELDS, "version"), entries, tuple(keys))
    ok = F.when(F.col("own_known"), vv_dominates_or_equals(F.col("in_version"), F.col("own_version"))).otherwise(True)
    j = j.withColumn("ok", ok)
    fields = [c for c in entries.columns if c not in (*keys, "seq")]
    taken = j.where("ok").select(*keys, *[F.col(f"in_{c}").alias(c) for c in fields], F.lit(0).alias("at"))
    last = entries.groupBy("folder", "node").agg(F.max("seq").alias("last_seq"))
    taken = assign_seq(taken, last).select(*entries.columns)
    after = entries.join(taken.select(*keys), keys, "left_anti").unionByName(taken)
    refused = committed.join(j.where("not ok").select(*keys), keys, "left_semi")
    return after, pending.join(taken.select(*keys), keys, "left_anti"), refused


def case_collisions(entries: DataFrame) -> DataFrame:
    """M9: ``folder, folded, paths``: live paths, directories above them included, equal but for case or Unicode form."""
    live = entries.where(is_live())
    every = live.select("folder", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    groups = folded(every).groupBy("folder", "folded").agg(F.count_distinct("path").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))
    return groups.where("n > 1")


def winner_fallbacks(classified: DataFrame) -> DataFrame:
    """Conflicts decided only beyond modified_by; there should be none."""
    return classified.where((F.col("decision") == "conflict") & decided_late("in_", "own_"))


def deny_versions(held: DataFrame, local: DataFrame, node: str, host: str, now_ns: Column, batches: DataFrame | None = None) -> DataFrame:
    """K8: the new local entry at each path of the denied ``batches`` (all held ones by default).

    Its vector is that of the record and all held versions of the path, of whatever batch, merged
    and one up on ``node``; its stamp is above all of theirs; the content stays. Without a local
    record it is a tombstone dated ``now_ns``. ``prev_hash`` is what peers last saw: the record's
    ``announced_hash`` if that column is there, else its hash.
    """
    keys = ["folder", "path"]
    denied = held if batches is None else held.join(batches.select("batch").distinct(), "batch", "left_semi")
    at = denied.select(*keys).distinct()
    over = held.join(at, keys, "left_semi").select(*keys, "version", "stamp")
    own = local.join(at, keys, "left_semi")
    both = over.unionByName(own.select(*keys, "version", "stamp"))
    merged = vv_merge_agg(both, keys).withColumn("version", vv_increment(F.col("version"), F.lit(node)))
    top = both.groupBy(*keys).agg((F.max("stamp") + 1).alias("stamp"))
    seen = F.col("announced_hash") if "announced_hash" in local.columns else F.col("hash")
    j = merged.join(top, keys).join(own.select(*keys, "kind", "size", "mtime_ns", "exec", "hash", "deleted", seen.alias("prev_hash")), keys, "left")
    gone = {"kind": F.lit("file"), "size": F.lit(0).cast("long"), "mtime_ns": now_ns, "exec": F.lit(False), "hash": F.lit(EMPTY), "deleted": F.lit(True), "prev_hash": F.lit(EMPTY)}
    return j.withColumns({c: F.coalesce(F.col(c), v) for c, v in gone.items()} | {"modified_by": F.lit(node), "author_host": F.lit(host)})


def kind_rank(kind: Column) -> Column:
    return rank(kind, KIND_RANK)
