"""Audits: each returns the rows that violate an invariant, none on sound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entries import is_live, packed, same_content, unpacked, winner_key
from ..functions.paths import ancestors, conflict_copy_name, name_of, parent_of
from ..functions.vectors import vv_compare, vv_dominates_or_equals, vv_key, vv_merge_agg
from ..schema import EMPTY, KIND_RANK
from .ordered import running


def convergence(entries: DataFrame, n_members: int, listing: DataFrame | None = None, held_dirs: DataFrame | None = None) -> DataFrame:
    """A1: paths whose live (kind, hash, exec) is not the same on all members, or differs from a member's ``listing``.

    ``listing`` (``folder, node, path, kind, hash, exec``) is what is on disk. ``held_dirs`` (``folder,
    node, path``): directories that a node keeps only for ignored files in them; they count as gone
    from its index, but must be on its disk like others.
    """
    keys = ["folder", "node", "path"]
    live = entries.where(is_live()).select(*keys, F.struct("kind", "hash", "exec").alias("state"))
    shown = live if held_dirs is None else live.join(held_dirs.select(*keys), keys, "left_anti")
    g = shown.groupBy("folder", "path").agg(F.count_distinct("state").alias("states"), F.count(F.lit(1)).alias("holders"))
    g = g.where(f"states > 1 or holders < {int(n_members)}")
    if listing is None:
        return g
    disk = listing.select(*keys, F.struct("kind", "hash", "exec").alias("disk"))
    off = live.join(disk, keys, "full_outer").where(~F.col("state").eqNullSafe(F.col("disk"))).groupBy("folder", "path").agg(F.count(F.lit(1)).alias("off_disk"))
    return g.join(off, ["folder", "path"], "full_outer").fillna(0)


def lost_content(adopted: DataFrame, files: DataFrame, trash: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """A2: adopted hashes (``folder, node, hash``) found neither in the node's files nor in its trash.

    With ``edits`` (``folder, node, path, edited_ns``), ``adopted`` has ``path`` and ``adopted_ns`` too:
    what the node's own user changed at the path after the adoption is no loss.
    """
    have = files.select("folder", "node", "hash").unionByName(trash.select("folder", "node", "hash")).distinct()
    asked = adopted.where(F.col("hash") != EMPTY)
    if edits is not None:
        keys = ["folder", "node", "path"]
        last = edits.groupBy(*keys).agg(F.max("edited_ns").alias("edited_ns"))
        asked = asked.select(*keys, "hash", "adopted_ns").join(last, keys, "left").where(F.col("edited_ns").isNull() | (F.col("edited_ns") <= F.col("adopted_ns")))
    return asked.select("folder", "node", "hash").distinct().join(have, ["folder", "node", "hash"], "left_anti")


def _versions(entries: DataFrame) -> DataFrame:
    """``folder, path, version, stamp`` of each distinct vector of a path: what :func:`non_monotone_changes` compares."""
    e = entries.select("folder", "path", "node", "version", "stamp").withColumn("__vk", vv_key(F.col("version")))
    return e.groupBy("folder", "path", "__vk").agg(F.min_by(F.struct("version", "stamp"), "node").alias("z")).select("folder", "path", "z.*")


def resurrections(entries: DataFrame, held_dirs: DataFrame | None = None, discarded: DataFrame | None = None) -> DataFrame:
    """A3: paths live on a node although a tombstone of theirs was never contradicted: no other version dominates it or is concurrent with it.

    Such a tombstone reaches every version of its path, so its vector is that of all of them merged:
    two sums with partial aggregation, whatever the number of versions. ``discarded`` (``folder, path,
    vv_key``): versions that their author took back by a revert before anyone saw them; they delete
    nothing and contradict nothing. Directories that a node keeps for ignored files (``held_dirs``:
    ``folder, node, path``) are not live there.
    """
    v = entries.select("folder", "path", "version", "deleted").withColumn("k", vv_key(F.col("version")))
    if discarded is not None:
        v = v.join(discarded.select("folder", "path", F.col("vv_key").alias("k")).distinct(), ["folder", "path", "k"], "left_anti")
    dead = v.where("deleted").select("folder", "path", "k").distinct()
    merged = vv_merge_agg(v.join(dead.select("folder", "path").distinct(), ["folder", "path"], "left_semi"), ["folder", "path"])
    gone = dead.join(merged.select("folder", "path", vv_key(F.col("version")).alias("k")), ["folder", "path", "k"]).select("folder", "path")
    keys = ["folder", "node", "path"]
    alive = entries.where(is_live()).select(*keys)
    alive = alive if held_dirs is None else alive.join(held_dirs.select(*keys), keys, "left_anti")
    return alive.select("folder", "path").join(gone, ["folder", "path"], "left_semi").distinct()


def _displacements(copies: DataFrame) -> int:
    """How many directories above a copy may have been displaced, at most: their names are those of copies."""
    return copies.agg(F.max(F.size(F.split(parent_of(F.col("path")), r"\.conflict-")) - 1)).first()[0] or 0


def places_made(copies: DataFrame, displaced: DataFrame, steps: int | None = None) -> DataFrame:
    """``folder, path, place``: every place at which a conflict copy may have been made: where it is, and back along directories that were displaced with it.

    ``displaced`` (``folder, copy, path``): names that displaced directories got. Each step maps the
    deepest such directory above the place back, so there are no more ``steps`` (counted if not given) than
    the directories above the deepest copy have tags. Only directories with a tag are looked up.
    """
    at = copies.select("folder", "path", F.col("path").alias("place"))
    every = at
    for _ in range(_displacements(copies) if steps is None else steps):
        up = at.withColumn("copy", F.explode(F.filter(ancestors(F.col("place")), lambda d: F.contains(d, F.lit(".conflict-")))))
        deepest = up.join(displaced.select("folder", "copy", F.col("path").alias("was")), ["folder", "copy"]).groupBy("folder", "path", "place").agg(F.max_by(F.struct("copy", "was"), F.length("copy")).alias("z"))
        at = deepest.select("folder", "path", F.concat("z.was", F.substr("place", F.length("z.copy") + 1, F.length("place"))).alias("place"))
        every = every.unionByName(at)
    return every.distinct()


def _losers(entries: DataFrame) -> DataFrame:
    """``folder, path, copy, kind, hash, exec``: the versions that lost, and the name of the copy that each was to get; ``hash`` is packed.

    All versions are shuffled once, by path, with no more than the comparison needs. Of versions of
    other content, one of them live, the winner rule decides by the exec bit at the latest if their kinds are
    known, so the size and the hash before, which rank behind it, are there only for other kinds.
    Both sides of the comparison must read one shuffle. So the columns come out of the sum over copies of a
    version, and the condition is one over both sides: a filter on one side alone would go ahead of its shuffle.
    """
    odd = ~F.coalesce(F.col("kind").isin(*KIND_RANK), F.lit(False))
    e = entries.select(
        "folder", "path", "version", "stamp", "deleted", "mtime_ns", "modified_by", "kind", "exec", "author_host", packed(F.col("hash")).alias("hash"), (F.col("hash") != F.col("prev_hash")).alias("edited"),
        F.when(odd, F.col("size")).alias("size"), F.when(odd, F.col("prev_hash")).alias("prev_hash"),
    )
    rest = [c for c in e.columns if c not in ("folder", "path", "version")]
    dealt = e.repartition("folder", "path").withColumn("k", vv_key(F.col("version")))
    v = dealt.groupBy("folder", "path", "k", *rest).agg(F.first(F.struct("version", *rest)).alias("z")).select("folder", "path", "k", "z.*")
    side = lambda p: v.select([F.col(c).alias(f"{p}{c}") for c in v.columns])
    key = lambda p: winner_key(p, F.col(f"{p}edited"))
    at = (F.col("a_folder") == F.col("b_folder")) & (F.col("a_path") == F.col("b_path"))
    beaten = F.when(~F.col("a_deleted") & (F.col("a_k") != F.col("b_k")) & ~same_content("a_", "b_") & (vv_compare(F.col("a_version"), F.col("b_version")) == "concurrent"), key("a_") < key("b_"))
    lost = side("a_").join(side("b_"), at & beaten, "left_semi")
    name = conflict_copy_name(F.col("a_path"), F.col("a_kind"), F.col("a_mtime_ns"), F.col("a_author_host"), F.col("a_modified_by"))
    return lost.select(F.col("a_folder").alias("folder"), F.col("a_path").alias("path"), name.alias("copy"), F.col("a_kind").alias("kind"), F.col("a_hash").alias("hash"), F.col("a_exec").alias("exec"))


def unexplained_conflicts(entries: DataFrame, edited: DataFrame | None = None) -> DataFrame:
    """A4: live ``.conflict-`` entries that are no copy of a losing version, at any place they may have been made (:func:`places_made`).

    A version lost if it is live and ranks below a concurrent one of other content. A copy must have
    its name and (kind, hash, exec), unless a user edited it since (``edited``: ``folder, path``).
    Copies that are explained where they are go no further; only others are mapped back, and only if
    a directory above some copy may have been displaced.
    """
    tagged = name_of(F.col("path")).contains(".conflict-")
    losers = _losers(entries.where(~tagged))
    made = entries.where(is_live() & tagged)
    copies = made.select("folder", "path", "kind", packed(F.col("hash")).alias("hash"), "exec")
    there = losers.select(F.col("folder").alias("l_folder"), F.col("copy").alias("place"), *[F.col(c).alias(f"l_{c}") for c in ("kind", "hash", "exec")])
    same = (F.col("kind") == F.col("l_kind")) & (F.col("hash") == F.col("l_hash")) & ((F.col("kind") != "file") | (F.col("exec") == F.col("l_exec")))
    # An anti join would go into the branches of a union, each with all losers.
    met = copies.join(there.withColumn("met", F.lit(True)), (F.col("folder") == F.col("l_folder")) & (F.col("path") == F.col("place")) & same, "left")
    left = met.where("met is null").select(*copies.columns).distinct()
    steps = _displacements(made)
    if steps or edited is not None:
        places = places_made(left, losers.where("kind = 'dir'").select("folder", "copy", "path").distinct(), steps)
        named = places.join(there.withColumnRenamed("l_folder", "folder"), ["folder", "place"])
        good = left.join(named, ["folder", "path"]).where(same).select("folder", "path", "kind", "hash", "exec")
        if edited is not None:
            own = named.join(places.join(edited.select("folder", F.col("path").alias("place")).distinct(), ["folder", "place"], "left_semi").select("folder", "path").distinct(), ["folder", "path"], "left_semi")
            good = good.unionByName(left.join(own.select("folder", "path").distinct(), ["folder", "path"], "left_semi"))
        left = left.join(good.distinct(), ["folder", "path", "kind", "hash", "exec"], "left_anti")
    return left.select("folder", "path", unpacked(F.col("hash")).alias("hash"))


def held_commits(commits: DataFrame, held: DataFrame, approved: DataFrame) -> DataFrame:
    """A5: commits of a batch that is still held and was not approved."""
    still = held.select("folder", "batch").distinct().join(approved.select("folder", "batch").distinct(), ["folder", "batch"], "left_anti")
    return commits.join(still, ["folder", "batch"], "left_semi")


def vector_content(entries: DataFrame, discarded: DataFrame | None = None) -> DataFrame:
    """Paths where equal vectors stand for different (kind, hash, exec, deleted).

    ``discarded`` (``folder, node, path, vv_key``): versions that their author took back by a revert
    before anyone saw them; their vectors may be issued again.
    """
    e = entries.withColumn("vv_key", vv_key(F.col("version")))
    e = e if discarded is None else e.join(discarded.select("folder", "node", "path", "vv_key"), ["folder", "node", "path", "vv_key"], "left_anti")
    return e.groupBy("folder", "path", "vv_key").agg(F.count_distinct("kind", "hash", "exec", "deleted").alias("contents")).where("contents > 1")


def adopt_dominance(landed: DataFrame) -> DataFrame:
    """Commits (``new_version`` over ``old_version``) that don't dominate or equal the record they landed on."""
    return landed.where(~vv_dominates_or_equals(F.col("new_version"), F.col("old_version")))


def readmitted_changes(entries: DataFrame, reverted: DataFrame, user_changes: DataFrame) -> DataFrame:
    """Own versions (``written_ns``) above the mark of a reverted path (``folder, path, node, mark, reverted_ns``), with ``user_changed``.

    Only a change by the node's user (``folder, path, node, changed_ns``) after the revert and before the version explains it.
    """
    keys = ["folder", "path", "node"]
    own = F.coalesce(F.try_element_at("version", F.col("node")), F.lit(0))
    e = entries.join(reverted.select(*keys, "mark", "reverted_ns"), keys).where((own > F.col("mark")) & (F.col("written_ns") > F.col("reverted_ns")))
    near = e.select(*keys, "written_ns", "reverted_ns").join(user_changes.select(*keys, "changed_ns"), keys).where("changed_ns > reverted_ns and changed_ns <= written_ns")
    u = near.select(*keys, "written_ns").distinct().withColumn("user_changed", F.lit(True))
    return e.join(u, [*keys, "written_ns"], "left").fillna(False, ["user_changed"])


def non_monotone_changes(entries: DataFrame) -> DataFrame:
    """A10: a version that dominates another at its path without a greater stamp."""
    v = _versions(entries)
    a = v.select("folder", "path", F.col("version").alias("va"), F.col("stamp").alias("sa"))
    b = v.select("folder", "path", F.col("version").alias("vb"), F.col("stamp").alias("sb"))
    return a.join(b, ["folder", "path"]).where((F.col("sa") <= F.col("sb")) & (vv_compare(F.col("va"), F.col("vb")) == "dominates")).select("folder", "path").distinct()


def broken_sequence(entries: DataFrame) -> DataFrame:
    """A10: records whose ``seq`` is not one above the one before on their folder and node."""
    after = running(entries, ["folder", "node"], ["seq"], F.col("seq"), "before", fold="max")  # along seq the greatest ahead is the last
    return after.where("before is not null and seq <> before + 1")


def frozen_sends(batch_entries: DataFrame, pending: DataFrame, paused: DataFrame) -> DataFrame:
    """Entries that were sent although their folder was paused and their path pending."""
    p = pending.join(paused.select("folder", "node").distinct(), ["folder", "node"], "left_semi").select("folder", "node", "path").distinct()
    return batch_entries.join(p, ["folder", "node", "path"], "left_semi")


def broken_chain(batches: DataFrame, batch_entries: DataFrame | None = None) -> DataFrame:
    """Batches whose ``seq_low`` is not the ``seq_high`` before, that are empty ranges, or of whose entries (``folder, source, batch_no, seq``) ``outside`` lie beyond the range."""
    linked = running(batches, ["folder", "source"], ["seq_high"], F.col("seq_high"), "expected_low", fold="max").fillna(0, ["expected_low"])
    if batch_entries is None:
        return linked.where("seq_low <> expected_low or seq_low >= seq_high")
    keys = ["folder", "source", "batch_no"]
    off = batch_entries.select(*keys, "seq").join(batches.select(*keys, "seq_low", "seq_high"), keys).where("seq <= seq_low or seq > seq_high")
    linked = linked.join(off.groupBy(*keys).agg(F.count(F.lit(1)).alias("outside")), keys, "left").fillna(0, ["outside"])
    return linked.where("seq_low <> expected_low or seq_low >= seq_high or outside > 0")


def unsafe_tombstones(diff: DataFrame, skips: DataFrame) -> DataFrame:
    """Tombstones written for a path that the same scan skipped, or beneath such a directory."""
    from .diff import covered_by_skip

    return covered_by_skip(diff.where("change = 'delete'"), skips).where("covered")
