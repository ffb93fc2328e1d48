"""The brake on mass changes, the quarantine of held batches, and what users decide about them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import dealt_by_path, is_live
from ..functions.paths import ancestors
from ..functions.vectors import vv_dominates_or_equals, vv_key
from ..schema import BRAKE_BYTES, BRAKE_COUNT, BRAKE_PERCENT
from .merge import classify_batch
from .ordered import row_number


def receiver_summary(classified: DataFrame, keys: list[str]) -> DataFrame:
    """K1: what applying would do here: ``adds, mods, dels, bytes``.

    Metadata-only and index-only items count nothing; a tombstone counts where it meets a live
    non-directory; bytes are those of adds and mods (a change of the exec bit alone included).
    """
    does = F.col("decision").isin("apply", "merge", "conflict") & F.coalesce(F.col("mode").isin("fetch", "direct"), F.lit(False))
    here = F.coalesce(~F.col("own_deleted"), F.lit(False))
    dele = does & F.col("in_deleted") & here & (F.col("own_kind") != "dir")
    add, mod = does & ~F.col("in_deleted") & ~here, does & ~F.col("in_deleted") & here
    size = F.sum(F.when(add | mod, F.col("in_size")).otherwise(0))
    return classified.groupBy(*keys).agg(F.count_if(add).alias("adds"), F.count_if(mod).alias("mods"), F.count_if(dele).alias("dels"), size.alias("bytes"))


def evaluate_brake(summary: DataFrame, count: Column | int = BRAKE_COUNT, percent: Column | int = BRAKE_PERCENT, size: Column | int = BRAKE_BYTES) -> DataFrame:
    """K2: adds ``held`` and ``reason`` from ``mods, dels, bytes, tracked``. Whole numbers throughout, no ratios."""
    c, p, s = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (count, percent, size))
    d = F.col("mods") + F.col("dels")
    many = (c > 0) & (F.col("tracked") > 0) & (d >= c) & (d * 100 >= p * F.col("tracked"))
    large = F.col("bytes") > s
    share = F.expr("(mods + dels) * 100 div greatest(tracked, 1)")
    by_count = F.format_string("would delete or modify %d of %d tracked files (%d%%)", d, F.col("tracked"), share)
    by_size = F.format_string("would write %d bytes", F.col("bytes"))
    return summary.withColumn("held", many | large).withColumn("reason", F.when(many, by_count).when(large, by_size))


def sender_precheck(summary: DataFrame, announced: DataFrame) -> DataFrame:
    """K3: the brake on what would be sent, against the tracked count as of the last announcement, 0 if there was none."""
    last = announced.select("folder", "node", F.col("announced_tracked").alias("tracked"))
    return evaluate_brake(summary.join(last, ["folder", "node"], "left").fillna(0, ["tracked"]))


def pause_or_send(prechecked: DataFrame, paused: DataFrame) -> DataFrame:
    """K4: adds ``action`` (pause, stay paused, send) and ``would_pass``. A paused folder stays paused."""
    p = paused.select("folder", "node", F.lit(True).alias("__p")).distinct()
    j = prechecked.join(p, ["folder", "node"], "left")
    action = F.when(F.col("__p"), "stay paused").when(F.col("held"), "pause").otherwise("send")
    return j.withColumn("action", action).withColumn("would_pass", ~F.col("held")).drop("__p")


def quarantine_match(incoming: DataFrame, held_versions: DataFrame) -> DataFrame:
    """K5: incoming entries that equal or exceed a held version of their path, with the earliest such ``held_batch``."""
    h = held_versions.select("folder", "path", F.col("version").alias("__v"), F.col("arrival").alias("__a"), F.col("batch").alias("__b"))
    # Copies of a vector at a path differ in arrival only: the first is enough.
    h = h.withColumn("__k", vv_key(F.col("__v"))).groupBy("folder", "path", "__k").agg(F.first("__v").alias("__v"), F.min(F.struct("__a", "__b")).alias("__z"))
    j = incoming.join(h, ["folder", "path"]).where(vv_dominates_or_equals(F.col("version"), F.col("__v")))
    keys = ["folder", "path", "source"] if "source" in incoming.columns else ["folder", "path", "node"]
    return j.groupBy(*keys).agg(F.min("__z").alias("__z")).select(*keys, F.col("__z.__b").alias("held_batch"), F.col("__z.__a").alias("arrival"))


def _stored(versions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, arrival`` of the version of each group that is kept as its entry: the first, then each that dominates or equals the one kept so far.

    Folded along sorted rows with one vector of state; a group is never gathered.
    """
    kind = {f.name: f.dataType.simpleString() for f in versions.schema.fields}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, vector, arrival = None, {}, 0
        columns = [*keys, "arrival"]
        for b in batches:
            out = []
            for *now, v, n in zip(*(b[c] for c in (*keys, "version", "arrival")), strict=True):
                counters = {} if v is None else dict(v)
                if now != key:
                    out += [] if key is None else [(*key, arrival)]
                    key, vector, arrival = now, counters, n
                elif all(counters.get(k, 0) >= c for k, c in vector.items()):
                    vector, arrival = counters, n
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([(*key, arrival)], columns=columns)

    dealt = versions.select(*keys, "version", "arrival").repartition(*keys).sortWithinPartitions(*keys, "arrival")
    return dealt.mapInPandas(fold, ", ".join(f"`{k}` {kind[k]}" for k in keys) + ", arrival long")


def hold(held_versions: DataFrame, joining: DataFrame) -> DataFrame:
    """K6: held versions with those that join (``folder, batch, path, version, stamp, at``) behind them, by arrival number.

    Tables with a ``node`` are of many machines, each of which has its own numbers. Every version
    stays; ``stored`` marks the one of each batch and path that is its entry: the first, replaced by
    each later one that dominates or equals the one stored so far. A null version is the empty
    vector, which every other reaches; an empty side adds nothing. Those that join a large folder
    are numbered in ranges.
    """
    owner = _owner(held_versions, joining)
    top = held_versions.groupBy(*owner).agg(F.max("arrival").alias("__top"))
    late = row_number(joining, owner, ["at", "batch", "path"], "__n").join(top, owner, "left")
    late = late.withColumn("arrival", F.coalesce("__top", F.lit(0)) + F.col("__n"))
    keys = [*owner, "batch", "path"]
    cols = [*keys, "version", "stamp", "arrival"]
    every = held_versions.select(*cols).unionByName(late.select(*cols))
    kept = _stored(every, keys).withColumn("__s", F.lit(True))
    return every.join(kept, [*keys, "arrival"], "left").withColumn("stored", F.coalesce("__s", F.lit(False))).drop("__s")


def _owner(*tables: DataFrame) -> list[str]:
    """What tells whose rows these are: folder and node, where all the tables have a node."""
    return ["folder", "node"] if all("node" in t.columns for t in tables) else ["folder"]


def approve(held: DataFrame, entries: DataFrame, batches: DataFrame) -> DataFrame:
    """K7: the entries of approved batches classified against the index as it stands, with no brake."""
    return classify_batch(held.join(batches.select("batch").distinct(), "batch", "left_semi"), entries)


def common_directory(least: Column, greatest: Column) -> Column:
    """The deepest directory above all paths between the least and the greatest of them; null if that is the top.

    What begins both begins every path between them.
    """
    a, b = F.split(least, "/"), F.split(greatest, "/")
    n = F.least(F.size(a), F.size(b)) - 1
    equal = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1)))
    return F.when(F.size(equal) > 0, F.array_join(F.slice(a, 1, F.size(equal)), "/"))


def review_report(held: DataFrame, items: DataFrame, now_ns: Column, samples: int = 5) -> DataFrame:
    """K9: per held batch: source, ``age_s``, reason, entries, bytes, deletions, the first ``sample_paths``, their deepest
    ``common_dir`` and ``extensions`` (``n``, ``ext``; most common first).

    ``held`` has ``folder, batch, path, size, deleted``, ``items`` ``folder, batch, source, held_at_ns, reason``.
    """
    keys = ["folder", "batch"]
    ext = F.regexp_extract("path", r"[^/.]\.([^/.]+)\z", 1)
    kinds = held.groupBy(*keys, ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    most = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "ext", "n"))), lambda x: F.struct(x["n"].alias("n"), x["ext"].alias("ext")))
    kinds = kinds.groupBy(*keys).agg(most.alias("extensions"))
    ranked = held.select(*keys, "path").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("r") <= samples)
    shown = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("sample_paths"))
    g = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("size").alias("bytes"), F.count_if("deleted").alias("n_deleted"), common_directory(F.min("path"), F.max("path")).alias("common_dir")
    )
    age = F.floor((now_ns - F.col("held_at_ns")) / F.lit(1_000_000_000)).cast("long")
    return g.join(shown, keys).join(kinds, keys).join(items.select(*keys, "source", age.alias("age_s"), "reason"), keys, "left")


def freeze(incoming: DataFrame, pending: DataFrame, paused: DataFrame) -> DataFrame:
    """Adds ``frozen``: the folder is paused (on that node) and the path has a pending change there; such entries wait in arrival order."""
    owner = _owner(incoming, pending, paused)
    p = pending.join(paused.select(*owner).distinct(), owner, "left_semi").select(*owner, "path").distinct().withColumn("__f", F.lit(True))
    return incoming.join(p, [*owner, "path"], "left").withColumn("frozen", F.coalesce("__f", F.lit(False))).drop("__f")


def unfreeze(frozen: DataFrame, entries: DataFrame) -> DataFrame:
    """All waiting entries classified together: the last to arrive of each path and source (and node, where both tables have it) stands for it."""
    keys = [*_owner(frozen, entries), "path"]
    last = frozen.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "source").orderBy(F.desc("arrival")))).where("__n = 1").drop("__n")
    return classify_batch(last, entries, tuple(keys))


def revert_plan(pending: DataFrame, entries: DataFrame) -> DataFrame:
    """What undoing the pending changes does at each path: ``folder, path, action, refetch``, and ``node`` where both tables have it.

    ``pending`` has ``announced_kind, announced_hash, announced_mtime_ns, announced_exec, announced_deleted``
    (nulls where nothing was announced). Content that did not change is kept (its metadata reset); a
    new directory stays while something live is restored beneath it; other content goes to the
    trash; what was announced and live is fetched again.
    """
    owner = _owner(pending, entries)
    keys = [*owner, "path"]
    own = entries.select(*keys, "kind", "hash", "mtime_ns", "exec", "deleted")
    j = pending.join(own, keys, "left")
    now = F.coalesce(~F.col("deleted"), F.lit(False))
    then = F.coalesce(~F.col("announced_deleted"), F.lit(False))
    after_live = F.when(F.col("announced_deleted").isNotNull(), then)
    touched = pending.select(*keys, F.coalesce(~F.col("announced_deleted"), F.lit(False)).alias("__then"))
    kept = entries.where(is_live()).join(touched.select(*keys), keys, "left_anti").select(*keys)
    alive = kept.unionByName(touched.where("__then").select(*keys))
    above = alive.select(*owner, F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("__child", F.lit(True))
    j = j.join(above, keys, "left")
    same = now & then & (F.col("kind") == F.col("announced_kind")) & (F.col("hash") == F.col("announced_hash"))
    meta = (F.col("mtime_ns") != F.col("announced_mtime_ns")) | (F.col("exec") != F.col("announced_exec"))
    dir_stays = now & (F.col("kind") == "dir") & ~(F.coalesce(after_live, F.lit(False)) & (F.col("announced_kind") == "dir")) & F.coalesce("__child", F.lit(False))
    action = F.when(same & (F.col("kind") == "file") & meta, "reset metadata").when(same, "keep").when(dir_stays, "keep directory").when(now, "trash").when(then, "fetch").otherwise("nothing")
    return j.select(*keys, action.alias("action"), (~F.coalesce(same, F.lit(False)) & ~dir_stays & then).alias("refetch"))


def return_denied(held_items: DataFrame) -> DataFrame:
    """Denied items come back behind the others, in the order of their denial: ``arrival`` anew."""
    back = F.col("state") == "denied"
    order = [back, F.when(back, F.col("denied_at")), "arrival", "batch"]
    # the new number has another name than the old one, which is part of the order
    numbered = row_number(held_items, ["folder"], order, "__arrival")
    return numbered.withColumn("arrival", F.col("__arrival")).withColumn("state", F.lit("held")).drop("__arrival")


def rules_recheck(summaries: DataFrame, rules: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """Would a held batch pass under new rules (``folder, hold_count, hold_pct, hold_size``)? Releases nothing.

    Folders without rules, and null limits, have the default ones. ``paused``: the same columns as
    ``summaries`` of the batches that paused folders keep back, with what is unannounced against the
    tracked count as of the last announcement (as :func:`sender_precheck` judges them).
    """
    limits = {"hold_count": BRAKE_COUNT, "hold_pct": BRAKE_PERCENT, "hold_size": BRAKE_BYTES}
    every = summaries if paused is None else summaries.unionByName(paused)
    j = every.join(rules.select("folder", *limits), "folder", "left").withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(v).cast("long")) for c, v in limits.items()})
    return evaluate_brake(j, *(F.col(c) for c in limits)).withColumn("would_pass", ~F.col("held"))


def route_batch(incoming: DataFrame, entries: DataFrame, held_versions: DataFrame, wants: DataFrame, pending: DataFrame, paused: DataFrame) -> DataFrame:
    """What receiving does with each path of each batch: :func:`.merge.classify_batch` with ``repeats``, ``held_batch`` and ``route``.

    ``incoming`` has ``folder, batch, path, position`` and the entry; of a path that a batch repeats
    the last counts. ``route``: ignored (equal or older); already wanted (``wants`` has that version
    or a newer one, and is no move to the trash, ``to_trash``, which outranks nothing); joined (equals or exceeds a version in quarantine: joins that item, the
    earliest if several); frozen (pending in a paused folder); kept: what the brake judges.
    """
    keys = ["folder", "batch", "path"]
    # Everything is dealt by folder and path alone, so that a row with its entry is shuffled once; the batch is matched within.
    here = (F.col("folder") == F.col("__f")) & (F.col("path") == F.col("__p")) & (F.col("batch") <= F.col("__b")) & (F.col("batch") >= F.col("__b"))
    found = lambda m: [F.col(k).alias(a) for k, a in zip(keys, ("__f", "__b", "__p"), strict=True)] + m

    def last(rows: DataFrame, *more: Column) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return dealt_by_path(rows).groupBy(*keys).agg(F.max_by(F.struct(*rest), "position").alias("z"), *more).select(*keys, "z.*", *(["repeats"] if more else []))

    c = classify_batch(last(incoming, (F.count(F.lit(1)) - 1).alias("repeats")), dealt_by_path(entries))
    vectors = last(incoming.select(*keys, "position", "version")).select(*keys, F.col("version").alias("in_version"))
    w = wants.where(~F.coalesce("to_trash", F.lit(False))) if "to_trash" in wants.columns else wants
    w = dealt_by_path(w.select("folder", "path", F.col("version").alias("v")))
    reached = vectors.join(w, ["folder", "path"]).where(vv_dominates_or_equals(F.col("v"), F.col("in_version"))).select(*keys).distinct()
    c = c.join(reached.select(*found([F.lit(True).alias("wanted")])), here, "left").drop("__f", "__b", "__p").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    h = dealt_by_path(held_versions.select("folder", "path", "version", "arrival", "batch")).withColumn("k", vv_key(F.col("version"))).groupBy("folder", "path", "k").agg(F.first("version").alias("v"), F.min(F.struct("arrival", "batch")).alias("first"))
    near = vectors.join(h, ["folder", "path"]).where(vv_dominates_or_equals(F.col("in_version"), F.col("v"))).groupBy(*keys).agg(F.min("first").alias("first"))
    c = c.join(near.select(*found([F.col("first.batch").alias("held_batch")])), here, "left").drop("__f", "__b", "__p")
    c = freeze(c, pending.select("folder", "path"), paused.select("folder"))
    route = F.when(F.col("decision") == "ignore", "ignored").when(F.col("wanted"), "already wanted").when(F.col("held_batch").isNotNull(), "joined").when(F.col("frozen"), "frozen").otherwise("kept")
    return c.withColumn("route", route).drop("wanted", "frozen")


def received_report(routed: DataFrame) -> DataFrame:
    """Per batch, from :func:`route_batch`: paths, repeats, where they went, and of the kept ones what becomes of them."""
    at = lambda r: F.count_if(F.col("route") == r)
    kept = lambda d: F.count_if((F.col("route") == "kept") & (F.col("decision") == d))
    counts = {"ignored": at("ignored"), "already_wanted": at("already wanted"), "joined": at("joined"), "frozen": at("frozen"), "kept": at("kept"), "applied": kept("apply"), "merged": kept("merge"), "conflicts": kept("conflict")}
    return routed.groupBy("folder", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("repeats").alias("repeats"), *[v.alias(k) for k, v in counts.items()])
