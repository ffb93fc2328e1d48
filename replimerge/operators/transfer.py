"""Transfer planning: sources, slots, the order of commits, waiting and backing off."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import least_tier, size_allowed, tier_rank
from ..functions.paths import ancestors, depth
from ..schema import BACKOFF_FIRST_S, BACKOFF_MAX_S, EMPTY, SLOTS_PER_FOLDER, SLOTS_PER_PEER
from ..sources.shared import written
from .ordered import row_number


def want_sources(wants: DataFrame, entries: DataFrame) -> DataFrame:
    """``folder, path, source``: who sent or wrote the entry, and every node that has the same content at the path."""
    named = wants.select("folder", "path", F.explode(F.array("batch_source", "modified_by")).alias("source")).where("source is not null")
    holders = entries.where(F.col("hash") != EMPTY).select("folder", "path", "hash", F.col("node").alias("source"))
    same = wants.where(F.col("hash") != EMPTY).select("folder", "path", "hash").join(holders, ["folder", "path", "hash"]).select("folder", "path", "source")
    return named.unionByName(same).distinct()


def source_choices(wants: DataFrame, sources: DataFrame, peers: DataFrame) -> DataFrame:
    """Connected sources that are neither refused nor excluded, with ``tier`` and ``allowed`` by size."""
    ok = sources.where(~F.coalesce("refused", F.lit(False)) & ~F.coalesce("excluded", F.lit(False))).select("folder", "path", "source")
    up = peers.where("online").select(F.col("node").alias("source"), "tier")
    j = wants.select("folder", "path", "size").join(ok, ["folder", "path"]).join(up, "source")
    return j.withColumn("allowed", size_allowed(F.col("tier"), F.col("size")))


def select_source(wants: DataFrame, sources: DataFrame, peers: DataFrame) -> DataFrame:
    """Each want with its best ``source`` (tier, then node), or what it waits for: ``need`` (a tier) or no source."""
    c = source_choices(wants, sources, peers)
    best = F.min(F.when(F.col("allowed"), F.struct(tier_rank(F.col("tier")).alias("r"), F.col("source").alias("s"))))
    g = c.groupBy("folder", "path").agg(best.alias("b"), F.lit(True).alias("__any"))
    j = wants.join(g, ["folder", "path"], "left")
    state = F.when(F.col("b").isNotNull(), "source").when(F.col("__any"), "deferred").otherwise("no source")
    need = F.when(state == "deferred", least_tier(F.col("size")))
    return j.withColumn("state", state).withColumn("source", F.col("b.s")).withColumn("need", need).drop("b", "__any")


def greedy_slots(rows: list[tuple[str, list[str]]], per_peer: int, per_folder: int, running: dict[str, int]) -> list[tuple[str, str]]:
    """Each path in order takes the first of its sources with a free slot, while the folder has one."""
    used, free, out = Counter(running), per_folder - sum(running.values()), []
    for path, allowed in rows:
        if free <= 0:
            break
        for node in allowed:
            if used[node] < per_peer:
                used[node] += 1
                free -= 1
                out.append((path, node))
                break
    return out


def plan_fetches(choices: DataFrame, running: DataFrame | None = None, per_peer: int = SLOTS_PER_PEER, per_folder: int = SLOTS_PER_FOLDER) -> DataFrame:
    """``folder, path, source`` of the fetches to start, from :func:`source_choices` rows.

    Wants go by (tier, node) of their best source, then path; a full peer falls through to the next
    source. Wants with the same list of sources are interchangeable, so only the first ``per_folder``
    of each list are looked at.

    A round takes of each folder the first ``per_folder`` wants, in order, that have a source with a
    free slot. Slots are only taken, so a want that finds none can never be served later. If a round
    does not fill the folder, either it saw all such wants, or one of them found its sources full
    that were not before: it filled a peer. A folder has room for ``per_folder / per_peer`` full peers,
    so that many rounds and one more are enough, and a task gets ``per_folder`` rows of a folder,
    whatever the number of wants, peers and lists.
    """
    listed = (
        choices.where("allowed")
        .groupBy("folder", "path")
        .agg(F.sort_array(F.collect_list(F.struct(tier_rank(F.col("tier")).alias("r"), F.col("source").alias("s")))).alias("l"))
        .select("folder", "path", F.col("l")[0].alias("best"), F.transform("l", lambda x: x["s"]).alias("allowed"))
    )
    alike = Window.partitionBy("folder", "allowed").orderBy("best", "path")
    few = written(listed.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= per_folder).drop("n"), "fetch-wants")
    none = few.select("folder", F.lit("").alias("source"), F.lit(0).cast("long").alias("n")).limit(0)
    taken = none if running is None else running.select("folder", "source", F.col("n").cast("long").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        used = pdf["used"].iloc[0]
        busy = {} if used is None else {k: int(v) for k, v in dict(used).items()}
        got = greedy_slots([(p, list(a)) for p, a in zip(pdf["path"], pdf["allowed"], strict=True)], per_peer, per_folder, busy)
        return pd.DataFrame([(pdf["folder"].iloc[0], p, s) for p, s in got], columns=["folder", "path", "source"])

    out = None
    for _ in range(-(-per_folder // per_peer) + 1):
        by_peer = taken.groupBy("folder", "source").agg(F.sum("n").alias("n"))
        state = by_peer.groupBy("folder").agg(F.sum("n").alias("busy"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("used"))
        free = lambda s: F.coalesce(F.try_element_at("used", s), F.lit(0)) < per_peer
        open_ = few.join(state, "folder", "left").where((F.coalesce("busy", F.lit(0)) < per_folder) & F.exists("allowed", free))
        open_ = open_ if out is None else open_.join(out, ["folder", "path"], "left_anti")
        first = open_.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("best", "path"))).where(F.col("nth") <= per_folder)
        got = written(first.select("folder", "path", "allowed", "used", "nth").groupBy("folder").applyInPandas(plan, "folder string, path string, source string"), "fetch-plan")
        if got.isEmpty():
            break
        out = got if out is None else out.unionByName(got)
        taken = taken.unionByName(got.select("folder", "source", F.lit(1).cast("long").alias("n")))
    return got if out is None else out


def gated(wants: DataFrame) -> DataFrame:
    """Adds ``gated``: a create waits for creates of directories above it (or their way to the trash), the
    deletion of a directory for deletions beneath it."""
    above = F.explode(ancestors(F.col("path")))
    opens = wants.where((~F.col("deleted") & (F.col("kind") == "dir")) | F.col("to_trash")).select("folder", F.col("path").alias("__a")).distinct()
    creates = wants.where(~F.col("deleted")).select("folder", "path", above.alias("__a")).join(opens, ["folder", "__a"], "left_semi").select("folder", "path")
    beneath = wants.where("deleted").select("folder", above.alias("path")).distinct()
    dirs = wants.where(F.col("deleted") & (F.col("kind") == "dir")).select("folder", "path").join(beneath, ["folder", "path"], "left_semi")
    held = creates.unionByName(dirs).distinct().withColumn("__g", F.lit(True))
    return wants.join(held, ["folder", "path"], "left").withColumn("gated", F.coalesce("__g", F.lit(False))).drop("__g")


def order_commits(wants: DataFrame) -> DataFrame:
    """Ready wants (nothing left to fetch, not gated) with ``turn``: creates by path, so parents first, then deletions by path backwards. A large folder is numbered in ranges."""
    ready = gated(wants).where(F.col("ready") & ~F.col("gated"))
    order = ["deleted", F.when(~F.col("deleted"), F.col("path")), F.desc(F.when(F.col("deleted"), F.col("path")))]
    return row_number(ready, ["folder"], order, "turn")


def waiting_for(wants: DataFrame) -> DataFrame:
    """Adds ``waits_for``: of a blocked create the nearest deferred directory above, of a directory's deletion the nearest deferred deletion beneath."""
    late = wants.where("state = 'deferred'")
    up = wants.where(~F.col("deleted")).select("folder", "path", F.explode(ancestors(F.col("path"))).alias("__a"))
    dirs = late.where(~F.col("deleted") & (F.col("kind") == "dir")).select("folder", F.col("path").alias("__a"))
    near = up.join(dirs, ["folder", "__a"]).groupBy("folder", "path").agg(F.max_by("__a", F.length("__a")).alias("__w"))
    down = late.where("deleted").select("folder", F.col("path").alias("__d"), F.explode(ancestors(F.col("path"))).alias("path"))
    beneath = down.join(wants.where(F.col("deleted") & (F.col("kind") == "dir")).select("folder", "path"), ["folder", "path"], "left_semi")
    below = beneath.groupBy("folder", "path").agg(F.min(F.struct(depth(F.col("__d")).alias("n"), F.col("__d").alias("d"))).alias("z")).select("folder", "path", F.col("z.d").alias("__w"))
    return wants.join(near.unionByName(below), ["folder", "path"], "left").withColumnRenamed("__w", "waits_for")


def backoff_s(strikes: Column) -> Column:
    """60 seconds, doubling with each strike, an hour at most."""
    return F.least(F.lit(BACKOFF_FIRST_S) * F.pow(F.lit(2), F.least(F.greatest(strikes - 1, F.lit(0)), F.lit(16))), F.lit(BACKOFF_MAX_S)).cast("long")


def expire(wants: DataFrame, now_ns: Column) -> DataFrame:
    """Adds ``event``: a stalled fetch, an overdue commit (warning only), an elapsed retry; null while there is time."""
    due = F.col("deadline_ns") <= now_ns
    event = F.when(due & (F.col("state") == "fetching"), "stalled").when(due & (F.col("state") == "committing"), "overdue").when(due & (F.col("state") == "retry"), "retry")
    return wants.withColumn("event", event)


def next_deadline(wants: DataFrame, sources: DataFrame) -> DataFrame:
    """``folder, deadline_ns``: the earliest deadline of a want or end of a refusal or exclusion."""
    own = wants.where(F.col("state").isin("fetching", "committing", "retry")).select("folder", "deadline_ns")
    ends = sources.select("folder", F.explode(F.array("refused_until", "excluded_until")).alias("deadline_ns"))
    return own.unionByName(ends).where("deadline_ns is not null").groupBy("folder").agg(F.min("deadline_ns").alias("deadline_ns"))


def unrecoverable(wants: DataFrame, members: DataFrame, answers: DataFrame) -> DataFrame:
    """Restoring wants that every other member refused."""
    ask = wants.where("restoring").select("folder", "path", "node").join(members.select("folder", F.col("node").alias("member")), "folder").where("member <> node")
    no = answers.where("refused").select("folder", "path", F.col("source").alias("member"), F.lit(1).alias("__no")).distinct()
    g = ask.join(no, ["folder", "path", "member"], "left").groupBy("folder", "path").agg(F.count(F.lit(1)).alias("asked"), F.count("__no").alias("refused"))
    return g.where("asked = refused")


def orphan_staging(files: DataFrame, wants: DataFrame) -> DataFrame:
    """Staged files whose first 16 hex digits match no wanted hash."""
    named = files.withColumn("__h", F.regexp_extract("name", "^([0-9a-f]{16})", 1))
    return named.join(wants.select(F.substring("hash", 1, 16).alias("__h")).distinct(), "__h", "left_anti").drop("__h")
