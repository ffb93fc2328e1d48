"""Batches and change feeds: windows, coalescing, greedy splits, chains, catch-up, watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import is_metadata_only
from ..schema import BATCH_BYTES, BATCH_ENTRIES, CAP_S, ENTRY_OVERHEAD, QUIET_S
from ..sources.shared import written
from .ordered import greedy_cuts, running


def batch_windows(changes: DataFrame, quiet_us: int = QUIET_S * 1_000_000, cap_us: int = CAP_S * 1_000_000, span_us: int = 3_600_000_000) -> DataFrame:
    """B1: ``folder, node, opened_us, due_us, n`` of the windows over ``folder, node, at_us``.

    A window opens at the first change and closes at the earlier of ``cap_us`` after it and
    ``quiet_us`` after the last; a change at that moment opens the next. Changes of one moment are
    counted first. Quiet gaps split the input into stretches, named by their start and dealt apart;
    along a stretch only the cap closes windows. Stretches of up to ``span_us`` are folded as streams
    with two numbers of state. A longer one is cut into spans, whose windows are found apart
    (:func:`.ordered.greedy_cuts`), so no task follows it from end to end.
    """
    keys, at = ["folder", "node"], F.col("at_us")
    moments = changes.groupBy(*keys, "at_us").agg(F.count(F.lit(1)).alias("n"))
    after = running(moments, keys, ["at_us"], at, "last", fold="max")
    opens = F.when(F.coalesce(at - F.col("last") >= quiet_us, F.lit(True)), at)
    dealt = running(after.withColumn("opens", opens), keys, ["at_us"], F.col("opens"), "run", fold="max")
    dealt = dealt.select(*keys, "at_us", "n", F.coalesce("opens", "run").alias("run"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, last, n = None, 0, 0, 0
        row = lambda: (key[0], key[1], first, min(first + cap_us, last + quiet_us), n)
        columns = ["folder", "node", "opened_us", "due_us", "n"]
        for b in batches:
            out = []
            for folder, node, at, r, more in zip(b["folder"], b["node"], b["at_us"], b["run"], b["n"], strict=True):
                if key != (folder, node, r) or at >= min(first + cap_us, last + quiet_us):
                    if key is not None:
                        out.append(row())
                    key, first, n = (folder, node, r), at, 0
                last, n = at, n + more
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([row()], columns=columns)

    folded = "folder string, node string, opened_us long, due_us long, n long"
    endless = dealt.groupBy(*keys, "run").agg(F.max("at_us").alias("end")).where(F.col("end") - F.col("run") >= span_us).select(*keys, "run")
    if endless.isEmpty():
        return dealt.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "at_us").mapInPandas(fold, folded)
    stretch = [*keys, "run"]
    endless = written(endless, "windows-endless")
    short = dealt.join(endless, stretch, "left_anti").repartition(*stretch).sortWithinPartitions(*stretch, "at_us").mapInPandas(fold, folded)
    long_ = written(dealt.join(endless, stretch, "left_semi").withColumn("since", F.col("at_us") - F.col("run")), "windows-long")

    def capped(p: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.searchsorted(p, p + cap_us)

    cuts = greedy_cuts(long_, stretch, "since", "n", capped, max(span_us, 2 * (cap_us + quiet_us)), cap_us + quiet_us)
    rows = long_.join(cuts, [*stretch, "since"]).groupBy(*stretch, "cut_at").agg(F.max("at_us").alias("last"), F.sum("n").alias("n"))
    opened = F.col("run") + F.col("cut_at")
    return short.unionByName(rows.select(*keys, opened.alias("opened_us"), F.least(opened + cap_us, F.col("last") + quiet_us).alias("due_us"), "n"))


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """B2: one step a path since the last announcement: add, modify, delete, or null (added and deleted again).

    ``changes`` has ``folder, node, path, at_us, announced_live, now_live, hash, size``.
    """
    first = F.min_by("announced_live", F.struct("at_us", "announced_live"))
    last = F.max(F.struct("at_us", "now_live", "hash", "size"))
    g = changes.groupBy("folder", "node", "path").agg(first.alias("was"), last.alias("z"), F.count(F.lit(1)).alias("n_changes"))
    now = F.col("z.now_live")
    step = F.when(F.col("was") & now, "modify").when(F.col("was") & ~now, "delete").when(now, "add")
    return g.select("folder", "node", "path", step.alias("step"), "n_changes", F.col("z.hash").alias("hash"), F.col("z.size").alias("size"))


def batch_summary(entries: DataFrame, keys: list[str]) -> DataFrame:
    """B3 (sender): adds count always, mods and dels only if the content changed; bytes are those of counted adds and mods. Exempt rows count nothing."""
    counted = ~F.col("exempt")
    add = counted & (F.col("step") == "add")
    mod = counted & (F.col("step") == "modify") & ~is_metadata_only()
    dele = counted & (F.col("step") == "delete") & ~is_metadata_only()
    size = F.sum(F.when(add | mod, F.col("size")).otherwise(0))
    return entries.groupBy(*keys).agg(F.count_if(add).alias("adds"), F.count_if(mod).alias("mods"), F.count_if(dele).alias("dels"), size.alias("bytes"))


def split_batches(records: DataFrame, most: int = BATCH_ENTRIES, room: int = BATCH_BYTES, span: int = 1_000_000) -> DataFrame:
    """Adds ``batch_no`` (from 0): greedily by ``seq``, then path, within folder and source, ``most`` entries and ``room`` estimated bytes at most, one at least.

    Rows are numbered in ranges of a large folder's order. Cutting every ``most`` rows is the greedy
    split wherever no such batch is too large; of the other folders the numbers and costs alone, no
    rows, are cut in spans of ``span`` rows apart (:func:`.ordered.greedy_cuts`) and joined back by number.
    """
    keys = ["folder", "source"]
    numbered = running(records, keys, ["seq", "path"], F.lit(1), "__n")
    costs = numbered.select(*keys, "__n", (F.octet_length("path") + ENTRY_OVERHEAD).alias("__cost"))
    sizes = costs.groupBy(*keys, F.floor(F.col("__n") / most).alias("__b")).agg(F.sum("__cost").alias("__size"))
    large = sizes.where(F.col("__size") > room).select(*keys).distinct()
    plain = F.floor(F.col("__n") / most).cast("long")
    if large.isEmpty():
        return numbered.select(*records.columns, plain.alias("batch_no"))
    numbered = written(numbered, "split-numbered")
    slow = numbered.select(*keys, "__n", (F.octet_length("path") + ENTRY_OVERHEAD).alias("__cost")).join(written(large, "split-large"), keys, "left_semi")

    def full(p: np.ndarray, costs: np.ndarray) -> np.ndarray:
        at, used = np.arange(len(p)), np.append(0, np.cumsum(costs))
        by_room = np.searchsorted(used, used[:-1] + room, "right") - 1
        return np.minimum(np.maximum(at + 1, np.minimum(at + most, by_room)), len(p))

    cuts = greedy_cuts(slow, keys, "__n", "__cost", full, max(span, 2 * most), most).select(*keys, "__n", "cut_no")
    return numbered.join(cuts, [*keys, "__n"], "left").select(*records.columns, F.coalesce("cut_no", plain).alias("batch_no"))


def batch_chain(batches: DataFrame) -> DataFrame:
    """Adds ``seq_low``, the ``seq_high`` of the batch before, 0 for the first."""
    chained = running(batches, ["folder", "source"], ["seq_high"], F.col("seq_high"), "seq_low", fold="max")  # along seq_high the greatest ahead is the last
    return chained.fillna(0, ["seq_low"])


def unannounced(entries: DataFrame, pending: DataFrame, announced: DataFrame) -> DataFrame:
    """Records written since the last batch; own changes with their ``step``, adopted ones with null.

    A folder that was never announced (no row, or null) has everything to send.
    """
    p = pending.select("folder", "node", "path", "step")
    last = announced.select("folder", "node", "announced_seq")
    return entries.join(last, ["folder", "node"], "left").where(F.col("seq") > F.coalesce("announced_seq", F.lit(0))).join(p, ["folder", "node", "path"], "left").drop("announced_seq")


def catch_up(entries: DataFrame, pending: DataFrame, acks: DataFrame, announced: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """What each peer of each folder still has to get: ``folder, node, peer, path, seq, hash``.

    Announced records above its ack; a pending path gives the record that peers last saw, if it was
    announced. Peers are those of ``acks`` and, of each folder, the other ``members`` (``folder, node``);
    one that never sent an ack has everything to get.
    """
    last = announced.select("folder", "node", "announced_seq")
    p = pending.select("folder", "node", "path", F.lit(True).alias("__p"), F.col("announced_seq_of").alias("__s"), F.col("announced_hash").alias("__h"))
    e = entries.join(p, ["folder", "node", "path"], "left")
    seq, hash_ = F.when(F.col("__p"), F.col("__s")).otherwise(F.col("seq")), F.when(F.col("__p"), F.col("__h")).otherwise(F.col("hash"))
    shown = e.select("folder", "node", "path", seq.alias("seq"), hash_.alias("hash")).where("seq is not null")
    known = shown.join(last, ["folder", "node"]).where("seq <= announced_seq").drop("announced_seq")
    peers = acks.groupBy("folder", "node", "peer").agg(F.coalesce(F.max("ack"), F.lit(0)).alias("ack"))
    if members is not None:
        m = members.select("folder", "node").distinct()
        pairs = m.join(m.select("folder", F.col("node").alias("peer")), "folder").where("node <> peer")
        peers = pairs.join(peers, ["folder", "node", "peer"], "full_outer").fillna(0, ["ack"])
    return known.join(peers, ["folder", "node"]).where("seq > ack").select("folder", "node", "peer", "path", "seq", "hash")


def replace_ack(reports: DataFrame, announced: DataFrame) -> DataFrame:
    """The latest report of each peer, lower or not; ``resend`` where it is below what was announced (0 for a folder that never was)."""
    last = reports.groupBy("folder", "node", "peer").agg(F.max(F.struct("arrival", "watermark")).alias("z"))
    j = last.join(announced.select("folder", "node", "announced_seq"), ["folder", "node"], "left")
    return j.select("folder", "node", "peer", F.col("z.watermark").alias("ack"), (F.col("z.watermark") < F.coalesce("announced_seq", F.lit(0))).alias("resend"))


def contiguous_watermark(ranges: DataFrame, keys: tuple[str, ...] = ("folder", "node", "peer")) -> DataFrame:
    """``keys, watermark, has_gap`` of received ranges ``(seq_low, seq_high]``, merged from 0; ranges above a gap wait."""
    w = Window.partitionBy(*keys).orderBy("seq_low", "seq_high")
    before = F.coalesce(F.max("seq_high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.when(F.col("seq_low") > F.greatest(before, F.lit(0)), 1).otherwise(0)
    gaps = F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = ranges.select(*keys, "seq_low", "seq_high").withColumn("__gap", gap).withColumn("__gaps", gaps)
    reached = F.coalesce(F.max(F.when(F.col("__gaps") == 0, F.col("seq_high"))), F.lit(0))
    return r.groupBy(*keys).agg(F.greatest(reached, F.lit(0)).alias("watermark"), (F.max("__gaps") > 0).alias("has_gap"))


def dedupe_batch(entries: DataFrame, batch: str = "batch") -> DataFrame:
    """The last entry of each path of a batch, with ``repeats``, how many came before it."""
    fields = [c for c in entries.columns if c not in (batch, "path", "position")]
    g = entries.groupBy(batch, "path").agg(F.max_by(F.struct("position", *fields), "position").alias("z"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return g.select(batch, "path", "z.*", "repeats")


def mark_announced(entries: DataFrame) -> DataFrame:
    """The state after announcing everything: ``folder, node, announced_seq, announced_tracked``."""
    tracked = F.count_if(~F.col("deleted") & (F.col("kind") != "dir"))
    return entries.groupBy("folder", "node").agg(F.max("seq").alias("announced_seq"), tracked.alias("announced_tracked"))
