"""Watcher events, change windows, staleness and liveness as streams.

Lateness is judged for each path against what was last reported of it, never by a global watermark;
a watermark here only lets state go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..schema import CAP_S, LIVENESS_S, QUIET_S

#: Event kinds that say nothing about content.
READ_ONLY = ("open", "close", "read")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long staleness of a path is remembered.
KEEP_S = 30 * 86_400


def observation_stream(spark: SparkSession, directory: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive as Parquet files."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.parquet(directory)


def debounce_paths(events: DataFrame, gap_s: int = QUIET_S, late: str = "1 minute") -> DataFrame:
    """``folder, path, first_ts, last_ts, n``: a path is released after ``gap_s`` seconds without an event that names it.

    Spark joins events that are exactly the gap apart; an event at that moment is a new one here, so
    the gap is a microsecond less. Works on static tables and streams.
    """
    named = events.where(~F.col("kind").isin(*READ_ONLY))
    named = named.withWatermark("ts", late) if events.isStreaming else named
    w = F.session_window("ts", f"{gap_s * 1_000_000 - 1} microseconds")
    g = named.groupBy("folder", "path", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return g.select("folder", "path", F.col("w.start").alias("first_ts"), "last_ts", "n")


class _Windows(StatefulProcessor):
    """Windows of one folder and node: how many changes each moment had that no window which has gone out holds, and a timer for the first that is due."""

    def __init__(self, quiet: int, cap: int) -> None:
        self.quiet, self.cap = quiet, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.moments = handle, handle.getMapState("moments", "at_us long", "n long")

    def _folded(self) -> list[tuple[int, int, int, list[int]]]:
        """``opened, due, n`` and the moments of each window, in order."""
        out, first, last, n, held = [], None, 0, 0, []
        for at, count in sorted((k[0], v[0]) for k, v in self.moments.iterator()):
            if first is not None and at >= min(first + self.cap, last + self.quiet):
                out.append((first, min(first + self.cap, last + self.quiet), n, held))
                first, n, held = None, 0, []
            first = at if first is None else first
            last, n = at, n + count
            held.append(at)
        return out if first is None else [*out, (first, min(first + self.cap, last + self.quiet), n, held)]

    def _wait(self, due: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            for at, n in frame["at_us"].value_counts().items():
                had = self.moments.getValue((int(at),)) if self.moments.containsKey((int(at),)) else (0,)
                self.moments.updateValue((int(at),), (int(had[0]) + int(n),))
        yield from self._due(key, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._due(key, timerValues)

    def _due(self, key, timer_values: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        mark, rows, due = timer_values.getCurrentWatermarkInMs() * 1000, [], None
        for opened, until, n, held in self._folded():
            if until > mark:
                due = until
                break
            rows.append((key[0], key[1], opened, until, n))
            for at in held:
                self.moments.removeKey((at,))
        self._wait(due)
        if rows:
            yield pd.DataFrame(rows, columns=["folder", "node", "opened_us", "due_us", "n"])

    def close(self) -> None:
        pass


def batch_window_stream(changes: DataFrame, quiet_s: int = QUIET_S, cap_s: int = CAP_S, late: str = "10 seconds") -> DataFrame:
    """R2: the windows of ``batch_windows`` live, over ``folder, node, ts, at_us``: 2 s quiet or 10 s after the first.

    A window goes out once the watermark has passed its end, so that late changes within the watermark
    still join it. State is a count for each moment that the watermark has not passed, however many
    changes a moment has, and an event-time timer for the window that is due first. The state store
    must be RocksDB's, which keeps map states and timers; it is set in the session here.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = "folder string, node string, opened_us long, due_us long, n long"
    grouped = changes.withWatermark("ts", late).select("folder", "node", "ts", "at_us").groupBy("folder", "node")
    return grouped.transformWithStateInPandas(_Windows(quiet_s * 1_000_000, cap_s * 1_000_000), out, "append", "EventTime")


def stale_filter_stream(observations: DataFrame, keep_s: int = KEEP_S) -> DataFrame:
    """C4 live: ``folder, path, state, at_ns, stale``.

    Rows of ``state`` report are commit reports; they only move the marks: ``at_ns``, and
    ``written_ns``, when the record was last written, before which ``unchanged`` says nothing. Rows of
    a micro-batch are taken in the order of ``arrival``; state is three numbers a path, and goes once
    the newest times of all are ``keep_s`` seconds beyond the path's: rows older than that are dropped.
    """
    out = "folder string, path string, state string, at_ns long, stale boolean"
    none = -(1 << 62)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, report, written = state.get if state.exists else (none, none, none)
        rows, frame = [], pd.concat(list(frames)).sort_values("arrival")
        for at, kind, wrote in frame[["at_ns", "state", "written_ns"]].itertuples(index=False):
            if kind == "report":
                report, written = max(report, at), written if pd.isna(wrote) else max(written, int(wrote))
                continue
            stale = at < seen or at < report or (kind == "unchanged" and at < written)
            seen = max(seen, at)
            rows.append((key[0], key[1], kind, at, stale))
        state.update((int(seen), int(report), int(written)))
        state.setTimeoutTimestamp(max(int(max(seen, report)) // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=["folder", "path", "state", "at_ns", "stale"])

    timed = observations.withColumn("ts", F.timestamp_micros(F.floor(F.col("at_ns") / 1000).cast("long"))).withWatermark("ts", f"{keep_s} seconds")
    grouped = timed.groupBy("folder", "path")
    return grouped.applyInPandasWithState(step, out, "seen long, report long, written long", "append", GroupStateTimeout.EventTimeTimeout)


def rescan_requests(events: DataFrame) -> DataFrame:
    """``folder, path`` to look at again after lost events; a whole-folder request (empty path) stands for all of its subtrees."""
    lost = events.where("kind = 'lost'").select("folder", F.coalesce("path", F.lit("")).alias("path")).distinct()
    whole = lost.where("path = ''").select("folder")
    return lost.where("path <> ''").join(whole, "folder", "left_anti").unionByName(lost.where("path = ''"))


def peer_liveness(heartbeats: DataFrame, silent_s: int = LIVENESS_S, late: str = "1 minute") -> DataFrame:
    """``node, up_from, up_to, beats``: stretches in which a peer was never silent for ``silent_s`` seconds."""
    beats = heartbeats.withWatermark("ts", late) if heartbeats.isStreaming else heartbeats
    w = F.session_window("ts", f"{silent_s * 1_000_000 - 1} microseconds")
    g = beats.groupBy("node", w.alias("w")).agg(F.count(F.lit(1)).alias("beats"), F.max("ts").alias("up_to"))
    return g.select("node", F.col("w.start").alias("up_from"), "up_to", "beats")


def in_arrival_order(each: Callable[[DataFrame, int], None], ordinal: str = "ordinal") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives ``each`` the batches of a micro-batch one ordinal at a time.

    Batches of a folder see earlier holds; folders are independent. So the loop runs over the ordinal
    of a batch within its folder, which is small, and each step works on all folders at once. The
    micro-batch is not kept, as a copy on disk would be larger than its files: each step reads it from its source again.
    """

    def run(df: DataFrame, batch_id: int) -> None:
        top = df.agg(F.max(ordinal)).first()[0]
        for n in range(1, (top or 0) + 1):
            each(df.where(F.col(ordinal) == n), batch_id)

    return run
