"""Running a stream over all that is there, and the receiver's gate on a stream of batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.entries import for_comparison
from ..operators.brake import receiver_summary, route_batch, rules_recheck
from ..schema import ENTRY
from ..sources.shared import exists, scratch, shared_dir, short_shuffles, written
from .events import in_arrival_order


def drain(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Run ``stream`` over everything available, into Parquet in the shared folder, and read the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = out or f"{base}/out"
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def staged(df: DataFrame) -> str:
    """Write a table where a stream can read it."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return path


#: What the gate remembers of a path, as rows of ``state``; ``part`` tells which table a row belongs to.
PATH_STATE = "folder string, batch string, path string, source string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.fields if f.name != "path") + ", arrival long"
#: What it says of a batch, in the same rows.
VERDICT = "adds long, mods long, dels long, bytes long, tracked long, joined long, frozen long, already_wanted long, held boolean, reason string"


def gate_state(spark: SparkSession, out: str, part: str, before: tuple[int, int] | None = None) -> DataFrame:
    """A table of :func:`brake_stream`'s state: ``verdict``, ``held``, ``want``, ``deferred`` or ``released``, with ``micro_batch, ordinal``.

    ``before``: only what was written ahead of that micro-batch and ordinal.
    """
    columns = PATH_STATE if part != "verdict" else f"folder string, batch string, {VERDICT}"
    schema = T.StructType.fromDDL(f"{columns}, micro_batch long, ordinal long, part string")
    if not exists(spark, f"{out}/state"):
        return spark.createDataFrame([], schema).drop("part").limit(0)  # the limit tells the planner that there is nothing to join
    rows = spark.read.schema(schema).option("basePath", f"{out}/state").parquet(f"{out}/state").where(F.col("part") == part).drop("part")
    if before is None:
        return rows
    batch_id, ordinal = before
    return rows.where((F.col("micro_batch") < batch_id) | ((F.col("micro_batch") == batch_id) & (F.col("ordinal") < ordinal)))


def waiting(spark: SparkSession, out: str, before: tuple[int, int] | None = None) -> DataFrame:
    """Frozen entries that were not let go since, of each path and source the last to arrive."""
    at = F.struct("micro_batch", "ordinal")
    keys = ["folder", "path"]
    go = gate_state(spark, out, "released", before).groupBy(*keys).agg(F.max(at).alias("went"))
    left = gate_state(spark, out, "deferred", before).withColumn("came", at).join(go, keys, "left").where(F.col("went").isNull() | (F.col("came") > F.col("went")))
    rest = [c for c in left.columns if c not in (*keys, "source", "came", "went")]
    return left.groupBy(*keys, "source").agg(F.max_by(F.struct(*rest), F.struct("came", "batch")).alias("z")).select(*keys, "source", "z.*")


def brake_stream(incoming: DataFrame, entries: DataFrame, out: str, wants: DataFrame, pending: DataFrame, paused: DataFrame, rules: DataFrame | None = None) -> None:
    """The receiver's gate per micro-batch; batches of a folder strictly by ``ordinal`` (from 1).

    ``incoming`` has ``folder, batch, ordinal, path, position`` and the entry, and may have ``source``. What
    becomes of each path is :func:`..operators.brake.route_batch`'s to say; it sees what earlier batches
    left: versions accepted (a version accepted once is already wanted when it is offered again),
    versions in quarantine, and frozen entries of paused folders. Before anything else a micro-batch
    lets go what waits in folders that are paused no longer: batch by batch it is routed and judged
    like one that has just come, and joins its own batch if that is held. A folder of which
    nothing is known has 0 tracked files; one without ``rules`` (``folder, hold_count, hold_pct,
    hold_size``) the default ones.

    Below ``out``, ``state`` has for each micro-batch and ordinal (0 for what was let go) the verdicts and
    what was held, wanted, deferred and released, written by one job, so all or none of it is there; a
    micro-batch that runs again writes the same in their place. Read it with :func:`gate_state`.
    ``entries``, and the ``wants`` from before, stand still during a run. A micro-batch is read from its
    source again for each ordinal; shuffle files last as long as the job that needs them, and what an ordinal writes
    besides the state goes with it.
    """
    spark = incoming.sparkSession
    tracked = entries.groupBy("folder").agg(F.count_if(~F.col("deleted") & (F.col("kind") != "dir")).alias("tracked"))
    limits = (rules if rules is not None else spark.createDataFrame([], "folder string, hold_count long, hold_pct long, hold_size long"))

    def judge(df: DataFrame, batch_id: int, ordinal: int) -> None:
        now = (batch_id, ordinal)
        df = df if "source" in df.columns else df.withColumn("source", F.lit(None).cast("string"))
        df = df.select("folder", "batch", "path", "source", "position", *[f.name for f in ENTRY.fields if f.name != "path"])
        here = F.broadcast(df.select("folder").distinct())  # a row a folder
        held = gate_state(spark, out, "held", now).join(here, "folder", "left_semi")
        wanted = gate_state(spark, out, "want", now).join(here, "folder", "left_semi").select("folder", "path", "version")
        known = wants.where(~F.coalesce("to_trash", F.lit(False))) if "to_trash" in wants.columns else wants
        routed = route_batch(df, for_comparison(entries), held, known.select("folder", "path", "version").unionByName(wanted), pending, paused)
        if ordinal == 0:  # what was let go joins its own batch if that is held
            own = held.select("folder", "batch").distinct().withColumn("__own", F.lit(True))
            joins = F.col("__own") & F.col("route").isin("kept")
            routed = routed.join(own, ["folder", "batch"], "left").withColumn("held_batch", F.when(joins, F.col("batch")).otherwise(F.col("held_batch")))
            routed = routed.withColumn("route", F.when(joins, "joined").otherwise(F.col("route"))).drop("__own")
        shown = F.col("route") != "ignored"  # of what is ignored only the batch is needed
        kept = {c: F.when(shown, F.col(c)) for c in ("path", "source", *[f"in_{f.name}" for f in ENTRY.fields if f.name != "path"])}
        routed = routed.withColumns(kept).select("folder", "batch", *kept, "own_deleted", "own_kind", "decision", "mode", "route", "held_batch")
        routed = written(routed, "gate-routed", "zstd")
        count = lambda r: F.count_if(F.col("route") == r)
        summary = receiver_summary(routed.withColumn("mode", F.when(F.col("route") == "kept", F.col("mode"))), ["folder", "batch"])
        routes = routed.groupBy("folder", "batch").agg(count("joined").alias("joined"), count("frozen").alias("frozen"), count("already wanted").alias("already_wanted"))
        facts = summary.join(tracked, "folder", "left").fillna(0, ["tracked"]).join(routes, ["folder", "batch"])
        verdicts = written(rules_recheck(facts, limits).drop("would_pass", "hold_count", "hold_pct", "hold_size"), "gate-verdicts")

        part = (
            F.when(F.col("route") == "joined", "held")
            .when(F.col("route") == "frozen", "deferred")
            .when(F.col("route") == "kept", F.when(F.col("__held"), "held").otherwise("want"))
        )
        entry = [F.col(f"in_{f.name}").alias(f.name) for f in ENTRY.fields if f.name != "path"]
        to = F.when(F.col("route") == "joined", F.col("held_batch")).otherwise(F.col("batch")).alias("batch")
        arrival = F.lit(batch_id * 2**32 + ordinal).cast("long").alias("arrival")
        judged = routed.join(verdicts.select("folder", "batch", F.col("held").alias("__held")), ["folder", "batch"])
        rows = judged.withColumn("part", part).where("part is not null").select("folder", to, "path", "source", *entry, arrival, "part")
        rows = rows.unionByName(verdicts.withColumn("part", F.lit("verdict")), allowMissingColumns=True)
        if ordinal == 0:
            rows = rows.unionByName(df.select("folder", "path", F.lit("released").alias("part")).distinct(), allowMissingColumns=True)
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{out}/state/micro_batch={batch_id}/ordinal={ordinal}", compression="zstd")

    def let_go(batch_id: int) -> None:
        free = waiting(spark, out, (batch_id, 0)).join(paused.select("folder").distinct(), "folder", "left_anti").drop("micro_batch", "ordinal")
        if not free.isEmpty():
            judge(written(free.withColumn("position", F.col("arrival")), "gate-waiting"), batch_id, 0)

    def each(df: DataFrame, batch_id: int) -> None:
        first = df.select("ordinal").first()
        if first is not None:
            with scratch(spark):
                judge(df, batch_id, first[0])

    in_order = in_arrival_order(each)

    def run(df: DataFrame, batch_id: int) -> None:
        with scratch(spark), short_shuffles(*{id(s): s for s in (spark, df.sparkSession)}.values()):
            let_go(batch_id)
            in_order(df, batch_id)

    q = incoming.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def schema_of(df: DataFrame) -> T.StructType:
    """The schema with every column nullable, as files have it."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


def read_stream(spark: SparkSession, df: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """``df``, written to the shared folder, as a stream of its files."""
    from .events import observation_stream

    return observation_stream(spark, staged(df), schema_of(df), per_trigger)
