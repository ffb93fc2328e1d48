"""The streaming operators as queries: derived tables as files, run until all are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..schema import ENTRIES, ENTRY
from ..sources import inventory, tables
from ..sources.shared import shared_dir
from ..streaming import events
from ..streaming.run import brake_stream, drain, gate_state, read_stream, schema_of, staged
from .fixtures import fixture
from .queries import _CLASS, _DOES, _EVAL, _RS, _WINDOWS, C, _replicas, _sessions, query

_BOTH = _CLASS.replace("a.node = 'n1'", "a.node IN ('n1', 'n2') AND a.k % 2 = 0")
_TRACKED = ", tr AS (SELECT folder, count(*) FILTER (NOT deleted AND kind <> 'dir') AS tracked FROM fx_replicas WHERE node = 'n0' GROUP BY folder)"
_TRIPS = "(mods + dels >= 50 AND tracked > 0 AND (mods + dels) * 100 >= 25 * tracked) OR bytes > 21474836480"
_AT = "{x}.folder = {y}.folder AND {x}.path = {y}.path"
_REACHES = " AND ".join("{x}.c_%s >= {y}.c_%s" % (n, n) for n in C)
_OVER = f"{_AT} AND {_REACHES}"


def _gate(frozen: str) -> str:
    """What the gate makes of ``b1`` (n1's entries) and then of ``b2`` (n2's): s1, y2 (with wanted, joins), k2, h1, h2."""
    return (
        _BOTH + _DOES + _TRACKED + f", f AS (SELECT *, decision <> 'ignore' AND {frozen} AS frozen FROM q), k1 AS (SELECT *, does AND NOT frozen AS counts FROM f WHERE node = 'n1'),"
        f" one AS (SELECT * FROM (SELECT folder, 'b1' AS batch, {_RS.replace('does', 'counts')}, CAST(0 AS BIGINT) AS joined FROM k1 GROUP BY folder) a JOIN tr USING (folder)), h1 AS (SELECT folder FROM one WHERE {_TRIPS}),"
        " s1 AS (SELECT k1.*, CASE WHEN h1.folder IS NULL THEN 'want' ELSE 'held' END AS part FROM k1 LEFT JOIN h1 ON h1.folder = k1.folder WHERE decision <> 'ignore' AND NOT frozen),"
        f" y2 AS (SELECT y.*, y.decision <> 'ignore' AND w.path IS NOT NULL AS wanted, y.decision <> 'ignore' AND w.path IS NULL AND x.path IS NOT NULL AS joins FROM f y LEFT JOIN s1 w ON w.part = 'want' AND {_OVER.format(x='w', y='y')} LEFT JOIN s1 x ON x.part = 'held' AND {_OVER.format(x='y', y='x')} WHERE y.node = 'n2'),"
        f" two AS (SELECT * FROM (SELECT folder, 'b2' AS batch, {_RS.replace('does', 'does AND NOT joins AND NOT wanted AND NOT frozen')}, count(*) FILTER (joins) AS joined FROM y2 GROUP BY folder) a JOIN tr USING (folder)),"
        f" h2 AS (SELECT folder FROM two WHERE {_TRIPS}), k2 AS (SELECT * FROM y2 WHERE decision <> 'ignore' AND NOT wanted AND NOT joins AND NOT frozen)"
    )


_BRAKE = _gate("FALSE") + f", s0 AS (SELECT * FROM one UNION ALL SELECT * FROM two), s1b AS ({_EVAL.replace('s1)', 's1b)')} SELECT folder, batch, adds, mods, dels, bytes, tracked, joined, held, reason FROM s"
_GATE_STATE = _gate("folder = 'f1' AND k % 10 = 8") + """
SELECT part, folder, 'b1' AS batch, path, CAST(1 AS BIGINT) AS ordinal FROM s1
UNION ALL SELECT 'deferred', folder, 'b1', path, 1 FROM f WHERE node = 'n1' AND frozen
UNION ALL SELECT 'held', folder, 'b1', path, 2 FROM y2 WHERE joins
UNION ALL SELECT 'deferred', folder, 'b2', path, 2 FROM y2 WHERE NOT wanted AND NOT joins AND frozen
UNION ALL SELECT CASE WHEN h2.folder IS NULL THEN 'want' ELSE 'held' END, k2.folder, 'b2', path, 2 FROM k2 LEFT JOIN h2 ON h2.folder = k2.folder
UNION ALL SELECT 'held', folder, 'b1', path, 3 FROM s1 WHERE part = 'held'
UNION ALL SELECT 'deferred', folder, 'b3', path, 3 FROM f WHERE node = 'n1' AND frozen"""


@query("stream_stale_filter", ", s AS (SELECT *, max(at_us) FILTER (size % 4 <> 0) OVER o AS seen, max(at_us) FILTER (size % 4 = 0) OVER o AS report FROM fx_changes WINDOW o AS (PARTITION BY folder, path ORDER BY (arrival * 7919) % 10007, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT folder, path, at_us AS at_ns, coalesce(at_us < seen, FALSE) OR coalesce(at_us < report, FALSE) OR (size % 2 = 0 AND coalesce(at_us < report + 50000000, FALSE)) AS stale FROM s WHERE size % 4 <> 0")
def _(spark, sf):
    c = fixture(spark, sf, "changes").withColumn("at_ns", F.col("at_us")).withColumn("written_ns", F.when(F.col("size") % 4 == 0, F.col("at_us") + 50_000_000))
    kind = F.when(F.col("size") % 4 == 0, "report").when(F.col("size") % 2 == 0, "unchanged").otherwise("observed")
    c = c.withColumn("arrival", (F.col("arrival") * 7919) % 10007 * 100_000_000 + F.col("arrival")).withColumn("state", kind)
    stream = read_stream(spark, c.select("folder", "path", "state", "at_ns", "written_ns", "arrival"))
    return drain(events.stale_filter_stream(stream)).select("folder", "path", "at_ns", "stale")


#: A stream gives what the watermark has passed; it is kept in whole milliseconds.
_MARK = "(SELECT max(at_us) // 1000 - {late_ms} FROM fx_changes) * 1000"


@query("stream_batch_windows", _WINDOWS + f" SELECT * FROM closed WHERE due_us <= {_MARK.format(late_ms=10_000)}")
def _(spark, sf):
    c = fixture(spark, sf, "changes").select("folder", "node", F.timestamp_micros("at_us").alias("ts"), "at_us")
    return drain(events.batch_window_stream(read_stream(spark, c)))


@query("stream_debounce", _sessions("folder, path", 2000000, "kind <> 'open'") + f", g AS (SELECT folder, path, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS n FROM s GROUP BY folder, path, session) SELECT * FROM g WHERE last_us + 1999999 <= {_MARK.format(late_ms=60_000)}")
def _(spark, sf):
    c = fixture(spark, sf, "changes").select("folder", "path", "kind", F.timestamp_micros("at_us").alias("ts"))
    d = drain(events.debounce_paths(read_stream(spark, c)))
    return d.select("folder", "path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


def _offered(df):
    """Of rows that are offered to the gate only what it reads."""
    return df.select("folder", "batch", "ordinal", "position", *ENTRY.fieldNames())


@query("stream_brake", _BRAKE)
def _(spark, sf):
    r = _replicas(spark, sf)
    a, b = r.where("node <> 'n0' and k % 2 = 0"), r.where("node = 'n0'")
    a = a.withColumn("ordinal", F.when(F.col("node") == "n1", 1).otherwise(2)).withColumn("batch", F.concat(F.lit("b"), "ordinal")).withColumn("position", F.col("k"))
    out = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    brake_stream(read_stream(spark, _offered(a)), b, out, b.limit(0), b.limit(0), b.limit(0))
    return gate_state(spark, out, "verdict").select("folder", "batch", "adds", "mods", "dels", "bytes", "tracked", "joined", "held", "reason")


@query("stream_gate_state", _GATE_STATE)
def _(spark, sf):
    """The same entries offered a third time: what was accepted is wanted already, what is held joins, what is frozen waits."""
    r = _replicas(spark, sf)
    own = r.where("node = 'n0'")
    at = lambda node, n: r.where((F.col("node") == node) & (F.col("k") % 2 == 0)).withColumns({"ordinal": F.lit(n), "batch": F.lit(f"b{n}"), "position": F.col("k")})
    out = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    pending, paused = r.where("folder = 'f1' and k % 10 = 8").select("folder", "path"), r.where("folder = 'f1'").select("folder")
    offered = _offered(at("n1", 1).unionByName(at("n2", 2)))
    files = staged(offered)
    read = lambda: events.observation_stream(spark, files, schema_of(offered))
    third = read().where("ordinal = 1").withColumns({"ordinal": F.lit(3), "batch": F.lit("b3")})
    brake_stream(read().unionByName(third), own, out, own.limit(0), pending, paused)
    parts = [gate_state(spark, out, p).select(F.lit(p).alias("part"), "folder", "batch", "path", "ordinal") for p in ("held", "want", "deferred")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_upsert", "SELECT folder, path, CASE WHEN k % 5 = 1 THEN 'new' ELSE hash END AS hash FROM fx_files WHERE k % 5 <> 0")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("folder", "path", "hash", "k")
    base = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    add = f.select("folder", "path", "hash", F.lit(False).alias("removed"), F.lit(1).alias("at"))
    inventory.write_changes(add, base, -1)
    late = f.where("k % 5 < 2").select("folder", "path", F.lit("new").alias("hash"), (F.col("k") % 5 == 0).alias("removed"), F.lit(2).alias("at"))
    q = read_stream(spark, late).writeStream.foreachBatch(lambda df, n: inventory.write_changes(df, base, n)).option("checkpointLocation", f"{base}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    inventory.compact(spark, base, f"{base}-compact", schema_of(add), ["folder", "path"])
    return inventory.read_state(spark, f"{base}-compact", schema_of(add), ["folder", "path"])


@query("load_table", "SELECT folder, path, hash, seq, NOT k % 7 = 3 AND NOT deleted AND k % 5 <> 1 AS sound FROM (SELECT *, CASE WHEN k % 7 = 3 THEN -1 ELSE k END AS seq FROM fx_files) f")
def _(spark, sf):
    f = fixture(spark, sf, "files").withColumns({"seq": F.when(F.col("k") % 7 == 3, -1).otherwise(F.col("k")), "size": F.col("size") + 1})
    f = f.withColumn("kind", F.when(F.col("k") % 5 == 1, "socket").otherwise(F.col("kind")))
    table = inventory.load_table(spark, staged(f), ENTRIES)
    good, bad = inventory.split_valid(table)
    both = good.withColumn("sound", F.lit(True)).unionByName(bad.withColumn("sound", F.lit(False)))
    return both.select("folder", "path", "hash", "seq", "sound")


_RAW = """, rb AS (
  SELECT batch AS record, batch, folder, source, CASE WHEN batch_no % 5 = 0 THEN 'lost' ELSE 'sent' END AS role, min(k) AS created_at, CASE WHEN batch_no % 7 = 3 THEN max(seq) + 1 ELSE min(seq) - 1 END AS seq_low, max(seq) AS seq_high,
         count(*) AS adds, CAST(0 AS BIGINT) AS mods, CAST(0 AS BIGINT) AS dels, CAST(1 AS BIGINT) AS bytes, CASE batch_no % 3 WHEN 0 THEN 'held' WHEN 1 THEN 'accepted' END AS decision, CASE WHEN batch_no % 3 = 0 AND batch_no % 4 <> 0 THEN 'many' END AS held_reason, max(k) AS recorded_at, batch_no AS b
  FROM fx_batch_entries GROUP BY batch, folder, source, batch_no),
rr AS (
  SELECT folder, node, peer, CASE WHEN seq_low % 4 = 2 THEN -1 - seq_low ELSE seq_low END AS seq_low, CASE WHEN seq_low % 3 = 0 THEN seq_low ELSE seq_high END AS seq_high, seq_low AS was FROM fx_ranges),
rt AS (
  SELECT folder, CASE WHEN arrival % 9 = 5 THEN 'same/' || CAST(arrival % 70 AS STRING) ELSE trashed_path END AS trashed_path, CASE WHEN arrival % 4 = 0 THEN 'a//b' ELSE original_path END AS original_path, CASE WHEN arrival % 6 = 1 THEN upper(hash) ELSE hash END AS hash, trashed_at_ns, CASE WHEN arrival % 10 = 3 THEN NULL ELSE size END AS size, arrival AS k FROM fx_trash),
rp AS (
  SELECT folder, node, path, CASE WHEN k % 3 = 0 THEN k END AS announced_seq, CASE WHEN k % 3 = 0 AND k % 5 <> 0 THEN hash END AS announced_hash, CASE WHEN k % 8 = 3 THEN NULL ELSE exempt END AS exempt, k FROM fx_batch_entries)"""
_FAULTS = _RAW + """,
told AS (
  SELECT 'batches' AS name, record AS id, CASE WHEN b % 5 = 0 THEN 'role: not sent|received|paused' WHEN b % 7 = 3 THEN 'an empty range' WHEN b % 12 = 0 THEN 'a decision and reason that do not fit' END AS fault FROM rb
  UNION ALL SELECT 'received_ranges', concat_ws('|', folder, node, peer, seq_low, seq_high), CASE WHEN was % 4 = 2 THEN 'seq_low: not count' WHEN was % 3 = 0 THEN 'an empty range' END FROM rr
  UNION ALL SELECT 'trash', concat_ws('|', folder, trashed_path), CASE WHEN k % 4 = 0 THEN 'original_path: not path' WHEN k % 6 = 1 AND lower(hash) <> hash THEN 'hash: not hash' WHEN k % 10 = 3 THEN 'size: null' END FROM rt
  UNION ALL SELECT 'pending', concat_ws('|', folder, node, path), CASE WHEN k % 8 = 3 THEN 'exempt: null' WHEN k % 15 = 0 THEN 'a half announced record' END FROM rp)
SELECT name, id, CASE WHEN fault IS NULL AND count(*) FILTER (fault IS NULL) OVER (PARTITION BY name, id) > 1 THEN 'a repeated key' ELSE fault END AS fault FROM told"""


@query("state_tables", _FAULTS)
def _(spark, sf):
    """State tables with corrupt rows, loaded by their rules: every row is there, with what is wrong with it."""
    for f in ("batch_entries", "ranges", "trash"):
        fixture(spark, sf, f).createOrReplaceTempView(f"fx_{f}")
    out = None
    for part, name in (("rb", "batches"), ("rr", "received_ranges"), ("rt", "trash"), ("rp", "pending")):
        raw = spark.sql(f"WITH {_RAW.lstrip(', ')} SELECT * FROM {part}")
        sound, corrupt = tables.load_state(spark, staged(raw), name)
        rows = sound.withColumn("fault", F.lit(None).cast("string")).unionByName(corrupt)
        rows = rows.select(F.lit(name).alias("name"), F.concat_ws("|", *tables.TABLES[name].key).alias("id"), "fault")
        out = rows if out is None else out.unionByName(rows)
    return out
