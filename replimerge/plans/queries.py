"""Every operator as a query over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries as fe
from ..functions import paths as fp
from ..functions import vectors as fv
from ..operators import audit, batches, brake, diff, ignore, merge, peers, retention, transfer
from ..sources import inventory
from ..streaming import events
from .fixtures import counters, fixture, oracle, with_version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the function below as query ``name``, with the body of its oracle over ``fx_<fixture>`` tables."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def _replicas(spark: SparkSession, sf: str) -> DataFrame:
    return with_version(fixture(spark, sf, "replicas"))


def _two(spark: SparkSession, sf: str, a: str = "n1", b: str = "n0") -> tuple[DataFrame, DataFrame]:
    r = _replicas(spark, sf)
    return r.where(F.col("node") == a), r.where(F.col("node") == b)


C = ("n0", "n1", "n2")
_MORE = " OR ".join(f"a.c_{n} > b.c_{n}" for n in C)
_LESS = " OR ".join(f"b.c_{n} > a.c_{n}" for n in C)
_REL = f"CASE WHEN ({_MORE}) AND ({_LESS}) THEN 'concurrent' WHEN ({_MORE}) THEN 'dominates' WHEN ({_LESS}) THEN 'dominated' ELSE 'equal' END"
_PAIR = ", p AS (SELECT a.*, b.folder IS NOT NULL AS known, b.kind AS b_kind, b.size AS b_size, b.mtime_ns AS b_mtime_ns, b.stamp AS b_stamp, b.exec AS b_exec, b.hash AS b_hash, b.prev_hash AS b_prev_hash, b.deleted AS b_deleted, b.modified_by AS b_modified_by, b.author_host AS b_author_host, b.c_n0 AS b0, b.c_n1 AS b1, b.c_n2 AS b2, CASE WHEN b.folder IS NULL THEN 'absent' ELSE " + _REL + " END AS relation FROM fx_replicas a LEFT JOIN fx_replicas b ON b.node = 'n0' AND a.folder = b.folder AND a.path = b.path WHERE a.node = 'n1')"
_SAME = "(deleted AND b_deleted) OR (NOT deleted AND NOT b_deleted AND kind = b_kind AND hash = b_hash AND exec = b_exec)"
_KEY = "row(stamp, NOT deleted, hash <> prev_hash, mtime_ns, modified_by, hash, CASE kind WHEN 'file' THEN 0 WHEN 'dir' THEN 1 ELSE 2 END, exec, size, prev_hash, author_host)"
_BKEY = "row(b_stamp, NOT b_deleted, b_hash <> b_prev_hash, b_mtime_ns, b_modified_by, b_hash, CASE b_kind WHEN 'file' THEN 0 WHEN 'dir' THEN 1 ELSE 2 END, b_exec, b_size, b_prev_hash, b_author_host)"
_CLASS = _PAIR + f""", c AS (
  SELECT *, CASE WHEN relation IN ('absent', 'dominates') THEN 'apply' WHEN relation IN ('equal', 'dominated') THEN 'ignore' WHEN {_SAME} THEN 'merge' ELSE 'conflict' END AS decision FROM p),
d AS (
  SELECT *, decision = 'conflict' AND {_KEY} >= {_BKEY} AS incoming_wins, known AND ({_SAME}) AS same FROM c),
m AS (
  SELECT *, CASE WHEN decision IN ('apply', 'merge') THEN CASE WHEN same AND kind = 'file' AND NOT deleted THEN 'metadata only' WHEN same THEN 'index only' WHEN deleted OR kind = 'dir' THEN 'direct' ELSE 'fetch' END
                 WHEN incoming_wins THEN CASE WHEN deleted OR kind = 'dir' THEN 'direct' ELSE 'fetch' END WHEN decision = 'conflict' THEN 'index only' END AS mode FROM d)"""
_MERGED = f""", z AS (
  SELECT folder, path, arg_max({{'hash': hash, 'size': size, 'deleted': deleted, 'stamp': stamp, 'modified_by': modified_by, 'kind': kind, 'mtime_ns': mtime_ns}}, {_KEY}) AS w, max(c_n0) AS c_n0, max(c_n1) AS c_n1, max(c_n2) AS c_n2, count(*) AS replicas
  FROM fx_replicas GROUP BY folder, path)"""


@query("merge_replicas", _MERGED + " SELECT folder, path, w.hash AS hash, w.size AS size, w.deleted AS deleted, w.stamp AS stamp, w.modified_by AS modified_by, w.kind AS kind, w.mtime_ns AS mtime_ns, replicas, c_n0, c_n1, c_n2 FROM z")
def _(spark, sf):
    m = merge.merge_replicas(_replicas(spark, sf))
    return m.select("folder", "path", "hash", "size", "deleted", "stamp", "modified_by", "kind", "mtime_ns", "replicas", *counters())


@query("vv_compare", _PAIR + " SELECT folder, path, relation FROM p")
def _(spark, sf):
    return merge.classify_batch(*_two(spark, sf)).select("folder", "path", "relation")


@query("vv_dominates", _PAIR + " SELECT folder, path, relation = 'dominates' AS strictly, relation IN ('dominates', 'equal') AS weakly FROM p WHERE known")
def _(spark, sf):
    j = merge.paired(*_two(spark, sf)).where("own_known")
    a, b = F.col("in_version"), F.col("own_version")
    return j.select("folder", "path", fv.vv_dominates(a, b).alias("strictly"), fv.vv_dominates_or_equals(a, b).alias("weakly"))


@query("vv_merge", _PAIR + " SELECT folder, path, greatest(c_n0, b0) AS c_n0, greatest(c_n1, b1) AS c_n1, greatest(c_n2, b2) AS c_n2 FROM p WHERE known")
def _(spark, sf):
    j = merge.paired(*_two(spark, sf)).where("own_known")
    return j.select("folder", "path", fv.vv_merge(F.col("in_version"), F.col("own_version")).alias("version")).select("folder", "path", *counters())


@query("vv_increment", "SELECT folder, path, node, c_n0 + CAST(node = 'n0' AS INTEGER) AS c_n0, c_n1 + CAST(node = 'n1' AS INTEGER) AS c_n1, c_n2 + CAST(node = 'n2' AS INTEGER) AS c_n2 FROM fx_replicas")
def _(spark, sf):
    r = _replicas(spark, sf)
    return r.select("folder", "path", "node", fv.vv_increment(F.col("version"), F.col("node")).alias("version")).select("folder", "path", "node", *counters())


@query("canonical_vv", "SELECT folder, path, node, concat_ws(',', CASE WHEN c_n0 > 0 THEN 'n0:' || c_n0 END, CASE WHEN c_n1 > 0 THEN 'n1:' || c_n1 END, CASE WHEN c_n2 > 0 THEN 'n2:' || c_n2 END) AS vv_key FROM fx_replicas")
def _(spark, sf):
    return _replicas(spark, sf).select("folder", "path", "node", fv.vv_key(F.col("version")).alias("vv_key"))


@query("frontier", f"SELECT folder, path, node FROM fx_replicas a WHERE NOT EXISTS (SELECT 1 FROM fx_replicas b WHERE b.folder = a.folder AND b.path = a.path AND ({_LESS}) AND NOT ({_MORE}))")
def _(spark, sf):
    return fv.frontier(_replicas(spark, sf), ["folder", "path"]).select("folder", "path", "node")


@query("classify_batch", _CLASS + " SELECT folder, path, relation, decision, mode, incoming_wins FROM m")
def _(spark, sf):
    return merge.classify_batch(*_two(spark, sf)).select("folder", "path", "relation", "decision", "mode", "incoming_wins")


@query("pick_winner", _PAIR + f" SELECT folder, path, {_KEY} >= {_BKEY} AS incoming_wins FROM p WHERE known")
def _(spark, sf):
    return merge.paired(*_two(spark, sf)).where("own_known").select("folder", "path", merge.pick_winner("in_", "own_").alias("incoming_wins"))


@query("merge_pair", _PAIR + f" SELECT folder, path, CASE WHEN {_KEY} >= {_BKEY} THEN hash ELSE b_hash END AS hash, CASE WHEN {_KEY} >= {_BKEY} THEN mtime_ns ELSE b_mtime_ns END AS mtime_ns, greatest(c_n0, b0) AS c_n0, greatest(c_n1, b1) AS c_n1, greatest(c_n2, b2) AS c_n2 FROM p WHERE known")
def _(spark, sf):
    p = merge.paired(*_two(spark, sf)).where("own_known")
    m = merge.merge_pair("in_", "own_")
    return p.select("folder", "path", *[m[c].alias(c) for c in ("hash", "mtime_ns", "version")]).select("folder", "path", "hash", "mtime_ns", *counters())


_STAMP = "strftime(make_timestamp(CAST(floor(b_mtime_ns / 1000000000) AS BIGINT) * 1000000), '%Y%m%d-%H%M%S')"
_COPY = f"regexp_extract(path, '^(.*/)?', 0) || regexp_extract(path, '[^/]*$', 0) || '.conflict-' || {_STAMP} || '-' || b_author_host"


@query(
    "conflict_copies",
    _CLASS
    + f""", x AS (SELECT *, {_COPY} AS copy_path FROM m WHERE decision = 'conflict' AND incoming_wins AND NOT b_deleted),
t AS (SELECT folder, path, k, {_COPY.replace('b_', '')} AS copy, mtime_ns + 5 AS s FROM fx_replicas WHERE node = 'n0' AND k % 4 < 2)
SELECT x.folder, x.path, copy_path, coalesce(t.k % 4 = 1, FALSE) AS to_trash, b_kind AS kind, b_size AS size, b_mtime_ns AS mtime_ns, b_exec AS exec, b_hash AS hash,
       CASE WHEN s IS NULL THEN CASE b_kind WHEN 'file' THEN b_mtime_ns ELSE 1 END WHEN b_kind = 'file' THEN greatest(b_mtime_ns, s + 1) ELSE s + 1 END AS stamp,
       CASE WHEN s IS NULL THEN repeat('0', 64) ELSE 'h' END AS prev_hash, CASE WHEN s IS NULL THEN 1 ELSE 4 END AS c_n0, FALSE AS deleted, 'n0' AS modified_by, 'me' AS author_host
FROM x LEFT JOIN t ON t.folder = x.folder AND t.copy = x.copy_path""",
)
def _(spark, sf):
    a, b = _two(spark, sf)
    name = fp.conflict_copy_name(F.col("path"), F.col("kind"), F.col("mtime_ns"), F.col("author_host"), F.col("modified_by"))
    three = F.create_map(F.lit("n0"), F.lit(3).cast("long"))
    there = b.where("k % 4 < 2").withColumns({"path": name, "stamp": F.col("mtime_ns") + 5, "version": three, "hash": F.lit("h"), "deleted": F.col("k") % 4 == 0})
    copies = merge.conflict_copies(merge.classify_batch(a, b), b.unionByName(there), "n0", "me")
    return copies.select("folder", "path", "copy_path", "to_trash", *merge.FIELDS, counters()[0])


@query("conflict_copy_name", f"SELECT path, node, regexp_replace(path, '\\.txt$', '') || '.conflict-' || {_STAMP.replace('b_mtime_ns', 'mtime_ns')} || '-' || node || '.txt' AS copy FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files")
    return f.select("path", "node", fp.conflict_copy_name(F.col("path"), F.col("kind"), F.col("mtime_ns"), F.lit(""), F.col("node")).alias("copy"))


_ADOPT = _PAIR + ", s AS (SELECT folder, max(k) AS top FROM fx_replicas WHERE node = 'n0' GROUP BY folder), t AS (SELECT p.*, relation IN ('absent', 'dominates', 'equal') AS ok FROM p), n AS (SELECT t.*, coalesce(top, 0) + row_number() OVER (PARTITION BY t.folder ORDER BY path) AS seq FROM t LEFT JOIN s USING (folder) WHERE ok)"


@query(
    "adopt",
    _ADOPT
    + " SELECT 'entry' AS part, folder, path, hash, kind, seq, c_n0, c_n1, c_n2 FROM n UNION ALL SELECT 'entry', folder, path, hash, kind, k, c_n0, c_n1, c_n2 FROM fx_replicas r WHERE node = 'n0' AND NOT EXISTS (SELECT 1 FROM n WHERE n.folder = r.folder AND n.path = r.path)"
    " UNION ALL SELECT 'pending', folder, path, NULL, NULL, NULL, NULL, NULL, NULL FROM fx_replicas r WHERE node = 'n0' AND k % 9 = 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.folder = r.folder AND n.path = r.path)"
    " UNION ALL SELECT 'refused', folder, path, hash, kind, NULL, c_n0, c_n1, c_n2 FROM t WHERE NOT ok",
)
def _(spark, sf):
    a, b = _two(spark, sf)
    own = b.select("folder", "node", "path", *merge.FIELDS, "version", F.col("k").alias("seq"))
    after, pending, refused = merge.adopt(own, a.withColumn("node", F.lit("n0")), b.where("k % 9 = 0").select("folder", "node", "path"))
    none = F.lit(None)
    part = lambda df, name, seq: df.select(F.lit(name).alias("part"), "folder", "path", "hash", "kind", seq.cast("long").alias("seq"), *counters())
    left = pending.select(F.lit("pending").alias("part"), "folder", "path", none.cast("string").alias("hash"), none.cast("string").alias("kind"), none.cast("long").alias("seq"), *[none.cast("long").alias(f"c_{n}") for n in C])
    return part(after, "entry", F.col("seq")).unionByName(left).unionByName(part(refused, "refused", none))


_CASES = ", every AS (SELECT folder, path FROM fx_files WHERE NOT deleted UNION SELECT folder, CASE WHEN k % 20 = 0 THEN upper(path) ELSE path END FROM fx_files WHERE k % 10 = 0 AND NOT deleted UNION SELECT folder, split_part(path, '/', 1) FROM fx_files WHERE NOT deleted UNION SELECT folder, upper(split_part(path, '/', 1)) FROM fx_files WHERE k % 20 = 0 AND NOT deleted)"


@query("case_collisions", _CASES + " SELECT folder, lower(path) AS folded, count(DISTINCT path) AS n, min(path) AS first, max(path) AS last FROM every GROUP BY ALL HAVING count(DISTINCT path) > 1")
def _(spark, sf):
    f = fixture(spark, sf, "files")
    copies = f.where("k % 10 = 0").withColumn("path", F.when(F.col("k") % 20 == 0, F.upper("path")).otherwise(F.col("path")))
    return merge.case_collisions(f.unionByName(copies))


@query("winner_fallbacks", _CLASS.replace("FROM fx_replicas a LEFT JOIN fx_replicas b", "FROM late a LEFT JOIN late b").replace(", p AS", ", late AS (SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN 'nx' ELSE modified_by END AS modified_by, CASE WHEN k % 4 = 0 THEN k ELSE mtime_ns END AS mtime_ns, CASE WHEN k % 4 = 0 THEN k ELSE stamp END AS stamp) FROM fx_replicas), p AS", 1) + " SELECT folder, path FROM m WHERE decision = 'conflict' AND stamp = b_stamp AND deleted = b_deleted AND (hash <> prev_hash) = (b_hash <> b_prev_hash) AND mtime_ns = b_mtime_ns AND modified_by = b_modified_by")
def _(spark, sf):
    late = F.col("k") % 4 == 0
    a, b = (x.withColumns({"modified_by": F.when(late, "nx").otherwise(F.col("modified_by")), "mtime_ns": F.when(late, F.col("k")).otherwise(F.col("mtime_ns")), "stamp": F.when(late, F.col("k")).otherwise(F.col("stamp"))}) for x in _two(spark, sf))
    return merge.winner_fallbacks(merge.classify_batch(a, b)).select("folder", "path")


# --- change detection -------------------------------------------------------------------------

_COVER = "o.folder = e.folder AND (o.path = e.path OR starts_with(e.path, o.path || '/'))"
_DIFF = f""", obs AS (
  SELECT * REPLACE (CASE kind WHEN 'dir' THEN 0 ELSE size END AS size, CASE kind WHEN 'dir' THEN repeat('0', 64) ELSE hash END AS hash, kind = 'file' AND exec AS exec, CASE kind WHEN 'file' THEN mtime_ns ELSE 0 END AS mtime_ns) FROM fx_parts_scan), e AS (
  SELECT *, EXISTS (SELECT 1 FROM obs o WHERE o.state = 'skipped' AND {_COVER}) AS covered FROM fx_parts_index e),
j AS (
  SELECT coalesce(e.folder, o.folder) AS folder, coalesce(e.path, o.path) AS path, o.state, o.kind, o.size, o.mtime_ns, o.exec, o.hash, o.at_ns, e.folder IS NOT NULL AND NOT e.deleted AS live, e.covered, e.kind AS e_kind, e.size AS e_size, e.mtime_ns AS e_mtime, e.exec AS e_exec, e.hash AS e_hash, e.stamp AS e_stamp, coalesce(e.c_n0, 0) AS c0
  FROM e FULL JOIN obs o ON e.folder = o.folder AND e.path = o.path),
d AS (
  SELECT *, CASE WHEN state IS NULL AND live AND covered THEN 'skipped' WHEN state IS NULL AND live THEN 'delete' WHEN state = 'skipped' THEN 'skipped' WHEN state IS NULL THEN 'unchanged'
    WHEN NOT live THEN 'add' WHEN kind = e_kind AND hash = e_hash AND size = e_size AND mtime_ns = e_mtime AND exec = e_exec THEN 'unchanged' WHEN kind <> e_kind OR hash <> e_hash THEN 'modify' WHEN exec <> e_exec THEN 'chmod' WHEN mtime_ns <> e_mtime THEN 'touch' ELSE 'unchanged' END AS change
  FROM j WHERE state IS NOT NULL OR live)"""


@query(
    "snapshot_diff",
    _DIFF
    + """, w AS (SELECT *, change NOT IN ('skipped', 'unchanged') AS written, change = 'delete' AS gone FROM d)
SELECT folder, path, change, CASE WHEN gone THEN e_kind WHEN written THEN kind END AS new_kind, CASE WHEN gone THEN 0 WHEN written THEN size END AS new_size,
  CASE WHEN gone THEN coalesce(at_ns, 1900000000000000000) WHEN written THEN mtime_ns END AS new_mtime_ns, CASE WHEN written THEN NOT gone AND exec END AS new_exec,
  CASE WHEN gone THEN repeat('0', 64) WHEN written THEN hash END AS new_hash, CASE WHEN written THEN gone END AS new_deleted, CASE WHEN written THEN coalesce(e_hash, repeat('0', 64)) END AS new_prev_hash,
  CASE WHEN NOT written THEN NULL WHEN e_stamp IS NULL THEN CASE kind WHEN 'file' THEN mtime_ns ELSE 1 END WHEN kind = 'file' AND NOT gone AND hash <> e_hash THEN greatest(mtime_ns, e_stamp + 1) ELSE e_stamp + 1 END AS new_stamp,
  CASE WHEN written THEN 'n0' END AS new_modified_by, CASE WHEN written THEN 'me' END AS new_author_host, CASE WHEN written THEN c0 + 1 ELSE 0 END AS c_n0 FROM w""",
)
def _(spark, sf):
    hosts = spark.range(1).select(F.lit("n0").alias("node"), F.lit("me").alias("host"))
    d = diff.snapshot_diff(with_version(fixture(spark, sf, "parts_index")), fixture(spark, sf, "parts_scan"), hosts=hosts, now_ns=F.lit(1_900_000_000_000_000_000))
    return d.select(*[c for c in d.columns if c not in ("node", "new_version")], counters("new_version")[0])


@query("covered_by_skip", f"SELECT folder, path, EXISTS (SELECT 1 FROM fx_parts_scan o WHERE o.state = 'skipped' AND {_COVER}) AS covered FROM fx_parts_index e")
def _(spark, sf):
    return diff.covered_by_skip(fixture(spark, sf, "parts_index"), fixture(spark, sf, "parts_scan").where("state = 'skipped'")).select("folder", "path", "covered")


@query("implied_ancestors", "SELECT DISTINCT folder, split_part(path, '/', 1) AS path FROM fx_parts_scan WHERE state = 'observed' AND path LIKE '%/%'")
def _(spark, sf):
    return diff.implied_ancestors(fixture(spark, sf, "parts_scan"), fixture(spark, sf, "parts_index")).select("folder", "path")


_REPORTS = ", r AS (SELECT folder, node, path, max(at_us) AS reported, max(at_us - 500000) AS written FROM fx_changes WHERE size % 4 = 0 GROUP BY ALL)"


@query("drop_stale", _REPORTS + ", s AS (SELECT *, max(at_us) OVER (PARTITION BY folder, node, path ORDER BY (arrival * 7919) % 10007, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_changes) SELECT s.arrival, coalesce(at_us < reported, FALSE) OR coalesce(at_us < m, FALSE) OR (size % 2 = 0 AND coalesce(at_us < written, FALSE)) AS stale FROM s LEFT JOIN r ON r.folder = s.folder AND r.node = s.node AND r.path = s.path")
def _(spark, sf):
    c = fixture(spark, sf, "changes").withColumn("at_ns", F.col("at_us"))
    reports = c.where("size % 4 = 0").select("folder", "node", "path", F.col("at_us").alias("reported_ns"), (F.col("at_us") - 500000).alias("written_ns"))
    obs = c.withColumn("id", F.col("arrival")).withColumn("arrival", F.struct((F.col("id") * 7919) % 10007, "id")).withColumn("state", F.when(F.col("size") % 2 == 0, "unchanged").otherwise("observed"))
    return diff.drop_stale(obs, reports).select(F.col("id").alias("arrival"), "stale")


@query("root_guard", "SELECT folder, path, bracket_id, bracket_id <> 'b1' AS may_delete FROM fx_parts_scan")
def _(spark, sf):
    obs = fixture(spark, sf, "parts_scan")
    ends = obs.select("folder", "node", "bracket_id").distinct()
    brackets = ends.select("*", F.lit(True).alias("marker_start"), (F.col("bracket_id") != "b1").alias("marker_end"), F.lit(True).alias("listed"))
    return diff.root_guard(obs, brackets).select("folder", "path", "bracket_id", "may_delete")


@query("mtime_shim", "SELECT folder, path, CASE WHEN arrival % 2 = 0 AND arrival % 6 <> 2 AND state = 'observed' AND path NOT LIKE 'new/%' THEN 1000 + arrival ELSE mtime_ns END AS mtime_ns FROM fx_parts_scan")
def _(spark, sf):
    obs = fixture(spark, sf, "parts_scan")
    shim = obs.where("arrival % 2 = 0 and state = 'observed' and path not like 'new/%'").select("folder", "path", (F.col("arrival") + 1000).alias("requested_ns"), (F.col("mtime_ns") + F.when(F.col("arrival") % 6 == 2, 5).otherwise(0)).alias("stored_ns"))
    return diff.apply_mtime_shim(obs, shim).select("folder", "path", "mtime_ns")


@query("shim_delta", "SELECT folder, path, CASE WHEN k % 5 = 0 THEN 'remove' WHEN k % 5 = 1 THEN 'add' WHEN k % 5 = 2 THEN 'move' ELSE 'keep' END AS action FROM fx_parts_index")
def _(spark, sf):
    p = fixture(spark, sf, "parts_index").withColumn("requested_ns", F.col("k")).withColumn("stored_ns", F.col("mtime_ns"))
    after = p.where("k % 5 <> 0").withColumn("stored_ns", F.col("mtime_ns") + F.when(F.col("k") % 5 == 2, 1).otherwise(0))
    return diff.shim_delta(p.where("k % 5 <> 1"), after).select("folder", "path", "action")


@query("scan_report", "SELECT folder, state, skip_reason, count(*) AS n FROM fx_parts_scan GROUP BY ALL")
def _(spark, sf):
    return diff.scan_report(fixture(spark, sf, "parts_scan"))


@query(
    "fill_by_hash",
    ", w AS (SELECT folder, 'w/' || k AS path, hash FROM fx_files WHERE k % 3 = 0 UNION ALL SELECT folder, path, hash FROM fx_files WHERE k % 5 = 0), live AS (SELECT * FROM fx_files WHERE NOT deleted AND k % 4 <> 1), bin AS (SELECT folder, hash, min('t/' || k) AS t FROM fx_files WHERE k % 4 = 1 GROUP BY ALL), f AS (SELECT folder, hash, min(path) AS p FROM live GROUP BY ALL) SELECT w.folder, w.path, CASE WHEN h.path IS NOT NULL THEN 'same path' WHEN p IS NOT NULL THEN 'entry' WHEN t IS NOT NULL THEN 'trash' END AS fill_from, CASE WHEN h.path IS NOT NULL THEN w.path ELSE coalesce(p, t) END AS fill_path FROM w LEFT JOIN live h ON h.folder = w.folder AND h.path = w.path AND h.hash = w.hash LEFT JOIN f ON f.folder = w.folder AND f.hash = w.hash LEFT JOIN bin ON bin.folder = w.folder AND bin.hash = w.hash",
)
def _(spark, sf):
    f = fixture(spark, sf, "files")
    wanted = f.where("k % 3 = 0").select("folder", F.concat(F.lit("w/"), "k").alias("path"), "hash").unionByName(f.where("k % 5 = 0").select("folder", "path", "hash"))
    bin_ = f.where("k % 4 = 1").select("folder", "hash", F.concat(F.lit("t/"), "k").alias("trashed_path"))
    return diff.fill_by_hash(wanted, f.where("k % 4 <> 1"), bin_)[["folder", "path", "fill_from", "fill_path"]]


@query("announced_hash", "SELECT folder, path, CASE WHEN k % 6 = 0 THEN repeat('0', 64) WHEN k % 3 = 0 THEN SHA[[CAST(k AS STRING)]] ELSE hash END AS announced_hash FROM fx_parts_index")
def _(spark, sf):
    e = fixture(spark, sf, "parts_index")
    p = e.where("k % 3 = 0").select("folder", "node", "path", F.when(F.col("k") % 6 != 0, F.sha2(F.col("k").cast("string"), 256)).alias("announced_hash"))
    return diff.announced_hash(e, p).select("folder", "path", "announced_hash")


@query("assign_seq", "SELECT folder, node, arrival, 100 + row_number() OVER (PARTITION BY folder, node ORDER BY arrival, path) AS seq FROM fx_changes")
def _(spark, sf):
    c = fixture(spark, sf, "changes").withColumn("at", F.col("arrival"))
    last = c.select("folder", "node").distinct().withColumn("last_seq", F.lit(100))
    return diff.assign_seq(c, last).select("folder", "node", "arrival", "seq")


@query("next_stamp", "SELECT folder, path, CASE WHEN k % 5 = 0 THEN CASE kind WHEN 'file' THEN mtime_ns ELSE 1 END WHEN k % 2 = 0 AND kind = 'file' THEN greatest(mtime_ns, stamp + 1) ELSE stamp + 1 END AS next FROM fx_parts_index")
def _(spark, sf):
    prev = F.when(F.col("k") % 5 != 0, F.col("stamp"))
    return fixture(spark, sf, "parts_index").select("folder", "path", fe.next_stamp(prev, F.col("kind"), F.col("mtime_ns"), F.col("k") % 2 == 0).alias("next"))


# --- paths and predicates -----------------------------------------------------------------------

_BAD = "CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN '/' || path WHEN 2 THEN path || '/' WHEN 3 THEN replace(path, '/', '//') WHEN 4 THEN './' || path WHEN 5 THEN '../' || path WHEN 6 THEN repeat('n', 256) || '/' || path WHEN 7 THEN '.replimerge/' || path WHEN 8 THEN repeat('abcdefgh/', 500) || path ELSE path END"


@query("validate_paths", f"SELECT k, {_BAD} AS path, CASE k % 12 WHEN 0 THEN 'empty' WHEN 1 THEN 'absolute' WHEN 2 THEN 'trailing slash' WHEN 3 THEN 'empty component' WHEN 4 THEN 'dot' WHEN 5 THEN 'dot dot' WHEN 6 THEN 'long component' WHEN 7 THEN 'reserved' WHEN 8 THEN 'too long' END AS reason, k % 12 > 8 AS valid FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("k", F.expr(_BAD).alias("path"))
    return fp.validate_paths(f)


@query("normalise_names", "SELECT k, nfc_normalize(path) AS path, nfc_normalize(path) <> path AS differs FROM (SELECT k, CASE WHEN k % 3 = 0 THEN path || 'e' || chr(769) ELSE path END AS path FROM fx_files) x")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("k", F.when(F.col("k") % 3 == 0, F.concat("path", F.lit("é"))).otherwise(F.col("path")).alias("disk_path"))
    return fp.normalise_names(f).select("k", "path", "differs")


@query("coinciding_names", "SELECT k, count(*) OVER (PARTITION BY folder, k % 500) > 1 AS coincides FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("folder", "k", (F.col("k") % 500).cast("string").alias("path"), F.col("path").alias("disk_path"))
    return fp.coinciding_names(f).select("k", "coincides")


_RULES = ["*.txt", "!en/", "fr/", "!fr/d10.txt", "/de/d1*.txt", "!*9.txt"]


@query("apply_ignore_rules", "SELECT k, CASE WHEN path LIKE 'fr/%' THEN 'line 3' WHEN path LIKE '%9.txt' THEN NULL WHEN regexp_matches(path, '^de/d1[^/]*\\.txt$') THEN 'line 5' ELSE 'line 1' END AS ignored_by FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("k", "folder", "path", "kind")
    return ignore.apply_ignore_rules(f, ignore.compile_rules(_RULES)).select("k", "ignored_by")


@query("invalid_rules", "SELECT folder, k AS line_no, CASE WHEN k % 7 = 0 THEN 'not UTF-8' ELSE 'malformed' END AS reason FROM fx_files WHERE k % 7 = 0 OR k % 5 = 0")
def _(spark, sf):
    f = fixture(spark, sf, "files")
    bad = F.element_at(F.array(*map(F.lit, ["[ab\r", "[]", "![z-a]", "x\\"])), (F.col("k") / 5 % 4 + 1).cast("int"))
    raw = F.when(F.col("k") % 7 == 0, F.unhex(F.lit("FF61"))).when(F.col("k") % 5 == 0, F.encode(bad, "utf-8")).otherwise(F.encode(F.concat("path", F.lit("\r")), "utf-8"))
    return ignore.invalid_rules(f.select("folder", F.col("k").alias("line_no"), raw.alias("bytes")))


@query("normalise_observation", "SELECT k, CASE k % 3 WHEN 1 THEN 0 ELSE size END AS size, CASE k % 3 WHEN 1 THEN repeat('0', 64) ELSE hash END AS hash, k % 3 = 0 AND exec AS exec, CASE k % 3 WHEN 0 THEN mtime_ns ELSE 0 END AS mtime_ns FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files").withColumn("kind", F.when(F.col("k") % 3 == 0, "file").when(F.col("k") % 3 == 1, "dir").otherwise("symlink"))
    return fe.normalise_observation(f).select("k", "size", "hash", "exec", "mtime_ns")


@query("same_content", _PAIR + f" SELECT folder, path, {_SAME} AS same, hash = prev_hash AS metadata_only, NOT b_deleted AND kind = b_kind AND CASE kind WHEN 'file' THEN size = b_size AND mtime_ns = b_mtime_ns AND exec = b_exec WHEN 'dir' THEN TRUE ELSE hash = b_hash END AS unchanged FROM p WHERE known")
def _(spark, sf):
    p = merge.paired(*_two(spark, sf)).where("own_known")
    return p.select("folder", "path", fe.same_content("in_", "own_").alias("same"), fe.is_metadata_only("in_").alias("metadata_only"), fe.unchanged_by_stat("in_", "own_").alias("unchanged"))


@query("tracked_count", "SELECT folder, node, count(*) FILTER (NOT deleted) AS tracked FROM fx_files GROUP BY ALL")
def _(spark, sf):
    return fe.tracked_count(fixture(spark, sf, "files"))


@query("size_allowed", "SELECT path, l_tier AS tier, CASE l_tier WHEN 'lan' THEN TRUE WHEN 'direct' THEN size <= 1073741824 ELSE size <= 52428800 END AS allowed, CASE WHEN size <= 52428800 THEN 'relay' WHEN size <= 1073741824 THEN 'direct' ELSE 'lan' END AS least FROM (SELECT *, CASE line % 3 WHEN 0 THEN 'lan' WHEN 1 THEN 'direct' ELSE 'relay' END AS l_tier FROM fx_wants) w")
def _(spark, sf):
    w = fixture(spark, sf, "wants").withColumn("tier", F.when(F.col("line") % 3 == 0, "lan").when(F.col("line") % 3 == 1, "direct").otherwise("relay"))
    return w.select("path", "tier", fe.size_allowed(F.col("tier"), F.col("size")).alias("allowed"), fe.least_tier(F.col("size")).alias("least"))


@query("valid_host", "SELECT node, regexp_matches(h, '^[a-z0-9-]{0,63}$') AS valid FROM (SELECT node, CASE k % 4 WHEN 0 THEN upper(node) WHEN 1 THEN repeat('a', 64) WHEN 2 THEN '' ELSE node END AS h FROM fx_peers) p")
def _(spark, sf):
    h = F.expr("CASE k % 4 WHEN 0 THEN upper(node) WHEN 1 THEN repeat('a', 64) WHEN 2 THEN '' ELSE node END")
    return fixture(spark, sf, "peers").select("node", fe.valid_host(h).alias("valid"))


@query("settled", "SELECT arrival, at_us % 5 >= 2 AS settled FROM fx_changes")
def _(spark, sf):
    c = fixture(spark, sf, "changes")
    now = F.col("at_us") * 1000
    return c.select("arrival", fe.settled(now - (F.col("at_us") % 5) * 1_000_000_000, now).alias("settled"))


@query("two_looks", "SELECT arrival, coalesce(lag(size % 3) OVER o = size % 3 AND at_us - lag(at_us) OVER o >= 2000000, FALSE) AS settled FROM fx_changes WINDOW o AS (PARTITION BY folder, path ORDER BY at_us, arrival)")
def _(spark, sf):
    c = fixture(spark, sf, "changes")
    c = c.select("folder", "path", "arrival", (F.col("at_us") * 1000 + F.col("arrival") % 1000).alias("looked_ns"), (F.lit(4 * 10**18) + F.col("size") % 3).alias("ctime_ns"))
    return diff.two_looks(c, 2_000_000_000 - 1000).select("arrival", "settled")


@query("subtree", "SELECT path, hash FROM fx_files WHERE starts_with(path, 'en/')")
def _(spark, sf):
    return fp.subtree(fixture(spark, sf, "files"), "en").select("path", "hash")


# --- batches -------------------------------------------------------------------------------------


_WINDOWS = """, o AS (SELECT folder, node, at_us, row_number() OVER (PARTITION BY folder, node ORDER BY at_us) AS rn FROM fx_changes),
w AS (SELECT folder, node, rn, at_us AS opened_us, at_us AS last_us FROM o WHERE rn = 1
      UNION ALL SELECT o.folder, o.node, o.rn, CASE WHEN o.at_us >= least(w.opened_us + 10000000, w.last_us + 2000000) THEN o.at_us ELSE w.opened_us END, o.at_us
      FROM w JOIN o ON o.folder = w.folder AND o.node = w.node AND o.rn = w.rn + 1),
closed AS (SELECT folder, node, opened_us, least(opened_us + 10000000, max(last_us) + 2000000) AS due_us, count(*) AS n FROM w GROUP BY folder, node, opened_us)"""


@query("batch_windows", _WINDOWS + " SELECT * FROM closed")
def _(spark, sf):
    return batches.batch_windows(fixture(spark, sf, "changes"))


@query("coalesce_changes", ", g AS (SELECT folder, node, path, arg_min(announced_live, row(at_us, announced_live)) AS was, max(row(at_us, now_live, hash, size)) AS z, count(*) AS n_changes FROM fx_changes GROUP BY folder, node, path) SELECT folder, node, path, CASE WHEN was AND z[2] THEN 'modify' WHEN was THEN 'delete' WHEN z[2] THEN 'add' END AS step, n_changes, z[3] AS hash, z[4] AS size FROM g")
def _(spark, sf):
    return batches.coalesce_changes(fixture(spark, sf, "changes"))


_SUM = "count(*) FILTER (NOT exempt AND step = 'add') AS adds, count(*) FILTER (NOT exempt AND step = 'modify' AND hash <> prev_hash) AS mods, count(*) FILTER (NOT exempt AND step = 'delete' AND hash <> prev_hash) AS dels, CAST(coalesce(sum(size) FILTER (NOT exempt AND (step = 'add' OR (step = 'modify' AND hash <> prev_hash))), 0) AS BIGINT) AS bytes"


@query("batch_summary", f"SELECT batch, {_SUM} FROM fx_batch_entries GROUP BY batch")
def _(spark, sf):
    return batches.batch_summary(fixture(spark, sf, "batch_entries"), ["batch"])


@query("split_batches", "SELECT folder, source, seq, CAST(floor((seq - 1) / 50) AS BIGINT) AS batch_no FROM fx_batch_entries")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries").select("folder", "source", "path", "seq")
    return batches.split_batches(b, most=50).select("folder", "source", "seq", "batch_no")


@query(
    "split_batches_by_size",
    """, o AS (SELECT folder, source, seq, strlen(path) + 256 AS cost FROM fx_batch_entries),
w AS (SELECT folder, source, seq, CAST(0 AS BIGINT) AS batch_no, 1 AS n, cost AS used FROM o WHERE seq = 1
      UNION ALL SELECT o.folder, o.source, o.seq, w.batch_no + CAST(w.n = 50 OR w.used + o.cost > 12000 AS BIGINT), CASE WHEN w.n = 50 OR w.used + o.cost > 12000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n = 50 OR w.used + o.cost > 12000 THEN o.cost ELSE w.used + o.cost END
      FROM w JOIN o ON o.folder = w.folder AND o.source = w.source AND o.seq = w.seq + 1) SELECT folder, source, seq, batch_no FROM w""",
)
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries").select("folder", "source", "path", "seq")
    return batches.split_batches(b, most=50, room=12_000).select("folder", "source", "seq", "batch_no")


@query("batch_chain", ", h AS (SELECT folder, source, batch_no, max(seq) AS seq_high FROM fx_batch_entries GROUP BY ALL) SELECT folder, source, batch_no, seq_high, lag(seq_high, 1, 0) OVER (PARTITION BY folder, source ORDER BY seq_high) AS seq_low FROM h")
def _(spark, sf):
    h = fixture(spark, sf, "batch_entries").groupBy("folder", "source", "batch_no").agg(F.max("seq").alias("seq_high"))
    return batches.batch_chain(h)


def _announced(b: DataFrame) -> DataFrame:
    return b.groupBy("folder", "node").agg((F.floor(F.max("seq") * 3 / 4)).cast("long").alias("announced_seq"), F.count_if(~F.col("deleted")).alias("announced_tracked"))


_LAST = ", last AS (SELECT folder, node, CAST(floor(max(seq) * 3 / 4) AS BIGINT) AS announced_seq, count(*) FILTER (NOT deleted) AS announced_tracked FROM fx_batch_entries GROUP BY folder, node)"


@query("unannounced", _LAST + " SELECT b.folder, b.node, path, seq, CASE WHEN k % 2 = 0 THEN step END AS step FROM fx_batch_entries b JOIN last USING (folder, node) WHERE seq > announced_seq")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    return batches.unannounced(b.drop("step"), b.where("k % 2 = 0").select("folder", "node", "path", "step"), _announced(b)).select("folder", "node", "path", "seq", "step")


@query(
    "catch_up",
    _LAST
    + ", shown AS (SELECT folder, node, path, CASE WHEN k % 10 = 0 THEN CASE WHEN k % 20 = 0 THEN seq - 1 END ELSE seq END AS seq, CASE WHEN k % 10 = 0 THEN 'old' ELSE hash END AS hash FROM fx_batch_entries) SELECT s.folder, s.node, 'p' || i AS peer, path, seq, hash FROM shown s JOIN last USING (folder, node) JOIN range(3) AS r(i) ON seq > CAST(floor(announced_seq * i / 3) AS BIGINT) WHERE seq <= announced_seq",
)
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    last = _announced(b)
    p = b.where("k % 10 = 0").select("folder", "node", "path", F.when(F.col("k") % 20 == 0, F.col("seq") - 1).alias("announced_seq_of"), F.lit("old").alias("announced_hash"))
    i = F.explode(F.array(*[F.lit(x) for x in range(3)]))
    acks = last.withColumn("i", i).select("folder", "node", F.concat(F.lit("p"), "i").alias("peer"), F.floor(F.col("announced_seq") * F.col("i") / 3).alias("ack"))
    return batches.catch_up(b, p, acks, last)


_FIRST = "folder <> 'f0'"


@query("unannounced_first", _LAST + f" SELECT b.folder, b.node, path, seq, CASE WHEN k % 2 = 0 THEN step END AS step FROM fx_batch_entries b LEFT JOIN (SELECT * FROM last WHERE {_FIRST}) l USING (folder, node) WHERE seq > coalesce(announced_seq, 0)")
def _(spark, sf):
    """A folder that was never announced has everything to send."""
    b = fixture(spark, sf, "batch_entries")
    return batches.unannounced(b.drop("step"), b.where("k % 2 = 0").select("folder", "node", "path", "step"), _announced(b).where(_FIRST)).select("folder", "node", "path", "seq", "step")


@query(
    "catch_up_first",
    _LAST
    + ", m AS (SELECT DISTINCT folder, node FROM fx_batch_entries UNION SELECT DISTINCT folder, 'p8' FROM fx_batch_entries), a AS (SELECT folder, node, 'p' || i AS peer, CAST(floor(announced_seq * i / 3) AS BIGINT) AS ack FROM last, range(1, 3) AS r(i)),"
    " pe AS (SELECT folder, node, peer, ack FROM a UNION ALL SELECT x.folder, x.node, y.node, 0 FROM m x JOIN m y ON x.folder = y.folder AND x.node <> y.node)"
    f" SELECT b.folder, b.node, peer, path, seq, hash FROM fx_batch_entries b JOIN last l ON l.folder = b.folder AND l.node = b.node JOIN pe ON pe.folder = b.folder AND pe.node = b.node WHERE b.{_FIRST} AND seq <= announced_seq AND seq > ack",
)
def _(spark, sf):
    """Members that never sent an ack get everything that was announced."""
    b = fixture(spark, sf, "batch_entries")
    last = _announced(b)
    i = F.explode(F.array(*[F.lit(x) for x in range(1, 3)]))
    acks = last.withColumn("i", i).select("folder", "node", F.concat(F.lit("p"), "i").alias("peer"), F.floor(F.col("announced_seq") * F.col("i") / 3).alias("ack"))
    pending = b.limit(0).select("folder", "node", "path", F.col("seq").alias("announced_seq_of"), F.col("hash").alias("announced_hash"))
    members = b.select("folder", "node").unionByName(b.select("folder", F.lit("p8").alias("node"))).distinct()
    return batches.catch_up(b, pending, acks, last.where(_FIRST), members)


@query("replace_ack", _LAST + ", a AS (SELECT folder, node, 'p' || k % 3 AS peer, arg_max(seq, (k * 31) % 1009 * 1000000 + k) AS ack FROM fx_batch_entries GROUP BY ALL) SELECT folder, node, peer, ack, ack < announced_seq AS resend FROM a JOIN last USING (folder, node)")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    r = b.select("folder", "node", F.concat(F.lit("p"), F.col("k") % 3).alias("peer"), ((F.col("k") * 31) % 1009 * 1000000 + F.col("k")).alias("arrival"), F.col("seq").alias("watermark"))
    return batches.replace_ack(r, _announced(b))


@query("contiguous_watermark", ", g AS (SELECT *, CASE WHEN seq_low > coalesce(max(seq_high) OVER (PARTITION BY folder, peer ORDER BY seq_low, seq_high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS gap FROM fx_ranges), h AS (SELECT *, sum(gap) OVER (PARTITION BY folder, peer ORDER BY seq_low, seq_high ROWS UNBOUNDED PRECEDING) AS gaps FROM g) SELECT folder, node, peer, coalesce(max(seq_high) FILTER (gaps = 0), 0) AS watermark, max(gaps) > 0 AS has_gap FROM h GROUP BY ALL")
def _(spark, sf):
    return batches.contiguous_watermark(fixture(spark, sf, "ranges"))


@query("dedupe_batch", ", b AS (SELECT batch, 'p' || k % 40 AS path, seq AS position, hash FROM fx_batch_entries) SELECT batch, path, max(position) AS position, arg_max(hash, position) AS hash, count(*) - 1 AS repeats FROM b GROUP BY ALL")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries").select("batch", F.concat(F.lit("p"), F.col("k") % 40).alias("path"), F.col("seq").alias("position"), "hash")
    return batches.dedupe_batch(b)


@query("mark_announced", "SELECT folder, node, max(seq) AS announced_seq, count(*) FILTER (NOT deleted) AS announced_tracked FROM fx_batch_entries GROUP BY folder, node")
def _(spark, sf):
    return batches.mark_announced(fixture(spark, sf, "batch_entries"))


# --- brake and quarantine ------------------------------------------------------------------------

_RS = "count(*) FILTER (does AND NOT deleted AND NOT here) AS adds, count(*) FILTER (does AND NOT deleted AND here) AS mods, count(*) FILTER (does AND deleted AND here AND b_kind <> 'dir') AS dels, CAST(coalesce(sum(size) FILTER (does AND NOT deleted), 0) AS BIGINT) AS bytes"
_DOES = ", q AS (SELECT *, coalesce(mode IN ('fetch', 'direct'), FALSE) AS does, coalesce(NOT b_deleted, FALSE) AS here FROM m)"
_HOLD = "d >= 50 AND tracked > 0 AND d * 100 >= 25 * tracked"
_EVAL = f"SELECT *, mods + dels AS d FROM s0), s AS (SELECT *, ({_HOLD}) OR bytes > 21474836480 AS held, CASE WHEN {_HOLD} THEN 'would delete or modify ' || d || ' of ' || tracked || ' tracked files (' || (d * 100 // greatest(tracked, 1)) || '%)' WHEN bytes > 21474836480 THEN 'would write ' || bytes || ' bytes' END AS reason FROM s1)"


@query("receiver_summary", _CLASS + _DOES + f" SELECT folder, {_RS} FROM q GROUP BY folder")
def _(spark, sf):
    return brake.receiver_summary(merge.classify_batch(*_two(spark, sf)), ["folder"])


@query("evaluate_brake", _CLASS + _DOES + f", s0 AS (SELECT * FROM (SELECT folder, {_RS} FROM q GROUP BY folder) a JOIN (SELECT folder, count(*) FILTER (NOT deleted AND kind <> 'dir') AS tracked FROM fx_replicas WHERE node = 'n0' GROUP BY folder) b USING (folder)), s1 AS ({_EVAL} SELECT folder, adds, mods, dels, bytes, tracked, held, reason FROM s")
def _(spark, sf):
    a, b = _two(spark, sf)
    tracked = b.groupBy("folder").agg(F.count_if(fe.is_tracked()).alias("tracked"))
    return brake.evaluate_brake(brake.receiver_summary(merge.classify_batch(a, b), ["folder"]).join(tracked, "folder"))


@query("pause_or_send", _LAST + f", s0 AS (SELECT *, announced_tracked AS tracked FROM (SELECT folder, node, {_SUM} FROM fx_batch_entries GROUP BY ALL) a JOIN last USING (folder, node)), s1 AS ({_EVAL} SELECT folder, node, held, reason, CASE WHEN folder = 'f3' THEN 'stay paused' WHEN held THEN 'pause' ELSE 'send' END AS action, NOT held AS would_pass FROM s")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    pre = brake.sender_precheck(batches.batch_summary(b, ["folder", "node"]), _announced(b))
    return brake.pause_or_send(pre, b.where("folder = 'f3'").select("folder", "node")).select("folder", "node", "held", "reason", "action", "would_pass")


@query("precheck_first", _LAST + f", s0 AS (SELECT a.*, coalesce(announced_tracked, 0) AS tracked FROM (SELECT folder, node, {_SUM} FROM fx_batch_entries GROUP BY ALL) a LEFT JOIN (SELECT * FROM last WHERE {_FIRST}) l USING (folder, node)), s1 AS ({_EVAL} SELECT folder, node, tracked, held, reason FROM s")
def _(spark, sf):
    """A first announcement is judged too, with nothing tracked before it."""
    b = fixture(spark, sf, "batch_entries")
    return brake.sender_precheck(batches.batch_summary(b, ["folder", "node"]), _announced(b).where(_FIRST)).select("folder", "node", "tracked", "held", "reason")


def _held(r: DataFrame) -> DataFrame:
    h = r.where("node = 'n2' and k % 20 = 0")
    return h.select("folder", "path", "version", "stamp", "size", "deleted", "k", F.concat(F.lit("h"), F.col("k") % 7).alias("batch"), F.col("k").alias("arrival"))


_HELD = ", h AS (SELECT *, 'h' || k % 7 AS batch, k AS arrival FROM fx_replicas WHERE node = 'n2' AND k % 20 = 0)"
_GE = " AND ".join(f"a.c_{n} >= b.c_{n}" for n in C)


@query("quarantine_match", _HELD + f" SELECT a.folder, a.path, a.node, arg_min(b.batch, b.arrival) AS held_batch, min(b.arrival) AS arrival FROM fx_replicas a JOIN h b ON a.folder = b.folder AND a.path = b.path AND {_GE} WHERE a.node <> 'n2' GROUP BY ALL")
def _(spark, sf):
    r = _replicas(spark, sf)
    return brake.quarantine_match(r.where("node <> 'n2'"), _held(r))


_FOLD = (
    ", f0 AS (SELECT folder, path, k % 7 AS b, bool_or(node = 'n0') AS p0, bool_or(node = 'n1') AS p1, CASE WHEN bool_or(node = 'n2') THEN 2 END AS s0, max(c_n0) FILTER (node = 'n0') AS v00, max(c_n1) FILTER (node = 'n0') AS v01, max(c_n2) FILTER (node = 'n0') AS v02, max(c_n0) FILTER (node = 'n1') AS v10, max(c_n1) FILTER (node = 'n1') AS v11, max(c_n2) FILTER (node = 'n1') AS v12, max(c_n0) FILTER (node = 'n2') AS v20, max(c_n1) FILTER (node = 'n2') AS v21, max(c_n2) FILTER (node = 'n2') AS v22 FROM fx_replicas WHERE k % 20 = 0 GROUP BY ALL)"
    ", f1 AS (SELECT *, CASE WHEN p0 AND (s0 IS NULL OR (v00 >= v20 AND v01 >= v21 AND v02 >= v22)) THEN 0 ELSE s0 END AS s1 FROM f0)"
    ", f2 AS (SELECT *, CASE WHEN p1 AND (s1 IS NULL OR (s1 = 0 AND v10 >= v00 AND v11 >= v01 AND v12 >= v02) OR (s1 = 2 AND v10 >= v20 AND v11 >= v21 AND v12 >= v22)) THEN 1 ELSE s1 END AS s2 FROM f1)"
)


@query("hold", _HELD + _FOLD + ", top AS (SELECT folder, max(arrival) AS t FROM h GROUP BY folder), l AS (SELECT * FROM fx_replicas WHERE node <> 'n2' AND k % 20 = 0), e AS (SELECT folder, batch, path, stamp, arrival, 2 AS who FROM h UNION ALL SELECT l.folder, 'h' || k % 7, l.path, l.stamp, coalesce(t, 0) + row_number() OVER (PARTITION BY l.folder ORDER BY k * 2 + r), r FROM l LEFT JOIN top USING (folder)) SELECT e.folder, batch, e.path, stamp, arrival, who = s2 AS stored FROM e JOIN f2 ON f2.folder = e.folder AND f2.path = e.path")
def _(spark, sf):
    r = _replicas(spark, sf)
    late = r.where("node <> 'n2' and k % 20 = 0").select("folder", F.concat(F.lit("h"), F.col("k") % 7).alias("batch"), "path", "version", "stamp", (F.col("k") * 2 + F.col("r")).alias("at"))
    return brake.hold(_held(r), late).select("folder", "batch", "path", "stamp", "arrival", "stored")


@query("approve", _CLASS + " SELECT folder, path, decision, mode FROM m WHERE k % 5 = 1")
def _(spark, sf):
    a, b = _two(spark, sf)
    held = a.withColumn("batch", F.col("k") % 5)
    return brake.approve(held, b, spark.range(1, 2).withColumnRenamed("id", "batch")).select("folder", "path", "decision", "mode")


@query(
    "deny",
    _HELD
    + ", o AS (SELECT * FROM fx_replicas WHERE node = 'n0') SELECT h.folder, h.path, greatest(h.c_n0, coalesce(o.c_n0, 0)) + 1 AS c_n0, greatest(h.c_n1, coalesce(o.c_n1, 0)) AS c_n1, greatest(h.c_n2, coalesce(o.c_n2, 0)) AS c_n2, greatest(h.stamp, coalesce(o.stamp, h.stamp)) + 1 AS stamp, coalesce(o.deleted, TRUE) AS deleted, coalesce(o.hash, repeat('0', 64)) AS hash, coalesce(o.hash, repeat('0', 64)) AS prev_hash,"
    " coalesce(o.size, 0) AS size, coalesce(o.kind, 'file') AS kind, coalesce(o.mtime_ns, 77) AS mtime_ns, coalesce(o.exec, FALSE) AS exec, 'n0' AS modified_by, 'me' AS author_host FROM h LEFT JOIN o ON o.folder = h.folder AND o.path = h.path WHERE batch <> 'h3'",
)
def _(spark, sf):
    r = _replicas(spark, sf)
    held = _held(r)
    d = merge.deny_versions(held, r.where("node = 'n0'"), "n0", "me", F.lit(77).cast("long"), held.where("batch <> 'h3'"))
    return d.select("folder", "path", *merge.FIELDS, *counters())


@query(
    "review_report",
    _HELD
    + ", f AS (SELECT *, row_number() OVER (PARTITION BY folder, batch ORDER BY path) AS n FROM (SELECT folder, batch, 'top/' || path || '.' || CASE WHEN k % 3 = 0 THEN 'md' ELSE 'txt' END AS path, size, deleted, k FROM h) x), g AS (SELECT folder, batch, count(*) AS n_entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (deleted) AS n_deleted,"
    " CASE WHEN min(split_part(path, '/', 2)) = max(split_part(path, '/', 2)) THEN 'top/' || min(split_part(path, '/', 2)) ELSE 'top' END AS common_dir, string_agg(path, ',' ORDER BY path) FILTER (n <= 5) AS samples, count(*) FILTER (path LIKE '%.md') AS md, count(*) FILTER (path LIKE '%.txt') AS txt, min(k) AS held FROM f GROUP BY ALL)"
    " SELECT folder, batch, n_entries, bytes, n_deleted, common_dir, samples, CASE WHEN txt = 0 THEN md || ' md' WHEN md = 0 THEN txt || ' txt' WHEN md >= txt THEN md || ' md,' || txt || ' txt' ELSE txt || ' txt,' || md || ' md' END AS extensions, 'n2' AS source, 1000000 - held AS age_s, 'why ' || batch AS reason FROM g",
)
def _(spark, sf):
    h = _held(_replicas(spark, sf))
    items = h.groupBy("folder", "batch").agg(F.lit("n2").alias("source"), (F.min("k") * 1_000_000_000).alias("held_at_ns")).withColumn("reason", F.concat(F.lit("why "), "batch"))
    named = h.withColumn("path", F.concat(F.lit("top/"), "path", F.lit("."), F.when(F.col("k") % 3 == 0, "md").otherwise("txt")))
    g = brake.review_report(named, items, F.lit(1_000_000 * 1_000_000_000))
    return g.withColumn("samples", F.array_join("sample_paths", ",")).withColumn("extensions", F.array_join(F.transform("extensions", lambda x: F.concat_ws(" ", x["n"], x["ext"])), ",")).drop("sample_paths")


@query("freeze", "SELECT folder, node, path, folder IN ('f1', 'f2') AND node IN ('n0', 'n1') AND k % 10 = 9 AS frozen FROM fx_batch_entries")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    return brake.freeze(b, b.where("k % 10 = 9"), b.where("folder in ('f1', 'f2') and node in ('n0', 'n1')").select("folder", "node")).select("folder", "node", "path", "frozen")


@query("unfreeze", _CLASS + " SELECT folder, path, decision FROM m WHERE k % 10 = 9")
def _(spark, sf):
    a, b = _two(spark, sf)
    waiting = a.where("k % 10 = 9").drop("node").withColumn("source", F.lit("n1")).withColumn("arrival", F.lit(2))
    old = waiting.withColumn("arrival", F.lit(1)).withColumn("hash", F.lit("x"))
    return brake.unfreeze(waiting.unionByName(old), b).select("folder", "path", "decision")


_REVERT = "k % 6 = 0"


@query(
    "revert_plan",
    ", a AS (SELECT folder, path, deleted, hash, kind, mtime_ns, exec, k FROM fx_replicas WHERE node = 'n0' AND k % 6 = 0), j AS (SELECT *, NOT deleted AS nw, k % 12 = 0 OR k % 5 = 0 AS known, (k % 12 = 0 OR k % 5 = 0) AND k % 7 <> 0 AS th, k % 12 = 0 AS same_hash, k % 24 = 0 AS same_meta FROM a) SELECT folder, path, CASE WHEN nw AND th AND same_hash AND NOT same_meta THEN 'reset metadata' WHEN nw AND th AND same_hash THEN 'keep' WHEN nw THEN 'trash' WHEN th THEN 'fetch' ELSE 'nothing' END AS action, th AND NOT (nw AND same_hash) AS refetch FROM j",
)
def _(spark, sf):
    own = _replicas(spark, sf).where("node = 'n0'")
    known = (F.col("k") % 12 == 0) | (F.col("k") % 5 == 0)
    p = own.where(_REVERT).select(
        "folder", "path",
        F.when(known, "file").alias("announced_kind"),
        F.when(known, F.when(F.col("k") % 12 == 0, F.col("hash")).otherwise("other")).alias("announced_hash"),
        F.when(known, F.col("mtime_ns") + F.when(F.col("k") % 24 == 0, 0).otherwise(1)).alias("announced_mtime_ns"),
        F.when(known, F.col("exec")).alias("announced_exec"),
        F.when(known, F.col("k") % 7 == 0).alias("announced_deleted"),
    )
    return brake.revert_plan(p, own)


@query("return_denied", _HELD + ", i AS (SELECT DISTINCT folder, batch, CAST(substr(batch, 2) AS BIGINT) AS n FROM h) SELECT folder, batch, row_number() OVER (PARTITION BY folder ORDER BY n % 2, CASE WHEN n % 2 = 1 THEN -n END, n, batch) AS arrival, 'held' AS state FROM i")
def _(spark, sf):
    h = _held(_replicas(spark, sf)).select("folder", "batch").distinct()
    n = F.substring("batch", 2, 9).cast("long")
    return brake.return_denied(h.select("folder", "batch", n.alias("arrival"), F.when(n % 2 == 1, "denied").otherwise("held").alias("state"), F.when(n % 2 == 1, -n).alias("denied_at"))).select("folder", "batch", "arrival", "state")


@query("rules_recheck", f"SELECT batch, NOT ((mods + dels >= 10 AND (mods + dels) * 100 >= 30 * 90) OR bytes > 9000000) AS would_pass FROM (SELECT batch, {_SUM} FROM fx_batch_entries GROUP BY batch) s")
def _(spark, sf):
    s = batches.batch_summary(fixture(spark, sf, "batch_entries"), ["folder", "batch"]).withColumn("tracked", F.lit(90))
    rules = s.select("folder").distinct().select("folder", F.lit(10).alias("hold_count"), F.lit(30).alias("hold_pct"), F.lit(9000000).alias("hold_size"))
    return brake.rules_recheck(s, rules).select("batch", "would_pass")


@query("rules_recheck_defaults", f"SELECT batch, NOT (CASE WHEN folder < 'f4' THEN (mods + dels >= 10 AND (mods + dels) * 100 >= 30 * 90) OR bytes > 9000000 ELSE (mods + dels >= 50 AND (mods + dels) * 100 >= 25 * 90) OR bytes > 21474836480 END) AS would_pass FROM (SELECT folder, batch, {_SUM} FROM fx_batch_entries GROUP BY ALL) s")
def _(spark, sf):
    """Folders without rules of their own have the default ones; paused batches are rechecked too."""
    s = batches.batch_summary(fixture(spark, sf, "batch_entries"), ["folder", "batch"]).withColumn("tracked", F.lit(90))
    rules = s.where("folder < 'f4'").select("folder").distinct().select("folder", F.lit(10).alias("hold_count"), F.lit(30).alias("hold_pct"), F.lit(9000000).alias("hold_size"))
    paused = F.substring_index("batch", "-", -1).cast("long") % 2 == 1
    return brake.rules_recheck(s.where(~paused), rules, s.where(paused)).select("batch", "would_pass")


_GE_H = " AND ".join(f"m.c_{n} >= h.c_{n}" for n in C)
_LE_H = " AND ".join(f"m.c_{n} <= h.c_{n}" for n in C)
_ROUTE = f", h AS (SELECT * FROM fx_replicas WHERE node = 'n2'), t AS (SELECT m.*, 'b' || m.k % 9 AS batch, CASE WHEN decision = 'ignore' THEN 'ignored' WHEN m.k % 6 = 0 AND coalesce({_LE_H}, FALSE) THEN 'already wanted' WHEN m.k % 20 = 0 AND coalesce({_GE_H}, FALSE) THEN 'joined' WHEN m.folder = 'f1' AND m.k % 10 = 9 THEN 'frozen' ELSE 'kept' END AS route FROM m LEFT JOIN h ON h.folder = m.folder AND h.path = m.path)"


@query(
    "received_report",
    _CLASS
    + _ROUTE
    + " SELECT folder, batch, count(*) AS n, count(*) FILTER (k % 15 = 0) AS repeats, count(*) FILTER (route = 'ignored') AS ignored, count(*) FILTER (route = 'already wanted') AS already_wanted, count(*) FILTER (route = 'joined') AS joined, count(*) FILTER (route = 'frozen') AS frozen, count(*) FILTER (route = 'kept') AS kept,"
    " count(*) FILTER (route = 'kept' AND decision = 'apply') AS applied, count(*) FILTER (route = 'kept' AND decision = 'merge') AS merged, count(*) FILTER (route = 'kept' AND decision = 'conflict') AS conflicts FROM t GROUP BY ALL",
)
def _(spark, sf):
    r = _replicas(spark, sf)
    a, b, h = (r.where(F.col("node") == n) for n in ("n1", "n0", "n2"))
    a = a.withColumn("batch", F.concat(F.lit("b"), F.col("k") % 9)).withColumn("position", F.lit(2))
    twice = a.where("k % 15 = 0").withColumns({"position": F.lit(1), "version": F.create_map(F.lit("n9"), F.lit(1).cast("long"))})
    pending = r.where("k % 10 = 9").select("folder", "path")
    return brake.received_report(brake.route_batch(a.unionByName(twice), b, _held(r), h.where("k % 6 = 0"), pending, r.where("folder = 'f1'").select("folder")))


# --- transfers -----------------------------------------------------------------------------------


def _wanted(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = fixture(spark, sf, "wants")
    node = F.explode(F.array(*[F.when(F.shiftright("bits", i).bitwiseAND(F.lit(1)) == 1, f"n{i}") for i in range(3)]))
    sources = w.select("folder", "path", "line", node.alias("source")).where("source is not null").withColumn("refused", (F.col("line") == 2) & (F.col("source") == "n0")).withColumn("excluded", F.lit(False))
    up = spark.range(3).select(F.concat(F.lit("n"), "id").alias("node"), F.element_at(F.array(F.lit("relay"), F.lit("direct"), F.lit("lan")), (F.col("id") + 1).cast("int")).alias("tier"), F.lit(True).alias("online"))
    return w, sources, up


_SRC = ", t AS (SELECT * FROM (VALUES ('n0', 'relay', 2, 0), ('n1', 'direct', 1, 1), ('n2', 'lan', 0, 2)) AS v(source, tier, r, i)), c AS (SELECT w.folder, w.path, w.size, t.*, CASE tier WHEN 'lan' THEN TRUE WHEN 'direct' THEN size <= 1073741824 ELSE size <= 52428800 END AS allowed FROM fx_wants w JOIN t ON (w.bits >> i) % 2 = 1 AND NOT (line = 2 AND source = 'n0'))"


@query("select_source", _SRC + ", g AS (SELECT folder, path, arg_min(source, r * 10 + i) FILTER (allowed) AS source FROM c GROUP BY ALL) SELECT w.folder, w.path, CASE WHEN g.source IS NOT NULL THEN 'source' WHEN g.path IS NOT NULL THEN 'deferred' ELSE 'no source' END AS state, g.source, CASE WHEN g.path IS NOT NULL AND g.source IS NULL THEN CASE WHEN w.size <= 52428800 THEN 'relay' WHEN w.size <= 1073741824 THEN 'direct' ELSE 'lan' END END AS need FROM fx_wants w LEFT JOIN g ON g.folder = w.folder AND g.path = w.path")
def _(spark, sf):
    return transfer.select_source(*_wanted(spark, sf)).select("folder", "path", "state", "source", "need")


@query("want_sources", ", w AS (SELECT folder, path, hash, 'n' || k % 4 AS batch_source, modified_by FROM fx_replicas WHERE node = 'n1' AND k % 2 = 0) SELECT folder, path, batch_source AS source FROM w UNION SELECT folder, path, modified_by FROM w UNION SELECT w.folder, w.path, r.node FROM w JOIN fx_replicas r ON r.folder = w.folder AND r.path = w.path AND r.hash = w.hash WHERE w.hash <> repeat('0', 64)")
def _(spark, sf):
    r = _replicas(spark, sf)
    w = r.where("node = 'n1' and k % 2 = 0").select("folder", "path", "hash", F.concat(F.lit("n"), F.col("k") % 4).alias("batch_source"), "modified_by")
    return transfer.want_sources(w, r)


@query(
    "plan_fetches",
    _SRC
    + """, l AS (SELECT folder, path, bool_or(allowed AND source = 'n0') AS a0, bool_or(allowed AND source = 'n1') AS a1, bool_or(allowed AND source = 'n2') AS a2 FROM c GROUP BY folder, path HAVING bool_or(allowed)),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, a0, a1, a2 ORDER BY path) AS q FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN a2 THEN 0 WHEN a1 THEN 1 ELSE 2 END, path) AS rn FROM k WHERE q <= 16),
w AS (SELECT DISTINCT folder, CAST(0 AS BIGINT) AS rn, 0 AS u0, 0 AS u1, 0 AS u2, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS source FROM o
      UNION ALL SELECT folder, rn, u0 + CAST(coalesce(pick = 'n0', FALSE) AS INTEGER), u1 + CAST(coalesce(pick = 'n1', FALSE) AS INTEGER), u2 + CAST(coalesce(pick = 'n2', FALSE) AS INTEGER), path, pick
      FROM (SELECT o.folder, o.rn, o.path, u0, u1, u2, CASE WHEN u0 + u1 + u2 >= 16 THEN NULL WHEN a2 AND u2 < 4 THEN 'n2' WHEN a1 AND u1 < 4 THEN 'n1' WHEN a0 AND u0 < 4 THEN 'n0' END AS pick
            FROM w JOIN o ON o.folder = w.folder AND o.rn = w.rn + 1) p) SELECT folder, path, source FROM w WHERE source IS NOT NULL""",
)
def _(spark, sf):
    return transfer.plan_fetches(transfer.source_choices(*_wanted(spark, sf)))


_TREE = "SELECT folder, split_part(path, '/', 1) AS path, 'dir' AS kind, bool_or(k % 7 = 0) AS deleted, FALSE AS to_trash, bool_and(k % 3 > 0) AS ready FROM fx_parts_index GROUP BY 1, 2 UNION ALL SELECT folder, path, kind, deleted, k % 31 = 0 AS to_trash, k % 3 > 0 AS ready FROM fx_parts_index"
_GATE = f", w AS ({_TREE}), g AS (SELECT *, CASE WHEN NOT deleted THEN EXISTS (SELECT 1 FROM w o WHERE o.folder = w.folder AND starts_with(w.path, o.path || '/') AND ((NOT o.deleted AND o.kind = 'dir') OR o.to_trash)) ELSE kind = 'dir' AND EXISTS (SELECT 1 FROM w o WHERE o.folder = w.folder AND o.deleted AND starts_with(o.path, w.path || '/')) END AS gated FROM w)"


def _tree(spark, sf) -> DataFrame:
    p = fixture(spark, sf, "parts_index")
    dirs = p.groupBy("folder", F.split("path", "/")[0].alias("path")).agg(F.lit("dir").alias("kind"), F.bool_or(F.col("k") % 7 == 0).alias("deleted"), F.lit(False).alias("to_trash"), F.bool_and(F.col("k") % 3 > 0).alias("ready"))
    return dirs.unionByName(p.select("folder", "path", "kind", "deleted", (F.col("k") % 31 == 0).alias("to_trash"), (F.col("k") % 3 > 0).alias("ready")))


@query("order_commits", _GATE + " SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY deleted, CASE WHEN NOT deleted THEN path END, CASE WHEN deleted THEN path END DESC) AS turn FROM g WHERE ready AND NOT gated")
def _(spark, sf):
    return transfer.order_commits(_tree(spark, sf)).select("folder", "path", "turn")


@query("gated", _GATE + " SELECT folder, path, kind, gated FROM g")
def _(spark, sf):
    return transfer.gated(_tree(spark, sf)).select("folder", "path", "kind", "gated")


@query("waiting_for", f", w AS ({_TREE}), l AS (SELECT *, NOT ready AS late FROM w) SELECT folder, path, kind, CASE WHEN NOT deleted THEN (SELECT arg_max(o.path, length(o.path)) FROM l o WHERE o.folder = l.folder AND o.late AND NOT o.deleted AND o.kind = 'dir' AND starts_with(l.path, o.path || '/')) WHEN kind = 'dir' THEN (SELECT min(o.path) FROM l o WHERE o.folder = l.folder AND o.late AND o.deleted AND starts_with(o.path, l.path || '/')) END AS waits_for FROM l")
def _(spark, sf):
    t = _tree(spark, sf).withColumn("state", F.when(~F.col("ready"), "deferred").otherwise("wanted"))
    return transfer.waiting_for(t).select("folder", "path", "kind", "waits_for")


@query("backoff", "SELECT path, least(60 * CAST(pow(2, least(greatest(k % 40 - 1, 0), 16)) AS BIGINT), 3600) AS seconds FROM fx_wants")
def _(spark, sf):
    return fixture(spark, sf, "wants").select("path", transfer.backoff_s(F.col("k") % 40).alias("seconds"))


@query("expire", "SELECT path, CASE WHEN k % 1000 <= 500 THEN CASE line % 4 WHEN 0 THEN 'stalled' WHEN 1 THEN 'overdue' WHEN 2 THEN 'retry' END END AS event FROM fx_wants")
def _(spark, sf):
    w = fixture(spark, sf, "wants").withColumn("deadline_ns", F.col("k") % 1000).withColumn("state", F.element_at(F.array(*map(F.lit, ["fetching", "committing", "retry", "wanted"])), (F.col("line") % 4 + 1).cast("int")))
    return transfer.expire(w, F.lit(500)).select("path", "event")


@query("next_deadline", ", d AS (SELECT folder, k * 10 AS t FROM fx_wants WHERE line % 4 < 3 UNION ALL SELECT folder, k * 7 FROM fx_wants WHERE line = 5) SELECT folder, min(t) AS deadline_ns FROM d GROUP BY folder")
def _(spark, sf):
    w = fixture(spark, sf, "wants").withColumn("deadline_ns", F.col("k") * 10).withColumn("state", F.when(F.col("line") % 4 < 3, "fetching").otherwise("wanted"))
    s = w.select("folder", F.when(F.col("line") == 5, F.col("k") * 7).alias("refused_until"), F.lit(None).cast("long").alias("excluded_until"))
    return transfer.next_deadline(w, s)


@query("unrecoverable", "SELECT folder, path, CAST(3 AS BIGINT) AS asked, CAST(3 AS BIGINT) AS refused FROM fx_wants WHERE line % 2 = 0 AND bits = 7")
def _(spark, sf):
    w = fixture(spark, sf, "wants")
    members = w.select("folder").distinct().select("folder", F.explode(F.array(*[F.lit(f"n{i}") for i in (0, 1, 2, 9)])).alias("node"))
    node = F.explode(F.array(*[F.when(F.shiftright("bits", i).bitwiseAND(F.lit(1)) == 1, f"n{i}") for i in range(3)]))
    answers = w.select("folder", "path", node.alias("source")).where("source is not null").withColumn("refused", F.lit(True))
    return transfer.unrecoverable(w.withColumn("restoring", F.col("line") % 2 == 0), members, answers)


@query("orphan_staging", ", f AS (SELECT k, substr(hash, 1, 16) || '-' || k AS name, hash, k % 3 AS m FROM fx_files) SELECT k, name FROM f WHERE substr(name, 1, 16) NOT IN (SELECT substr(hash, 1, 16) FROM f WHERE m = 0)")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("k", F.concat(F.substring("hash", 1, 16), F.lit("-"), F.col("k")).alias("name"), "hash")
    return transfer.orphan_staging(f.select("k", "name"), f.where("k % 3 = 0"))


# --- retention -----------------------------------------------------------------------------------

_DAY = "strftime(make_timestamp(CAST(floor(trashed_at_ns / 1000000000) AS BIGINT) * 1000000), '%Y-%m-%d')"


@query("trash_places", f", n AS (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY folder, {_DAY}, path ORDER BY trashed_at_ns, arrival) - 1 AS n FROM fx_trash) SELECT arrival, day || '/' || replace(path, '.txt', '') || CASE WHEN n > 0 THEN '~' || n ELSE '' END || '.txt' AS trashed_path FROM n")
def _(spark, sf):
    return retention.trash_places(fixture(spark, sf, "trash")).select("arrival", "trashed_path")


@query("prune_trash", ", n AS (SELECT arrival, trashed_at_ns, CAST(sum(size) OVER (PARTITION BY folder) - coalesce(sum(size) OVER (PARTITION BY folder ORDER BY trashed_at_ns, trashed_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM fx_trash) SELECT arrival, 870000000000000000 - trashed_at_ns > 2592000000000000 * 20 OR rest > 10737418240 AS prune FROM n")
def _(spark, sf):
    return retention.prune_trash(fixture(spark, sf, "trash"), F.lit(870000000000000000), days=600).select("arrival", "prune")


@query("reconcile_trash", "SELECT folder, trashed_path, CASE WHEN arrival % 4 = 0 THEN 'drop' WHEN arrival % 4 = 1 THEN 'add' ELSE 'keep' END AS action, CASE WHEN arrival % 4 = 1 THEN CAST(arrival AS STRING) ELSE original_path END AS original_path FROM fx_trash")
def _(spark, sf):
    t = fixture(spark, sf, "trash")
    return retention.reconcile_trash(t.where("arrival % 4 <> 1"), t.where("arrival % 4 <> 0"))


@query("restore_candidates", "SELECT folder, original_path, max(trashed_at_ns) AS trashed_at_ns, arg_max(hash, row(trashed_at_ns, trashed_path)) AS hash FROM fx_trash GROUP BY ALL")
def _(spark, sf):
    return retention.restore_candidates(fixture(spark, sf, "trash")).select("folder", "original_path", "trashed_at_ns", "hash")


@query("batch_history", ", b AS (SELECT folder, batch, max(recorded_at) AS recorded_at FROM fx_batch_entries GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY folder ORDER BY recorded_at, batch) AS nth FROM b")
def _(spark, sf):
    return retention.batch_history(fixture(spark, sf, "batch_entries").groupBy("folder", "batch").agg(F.max("recorded_at").alias("recorded_at")))


@query("path_history", ", b AS (SELECT folder, k % 50 AS p, source, seq, recorded_at, hash FROM fx_batch_entries) SELECT folder, p, source, seq, row_number() OVER o AS step_no, lag(hash) OVER o AS hash_before FROM b WINDOW o AS (PARTITION BY folder, p ORDER BY recorded_at, source, seq)")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries").withColumn("p", F.col("k") % 50).withColumn("path", F.col("p").cast("string"))
    return retention.path_history(b).select("folder", "p", "source", "seq", "step_no", "hash_before")


@query(
    "folder_status",
    "SELECT folder, node, count(*) FILTER (NOT deleted AND kind <> 'dir') AS files, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS bytes, count(*) FILTER (deleted) AS tombstones, count(*) FILTER (k % 9 = 0) AS pending, count(DISTINCT CASE WHEN k % 20 = 0 THEN k % 7 END) AS held, folder = 'f1' AS paused,"
    " count(*) FILTER (k % 8 = 3) AS deferred, concat_ws(',', CASE WHEN count(*) FILTER (k % 16 = 3) > 0 THEN 'frozen:' || count(*) FILTER (k % 16 = 3) END, CASE WHEN count(*) FILTER (k % 16 = 11) > 0 THEN 'too large:' || count(*) FILTER (k % 16 = 11) END) AS deferred_reasons, count(*) FILTER (k % 30 = 1) AS skipped FROM fx_replicas GROUP BY folder, node",
)
def _(spark, sf):
    r = _replicas(spark, sf)
    held = r.where("k % 20 = 0").withColumn("batch", F.col("k") % 7)
    deferred = r.where("k % 8 = 3").withColumn("reason", F.when(F.col("k") % 16 == 3, "frozen").otherwise("too large"))
    return retention.folder_status(r, r.where("k % 9 = 0"), held, r.where("folder = 'f1'"), deferred, r.where("k % 30 = 1"))


@query(
    "folder_status_partial",
    "SELECT folder, node, count(*) FILTER (folder <> 'f2' AND NOT deleted AND kind <> 'dir') AS files, count(*) FILTER (k % 9 = 0) AS pending, count(DISTINCT CASE WHEN k % 20 = 0 THEN k % 7 END) AS held, bool_or(folder = 'f1') AS paused, count(*) FILTER (k % 8 = 3) AS deferred, count(*) FILTER (k % 30 = 1) AS skipped"
    " FROM fx_replicas GROUP BY folder, node",
)
def _(spark, sf):
    """Machines that have something pending, held or deferred, but no entry yet, have a row too."""
    r = _replicas(spark, sf)
    s = retention.folder_status(r.where("folder <> 'f2'"), r.where("k % 9 = 0"), r.where("k % 20 = 0").withColumn("batch", F.col("k") % 7), r.where("folder = 'f1'"), r.where("k % 8 = 3").withColumn("reason", F.lit("frozen")), r.where("k % 30 = 1"))
    return s.select("folder", "node", "files", "pending", "held", "paused", "deferred", "skipped")


@query("change_rollup", "SELECT folder, source, day, count(*) FILTER (step = 'add') AS adds, count(*) FILTER (step = 'modify') AS mods, count(*) FILTER (step = 'delete') AS dels, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT folder, source, substr(day, 1, 7) AS day, step, size FROM fx_batch_entries) b GROUP BY ROLLUP (folder, source, day)")
def _(spark, sf):
    return retention.change_rollup(fixture(spark, sf, "batch_entries").withColumn("day", F.substring("day", 1, 7)))


# --- peers ---------------------------------------------------------------------------------------


@query("classify_tier", "SELECT node, CASE k % 6 WHEN 4 THEN 'direct' WHEN 5 THEN 'relay' ELSE 'lan' END AS tier FROM fx_peers")
def _(spark, sf):
    return peers.classify_tier(fixture(spark, sf, "peers")).select("node", "tier")


@query("trusted_peers", "SELECT node, CASE WHEN tagged THEN k % 18 = 0 ELSE user = 'u1' END AS trusted FROM fx_peers")
def _(spark, sf):
    p = fixture(spark, sf, "peers").withColumn("tags", F.when(F.col("tagged"), F.array(F.lit("tag:x"))).otherwise(F.array().cast("array<string>")))
    return peers.trusted_peers(p, "u1", p.where("k % 18 = 0")).select("node", "trusted")


@query("binding_conflicts", "SELECT 'm' || k % 40 AS node, count(DISTINCT stable_id) AS platforms, min(stable_id) AS first_id FROM fx_peers GROUP BY 1 HAVING count(DISTINCT stable_id) > 1")
def _(spark, sf):
    return peers.binding_conflicts(fixture(spark, sf, "peers").withColumn("node", F.concat(F.lit("m"), F.col("k") % 40)))


@query("clock_skew", "SELECT node, peer_us - received_us AS skew_us FROM fx_peers WHERE abs(peer_us - received_us) > 300000000")
def _(spark, sf):
    return peers.clock_skew(fixture(spark, sf, "peers")).select("node", "skew_us")


@query("members", "SELECT DISTINCT folder, node, 'send-receive' AS mode, CASE WHEN node <> 'n2' THEN 'host-' || node END AS host FROM fx_replicas")
def _(spark, sf):
    r = fixture(spark, sf, "replicas")
    machines = r.where("node <> 'n2'").select("node", F.concat(F.lit("host-"), "node").alias("host")).distinct()
    return peers.members(r.select("folder", "node", F.lit("send-receive").alias("mode")).distinct(), machines)


# --- audits --------------------------------------------------------------------------------------


@query(
    "audit_convergence",
    ", l AS (SELECT folder, node, path, k, kind, hash, exec FROM fx_replicas WHERE NOT deleted), s AS (SELECT * FROM l WHERE NOT (kind = 'dir' AND node = 'n2' AND k % 40 = 17)), g AS (SELECT folder, path, count(DISTINCT kind || hash || exec) AS states, count(*) AS holders FROM s GROUP BY ALL HAVING count(DISTINCT kind || hash || exec) > 1 OR count(*) < 3),"
    " o AS (SELECT folder, path, count(*) AS off_disk FROM l WHERE (node = 'n1' AND k % 50 = 0) OR (node = 'n0' AND k % 70 = 0) GROUP BY ALL) SELECT coalesce(g.folder, o.folder) AS folder, coalesce(g.path, o.path) AS path, coalesce(states, 0) AS states, coalesce(holders, 0) AS holders, coalesce(off_disk, 0) AS off_disk FROM g FULL JOIN o ON g.folder = o.folder AND g.path = o.path",
)
def _(spark, sf):
    r = _replicas(spark, sf)
    live = r.where("not deleted")
    disk = live.where("not (node = 'n1' and k % 50 = 0)").withColumn("hash", F.when((F.col("node") == "n0") & (F.col("k") % 70 == 0), "other").otherwise(F.col("hash")))
    return audit.convergence(r, 3, disk, live.where("kind = 'dir' and node = 'n2' and k % 40 = 17"))


@query("audit_lost_content", "SELECT DISTINCT a.folder, a.node, a.hash FROM fx_files a WHERE a.k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM fx_files b WHERE b.folder = a.folder AND b.node = a.node AND b.hash = a.hash AND b.k % 4 < 2)")
def _(spark, sf):
    f = fixture(spark, sf, "files")
    return audit.lost_content(f.where("k % 3 = 0"), f.where("k % 4 = 0"), f.where("k % 4 = 1"))


_PAIRS = "fx_replicas a JOIN fx_replicas b ON a.folder = b.folder AND a.path = b.path"


@query("audit_resurrections", f", ag AS (SELECT DISTINCT a.folder, a.path, a.node FROM {_PAIRS} WHERE a.deleted AND ({_LESS})), gone AS (SELECT DISTINCT folder, path FROM fx_replicas d WHERE deleted AND NOT EXISTS (SELECT 1 FROM ag WHERE ag.folder = d.folder AND ag.path = d.path AND ag.node = d.node)) SELECT DISTINCT l.folder, l.path FROM fx_replicas l JOIN gone USING (folder, path) WHERE NOT l.deleted AND NOT (l.kind = 'dir' AND l.node = 'n2')")
def _(spark, sf):
    r = _replicas(spark, sf)
    return audit.resurrections(r, r.where("kind = 'dir' and node = 'n2'"))


_AKEY, _BSIDE = (_KEY.replace("stamp", f"{t}.stamp", 1).replace("deleted", f"{t}.deleted").replace("prev_hash", "PREV").replace("hash", f"{t}.hash").replace("PREV", f"{t}.prev_hash").replace("mtime_ns", f"{t}.mtime_ns").replace("modified_by", f"{t}.modified_by").replace("CASE kind", f"CASE {t}.kind").replace("exec", f"{t}.exec").replace("size", f"{t}.size").replace("author_host", f"{t}.author_host") for t in "ab")
_TAGGED = "{0}.path || '.conflict-' || strftime(make_timestamp(CAST(floor({0}.mtime_ns / 1000000000) AS BIGINT) * 1000000), '%Y%m%d-%H%M%S') || '-' || {0}.author_host"


@query(
    "audit_conflict_copies",
    f", c AS (SELECT folder, {_TAGGED.format('r')} AS copy, kind, hash, exec FROM fx_replicas r WHERE node = 'n1' AND NOT deleted),"
    f" losers AS (SELECT DISTINCT a.folder, {_TAGGED.format('a')} AS copy, a.kind, a.hash, a.exec FROM {_PAIRS} WHERE ({_MORE}) AND ({_LESS}) AND NOT a.deleted AND NOT (NOT b.deleted AND a.kind = b.kind AND a.hash = b.hash AND a.exec = b.exec) AND {_AKEY} < {_BSIDE})"
    " SELECT DISTINCT folder, copy AS path, hash FROM c WHERE NOT EXISTS (SELECT 1 FROM losers l WHERE l.folder = c.folder AND l.copy = c.copy AND l.kind = c.kind AND l.hash = c.hash AND l.exec = c.exec)",
)
def _(spark, sf):
    r = _replicas(spark, sf)
    name = fp.conflict_copy_name(F.col("path"), F.col("kind"), F.col("mtime_ns"), F.col("author_host"), F.col("node"))
    copies = r.where("node = 'n1' and not deleted").withColumn("path", name)
    return audit.unexplained_conflicts(r.unionByName(copies))


@query("audit_held_commits", "SELECT folder, path FROM fx_batch_entries WHERE batch_no % 5 = 0 AND batch_no % 10 <> 0")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    return audit.held_commits(b, b.where("batch_no % 5 = 0"), b.where("batch_no % 10 = 0")).select("folder", "path")


@query("audit_vector_content", ", c AS (SELECT *, CASE WHEN k % 97 = 0 THEN 'x' || node ELSE hash END AS h FROM fx_replicas WHERE NOT (node = 'n2' AND k % 194 = 0)) SELECT folder, path, concat_ws(',', CASE WHEN c_n0 > 0 THEN 'n0:' || c_n0 END, CASE WHEN c_n1 > 0 THEN 'n1:' || c_n1 END, CASE WHEN c_n2 > 0 THEN 'n2:' || c_n2 END) AS vv_key, count(DISTINCT kind || h || exec || deleted) AS contents FROM c GROUP BY ALL HAVING count(DISTINCT kind || h || exec || deleted) > 1")
def _(spark, sf):
    r = _replicas(spark, sf)
    back = r.where("node = 'n2' and k % 194 = 0").select("folder", "node", "path", fv.vv_key(F.col("version")).alias("vv_key"))
    return audit.vector_content(r.withColumn("hash", F.when(F.col("k") % 97 == 0, F.concat(F.lit("x"), "node")).otherwise(F.col("hash"))), back)


@query("audit_adopt_dominance", _PAIR + " SELECT folder, path FROM p WHERE known AND relation IN ('dominated', 'concurrent')")
def _(spark, sf):
    p = merge.paired(*_two(spark, sf)).where("own_known")
    return audit.adopt_dominance(p.select("folder", "path", F.col("in_version").alias("new_version"), F.col("own_version").alias("old_version"))).select("folder", "path")


@query("audit_readmitted_changes", "SELECT folder, path, k % 20 = 1 AS user_changed FROM fx_replicas WHERE node = 'n0' AND k % 10 = 1 AND c_n0 > 1")
def _(spark, sf):
    r = _replicas(spark, sf).where("node = 'n0'").withColumn("written_ns", F.col("stamp"))
    reverted = r.where("k % 10 = 1").select("folder", "path", "node", F.lit(1).alias("mark"), F.lit(1000).alias("reverted_ns"))
    user = r.select("folder", "path", "node", F.when(F.col("k") % 20 == 1, 2000).otherwise(500).alias("changed_ns"))
    return audit.readmitted_changes(r, reverted, user).select("folder", "path", "user_changed")


@query("audit_non_monotone", f", s AS (SELECT *, stamp - CASE WHEN k % 91 = 0 AND e > 0 THEN 10000 ELSE 0 END AS st FROM fx_replicas) SELECT DISTINCT a.folder, a.path FROM s a JOIN s b ON a.folder = b.folder AND a.path = b.path WHERE a.st <= b.st AND ({_MORE}) AND NOT ({_LESS})")
def _(spark, sf):
    r = _replicas(spark, sf)
    return audit.non_monotone_changes(r.withColumn("stamp", F.col("stamp") - F.when((F.col("k") % 91 == 0) & (F.col("e") > 0), 10000).otherwise(0)))


@query("audit_broken_sequence", ", s AS (SELECT folder, node, seq, lag(seq) OVER (PARTITION BY folder, node ORDER BY seq) AS before FROM fx_batch_entries WHERE k % 37 <> 0) SELECT folder, node, seq, before FROM s WHERE before IS NOT NULL AND seq <> before + 1")
def _(spark, sf):
    return audit.broken_sequence(fixture(spark, sf, "batch_entries").where("k % 37 <> 0")).select("folder", "node", "seq", "before")


@query("audit_frozen_sends", "SELECT folder, node, path FROM fx_batch_entries WHERE folder = 'f1' AND k % 10 = 9")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    return audit.frozen_sends(b, b.where("k % 10 = 9"), b.where("folder = 'f1'")).select("folder", "node", "path")


@query("audit_broken_chain", ", g AS (SELECT folder, source, batch_no, max(seq) AS seq_high, min(seq) - 1 AS low FROM fx_batch_entries GROUP BY ALL), h AS (SELECT folder, source, batch_no, seq_high, low + CASE WHEN batch_no % 3 = 2 THEN 1 ELSE 0 END AS seq_low FROM g), l AS (SELECT *, lag(seq_high, 1, 0) OVER (PARTITION BY folder, source ORDER BY seq_high) AS expected_low, CAST((batch_no % 3 = 2) AS BIGINT) + CAST((batch_no % 5 = 1) AS BIGINT) AS outside FROM h) SELECT folder, source, batch_no, seq_low, expected_low, outside FROM l WHERE seq_low <> expected_low OR seq_low >= seq_high OR outside > 0")
def _(spark, sf):
    e = fixture(spark, sf, "batch_entries")
    b = e.groupBy("folder", "source", "batch_no").agg(F.max("seq").alias("seq_high"), (F.min("seq") - 1).alias("seq_low"))
    b = b.withColumn("seq_low", F.col("seq_low") + F.when(F.col("batch_no") % 3 == 2, 1).otherwise(0))
    late = b.where("batch_no % 5 = 1").select("folder", "source", "batch_no", (F.col("seq_high") + 1).alias("seq"))
    return audit.broken_chain(b, e.select("folder", "source", "batch_no", "seq").unionByName(late)).select("folder", "source", "batch_no", "seq_low", "expected_low", "outside")


@query("audit_unsafe_tombstones", f"SELECT folder, path FROM fx_parts_index e WHERE e.k % 3 = 0 AND EXISTS (SELECT 1 FROM fx_parts_scan o WHERE o.state = 'skipped' AND {_COVER})")
def _(spark, sf):
    e = fixture(spark, sf, "parts_index").where("k % 3 = 0").withColumn("change", F.lit("delete"))
    return audit.unsafe_tombstones(e, fixture(spark, sf, "parts_scan").where("state = 'skipped'")).select("folder", "path")


@query("audit_determinism", ", a AS (SELECT folder, path, hash FROM fx_files), b AS (SELECT folder, path, CASE WHEN k % 100 = 0 THEN 'x' ELSE hash END AS hash FROM fx_files) (SELECT *, 'a' AS side FROM (FROM a EXCEPT ALL FROM b)) UNION ALL (SELECT *, 'b' FROM (FROM b EXCEPT ALL FROM a))")
def _(spark, sf):
    f = fixture(spark, sf, "files")
    b = f.withColumn("hash", F.when(F.col("k") % 100 == 0, "x").otherwise(F.col("hash")))
    return inventory.table_diff(f.select("folder", "path", "hash"), b.select("folder", "path", "hash"))


# --- sources and streams --------------------------------------------------------------------------


@query("snapshot_since", "SELECT folder, path, seq FROM fx_batch_entries WHERE seq > 200")
def _(spark, sf):
    return inventory.snapshot_since(fixture(spark, sf, "batch_entries").select("folder", "path", "seq"), 200)


@query("hash_content", "SELECT k, SHA[[CAST(k AS STRING)]] AS hash FROM fx_files WHERE k % 10 <> 3")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("k", "path", "kind", "size", "mtime_ns", F.lit(1).alias("ctime_ns"), F.encode(F.col("k").cast("string"), "utf-8").alias("content"))
    after = f.withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("k") % 10 == 3, 1).otherwise(0))
    return inventory.hash_content(f, f, after).select("k", "hash")


@query("upsert", "SELECT folder, path, CASE WHEN k % 5 = 1 THEN 'new' ELSE hash END AS hash FROM fx_files WHERE k % 5 <> 0 UNION ALL SELECT folder, path || '.more', 'new' FROM fx_files WHERE k % 50 = 2")
def _(spark, sf):
    f = fixture(spark, sf, "files").select("folder", "path", "hash", "k")
    at = f.where("k % 5 < 2").select("folder", "path", F.lit("new").alias("hash"), (F.col("k") % 5 == 0).alias("removed"), F.lit(2).alias("at"))
    old = at.withColumn("hash", F.lit("old")).withColumn("removed", F.lit(False)).withColumn("at", F.lit(1))
    more = f.where("k % 50 = 2").select("folder", F.concat("path", F.lit(".more")).alias("path"), F.lit("new").alias("hash"), F.lit(False).alias("removed"), F.lit(1).alias("at"))
    return inventory.upsert(f.select("folder", "path", "hash"), at.unionByName(old).unionByName(more), ["folder", "path"])


@query("split_valid", "SELECT folder, path, NOT (k % 6 = 0 OR k % 7 = 3) AND NOT deleted AS valid FROM fx_files")
def _(spark, sf):
    f = fixture(spark, sf, "files").withColumn("seq", F.when(F.col("k") % 7 == 3, -1).otherwise(F.col("k"))).withColumn("hash", F.when(F.col("k") % 6 == 0, "zz").otherwise(F.col("hash")))
    good, bad = inventory.split_valid(f.withColumn("size", F.col("size") + 1))
    return good.select("folder", "path", F.lit(True).alias("valid")).unionByName(bad.select("folder", "path", F.lit(False).alias("valid")))


@query("history_rows", "SELECT folder, source, batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY seq) - 1 AS INTEGER) AS position, path FROM fx_batch_entries")
def _(spark, sf):
    b = fixture(spark, sf, "batch_entries")
    g = b.groupBy("folder", "source", "batch").agg(F.max("recorded_at").alias("recorded_at"), F.sort_array(F.collect_list(F.struct("seq", "path"))).alias("entries"))
    return inventory.history_rows(g)[1].select("folder", "source", "batch", "position", "path")


_SESSION = "sum(CASE WHEN at_us - before >= {gap} OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY at_us ROWS UNBOUNDED PRECEDING)"


def _sessions(keys: str, gap: int, where: str) -> str:
    return f", b AS (SELECT *, lag(at_us) OVER (PARTITION BY {keys} ORDER BY at_us) AS before FROM fx_changes WHERE {where}), s AS (SELECT *, {_SESSION.format(gap=gap, keys=keys)} AS session FROM b)"


@query("debounce_paths", _sessions("folder, path", 2000000, "kind <> 'open'") + " SELECT folder, path, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS n FROM s GROUP BY folder, path, session")
def _(spark, sf):
    c = fixture(spark, sf, "changes").withColumn("ts", F.timestamp_micros("at_us"))
    d = events.debounce_paths(c)
    return d.select("folder", "path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("peer_liveness", _sessions("peer", 45000000, "TRUE") + " SELECT peer AS node, min(at_us) AS from_us, max(at_us) AS to_us, count(*) AS beats FROM s GROUP BY peer, session")
def _(spark, sf):
    c = fixture(spark, sf, "changes").select(F.col("peer").alias("node"), F.timestamp_micros("at_us").alias("ts"))
    return events.peer_liveness(c).select("node", F.unix_micros("up_from").alias("from_us"), F.unix_micros("up_to").alias("to_us"), "beats")


@query("rescan_requests", ", l AS (SELECT DISTINCT folder, CASE WHEN folder = 'f2' AND size % 3 = 0 THEN '' ELSE path END AS path FROM fx_changes WHERE size % 10 = 0) SELECT folder, path FROM l WHERE path = '' OR folder NOT IN (SELECT folder FROM l WHERE path = '')")
def _(spark, sf):
    c = fixture(spark, sf, "changes").withColumn("path", F.when((F.col("folder") == "f2") & (F.col("size") % 3 == 0), None).otherwise(F.col("path")))
    return events.rescan_requests(c.withColumn("kind", F.when(F.col("size") % 10 == 0, "lost").otherwise("write")))
