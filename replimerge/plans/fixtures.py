"""Tables of the data model derived from the driver's tables, as SQL that Spark and DuckDB both read.

``SHA[[x]]`` stands for the SHA-256 hex digest and is put into either dialect by :func:`render`.
Version vectors are columns ``c_n0, c_n1, c_n2`` here; :func:`with_version` makes the map.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Z64 = "repeat('0', 64)"
#: Some directories and links among the files.
KIND = "CASE WHEN p_partkey % 23 = 5 THEN 'symlink' WHEN p_partkey % 23 = 6 THEN 'dir' ELSE 'file' END"

SQL: dict[str, str] = {}
USES: dict[str, tuple[str, ...]] = {}


def _define(name: str, uses: tuple[str, ...], sql: str) -> None:
    USES[name], SQL[name] = uses, sql


_define(
    "replicas",
    ("orders",),
    f"""
SELECT folder, path, node, k, r, e, kind, CASE WHEN deleted OR kind = 'dir' THEN 0 ELSE k % 1000 + 10 * e + 1 END AS size, CASE WHEN deleted OR kind = 'file' THEN mtime_ns ELSE 0 END AS mtime_ns, stamp,
       k % 7 = 0 AND NOT deleted AND kind = 'file' AS exec, CASE WHEN deleted OR kind = 'dir' THEN {Z64} ELSE h END AS hash, CASE WHEN e > 0 THEN SHA[[path]] ELSE {Z64} END AS prev_hash,
       deleted, CASE WHEN e > 0 THEN node ELSE 'n0' END AS modified_by, CASE WHEN e > 0 THEN 'host' || CAST(r AS STRING) ELSE 'host0' END AS author_host, c_n0, c_n1, c_n2
FROM (
  SELECT *, CASE WHEN e = 0 THEN SHA[[path]] WHEN k % 5 = 0 THEN SHA[[path || '|' || CAST(e AS STRING)]]
                 ELSE SHA[[path || '|' || CAST(r AS STRING) || '|' || CAST(e AS STRING)]] END AS h,
         e > 0 AND (k + r) % 11 = 0 AS deleted, CASE WHEN k % 20 = 17 AND NOT (e > 0 AND r = 1) THEN 'dir' WHEN k % 20 = 19 AND NOT (e > 0 AND r = 2) THEN 'symlink' ELSE 'file' END AS kind
  FROM (
    SELECT 'f' || CAST(o_custkey % 8 AS STRING) AS folder, 'o' || CAST(k % 100 AS STRING) || '/' || CAST(k AS STRING) AS path,
           'n' || CAST(r AS STRING) AS node, k, r, e,
           1 + CASE WHEN r = 0 THEN e ELSE 0 END AS c_n0, CASE WHEN r = 1 THEN e ELSE 0 END AS c_n1, CASE WHEN r = 2 THEN e ELSE 0 END AS c_n2,
           1000000000 + k * 7 + CASE WHEN e > 0 THEN e * 1000 + r * (k % 2) ELSE 0 END AS stamp,
           1700000000000000000 + k * 1000003 + CASE WHEN e > 0 THEN e * 1000000000 + r ELSE 0 END AS mtime_ns
    FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(r AS BIGINT) AS r, CAST(floor(o_orderkey / p) AS BIGINT) % 3 AS e
          FROM orders CROSS JOIN (VALUES (0, 1), (1, 3), (2, 9)) AS v(r, p) WHERE o_orderkey % 13 <> r) a) b) c
""",
)
_define(
    "files",
    ("documents",),
    """
SELECT coalesce(source, 'none') AS folder, coalesce(lang, 'xx') || '/d' || CAST(doc_id AS STRING) || '.txt' AS path, 'n' || CAST(doc_id % 3 AS STRING) AS node, 'file' AS kind,
       CAST(BYTES[[coalesce(text, '')]] AS BIGINT) AS size, 1700000000000000000 + doc_id * 1000003 AS mtime_ns, doc_id % 7 = 0 AS exec,
       SHA[[coalesce(text, '')]] AS hash, doc_id % 11 = 0 AS deleted, doc_id AS k
FROM documents
""",
)
_define(
    "parts_index",
    ("part",),
    f"""
SELECT 'f' || CAST(p_partkey % 4 AS STRING) AS folder, 'n0' AS node, 'p' || CAST(p_size AS STRING) || '/' || CAST(p_partkey AS STRING) AS path, CAST(p_partkey AS BIGINT) AS k, {KIND} AS kind,
       CASE WHEN {KIND} = 'dir' THEN 0 ELSE CAST(p_size AS BIGINT) END AS size, CASE WHEN {KIND} = 'file' THEN 1700000000000000000 + CAST(p_partkey AS BIGINT) * 1000 ELSE 0 END AS mtime_ns, CAST(5000 + p_partkey AS BIGINT) AS stamp,
       p_partkey % 2 = 0 AND {KIND} = 'file' AS exec, CASE WHEN {KIND} = 'dir' THEN {Z64} ELSE SHA[[p_name]] END AS hash,
       {Z64} AS prev_hash, p_partkey % 17 = 0 AS deleted, 'n0' AS modified_by, 'host0' AS author_host, CAST(p_partkey % 3 + 1 AS BIGINT) AS c_n0, CAST(0 AS BIGINT) AS c_n1, CAST(0 AS BIGINT) AS c_n2
FROM part
""",
)
_define(
    "parts_scan",
    ("part",),
    f"""
SELECT folder, 'n0' AS node, 'b' || CAST(k % 3 AS STRING) AS bracket_id, path, state, CASE WHEN state = 'skipped' THEN 'unreadable' END AS skip_reason, kind, size, mtime_ns, exec, hash, 1800000000000000000 + k AS at_ns, k AS arrival
FROM (
  SELECT 'f' || CAST(p_partkey % 4 AS STRING) AS folder, 'p' || CAST(p_size AS STRING) || '/' || CAST(p_partkey AS STRING) AS path, CAST(p_partkey AS BIGINT) AS k,
         CASE WHEN p_partkey % 10 = 4 THEN 'skipped' ELSE 'observed' END AS state, {KIND} AS kind, CAST(p_size AS BIGINT) AS size,
         1700000000000000000 + CAST(p_partkey AS BIGINT) * 1000 + CASE WHEN p_partkey % 10 = 2 THEN 1 ELSE 0 END AS mtime_ns,
         CASE WHEN p_partkey % 10 = 3 THEN p_partkey % 2 <> 0 ELSE p_partkey % 2 = 0 END AS exec,
         CASE WHEN p_partkey % 10 = 1 THEN SHA[[p_name || '!']] ELSE SHA[[p_name]] END AS hash
  FROM part WHERE p_partkey % 10 <> 0 AND p_size <> 7
  UNION ALL
  SELECT DISTINCT 'f' || CAST(p_partkey % 4 AS STRING), 'p7', CAST(0 AS BIGINT), 'skipped', 'dir', CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, '' FROM part WHERE p_size = 7
  UNION ALL
  SELECT 'f' || CAST(p_partkey % 4 AS STRING), 'new/' || CAST(p_partkey AS STRING), CAST(p_partkey AS BIGINT), 'observed', 'file', CAST(1 AS BIGINT), CAST(7 AS BIGINT), FALSE, SHA[[p_name]] FROM part WHERE p_partkey % 50 = 0) a
""",
)
_define(
    "changes",
    ("events",),
    """
SELECT 'f' || CAST(user_id % 8 AS STRING) AS folder, 'n' || CAST(user_id % 3 AS STRING) AS node, 'u' || CAST(user_id AS STRING) || '/' || event_type AS path, CAST(floor(US[[ts]] / 1000) AS BIGINT) AS at_us,
       event_id % 3 <> 0 AS announced_live, event_id % 5 <> 0 AS now_live, SHA[[CAST(event_id AS STRING)]] AS hash, CAST(event_id % 1000 AS BIGINT) AS size, CAST(event_id AS BIGINT) AS arrival, event_type AS kind,
       'n' || CAST(user_id % 20 AS STRING) AS peer
FROM events
""",
)
_define(
    "batch_entries",
    ("orders",),
    f"""
SELECT *, CAST(floor((seq - 1) / 100) AS BIGINT) AS batch_no, folder || '-' || source || '-' || CAST(CAST(floor((seq - 1) / 100) AS BIGINT) AS STRING) AS batch
FROM (
  SELECT 'f' || CAST(o_custkey % 8 AS STRING) AS folder, 'n' || CAST(o_custkey % 4 AS STRING) AS source, 'n' || CAST(o_custkey % 4 AS STRING) AS node, 'o' || CAST(o_orderkey % 100 AS STRING) || '/' || CAST(o_orderkey AS STRING) AS path,
         CAST(o_orderkey AS BIGINT) AS k, CASE o_orderstatus WHEN 'O' THEN 'add' WHEN 'P' THEN 'modify' ELSE 'delete' END AS step, CAST(floor(o_totalprice) AS BIGINT) AS size,
         SHA[[CAST(o_orderkey % 97 AS STRING)]] AS hash, CASE WHEN o_orderkey % 4 = 0 THEN SHA[[CAST(o_orderkey % 97 AS STRING)]] ELSE {Z64} END AS prev_hash, o_orderkey % 29 = 0 AS exempt, o_orderstatus = 'F' AS deleted, 'file' AS kind,
         CAST(o_orderdate AS STRING) AS day, CAST(o_orderkey AS BIGINT) AS recorded_at,
         row_number() OVER (PARTITION BY o_custkey % 8, o_custkey % 4 ORDER BY o_orderdate, o_orderkey) AS seq
  FROM orders) a
""",
)
_define(
    "ranges",
    ("orders",),
    """
SELECT folder, source AS peer, 'n0' AS node, batch, min(seq) - 1 AS seq_low, max(seq) AS seq_high, SHA[[batch]] AS arrival
FROM (SELECT 'f' || CAST(o_custkey % 8 AS STRING) AS folder, 'n' || CAST(o_custkey % 4 AS STRING) AS source, CAST(floor((seq - 1) / 10) AS BIGINT) AS b, 'b' || CAST(o_custkey % 8 AS STRING) || '-' || CAST(o_custkey % 4 AS STRING) || '-' || CAST(CAST(floor((seq - 1) / 10) AS BIGINT) AS STRING) AS batch, seq
      FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey % 8, o_custkey % 4 ORDER BY o_orderdate, o_orderkey) AS seq FROM orders) s) t
WHERE b % 17 <> 16 OR folder = 'f0' GROUP BY folder, source, batch
""",
)
_define(
    "wants",
    ("lineitem",),
    f"""
SELECT 'f' || CAST(l_orderkey % 16 AS STRING) AS folder, 'n9' AS node, CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS path, 'file' AS kind,
       CAST(l_quantity * l_quantity * 1000000 AS BIGINT) AS size, SHA[[CAST(l_partkey AS STRING)]] AS hash, l_returnflag = 'R' AS deleted, CAST(l_partkey % 8 AS BIGINT) AS bits, CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS line, CAST(l_orderkey AS BIGINT) AS k
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) l
""",
)
_define(
    "trash",
    ("orders",),
    """
SELECT 'f' || CAST(o_custkey % 8 AS STRING) AS folder, 'n' || CAST(o_custkey % 3 AS STRING) AS node, 'o' || CAST(o_orderkey % 100 AS STRING) || '.txt' AS path, 'o' || CAST(o_orderkey % 100 AS STRING) || '.txt' AS original_path, 'file' AS kind,
       (CAST(US[[o_orderdate]] AS BIGINT) + o_orderkey % 1000) * 1000 AS trashed_at_ns, CAST(o_orderkey AS BIGINT) AS arrival, CAST(floor(o_totalprice) AS BIGINT) * 10000 AS size, SHA[[CAST(o_orderkey AS STRING)]] AS hash, 't/' || CAST(o_orderkey AS STRING) AS trashed_path
FROM orders
""",
)
_define(
    "peers",
    ("supplier",),
    """
SELECT 'n' || CAST(s_suppkey AS STRING) AS node, CAST(s_suppkey AS BIGINT) AS k, 's' || CAST(s_suppkey % 90 AS STRING) AS stable_id, 'u' || CAST(s_nationkey % 3 AS STRING) AS user, s_suppkey % 9 = 0 AS tagged,
       CASE s_suppkey % 6 WHEN 0 THEN '10.0.0.' || CAST(s_suppkey % 200 AS STRING) WHEN 1 THEN '172.16.1.' || CAST(s_suppkey % 200 AS STRING) WHEN 2 THEN '::ffff:192.168.0.7' WHEN 3 THEN '169.254.1.1' WHEN 4 THEN '8.8.8.8' END AS direct_addr,
       CAST(s_suppkey * 1000000 AS BIGINT) AS received_us, CAST(s_suppkey * 1000000 AS BIGINT) + CASE WHEN s_suppkey % 10 = 0 THEN 400000000 ELSE 200000000 END AS peer_us, s_suppkey % 4 <> 3 AS online
FROM supplier
""",
)


def render(sql: str, dialect: str) -> str:
    spark = dialect == "spark"

    def swap(tag: str, form: str, s: str) -> str:
        while (i := s.find(f"{tag}[[")) >= 0:
            n, j = 0, i
            while True:
                n += {"[": 1, "]": -1}.get(s[j], 0)
                if s[j] == "]" and n == 0:
                    break
                j += 1
            s = s[:i] + form.format(s[i + len(tag) + 2 : j - 1]) + s[j + 1 :]
        return s

    sql = swap("SHA", "sha2({}, 256)" if spark else "sha256({})", sql)
    sql = swap("BYTES", "octet_length({})" if spark else "strlen({})", sql)
    return swap("US", "unix_micros(CAST({} AS TIMESTAMP))" if spark else "epoch_us(CAST({} AS TIMESTAMP))", sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named derivation over the tables of ``sf_dir``."""
    for t in USES[name]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(render(SQL[name], "spark"))


def oracle(body: str) -> str:
    """DuckDB SQL: the fixtures that ``body`` names as ``{name}``, and ``body``."""
    names = [n for n in SQL if re.search(rf"\bfx_{n}\b", body)]
    return render("WITH RECURSIVE " + ", ".join(f"fx_{n} AS ({SQL[n]})" for n in names) + ("," if body.lstrip().startswith(",") else "") + body.lstrip().lstrip(","), "duckdb")


def with_version(df: DataFrame, nodes: tuple[str, ...] = ("n0", "n1", "n2"), out: str = "version") -> DataFrame:
    """The vector map from its counter columns."""
    pairs = F.create_map(*[x for n in nodes for x in (F.lit(n), F.col(f"c_{n}").cast("long"))])
    return df.withColumn(out, F.map_filter(pairs, lambda _, c: c > 0))


def counters(version: str = "version", nodes: tuple[str, ...] = ("n0", "n1", "n2"), prefix: str = "c_") -> list:
    """The counter columns of a vector map, for comparison with an oracle."""
    return [F.coalesce(F.try_element_at(F.col(version), F.lit(n)), F.lit(0).cast("long")).alias(f"{prefix}{n}") for n in nodes]
