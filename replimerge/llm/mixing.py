"""Mixing sources to target weights (operator 9): hash-random order, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, join_per_key, materialize, n_words, table

#: Hex digits of the key that tell its range.
_RANGE_DIGITS = 8
#: Sources whose cuts are broadcast at most (about 200 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source: ``source, source_size, source_rows, target``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all sizes.
    No target exceeds ``epochs`` times its source's size; what is cut off goes to the others by
    weight. That water level is the largest of the levels left after capping the first k sources
    in order of cap per weight, so one pass over the (few) sources finds it.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    per_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn("weight", F.get(kinds, (F.row_number().over(every) - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(whole))
    )
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    return (
        per_source.withColumn("level", (F.col("pool") - before) / left)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight")))
        .select("source", "source_size", "source_rows", "target")
    )


def with_source(rows: DataFrame, per_source: DataFrame, source: str, n: str, broadcast_sources: int) -> DataFrame:
    """``rows`` with the columns of the one ``per_source`` row of its source, null being a source like others.

    ``per_source`` has the source in the column ``source`` and the number of its rows in ``n``; both are dropped.
    """
    if per_source.count() <= broadcast_sources:
        return rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col(source))).drop(source, n)
    key = fresh(rows, "__of")
    named = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c), F.lit("")))
    kept = per_source.withColumn(key, named(source)).drop(source)
    return join_per_key(rows.withColumn(key, named("source")), kept, key, n).drop(key, n)


def source_cuts(rows: DataFrame, weights: tuple[int, ...], share: float, epochs: int, range_rows: int, broadcast_sources: int) -> DataFrame:
    """Where each source of ``rows`` (``source, size, key, salt``) is cut: ``s, rows, source_size, target, whole, at, part``.

    A source's rows, in the order of (key, size, salt), are taken ``whole`` times each; those before
    ``at`` once more, and at ``at`` ``part`` words of each row. The rows of a source are summed by
    ranges of the uniform key, about ``range_rows`` each; the sums tell the range in which the cut
    lies, and only that range is sorted. So no source, however large, is sorted in one task.
    """
    targets = source_targets(rows.select("source", "size"), weights, share, epochs).withColumnRenamed("source", "s")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    targets = materialize(targets.withColumn("pieces", F.ceil(F.col("source_rows") / range_rows)), "mix-targets")
    piece = F.floor(F.conv(F.substring("key", 1, _RANGE_DIGITS), 16, 10).cast("long") * F.col("pieces") / F.lit(16**_RANGE_DIGITS)).cast("long")
    ranged = with_source(rows, targets.select("s", "source_rows", "pieces"), "s", "source_rows", broadcast_sources).withColumn("range", piece)
    ranged = materialize(ranged.select("source", "range", "size", "key", "salt"), "mix-ranges")
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.col("source").eqNullSafe(F.col("s"))
    cut_range = sums.join(targets.select("s", "rest"), own).where("rest > before and rest <= before + n").select("s", "range", "rest", "before")
    cut_range = materialize(cut_range.withColumnRenamed("range", "r"), "mix-cuts")
    near = ranged.join(F.broadcast(cut_range) if cut_range.count() <= broadcast_sources else cut_range, own & (F.col("range") == F.col("r")))
    equal = near.groupBy("s", "rest", "before", F.struct("key", "size", "salt").alias("at")).agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("n"))
    so_far = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    cut = equal.where("rest > before and rest <= before + n").select(F.col("s").alias("c"), "at", F.floor((F.col("rest") - F.col("before")) / F.col("m")).cast("long").alias("part"))
    joined = targets.join(cut, F.col("s").eqNullSafe(F.col("c")), "left")
    return materialize(joined.select("s", F.col("source_rows").alias("rows"), "source_size", "target", "whole", "at", "part"), "mix-cuts")


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    range_rows: int = 5_000,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Cut every source of ``docs`` (``doc_id, source, text``) to its target number of words.

    Each row gets a key, the MD5 of seed and doc_id. A source runs whole epochs while its target
    lasts, then takes rows in key order, the one on the boundary in part: its taken words are
    exactly ``floor(target)``. Where a source is cut is worked out from narrow rows (see
    :func:`source_cuts`); ``taken`` is then a column over ``docs``, of which nothing is shuffled.

    Adds ``size, source_size, target, taken`` (columns of those names are replaced) and keeps all
    rows and other columns, whatever their names. Null text has size 0; null source is a source of
    its own; rows without doc_id share a key and are told apart by their text's hash; rows that repeat
    count each, and equal rows on the boundary share its words evenly, rounded down; an empty table
    gives an empty result.
    """
    own = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}]
    words = (n_words(F.col("text")) if size is None else size).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    salt = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    row = F.struct(key.alias("key"), words.alias("size"), salt.alias("salt"))
    narrow = materialize(docs.select("source", row.alias("row")).select("source", "row.*"), "mix-rows")
    cuts = source_cuts(narrow, weights, share, epochs, range_rows, broadcast_sources).withColumnsRenamed({"source_size": "total"})
    # The rows' own columns stay in a struct, so that none of their names can clash.
    kept = docs.select(F.struct(*own).alias("doc"), "source", row.alias("row"))
    part = F.when(F.col("row") < F.col("at"), F.col("row.size")).when(F.col("row") == F.col("at"), F.col("part")).otherwise(0)
    taken = F.col("whole") * F.col("row.size") + part
    found = with_source(kept, cuts, "s", "rows", broadcast_sources)
    return found.select("doc.*", F.col("row.size").alias("size"), F.col("total").alias("source_size"), "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"))
    return mix_sources(materialize(docs, "mix-sizes"), size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 2 AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS pool FROM sums),
levels AS (
  SELECT *, (pool - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
cut AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS full_epochs,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(full_epochs * size + least(greatest(budget - full_epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM cut
"""
