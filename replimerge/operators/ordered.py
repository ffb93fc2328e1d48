"""Running sums and maxima in a group's own order, where one group may hold most rows; and greedy cuts along such an order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import fresh, written

#: Rows of a group that one task sorts and folds; groups of more are folded in ranges of the order.
ROWS = 1_000_000


def running(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, before: str, total: str | None = None, fold: str = "sum", most: int = ROWS) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the rows ahead in the group's ``order``, and ``total``, that of the group.

    With ``fold="max"`` the greatest value instead, null if there is none ahead; a sum of none is 0.
    ``order`` may be of any type, and must tell all rows apart where that matters.

    Groups are counted first. If none has more than ``most`` rows, one window does. Else all rows are
    dealt by range of (``keys``, ``order``) and written, so that a range stays the range it was; each
    is folded apart, and what the ranges ahead have of a group is added. Only groups that span
    ranges need that, two a range at most, so what is broadcast is bounded by the number of ranges.
    """
    agg = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max}[fold]
    over = {"sum": lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), "max": lambda c, w: F.max(c).over(w)}[fold]
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest}[fold]

    def folded(rows: DataFrame, by: list[str]) -> DataFrame:
        own = Window.partitionBy(*by)
        out = rows.withColumn(before, over(value, own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
        return out.withColumn(total, over(value, own)) if total else out

    n = fresh(df, "__rows")
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > most).isEmpty():
        return folded(df, keys)
    piece, ahead, every, part = (fresh(df, c) for c in ("__piece", "__ahead", "__all", "__part"))
    dealt = written(df.repartitionByRange(*keys, *order).withColumn(piece, F.spark_partition_id()), "ordered")
    sums = dealt.groupBy(*keys, piece).agg(agg(value).alias(part))
    group = Window.partitionBy(*keys)
    ahead_of = over(F.col(part), group.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    known = sums.withColumns({ahead: ahead_of, every: over(F.col(part), group), n: F.count(F.lit(1)).over(group)}).where(F.col(n) > 1)
    known = known.select(*[F.col(k).alias(f"{part}_{k}") for k in keys], F.col(piece).alias(f"{part}_"), ahead, every)
    same = F.col(piece) == F.col(f"{part}_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{part}_{k}"))
    out = folded(dealt, [*keys, piece]).join(F.broadcast(known), same, "left").withColumn(before, both(F.col(before), F.col(ahead)))
    if total:
        out = out.withColumn(total, F.coalesce(every, total))
    return out.select(*df.columns, before, *([total] if total else []))


def row_number(df: DataFrame, keys: list[str], order: list[Column | str], out: str, most: int = ROWS) -> DataFrame:
    """Adds ``out``, the row's number from 1 in its group's ``order``."""
    return running(df, keys, order, F.lit(1), out, most=most).withColumn(out, F.col(out) + 1)


def greedy_cuts(rows: DataFrame, keys: list[str], position: str, value: str, following: Callable[[np.ndarray, np.ndarray], np.ndarray], span: int, reach: int) -> DataFrame:
    """``keys, position, cut_no, cut_at`` (both long): the greedy parts along each group's ``position`` (>= 0, distinct).

    The first part begins at the first row; where a part that begins at row i ends is what
    ``following(positions, values)`` says: for each row the index of the row that begins the next
    part (the number of rows for none), above its own, no more than ``reach`` positions on.
    ``cut_no`` counts a row's part from 0, ``cut_at`` is the position at which the part begins.

    Positions are cut into chunks of ``span``, each dealt with the ``reach`` positions behind it (so no
    task holds more, one group or not). A chunk tells of every row at which a part may be the first
    to begin in it, those in its first ``reach`` positions, where the first part beyond the chunk
    then begins and how many parts lie between. These steps are composed by pointer doubling, so
    where each chunk's first part begins is known after log2(chunks) joins, and the chunks are then
    numbered apart.
    """
    if span <= reach:
        raise ValueError("a chunk must be longer than a part reaches")
    types = {f.name: f.dataType for f in rows.schema.fields}
    key_fields = [T.StructField(k, types[k]) for k in keys]
    own = F.floor(F.col(position) / span).cast("long")
    chunks = F.when((own > 0) & (F.col(position) % span < reach), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.select(*keys, F.col(position).cast("long").alias("p"), F.col(value).cast("long").alias("v"), F.explode(chunks).alias("chunk"))

    def ends(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        b = b.sort_values("p")
        p, v, end = b["p"].to_numpy(), b["v"].to_numpy(), (int(b["chunk"].iloc[0]) + 1) * span
        return p, v, following(p, v), int(np.searchsorted(p, end))

    def steps(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        p, _, after, n = ends(b)
        to, count = np.append(after, len(p)), np.append(np.ones(len(p), np.int64), 0)
        while True:  # rows from n on lie beyond the chunk
            inside = to < n
            if not inside.any():
                break
            count = np.where(inside, count + count[np.minimum(to, len(p))], count)
            to = np.where(inside, to[np.minimum(to, len(p))], to)
        first = key[-1] * span
        begins = np.flatnonzero(p[:n] < first + reach) if key[-1] else np.arange(min(n, 1))
        exits = [None if t >= len(p) else int(p[t]) for t in to[begins]]
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "chunk": key[-1], "p": p[begins], "exit": pd.array(exits, "Int64"), "parts": count[begins]})

    step_type = T.StructType([*key_fields, *T.StructType.fromDDL("chunk long, p long, exit long, parts long").fields])
    maps = written(dealt.groupBy(*keys, "chunk").applyInPandas(steps, step_type), "cut-steps")
    lead = maps.groupBy(*keys).agg(F.min("chunk").alias("lead"))
    known = maps.join(lead, keys).where("chunk = lead").groupBy(*keys, "chunk").agg(F.min("p").alias("p")).withColumn("number", F.lit(0).cast("long"))
    known, far = written(known, "cut-chunks"), 1
    most = maps.groupBy(*keys).agg((F.max("chunk") - F.min("chunk")).alias("n")).agg(F.max("n")).first()[0] or 0
    while far <= most:
        onward = known.join(maps, [*keys, "chunk", "p"]).where("exit is not null")
        onward = onward.select(*keys, (F.col("chunk") + far).alias("chunk"), F.col("exit").alias("p"), (F.col("number") + F.col("parts")).alias("number"))
        known = written(known.unionByName(onward), "cut-chunks")
        far *= 2
        if far <= most:
            then = maps.select(*keys, (F.col("chunk") - far // 2).alias("chunk"), F.col("p").alias("exit"), F.col("exit").alias("to"), F.col("parts").alias("more"))
            maps = written(maps.join(then, [*keys, "chunk", "exit"]).select(*keys, "chunk", "p", F.col("to").alias("exit"), (F.col("parts") + F.col("more")).alias("parts")), "cut-steps")

    def numbered(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        p, _, after, n = ends(b)
        begin, number = b["begin"].iloc[0], b["number"].iloc[0]
        cuts = []
        at = len(p) if pd.isna(begin) else int(np.searchsorted(p, int(begin)))
        while at < n:
            cuts.append(at)
            at = int(after[at])
        part = np.searchsorted(cuts, np.arange(n), "right") - 1
        begins = pd.array([int(p[cuts[x]]) if x >= 0 else None for x in part], "Int64") if cuts else pd.array([None] * n, "Int64")
        base = 0 if pd.isna(number) else int(number)
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "p": p[:n], "part": part + base, "known": [bool(cuts) or not pd.isna(number)] * n, "begin": begins, "chunk": key[-1]})

    starts = known.select(*keys, "chunk", F.col("p").alias("begin"), "number")
    out_type = T.StructType([*key_fields, *T.StructType.fromDDL("p long, part long, known boolean, begin long, chunk long").fields])
    told = dealt.join(starts, [*keys, "chunk"], "left").groupBy(*keys, "chunk").applyInPandas(numbered, out_type)
    # Rows ahead of the first part that begins in their chunk belong to the last one that begins before it.
    told = written(told, "cut-rows")
    last = told.where("begin is not null").groupBy(*keys, "chunk").agg(F.max("part").alias("last"), F.max("begin").alias("last_begin"))
    last = last.withColumn("chunk", F.col("chunk") + 1)
    j = told.join(last, [*keys, "chunk"], "left")
    return j.select(*keys, F.col("p").alias(position), F.when(F.col("begin").isNull(), F.col("last")).otherwise(F.col("part")).alias("cut_no"), F.coalesce("begin", "last_begin").alias("cut_at"))
