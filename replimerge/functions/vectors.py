"""Version vectors as ``map<string,bigint>`` columns: node to counter, absent meaning 0.

Vectors are partially ordered, so none of this sorts them; :func:`vv_key` gives text for equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAX = (1 << 63) - 1


def _at(v: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(v, node), F.lit(0).cast("long"))


def _exceeds(a: Column, b: Column) -> Column:
    """True if some counter of ``a`` is above that of ``b``."""
    return F.exists(F.map_entries(a), lambda e: e["value"] > _at(b, e["key"]))


def vv_compare(a: Column, b: Column) -> Column:
    """V1: ``equal``, ``dominates``, ``dominated`` or ``concurrent``."""
    more, less = _exceeds(a, b), _exceeds(b, a)
    return F.when(more & less, "concurrent").when(more, "dominates").when(less, "dominated").otherwise("equal")


def vv_dominates_or_equals(a: Column, b: Column) -> Column:
    """V2: every counter of ``b`` is reached in ``a``."""
    return F.forall(F.map_entries(b), lambda e: e["value"] <= _at(a, e["key"]))


def vv_dominates(a: Column, b: Column) -> Column:
    """V2: :func:`vv_dominates_or_equals` and not equal."""
    return vv_dominates_or_equals(a, b) & _exceeds(a, b)


def vv_canonical(v: Column) -> Column:
    """V8: without zero counters."""
    return F.map_filter(v, lambda _, n: n > 0)


def vv_valid(v: Column) -> Column:
    """V8: no negative counter and no empty node."""
    return F.forall(F.map_entries(v), lambda e: (e["value"] >= 0) & (e["key"] != ""))


def vv_key(v: Column) -> Column:
    """V8: canonical text ``node:counter,...`` by node, equal exactly for equal vectors."""
    entries = F.sort_array(F.map_entries(vv_canonical(v)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


def vv_merge(a: Column, b: Column) -> Column:
    """V3: larger counter of each node."""
    zero = F.lit(0).cast("long")
    return vv_canonical(F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero))))


def vv_increment(v: Column, node: Column) -> Column:
    """V4: one more on ``node``'s counter, saturating."""
    up = F.create_map(node, F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    return F.map_zip_with(v, up, lambda _, x, y: F.when(x == _MAX, x).otherwise(F.coalesce(x, zero) + F.coalesce(y, zero)))


def vv_merge_agg(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """V3 over groups: ``keys, version``. Both steps combine before they shuffle; the map has a row's worth of nodes."""
    counters = df.select(*keys, F.explode_outer(version).alias("__n", "__c")).groupBy(*keys, "__n").agg(F.max("__c").alias("__c"))
    pairs = F.collect_list(F.when(F.col("__c") > 0, F.struct("__n", "__c")))
    return counters.groupBy(*keys).agg(F.map_from_entries(F.sort_array(pairs)).alias(version))


def frontier(df: DataFrame, keys: list[str], version: str = "version", parts: int = 64) -> DataFrame:
    """V9: rows whose version no other version of the same ``keys`` dominates.

    Copies of a version count once. The versions of a key are dealt to ``parts`` by hash, each part
    is reduced to what nothing in it dominates, and these are reduced again together: domination
    is transitive, so what a part drops could drop nothing more. A task holds one key's part, then
    one key's survivors: their frontier and no more than ``parts`` of each chain; a node's own
    versions of a path follow each other, so a frontier is no wider than the nodes that wrote it.
    """
    own = df.withColumn("__vk", vv_key(F.col(version)))
    kinds = own.groupBy(*keys, "__vk").agg(F.first(version).alias("__v"))

    def reduced(rows: DataFrame, by: list) -> DataFrame:
        held = rows.groupBy(*by).agg(F.collect_list(F.struct("__vk", "__v")).alias("__l"))
        top = F.filter("__l", lambda x: ~F.exists("__l", lambda y: vv_dominates(y["__v"], x["__v"])))
        return held.select(*keys, F.explode(top).alias("__x")).select(*keys, "__x.*")

    some = reduced(kinds.withColumn("__part", F.pmod(F.xxhash64("__vk"), F.lit(parts))), [*keys, "__part"])
    top = reduced(some, keys).select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__vk").alias("__o"))
    same = F.col("__vk") == F.col("__o")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    return own.join(top, same, "left_semi").drop("__vk")
