"""Peers and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRIVATE = r"^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def classify_tier(peers: DataFrame) -> DataFrame:
    """Adds ``tier``: a direct private IPv4 or link-local address (fe80::/10 too) is lan, any other direct one direct, else relay. IPv4-mapped addresses count as IPv4."""
    addr = F.regexp_replace("direct_addr", "(?i)^::ffff:", "")
    tier = F.when(addr.isNull() | (addr == ""), "relay").when(addr.rlike(_PRIVATE) & addr.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "lan").when(addr.rlike("(?i)^fe[89ab][0-9a-f]:"), "lan").otherwise("direct")
    return peers.withColumn("tier", tier)


def trusted_peers(peers: DataFrame, me: str, trusted: DataFrame) -> DataFrame:
    """Adds ``trusted``: untagged peers of the same user; tagged ones only if listed (``node``)."""
    t = trusted.select("node", F.lit(True).alias("__t")).distinct()
    j = peers.join(t, "node", "left")
    ok = F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, F.col("user") == me).otherwise(F.coalesce("__t", F.lit(False)))
    return j.withColumn("trusted", ok).drop("__t")


def binding_conflicts(hellos: DataFrame) -> DataFrame:
    """Node ids seen from more than one platform id: cloned state."""
    g = hellos.groupBy("node").agg(F.count_distinct("stable_id").alias("platforms"), F.min("stable_id").alias("first_id"))
    return g.where("platforms > 1")


def clock_skew(hellos: DataFrame, limit_us: int = 300_000_000) -> DataFrame:
    """Hellos whose clock is more than five minutes off, with ``skew_us``."""
    return hellos.withColumn("skew_us", F.col("peer_us") - F.col("received_us")).where(F.abs("skew_us") > limit_us)


def members(folders: DataFrame, machines: DataFrame) -> DataFrame:
    """Each folder's roster with the machines' names; unknown machines stay, without one."""
    return folders.select("folder", "node", "mode").join(machines.select("node", "host"), "node", "left")
