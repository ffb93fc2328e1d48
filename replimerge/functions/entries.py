"""Predicates and projections over entries: one version of one path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIRECT_LIMIT, EMPTY, KIND_RANK, RELAY_LIMIT, SETTLE_NS, TIER_RANK


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def rank(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, r in ranks.items():
        out = F.when(column == name, r).otherwise(out)
    return out


def normalise_observation(df: DataFrame) -> DataFrame:
    """Directories have no size, content, exec bit or mtime; symlinks no exec bit or mtime."""
    is_dir, plain = F.col("kind") == "dir", F.col("kind") == "file"
    return df.withColumns(
        {
            "size": F.when(is_dir, 0).otherwise(F.col("size")).cast("long"),
            "hash": F.when(is_dir, EMPTY).otherwise(F.col("hash")),
            "exec": F.when(plain, F.col("exec")).otherwise(False),
            "mtime_ns": F.when(plain, F.col("mtime_ns")).otherwise(0).cast("long"),
        }
    )


def unchanged_by_stat(a: str, b: str) -> Column:
    """The stat of the observation ``a`` (column prefix) matches the record ``b``, which must be live."""
    kind = _c(a, "kind")
    file_same = (_c(a, "size") == _c(b, "size")) & (_c(a, "mtime_ns") == _c(b, "mtime_ns")) & (_c(a, "exec") == _c(b, "exec"))
    link_same = _c(a, "hash") == _c(b, "hash")
    same = F.when(kind == "file", file_same).when(kind == "dir", F.lit(True)).otherwise(link_same)
    return F.coalesce(~_c(b, "deleted") & (kind == _c(b, "kind")) & same, F.lit(False))


def same_content(a: str, b: str) -> Column:
    """Kind and hash (and exec bit of files) agree; two tombstones always do."""
    live = (_c(a, "kind") == _c(b, "kind")) & (_c(a, "hash") == _c(b, "hash")) & ((_c(a, "kind") != "file") | (_c(a, "exec") == _c(b, "exec")))
    return F.when(_c(a, "deleted") & _c(b, "deleted"), True).when(_c(a, "deleted") | _c(b, "deleted"), False).otherwise(live)


def is_metadata_only(prefix: str = "") -> Column:
    """The step left the content as it was."""
    return _c(prefix, "hash") == _c(prefix, "prev_hash")


def is_live(prefix: str = "") -> Column:
    """P10."""
    return ~_c(prefix, "deleted")


def is_tracked(prefix: str = "") -> Column:
    """P10: live and no directory."""
    return is_live(prefix) & (_c(prefix, "kind") != "dir")


def tracked_count(entries: DataFrame) -> DataFrame:
    """P10: ``folder, node, tracked``."""
    return entries.groupBy("folder", "node").agg(F.count_if(is_tracked()).alias("tracked"))


def size_allowed(tier: Column, size: Column, direct: Column | int = DIRECT_LIMIT, relay: Column | int = RELAY_LIMIT) -> Column:
    """What a tier lets through, limits included."""
    d, r = (x if isinstance(x, Column) else F.lit(x) for x in (direct, relay))
    return F.when(tier == "lan", True).when(tier == "direct", size <= d).otherwise(size <= r)


def least_tier(size: Column) -> Column:
    """The least demanding tier that lets ``size`` through."""
    return F.when(size <= RELAY_LIMIT, "relay").when(size <= DIRECT_LIMIT, "direct").otherwise("lan")


def tier_rank(tier: Column) -> Column:
    return rank(tier, TIER_RANK)


def valid_host(host: Column) -> Column:
    """P12."""
    return host.rlike("^[a-z0-9-]{0,63}$")


def settled(ctime_ns: Column, now_ns: Column) -> Column:
    """The inode has not changed for two seconds."""
    return now_ns - ctime_ns >= SETTLE_NS


def packed(text: Column) -> Column:
    """A digest as its 32 bytes, half of what it has as text, which no codec of shuffles makes up for. Any other text is there too, behind 33 zero bytes."""
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(text)).otherwise(F.concat(F.lit(bytes(33)), F.encode(text, "UTF-8")))


def unpacked(data: Column) -> Column:
    """The text that :func:`packed` was given."""
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(F.decode(F.substring(data, 34, 2147483647), "UTF-8"))


def dealt_by_path(df: DataFrame) -> DataFrame:
    """``df`` shuffled by folder and path; its digests go packed."""
    digests = [c for c in ("hash", "prev_hash") if c in df.columns]
    there = df.withColumns({c: packed(F.col(c)) for c in digests}).repartition("folder", "path")
    return there.withColumns({c: unpacked(F.col(c)) for c in digests})


def for_comparison(df: DataFrame) -> DataFrame:
    """``df`` with no more than versions of other content are compared by, for the side of a comparison that is not kept.

    What ranks behind the exec bit decides nothing between versions of other content, one of them live and both of
    known kinds: there is no size and host, and of ``prev_hash`` only whether it is the hash (if not, a short stand-in that is none either).
    """
    known = F.coalesce(F.col("kind").isin(*KIND_RANK), F.lit(False))
    stand_in = F.when(F.col("hash") != EMPTY, EMPTY).otherwise("")
    return df.withColumns(
        {
            "prev_hash": F.when(known & (F.col("prev_hash") != F.col("hash")), stand_in).otherwise(F.col("prev_hash")),
            "size": F.when(~known, F.col("size")),
            "author_host": F.when(~known, F.col("author_host")),
        }
    )


def winner_key(prefix: str = "", edited: Column | None = None) -> Column:
    """M3: a struct whose order is the winner rule; the greater one wins. ``edited``: whether the hash is another than the one before, where that is known by itself."""
    c = lambda n: _c(prefix, n)
    return F.struct(
        c("stamp").alias("stamp"),
        (~c("deleted")).alias("live"),
        (c("hash") != c("prev_hash") if edited is None else edited).alias("edited"),
        c("mtime_ns").alias("mtime_ns"),
        c("modified_by").alias("modified_by"),
        c("hash").alias("hash"),
        rank(c("kind"), KIND_RANK).alias("kind_rank"),
        c("exec").alias("exec"),
        c("size").alias("size"),
        c("prev_hash").alias("prev_hash"),
        c("author_host").alias("author_host"),
    )


def next_stamp(prev: Column, kind: Column, mtime_ns: Column, content_changed: Column) -> Column:
    """V5: beyond the previous stamp; a content change of a file also reaches its mtime. First record: a file's mtime, else 1."""
    changed_file = (kind == "file") & content_changed
    return F.when(prev.isNull(), F.when(kind == "file", mtime_ns).otherwise(F.lit(1))).when(changed_file, F.greatest(mtime_ns, prev + 1)).otherwise(prev + 1)
