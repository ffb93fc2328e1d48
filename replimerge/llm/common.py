"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh as fresh
from ..sources.shared import shared_dir

#: White space is these six code points; a word is a run of anything else.
SPACE_CHARS = " \t\n\u000b\u000c\r"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` as Parquet in the shared folder: its path, and the rows read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage without tying it to an executor: a lost executor costs only the tasks it ran.
    The files stay while the rows may be read; :func:`..sources.shared.scratch` bounds that.
    """
    return written(df, name)[1]


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n: str = "n", how: str = "inner", total: int | None = None, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a ``key`` and ``n``, the number of ``rows`` of that key.

    Fewer than ``share`` keys can have more than a ``share``-th of all rows each. These are broadcast,
    so that no task gets the rows of a hot key; the others are joined by shuffle. ``rows`` is read
    twice then; ``per_key`` is written first, so it is worked out once. ``total``: the number of
    ``rows``, if it is known.
    """
    per_key = materialize(per_key, "per-key")
    total = (per_key.agg(F.sum(n)).first()[0] or 0) if total is None else total
    hot = per_key.where(F.col(n) > total / share)
    if hot.isEmpty():
        return rows.join(per_key, key, how)
    few = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.where(F.col(n) <= total / share), key, how)
    return rows.join(few, key).unionByName(cold)


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null and for text without a word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.filter(F.split(trimmed, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words (long); null counts as no text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once.

    An array column that a lambda refers to is worked out again for every element once the optimizer
    has moved the lambda into the projection or filter that makes the array; a lambda's own variable
    is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def shingle_hashes(word_hashes: Column, k: int = 5) -> Column:
    """Hash of each run of ``k`` words, from the words' hashes; empty below ``k`` words."""

    def runs(w: Column) -> Column:
        last = F.size(w) - k
        hashed = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))

    return let(word_hashes, runs)


def hash_masks(n: int) -> list[int]:
    """``n`` 64-bit constants with evenly spread leading bits, for XOR-permuted MinHash.

    With ``h`` uniform, ``argmin(h ^ mask)`` is the element nearest to the mask, so masks that differ
    early pick from different parts of the hash range and the minima are close to independent.
    """
    golden, out = 0x9E3779B97F4A7C15, []
    for i in range(n):
        low = (i + 1) * golden * 0xD1B54A32D192ED03 % 2**64 >> 16
        mask = (i * 2**64 // n + (low % (2**64 // n))) % 2**64
        out.append(mask - 2**64 if mask >= 2**63 else mask)
    return out


def bands_needed(similarity: float, miss: float, rows: int = 1) -> int:
    """Fewest bands of ``rows`` MinHashes that miss a pair of this Jaccard similarity with probability <= ``miss``."""
    n, p = 1, 1 - similarity**rows
    while p**n > miss:
        n += 1
    return n


def thinned(df: DataFrame, keys: list[str], rows: float) -> DataFrame:
    """About ``rows`` rows of ``df``, all if it has no more: those whose hash of ``keys`` is low enough.

    For fits with a bound. A plain top-k by hash has every task send k rows, which grows with the
    number of tasks; after this the whole job sends about ``rows``.
    """
    n = df.count()
    uniform = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return df if n <= rows else df.where(uniform < rows / n)


def percentile_of_counts(counts: DataFrame, p: float, cells: int = 1000) -> float | None:
    """The exact percentile ``p`` of ``counts`` (``value`` double, ``n``: how often it occurs), as ``F.percentile``; None without rows.

    ``F.percentile`` gathers all values in one task. Here the range that has the rank is cut into
    ``cells``, whose sums come to the driver, until it has one value. ``counts`` is read a few times,
    so pass a written table.
    """
    n, least, most = counts.agg(F.sum("n"), F.min("value"), F.max("value")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        low, high, ahead = least, most, 0
        while low < high:
            cell = F.least(F.floor((F.col("value") - low) / (high - low) * cells), F.lit(cells - 1))
            found = counts.where(F.col("value").between(low, high)).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            for r in sorted(found.collect()):
                low, high = r.low, r.high
                if ahead + r.n > rank:
                    break
                ahead += r.n
        return low

    place = (n - 1) * p
    lower = at(math.floor(place))
    if place == math.floor(place):
        return lower
    upper = at(math.ceil(place))
    return lower if lower == upper else (math.ceil(place) - place) * lower + (place - math.floor(place)) * upper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
