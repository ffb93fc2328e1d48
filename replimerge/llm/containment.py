"""Short texts inside long ones: MinHash bands of shingle windows, then exact shingle containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bands_needed, hash_masks, materialize, shingle_hashes

SHINGLE = 5
#: Band rows of the searched items that are broadcast at most (about 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Tasks that the windows of one key are dealt to where keys are joined by shuffle.
SALTS = 8


@dataclass(frozen=True)
class SizeClass:
    """Items of at least ``least`` shingles are looked for by windows of ``width`` shingles, ``step`` apart."""

    least: int
    width: int
    step: int


def block_classes(widths: tuple[int, ...] = (1, 4, 8)) -> list[SizeClass]:
    """Windows side by side: a run of 2 * width - 1 shingles contains a whole one."""
    return [SizeClass(2 * w - 1 if w > 1 else 1, w, w) for w in widths]


def overlapping_classes(widths: tuple[int, ...] = (1, 4, 8)) -> list[SizeClass]:
    """Windows that overlap by half: a run of 1.5 * width - 1 shingles contains a whole one."""
    return [SizeClass(w + w // 2 - 1 if w > 1 else 1, w, max(1, w // 2)) for w in widths]


def worst_similarity(c: SizeClass, threshold: float) -> float:
    """Least Jaccard similarity of the best window of an item of which a share ``threshold`` is left.

    At the smallest size of the class one window lies within the item, and all that was changed may
    lie in that window.
    """
    lost = min((1 - threshold) * c.least, c.width - 1)
    return (c.width - lost) / (c.width + lost)


def norm_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that case and punctuation don't hide a passage."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``h``, the hashes of the five-word shingles of ``text`` in order."""
    hashed = df.select(key, F.transform(norm_words(F.col("text")), lambda w: F.xxhash64(w)).alias("__w"))
    return hashed.select(key, shingle_hashes(F.col("__w"), SHINGLE).alias("h"))


def _window_rows(df: DataFrame, keep: list[str], classes: list[tuple[SizeClass, int]], every_offset: bool) -> DataFrame:
    """``keep, key, pos``: a row for each window and band of the shingles ``h``.

    One row generator over a counter, with the window's place and band worked out from it, keeps
    this in generated code: no array of windows is ever built. An outer generator, because the
    filter that Spark derives from an inner one would work out ``h`` again below it.
    """
    n, bands = F.size("h"), max(b for _, b in classes)
    counts, start, bases = [], F.lit(0), []
    for c, _ in classes:
        step = 1 if every_offset else c.step
        fits = F.col("width") == c.width if every_offset else F.lit(True)
        counts.append(F.when(fits & (n >= c.width), (F.floor((n - c.width) / step) + 1) * bands).otherwise(0).cast("int"))
    for c in counts:
        bases.append(start)
        start = start + c
    bounded = df.select(*keep, "h", *[b.cast("int").alias(f"__b{i}") for i, b in enumerate(bases)], start.cast("int").alias("__all"))
    counter = F.when(F.col("__all") > 0, F.sequence(F.lit(0), F.col("__all") - 1))
    ids = bounded.select(*keep, "h", *[f"__b{i}" for i in range(len(bases))], F.explode_outer(counter).alias("__i"))
    base, wide, step = F.lit(0), F.lit(classes[0][0].width), F.lit(1 if every_offset else classes[0][0].step)
    for i, (c, _) in enumerate(classes):  # the last class whose base is reached
        here = F.col("__i") >= F.col(f"__b{i}")
        base, wide = F.when(here, F.col(f"__b{i}")).otherwise(base), F.when(here, F.lit(c.width)).otherwise(wide)
        step = step if every_offset else F.when(here, F.lit(c.step)).otherwise(step)
    masks = F.array(*[F.lit(m).cast("long") for m in hash_masks(bands)])
    placed = ids.select(*keep, "h", (F.col("__i") - base).alias("__l"), wide.alias("__w"), step.alias("__step"))
    placed = placed.select(*keep, "h", "__w", F.expr(f"(__l div {bands}) * __step").cast("int").alias("pos"), (F.col("__l") % bands).alias("__band"))
    placed = placed.select(*keep, "h", "__w", "pos", "__band", F.get(masks, F.col("__band")).alias("__mask"))
    at = lambda j: F.get("h", F.col("pos") + (F.least(F.lit(j), F.col("__w") - 1) if j else 0)).bitwiseXOR(F.col("__mask"))
    values = [at(j) for j in range(max(c.width for c, _ in classes))]
    least = F.least(*values) if len(values) > 1 else values[0]
    return placed.select(*keep, "h", "pos", F.xxhash64("__w", "__band", least).alias("key"))


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    classes: list[SizeClass],
    doc: str = "doc_id",
    item: str = "item_id",
    threshold: float = 0.8,
    miss: float = 0.01,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc, item, containment, first_shingle``: items of which ``threshold`` lies in one span of a document.

    Containment is the share of an item's distinct five-word shingles found in a span of the document
    as long as the item and a quarter and five shingles more at either end. Items fall into
    ``classes`` by size; each class has its own window width, and as many MinHashes per window as
    find an item at the threshold with probability ``1 - miss`` in the worst case. Items are cut at
    every offset, documents at every step, so a verbatim run always shares a window.

    Retrieved spans are all verified exactly. Nothing of a document is shuffled while the items'
    band rows number ``broadcast_rows`` or fewer (checked); beyond that keys alone are joined by
    shuffle, and only documents with a hit are read and hashed again for verification. Texts of under five words
    have no shingle: such items are not looked for and such documents contain nothing. Null texts
    are empty; rows of equal id count as one, null being an id like others; an empty side gives an empty result.
    Texts of any length are searched whole, a window at a time; of spans that tie the first counts. Of
    either table only the id and ``text`` are read, whatever other columns are called.
    """
    by_size = sorted(classes, key=lambda c: c.least)
    width = F.lit(None).cast("int")
    for c in by_size:
        width = F.when(F.size("h") >= c.least, F.lit(c.width)).otherwise(width)
    sized = materialize(
        shingled(items, item).where(F.size("h") > 0).select(F.col(item).alias("__item"), "h", F.array_distinct("h").alias("__set"), width.alias("width")),
        "contained-items",
    )
    present = {r[0] for r in sized.select("width").distinct().collect()}  # as many as classes at most
    used = [(c, bands_needed(worst_similarity(c, threshold), miss)) for c in by_size if c.width in present]
    if not used:
        empty = docs.select(F.col(doc), F.lit(0.0).alias("containment"), F.lit(0).alias("first_shingle")).limit(0)
        return empty.crossJoin(items.select(item).limit(0)).select(doc, item, "containment", "first_shingle")
    keys = _window_rows(sized.withColumn("n", F.size("h")), ["__item", "n", "width"], used, every_offset=True)
    keys = materialize(keys.select("key", "__item", "n", F.col("pos").alias("off")), "contained-keys")
    small = keys.count() <= broadcast_rows
    hashed = shingled(docs, doc)
    windows = _window_rows(hashed, [doc], used, every_offset=False)

    def spans(hits: DataFrame) -> DataFrame:
        begin = F.col("pos") - F.col("off")
        slack = F.ceil(F.col("n") / 4).cast("int") + SHINGLE
        low = F.greatest(begin - slack, F.lit(0))
        span = F.slice("h", low + 1, F.greatest(begin + F.col("n") + slack - low, F.lit(0)))
        return hits.select(doc, "__item", F.greatest(begin, F.lit(0)).alias("first_shingle"), span.alias("__span"))

    if small:
        found = spans(windows.join(F.broadcast(keys), "key"))
        sets = F.broadcast(sized.select("__item", "__set"))
    else:
        # A passage that very many documents share is one key: its windows are dealt to SALTS tasks.
        salted = windows.select(F.col(doc).alias("__doc"), "pos", "key", F.pmod(F.xxhash64(F.col(doc), "pos"), F.lit(SALTS)).alias("__salt"))
        every = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = materialize(salted.join(every, ["key", "__salt"]).select("__doc", "__item", "n", "off", "pos").distinct(), "contained-hits")
        ids = materialize(hits.select("__doc").distinct(), "contained-docs")
        ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
        some = shingled(docs.join(ids, F.col(doc).eqNullSafe(F.col("__doc")), "left_semi"), doc)
        found = spans(hits.join(some, F.col("__doc").eqNullSafe(F.col(doc))))
        sets = sized.select("__item", "__set")
    share = F.size(F.array_intersect("__set", "__span")) / F.size("__set")
    return (
        found.join(sets.withColumnRenamed("__item", "__of"), F.col("__item").eqNullSafe(F.col("__of")))
        .select(doc, F.col("__item").alias(item), share.alias("containment"), "first_shingle")
        .where(F.col("containment") >= threshold)
        .groupBy(doc, item)
        .agg(F.max(F.struct("containment", (-F.col("first_shingle")).alias("at"))).alias("best"))
        .select(doc, item, "best.containment", (-F.col("best.at")).alias("first_shingle"))
    )


def containment_sql(items: str, item: str, threshold: float = 0.8) -> str:
    """DuckDB SQL of :func:`find_contained` by brute force; ``items`` is a query with ``item`` and ``text``."""
    cut = "unnest(range(1, len(w) - 3)) AS p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS s"
    split = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w"
    return f"""
WITH items AS ({items}),
d AS (SELECT doc_id, p - 1 AS p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT doc_id, {split} FROM documents) WHERE len(w) >= 5)),
t AS (SELECT {item}, p - 1 AS p, n, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS s
      FROM (SELECT {item}, w, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS p FROM (SELECT {item}, {split} FROM items) WHERE len(w) >= 5)),
sizes AS (SELECT {item}, max(n) AS n, count(DISTINCT s) AS distinct_n FROM t GROUP BY {item}),
m AS (SELECT DISTINCT doc_id, {item}, d.p AS dp, t.p AS tp, s FROM d JOIN t USING (s)),
starts AS (SELECT DISTINCT doc_id, {item}, dp - tp AS b FROM m),
spans AS (
  SELECT a.doc_id, a.{item}, a.b, count(DISTINCT m.s) / max(z.distinct_n)::DOUBLE AS containment
  FROM starts a JOIN sizes z USING ({item}) JOIN m ON m.doc_id = a.doc_id AND m.{item} = a.{item}
   AND m.dp >= greatest(a.b - (ceil(z.n / 4.0) + 5), 0) AND m.dp < a.b + z.n + ceil(z.n / 4.0) + 5
  GROUP BY ALL)
SELECT doc_id, {item}, max(containment) AS containment FROM spans GROUP BY doc_id, {item} HAVING max(containment) >= {threshold}
"""
