"""Quality rules (operator 7): fences from mergeable quantile sketches instead of fixed cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_per_key, materialize, shingle_hashes, table, words

#: Metric -> (lower quantile, upper quantile, spreads beyond them, whether low values fail too).
#: Metrics are whole numbers per mille; all else about a fence comes from the sketches.
METRICS = {
    "m_symbols": (0.75, 0.99, 1, False),
    "m_dup_lines": (0.5, 0.99, 1, False),
    "m_capitals": (0.05, 0.95, 3, False),
    "m_word_length": (0.25, 0.75, 6, True),
}
#: Metrics that are zero in most texts: where the values beyond the lower quantile leave a gap of this
#: factor or more, the fence stands in the widest such gap, at its geometric middle.
GAPS = {"m_symbols": 4.0}
_LEVELS = sorted({q for low, high, _, _ in METRICS.values() for q in (low, high)})
#: Groups whose fences are broadcast at most (about 100 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Values below 2**_EXACT_BITS have a cell of their own; above, cells are 1/2**(_EXACT_BITS - 1) of the value wide.
_EXACT_BITS = 6


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus the counts of its ``text`` (null: no words).

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals``. Nothing is
    shuffled: repeated five-word windows are found by sorting a row's own window hashes, and only
    where a row has any.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\u000b\u000c\r"))) > 0)
    one = docs.select(
        *keep,
        words(F.col("text")).alias("__w"),
        lines.alias("__l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    two = one.select(
        *keep,
        "n_symbols",
        "n_capitals",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__wh"),
    )
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals"]
    three = two.select(*keep, *stats, shingle_hashes(F.col("__wh")).alias("__h"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    four = three.select(
        *keep,
        *stats,
        F.when(
            F.size(F.array_distinct("__h")) < F.size("__h"),
            F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(none)
        .alias("__s"),
    )
    same = lambda s, k: s["h"] == F.get(F.col("__s"), k)["h"]
    repeated = F.filter("__s", lambda s, k: F.coalesce(same(s, k - 1), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False)))
    five = four.select(*keep, *stats, F.sort_array(F.transform(repeated, lambda s: s["i"])).alias("__p"))
    gap = lambda p, k: F.when(k == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(F.col("__p"), k - 1)))
    covered = F.aggregate(F.transform("__p", gap), F.lit(0).cast("long"), lambda a, x: a + x)
    return five.select(*keep, *stats, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _metrics() -> dict[str, Column]:
    per = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "m_symbols": per("n_symbols", "word_chars"),
        "m_dup_lines": per("n_dup_lines", "n_lines"),
        "m_capitals": per("n_capitals", "word_chars"),
        "m_word_length": per("word_chars", "n_words"),
    }


def cell_width(value: Column) -> Column:
    """Width of the cell of a log-linear histogram that holds ``value`` (>= 0)."""
    return F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - _EXACT_BITS, F.lit(0))).cast("long")


def sketch_cell(value: Column) -> Column:
    """Lowest value of that cell."""
    return value - F.pmod(value, cell_width(value))


def _sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return (
        df.select(*keys, F.explode(pairs).alias("__p"))
        .select(*keys, "__p.metric", sketch_cell(F.col("__p.value")).alias("cell"))
        .groupBy(*keys, "metric", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile_sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``keys, metric, cell, n``: a log-linear histogram of each metric and key.

    Its rows merge by adding ``n``, in any order, to the same result; cells are within 1/32 of their
    values, so their number is bounded whatever the number of rows. The metrics are written out
    first: as expressions they would be worked out again for each of them.
    """
    return _sketch(materialize(df.select(*keys, *metrics), "sketch-input"), keys, metrics)


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], quantiles: dict[str, float], gap_above: dict[str, float] | None = None) -> DataFrame:
    """``keys, metric, rows`` and a column for each quantile: the first cell to reach that share of rows.

    With ``gap_above`` (metric to quantile) also ``gap``: of the gaps between occupied cells from that
    quantile on the one of the greatest ``ratio`` (one more than the values at its ends, so that 0
    counts), the lower on ties, and its ``middle``; null if there is none.
    """
    w = Window.partitionBy(*keys, "metric")
    up_to = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    at = sketch.withColumn("rows", F.sum("n").over(w)).withColumn("up_to", up_to)
    gap = []
    if gap_above is not None:
        level = F.lit(None).cast("double")
        for m, q in gap_above.items():
            level = F.when(F.col("metric") == m, F.lit(q)).otherwise(level)
        at = at.withColumn("next", F.lead("cell").over(w.orderBy("cell")))
        top = F.col("cell") + cell_width(F.col("cell"))
        middle = F.floor(F.sqrt((top * (F.col("next") + 1)).cast("double"))).cast("long") - 1
        one = F.struct(((F.col("next") + 1) / top).alias("ratio"), (-F.col("cell")).alias("at"), middle.alias("middle"))
        gap = [F.max(F.when((F.col("up_to") >= F.col("rows") * level) & F.col("next").isNotNull(), one)).alias("gap")]
    return at.groupBy(*keys, "metric").agg(
        F.max("rows").alias("rows"),
        *gap,
        *[F.min(F.when(F.col("up_to") >= F.col("rows") * F.lit(q), F.col("cell"))).alias(c) for c, q in quantiles.items()],
    )


def adaptive_fences(stats: DataFrame, min_rows: int = 100) -> DataFrame:
    """``lang, source, rows`` and, in ``fences``, each metric's lowest and highest accepted value.

    A fence lies some spreads beyond a quantile of the rows of that language and source
    (``METRICS``); the spread is the distance of the upper from the lower quantile. A sketch tells
    values no closer than a cell apart, so the spread is that of the upper quantile's cell at least:
    this is the rule for groups of which most rows have one value. Of a metric in ``GAPS`` the upper
    fence is that of the widest gap of the tail, if it is wide enough: quantiles of such a metric are
    0 far up, so their distance says nothing of the tail. Groups of under ``min_rows`` rows
    take the fences of their language, those of a small language the fences of all rows; both are
    merged from the same sketch.
    """
    names = list(METRICS)
    sketch = materialize(quantile_sketch(stats, ["lang", "source"], names), "quality-sketch")
    level = lambda q: f"q{round(1000 * q)}"

    def chosen(i: int) -> Column:
        out = F.lit(None).cast("long")
        for m, row in METRICS.items():
            out = F.when(F.col("metric") == m, F.col(level(row[i])) if i < 2 else F.lit(row[i])).otherwise(out)
        return out

    def fences(df: DataFrame, keys: list[str]) -> DataFrame:
        q = sketch_quantiles(df, keys, {level(x): x for x in _LEVELS}, {m: METRICS[m][0] for m in GAPS})
        wide = F.lit(None).cast("double")
        for m, factor in GAPS.items():
            wide = F.when(F.col("metric") == m, F.lit(factor)).otherwise(wide)
        q = q.select(*keys, "metric", "rows", "gap", wide.alias("wide"), chosen(0).alias("a"), chosen(1).alias("b"), chosen(2).alias("spreads"))
        reach = F.col("spreads") * F.greatest(F.col("b") - F.col("a"), cell_width(F.col("b")))
        high = F.when(F.col("gap.ratio") >= F.col("wide"), F.col("gap.middle")).otherwise(F.col("b") + reach)
        q = q.withColumn("fence", F.struct((F.col("a") - reach).alias("low"), high.alias("high")))
        of = lambda m: F.max(F.when(F.col("metric") == m, F.col("fence")))
        return q.groupBy(*keys).agg(F.struct(F.max("rows").alias("rows"), *[of(m).alias(m) for m in names]).alias("f"))

    own = fences(sketch, ["lang", "source"])
    lang = fences(merge_sketches(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("__lang"), F.col("f").alias("g"))
    row = fences(merge_sketches(sketch.withColumn("__one", F.lit(1)), ["__one"]), ["__one"]).select("f.*").first()
    every = F.col("f")
    if row is not None:  # one row, of as many numbers as metrics: it becomes part of the expression
        every = F.struct(F.lit(row["rows"]).cast("long").alias("rows"), *[F.struct(*[F.lit(row[m][k]).cast("long").alias(k) for k in ("low", "high")]).alias(m) for m in names])
    big = lambda f: F.col(f"{f}.rows") >= min_rows
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("__lang")))
    best = F.when(big("f"), F.col("f")).when(big("g"), F.col("g")).otherwise(every)
    return joined.select("lang", "source", F.col("f.rows").alias("rows"), best.alias("fences"))


def apply_quality_rules(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for each row of ``docs`` (``doc_id, lang, source, text``).

    Texts of any length are measured whole. Values that lie on a fence pass, equal ones alike.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated five-word windows.
    Other rows fail if a metric lies outside the fences of their language and source (see
    :func:`adaptive_fences`, computed over all rows that pass the base rules). Null text has no
    words and fails; null language or source is a group of its own; repeated rows are judged each;
    an empty table gives an empty result. Columns other than those named are not read, whatever their names.
    """
    stats = text_statistics(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"])
    stats = materialize(stats.withColumns({"base_failed": base_failed(), **_metrics()}), "quality-stats")
    fences = materialize(adaptive_fences(stats.where("not base_failed"), min_rows), "quality-fences")
    return verdict(stats, fences).withColumn("kept", F.col("verdict") == "kept").drop("verdict")


def verdict(stats: DataFrame, fences: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``stats`` with the column ``verdict``: base, fence or kept. One expression over both sides of
    the join, so that Spark does not work out the statistics again to filter earlier.

    ``fences`` (written out) are broadcast if they are few, and no row of ``stats`` is shuffled; else joined by shuffle, hot groups apart.
    """
    beyond = F.lit(False)
    for m, (*_, low) in METRICS.items():
        beyond = beyond | (F.col(m) > F.col(f"fences.{m}.high"))
        beyond = beyond | (F.col(m) < F.col(f"fences.{m}.low")) if low else beyond
    told = F.when(F.col("base_failed"), F.lit("base")).when(beyond, F.lit("fence")).otherwise(F.lit("kept"))
    if fences.count() <= broadcast_groups:
        named = F.broadcast(fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "fences"))
        same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
        return stats.join(named, same, "left").withColumn("verdict", told).drop("__lang", "__source", "fences")
    one = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.length(F.coalesce(c, F.lit(""))), F.lit(":"), F.coalesce(c, F.lit("")))
    group = F.concat(one("lang"), one("source"))
    per_group = fences.select(group.alias("__group"), F.col("rows").alias("__rows"), "fences")
    joined = join_per_key(stats.withColumn("__group", group), per_group, "__group", "__rows", "left")
    return joined.withColumn("verdict", told).drop("__group", "__rows", "fences")


def filter_quality(docs: DataFrame, min_rows: int = 100) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns (any names, as they are kept in a struct meanwhile).

    Nulls, repeats and empty tables as in :func:`apply_quality_rules`. Texts are read twice and
    never shuffled: once for the fences, once to judge each row.
    """

    def measured(df: DataFrame, keep: list[str]) -> DataFrame:
        return text_statistics(df, keep).withColumns({"base_failed": base_failed(), **_metrics()})

    first = materialize(measured(docs.select("lang", "source", "text"), ["lang", "source"]), "quality-stats")
    fences = materialize(adaptive_fences(first.where("not base_failed"), min_rows), "quality-fences")
    again = measured(docs.select(F.struct("*").alias("__doc"), "lang", "source", "text"), ["__doc", "lang", "source"])
    return verdict(again, fences).where("verdict = 'kept'").select("__doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_value('') || w, 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         1000 * n_symbols // greatest(word_chars, 1) AS m_symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS m_dup_lines,
         1000 * n_capitals // greatest(word_chars, 1) AS m_capitals, 1000 * word_chars // greatest(n_words, 1) AS m_word_length FROM stats),
long AS (
  SELECT lang, source, metric, value FROM (SELECT * FROM judged WHERE NOT base_failed)
  UNPIVOT (value FOR metric IN (m_symbols, m_dup_lines, m_capitals, m_word_length))),
cells AS (
  SELECT lang, source, metric, CASE WHEN length(bin(value)) <= 6 THEN value ELSE value - value % CAST(pow(2, length(bin(value)) - 6) AS BIGINT) END AS cell FROM long),
grouped AS (
  SELECT 1 AS level, lang, source, metric, cell, count(*) AS n FROM cells GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, metric, cell, count(*) FROM cells GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, cell, count(*) FROM cells GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total, cell + CAST(pow(2, greatest(length(bin(cell)) - 6, 0)) AS BIGINT) AS top,
         lead(cell) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS next,
         sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS up_to FROM grouped),
levels AS (
  SELECT * FROM (VALUES ('m_symbols', 0.75, 0.99, 1), ('m_dup_lines', 0.5, 0.99, 1), ('m_capitals', 0.05, 0.95, 3), ('m_word_length', 0.25, 0.75, 6)) AS v(metric, p, q, spreads)),
quantiles AS (
  SELECT level, lang, source, r.metric, max(total) AS total, min(cell) FILTER (up_to >= p * total) AS a, min(cell) FILTER (up_to >= q * total) AS b, max(spreads) AS spreads,
         max(row((next + 1) / top, -cell, CAST(floor(sqrt(CAST(top * (next + 1) AS DOUBLE))) AS BIGINT) - 1)) FILTER (r.metric = 'm_symbols' AND up_to >= p * total AND next IS NOT NULL) AS gap
  FROM ranked r JOIN levels l ON l.metric = r.metric GROUP BY level, lang, source, r.metric),
fences AS (
  SELECT level, lang, source, metric, total, CASE WHEN gap[1] >= 4 THEN gap[3] ELSE b + spreads * greatest(b - a, CAST(pow(2, greatest(length(bin(b)) - 6, 0)) AS BIGINT)) END AS high,
         CASE WHEN metric = 'm_word_length' THEN a - spreads * greatest(b - a, CAST(pow(2, greatest(length(bin(b)) - 6, 0)) AS BIGINT)) ELSE -1 END AS low FROM quantiles),
chosen AS (
  SELECT a.lang, a.source, a.metric,
         CASE WHEN a.total >= 100 THEN a.high WHEN b.total >= 100 THEN b.high ELSE c.high END AS high,
         CASE WHEN a.total >= 100 THEN a.low WHEN b.total >= 100 THEN b.low ELSE c.low END AS low
  FROM fences a JOIN fences b ON b.level = 2 AND b.metric = a.metric AND b.lang IS NOT DISTINCT FROM a.lang
  JOIN fences c ON c.level = 3 AND c.metric = a.metric WHERE a.level = 1),
bad AS (
  SELECT j.doc_id FROM judged j JOIN chosen f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
  WHERE CASE f.metric WHEN 'm_symbols' THEN m_symbols WHEN 'm_dup_lines' THEN m_dup_lines WHEN 'm_capitals' THEN m_capitals ELSE m_word_length END
        NOT BETWEEN low AND high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM judged
"""
