"""Phrase collocation mining (operator 13): a sample proposes, full passes count exactly until nothing frequent is left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_per_key, materialize, table

#: Words of a phrase at most, its least count, rows returned of a language.
WORDS, LEAST, TOP = 5, 100, 2000
#: One document in so many proposes, and the share of the count expected there from which a phrase is proposed.
SAMPLE, LOWERED = 8, 0.8
#: Bytes of text whose phrases are counted before they are sent on; a longer piece is counted whole.
PORTION = 2_000_000
#: Bits of the filter of proposed phrases: so many a phrase, a power of two, this many at most (32 MB).
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
PROBES = 4
#: Keys are the upper 40 bits of a phrase's hash.
KEY_SHIFT = np.uint64(24)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


@dataclass
class Filter:
    """Bloom filters of phrase keys, of a bounded size whatever their number; it has what one of its ``parts`` has.

    It defines which phrases count as proposed: one that it admits by chance is counted too, which
    costs a little and changes no count. Filters are united part by part, so that what one of them
    admits its unions do.
    """

    parts: tuple[np.ndarray, ...]

    def has(self, keys: np.ndarray) -> np.ndarray:
        low, step = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(8) | np.uint64(1)
        any_ = np.zeros(len(keys), bool)
        for bits in self.parts:
            found, last = np.ones(len(keys), bool), np.uint64(len(bits) * 64 - 1)
            for j in range(PROBES):
                at = low + np.uint64(j) * step & last
                found &= bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
            any_ |= found
        return any_

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.parts + other.parts)


def filter_of(keys: DataFrame) -> Filter:
    """The filter that has ``key`` of ``keys``. Set bits are gathered by word of 64, so the driver gets no more than the filter's size."""
    wanted, n = keys.count() * BITS_EACH, FEWEST_BITS
    while n < min(wanted, MOST_BITS):
        n *= 2
    out = np.zeros(n // 64, np.uint64)
    low, step = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 8).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + F.lit(j) * step).bitwiseAND(F.lit(n - 1)) for j in range(PROBES)])).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out[words["word"].to_numpy()] |= words["set"].to_numpy().view(np.uint64)
    return Filter((out,))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _cuts(data: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of ``most`` at most that end where a text or a piece does; a longer piece is a range of its own."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + most, end)
        if to < end:
            text = starts[np.searchsorted(starts, to, "right") - 1]
            if text > at:
                to = int(text)
            else:
                breaks = np.flatnonzero(_KIND[data[at:to]] == 2)
                if len(breaks):
                    to = at + int(breaks[-1]) + 1
                else:
                    while to < end and _KIND[data[to]] != 2 and starts[np.searchsorted(starts, to, "left")] != to:
                        to += 1
        yield at, to
        at = to


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense codes of ``keys``, the key of each code, and where it is first."""
    codes, unique = pd.factorize(keys)
    first = np.empty(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, unique, first


@dataclass
class Pass:
    """What a pass over texts counts.

    Phrases that ``wanted`` has are counted by name. With ``border`` so are, under their keys, all other
    phrases of which both parts of one word less are in ``grow`` (of single words: all), but for those
    of which ``before`` has both: an earlier pass has counted them. What is counted by name counts as
    being in ``grow`` for longer phrases (``wanted`` may have it by chance), with ``onward`` also
    what is counted under a key. ``lengths``: the numbers of words.
    """

    wanted: Filter | None = None
    grow: Filter | None = None
    before: Filter | None = None
    border: bool = True
    onward: bool = False
    lengths: tuple[int, int] = (1, WORDS)


def _named(lang: pa.Array, phrase: pa.Array) -> pa.Array:
    """Language and phrase as one string: a row that only has a key should be small."""
    return pc.binary_join_element_wise(pc.cast(pc.utf8_length(lang), pa.string()), pc.binary_join_element_wise(lang, phrase, ""), ":")


def count_portion(langs: pa.Array, data: np.ndarray, starts: np.ndarray, of_text: np.ndarray, what: Pass) -> Iterator[tuple]:
    """``name, key, n`` (arrays; name, see :func:`_named`, null where only the key counts) of texts that begin at ``starts`` in ``data``.

    A phrase of no words stands for the number of words of a language. Within the portion phrases are
    told apart by numbers that are exact, never by a hash.
    """
    data = _LOWER[data]
    kind = _KIND[data]
    word = kind == 0
    inner = starts[(starts > 0) & (starts < len(data))]
    behind, ahead = np.zeros(len(word), bool), np.zeros(len(word), bool)
    behind[1:], ahead[:-1] = word[:-1], word[1:]
    behind[inner], ahead[inner - 1] = False, False
    begin, finish = np.flatnonzero(word & ~behind), np.flatnonzero(word & ~ahead) + 1
    n = len(begin)
    if not n:
        return
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(finish - begin, out=ends[1:])
    encoded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[word])]).dictionary_encode()
    ids, vocabulary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    text = np.searchsorted(starts, begin, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin] + text
    joined = piece[1:] == piece[:-1]
    size, by_word, by_lang, lang = len(vocabulary), _hashes(vocabulary), _hashes(langs), of_text[text]
    del data, kind, word, behind, ahead, finish, encoded, piece
    least, most = what.lengths

    if what.wanted and what.before is None:
        held = np.bincount(lang, minlength=len(langs))
        some = np.flatnonzero(held)
        yield _named(langs.take(pa.array(some)), pa.array([""] * len(some), pa.string())), np.zeros(len(some), np.uint64), held[some]

    codes, unique, first = _codes(lang * size + ids)
    keys, begins, whole = _mixed(by_lang[unique // size], by_word[unique % size]), np.arange(n), np.ones(n, bool)
    for m in range(1, most + 1):
        if m > 1:
            whole = whole[:-1] & joined[m - 2 :]
            begins = np.flatnonzero(whole & ok[: len(whole)] & ok[1 : len(whole) + 1])
            if not len(begins):
                return
            codes, unique, first = _codes(code[begins] * size + ids[begins + m - 1])
            keys = _mixed(keys[unique // size], by_word[unique % size])
        here, times = begins[first], np.bincount(codes, minlength=len(keys))
        short = keys >> KEY_SHIFT
        named = what.wanted.has(short) if what.wanted else np.zeros(len(keys), bool)
        seen = np.zeros(len(keys), bool)
        if what.before:
            seen = old[code[here]] & old[code[here + 1]] if m > 1 else ~seen
            old = what.before.has(short) & seen  # the earlier pass came as far as this phrase, and went on from it
        keyed = ~named & ~seen & what.border
        if m >= least and named.any():
            at = here[named]
            parts = [vocabulary.take(pa.array(ids[at + j])) for j in range(m)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string())
            yield _named(langs.take(pa.array(lang[at])), phrase), short[named], times[named]
        if m >= least and keyed.any():
            yield pa.nulls(int(keyed.sum()), pa.string()), short[keyed], times[keyed]
        if m < most:
            grown = what.grow.has(short) if what.grow else np.ones(len(keys), bool)
            grown = grown | named | keyed if what.onward else grown | named
            code, ok = np.full(n, -1, np.int64), np.zeros(n, bool)
            code[begins], ok[begins] = codes, grown[codes]


def count_phrases(docs: DataFrame, what: Pass, portion: int = PORTION) -> DataFrame:
    """``lang, phrase, words, key, n`` over ``docs`` (``lang, text``) of what the pass counts; lang, phrase and words are null where only the key counts.

    Phrases are counted a portion of text at a time, then a task at a time, before they are shuffled, so
    a frequent one is a row a task. Counts by name are exact; one under a key is that of all phrases with this key,
    hence never too low.
    """
    parts = ("wanted", "grow", "before")
    sent = {k: docs.sparkSession.sparkContext.broadcast(getattr(what, k).parts) for k in parts if getattr(what, k)}
    plain = replace(what, **dict.fromkeys(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = replace(plain, **{k: Filter(b.value) for k, b in sent.items()})
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            of_text, text = coded.indices.to_numpy(), batch.column(1)
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            if not len(text) or ends[0] == ends[-1]:
                continue
            data, ends = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
            for low, high in _cuts(data, ends, portion):
                a, b = np.searchsorted(ends[:-1], low, "right") - 1, np.searchsorted(ends[:-1], high, "left")
                starts = np.maximum(ends[a:b] - low, 0)
                for name, keys, n in count_portion(coded.dictionary, data[low:high], starts, of_text[a:b], here):
                    yield pa.record_batch([name, pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["name", "key", "n"])

    counted = docs.mapInArrow(run, "name string, key long, n long").groupBy("name", "key").agg(F.sum("n").alias("n"))
    colon = F.instr("name", ":")
    long_ = F.substr("name", F.lit(1), colon - 1).cast("int")
    told = counted.select(F.substr("name", colon + 1, long_).alias("lang"), F.substr("name", colon + 1 + long_).alias("phrase"), "key", "n")
    return told.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).cast("int")).withColumn("words", F.when(F.col("phrase").isNotNull(), F.col("words")))


def frequent_phrases(docs: DataFrame, least: int = LEAST, most: int = WORDS, sample: int = SAMPLE, lowered: float = LOWERED, portion: int = PORTION) -> DataFrame:
    """``lang, phrase, words, n`` of every phrase of ``most`` words at most with ``n >= least`` contiguous occurrences, and of the empty one (all words).

    Toivonen's way. One document of ``sample`` proposes the phrases frequent enough there, length by
    length. A full pass counts them, and their negative border: the phrases not proposed whose parts
    of one word less are. If some of the border are frequent after all, they are proposed too, and
    an expansion pass counts them and what that adds to the border, along each text up to ``most``
    words at once; what is frequent there is counted by a last pass.

    The border is counted under 40-bit keys, as no more bytes should be shuffled than needed: a shared key can only propose a phrase in vain, and every
    result is counted by name. Nothing frequent is missing, whatever the sample was: both parts of a
    frequent phrase are frequent, so, shorter ones first, each was proposed by the sample, or failed
    at the border, or was found by the expansion, and so the phrase was counted there or then. What a
    pass counts by name is in the filter that the next ones grow by, be it there by chance.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    share = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(sample)) == 0
    some = materialize(docs.where(share).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text")), "phrases-sample")
    proposed = Filter(())
    for m in range(1, most + 1):
        keys = count_phrases(some, Pass(grow=proposed, lengths=(m, m)), portion).where(F.col("n") >= max(1, round(least * lowered / sample)))
        proposed |= filter_of(materialize(keys.select("key"), "phrases-proposed"))

    def counted(what: Pass) -> tuple[DataFrame, DataFrame]:
        enough = materialize(count_phrases(rows, replace(what, lengths=(1, most)), portion).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")
        return enough.where("phrase is not null"), enough.where("phrase is null").select("key")

    found, failed = counted(Pass(wanted=proposed, grow=proposed))
    onward = True
    while not failed.isEmpty():  # at most twice
        wanted = filter_of(failed)
        wider = proposed | wanted
        more, failed = counted(Pass(wanted=wanted, grow=wider, before=proposed, border=onward, onward=onward))
        found, proposed, onward = found.unionByName(more), wider, False
    return found.groupBy("lang", "phrase", "words").agg(F.max("n").alias("n"))  # a filter may have a phrase by chance: counted twice, alike


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase ``part`` in ``out``; common parts are joined apart."""
    per = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("times"))
    per = per.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)), ["lang", part])
    per = per.select(F.struct("lang", part).alias("at"), "times", out)
    return join_per_key(rows.withColumn("at", F.struct("lang", part)), per, "at", "times").drop("at", "times")


def collocations(docs: DataFrame, least: int = LEAST, most: int = WORDS, top: int = TOP, covered: int = 100, **sampling) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases of 2 to ``most`` words.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, and these into words
    at spaces and tabs. ``a`` is the number of a phrase's contiguous occurrences within pieces,
    ``least`` or more, overlaps included, ``n`` that of all words of its language. Cut after its first k
    words it has parts with ``l`` and ``r`` occurrences and the score ``1000 * a * n / (l * r)``, rounded
    down, in exact decimals; the lowest counts, the smallest k on ties. A phrase inside a longer one
    that has ``covered`` hundredths of its occurrences or more is dropped. By score, then a (both
    falling), then phrase in byte order.

    Null texts are empty; null lang is ``und``, the empty one a language like others; repeated rows
    count each; an empty table gives an empty result; other columns are not read, but for doc_id,
    which with the text draws the sample. Bytes that are no UTF-8 become U+FFFD first. A task holds
    some thirty times the bytes of its portion, which is :data:`PORTION` or one longer piece.
    """
    counts = frequent_phrases(docs, least, most, **sampling)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    subs = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inside = phrases.where("words > 2").select("lang", F.explode(subs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)).drop("longer")
    kept = materialize(kept, "phrases-kept")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": _part(1, F.col("k")), "rest": _part(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = _looked_up(materialize(cuts, "phrases-cut"), counts, "first", "l")
    cuts = _looked_up(materialize(cuts, "phrases-cut"), counts, "rest", "r")
    all_words = F.broadcast(counts.where("words = 0").select("lang", F.col("n").alias("n")))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    product = (F.lit(1000).cast("decimal(4,0)") * wide["a"]).cast("decimal(23,0)") * F.col("n").cast("decimal(15,0)")
    scored = cuts.join(all_words, "lang").withColumns({"over": product, "under": wide["l"] * wide["r"]}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("z")).select("lang", "phrase", "a", "z.l", "z.r", "n", "z.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m} AS m, array_to_string(w[p:p + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS p FROM pieces WHERE len(w) >= {m})" for m in range(1, WORDS + 1)
)
SQL = f"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
subs AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, a, string_split(phrase, ' ') AS w, m AS size, unnest(range(2, m)) AS m FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN subs USING (lang, phrase) WHERE m > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, c.k, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best)
WHERE rank <= {TOP}
"""
