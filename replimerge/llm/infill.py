"""Fill-in-middle transformation (operator 11): pieces of a document in another order, rebuilt exactly.

Units are cut, numbered, dealt to roles and joined again by Arrow's own kernels, a batch at a time;
no row is visited in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: The marks of prefix, suffix and middle, shares in a hundred, and the unit, one run of
#: ASCII letters or any other code point, as a pattern over UTF-8 bytes.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMED_SHARE, SPM_SHARE = 90, 20
UNIT = r"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
#: Never a byte of UTF-8, so it can stand between units.
CUT = b"\xff"
#: Bytes of text that are cut into units at a time; a longer text is a portion of its own.
PORTION = 4_000_000


def portions(text: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Row ranges ``(start, length)`` of ``text`` with ``most`` bytes at most each, one row at least."""
    start, used = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if i > start and used + n > most:
            yield start, i - start
            start, used = i, 0
        used += n
    if len(text) > start:
        yield start, len(text) - start


def units(text: pa.Array) -> pa.Array:
    """Each text (binary, no nulls) as the list of its units and one empty value behind them."""
    return pc.split_pattern(pc.replace_substring_regex(text, UNIT, b"\\0" + CUT), CUT)


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _offsets(counts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(counts).cast(pa.int32())])


def pieces(text: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Number of units of each text, and its prefix, middle and suffix (binary).

    The prefix ends after the lesser of ``first`` and ``second`` modulo the number of units and one,
    the middle after the greater.
    """
    lists = units(text)
    n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())
    ends = [_mod(h, pc.add(n, 1)) for h in (first, second)]
    low, high = pc.min_element_wise(*ends), pc.max_element_wise(*ends)
    values, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pc.take(_offsets(pc.add(n, 1)), pc.cast(parent, pa.int64()))
    ordinal = pc.subtract(pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(values))), 1), begin)
    after_low, after_high = (pc.greater_equal(ordinal, pc.take(x, parent)) for x in (low, high))
    is_unit = pc.less(ordinal, pc.take(n, parent))
    roles = [pc.invert(after_low), pc.and_not(after_low, after_high), pc.and_(after_high, is_unit)]
    sizes = [low, pc.subtract(high, low), pc.subtract(n, high)]
    out = []
    for role, size in zip(roles, sizes, strict=True):
        own = pa.ListArray.from_arrays(_offsets(size), pc.filter(values, role))
        out.append(pc.binary_join(own, pa.scalar(b"", pa.binary())))
    return n, out


def formed(form: pa.Array, text: pa.Array, parts: list[pa.Array]) -> pa.Array:
    """The output: the text where the form is plain, else its parts behind their marks in the form's order."""
    p, m, s = ([pa.scalar(mark.encode(), pa.binary()), part] for mark, part in zip((PREFIX, MIDDLE, SUFFIX), parts, strict=True))
    none = pa.scalar(b"", pa.binary())
    psm, spm = (pc.binary_join_element_wise(*x, none) for x in (p + s + m, s + p + m))
    return pc.if_else(pc.equal(form, "plain"), text, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _numbers(doc_id: Column, seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row's whole text.

    ``n`` counts units: runs of ASCII letters, and every other code point. Where to cut and which
    form to take follow from the digest of ``seed`` and doc_id alone, so reruns agree. ``form`` is
    plain (``output`` is the text, the lengths are null), psm or spm (prefix, suffix and middle in
    that order of letters, each behind its mark). Texts that hold a mark, and empty ones, are plain.

    Null texts are empty; null doc_id counts as an empty name; repeated rows come out repeated and
    alike; an empty table gives an empty result; other columns of ``docs`` are not read. Bytes that
    are no UTF-8 become U+FFFD first. A task holds some thirty times the bytes of its portion, which
    is :data:`PORTION` or one longer text.
    """
    names = ["__h1", "__h2", "__h3", "__h4"]
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").alias("__d"), text.alias("__t"), *[h.alias(k) for h, k in zip(_numbers(F.col("doc_id"), seed), names, strict=True)])
    plain = (F.col("__t") == "") | (F.col("__h3") % 100 >= FORMED_SHARE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("__t", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < SPM_SHARE, "spm").otherwise("psm")
    rows = rows.select("__d", form.alias("__form"), "__t", "__h1", "__h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, length in portions(whole.column(2)):
                doc, form, text, first, second = whole.slice(start, length).columns
                text, plain = text.cast(pa.binary()), pc.equal(form, "plain")
                n, parts = pieces(text, first, second)
                lengths = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p.cast(pa.string())).cast(pa.int64())) for p in parts[:2]]
                yield pa.record_batch([doc, n, form, *lengths, formed(form, text, parts).cast(pa.string())], names=out.names)

    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    rest = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    out = T.StructType([key, *rest.fields])
    return rows.mapInArrow(run, out)


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` gave ``output`` of: what stands between the marks, in the text's order."""
    part = lambda i: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4), i)
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_H = "CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {}, 8) AS BIGINT)"
SQL = f"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents),
c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
