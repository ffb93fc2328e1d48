"""Content-addressed WARC archive (operator 12): payloads once by digest, record headers apart, records rebuilt by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import join_per_key, materialize, table

CRLF = "\r\n"
#: Fixed values of the format: what ends a header block and a record, the profile of revisits, the digest's alphabet.
BLANK = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Record ids are this scheme and the page_id.
SCHEME = "urn:x-page:"
#: When pages were fetched is not known.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: forty bits, ten hex digits, are eight digits to base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{SCHEME}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``head, digest`` of a WARC record for each row of ``page_id, url, html``: the bytes before its payload, and the payload's SHA-256.

    Of rows with equal payloads (html in UTF-8) of ``least`` bytes or more that with the largest page_id
    is the response, the others are revisits that refer to it, and their digest is null, as they have
    no payload; smaller ones are all responses. A payload's SHA-256 stands for it; that rows which
    share one agree in SHA-1 and length too is checked here, and an error if not.

    Null html is empty; null page_id is the least, with an empty name; rows that tie for the largest
    page_id are all responses; a null url gives no target line; line ends in a url are escaped. An
    empty table gives none; other columns are not read. No payload is shuffled here, nor is one of
    any length copied; groups of copies are joined by :func:`.common.join_per_key`.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    each = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("digest")
    )
    each = materialize(each, "warc-pages")
    agree = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    groups = each.groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n"), agree.alias("agree"))
    rows = join_per_key(each, groups, "digest").where(F.when(F.col("agree"), True).otherwise(F.raise_error(F.lit("payloads that differ share a SHA-256"))))

    response = F.col("page_id").eqNullSafe(F.col("chosen")) | (F.col("bytes") < least)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    length = F.length(http) + F.when(response, F.col("bytes")).otherwise(0)
    refers = F.concat(_line("WARC-Refers-To", _record_id(F.col("chosen"))), _line("WARC-Profile", PROFILE))
    head = [
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")), _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Date", DATE),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), F.when(response, "").otherwise(refers),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", length.cast("string")), F.lit(CRLF), http,
    ]
    return rows.select(F.concat(*head).cast("binary").alias("head"), F.when(response, F.col("digest")).alias("digest"))


def write_archive(headers: DataFrame, payloads: DataFrame, directory: str) -> None:
    """Write ``headers`` (``head, digest``) and each distinct one of ``payloads`` (``payload``) once, by its SHA-256.

    Equal payloads meet as one row a task before they are dealt by digest, so copies cost nothing.
    """
    headers.write.parquet(f"{directory}/headers")
    once = payloads.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.parquet(f"{directory}/payloads")


def archive_pages(pages: DataFrame, directory: str, least: int = 0) -> None:
    """Archive ``pages`` (see :func:`page_records`) in ``directory``."""
    write_archive(page_records(pages, least), pages.select(F.coalesce("html", F.lit("")).cast("binary").alias("payload")), directory)


def read_records(spark: SparkSession, directory: str, of: dict[str, Column] | None = None) -> DataFrame:
    """``head, payload``: the archived records, rebuilt by joining headers with payloads; null payload where a record has none.

    ``of`` names what is wanted of a payload, as columns over ``payload``: these are worked out before
    the join then, and no payload is shuffled. Every payload is verified against its digest. A
    header whose payload is missing, or that of another content, is an error, never a row less.
    Records with equal payloads of their own come from archives of more than one crawl only; their
    join is on the digest and may be skewed, which adaptive execution splits.
    """
    of = of or {"payload": F.col("payload")}
    headers = spark.read.schema("head binary, digest string").parquet(f"{directory}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{directory}/payloads")
    failed = lambda c: F.raise_error(F.concat(F.lit("no sound payload for digest "), c))
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(failed(F.col("digest")))
    stored = stored.select(verified.alias("stored"), *[c.alias(k) for k, c in of.items()])
    joined = headers.where("digest is not null").join(stored, F.col("digest") == F.col("stored"), "left")
    present = lambda k: F.when(F.col("stored").isNotNull(), F.col(k)).otherwise(failed(F.col("digest")).cast(stored.schema[k].dataType))
    full = joined.select("head", *[present(k).alias(k) for k in of])
    return full.unionByName(headers.where("digest is null").select("head", *[F.lit(None).cast(stored.schema[k].dataType).alias(k) for k in of]))


def field(head: Column, name: str) -> Column:
    """A field of a record's WARC header; null if it has none."""
    block = F.substring_index(head.cast("string"), BLANK, 1)
    return F.nullif(F.regexp_extract(block, rf"(?im)^{name}:[\x20\t]*([^\r\n]*)", 1), F.lit(""))


def _page_id(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, rf"<{SCHEME}(-?[0-9]*)>", 1), F.lit("")).cast("long")


def write_warc(records: DataFrame, directory: str) -> None:
    """Write rebuilt records as WARC files. What ends a record is the line end of Spark's text writer, so nothing is gathered."""
    block = F.concat("head", F.coalesce("payload", F.lit("").cast("binary")))
    records.select(block.cast("string").alias("value")).write.option("lineSep", BLANK).text(directory)


def read_pages(spark: SparkSession, directory: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload_bytes, payload_digest`` of every archived page, measured on the rebuilt records.

    A revisit's are those of the response that it refers to. Where a header tells another digest or
    length than its payload has, that is an error.
    """
    head = F.col("head")
    of = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))}
    http = F.length(F.substring_index(head.cast("string"), BLANK, -2))
    measured = read_records(spark, directory, of).where("payload_bytes is not null").select(
        _page_id(field(head, "WARC-Record-ID")).alias("page_id"), field(head, "WARC-Payload-Digest").alias("told"), (field(head, "Content-Length").cast("long") - http).alias("long"), *of
    )
    told = (F.col("told") == F.concat(F.lit("sha1:"), "payload_digest")) & (F.col("long") == F.col("payload_bytes"))
    checked = F.when(told, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a header does not fit its payload: "), "told")))
    responses = materialize(measured.select("page_id", "payload_bytes", checked.alias("payload_digest")), "warc-responses")

    headers = spark.read.schema("head binary, digest string").parquet(f"{directory}/headers").where("digest is null")
    revisits = headers.select(_page_id(field(head, "WARC-Record-ID")).alias("page_id"), _page_id(field(head, "WARC-Refers-To")).alias("refers_to"))
    n = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    to = responses.groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")).join(n, "refers_to")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = join_per_key(revisits, to, "refers_to", how="left").withColumn("record_type", F.lit("revisit")).select(*cols)
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), directory)
    return read_pages(spark, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS chosen FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string([substr('{BASE32}', ((CAST('0x' || substr(x, 5 * i // 4 + 1, 2) AS INTEGER) >> (3 - 5 * i % 4)) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < chosen THEN chosen END AS refers_to
FROM d
"""
