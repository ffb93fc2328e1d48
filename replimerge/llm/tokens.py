"""Token counts (operator 1): encode a document once, then attribute its tokens to its sections."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Where the rank file of the vocabulary is, unless the session's setting ``replimerge.vocabulary`` says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level encoder of a rank file and the byte length of each of its ids; once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens per section, from the tokens' byte lengths and the byte offsets at which sections end.

    Interval join of two sorted lists. A token goes to the section that holds most of its bytes, the
    earlier on a tie, so every token counts once.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    for t in np.flatnonzero(first != last):
        edges = np.concatenate(([starts[t]], bounds[first[t] : last[t]], [ends[t]]))
        first[t] += int(np.argmax(np.diff(edges)))
    return np.bincount(first, minlength=len(bounds))


def section_rows(text: str, enc, byte_lengths: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Start, end (code points, separator included) and tokens of each line of ``text``."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    bounds = np.flatnonzero(data == 10) + 1
    if not len(bounds) or bounds[-1] != len(data):
        bounds = np.append(bounds, len(data))
    ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
    counts = attribute(byte_lengths[ids], bounds)
    chars = np.cumsum((data & 0xC0) != 0x80)
    ends = chars[bounds - 1]
    return [0, *ends[:-1].tolist()], ends.tolist(), counts.tolist()


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, section, start, end, n_tokens``: one row for each line of each ``text``.

    The whole document is encoded once, so counts add up to the document's own number of tokens;
    encoding lines apart would not. Sections are lines with their ``\\n``; offsets are code points,
    end exclusive. Boundary rule: see :func:`attribute`. Null and empty texts have one section of no
    tokens; a repeated row repeats its sections; an empty table gives an empty result. Work is per
    row and streams through Arrow batches: nothing is shuffled, and no prefix is cut off. The rank
    file ``vocabulary`` (a path that the driver reads) goes with the job to its executors.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or spark.conf.get("replimerge.vocabulary", VOCABULARY)
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]
    schema = "doc_id long, section int, start long, end long, n_tokens long"
    arrow = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(SparkFiles.get(name))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                starts, ends, counts = section_rows(text, enc, lengths) if text else ([0], [0], [0])
                for col, part in zip(out, ([doc] * len(ends), range(len(ends)), starts, ends, counts), strict=True):
                    col.extend(part)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
