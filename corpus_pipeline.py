"""A corpus from raw documents: quality rules, near-dedup, decontamination, secrets, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replimerge.llm import decontamination, mixing, quality_rules, secrets, simhash
from replimerge.sources.shared import delete, scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Every stage takes rows with nulls in any column and any further columns, and returns these; an
# empty table gives an empty one. What else is odd, each says for itself.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts go, as texts of under ten words do. Null lang or source is a
    group of its own. Repeated rows are judged each, and alike.
    """
    return quality_rules.filter_quality(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least doc_id.

    Null and empty texts are copies of each other. Of rows that share a doc_id one stays; rows
    without doc_id all stay, as no row can stand for them.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark.

    Null and empty texts, and rows without doc_id, stay; all rows of a doc_id go if one has an item.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` made to fit.

    Null texts stay null; repeated rows are changed alike; without a found secret the models are the
    uniform one against what runs there are.
    """
    return secrets.redact_secrets(docs, secrets.train_markov(secrets.labelled_samples(docs.select("doc_id", "text"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size, source_size, target, taken`` (words).

    Null and empty texts have no words and are not taken; null source is a source of its own;
    repeated rows count each, and equal ones on a boundary share its words.
    """
    return mixing.mix_sources(docs).where(F.col("taken") > 0)


#: In order; each takes (spark, docs, sf_dir) and all but the last return the columns of documents.
STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secret_scans", hide_secrets),
    ("mixing", mix),
]

#: SimHash, Markov models and MinHash are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written to the shared folder and read back as the next one's.

    What a stage wrote is removed once the next one's rows are written; the last but one's rows stay, as the result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    last = None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
