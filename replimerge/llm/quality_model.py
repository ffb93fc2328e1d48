"""Quality classifier (operator 4): tree paths as rules, lasso weights, compiled into columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import materialize, table, thinned, words
from .quality_rules import text_statistics

#: Statistic -> its column over the counts; labels, lang, source and doc_id are no inputs.
STATISTICS = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "exclamations": "n_exclaim / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
}
Condition = tuple[str, str, float]


@dataclass
class RuleModel:
    """Log odds: ``intercept`` plus the weight of each rule that holds; a rule is a conjunction of (statistic, <= or >, number)."""

    intercept: float = 0.0
    rules: list[tuple[float, list[Condition]]] = field(default_factory=list)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of each whole ``text``; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
    extra = {"n_exclaim": count("!"), "n_bars": count("|"), "n_stops": count("."), "n_distinct": F.size(F.array_distinct(words(F.col("text")))).cast("long")}
    own = docs.select(*keep, "text", *[c.alias(f"__x_{n}") for n, c in extra.items()])
    counted = text_statistics(own, [*keep, *[f"__x_{n}" for n in extra]]).withColumnsRenamed({f"__x_{n}": n for n in extra})
    return counted.select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


def tree_paths(nodes: list[dict]) -> list[list[tuple[int, str, float]]]:
    """The paths from the root (id 0) to every node below it, from a tree's rows of ``id, leftChild, rightChild, split``."""
    by, found = {n["id"]: n for n in nodes}, []

    def walk(at: int, path: list[tuple[int, str, float]]) -> None:
        n = by[at]
        if n["leftChild"] < 0:
            return
        feature, value = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        for child, op in ((n["leftChild"], "<="), (n["rightChild"], ">")):
            found.append([*path, (feature, op, value)])
            walk(child, found[-1])

    walk(0, [])
    return found


def forest_paths(spark: SparkSession, forest: RandomForestClassificationModel) -> list[list[tuple[int, str, float]]]:
    """:func:`tree_paths` of all trees, from the node table that Spark saves a forest as; at most trees x 2**(depth + 1) rows."""
    with scratch(spark) as folder:
        forest.save(f"{folder}/forest")
        rows = spark.read.parquet(f"{folder}/forest/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, list[dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r.asDict(recursive=True))
    return [p for t in sorted(trees) for p in tree_paths(trees[t])]


def simplify(path: list[tuple[int, str, float]], names: list[str]) -> tuple[Condition, ...]:
    """The tightest bound of each statistic and side, in a fixed order."""
    best: dict[tuple[str, str], float] = {}
    for i, op, value in path:
        k = (names[i], op)
        best[k] = value if k not in best else (min if op == "<=" else max)(best[k], value)
    return tuple(sorted((n, op, v) for (n, op), v in best.items()))


def holds(conditions: list[Condition] | tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, op, value in conditions:
        out = out & (F.col(name) <= F.lit(value) if op == "<=" else F.col(name) > F.lit(value))
    return F.when(out, F.lit(1.0)).otherwise(F.lit(0.0))


def fit_rules(labelled: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Fit the ensemble on rows of statistics and ``quality`` (0 or 1; others are left out).

    A random forest proposes rules, the paths to all its nodes; logistic regression with an L1
    penalty keeps few of them. Without rows of both labels, or where no statistic tells them apart,
    the model is the smoothed share of 1.
    """
    rows = labelled.where(F.col("quality").isin(0, 1)).select(*STATISTICS, F.col("quality").cast("double").alias("label"))
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = RuleModel(math.log((n.get(1.0, 0) + 1) / (n.get(0.0, 0) + 1)))
    if len(n) < 2:
        return share
    names = list(STATISTICS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", cacheNodeIds=False)
    grown = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("features")))
    rules = sorted({simplify(p, names) for p in forest_paths(rows.sparkSession, grown)})
    if not rules:
        return share
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    weights = lasso.fit(rows.select("label", array_to_vector(F.array(*[holds(r) for r in rules])).alias("features")))
    kept = [(float(w), list(r)) for w, r in zip(weights.coefficients, rules, strict=True) if w]
    return RuleModel(float(weights.intercept), kept)


def score_column(model: RuleModel) -> Column:
    odds = F.lit(model.intercept)
    for weight, conditions in model.rules:
        odds = odds + F.lit(weight) * holds(conditions)
    return 1 / (1 + F.exp(-odds))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Statistics and label of labelled documents that are not held out: ``max_rows`` labels at most, least hash of doc_id first, and every row of ``docs`` that has such a doc_id."""
    pick = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    pick = thinned(pick, ["doc_id"], 2.0 * max_rows).orderBy(F.xxhash64("doc_id"), "quality").limit(max_rows)
    return statistics(docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id"), ["quality"])


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    The model is fitted on ``max_rows`` labelled rows at most (a bound on the fit alone; every row is
    scored, over its whole text). ``score`` is the model's probability of ``quality`` 1; ``predicted``
    is 1 at ``threshold`` or more. Null and empty texts are scored as texts without a word; rows
    without doc_id are not held out; repeated rows get equal scores, and a score of just ``threshold``
    counts as 1; labels of unknown documents are unused; empty tables give an empty result, no labels
    a score of one half. Texts of any length are measured whole; other columns are not read.
    """
    model = fit_rules(materialize(training_rows(docs, labels, max_rows), "quality-training"))
    scored = statistics(docs, ["doc_id"]).withColumn("score", score_column(model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
