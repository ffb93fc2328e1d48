"""Secret scans (operator 5): fixed patterns, and character Markov models for what they miss."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import let, materialize, percentile_of_counts, table

#: The base patterns, in the order in which kinds sort.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
MIN_VALUE = 6
#: A run that the models score; ``random`` is the kind of span that they add.
RUN = r"[A-Za-z0-9+/_.=-]"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Alphabets that random strings are drawn from, smallest first, and their sizes.
ALPHABETS = [("[0-9]", 10), ("[0-9a-f]", 16), ("[0-9A-F]", 16), ("[a-z]", 26), ("[A-Z]", 26), ("[a-z0-9]", 36), ("[A-Z0-9]", 36), ("[A-Za-z0-9]", 62)]
SPAN = "struct<s:int,e:int,m:string>"
#: Matches of which the offsets are summed at a time; bounds the copying in long lists.
_BLOCK = 128


def run_of(least: int) -> str:
    """A run of ``least`` or more characters."""
    return rf"{RUN}{{{least},}}"


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as ``array<struct<s, e, m>>``: offsets in code points and the match.

    ``split`` gives what lies between the matches and ``regexp_extract_all`` the matches; the sums of
    their lengths are the offsets.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(gaps: Column, found: Column) -> Column:
        lens = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        return let(lens, offsets)

    def offsets(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int")), lambda b: F.slice(z, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(blocks, within)

    def within(blocks: Column) -> Column:
        total = lambda blk: F.aggregate(blk, F.lit(0), lambda a, x: a + x["g"] + F.length(x["m"]))
        sums = F.transform(blocks, total)
        begins = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["p"] + n).alias("p"), F.array_append(a["out"], a["p"]).alias("out")),
            lambda a: a["out"],
        )
        return F.flatten(F.zip_with(blocks, begins, spread))

    def spread(block: Column, begin: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            s = a["p"] + x["g"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("p"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("p"), none.alias("out")), step, lambda a: a["out"])

    pieces = let(
        F.struct(F.split(text, pattern).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
        lambda x: F.when(F.size(x["m"]) > 0, placed(x["g"], x["m"])).otherwise(none),
    )
    return F.when(text.rlike(pattern), pieces).otherwise(none)


def _long_value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE


def with_base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``__t`` (text, null as empty) and the spans of each base kind."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    for kind, pattern in KINDS.items():
        spans = find_spans(F.col("__t"), pattern)
        df = df.withColumn(kind, F.filter(spans, lambda x: _long_value(x["m"])) if kind == "assign" else spans)
    return df


def without(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(span)`` in place of each of the ``spans`` (structs with ``s, e``, in order, none overlapping)."""

    def put(x: Column) -> Column:
        end = lambda i: F.coalesce(F.get(x["z"], i - 1)["e"], F.lit(0))
        pieces = F.transform(x["z"], lambda p, i: F.concat(F.substr(x["t"], end(i) + 1, p["s"] - end(i)), fill(p)))
        last = end(F.size(x["z"]))
        return F.concat(F.array_join(pieces, ""), F.substr(x["t"], last + 1, F.length(x["t"]) - last))

    return let(F.struct(text.alias("t"), spans.alias("z")), lambda x: F.when(F.size(x["z"]) > 0, put(x)).otherwise(x["t"]))


def with_rest(base: DataFrame) -> DataFrame:
    """Adds ``__rest``: the text with blanks in place of what the base patterns match, so that offsets stay."""
    blank = lambda p: F.repeat(F.lit(" "), p["e"] - p["s"])
    rest = F.col("__t")
    for kind in KINDS:
        rest = without(rest, F.col(kind), blank)
    return base.withColumn("__rest", rest)


def _codes(token: Column) -> Column:
    """Position of each character in ``ALPHABET``."""
    places = [ALPHABET.find(chr(i)) for i in range(128)]
    at = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.get(at, F.ascii(c)))


def labelled_samples(docs: DataFrame, least: int = 8) -> DataFrame:
    """``token, label``: values that the base patterns find (1), and runs of ``least`` or more in the rest of the texts (0).

    From the whole text of every row; of ``docs``, ``text`` alone is read.
    """
    none = F.array().cast("array<string>")
    base = with_rest(with_base_spans(docs, []))
    value = F.transform("assign", lambda x: F.regexp_extract(x["m"], ASSIGN, 2))
    secret = F.concat(value, F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))
    other = F.regexp_extract_all("__rest", F.lit(run_of(least)), F.lit(0))
    both = base.select(
        F.array(
            F.struct(F.lit(1).alias("label"), F.coalesce(secret, none).alias("tokens")),
            F.struct(F.lit(0).alias("label"), F.coalesce(other, none).alias("tokens")),
        ).alias("__b")
    )
    return both.select(F.explode("__b").alias("__b")).select("__b.label", F.explode_outer("__b.tokens").alias("token"))


@dataclass(frozen=True)
class Markov:
    """Two models of random strings against one of ordinary runs, as log values of character pairs, row by row of ``ALPHABET``.

    ``trained``: log ratio of a pair in found secrets over ordinary runs. ``plain``: minus the log of a
    pair in ordinary runs; with the log of an alphabet's size taken off, the ratio of the uniform
    model of that alphabet. ``min_llr``: the ratio from which a run is a secret.
    """

    trained: list[float]
    plain: list[float]
    min_llr: float


def train_markov(samples: DataFrame, uniform: float = 0.5, smoothing: float = 0.1, false_alarms: float = 1e-4, least: int = 16) -> Markov:
    """The models of ``samples`` (``token, label``), and the threshold at a rate of ``false_alarms``.

    Character pairs are counted; only the table of pairs, whose size the alphabet bounds, comes to the
    driver. Secrets are few and of few kinds, so their model is mixed with the uniform one by the share
    ``uniform``; counts of ordinary runs get ``smoothing``. An ordinary run reaches a ratio of
    ``-log(false_alarms)`` with that probability at most if its model is right; where it is not, the
    threshold is what that share of all ordinary runs of ``least`` characters or more exceeds, exactly:
    runs are counted by ratio, those below the threshold of the model together, and no task gets them whole.
    Null tokens count for nothing; without samples of a label its model is uniform. ``samples`` is read twice.
    """
    n = len(ALPHABET)
    pairs = lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(c, i) * n + x)
    counts = (
        samples.select("label", F.explode_outer(let(_codes(F.coalesce("token", F.lit(""))), pairs)).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.count("pair").alias("n"))
    )
    seen = {(r[0], r[1]): r[2] for r in counts.where("pair is not null").collect()}
    trained, plain = [], []
    for a in range(n):
        row = lambda label: [seen.get((label, a * n + b), 0) for b in range(n)]  # noqa: B023, E731
        secret, ordinary = row(1), row(0)
        s, p = sum(secret), sum(ordinary)
        for b in range(n):
            of_secret = uniform / n + (1 - uniform) * (secret[b] / s if s else 1 / n)
            of_plain = (ordinary[b] + smoothing) / (p + smoothing * n)
            trained.append(round(math.log(of_secret / of_plain), 4))
            plain.append(round(-math.log(of_plain), 4))
    model = Markov(trained, plain, -math.log(false_alarms))
    runs = samples.where((F.col("label") == 0) & (F.length("token") >= least)).select(likelihood_ratio(F.col("token"), model).alias("llr"))
    ratios = runs.select(F.greatest("llr", F.lit(model.min_llr)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    with scratch(samples.sparkSession):
        reached = percentile_of_counts(materialize(ratios, "ratios"), 1 - false_alarms)
    return model if reached is None else replace(model, min_llr=reached)


def alphabet_size(token: Column) -> Column:
    """Size of the smallest of ``ALPHABETS`` that holds every character of ``token``."""
    out = F.lit(float(len(ALPHABET)))
    for pattern, size in reversed(ALPHABETS):
        out = F.when(token.rlike(rf"\A{pattern}*\z"), F.lit(float(size))).otherwise(out)
    return out


def likelihood_ratio(token: Column, model: Markov) -> Column:
    """Log-likelihood ratio of ``token``, the better of the two random models: above 0, it looks more like a random string."""
    n = len(ALPHABET)
    logs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")
    trained, plain = logs(model.trained), logs(model.plain)

    def best(x: Column) -> Column:
        total = lambda values: F.aggregate(x["p"], F.lit(0.0), lambda a, i: a + F.coalesce(F.get(values, i), F.lit(0.0)))
        return F.greatest(total(trained), total(plain) - x["size"] * F.size(x["p"]))

    pairs = lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(c, i) * n + x)
    return let(F.struct(let(_codes(token), pairs).alias("p"), F.log(alphabet_size(token)).alias("size")), best)


def scan_secrets(docs: DataFrame, model: Markov, keep: list[str], least: int = 16) -> DataFrame:
    """``keep``, ``__t`` and the spans of each kind: ``assign, access, hex`` by pattern, ``random`` by the models.

    ``random``: a run of ``least`` or more characters in what the base patterns leave of the text,
    either side of their matches, whose log-likelihood ratio is the model's threshold or more. Null
    text is empty; repeated rows are scanned each; an empty table gives an empty result; whole texts
    are read, and offsets and lists have no cap. Of ``docs``, ``keep`` and ``text`` alone are read.
    """
    base = with_rest(with_base_spans(docs, keep))
    runs = find_spans(F.col("__rest"), run_of(least))
    odd = F.filter(runs, lambda x: likelihood_ratio(x["m"], model) >= model.min_llr)
    return base.withColumn("random", odd).drop("__rest")


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""
    order = [*KINDS, "random"]

    def tagged_as(kind: str) -> Column:
        rank = F.lit(order.index(kind))
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), rank.alias("k"), x["e"].alias("e")))

    names = F.array(*[F.lit(k) for k in order])
    joined = F.transform(F.sort_array(F.concat(*[tagged_as(k) for k in kinds])), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"]))
    return F.array_join(joined, ",")


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in [*KINDS, "random"]]
    return scanned.select(*keep, *counts, F.sha2(span_list(list(KINDS)), 256).alias("base_sha256"), span_list([*KINDS, "random"]).alias("spans"))


def hidden_spans() -> Column:
    """What is hidden of a scanned text, in order and without overlaps: the value of an assignment, and other secrets whole."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    part = F.transform("assign", lambda x: F.struct((x["e"] - value(x["m"])).alias("s"), x["e"].alias("e")))
    whole = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in ("access", "hex", "random")]

    def add(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(x["s"] < last["e"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.array_append(out, x))

    return F.aggregate(F.sort_array(F.concat(part, *whole)), F.array().cast("array<struct<s:int,e:int>>"), add)


def redact_secrets(docs: DataFrame, model: Markov, mark: str = "[SECRET]", least: int = 16) -> DataFrame:
    """``docs`` with every span of :func:`scan_secrets` replaced by ``mark`` in its text, and ``n_chars``, if there, made to fit.

    Of an assignment the value goes and the name stays; spans that overlap get one mark. Rows and
    columns stay as they are, and so do texts without a secret, null ones included; repeated rows
    are changed alike; an empty table stays empty.
    """
    scanned = scan_secrets(docs.select(F.struct("*").alias("__doc"), "text"), model, ["__doc"], least)
    text = F.when(F.col("__doc.text").isNotNull(), without(F.col("__t"), hidden_spans(), lambda _: F.lit(mark)))
    new = {"text": text} | ({"n_chars": F.length("__new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    out = scanned.select("__doc", text.alias("__new"))
    return out.select(*[F.col("__new").alias(c) if c == "text" else new[c].alias(c) if c in new else F.col(f"__doc.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan_secrets(docs, train_markov(labelled_samples(docs)), ["doc_id"]), ["doc_id"])
