"""PII (operator 6): fixed patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, thinned

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run of the leading class is entered at its start only (or right
#: after a match, where a scan would go on), so that a long run is read once.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL_ON = re.compile(rf"{_LOCAL}++@{_HOST}++(\.{_HOST}++)+")
EMAIL = re.compile(rf"(?<!{_LOCAL}){EMAIL_ON.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := (EMAIL_ON.match(text, at) if at else None) or EMAIL.search(text, at):
        yield m.span()
        at = m.end()


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def is_card(s: str) -> bool:
    return 12 <= len(d := _digits(s)) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed; offsets are code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


# --- Regions, pieces, candidate segments -------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
#: Pieces of an entity at most: what bounds the dynamic program to n * MAX_PIECES segments.
MAX_PIECES = 18
_CONTEXT = 24


#: What ends a region: between two of its words lie white space in one line and punctuation only.
_SOLID = re.compile(r"[^\W_]|[\n\r\v\f]")
_WORD_AFTER = re.compile(r"[\x20\t]+\S+")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of white-space separated words that hold a digit or @, neighbours joined.

    Words of punctuation only don't part neighbours; an @ at either end of a word takes in the next word there.
    """
    start, end = -1, 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        left = max((text.rfind(c, end, m.start()) for c in " \n\t\r\v\f"), default=-1)
        left = max(left + 1, end)
        stop = _SPACE.search(text, m.end())
        right = stop.start() if stop else len(text)
        if text[left] == "@":
            at = left
            while at > end and text[at - 1] in " \t":
                at -= 1
            while at > end and not text[at - 1].isspace():
                at -= 1
            left = at
        if text[right - 1] == "@" and (after := _WORD_AFTER.match(text, right)):
            right = after.end()
        if start >= 0 and (left - end <= 1 or not _SOLID.search(text, end, left)):
            end = right
            continue
        if start >= 0:
            yield start, end
        start, end = left, right
    if start >= 0:
        yield start, end


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def span_features(s: str, before: str, after: str) -> list[int]:
    """Indices of the features of a whole candidate span and its neighbours; as many for every span."""
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    at, dots = s.count("@"), s.count(".")
    tail = s.rpartition("@")[2]
    groups = [len(g) for g in re.findall("[0-9]+", s)][-3:]
    near = lambda c: 0 if not c else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "@+." else 4
    values = (
        _bucket(digits, (1, 4, 7, 9, 12, 14, 16, 20)) * 2 + (letters > 0),
        min(at, 2) * 3 + (min(tail.count("."), 2) if at else 0),
        min(dots, 4) * 2 + (letters > 0),
        (s[0] == "+") * 2 + ("(" in s),
        ("-" in s) * 4 + (" " in s) * 2 + any(c in s for c in "/:;,=#$%&*|<>\"'"),
        (2 if is_card(s) else 1 if digits >= 12 else 0),
        (2 if dots == 3 and not letters and digits == len(s) - 3 and is_ip(s) else 1 if dots == 3 else 0),
        (3 if groups == [3, 3, 4] else 2 if groups[-2:] == [3, 4] else 1 if len(groups) > 1 else 0),
        near(before) * 5 + near(after),
        (0 if s[0].isalnum() else 1 if s[0] in "+(" else 2) * 2 + (s[-1].isalnum()),
        _bucket(len(s), (4, 8, 12, 16, 20, 28)),
    )
    return [i * 32 + v for i, v in enumerate(values)]


N_FEATURES = 11 * 32


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Piece boundaries of a region, candidate segments (first piece, piece after) and their features."""
    cuts = [start, *(m.end() for m in _PIECE.finditer(text, start, end))]
    segments, rows = [], []
    for i in range(len(cuts) - 1):
        c = text[cuts[i]]
        if not (c.isalnum() or c in "+(") or (c.isalnum() and i and text[cuts[i] - 1].isalnum() and cuts[i] > start):
            continue
        for j in range(i + 1, min(i + MAX_PIECES, len(cuts) - 1) + 1):
            s = text[cuts[i] : cuts[j]]
            if s[-1].isalnum() and len(s) >= 6 and _TRIGGER.search(s):
                before = text[cuts[i] - 1] if cuts[i] else ""
                after = text[cuts[j]] if cuts[j] < len(text) else ""
                segments.append((i, j))
                rows.append(span_features(s, before, after))
    return cuts, segments, np.array(rows, dtype=np.int32).reshape(len(rows), 11)


def _logsumexp(x: np.ndarray) -> float:
    m = float(np.max(x))
    return m + float(np.log(np.exp(x - m).sum()))


def _forward(n: int, segments: list[tuple[int, int]], scores: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Log sums over all segmentations of the pieces before (after, if reversed) each boundary."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for k, (i, j) in enumerate(segments):
        ends.setdefault(i if reverse else j, []).append((k, j if reverse else i))
    out = np.zeros(n + 1)
    for b in range(n - 1, -1, -1) if reverse else range(1, n + 1):
        plain = out[b + 1] if reverse else out[b - 1]
        out[b] = _logsumexp(np.concatenate([[plain], *[out[o] + scores[k] for k, o in ends.get(b, [])]]))
    return out


def _gradient(weights: np.ndarray, n: int, segments: list[tuple[int, int]], rows: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Gradient of the log-likelihood of the gold segmentation of one region, by forward and backward sums."""
    scores = weights[rows].sum(axis=1)
    a, b = _forward(n, segments, scores), _forward(n, segments, scores, reverse=True)
    first, last = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    expected = np.exp(a[first][:, None] + scores + b[last][:, None] - a[n])
    target = np.zeros_like(expected)
    for k, s in enumerate(segments):
        if s in gold:
            target[k, gold[s]] = 1.0
    out = np.zeros_like(weights)
    for f in range(rows.shape[1]):
        np.add.at(out, rows[:, f], target - expected)
    return out


def train_crf(samples: list[str], steps: int = 15_000, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights (feature x kind) by ``steps`` of AdaGrad ascent on texts labelled by the base patterns and their variants.

    Outside a segment a piece scores 0, so a kind's weights say how much likelier it is than none.
    Regions with a labelled span of more than ``MAX_PIECES`` pieces teach nothing and are left out.
    """
    cases = []
    for text in samples:
        for variant, spans in variants(text):
            found = list(regions(variant))
            assert all(any(a <= s and e <= b for a, b in found) for s, _, e in spans), "a labelled span lies outside the regions"
            for start, end in found:
                cuts, segments, rows = candidates(variant, start, end)
                at, known = {c: i for i, c in enumerate(cuts)}, set(segments)
                gold = {(at.get(s), at.get(e)): KINDS.index(k) for s, k, e in spans if start <= s and e <= end}
                if segments and known.issuperset(gold):
                    cases.append((len(cuts) - 1, segments, rows, gold))
    weights = np.full((N_FEATURES, len(KINDS)), -0.5)
    squares = np.full_like(weights, 1e-2)
    order = np.random.default_rng(5)
    for _ in range(-(-steps // max(len(cases), 1))):
        for c in order.permutation(len(cases)):
            g = _gradient(weights, *cases[c]) - decay * weights
            squares += g * g
            weights += rate * g / np.sqrt(squares)
    return weights


def other_forms(kind: str, old: str) -> list[str]:
    """Ways to write what a base pattern found that the patterns miss."""
    name, _, host = old.partition("@")
    plain, last = re.sub("[._]?[0-9]+", "", name) or name, ".".join(host.split(".")[-2:])
    short = re.sub(r"^\+[0-9]{1,3}[ .-]", "", old)
    digits = _digits(old)
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    forms = {
        "email": [f"{name} @ {host}", f"{plain} @ {last}", f"{plain}.{plain} @ {last}"],
        "ip": [old.replace(".", " . "), old.replace(".", "[.]")],
        "card": [" - ".join(fours), ".".join(fours), "  ".join(fours)],
        "phone": [short, re.sub("[.-]", r" \g<0> ", short), re.sub(r"^([0-9]{3})[ .-]", r"(\1) ", short), re.sub("[ -]", ".", short)],
    }
    return [f for f in dict.fromkeys(forms[kind]) if f != old and not any(s == 0 and e == len(f) for s, _, e in base_spans(f))]


def variants(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The text with its base spans, and the surroundings of each span with it in :func:`other_forms`."""
    spans = base_spans(text)
    yield text, spans
    for s, kind, e in spans:
        old, left, right = text[s:e], text[max(0, s - _CONTEXT) : s], text[e : e + _CONTEXT]
        for new in other_forms(kind, old):
            yield left + new + right, [(len(left), kind, len(left) + len(new))]
        if kind == "card":  # the pattern runs the number before it into the card and then drops both
            yield f"{left}12 {old}{right}", [(len(left) + 3, kind, len(left) + 3 + len(old))]
        if kind == "email":  # two words about an @, and no host
            name, _, host = old.partition("@")
            yield f"{left}{re.sub('[._]?[0-9]+', '', name) or name} @ {host.partition('.')[0]} {right}", []


def decode(text: str, weights: np.ndarray, margin: float = 0.5) -> list[Span]:
    """The best segmentation of each region, where a segment counts ``margin`` (log odds) less than its score.

    Boundaries and kinds are chosen jointly by that sum; all pieces in no segment count 0.
    """
    found: list[Span] = []
    for start, end in regions(text):
        cuts, segments, rows = candidates(text, start, end)
        if not segments:
            continue
        scores = weights[rows].sum(axis=1) - margin
        found += [(cuts[segments[k][0]], KINDS[int(scores[k].argmax())], cuts[segments[k][1]]) for k in best_segments(len(cuts) - 1, segments, scores.max(axis=1))]
    return found


def best_segments(n: int, segments: list[tuple[int, int]], gains: np.ndarray) -> list[int]:
    """Indices of the ``segments`` of ``n`` pieces that don't overlap and of which the ``gains`` sum to the most."""
    ends: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segments):
        if gains[k] > 0:
            ends.setdefault(j, []).append(k)
    total, back = [0.0] * (n + 1), [-1] * (n + 1)
    for b in range(1, n + 1):
        total[b] = total[b - 1]
        for k in ends.get(b, ()):
            if (t := total[segments[k][0]] + gains[k]) > total[b]:
                total[b], back[b] = t, k
    out, b = [], n
    while b > 0:
        if back[b] < 0:
            b -= 1
        else:
            out.append(back[b])
            b = segments[back[b]][0]
    return out[::-1]


def all_spans(text: str, weights: np.ndarray, margin: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with the decoded ones that touch none of them."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    taken = sorted((s, e) for s, _, e in base)
    starts = np.array([s for s, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], dtype=np.int64)) if taken else starts
    more = []
    for s, kind, e in decode(text, weights, margin):
        k = int(np.searchsorted(starts, e))  # base spans that begin before its end
        if k == 0 or reach[k - 1] <= s:
            more.append((s, kind, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[1]], x[2]))


def _text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


# --- On Spark ------------------------------------------------------------------------------------


def training_samples(docs: DataFrame, max_texts: int = 400, max_chars: int = 300) -> list[str]:
    """Up to ``max_texts`` stretches of ``max_chars`` about a digit or @, least hash first: the bound of the fit.

    Taken from some 100 times as many documents at most, by hash of doc_id. The spans themselves are
    looked for in every whole text.
    """
    near = F.regexp_extract("text", rf"(?s)(.{{0,{_CONTEXT}}}(?:\+[0-9]|[0-9@]).{{0,{max_chars - _CONTEXT}}})", 1)
    plus = F.regexp_extract("text", rf"(?s)(.{{0,{_CONTEXT}}}(?:\+[0-9]|[A-Za-z]@|[0-9]\.[0-9]|[0-9]{{4}}).{{0,{max_chars - _CONTEXT}}})", 1)
    some = thinned(docs, ["doc_id", "text"], 100.0 * max_texts)
    found = some.where(F.col("text").rlike("[0-9@]")).select(F.when(plus != "", plus).otherwise(near).alias("t"))
    return [r[0] for r in found.orderBy(F.xxhash64("t"), "t").limit(max_texts).collect()]


@lru_cache(maxsize=4)
def _weights(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw).reshape(N_FEATURES, len(KINDS))


def find_personal_data(docs: DataFrame, weights: np.ndarray, margin: float = 0.5) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` and ``spans`` for each row of ``docs`` (``doc_id, text``).

    Base spans come from the patterns; the field adds segments that touch none of them. Null and
    empty texts have no spans; repeated rows are searched each; an empty table gives an empty
    result. Whole texts are read; an entity has ``MAX_PIECES`` pieces at most, which makes the time
    proportional to the text's length.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    raw = weights.astype(np.float64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _weights(raw)
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1):
                base, every = all_spans(text.as_py() or "", w, margin)
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(_text(base).encode()).hexdigest(), _text(every)))
            cols = [b.column(0), *[pa.array([r[i] for r in out], pa.int64()) for i in range(4)], *[pa.array([r[i] for r in out], pa.string()) for i in (4, 5)]]
            yield pa.record_batch(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train_crf(training_samples(docs)))
