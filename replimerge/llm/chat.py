"""Chat formatting (operator 10): a reversible template, proved by parsing what was rendered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: turn := "### " head ":\n" body "\n</turn>\n". In a body a control string has a backslash before it,
#: one more than the backslashes that the text itself has there.
HEADS = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in HEADS.items()}
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_HEAD = re.compile(r"### (System|User|Assistant|role=[^:\n]*):\n")
_END = "\n</turn>\n"


class NotATurn(ValueError):
    """The text does not follow the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(body: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int] | None:
    """Role, start and end of the body, and end of the turn that begins at ``at``; None if it goes on beyond the text."""
    head = _HEAD.match(text, at)
    if not head:
        if "\n" in text[at:]:
            raise NotATurn(text[at : at + 40])
        return None
    for m in _CONTROL.finditer(text, head.end()):
        if m[1]:
            continue
        closes = m[2] == "</turn>" and m.start(2) > head.end() and text[m.start(2) - 1] == "\n"
        if not closes or text[m.end() : m.end() + 1] not in ("\n", ""):
            raise NotATurn(m[0])
        if m.end() == len(text):
            return None
        role = _ROLES.get(head[1]) if head[1] in _ROLES else unquote(head[1][5:], errors="surrogatepass")
        return role, head.end(), m.start(2) - 1, m.end() + 1
    return None


def render_turn(role: str, text: str) -> str:
    """The turn in the template, with the least escaping from which the parser gets the same role and text."""
    head = HEADS.get(role) or "role=" + quote(role, safe="", errors="surrogatepass")
    for body in (text, escape(text)):
        piece = f"### {head}:\n{body}{_END}"
        try:
            got = parse_turn(piece)
        except NotATurn:
            continue
        if got and got[0] == role and got[3] == len(piece) and unescape(piece[got[1] : got[2]]) == text:
            return piece
    raise NotATurn(f"no escaping recovers {role!r}")


class Reader:
    """Parses formatted text as it comes and keeps digests only, however long the conversation."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.rest += piece
        self.chars += len(piece)
        at = 0
        while at < len(self.rest) and (got := parse_turn(self.rest, at)):
            role, start, end, at = got
            text = unescape(self.rest[start:end])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.rest = self.rest[at:]

    def row(self, conv) -> tuple:
        if self.rest:
            raise NotATurn(f"conversation {conv} ends within a turn")
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _in_order(conversations: DataFrame) -> DataFrame:
    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    df = conversations.select(*cols)
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, formatted, loss_start, loss_end``: each turn in the template.

    Pieces of a conversation in the order of turn, role, text join to its formatted text. The loss
    mask is the body of assistant turns, as offsets into the piece (null elsewhere). Null role and
    text count as empty; every role is allowed; repeated rows are turns of their own. Work is per
    row: a conversation of any length is never gathered.
    """
    schema = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, turn, role, text = (c.to_pylist() for c in b.columns)
            pieces = [render_turn(r, t) for r, t in zip(role, text, strict=True)]
            spans = [parse_turn(p)[1:3] if r == "assistant" else (None, None) for r, p in zip(role, pieces, strict=True)]
            cols = [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(pieces, pa.string())]
            cols += [pa.array([s[k] for s in spans], pa.int32()) for k in (0, 1)]
            yield pa.record_batch(cols, names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.select(*cols).mapInArrow(run, schema)


def read_back(conversations: DataFrame) -> DataFrame:
    """Formats each conversation and reads it back with the parser: one row of digests for each.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; see
    :func:`format_turns` for nulls, roles and ties. Turns are sorted by Spark (which spills) and
    streamed, so a task holds one Arrow batch and not the conversation. Rows of null conv_id form
    one conversation; an empty table gives an empty result.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for b in batches:
            done = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if reader is None or conv != now:
                    done += [reader.row(now)] if reader else []
                    now, reader = conv, Reader()
                reader.feed(render_turn(role, text))
            if done:
                yield out(done)
        if reader:
            yield out([reader.row(now)])

    return _in_order(conversations).mapInArrow(run, schema)


PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return read_back(conv.unionByName(probe))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) + length('### ' || role || ':' || chr(10)) + 9 AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
