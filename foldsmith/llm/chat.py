r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it as context, and only
its text under the loss mask. Turns after the last assistant turn (or all turns, where no
assistant speaks) form one more example without loss, so that no turn is lost.

Template: ``### <role>: <text> </turn>`` and a line feed. Inside roles and texts the
strings ``\``, ``###`` and ``</turn>`` (in roles also ``:``) get a backslash in front, so a
text can never end a turn or open one, and the change can be undone.

Defined results: NULL role or text is empty; turns are ordered by (turn, role, text), NULL
first, so repeated turns stay; a NULL conversation is one conversation; an empty table gives
no example. Only the four named columns are read.

Rows are sorted by conversation and streamed, so a task holds one running prefix. Of a
conversation with more than ``BLOCK`` turns each block of targets is a group of its own,
which gets the turns before it as well; its examples repeat those turns anyway.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table

BLOCK = 256
BATCH_CHARS = 8_000_000
TARGET = "assistant"
OPEN, CLOSE = "### ", " </turn>\n"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_UNDO = re.compile(r"\\(\\|###|</turn>|:)")
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    r"""The turns of a formatted example, read from left to right.

    >>> parse(r"### user: a \</turn> </turn>" + "\n")
    [('user', 'a </turn>')]
    """
    turns, at = [], 0
    while at < len(formatted):
        at += len(OPEN)
        colon = at
        while formatted[colon] != ":":
            colon += len(_UNDO.match(formatted, colon).group()) if formatted[colon] == "\\" else 1
        end = colon + 2
        while True:
            mark = min(x for x in (formatted.find("\\", end), formatted.find("</turn>", end)) if x >= 0)
            if formatted[mark] != "\\":
                break
            end = mark + len(_UNDO.match(formatted, mark).group())
        turns.append((unescape(formatted[at:colon]), unescape(formatted[colon + 2 : mark - 1])))
        at = mark + len(CLOSE) - 1
    return turns


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, prefix, number = None, "", 0
    out: list[tuple] = []
    size = 0
    for frame in frames:
        for conv, block, pos, last, role, text in frame.itertuples(index=False):
            conv = None if pd.isna(conv) else int(conv)
            if (conv, block) != group:
                group, prefix, number = (conv, block), "", 0
            head = f"{OPEN}{escape(role, _ROLE)}: "
            body = escape(text)
            start = len(prefix) + len(head)
            prefix += head + body + CLOSE
            number += role == TARGET
            if pos // BLOCK == block and (last or role == TARGET):
                if role == TARGET:
                    out.append((conv, number, prefix, start, start + len(body)))
                else:
                    out.append((conv, number + 1, prefix, len(prefix), len(prefix)))
                size += len(prefix)
            if size >= BATCH_CHARS or len(out) >= 500:
                yield pd.DataFrame(out, columns=["conv_id", "example", "text", "loss_start", "loss_end"])
                out, size = [], 0
    yield pd.DataFrame(out, columns=["conv_id", "example", "text", "loss_start", "loss_end"])


def expand(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 1), text, loss_start, loss_end."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    rows = turns.select(
        F.col("conv_id").cast("long"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("pos", F.row_number().over(whole.orderBy(*order)) - 1)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("pos") / BLOCK), F.floor((F.col("n") - 1) / BLOCK))),
    )
    rows = rows.select("conv_id", "block", "pos", (F.col("pos") + 1 == F.col("n")).alias("last"), "role", "text")
    return (
        rows.repartition("conv_id", "block")
        .sortWithinPartitions("conv_id", "block", "pos")
        .mapInPandas(_expand, EXAMPLES)
    )


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests per conversation from its examples, which come in order."""

    def row():
        return (conv, len(turns), every, loss_chars, loss.hexdigest(), chars)

    conv, seen, turns, every, loss, loss_chars, chars = None, False, [], "", None, 0, 0
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for frame in frames:
        out = []
        for key, _, text, start, end in frame.itertuples(index=False):
            key = None if pd.isna(key) else int(key)
            if not seen or key != conv:
                if seen:
                    out.append(row())
                conv, seen, loss, loss_chars, chars = key, True, hashlib.sha256(), 0, 0
            turns = parse(text)
            every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            said = unescape(text[start:end])
            loss.update(said.encode())
            loss_chars += len(said)
            chars += len(text)
        yield pd.DataFrame(out, columns=columns)
    if seen:
        yield pd.DataFrame([row()], columns=columns)


def digests(examples: DataFrame) -> DataFrame:
    """Turns and trainable texts of each conversation, read back from its examples."""
    return (
        examples.repartition("conv_id")
        .sortWithinPartitions("conv_id", "example")
        .mapInPandas(
            _digests,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
            " formatted_chars long",
        )
    )


HARD = "\\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  count(*) OVER (PARTITION BY conv_id) AS n_turns,
  4 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + 2
  + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 9 AS size FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM n)
SELECT conv_id, max(n_turns) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n_turns THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""


@query("op1_chat_format", SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, TARGET, HARD)], turns.schema)
    return digests(expand(turns.unionByName(hard)))
