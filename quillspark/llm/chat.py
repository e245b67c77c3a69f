"""Chat formatting: conversations through a black-box template, with each turn's span and a loss mask.

Method. The template is only ever called: all successive prefixes of the turns are rendered and consecutive outputs
compared; what an output adds to the one before it is the turn's span. Where an output doesn't begin with the one
before, the template rewrites history: the conversation is flagged and gets no spans and no loss. Where a turn's text
lies in its span is found by rendering it with one-character texts: they differ just there, and what stands around is
the turn's frame; frames are kept by role and position and found anew where they don't fit.

Defined cases: null text or role: empty. Turns with equal numbers follow each other by role, then text. Rows without
conv_id form one conversation. Extra columns are ignored. A conversation is held by one task; its rows stream through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What a text must not contain as such: the template's own marks and those that common models take for control.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

#: Escaped strings of a task, emptied at HELD characters (their sum stands under None): a turn comes back in all later prefixes.
ESCAPED: dict = {None: 0}
HELD = 1 << 25


def escape(s: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    found = ESCAPED.get(s)
    if found is None:
        found = re.sub("|".join([r"\\", *map(re.escape, CONTROL)]), lambda m: m[0][0] + "\\" + m[0][1:], s)
        if ESCAPED[None] > HELD:
            ESCAPED.clear()
        ESCAPED[s] = found
        ESCAPED[None] = ESCAPED.get(None, 0) + len(s)
    return found


def unescape(s: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: m[1], s) if "\\" in s else s


def template(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(r)}{TEXT}{escape(t)}{END}\n" for r, t in turns)


def spans_of(turns: list[tuple[str, str]], render: Callable[[list[tuple[str, str]]], str] = template, frames: dict | None = None) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, (start, end, text start, text end) of each turn, whether history was rewritten).

    Every prefix is rendered and compared with the one before it, however many turns there are.
    """
    frames = {} if frames is None else frames
    out: list[tuple[int, int, int, int]] = []
    before = ""
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            return render(turns), [], True
        at, span, key = len(before), now[len(before) :], (role, k == 0)
        head, tail = frames.get(key, (None, ""))
        if head is None or len(span) < len(head) + len(tail) or not (span.startswith(head) and span.endswith(tail)):
            a, b = (render([*turns[:k], (role, x)])[at:] for x in "ab")
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
            if n is None:  # the template leaves such texts out
                head, tail = span, ""
            else:
                head, tail = a[:n], a[n + 1 :]
                frames[key] = (head, tail)
        out.append((at, len(now), at + len(head), len(now) - len(tail)))
        before = now
    return before, out, False


def format_conversations(rows: DataFrame, render: Callable[[list[tuple[str, str]]], str] = template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, spans: array of (role, start, end, text_start, text_end, in_loss), rewrites."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())]))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", kind), ("rewrites", pa.bool_())])
    names = schema.names

    def run(batches):
        frames: dict = {}

        def done(key, turns) -> dict:
            out, spans, rewrites = spans_of(turns, render, frames)
            spans = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "in_loss": r in trained} for (r, _), (a, b, c, d) in zip(turns, spans, strict=False)]
            return dict(zip(names, (key, len(turns), out, spans, rewrites), strict=True))

        at: tuple | None = None
        turns: list[tuple[str, str]] = []
        for batch in batches:
            ready = []
            for key, role, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if at != (key,):
                    if at:
                        ready.append(done(at[0], turns))
                    at, turns = (key,), []
                turns.append((role, t))
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
        if at:
            yield pa.RecordBatch.from_pylist([done(at[0], turns)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long, in_loss: boolean>>, rewrites boolean")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))

    def run(batches):
        for b in batches:
            out = []
            for key, n, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "spans")), strict=True):
                parts = [(s["role"], unescape(text[s["text_start"] : s["text_end"]]), s["in_loss"]) for s in spans]
                loss = "".join(t for _, t, on in parts if on)
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((key, n, digest("".join(f"{r}\n{t}\n" for r, t, _ in parts)), len(loss), digest(loss), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_conversations(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _escaped_length(column: str) -> str:
    each = ["\\", *CONTROL]
    return f"length({column})" + "".join(f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in each)


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN + TEXT + END) + 1} + {_escaped_length("role")} + {_escaped_length("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
