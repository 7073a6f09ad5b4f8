r"""Conversations as training text in windows of a token budget.

A turn is written as `### role: text</turn>` and a line end. Inside roles and texts a backslash goes before each
backslash, `###`, `</turn>` and (in roles) colon, so that control strings never occur unescaped and reading back
restores every text. Prefix sums of turn tokens choose the spans: a window holds as many whole turns as the budget has
room for, after the system turn, which every window repeats, and as much of the preceding turns as the history budget
allows. The loss mask lists the code point ranges of assistant texts; repeated turns are outside it, so each assistant
text is a target once.

Turns are sorted by conversation and read as a stream; a task holds one window's turns, however long the conversation.

Edge cases: null texts and roles are empty; a turn beyond the budget has a window to itself, marked over_budget; equal
turn numbers are ordered by role, then text; rows with a null conv_id form one conversation; an empty table has no
windows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import TokenBytes, rows_to_batch

OPEN, CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_WINDOW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_context", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_WINDOW_DDL = "conv_id bigint, window bigint, text string, n_context bigint, n_new bigint, n_tokens bigint, over_budget boolean, loss array<struct<start:bigint,end:bigint>>"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn as written, start and end of its text in it)."""
    head = OPEN + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def unescaped(text: str, mark: str, at: int) -> int:
    """Place of the first mark from `at` on that no backslash escapes, by whole-string searches."""
    while True:
        found = text.index(mark, at)
        start = found
        while start > at and text[start - 1] == "\\":
            start -= 1
        if (found - start) % 2 == 0:
            return found
        at = found + 1


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window. Reads by searches for marks, so memory is that of the texts."""
    out, at = [], 0
    while at < len(window):
        colon = unescaped(window, ":", at + len(OPEN))
        end = unescaped(window, CLOSE, colon + 2)
        out.append((unescape(window[at + len(OPEN) : colon]), unescape(window[colon + 2 : end])))
        at = end + len(CLOSE)
    return out


class Turn:
    __slots__ = ("role", "start", "end", "text", "tokens")

    def __init__(self, role: str, text: str, count):
        self.role = role
        self.text, self.start, self.end = format_turn(role, text)
        self.tokens = count(self.text)


def windows_of(turns: Iterator[Turn], budget: int, history: int) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """(context turns, new turns) of each window of a conversation.

    past holds turns of earlier windows that history may repeat, new those of the window that is open; sums[i] is the
    prefix sum of the tokens of the first i turns of past. Context gives way to a new turn that needs its room.
    """
    system: list[Turn] = []
    past: list[Turn] = []
    new: list[Turn] = []
    new_tokens = 0

    def window() -> tuple[list[Turn], list[Turn]]:
        head = [] if not system or new[0] is system[0] else system
        room = min(history, budget - new_tokens - sum(t.tokens for t in head))
        sums = [0]
        for t in past:
            sums.append(sums[-1] + t.tokens)
        start = bisect.bisect_left(sums, sums[-1] - max(room, 0))
        return head + [t for t in past[start:] if not system or t is not system[0]], new

    for turn in turns:
        if not past and not new and not system and turn.role == "system":
            system = [turn]
        fixed = system[0].tokens if system and new and new[0] is not system[0] else 0
        if new and fixed + new_tokens + turn.tokens > budget:
            yield window()
            past = past + new
            tokens = 0
            for i in range(len(past) - 1, -1, -1):
                tokens += past[i].tokens
                if tokens > history:
                    past = past[i + 1 :]
                    break
            new, new_tokens = [], 0
        new.append(turn)
        new_tokens += turn.tokens
    if new:
        yield window()


def formatted(rows: DataFrame, tokenizer_path: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """The windows of conversations (conv_id, turn, role, text): text, its context and new turns, tokens and loss ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes.of(tokenizer_path)
        count = lambda text: len(tokens.encode(text)) // 4
        stream = ((c, r or "", t or "") for batch in batches for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))))
        out: list[tuple] = []
        for conv_id, group in itertools.groupby(stream, key=lambda x: x[0]):
            for number, (context, new) in enumerate(windows_of((Turn(r, t, count) for _, r, t in group), budget, history)):
                at, loss = sum(len(t.text) for t in context), []
                for t in new:
                    if t.role == "assistant" and t.end > t.start:
                        loss.append({"start": at + t.start, "end": at + t.end})
                    at += len(t.text)
                n = sum(t.tokens for t in context + new)
                out.append((conv_id, number, "".join(t.text for t in context + new), len(context), len(new), n, n > budget, loss))
                if len(out) >= 500:
                    yield rows_to_batch(out, _WINDOW)
                    out = []
        yield rows_to_batch(out, _WINDOW)

    columns = F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    return rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _WINDOW_DDL)


def digest(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x for batch in batches for x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "n_context", "loss"))))
        out: list[tuple] = []
        for conv_id, group in itertools.groupby(stream, key=lambda x: x[0]):
            turns, loss, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, n_context, ranges in group:
                for role, body in read_turns(text)[n_context:]:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                for r in ranges:
                    target = unescape(text[r["start"] : r["end"]])
                    loss.update(target.encode("utf-8", "surrogatepass"))
                    n_loss += len(target)
                n_chars += len(text)
            out.append((conv_id, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) >= 2000:
                yield rows_to_batch(out, _DIGEST)
                out = []
        yield rows_to_batch(out, _DIGEST)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, _DIGEST_DDL)
