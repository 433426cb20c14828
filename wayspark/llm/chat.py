"""Chat formatting with a template that is only called, never looked into.

``render(turns) -> str`` is the black box. Successive prefixes of a conversation are rendered; where the text
of one prefix continues that of the one before, the new part is the span of the new turn. A template that changes
what it wrote before (it rewrites history) shows as a prefix that is no continuation; such a conversation is
flagged and its spans are taken from the first character that changed.

Conversations are dealt out by a hash of their id and sorted inside the partitions, and each task streams its
rows. A conversation's turns and text are held by one task while it is rendered. By default every prefix is rendered from
turn 0, so that a template may look back as far as it likes; the work grows with the square of a conversation's turns.
For a template known to look back fewer than ``memory // 2`` turns the prefixes can slide instead: a new turn is rendered
behind the last ``memory`` turns at most. Each time the window slides, what it gives must be how the text before it ended;
where it is not, or the template refuses the window, that conversation is rendered again by whole prefixes.

The template marks turns by control strings and escapes those inside texts reversibly: a backslash precedes every
backslash and every ``<|`` of a text, so no control string occurs unescaped in a text.

Cases: a null text is empty; a null role is empty; turns are ordered by (turn, role, text), nulls first; repeated
rows are turns like others; rows of a null id are one conversation with a null id; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                       ("mask", pa.list_(pa.bool_())), ("rewrites", pa.int64())])
Turn = tuple[str, str]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\<|")


def unescape(text: str) -> str:
    """The inverse of ``escape``: a backslash stands for the character after it."""
    if "\\" not in text:
        return text
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out.append(text[at:cut] + text[cut + 1:cut + 2])
        at = cut + 2
    return "".join(out) + text[at:]


def chatml(turns: Sequence[Turn]) -> str:
    return "".join(f"{OPEN}{escape(role)}\n{escape(text)}{CLOSE}" for role, text in turns)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def ends_with(parts: list[str], tail: str) -> bool:
    """Whether the joined parts end with ``tail``; joins no more of them than it needs."""
    first, held = len(parts), 0
    while first and held < len(tail):
        first -= 1
        held += len(parts[first])
    return "".join(parts[first:]).endswith(tail)


def slide(parts: list[str], window: Sequence[Turn], render: Callable[[Sequence[Turn]], str]) -> str | None:
    """The window's rendering if the text so far ends with it; None where the template needs the turns before the window."""
    try:
        tail = render(window)
    except Exception:                                    # whole prefixes raise it again if it is not the window's fault
        return None
    return tail if ends_with(parts, tail) else None


def spans(turns: Iterator[Turn], render: Callable[[Sequence[Turn]], str], memory: int | None = None) -> tuple[str, list[int], list[int], int]:
    """(text, starts, ends, rewrites) of a conversation from renderings of its prefixes."""
    parts, starts, ends, rewrites, total = [], [], [], 0, 0
    said: list[Turn] = []
    first = 0                                           # the turn where the rendered window begins
    before = render([])
    parts.append(before)
    total = len(before)
    turns = iter(turns)
    for turn in turns:
        if memory is not None and len(said) - first >= memory:    # slide by half, so that the renderings stay amortised
            first = len(said) - memory // 2
            tail = slide(parts, said[first:], render)
            if tail is None:
                return spans(itertools.chain(said, [turn], turns), render)
            before = tail
        said.append(turn)
        now = render(said[first:])
        same = common(before, now)
        back = len(before) - same
        if back:                                        # history was rewritten: take back what changed
            rewrites += 1
            text = "".join(parts)
            parts = [text[:max(0, len(text) - back)]]
            total = len(parts[0])
            ends = [min(e, total) for e in ends]
            starts = [min(s, total) for s in starts]
        starts.append(total)
        parts.append(now[same:])
        total += len(now) - same
        ends.append(total)
        before = now
    return "".join(parts), starts, ends, rewrites


def format_chats(rows: DataFrame, render: Callable[[Sequence[Turn]], str] = chatml, *, train_roles: Sequence[str] = ("assistant",), memory: int | None = None) -> DataFrame:
    """(conv_id, formatted, starts, ends, mask, rewrites), one row per conversation; the mask marks turns to learn from."""
    placed = (rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
              .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    learn = frozenset(train_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        done: list[list] = [[] for _ in FORMATTED]
        weight = 0
        for key, group in itertools.groupby(turns(), key=lambda r: r[0]):
            roles: list[bool] = []

            def seen(group=group, roles=roles):
                for _, role, text in group:
                    roles.append(role in learn)
                    yield role, text
            text, starts, ends, rewrites = spans(seen(), render, memory)
            for column, value in zip(done, (key, text, starts, ends, roles, rewrites)):
                column.append(value)
            weight += len(text)
            if weight > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, FORMATTED)], schema=FORMATTED)
                done, weight = [[] for _ in FORMATTED], 0
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, FORMATTED)], schema=FORMATTED)

    return placed.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, starts array<long>, ends array<long>, mask array<boolean>, rewrites long")


def read_turn(span: str) -> Turn:
    """Role and text of one turn's span of ``chatml``."""
    role, _, text = span[len(OPEN):-len(CLOSE)].partition("\n")
    return unescape(role), unescape(text)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])


def digests(formatted: DataFrame, read: Callable[[str], Turn] = read_turn) -> DataFrame:
    """Counts and digests read back from formatted texts, their spans and their mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in DIGEST]
            for key, text, starts, ends, mask, rewrites in zip(*(batch.column(c).to_pylist() for c in range(6))):
                every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for start, end, learn in zip(starts, ends, mask):
                    role, said = read(text[start:end])
                    every.update(f"{role}\n{said}\n".encode())
                    if learn:
                        loss.update(said.encode())
                        chars += len(said)
                for column, value in zip(out, (key, len(starts), every.hexdigest(), chars, loss.hexdigest(), len(text), rewrites)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, DIGEST)], schema=DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
