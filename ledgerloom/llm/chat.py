"""Chat formatting with a grammar round trip.

A conversation is a series of turns, each rendered as ``<|turn|>role<|says|>text<|end|>`` and a line break. The
four marks are the template's only control strings, and a deterministic parser reads rendered text
back. Every turn is rendered as it is, parsed again and compared with its source; where they differ,
content that conflicts is escaped and the turn is rendered again, until source and parse are identical. The
escape puts one backslash after the ``<`` of a mark, behind backslashes that are there already, so it
can be undone exactly, and common marks of other templates are escaped in the same way.

Turns are ordered by turn, then role and text. Output rows hold runs of rendered turns of one conversation,
at most ``PART_CHARS`` characters unless a single turn is longer, so a conversation of any length
streams through a task. Assistants' texts are under the loss mask, as spans of the rendered text.

Defined results: a null text or role is empty; a null conversation id is a conversation of its own;
repeated turns are all kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import materialize

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Characters of rendered text in one output row.
PART_CHARS = 1 << 20

# Marks of this template and of other common ones, without their "<".
_NAMES = r"\|[a-z_]+\|>|/?s>|/?SYS>>"
_CONFLICT = re.compile(rf"<(\\*)(?={_NAMES})|\[(\\*)(?=/?INST\])")
_ESCAPED = re.compile(rf"<\\(\\*)(?={_NAMES})|\[\\(\\*)(?=/?INST\])")


def escape(text: str) -> str:
    """One more backslash in every mark, escaped or not."""
    return _CONFLICT.sub(lambda m: f"<\\{m[1]}" if m[0][0] == "<" else f"[\\{m[2]}", text)


def unescape(text: str) -> str:
    """One backslash less in every escaped mark; undoes :func:`escape`."""
    return _ESCAPED.sub(lambda m: f"<{m[1]}" if m[0][0] == "<" else f"[{m[2]}", text)


def _parse_raw(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text) as rendered; raises ValueError outside the grammar."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        says = rendered.find(SAYS, at)
        end = rendered.find(END, says)
        if says < 0 or end < 0 or rendered[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"turn at {at} isn't closed")
        role, text = rendered[at + len(TURN) : says], rendered[says + len(SAYS) : end]
        if TURN in role or TURN in text or SAYS in text:
            raise ValueError(f"mark inside the turn at {at}")
        out.append((role, text, says + len(SAYS), end))
        at = end + len(END) + 1
    return out


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns (role, text) of rendered text, unescaped."""
    return [(unescape(role), unescape(text)) for role, text, _, _ in _parse_raw(rendered)]


def render_turn(role: str, text: str, rounds: int = 3) -> tuple[str, int, int]:
    """One turn and the span of its text, escaped only if its parse differs from the source."""
    shown = [role, text]
    for _ in range(rounds):
        rendered = f"{TURN}{shown[0]}{SAYS}{shown[1]}{END}\n"
        try:
            back = _parse_raw(rendered)
            if len(back) == 1 and (unescape(back[0][0]), unescape(back[0][1])) == (role, text) and not _foreign(back[0]):
                return rendered, back[0][2], back[0][3]
        except ValueError:
            pass
        shown = [escape(s) if unescape(s) != source or _bare(s) else s for s, source in zip(shown, (role, text), strict=True)]
    raise ValueError("turn can't be rendered reversibly")


def _bare(shown: str) -> bool:
    """Whether a mark stands in it unescaped."""
    return any(not (m[1] or m[2]) for m in _CONFLICT.finditer(shown))


def _foreign(parsed: tuple[str, str, int, int]) -> bool:
    return _bare(parsed[0]) or _bare(parsed[1])


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """Rendered rows: conv_id, part, n_turns, formatted, loss_starts, loss_ends (code points within ``formatted``)."""
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, part, n, pieces, spans, size = object(), 0, 0, [], [], 0
        id_type = None

        def close() -> None:
            if n:
                done.append((at, part, n, "".join(pieces), [s for s, _ in spans], [e for _, e in spans]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [id_type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                rendered, start, end = render_turn(role, text)
                if n and (conv != at or size + len(rendered) > part_chars):
                    close()
                    part, n, pieces, spans, size = part + 1 if conv == at else 0, 0, [], [], 0
                at = conv
                if role == "assistant":
                    spans.append((size + start, size + end))
                pieces.append(rendered)
                n, size = n + 1, size + len(rendered)
            if done:
                yield out()
                done = []
        close()
        if done:
            yield out()

    schema = f"conv_id {kind}, part long, n_turns long, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
    return ordered.mapInArrow(run, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation from rendered text alone: n_turns, digests and lengths, by the parser and the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[list] = []
        id_type = None

        def close() -> None:
            if state is not None:
                conv, n, turns_sum, loss, loss_sum, size = state
                done.append([conv, n, turns_sum.hexdigest(), loss, loss_sum.hexdigest(), size])

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != state[0]:
                    close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for start, end in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    under = unescape(row["formatted"][start:end])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(row["formatted"])
            if done:
                yield out()
                done = []
        close()
        if done:
            yield out()

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)


def write_and_read(turns: DataFrame) -> DataFrame:
    """Format, write to the shared folder, and read back."""
    return read_conversations(materialize(format_conversations(turns), "conversations"))
