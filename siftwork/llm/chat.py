"""Chat formatting with a grammar round trip.

A turn is written ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The grammar reserves
``<|``: inside a text it may only stand with backslashes between its two
characters, one of which the parser takes away. Each rendered turn is parsed
again; a text that does not come back as it was is escaped, and the turn is
rendered anew until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import prepare, stored

START, END = "<|im_start|>", "<|im_end|>"
_CLASH, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CLASH.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\v")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "v": "|"}.get(m[1], m[1]), role)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns of a rendered conversation; ValueError where the grammar does not hold."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        close = rendered.find("<|", line)
        if line < 0 or "<|" in rendered[at + len(START) : line] or close < 0 or not rendered.startswith(END + "\n", close):
            raise ValueError(f"the turn at {at} does not end")
        out.append((unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : close])))
        at = close + len(END) + 1
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn and the span of its text in it."""
    head = f"{START}{escape_role(role)}\n"
    body = text
    for _ in range(2):
        rendered = f"{head}{body}{END}\n"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered, len(head), len(head) + len(body)
        except ValueError:
            pass
        body = escape(body)
    raise AssertionError("a turn cannot be rendered")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, place, rendered, loss_start, loss_end) per row of ``turns``, verified by parsing.

    The rendered conversation is the concatenation of its rows by turn and
    ``place`` (the role; ties: by the rendered turn). The loss span, in code points of
    ``rendered``, is the text of turns with role ``trained``, else empty. Null
    roles and texts are empty; null conversation ids form one conversation; an
    empty table gives an empty result.
    """
    prepare(turns.sparkSession)
    rows = turns.select(F.col(conv_id).cast("long"), F.col(turn).cast("long"), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, ends, places = [], [], [], []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rendered, a, b = render_turn(r, t)
                out.append(rendered)
                starts.append(a if r == trained else 0)
                ends.append(b if r == trained else 0)
                places.append(r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(places, pa.string()), pa.array(out, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["conv_id", "turn", "place", "rendered", "loss_start", "loss_end"],
            )

    return rows.mapInArrow(run, "conv_id bigint, turn bigint, place string, rendered string, loss_start bigint, loss_end bigint")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from what was written.

    A digest of a conversation has to take its turns in order, so a conversation
    is one sorted stream through one task; nothing but two hash states is held,
    however long it is.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "rendered").select("conv_id", "rendered", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, rendered, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for r, t in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{r}\n{t}\n".encode())
                loss = unescape(rendered[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(rendered)
            if len(done) >= 1000:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    return ordered.mapInArrow(run, schema)


def written(formatted: DataFrame) -> DataFrame:
    return stored(formatted, "chat")
