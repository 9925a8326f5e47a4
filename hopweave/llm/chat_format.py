"""Chat formatting with a grammar round trip.

A conversation is its turns, one after another; a turn is "### ", its role, ": ", its text, and "</turn>" as a line of
its own. In a role, backslash, colon and line break are written as \\\\, \\c and \\n. The parser is deterministic: it reads a
role up to ": ", then text up to "</turn>" without a backslash before it; "###" without a backslash before it is an
error in a text; a backslash goes from each run of backslashes before a "###" or "</turn>". A turn is rendered as it is
and parsed again; if what comes back is not the turn, its control strings get a backslash more, until it is.
A parsed turn uses up its rendering to the last character, so turns can be rendered alone and put together.

The loss mask covers the assistant's texts as they stand in the output.

Nulls and the like: a null role or text is empty; turns are in order of turn, then role, then text, nulls first,
so ties and repeated rows have one order; null conv_ids make one conversation; extra columns are ignored; an empty
table gives no rows. A conversation of any length streams through its task, sorted, a turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MARK, END, LEARNT = "### ", ": ", "\n</turn>\n", "assistant"
CONTROL = re.compile(r"\\*(?:###|</turn>)")
ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
_ROLE = {"\\": "\\\\", ":": "\\c", "\n": "\\n"}
_READ = {"\\\\": "\\", "\\c": ":", "\\n": "\n"}
OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def compose(role: str, body: str) -> tuple[str, int, int]:
    """A turn, and where its body stands in it."""
    head = HEAD + re.sub(r"[\\:\n]", lambda m: _ROLE[m[0]], role) + MARK
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and first and last place of the body, of each turn from `at` on."""
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise GrammarError(f"no turn begins at {at}")
        colon = text.find(MARK, at + len(HEAD))
        if colon < 0:
            raise GrammarError(f"the role at {at} has no end")
        body = colon + len(MARK)
        for m in CONTROL.finditer(text, body):
            if m[0][0] == "\\":
                continue
            end = m.start() - 1
            if end < body or not text.startswith(END, end):
                raise GrammarError(f"{m[0]} at {m.start()}")
            role = re.sub(r"\\[\\cn]", lambda x: _READ[x[0]], text[at + len(HEAD) : colon])
            yield role, unescape(text[body:end]), body, end
            at = end + len(END)
            break
        else:
            raise GrammarError(f"the turn at {at} has no end")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in a form that reads back as it was."""
    body = text
    while True:
        made = compose(role, body)
        try:
            back = [(r, t) for r, t, _, _ in parse(made[0])]
        except GrammarError:
            back = []
        if back == [(role, text)]:
            return made
        if body != text or escape(text) == text:
            raise GrammarError(f"{text!r} can't be escaped")
        body = escape(text)


_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            made, a, b = render(role or "", text or "")
            rows.append((made, a, b) if role == LEARNT else (made, None, None))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(x, type=f.type) for x, f in zip(cols, list(_TURN)[2:], strict=True))], schema=_TURN)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn's part of its conversation's output, and what of it is under the loss mask (null: nothing)."""
    return _typed(conversations).mapInArrow(_rendered, "conv_id long, turn long, formatted string, loss_from long, loss_to long")


def _typed(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))


class _Digest:
    """What is read back from a conversation's output, part by part."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.size = conv, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str) -> None:
        self.size += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LEARNT:
                self.loss += len(text)
                self.learnt.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.size


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for part in _rendered(batches):
        rows = []
        for conv, formatted in zip(part.column("conv_id").to_pylist(), part.column("formatted").to_pylist(), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv)
            now.read(formatted)
        if rows:
            yield batch(rows)
    if now is not None:
        yield batch([now.row()])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """What reads back from each conversation's output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = _typed(conversations).withColumns({k: F.coalesce(k, F.lit("")) for k in ("role", "text")})
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_read_back, OUT)
