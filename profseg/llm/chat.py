r"""Chat formatting with a grammar round trip.

Grammar of the formatted text, a turn after another:

    turn   := "<s>" mode role "\n" body "</s>\n"
    mode   := "" | "!"                  "!": the body is escaped
    body   := "[INST] " text " [/INST]" for the role user, "<<SYS>>" text "<</SYS>>" for system, else text

A turn is rendered with its text as it is, reparsed by the deterministic parser and compared with its source; only when
they differ is it rendered again with its text escaped, and compared again. An escape is a backslash after the first
character of a control string; backslashes are doubled. Roles are always escaped, line ends in them as "\n". The parse
of a conversation is that of its turns, since the parser ends a turn at its first end mark and rejects any control
string inside a body. The loss mask covers the texts of the role assistant.

Nulls: a null text or role is empty; rows with a null conv_id are one conversation; null turns come first. Rows with
the same turn are ordered by role, then text. A conversation is streamed turn by turn, in the order of one sorted
partition, into running digests: memory is one turn, however many rows one conversation has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<s>", "</s>\n"
WRAP = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>")}
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)


class ParseError(ValueError):
    """The text isn't in the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    before, after = WRAP.get(role, ("", ""))
    name = escape(role).replace("\n", "\\\n")
    return f"{OPEN}{'!' * escaped}{name}\n{before}{escape(text) if escaped else text}{after}{CLOSE}"


def parse_turn(formatted: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """The turn at `at`: its role, its text, where its text stands, where the next turn begins."""
    if not formatted.startswith(OPEN, at):
        raise ParseError("no turn begins here")
    at += len(OPEN)
    escaped = formatted.startswith("!", at)
    at += escaped
    end = at
    while True:  # a line end belongs to the role if an odd number of backslashes stands before it
        end = formatted.find("\n", end)
        if end < 0:
            raise ParseError("a header without an end")
        marks = end - len(formatted[at:end].rstrip("\\")) - at
        if marks % 2 == 0:
            break
        end += 1
    name = formatted[at:end]
    if _CONTROL.search(name):
        raise ParseError("a control string in a header")
    role = unescape(name)
    before, after = WRAP.get(role, ("", ""))
    begin, stop = end + 1, formatted.find(CLOSE, end + 1)
    if stop < 0 or not formatted.startswith(before, begin) or not formatted.endswith(after, begin + len(before), stop):
        raise ParseError("a body without its marks")
    span = (begin + len(before), stop - len(after))
    body = formatted[span[0] : span[1]]
    if _CONTROL.search(body):
        raise ParseError("a control string in a body")
    return role, unescape(body) if escaped else body, span, stop + len(CLOSE)


def format_turn(role: str, text: str) -> str:
    """The first rendering that reads back as its source: plain, else escaped."""
    for escaped in (False, True):
        formatted = render_turn(role, text, escaped)
        try:
            role_back, text_back, _, end = parse_turn(formatted)
        except ParseError:
            continue
        if (role_back, text_back, end) == (role, text, len(formatted)):
            return formatted
    raise AssertionError("an escaped turn reads back as its source")


def parse(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """All turns of a formatted conversation: role, text and where the text stands."""
    turns, at = [], 0
    while at < len(formatted):
        role, text, span, at = parse_turn(formatted, at)
        turns.append((role, text, span))
    return turns


class _Digest:
    """What is read back from one conversation's formatted turns."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str) -> None:
        at = 0
        while at < len(formatted):
            role, text, _, at = parse_turn(formatted, at)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _sorted_turns(rows: DataFrame) -> DataFrame:
    turns = pick(rows, conv_id="long", turn="long", role="string", text="string")
    turns = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    # repartition() names no count, so that AQE sizes the partitions
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(rows: DataFrame) -> DataFrame:
    """Per row of a conversation: conv_id, turn, role and its formatted text, in the order of the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], ["conv_id", "turn", "role", "formatted"])

    return _sorted_turns(rows).mapInArrow(run, "conv_id long, turn long, role string, formatted string")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[str]]]:
    from itertools import groupby

    def turns() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

    for conv_id, group in groupby(turns(), key=lambda row: row[0]):
        yield conv_id, (format_turn(role, text) for _, role, text in group)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, its formatted text and the spans (begin, end) of its loss mask, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, formatted in _conversations(batches):
            whole = "".join(formatted)
            spans = [list(span) for role, _, span in parse(whole) if role == "assistant"]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([whole], pa.string()), pa.array([spans], pa.list_(pa.list_(pa.int64())))], ["conv_id", "formatted", "loss_spans"])

    return _sorted_turns(rows).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<bigint>>")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Per conversation what reading its formatted text back gives, as counts and digests."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
            found.clear()
            return out

        for conv_id, formatted in _conversations(batches):
            digest = _Digest()
            for turn in formatted:
                digest.take(turn)
            found.append((conv_id, *digest.row()))
            if len(found) == 4096:
                yield flush()
        if found:
            yield flush()

    return _sorted_turns(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row whose text is made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
