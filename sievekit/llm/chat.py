"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens
choose the spans: a window takes as many further turns as fit the token budget,
beside the system turn (kept in every window) and a limited number of turns
repeated from before. Repeated turns give context only: the loss mask covers each
assistant text in the one window where it is new, so every target is trained on
exactly once. A window is within the budget, unless the system turn and one
more turn alone exceed it; then it holds just these.

The template marks a turn as ``<|im_start|>role`` newline text ``<|im_end|>``
newline. A text may hold such marks itself; every ``<``, backslashes, ``|`` run
inside a text gets one more backslash, which reading back removes again.

Conversations are streamed: rows are hashed by conversation, sorted by turn inside
partitions and read one by one, so a conversation never sits whole in memory: the
state is one window and its history. Texts of a window are bounded by the budget
or by one turn.

Edge cases: null text or role is empty; turns with the same number are ordered by
role, then text; null conv_id is a conversation of its own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

WINDOW_TYPE = (
    "conv_id long, window int, first_turn int, n_new int, n_tokens int, formatted string,"
    " targets array<struct<start:int,end:int>>"
)
DIGEST_TYPE = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int32()), ("n_new", pa.int32()),
    ("n_tokens", pa.int32()), ("formatted", pa.string()),
    ("targets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])
ROWS = 512


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


# A mark of the template (texts hold none, as theirs are escaped), up to four letters or digits of ASCII,
# any other letter or mark alone.
_TOKEN = re.compile(r"<\|im_(?:start|end)\|>|[A-Za-z0-9_]{1,4}|[^A-Za-z0-9_ ]")


def token_count(text: str) -> int:
    """Tokens of a formatted turn, about as many as a vocabulary of pieces gives; a long word or a
    sentence without blanks counts by its length."""
    return len(_TOKEN.findall(text))


def escape_role(role: str) -> str:
    """As ``escape``, and a line end becomes backslash n, since a line end closes the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}"


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text in ``formatted``."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        turns.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(CLOSE)
    return turns


class _Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, int] | None = None
        self.past: list[tuple[str, int]] = []  # the last turns, for repetition
        self.new: list[tuple[str, int, bool]] = []
        self.n_new_tokens, self.window, self.turn = 0, 0, 0
        self.context: list[tuple[str, int]] = []

    def _context(self, tokens: int) -> list[tuple[str, int]]:
        """What a window that begins with a turn of so many tokens repeats: the system turn, and the
        last turns that fit beside both, in half of the budget at most."""
        if not self.window:
            return []
        kept, room = [], min(self.budget // 2, self.budget - tokens - (self.system[1] if self.system else 0))
        for turn in reversed(self.past):
            room -= turn[1]
            if room < 0:
                break
            kept.insert(0, turn)
        return ([self.system] if self.system else []) + kept

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = format_turn(role, text)
        tokens = token_count(turn)
        if self.new and self.n_new_tokens + sum(n for _, n in self.context) + tokens > self.budget:
            yield self.close()
        if not self.new:
            self.context = self._context(tokens)
        self.new.append((turn, tokens, role == "assistant"))
        self.n_new_tokens += tokens
        if not self.turn and role == "system":
            self.system = (turn, tokens)
        self.turn += 1

    def close(self) -> dict:
        context = self.context
        parts, targets, at = [t for t, _ in context], [], sum(len(t) for t, _ in context)
        for turn, _, is_target in self.new:
            if is_target:
                start = at + turn.index("\n") + 1
                targets.append({"start": start, "end": at + len(turn) - len(CLOSE)})
            parts.append(turn)
            at += len(turn)
        out = {
            "conv_id": self.conv_id, "window": self.window, "first_turn": self.turn - len(self.new),
            "n_new": len(self.new), "n_tokens": self.n_new_tokens + sum(n for _, n in context),
            "formatted": "".join(parts), "targets": targets,
        }
        started_with_system = not self.window and self.system is not None
        fresh = [(t, n) for t, n, _ in self.new][1 if started_with_system else 0 :]
        self.past = (self.past + fresh)[-self.history :] if self.history else []
        self.new, self.n_new_tokens, self.window = [], 0, self.window + 1
        return out


def _rows(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in found:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """All windows of all conversations, in order inside partitions: see WINDOW_TYPE.

    ``targets`` bounds, in code points of ``formatted``, the texts under the loss mask.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: _Windows | None = None
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now.close()
                    now = _Windows(conv_id, budget, history)
                yield from now.add(role or "", text or "")
        if now is not None:
            yield now.close()

    turns = conversations.select("conv_id", "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _rows(stream(batches), _ARROW), WINDOW_TYPE)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads windows back, in the order ``windows`` gives them, and sums up each conversation."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row, turns, loss = None, hashlib.sha256(), hashlib.sha256()

        def done() -> dict:
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            for w in batch.to_pylist():
                if row is None or row["conv_id"] != w["conv_id"]:
                    if row is not None:
                        yield done()
                    row = {"conv_id": w["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                read = read_back(w["formatted"])
                for role, text, _, _ in read[len(read) - w["n_new"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                for span in w["targets"]:
                    text = unescape(w["formatted"][span["start"] : span["end"]])
                    loss.update(text.encode())
                    row["loss_chars"] += len(text)
                row["n_turns"] += w["n_new"]
                row["formatted_chars"] += len(w["formatted"])
                row["n_windows"] += 1
        if row is not None:
            yield done()

    return formatted.mapInArrow(lambda batches: _rows(stream(batches), _DIGEST), DIGEST_TYPE)
