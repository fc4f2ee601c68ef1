"""Chat formatting in windows of a token budget, with loss masks."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import ready
from locusmill.llm.packing import default_tokenizer, word_ids

#: Tokens of a window, and of the history that a window repeats.
BUDGET, HISTORY = 1024, 192
#: The template's control strings.
BEGIN, END, NEW, OLD = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
TRAINED = "assistant"


def escape(text: str) -> str:
    """The text without any control string; unescape gives it back."""
    return CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def head_of(role: str, fresh: bool) -> str:
    return (NEW if fresh else OLD) + escape(role).replace("\n", "\\n") + "\n"


def formatted_turn(role: str, text: str) -> str:
    """A turn as it stands in a window, with the longer of the two marks, for counting its tokens."""
    return f"{head_of(role, False)}{escape(text)} {END}"


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text, flags=re.S)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Windows:
    """Turns of one conversation, in order, to formatted windows; holds one window and its history at most.

    Tokens are those of formatted turns, so role, marks, escapes and END count too, and of BEGIN. The running sum of
    turn tokens decides: a span of new turns ends before the turn with which the window, its system
    turn and its history would pass the budget. The next window begins with the system turn, then as many of the last
    turns before it as HISTORY tokens allow, neither being a target again, then the new turns. A turn that is larger
    than the budget is a window's only new turn. Turns are never cut.
    """

    budget: int = BUDGET
    history: int = HISTORY
    begin: int = 0
    system: Turn | None = None
    past: deque = field(default_factory=deque)
    past_tokens: int = 0
    new: list = field(default_factory=list)
    total: int = 0
    span_start: int = 0
    number: int = 0
    any: bool = False

    def add(self, turn: Turn) -> Iterator[tuple]:
        used = self.begin + self.total - self.span_start + self.past_tokens + (self.system.tokens if self.system and self.number else 0)
        if self.new and used + turn.tokens > self.budget:
            yield self.close()
        if not self.any and turn.role == "system":
            self.system = turn
        self.any = True
        self.new.append(turn)
        self.total += turn.tokens

    def close(self) -> tuple:
        """(window number, new turns, text, mask) of the window; the mask holds starts and ends in code points."""
        parts, mask, at = [BEGIN], [], len(BEGIN)
        repeated = [*([self.system] if self.system and self.number else []), *self.past]
        for turn, fresh in [*((t, False) for t in repeated), *((t, True) for t in self.new)]:
            head = head_of(turn.role, fresh)
            body = escape(turn.text)
            parts += [head, body, END]
            if fresh and turn.role == TRAINED:
                mask += [at + len(head), at + len(head) + len(body)]
            at += len(head) + len(body) + len(END)
        out = (self.number, len(self.new), "".join(parts), mask)
        for t in self.new:
            if t is not self.system:
                self.past.append(t)
                self.past_tokens += t.tokens
        while self.past and self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft().tokens
        self.new, self.span_start, self.number = [], self.total, self.number + 1
        return out


def read_window(text: str) -> list[tuple[bool, str, str]]:
    """(new, role, text) of a formatted window's turns."""
    if not text.startswith(BEGIN):
        raise ValueError("not a formatted window")
    out = []
    for part in text[len(BEGIN) :].split(END)[:-1]:
        fresh = part.startswith(NEW)
        role, _, body = part[len(NEW if fresh else OLD) :].partition("\n")
        out.append((fresh, unescape(role), unescape(body)))
    return out


def ordered(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order; equal turn numbers by role and text, nulls first."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def windows(tokenizer: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        begin = len(ids.prepare({BEGIN.encode()})[BEGIN.encode()]) // 4
        now, last, first = Windows(budget, history, begin), None, True
        for batch in batches:
            out: list[tuple] = []
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            known = ids.prepare({w for _, role, text in rows for w in formatted_turn(role, text).encode().split()})
            for conv, role, text in rows:
                if first or conv != last:
                    if not first:
                        out.append((last, *now.close()))
                    now, last, first = Windows(budget, history, begin), conv, False
                turn = Turn(role, text, sum(map(len, map(known.__getitem__, formatted_turn(role, text).encode().split()))) // 4)
                out += [(conv, *w) for w in now.add(turn)]
            yield window_batch(out)
        if not first:
            yield window_batch([(last, *now.close())])

    return run


WINDOW = "conv_id long, window int, n_new int, formatted string, mask array<int>"


def window_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "window", "n_new", "formatted", "mask"])


def format_chats(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of the conversations in turns (conv_id, turn, role, text): conv_id, window, n_new, formatted, mask.

    A window is BEGIN and its turns, each marked NEW (or OLD when repeated), with role, a line feed, text and END; mask
    holds the start and end, in code points, of each target: the text of a new turn of the assistant. Null texts and
    roles are empty but count with their marks, so however many there are, windows stay within the budget; only a turn
    that is larger than the budget by itself passes it. Rows with a null conv_id are one conversation. A conversation
    streams through one task in order, which holds no more of it than a window and a batch.
    """
    ready(turns.sparkSession)
    return ordered(turns).mapInArrow(windows(tokenizer or default_tokenizer(), budget, history), WINDOW)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its windows in order."""
    last, first = None, True
    turns = loss = None
    n = chars = formatted = 0

    def row() -> tuple:
        return last, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    for batch in batches:
        out = []
        for conv, _, _, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first or conv != last:
                if not first:
                    out.append(row())
                last, first = conv, False
                turns, loss, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for fresh, role, body in read_window(text):
                if fresh:
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
            for a, b in zip(mask[::2], mask[1::2], strict=True):
                target = unescape(text[a:b])
                chars += len(target)
                loss.update(target.encode())
            formatted += len(text)
        yield digest_batch(out)
    if not first:
        yield digest_batch([row()])


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return format_chats(turns, tokenizer).mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
