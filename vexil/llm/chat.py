"""Chat formatting: budgeted windows over the turns of a conversation.

A turn's tokens are those of its role and its text by a vocabulary file (without one, runs of non-blanks), and MARKS for its marks; they are
counted before the turns are brought together. Running sums of the turns' tokens, searched by bisection, say where each window's span of new
turns ends, and how much history comes before it. A window begins with the conversation's system turn, if its first turn is one, then
repeats up to `history` turns before the span as far as these take at most half of what is left; only the texts of new
assistant turns are under the loss mask, so each counts once. A turn larger than the budget gets a window of its own, whole.
Every turn is <|im_start|>role newline text <|im_end|> newline. Control strings inside texts get a backslash after their first
character, and one that has backslashes there gets one more, so that reading takes exactly one away.

Conversations stream by in sorted order: a task holds no more than a window and its history, however long a conversation is.
The whole of one conversation goes through one task, as its digest has to.

Defined cases: null texts are empty; a null role is the role ''; a null turn comes first; turns of one number are ordered by role and
text; repeated rows are turns of their own; rows of a null conv_id form one conversation; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.shared import cut, small_batches
from vexil.llm.token_counts import counter_of

BUDGET = 512
HISTORY = 2
MARKS = 3
START, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, without their first character.
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
_PUT = re.compile(rf"([<\[])(\\*)(?=(?:{_CONTROL}))")
_TAKE = re.compile(rf"([<\[])\\(\\*)(?=(?:{_CONTROL}))")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.S)


def escape(text: str) -> str:
    return _PUT.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _TAKE.sub(r"\1\2", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class _Conversation:
    """Takes turns in order; gives windows as soon as they are full. held[new:] are turns that no window has yet, those before are history."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str] | None = None
        self.system_size = 0
        self.held: list[tuple[str, str]] = []
        self.sums = [0]  # tokens before each held turn, and after the last
        self.new = self.turns = self.windows = 0

    def span(self) -> tuple[int, int]:
        """Where the repeated turns of the next window begin, and where its new ones end."""
        free = self.budget - (self.system_size if self.windows else 0)
        at = self.sums[self.new]
        low = bisect_left(self.sums, at - max(free, 0) // 2, max(0, self.new - self.history), self.new)
        end = bisect_right(self.sums, free + self.sums[low], self.new) - 1
        return low, max(end, self.new + 1)

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        if not self.turns and role == "system":
            self.system, self.system_size = (role, text), tokens
        self.held.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        self.turns += 1
        return self.window() if self.span()[1] < len(self.held) else None

    def window(self) -> dict:
        low, end = self.span()
        repeated = [*([self.system] if self.system and self.windows else []), *self.held[low : self.new]]
        parts, spans, at = [], [], 0
        for k, (role, text) in enumerate([*repeated, *self.held[self.new : end]]):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if role == "assistant" and k >= len(repeated):
                spans += [at + len(head), at + len(head) + len(body)]
            parts.append(f"{head}{body}{STOP}\n")
            at += len(parts[-1])
        out = {"conv_id": self.id, "window": self.windows, "text": "".join(parts), "repeated": len(repeated), "loss_spans": spans}
        # The system turn is no history: it comes first anyhow.
        gone = max(end - self.history, 1 if self.system and not self.windows else 0)
        self.held, self.sums, self.new = self.held[gone:], self.sums[gone:], max(end - gone, 0)
        self.windows += 1
        return out


_NONE = object()
_WINDOWS = "conv_id long, window int, text string, repeated int, loss_spans array<int>"


def _frames(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "text", "repeated", "loss_spans"])
    return out.astype({"conv_id": "Int64"})


def sized(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn, role, text (nulls replaced) and tokens of all turns. vocabulary: path of a file that all executors have."""
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(vocabulary).count if vocabulary else lambda texts: [len(x.split()) for x in texts]
        for b in batches:
            sizes = [x + y + MARKS for x, y in zip(count(b["role"].to_pylist()), count(b["text"].to_pylist()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, "tokens"])

    small_batches(turns.sparkSession)
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """One row a window: conv_id, window, text, repeated (leading turns that aren't new), loss_spans (starts and ends of the loss mask, in code points)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, rows = None, _NONE, []
        for f in frames:
            for conv, role, text, tokens in zip(f["conv_id"].astype("Int64"), f["role"], f["text"], f["tokens"]):
                conv = None if conv is pd.NA else int(conv)
                if conv != last or now is None:
                    if now is not None:
                        rows.append(now.window())  # what is left fits one
                    now, last = _Conversation(conv, budget, history), conv
                full = now.add(role, text, int(tokens))
                if full:
                    rows.append(full)
                if len(rows) >= 1000:
                    yield _frames(rows)
                    rows = []
        if now is not None:
            rows.append(now.window())
        yield _frames(rows)

    return sized(turns, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, _WINDOWS)


def read_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of every turn of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: what the windows say of each conversation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now, rows = _NONE, None, []

        def done() -> None:
            if now is not None:
                rows.append((last, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5]))

        for f in frames:
            for conv, text, repeated, spans in zip(f["conv_id"].astype("Int64"), f["text"], f["repeated"], f["loss_spans"]):
                conv = None if conv is pd.NA else int(conv)
                if now is None or conv != last:
                    done()
                    last, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in read_window(text)[repeated:]:
                    now[0] += 1
                    now[1].update(f"{role}\n{said}\n".encode())
                for i in range(0, len(spans), 2):
                    said = unescape(text[spans[i] : spans[i + 1]])
                    now[2] += len(said)
                    now[3].update(said.encode())
                now[4] += len(text)
                now[5] += 1
        done()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInPandas(run, schema)


def chat_digests(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Formats all conversations, keeps the windows, and reads them back."""
    return read_back(cut(format_windows(turns, vocabulary=vocabulary)))
