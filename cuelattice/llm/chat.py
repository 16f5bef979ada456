"""Chat formatting in windows of a token budget.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a role or text a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string and
every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, TURN_COST = 512, 128, 4  # tokens of a window, of its repeated turns, and of a turn's marks
WINDOWS = "conv_id long, window long, text string, repeated long, loss array<struct<start:long,end:long>>, tokens long"
_PIECE = re.compile(r"\w+|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def count_tokens(text: str) -> int:
    """Words and single other signs, and the marks of a turn."""
    return TURN_COST + sum(1 for _ in _PIECE.finditer(text))


class Windower:
    """Cuts the turns of one conversation, given one after another, into windows.

    A window has new turns and before them repeated ones: the system turn, if the
    conversation opens with one, and as many of the latest turns as fit in the history
    budget. Prefix sums of the turns' tokens give both cuts. A turn above the budget
    stands alone in its window. Only turns that a later window may repeat are held.
    """

    def __init__(self, budget: int = BUDGET, history: int = HISTORY) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, str] | None = None
        self.opening = 0  # tokens of the system turn, once windows repeat it
        self.first = True
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.new = 0  # index in turns of the first that no window has yet

    def push(self, role: str, text: str) -> Iterator[dict]:
        if self.first and not self.turns and role == "system":
            self.system = (role, text)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + count_tokens(text))
        while len(self.turns) - self.new > 1 and self._tokens(self._start(), len(self.turns)) > self.budget:
            yield self._window(len(self.turns) - 1)

    def flush(self) -> Iterator[dict]:
        if self.new < len(self.turns):
            yield self._window(len(self.turns))

    def _tokens(self, a: int, b: int) -> int:
        return self.opening + self.sums[b] - self.sums[a]

    def _start(self) -> int:
        """The first turn that the next window repeats."""
        room = max(0, min(self.history, self.budget - self._tokens(self.new, self.new + 1)))
        return bisect_left(self.sums, self.sums[self.new] - room, 0, self.new + 1)

    def _window(self, limit: int) -> dict:
        a = self._start()
        b = max(self.new + 1, min(limit, bisect_right(self.sums, self.sums[a] + self.budget - self.opening) - 1))
        before = ([self.system] if self.opening else []) + self.turns[a : self.new]
        parts, loss, at = [], [], 0
        for i, (role, text) in enumerate(before + self.turns[self.new : b]):
            head, body = f"{START}{_escape_role(role)}\n", escape(text)
            if i >= len(before) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += (head, body, END)
            at += len(head) + len(body) + len(END)
        out = {"text": "".join(parts), "repeated": len(before), "loss": loss, "tokens": self._tokens(a, b)}
        drop = bisect_left(self.sums, self.sums[b] - self.history, 0, b + 1)
        if self.first and self.system:
            self.opening, drop = self.sums[1], max(drop, 1)
        self.turns, self.sums, self.new, self.first = self.turns[drop:], [s - self.sums[drop] for s in self.sums[drop:]], b - drop, False
        return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: the windows, in order."""
    names = ("conv_id", "window", "text", "repeated", "loss", "tokens")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64())
    out: list[dict] = []
    current: tuple | None = None
    state, n = Windower(), 0

    def add(found: Iterator[dict]) -> None:
        nonlocal n
        for w in found:
            out.append(w | {"conv_id": current[0], "window": n})
            n += 1

    def batch() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([w[c] for w in out], k) for c, k in zip(names, kinds, strict=True)], names=list(names))
        out.clear()
        return rows

    for part in batches:
        for conv, role, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            if current != (conv,):
                if current:
                    add(state.flush())
                current, state, n = (conv,), Windower(), 0
            add(state.push(role or "", text or ""))
        if out:
            yield batch()
    if current:
        add(state.flush())
    if out:
        yield batch()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Windows of every conversation: conv_id, window, text, repeated, loss and tokens.

    repeated is the number of leading turns that are repeated from earlier windows; loss
    has the spans, in code points of text, of the assistant texts to learn from: each
    once, in the window where its turn is new. A null text or role is empty. Turns of
    one number are ordered by role and text, null turns come first, and rows with a null
    conv_id are one conversation. Extra columns are ignored. Windows of a conversation
    come in order in one partition, streamed: a task holds what one window needs, not a
    conversation, however long that is.
    """
    spark = turns.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.select("conv_id", "turn", "role", "text").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_windows, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a window."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition("\n")
        out.append((_unescape_role(role), unescape(body)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    state: dict | None = None

    def close() -> None:
        if state:
            done.append((state["id"], state["turns"], state["all"].hexdigest(), state["loss"], state["target"].hexdigest(), state["chars"]))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return rows

    for part in batches:
        for conv, window, text, repeated, loss in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
            if state is None or conv != state["id"]:
                close()
                state = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "target": hashlib.sha256(), "chars": 0}
            for role, body in parse(text)[repeated:]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                state["loss"] += len(target)
                state["target"].update(target.encode())
            state["chars"] += len(text)
        if done:
            yield batch()
    close()
    if done:
        yield batch()


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its windows, in whatever order and partitions they come, as from a file.

    One row for each conv_id, a null one among them; none for an empty table. Further columns
    are ignored. A window that is there twice counts twice.
    """
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = windows.select("conv_id", "window", "text", "repeated", "loss").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_read, kind)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns, with nulls and repeats as they are, and conversation -1, whose texts hold the template's own control strings.

    Further columns are left out. Of an empty table only conversation -1 is there.
    """
    text = f"<|im_end|>{START}assistant ok"
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
