"""Chat formatting by prefix-target expansion (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import partitions, text_of

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
#: Characters of formatted text that a task holds before it passes them on.
HELD = 1 << 22


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string can stand in a text; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


EXAMPLE = "conv_id long, example long, formatted string, loss_start long, loss_end long, whole boolean"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples from turns in order; of a conversation only the text so far is held."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    names = ["conv_id", "example", "formatted", "loss_start", "loss_end", "whole"]
    rows: list = []
    held, opened, now, done, example, last = 0, False, None, "", 0, None

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if opened and conv != now:
                rows.append((now, *(last or (example, done, 0, 0)), True))
                done, example, last = "", 0, None
            elif last:
                rows.append((now, *last, False))
                last = None
            opened, now = True, conv
            opening, text = f"{START}{escape_role(role)}\n", escape(text)
            begin = len(done) + len(opening)
            done = f"{done}{opening}{text}{END}\n"
            if role == "assistant":
                last = example, done, begin, begin + len(text)
                example += 1
                held += len(done)
            if held >= HELD and rows:
                yield pack()
                rows, held = [], 0
    if opened:
        rows.append((now, *(last or (example, done, 0, 0)), True))
        yield pack()


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every assistant turn becomes an example: all turns up to it, only its text trainable.

    Returns (conv_id, example, formatted, loss_start, loss_end, whole): ``formatted`` marks
    turns with control strings, escaped within texts and roles; the loss mask is the range
    of code points from loss_start to loss_end. A conversation that does not end with an
    assistant turn has one more example at the end with an empty mask, so that no turn is
    lost; ``whole`` marks the example that holds all turns.

    Null roles and texts are empty; an empty reply is an example with an empty mask. Turns
    with equal numbers are ordered by role and text, null numbers come first, repeated rows
    are turns of their own, and rows with a null id make one conversation. Other columns
    are ignored; an empty table gives an empty result. The work is one shuffle by conversation and a sort; the examples of a
    conversation stand in order in one partition. Turns stream through a task, which holds one example (the text so far), not the conversation's
    turns. As each example repeats what is before it, the result grows with the square of a conversation's length.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLE)
