"""Chat formatting whose output can be parsed back.

The grammar of a formatted conversation, with ESC for a backslash:

    conversation := turn*
    turn         := "<|" role "|>\\n" text "<|end|>\\n"
    role         := one of system, user, assistant, tool, or any other string, escaped
    text         := characters, escaped

Control strings of this template, and those of other common ones, are escaped inside texts and roles by a backslash
after their first character; a backslash is doubled. So no control string stands in the output but those that the
template wrote, and unescaping is a left-to-right scan. After rendering, a deterministic parser reads the output
back; where its turns differ from the source, more is escaped (then every character of the control strings' alphabet)
until they are identical.

The loss mask covers the text of assistant turns.

Null texts and roles are empty. Turns are in order of turn (null first), ties by role and text; repeated rows are
turns of their own. Very long texts are escaped and read back whole. Rows without conv_id form one conversation. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

END = "<|end|>"
TRAINED = "assistant"
#: Strings that a template or tokenizer may read as control. Fixed values.
CONTROLS = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_CONTROL = re.compile(rf"(?=({'|'.join(map(re.escape, CONTROLS))})).|\\", re.S)  # first characters, of overlapping strings too
_ALPHABET = re.compile(r"[<|>\[\]/\\]")


def escape(text: str, level: int = 0) -> str:
    """level 0 puts a backslash after the first character of a control string; level 1 before each of their characters."""
    if level:
        return _ALPHABET.sub(lambda m: "\\" + m[0], text)
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def spans(out: str) -> list[tuple[str, int, int]]:
    """Deterministic parser: role, and first and last-plus-one character of the escaped text, of each turn."""
    found, at = [], 0
    while at < len(out):
        if not out.startswith("<|", at):
            raise ValueError(f"no turn at {at}")
        close = out.find("|>\n", at + 2)
        end = out.find(END + "\n", close + 3) if close >= 0 else -1
        if end < 0:
            raise ValueError(f"turn at {at} does not end")
        found.append((unescape(out[at + 2 : close]), close + 3, end))
        at = end + len(END) + 1
    return found


def parse(out: str) -> list[tuple[str, str]]:
    return [(role, unescape(out[a:b])) for role, a, b in spans(out)]


def render(turns: list[tuple[str, str]]) -> str:
    for level in (0, 1):
        out = "".join(f"<|{escape(role, level)}|>\n{escape(text, level)}{END}\n" for role, text in turns)
        try:
            if parse(out) == turns:
                return out
        except ValueError:
            continue
    raise ValueError("a conversation does not come back from its rendered form")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, the rendered conversation, and the starts and ends of its loss mask in characters.

    A conversation is one string, so its turns meet in one task; conversations are spread by conv_id.
    """
    common.ship(conversations.sparkSession)
    turn = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, starts, ends = [], [], []
            for turns in batch.column("turns").to_pylist():
                out = render([(t["role"] or "", t["text"] or "") for t in turns])
                mask = [(a, b) for role, a, b in spans(out) if role == TRAINED]
                texts.append(out)
                starts.append([a for a, _ in mask])
                ends.append([b for _, b in mask])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(starts, ints), pa.array(ends, ints)], names=["conv_id", "formatted", "loss_starts", "loss_ends"])

    return whole.mapInArrow(run, "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>")


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations: their turns, and the text under the loss mask."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
                turns = parse(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
