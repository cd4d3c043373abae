"""Chat formatting with offset-aligned loss masks.

All turns of a conversation are rendered into one text. Marks open and close a turn; inside roles
and texts a backslash is doubled and the start of a mark is broken by one, so no text can forge a
mark and the original comes back exactly. The text is encoded once, with the character offsets of
every token; the marks are added tokens, so no token crosses the border of a turn. The loss mask
comes from the sorted spans of the learned turns by binary search in the sorted token offsets.

A conversation is one record of the output, so its turns meet in one row.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), repeated
rows are repeated turns; rows with a null conversation id form one conversation; an empty table
gives no row. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import values

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
BACK = re.compile(r"\\(.)", re.DOTALL)
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str) -> tuple[str, list[tuple[int, int]]]:
    """Text of all (role, text) turns and the sorted spans of the texts whose role is ``learned``."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = START + escape(role) + MIDDLE, escape(text)
        at += len(head)
        if role == learned:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens (sorted offsets) that overlap a span."""
    step = np.zeros(len(starts) + 1, np.int32)
    if spans:
        a, b = np.array(spans).T
        filled = b > a
        np.add.at(step, np.searchsorted(ends, a[filled], side="right"), 1)
        np.add.at(step, np.searchsorted(starts, b[filled], side="left"), -1)
    return np.cumsum(step[:-1]) > 0


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of ``text`` under the mask, read from token offsets."""
    out: list[str] = []
    on = np.flatnonzero(mask)
    for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1) if len(on) else []:
        out.append(text[int(starts[run[0]]) : int(ends[run].max())])
    return out


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        own.add_special_tokens([START, MIDDLE, END])
        _TOKENIZERS[path] = own
    return _TOKENIZERS[path]


FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))]
)


def _format(path: str, learned: str):
    def encoded(group: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (conv, text, spans), e in zip(group, _tokenizer(path).encode_batch([t for _, t, _ in group], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            rows.append((conv, text, e.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets[:, 0], offsets[:, 1], spans)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), FORMATTED, strict=True)], schema=FORMATTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for conv, turns in zip(values(batch, "conv_id"), values(batch, "turns"), strict=True):
                text, spans = render([(t["role"], t["text"]) for t in turns], learned)
                group.append((conv, text, spans))
                size += len(text)
                if size >= BATCH_CHARS:
                    yield encoded(group)
                    group, size = [], 0
        if group:
            yield encoded(group)

    return run


def format_conversations(turns: DataFrame, path: str, learned: str = "assistant") -> DataFrame:
    """conv_id, text, ids, starts, ends (offsets in code points) and loss, from rows (conv_id, turn,
    role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return rows.mapInArrow(_format(path, learned), "conv_id long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
    for batch in batches:
        rows = []
        columns = (values(batch, n) for n in ("conv_id", "text", "starts", "ends", "loss"))
        for conv, text, starts, ends, mask in zip(*columns, strict=True):
            turns = parse(text)
            loss = "".join(map(unescape, masked_texts(text, np.array(starts, np.int64), np.array(ends, np.int64), np.array(mask, bool))))
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: their turns and the text under the mask."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
