"""Chat formatting: conversations as one text each, with loss spans, built by columnar byte assembly.

Template of a turn: ``<s>[INST] role [/INST]text</s>``. Control strings inside a role or text are escaped: in
``<``, any backslashes, ``s>`` (or ``/s>``), and in ``[``, any backslashes, ``INST]`` (or ``/INST]``), one
backslash is added after the first character. Taking one away undoes it, whatever the text held before.

Within a task, segment lengths, cumulative offsets and scatter indices are numpy arrays, and headers and
contents are copied into one preallocated buffer that becomes the Arrow column.

Defined cases: null role or text is empty; turns are ordered by (turn, role, text), nulls first; repeated rows are
turns of their own; rows with a null conversation id form one conversation; other columns are not read; an
empty table gives an empty table. A conversation is one output value, so it must fit into a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pairsight.llm.arrow_text import as_text, ragged

HEAD, MIDDLE, TAIL = b"<s>[INST] ", b" [/INST]", b"</s>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
SPANS = "array<struct<start:int,length:int>>"
UNESCAPE = re.compile(ESCAPED)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=CONTROL, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and each value's start and length in them."""
    column = pa.concat_arrays([column])  # no slice offset
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; each turn's end in it; start and length of each turn's text."""
    columns = [string_bytes(escape(roles)), string_bytes(escape(texts))]
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        lengths[:, k] = len(fixed)
    lengths[:, 1], lengths[:, 3] = columns[0][2], columns[1][2]
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, (data, origin, size) in ((1, columns[0]), (3, columns[1])):
        out[ragged(starts[:, k], size)] = data[ragged(origin, size)]
    return out, ends[:, -1], np.stack((starts[:, 3], lengths[:, 3]), axis=1)


def format_part(ids: pa.Array, first: np.ndarray, roles: pa.Array, texts: pa.Array, loss_role: str) -> pa.RecordBatch:
    """One row per conversation; ``first`` holds the index of each conversation's first turn."""
    buffer, ends, spans = assemble(roles, texts)
    bounds = np.append(first, len(roles))
    edges = np.append(0, ends)[bounds].astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(buffer))
    conversation = np.repeat(np.arange(len(first)), np.diff(bounds))
    scored = np.flatnonzero(pc.equal(roles, loss_role).to_numpy(zero_copy_only=False))
    starts = spans[scored, 0] - edges[conversation[scored]]
    counts = np.bincount(conversation[scored], minlength=len(first))
    entries = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(spans[scored, 1], pa.int32())],
                                         ["start", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), entries)
    return pa.RecordBatch.from_pydict({
        "conv_id": ids.take(pa.array(first)), "n_turns": pa.array(np.diff(bounds), pa.int64()),
        "formatted": formatted, "loss_spans": lists})


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, n_turns, formatted text, and the spans under the loss mask, in bytes."""
    narrow = turns.select(turns[id_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"),
                          turns[text_col].alias("text"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None  # turns of the conversation that may go on in the next batch

        def finish(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            flat = table.combine_chunks()
            one = lambda c: flat.column(c).chunk(0)
            return format_part(one("conv_id"), first, as_text(one("role")), as_text(one("text")), loss_role)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([waiting, table]) if waiting is not None else table
            codes = table.column("conv_id").combine_chunks().dictionary_encode(null_encoding="encode")
            codes = pa.concat_arrays([codes] if isinstance(codes, pa.Array) else codes.chunks).indices.to_numpy()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            if len(first) > 1:
                yield finish(table.slice(0, int(first[-1])), first[:-1])
            waiting = table.slice(int(first[-1]))
        if waiting is not None:
            yield finish(waiting, np.zeros(1, np.int64))

    return dealt.mapInArrow(run, f"conv_id {narrow.dtypes[0][1]}, n_turns long, formatted string, loss_spans {SPANS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss-bearing text of formatted conversations, unescaped, found in the text itself."""
    narrow = formatted.select("conv_id", "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": unescape(r), "text": unescape(t)} for r, t in TURN.findall(x)] for x in texts]
            loss = []
            for x, spans in zip(texts, batch.column("loss_spans").to_pylist()):
                raw = x.encode()
                loss.append("".join(unescape(raw[s["start"]:s["start"] + s["length"]].decode()) for s in spans))
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "formatted": batch.column("formatted"),
                "turns": pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                "loss_text": pa.array(loss, pa.string())})

    kind = narrow.dtypes[0][1]
    return narrow.mapInArrow(
        run, f"conv_id {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string")
