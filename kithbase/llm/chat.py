"""Chat formatting by columnar byte assembly.

For a batch of turns the lengths of all segments (header, role, text, end)
are computed at once, their cumulative sums say where each goes, and headers
and contents are scattered into one preallocated Arrow buffer. No turn is
formatted on its own.

The template of a turn is <|im_start|>role\\ntext<|im_end|>\\n. Control
strings in contents are escaped reversibly: "<", any number of backslashes
and "|" gets one backslash more before the "|", so an escaped text has no
"<|". In roles, backslashes and line ends are escaped too.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .lexer import bytes_of, texts
from .store import slim_batches

BEGIN, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: A part is a stretch of one conversation with at most so many turns, so that a conversation may exceed a task's memory.
PART_TURNS = 1024
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(array: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(array, r"<(\\*)\|", r"<\\\1|") if len(array) and pc.any(pc.match_substring(array, "|")).as_py() else array


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"<\1|", s) if "<\\" in s else s


def escape_role(array: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(array, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def assemble(roles: pa.Array, contents: pa.Array, parts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One string per part, and begin and end of each turn's text in code points of its part.

    parts: the number of the first turn of each part, and the number of turns.
    """
    role, text = bytes_of(escape_role(roles)), bytes_of(escape(contents))
    n = len(roles)
    role_size, text_size = np.diff(role[1]), np.diff(text[1])
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(BEGIN), role_size, len(MIDDLE), text_size, len(END)
    edges = np.concatenate([[0], np.cumsum(sizes.ravel())])
    at = edges[:-1].reshape(n, 5)
    out = np.empty(int(edges[-1]), np.uint8)
    for column, constant in ((0, BEGIN), (2, MIDDLE), (4, END)):
        out[at[:, column, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for column, (flat, off), size in ((1, role, role_size), (3, text, text_size)):
        out[np.arange(len(flat)) + np.repeat(at[:, column] - off[:-1], size)] = flat
    cuts = np.append(at[:, 0], edges[-1])[parts]
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    home = points[np.repeat(cuts[:-1], np.diff(parts))]
    begin, end = points[at[:, 3]] - home, points[at[:, 4]] - home
    formatted = pa.LargeStringArray.from_buffers(len(parts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return formatted, begin, end


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss, whole of turns (conv_id, turn, role, text).

    Rows are ordered by turn (null first), rows of the same turn by a hash of
    role and text; repeated rows all stay. loss lists begin and end, in code
    points of the part, of the (escaped) text of each assistant turn. Null
    texts and roles count as empty; rows without a conv_id form one
    conversation. Parts of a conversation follow one another by part; whole
    says of a part that it surely is all of its conversation. Very long texts
    are rows like others. Extra columns are left out; ids may be of any type;
    an empty table gives an empty result.

    Rows are dealt by ranges of (conv_id, turn), so that a conversation with
    a third of all rows spreads over many tasks.
    """
    slim_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("role", "text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, roles, contents = batch.column(0), texts(batch.column(2)), texts(batch.column(3))
            ids = np.asarray(pc.dictionary_encode(conv, null_encoding="encode").indices)
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            parts = np.array([k for a, b in zip(starts[:-1], starts[1:], strict=True) for k in range(a, b, PART_TURNS)] + [len(ids)])
            # What stands at an end of the batch may go on beyond it.
            whole = np.isin(parts[:-1], starts[1:-2]) & np.isin(parts[1:], starts[2:-1])
            formatted, begin, end = assemble(roles, contents, parts)
            spoken = np.asarray(pc.equal(roles, "assistant"))
            count = np.concatenate([[0], np.cumsum(spoken)])[parts].astype(np.int32)
            loss = pa.ListArray.from_arrays(pa.array(count), pa.StructArray.from_arrays([pa.array(begin[spoken]), pa.array(end[spoken])], ["begin", "end"]))
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(parts[:-1])), pa.array(number + np.arange(len(parts) - 1)), pa.array(np.diff(parts)), formatted, loss, pa.array(whole)], ["conv_id", "part", "n_turns", "formatted", "loss", "whole"])
            number += len(parts) - 1

    return dealt.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part long, n_turns long, formatted string, loss array<struct<begin:long,end:long>>, whole boolean")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a part."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn[len(BEGIN) :].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


NAMES = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


class Digest:
    """What is read back from the parts of one conversation, one after another."""

    def __init__(self):
        self.turns, self.chars, self.length, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, content in read_back(text):
            self.turns += 1
            self.all.update(f"{role}\n{content}\n".encode())
        for span in loss:
            learned = unescape(text[span["begin"] : span["end"]])
            self.chars += len(learned)
            self.loss.update(learned.encode())
        self.length += len(text)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.length


def _table(columns: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(KINDS), KINDS, strict=True))], [*names, *NAMES])


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_conversations().

    A conversation that is one part is read where it lies, and only what was
    read moves on. The parts of the others pass through one task in order, one
    at a time; a digest of a sequence can't be had otherwise. Nothing is
    gathered.
    """
    own = formatted.select("conv_id", "part", "formatted", "loss", "whole")
    fields = [*own.schema.fields[:4], *(StructField(n, LongType() if pa.types.is_int64(k) else StringType()) for n, k in zip(NAMES, KINDS, strict=True))]

    def at_once(batches):
        for batch in batches:
            rows, keep = [], np.asarray(pc.invert(batch.column(4)))
            for text, loss, whole in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                digest = Digest()
                if whole:
                    digest.add(text, loss)
                rows.append(digest.row() if whole else (None,) * len(KINDS))
            blank = [pc.if_else(pa.array(keep), batch.column(2), pa.scalar(None, batch.column(2).type)), pa.array([x if k else None for x, k in zip(batch.column(3).to_pylist(), keep, strict=True)], batch.column(3).type)]
            yield _table([batch.column(0), batch.column(1), *blank], ["conv_id", "part", "formatted", "loss"], rows)

    def in_order(batches):
        now, state, kind = None, None, None
        for batch in batches:
            kind, ids, rows = batch.schema.field(0).type, [], []
            for conv, text, loss, *known in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, *range(4, 9))), strict=True):
                if known[0] is not None:
                    ids.append(conv)
                    rows.append(tuple(known))
                    continue
                if state is None or conv != now:
                    if state is not None:
                        ids.append(now)
                        rows.append(state.row())
                    now, state = conv, Digest()
                state.add(text, loss)
            yield _table([pa.array(ids, kind)], ["conv_id"], rows)
        if state is not None:
            yield _table([pa.array([now], kind)], ["conv_id"], [state.row()])

    read = own.mapInArrow(at_once, StructType(fields))
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(in_order, StructType([fields[0], *fields[4:]]))
