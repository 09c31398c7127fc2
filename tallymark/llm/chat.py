"""Conversations as token ids with a loss mask, assembled from separately encoded segments.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. The two marks are reserved ids beyond
the vocabulary and are only ever spliced in. Role, text and newline are encoded on their own, so no token spans a
border, and the mask comes from prefix sums of the segments' lengths. Inside roles and texts every control string is
escaped by one more backslash between ``<`` and ``|`` (runs of backslashes grow by one, so it can be undone); in roles
backslashes and newlines are escaped before that.

Defined results: null roles and texts are empty; only the role ``assistant`` bears loss; turns stand in the order of
(turn, ids) with a null turn first, so ties and repeated rows have one order; null conversation ids form a conversation
of their own; an empty table has no conversations; other columns are not read. Turns are encoded and decoded wherever
their rows lie; only the running digest of a conversation is made by one task, as a stream of its turns.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from tallymark.llm.tokenizer import ByteBpe, parse, read

#: Fixed values of the template.
START, END, BEARS_LOSS = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marks(bpe: ByteBpe) -> tuple[int, int]:
    return len(bpe.labels), len(bpe.labels) + 1


def assemble(bpe: ByteBpe, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and mask of all turns end to end, and where each turn starts."""
    start, end = marks(bpe)
    newline = bpe.encode_plain("\n")
    segments = [
        segment for role, text in zip(roles, texts, strict=True)
        for segment in ([start], bpe.encode_plain(escape_role(role) + "\n"), bpe.encode_plain(escape(text)), [end], newline)]
    borders = np.cumsum([0, *map(len, segments)])
    ids = np.fromiter(chain.from_iterable(segments), np.int32, int(borders[-1]))
    bearing = np.flatnonzero(np.array([r == BEARS_LOSS for r in roles], bool))
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, borders[5 * bearing + 2], 1)
    np.add.at(change, borders[5 * bearing + 3], -1)
    return ids, np.cumsum(change)[:-1].astype(np.int8), borders[::5]


def format_turns(conversations: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``ids`` and ``loss_mask`` of every turn; a conversation's ids are its turns' ids in order."""
    content = conversations.sparkSession.sparkContext.broadcast(read(tokenizer))
    rows = conversations.select(*[F.col(f"`{c}`").alias(c) for c in (conv, turn, role, text)])
    schema = StructType([rows.schema[0], rows.schema[1], StructField("ids", ArrayType(IntegerType())),
                         StructField("loss_mask", ArrayType(ByteType()))])

    def run(batches):
        bpe = parse(content.value)
        for big in batches:
            for batch in (big.slice(k, 2000) for k in range(0, big.num_rows, 2000)):
                ids, mask, starts = assemble(
                    bpe, [x or "" for x in batch.column(2).to_pylist()], [x or "" for x in batch.column(3).to_pylist()])
                starts = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(starts, pa.array(ids)),
                     pa.ListArray.from_arrays(starts, pa.array(mask))], schema=None, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def read_back(bpe: ByteBpe, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and the length of the formatted turn, from ids and mask alone."""
    start, end = marks(bpe)
    if ids[0] != start:
        raise ValueError("a turn begins with its mark")
    close = ids.index(end)
    inside = b"".join(map(bpe.labels.__getitem__, ids[1:close])).decode()
    role, _, text = inside.partition("\n")
    loss = b"".join([bpe.labels[k] for k, m in zip(ids, mask, strict=True) if m]).decode()
    tail = b"".join(map(bpe.labels.__getitem__, ids[close + 1:])).decode()
    return unescape_role(role), unescape(text), unescape(loss), len(START) + len(inside) + len(END) + len(tail)


def digests(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of whole conversations, read back from ``format_turns``' output as a stream of turns in order."""
    content = turns.sparkSession.sparkContext.broadcast(read(tokenizer))
    schema = StructType([
        turns.schema[conv], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
        StructField("formatted_chars", LongType())])

    def run(batches):
        bpe = parse(content.value)
        now, state = None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for frame in batches:
            done = []
            for key, ids, mask in zip(frame[conv].tolist(), frame["ids"], frame["loss_mask"], strict=True):
                key = None if pd.isna(key) else key
                if state is None or key != now:
                    if state is not None:
                        done.append(row())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, chars = read_back(bpe, ids.tolist(), mask.tolist())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            yield _frame(done, schema)
        if state is not None:
            yield _frame([row()], schema)

    def _frame(rows, schema):
        return pd.DataFrame(rows, columns=[f.name for f in schema], dtype=object)

    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(width, conv).sortWithinPartitions(conv, turn, "ids").mapInPandas(run, schema)
