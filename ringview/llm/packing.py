"""Cost-balanced packing of documents into training sequences.

A document's cost is ``linear * tokens + quadratic * tokens ** 2`` (projections, then attention inside the
document). Whole runs of ``capacity`` tokens fill sequences of their own. What is left of each document goes,
longest first, to the sequence of lowest cost that still has room for it; if none has room for all of it,
it is cut: the sequence of lowest cost with any room takes what fits, then the next. Sequences are balanced
within groups of rows that a task reads one after another, each of about ``group_tokens`` tokens (and one document),
as they are encoded: nothing is shuffled or written before, no task holds more than one group, and each group leaves less than one sequence of padding.

Sequences are numbered by task and within it, so a task that runs again gives the same numbers.

Defined results: a null or empty text holds the end id alone; equal documents are packed one by one, also
with equal ids; ties in cost go to the lower sequence, ties in length to the earlier row; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices
from .tokens import Encoder, default_tokenizer


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, ids)``: ids as little-endian unsigned 32-bit numbers, ``end_id`` last, ``n`` with it."""
    prepare(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), int(end_id).to_bytes(4, "little")
    kind = docs.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in slices(batches):
            ids = [x + end for x in encoder.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind.simpleString()}, n long, ids binary")


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """Pieces ``(start, length, sequence, offset)`` of each item; items come longest first and are shorter than ``capacity``."""
    sequences = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(sequences, capacity), np.zeros(sequences)
    pieces: list[list[tuple[int, int, int, int]]] = []
    for length in lengths.tolist():
        own, start = [], 0
        while start < length:
            left = length - start
            fits = room >= left
            if not fits.any():
                fits = room > 0
            k = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[k]))
            own.append((start, take, k, capacity - int(room[k])))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start += take
        pieces.append(own)
    return pieces


_PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packed(keys: pa.Array, ids: list[bytes], capacity: int, linear: float, quadratic: float, first: int) -> tuple[list[pa.Array], int]:
    """The columns of a group's pieces, and how many sequences they fill from ``first`` on."""
    n = np.array([len(x) // 4 for x in ids], np.int64)
    rest = n % capacity
    order = np.argsort(-rest, kind="stable")
    own = balance(rest[order], capacity, linear, quadratic)
    used = 1 + max((p[2] for x in own for p in x), default=-1)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in ids]
    for row, parts in zip(order.tolist(), own, strict=True):
        at = int(n[row] - rest[row])
        pieces[row] = [(start + at, length, sequence, offset) for start, length, sequence, offset in parts]
    for row, whole in enumerate((n // capacity).tolist()):
        pieces[row] = [(k * capacity, capacity, used + k, 0) for k in range(whole)] + pieces[row]
        used += whole
    flat = [(row, *p) for row, parts in enumerate(pieces) for p in parts]
    column = lambda k: pa.array([x[k] for x in flat], pa.int64())
    cut_ids = pa.array([ids[row][4 * start : 4 * (start + length)] for row, start, length, _, _ in flat], pa.binary())
    sequences = pa.array([first + x[3] for x in flat], pa.int64())
    return [keys.take(column(0)), column(1), column(2), cut_ids, pa.array(n[[x[0] for x in flat]], pa.int64()), sequences, column(4)], used


def _in_groups(rows: Iterator[tuple[pa.Array, list[bytes]]], capacity: int, linear: float, quadratic: float, group_tokens: int) -> Iterator[pa.RecordBatch]:
    """Pack encoded rows group by group."""
    keys, ids, tokens, first = [], [], 0, TaskContext.get().partitionId() << 40
    names = ["doc_id", *(x.split()[0] for x in _PIECES.split(", "))]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal keys, ids, tokens, first
        columns, used = _packed(pa.concat_arrays(keys), ids, capacity, linear, quadratic, first)
        keys, ids, tokens, first = [], [], 0, first + used
        yield from slices(iter([pa.RecordBatch.from_arrays(columns, names)]), 4096)

    for key, found in rows:
        begin = 0
        for k, x in enumerate(found):
            ids.append(x)
            tokens += len(x) // 4
            if tokens >= group_tokens:
                keys.append(key.slice(begin, k + 1 - begin))
                begin = k + 1
                yield from flush()
        keys.append(key.slice(begin))
    if ids:
        yield from flush()


def pack(encoded: DataFrame, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, group_tokens: int = 2048 * 512) -> DataFrame:
    """Pack ``encode_documents`` rows: a row ``doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset`` for each piece."""
    prepare(encoded.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0), b.column(1).to_pylist()) for b in slices(batches))
        return _in_groups(rows, capacity, linear, quadratic, group_tokens)

    return encoded.select("doc_id", "ids").mapInArrow(of, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, {_PIECES}")


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 2048 * 512,
) -> DataFrame:
    """Encode and pack in one pass: the rows of ``pack(encode_documents(docs))``."""
    prepare(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), int(end_id).to_bytes(4, "little")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        rows = ((b.column(0), [x + end for x in encoder.encode([t or "" for t in b.column(1).to_pylist()])]) for b in slices(batches))
        return _in_groups(rows, capacity, linear, quadratic, group_tokens)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(of, f"doc_id {docs.schema[key].dataType.simpleString()}, {_PIECES}")
