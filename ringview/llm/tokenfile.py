"""Token shards with a minimal perfect hash index.

A shard is three files. ``.ids`` is the raw payload, unsigned little-endian, two bytes an id where the
vocabulary allows it, else four. ``.keys`` is the keys in payload order. ``.mph`` maps a key to its slot by a
cascade of bit arrays (a key takes the first level on which no other remaining key shares its bit; its slot is
the rank of that bit), and each slot holds a fingerprint of its key, the payload offset and the lengths of the
key's documents. A lookup costs a few hashes and one read at an offset; a key that is absent is found out by the fingerprint.

Rows are range-partitioned and sorted by key, then by the text's first 64 characters and its hash, so shards follow each other in ascending order and the
documents of one key may fill several. Each task
writes files under a name of its own attempt and the manifest names those of the attempt that counted.

Defined results: null keys come first and are kept (they share a slot with the least key, whose documents follow); a key that repeats
keeps all its documents of a shard in one slot, in that order; null text holds the end id alone; an empty
table has no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, prepare, shared_path, slices
from .tokens import Encoder, default_tokenizer

#: Bits per remaining key on each level.
GAMMA = 2.0
_NULL = np.iinfo(np.int64).min


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys for each seed."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, about 3 bits a key besides the slots' own data."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, int(GAMMA * len(keys)))
            at = (mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is absent, any slot or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x.astype(np.uint8)).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[PerfectHash, int]:
        count = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", count, 8), 8 * (count + 1), []
        for n in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(np.int64))
            at += -(-n // 8)
        return cls(levels), at


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class Shard:
    """An open shard: constant-time access to the ids of a key."""

    def __init__(self, base: str, width: int) -> None:
        self.fs, self.base = filesystem(base)
        self.width = width
        with self.fs.open_input_file(f"{self.base}.mph") as f:
            data = memoryview(f.read())
        self.hash, at = PerfectHash.from_bytes(data)
        n = int(self.hash.before[-1])
        self.marks = np.frombuffer(data, "<u4", n, at)
        self.offsets = np.frombuffer(data, "<i8", n, at + 4 * n)
        self.runs = np.frombuffer(data, "<i8", n + 1, at + 12 * n)
        self.lengths = np.frombuffer(data, "<i8", int(self.runs[-1]), at + 20 * n + 8)
        self.payload = self.fs.open_input_file(f"{self.base}.ids")

    def close(self) -> None:
        self.payload.close()

    def keys(self) -> np.ndarray:
        with self.fs.open_input_file(f"{self.base}.keys") as f:
            return np.frombuffer(f.read(), "<i8")

    def get(self, keys: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For each key its documents: (offset in ids, ids); an empty list for a key that is absent."""
        keys = np.asarray(keys, np.int64)
        for slot, mark in zip(self.hash.slots(keys).tolist(), fingerprints(keys).tolist(), strict=True):
            if slot < 0 or self.marks[slot] != mark:
                yield []
                continue
            lengths, at, found = self.lengths[self.runs[slot] : self.runs[slot + 1]].tolist(), int(self.offsets[slot]), []
            self.payload.seek(at * self.width)
            for n in lengths:
                found.append((at, np.frombuffer(self.payload.read(n * self.width), f"<u{self.width}")))
                at += n
            yield found


def write_index(keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """The ``.mph`` file for sorted keys, which may repeat, and the lengths of their documents."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    ends = np.cumsum(lengths)
    table = PerfectHash.build(distinct)
    order = np.argsort(table.slots(distinct))
    runs = np.concatenate([[0], np.cumsum(count[order])])
    by_slot = [lengths[first[k] : first[k] + count[k]] for k in order]
    parts = [fingerprints(distinct)[order].astype("<u4"), (ends - lengths)[first][order].astype("<i8"), runs.astype("<i8"), *(x.astype("<i8") for x in by_slot)]
    return table.to_bytes() + b"".join(x.tobytes() for x in parts)


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, docs_per_shard: int = 8192, width: int = 2, path: str | None = None) -> DataFrame:
    """Encode and write; the manifest comes back: ``shard, base, n_docs, n_null, n_ids, first_id``.

    ``width`` is 2 for vocabularies under 65,536 ids, else 4. ``first_id`` counts the ids of all shards before.
    """
    prepare(docs.sparkSession)
    spark, vocabulary = docs.sparkSession, tokenizer or default_tokenizer()
    folder = path or shared_path(spark, "token-shards")
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, at = filesystem(base)
        encoder, keys, lengths, out, nulls = Encoder.of(vocabulary), [], [], None, 0
        for b in slices(batches):
            if out is None:
                fs.create_dir(at.rpartition("/")[0])
                out = fs.open_output_stream(f"{at}.ids")
            nulls += b.column(0).null_count
            keys.append(b.column(0).fill_null(_NULL).to_numpy())
            for ids in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                whole = np.frombuffer(ids + end, "<u4")
                if width == 2 and whole.max() > 0xFFFF:
                    raise ValueError("ids over 65535 need width=4")
                lengths.append(len(whole))
                out.write(whole.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        all_keys, all_lengths = np.concatenate(keys).astype("<i8"), np.array(lengths, np.int64)
        for name, data in (("keys", all_keys.tobytes()), ("mph", write_index(all_keys, all_lengths))):
            with fs.open_output_stream(f"{at}.{name}") as f:
                f.write(data)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "base": [base], "n_docs": [len(lengths)], "n_null": [nulls], "n_ids": [int(all_lengths.sum())]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-rows.count() // docs_per_shard))
    # Equal ids are split by text: one key may hold more than a task should.
    order = [F.col("doc_id"), F.substring("text", 1, 64), F.xxhash64("text")]
    placed = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    written = placed.mapInArrow(write, "shard long, base string, n_docs long, n_null long, n_ids long")
    manifest = cut(written, "token-manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("first_id", before)


def read_shards(manifest: DataFrame, width: int = 2) -> DataFrame:
    """Every document of the shards, each found by its key through the index: ``doc_id, start, n_tokens, ids``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, first, nulls in zip(*(b.column(x).to_pylist() for x in ("base", "first_id", "n_null")), strict=True):
                shard = Shard(base, width)
                keys = np.unique(shard.keys())
                for i in range(0, len(keys), 512):
                    part = keys[i : i + 512]
                    # Null shares the slot of the least key, and its documents come first.
                    rows = [
                        (None if key == _NULL and k < nulls else key, first + at, ids)
                        for key, found in zip(part.tolist(), shard.get(part), strict=True)
                        for k, (at, ids) in enumerate(found)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in rows], pa.int64()),
                            pa.array([at for _, at, _ in rows], pa.int64()),
                            pa.array([len(x) for _, _, x in rows], pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for _, _, x in rows], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                shard.close()

    shards = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return manifest.select("base", "first_id", "n_null", "shard").repartition(shards, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


