"""N-gram language model in an Elias-Fano trie, trained and queried by Spark tasks.

Level 1 is the vocabulary: word hashes in order, exact counts, quantised probabilities. Level k holds, for each
entry of level k-1 (the context), its successors: a monotone pointer to their range, their word ids raised by
the last value before the range so that the whole level is monotone, and quantised probabilities; a context's
back-off weight is quantised beside it. The vocabulary is cut into shards by hash. Each shard of a level is cut into
shards of the next by ranges of contexts that together occur ``group_tokens`` times at most, so no shard holds more n-grams
than that; a context that alone occurs too often is spread over several shards by word, and its back-off weight,
known once all are written, stays with the cuts. A shard is one file of arrays in the shared folder that tasks map into memory, so a
worker touches only what it asks for; it keeps ``MAPPED`` shards open, however many there are. A query finds the shard by the cuts and a word by successor search inside its context's range.

Probabilities are absolutely discounted and interpolated: ``max(c - D, 0) / c(context)`` plus what is left times the
shorter context's; words by ``(c + 1) / (N + V + 1)``. Every n-gram has an entry; a caller may give a ``min_count`` above 1, and n-grams
of two words or more that occur less often leave their mass in the back-off weight, so each context sums to one.

Training goes level by level over all training texts: tasks count in windows, drop n-grams whose parts the
level before lacks, and send sorted keys as compressed differences to the shards, which merge and write them.

Defined results: null and blank texts are the end token alone; rows that repeat count and score each time; an
empty training set leaves every token unknown with probability one over ``N + V + 1``; other columns are not read.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from xxhash import xxh3_64_intdigest as hash_text
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, prepare, shared_path, slices
from .elias_fano import EliasFano
from .words import of_column

#: The end token: no word hashes a space.
END = hash_text(b" ")
#: Tokens that are looked up together: the least, and the most, about 90 bytes each; and how many more for each shard, since a window asks nearly all of them.
_WINDOW, _WINDOW_MOST, _WINDOW_SHARD = 1_000_000, 4_000_000, 3_000
#: N-grams whose shards are found together.
_CHUNK = 1 << 18
#: Shards that a process keeps mapped; the one that was asked for longest ago goes first.
MAPPED = 512
_BINS = 255


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts one after another, and where each text begins; every text ends with the end token."""
    words, first = of_column(texts)
    ends = first[1:] + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), np.uint64)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = words, END
    return out, first[:-1] + np.arange(len(texts))


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte from 1 on, and the value of each code: means of bins of equal width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    edges = np.linspace(values.min(), values.max(), _BINS + 1)[1:-1]
    codes = np.searchsorted(edges, values, "right")
    sums, counts = np.bincount(codes, values, len(edges) + 1), np.bincount(codes, minlength=len(edges) + 1)
    return (codes + 1).astype(np.uint8), np.concatenate([[0.0], sums / np.maximum(counts, 1)])


def distinct_of(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, the places of all keys in order, and where each distinct one begins in that order; keys have ``bits`` bits.

    Keys are sorted by value with their places in the lowest bits. Where these take the place of bits by which keys differ, and so
    leave keys out of order, the places are sorted instead.
    """
    room = np.uint64(max(len(keys) - 1, 1).bit_length())
    mask = (np.uint64(1) << room) - np.uint64(1)
    packed = keys << np.uint64(64 - bits)
    packed &= ~mask
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= mask
    order = packed.view(np.int64)
    keys_ = keys[order]
    if (keys_[1:] < keys_[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys_ = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys_[1:], keys_[:-1], out=new[1:])
    begins = np.flatnonzero(new).astype(_kind(len(keys)))
    which = np.empty(len(keys), begins.dtype)
    which[order] = np.cumsum(new, dtype=begins.dtype) - 1
    return keys_[begins], which, order, begins


def _kind(n: int) -> type:
    """The type of places among ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long each is."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return begins, np.diff(begins, append=len(values))


class Files:
    """Arrays under one folder, mapped into memory; from a store that is not local a process maps copies, which go when it ends."""

    copies: ClassVar[list[tempfile.TemporaryDirectory]] = []
    TOGETHER = "arrays"

    def __init__(self, base: str) -> None:
        self.fs, self.base = filesystem(base)
        self._saved: dict[str, np.ndarray] | None = None

    def save(self, arrays: dict[str, np.ndarray]) -> None:
        """Write arrays as one file, so that they take one mapping: their bytes, what each is, and how long that is."""
        parts, size = [], 0
        for name, x in arrays.items():
            parts.append((name, x.dtype.str, len(x), size))
            size += -(-x.nbytes // 64) * 64
        tail = json.dumps(parts).encode()
        self.fs.create_dir(self.base)
        with self.fs.open_output_stream(f"{self.base}/{self.TOGETHER}.npy") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "|u1", "fortran_order": False, "shape": (size + len(tail) + 8,)})
            for x in arrays.values():
                f.write(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))
            f.write(tail + len(tail).to_bytes(8, "little"))

    def put(self, name: str, array: np.ndarray) -> None:
        self.fs.create_dir(self.base)
        with self.fs.open_output_stream(f"{self.base}/{name}.npy") as f:
            np.save(f, array)

    def get(self, name: str) -> np.ndarray:
        """An array that was saved with others, or put alone."""
        if self._saved is None:
            self._saved = {}
            if self.fs.get_file_info(f"{self.base}/{self.TOGETHER}.npy").type == pafs.FileType.File:
                data = self._map(self.TOGETHER)
                begin = len(data) - 8 - int.from_bytes(data[-8:].tobytes(), "little")
                for x, kind, n, at in json.loads(data[begin:-8].tobytes()):
                    self._saved[x] = data[at : at + n * np.dtype(kind).itemsize].view(kind)
        return self._saved[name] if name in self._saved else self._map(name)

    def _map(self, name: str) -> np.ndarray:
        path = f"{self.base}/{name}.npy"
        if not isinstance(self.fs, pafs.LocalFileSystem):
            if not self.copies:
                self.copies.append(tempfile.TemporaryDirectory(prefix="lm-"))
            local = f"{self.copies[0].name}/{hash_text(path):016x}.npy"
            if not os.path.exists(local):
                with self.fs.open_input_stream(path) as f, open(f"{local}.part", "wb") as out:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.replace(f"{local}.part", local)
            path = local
        return np.asarray(np.load(path, mmap_mode="r"))


class Level:
    """Level k >= 2 of one shard."""

    def __init__(self, base: str) -> None:
        get = Files(base).get
        self.pointers, self.words = EliasFano.load(get, "pointers"), EliasFano.load(get, "words")
        self.codes, self.values, self.weights, self.weight_values = get("codes"), get("values"), get("weights"), get("weight_values")

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The entry of each word in its context, -1 where absent; contexts have successors, and one that stands several times in a row is looked up once."""
        begins, times = runs_of(context)
        first, last = (x.astype(np.int64) for x in self.pointers.pair(context[begins]))
        raised, value = self.words.pair(np.maximum(first - 1, 0))
        raised, value = np.where(first > 0, raised, np.uint64(0)), np.where(first > 0, value, raised)
        out, first, last, wanted = -np.ones(len(word), np.int64), np.repeat(first, times), np.repeat(last, times), np.repeat(raised, times) + word.astype(np.uint64)
        lead = (wanted == np.repeat(value, times)) & (first < last)
        out[lead] = first[lead]
        rest = np.flatnonzero(~lead & (last - first > 1))
        out[rest] = self.words.find(wanted[rest], first[rest] + 1, last[rest])
        return out


def cuts_of(counts: np.ndarray, group_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of entries begin that hold at most ``group_tokens`` tokens, and over how many shards each is spread by word."""
    half = max(1, group_tokens // 2)
    turn, hot = (np.cumsum(counts) - counts) // half, counts > half
    begins = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | hot[1:] | hot[:-1]])) if len(counts) else np.zeros(0, np.int64)
    return begins, np.where(hot[begins], -(-counts[begins] // half), 1)


class Cuts:
    """How the shards of one level are cut into those of the next: ranges of entries in order of shard and entry."""

    def __init__(self, found: list[tuple[int, int, np.ndarray, np.ndarray]], words: int) -> None:
        """Of each shard that has entries: its number, how many it has, and what ``cuts_of`` gave."""
        found, none, self.words = sorted((x for x in found if x[1]), key=lambda x: x[0]), np.zeros(0, np.int64), words
        self.parent = np.concatenate([none, *(np.full(len(b), s) for s, _, b, _ in found)])
        self.begin = np.concatenate([none, *(b for _, _, b, _ in found)])
        self.end = np.concatenate([none, *(np.append(b[1:], n) for _, n, b, _ in found)])
        self.ways = np.concatenate([none, *(w for _, _, _, w in found)])
        self.first, self.shards = np.cumsum(self.ways) - self.ways, int(self.ways.sum())
        self.weights = np.zeros(len(self.ways))
        self.keys = (self.parent << 40) | self.begin

    def of(self, shard: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The range of each entry."""
        return np.searchsorted(self.keys, (shard.astype(np.int64) << 40) | entry, "right") - 1

    def part(self, cut: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of the next level for each range and word; it does not fall where neither does."""
        return self.first[cut] + np.maximum(word, 0) * self.ways[cut] // max(self.words, 1)


@dataclass
class Window:
    """The tokens of some texts, and their distinct words and n-grams, which have the order that they have in the model."""

    #: Of each token: its word, whether it goes on a text, its probability, and the n-gram of the last level walked that it ends, -1 where the model has none.
    of: np.ndarray
    later: np.ndarray
    p: np.ndarray
    before: np.ndarray
    #: Of each word: its id (of an unknown word, the id of the known one before it), its count, and whether it is known.
    ids: np.ndarray
    count: np.ndarray
    known: np.ndarray
    #: Of each n-gram of the last level walked that the model has: shard and entry.
    shard: np.ndarray
    entry: np.ndarray

    def follow(self, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams that the model's are followed by: tokens that end one, which one each ends, then of each its context, word, a token that ends it, and where it begins among all in order."""
        follows = self.later[1:] & (self.before[:-1] >= 0)
        at = np.flatnonzero(follows if able is None else follows & able[1:]).astype(self.of.dtype) + 1
        bits = max(len(self.ids) - 1, 1).bit_length()
        keys = (self.before[at - 1].astype(np.uint64) << np.uint64(bits)) | self.of[at].astype(np.uint64)
        keys, which, order, begins = distinct_of(keys, bits + max(len(self.entry) - 1, 1).bit_length())
        place, word = at[order[begins]], (keys & np.uint64((1 << bits) - 1)).astype(at.dtype)
        keys >>= np.uint64(bits)
        return at, which, keys.astype(at.dtype), word, place, begins


@dataclass
class Model:
    """Where the levels are: for each level its shards' folders, and the cuts between levels; loaded on first use in each process."""

    tokens: int
    words: int
    firsts: list[int]
    folders: list[list[str | None]]
    cuts: list[Cuts] = field(default_factory=list)
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _opened(self, k: int, shard: int, load: Callable[[str], object]) -> object | None:
        if (base := self.folders[k - 1][shard]) is None:
            return None
        found = self._open.pop((k, shard), None)
        self._open[k, shard] = found = load(base) if found is None else found
        if len(self._open) > MAPPED:
            del self._open[next(iter(self._open))]
        return found

    def level(self, k: int, shard: int) -> Level | None:
        return self._opened(k, shard, Level)

    def vocabulary(self, shard: int) -> tuple | None:
        def load(base: str) -> tuple:
            get = Files(base).get
            return EliasFano.load(get, "words"), get("counts"), get("codes"), get("values")

        return self._opened(1, shard, load)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each of some words in order: shard, index there (-1 if unknown), count and probability."""
        shards = len(self.firsts)
        where = ((hashes >> np.uint64(32)) * np.uint64(max(shards, 1)) >> np.uint64(32)).astype(np.int64)
        index, count, p = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.full(len(hashes), 1 / (self.tokens + self.words + 1))
        for a, n in zip(*runs_of(where), strict=True) if shards else []:
            if (open_ := self.vocabulary(int(where[a]))) is None:
                continue
            words, counts, codes, values = open_
            at = words.find(hashes[a : a + n])
            own, at = a + np.flatnonzero(at >= 0), at[at >= 0]
            index[own], count[own], p[own] = at, counts[at], (10.0**values)[codes[at]]
        return where, index, count, p

    def walk(self, hashes: np.ndarray, starts: np.ndarray, upto: int, rate: bool = True) -> tuple[Window, np.ndarray, np.ndarray]:
        """The window after level ``upto``, the counts of its words and the probabilities of its tokens, which are the words' own unless rated."""
        words, of, _, _ = distinct_of(hashes)
        shard, index, count, own = self.look_up(words)
        known = index >= 0
        ids = np.maximum.accumulate(np.where(known, np.array([*self.firsts, 0])[np.where(known, shard, -1)] + index, -1))
        later = np.ones(len(hashes), bool)
        later[starts] = False
        window = Window(of, later, own[of], _numbered(known)[of], ids, count, known, shard[known], index[known])
        for k in range(2, upto + 1):
            self._step(window, k, rate, k < upto or not rate)
        return window, window.count, window.p

    def _step(self, window: Window, k: int, rate: bool, on: bool) -> None:
        """Walk one level on: each distinct n-gram is looked up once, shard by shard and in order. Without ``on``, only probabilities are wanted."""
        at, which, context, word, place, _ = window.follow()
        part, held, factor = self.place(window, k, context, word)
        entry, p = np.full(len(context), -1, held.dtype), window.p[place] if rate else None
        for a, n in zip(*(x.tolist() for x in runs_of(part)), strict=True):
            own = context[a : a + n]
            if rate:
                p[a : a + n] *= factor[own]
            if (level := self.level(k, int(part[a]))) is None:
                continue
            own, asked = held[own], word[a : a + n]
            weights = level.weights[own]
            if rate:
                p[a : a + n] *= (10.0**level.weight_values)[weights]
            able = np.flatnonzero(window.known[asked] & (weights > 0))
            found = level.find(own[able], window.ids[asked[able]])
            able, found = a + able[found >= 0], found[found >= 0]
            entry[able] = found
            if rate:
                p[able] += (10.0**level.values)[level.codes[found]]
        if rate:
            window.p[at] = p[which]
        if on:
            there = entry >= 0
            window.shard, window.entry = part[there], entry[there]
            window.before = np.full(len(window.of), -1, window.of.dtype)
            window.before[at] = _numbered(there)[which]

    def place(self, window: Window, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each n-gram of level ``k``, given its context and word in the window: its shard; of each context its place there and the factor of its range."""
        cuts = self.cuts[k - 2]
        cut = cuts.of(window.shard, window.entry).astype(np.int32)
        part = np.empty(len(context), np.int32)
        for a in range(0, len(context), _CHUNK):
            part[a : a + _CHUNK] = cuts.part(cut[context[a : a + _CHUNK]], window.ids[word[a : a + _CHUNK]])
        return part, (window.entry - cuts.begin[cut]).astype(_kind(int(cuts.end.max(initial=0)))), (10.0**cuts.weights)[cut]


def _numbered(there: np.ndarray) -> np.ndarray:
    """The place of each among those that are there, -1 for the others."""
    kind = _kind(len(there))
    return np.where(there, np.cumsum(there, dtype=kind) - 1, -1).astype(kind)


def _together(model: Model) -> int:
    """How many tokens are looked up together."""
    return min(max(_WINDOW, _WINDOW_SHARD * sum(map(len, model.folders))), _WINDOW_MOST)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of many texts at once, with the places where texts begin."""
    held, starts, n = [], [], 0
    for b in slices(batches):
        tokens, begins = token_hashes(b.column(0))
        held.append(tokens)
        starts.append(begins + n)
        n += len(tokens)
        if n >= size:
            window, held, starts, n = (np.concatenate(held), np.concatenate(starts)), [], [], 0
            yield window
    if held:
        yield np.concatenate(held), np.concatenate(starts)


def _shrink(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    pack = zstandard.ZstdCompressor(level=1).compress
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack(steps.view(np.uint8).reshape(-1, 8).T.tobytes()), pack(counts.astype("<u4").tobytes())


def _merge(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    keys = [np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(k), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for k, _ in rows]
    counts = np.concatenate([np.frombuffer(unpack(c), "<u4") for _, c in rows]).astype(np.int64)
    joined = np.concatenate(keys)
    joined, _, order, begins = distinct_of(joined, max(int(joined.max()).bit_length(), 1))
    return joined, np.add.reduceat(counts[order], begins)


def train(docs: DataFrame, order: int = 3, min_count: int = 1, discount: float = 0.75, shard_words: int = 1 << 18, group_tokens: int = 4_000_000) -> Model:
    """Train on the column ``text`` of all rows."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    folder = shared_path(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in _windows(batches, _WINDOW):
            values, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["hash", "n"])

    words = texts.mapInArrow(count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).persist()
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    vocabulary, tokens = total["v"], total["n"]
    if vocabulary >= 1 << 32:
        raise ValueError(f"{vocabulary} distinct words: word ids have 32 bits")
    shards = -(-vocabulary // shard_words)
    model = Model(tokens, vocabulary, [0] * shards, [[None] * shards])

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = f"{folder}/words-{int(key[0]):06d}-{TaskContext.get().taskAttemptId()}"
        arrays: dict[str, np.ndarray] = {}
        hashes = rows["hash"].to_numpy().view(np.uint64)
        order_ = np.argsort(hashes)
        counts = rows["n"].to_numpy()[order_]
        EliasFano.build(hashes[order_]).save(arrays.__setitem__, "words")
        codes, values = quantise(np.log10((counts + 1) / (tokens + vocabulary + 1)))
        Files(base).save(arrays | {"counts": counts.astype(np.min_scalar_type(counts.max(initial=0))), "codes": codes, "values": values})
        return pd.DataFrame({"shard": [int(key[0])], "base": [base], "n": [len(counts)], **_cut_row(counts, group_tokens)})

    if shards:
        shard = F.shiftright(F.shiftrightunsigned("hash", 32) * F.lit(shards).cast("long"), 32)
        written = words.withColumn("shard", shard).groupBy("shard").applyInPandas(write_words, f"shard long, base string, n long, {_CUT_ROW}").collect()
        sizes = [0] * shards
        for r in written:
            model.folders[0][r["shard"]], sizes[r["shard"]] = r["base"], r["n"]
        model.firsts = [0, *np.cumsum(sizes).tolist()][:-1]
        model.cuts.append(_cuts(written, vocabulary))
    words.unpersist()
    for k in range(2, order + 1 if shards else 2):
        _train_level(texts, model, k, order, min_count, discount, group_tokens, folder)
    return model


_CUT_ROW = "begins array<long>, ways array<long>"


def _cut_row(counts: np.ndarray, group_tokens: int) -> dict[str, list]:
    begins, ways = cuts_of(counts, group_tokens)
    return {"begins": [begins.tolist()], "ways": [ways.tolist()]}


def _cuts(written: list, words: int) -> Cuts:
    return Cuts([(r["shard"], r["n"], np.array(r["begins"], np.int64), np.array(r["ways"], np.int64)) for r in written], words)


def _train_level(texts: DataFrame, model: Model, k: int, order: int, min_count: int, discount: float, group_tokens: int, folder: str) -> None:
    """Count, merge and write level ``k``, and add it to the model; counts are kept where a next level needs them."""
    below, cuts = list(model.folders[-1]), model.cuts[-1]
    cut_of = np.repeat(np.arange(len(cuts.ways)), cuts.ways)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, starts in _windows(batches, _together(model)):
            window, able = model.walk(hashes, starts, k - 1, rate=False)[0], None
            frequent = window.count >= min_count
            if min_count > 1 or not frequent.all():
                able = frequent[window.of]
                able[1:] &= able[:-1].copy()
                able &= window.before >= 0
            at, _, context, word, _, begins = window.follow(able)
            group, held, _ = model.place(window, k, context, word)
            times = np.diff(begins, append=len(at))
            keys = (held[context].astype(np.uint64) << np.uint64(32)) | window.ids[word].astype(np.uint64)
            out = [(int(group[a]), *_shrink(keys[a : a + n], times[a : a + n])) for a, n in zip(*runs_of(group), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        base = f"{folder}/level{k}-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        arrays: dict[str, np.ndarray] = {}
        cut = cut_of[shard]
        keys, counts = _merge(list(zip(rows["keys"], rows["counts"], strict=True)))
        if min_count > 1:
            keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        totals = np.asarray(Files(below[cuts.parent[cut]]).get("counts")[cuts.begin[cut] : cuts.end[cut]])
        context, word = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        pointers = np.searchsorted(context, np.arange(len(totals) + 1))
        p = (counts - discount) / totals[context]
        left = np.clip(1 - np.bincount(context, p, len(totals)), 1e-12, 1.0)
        begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        last = np.concatenate([begins[1:], [len(context)]]) - 1
        raise_by = np.concatenate([[0], np.cumsum(word[last])[:-1]]).astype(np.uint64) if len(begins) else np.zeros(0, np.uint64)
        EliasFano.build(pointers).save(arrays.__setitem__, "pointers")
        EliasFano.build(word + np.repeat(raise_by, np.diff([*begins, len(context)]))).save(arrays.__setitem__, "words")
        codes, values = quantise(np.log10(p))
        weights, own = np.zeros(len(totals), np.uint8), context[begins]
        weights[own], weight_values = quantise(np.log10(left[own]) if cuts.ways[cut] == 1 else np.zeros(len(own)))
        arrays |= {"codes": codes, "values": values, "weights": weights, "weight_values": weight_values}
        if k < order:
            arrays["counts"] = counts.astype(np.min_scalar_type(counts.max(initial=0)))
        Files(base).save(arrays)
        return pd.DataFrame({"shard": [shard], "base": [base], "n": [len(counts)], "taken": [float(p.sum())], **_cut_row(counts, group_tokens)})

    counted = texts.mapInArrow(count, "part long, keys binary, counts binary").groupBy("part")
    written = counted.applyInPandas(write, f"shard long, base string, n long, taken double, {_CUT_ROW}").collect()
    folders: list[str | None] = [None] * cuts.shards
    taken = np.zeros(len(cuts.ways))
    for r in written:
        folders[r["shard"]] = r["base"]
        taken[cut_of[r["shard"]]] += r["taken"]
    cuts.weights = np.where(cuts.ways > 1, np.log10(np.clip(1 - taken, 1e-12, 1.0)), 0.0)
    model.folders.append(folders)
    model.cuts.append(_cuts(written, model.words))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row; scores are log10 probabilities of the text."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rated(ids: list[pa.Array], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.concatenate([np.diff(starts, append=len(tokens)) for tokens, starts in parts])
        starts = np.cumsum(lengths) - lengths
        hashes = np.concatenate([tokens for tokens, _ in parts])
        parts.clear()
        window, count, p = model.walk(hashes, starts, len(model.folders))
        base = np.log10((count + 1) / (model.tokens + model.words + 1))
        sums = [pa.array(np.add.reduceat(x, starts)) for x in (window.known.astype(np.int64)[window.of], base[window.of], np.log10(p))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(lengths), *sums], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, size = [], [], 0, _together(model)
        for b in slices(batches):
            ids.append(b.column(0))
            parts.append(token_hashes(b.column(1)))
            n += len(parts[-1][0])
            if n >= size:
                yield rated(ids, parts)
                ids, parts, n = [], [], 0
        if ids:
            yield rated(ids, parts)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
