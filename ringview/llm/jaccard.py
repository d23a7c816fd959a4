"""Exact n-gram Jaccard join and the components of its links.

Documents with equal shingle sets collapse into one class. Classes meet in tiles: a tile is a shingle and a size
band. A class opens tiles for the first ``n - ceil(t * n) + 1`` of its ordered shingles, one of which two sets of
similarity ``t`` must share (prefix filter), in the band of its own size and in that of the largest set it can link with;
bands double in size. Shingles that many documents hold are ordered last, so a common passage
opens no tile unless a text consists of such. In a tile, sizes must agree
(``t * larger <= smaller``) and both classes must be in tiles enough for the overlap that a link needs; then hashed bitmap signatures bound the overlap from above by bit counts; what is
left is decided by intersecting the sorted shingle arrays.

Links are found in two rounds, so that a group of copies costs its size and not its square: first every tile
member against the tile's pivot; then only members that are still in different components and that the
triangle inequality over their distances to the pivot leaves a link (the Jaccard distance is a metric).
A pair in one component needs no test, and nothing else is left out: components are exact. A tile's pivot and
components come from sums that are merged before the shuffle and joined back, so no task needs a whole tile.

Shingles are compared by 64-bit hashes of their words; sets are exact up to collisions of those.

Defined results: null or blank texts have an empty set and link with nothing; rows
that repeat an id are one node: links of any of its texts count, and all its rows have its component; a row without id has no component
and links with nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, prepare, slices
from .words import of_column

#: Signature bits for sets of up to half as many shingles; larger sets double them.
LEAST_BITS = 2048


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer words, the whole sequence is one."""
    hashes, first = of_column(texts)
    whole = _rolled(hashes, width) if len(hashes) >= width else hashes[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - width + 1]) if b - a >= width else _rolled(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), width)[0]


def signature(found: np.ndarray) -> bytes:
    """A bitmap of the set; its size is a power of two that follows the size of the set."""
    bits = LEAST_BITS
    while bits < 2 * len(found):
        bits *= 2
    mark = np.zeros(bits, np.uint8)
    mark[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark).tobytes()


def most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """The overlap's upper bound: a bit of one side alone is at least one shingle of that side alone."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def linked(shared: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * shared >= percent * (n_a + n_b - shared)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, width: int, window: int = 4_000_000, least: int = 4) -> DataFrame:
    """Per row its set's size, fingerprint and signature; per window of shingles, those that several sets hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            at = counts >= least
            empty = [pa.array([None], t) for t in (kind, pa.int64(), pa.binary(), pa.binary())]
            parts = [pa.array([values[at].view(np.int64)], pa.list_(pa.int64())), pa.array([counts[at]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*empty, *parts], names)

        names, kind, size = ["id", "n", "fingerprint", "signature", "common", "counts"], pa.int64(), 0
        for b in slices(batches):
            found = shingle_sets(b.column(1), width)
            prints = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
            none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(prints, pa.binary()), pa.array([signature(x) for x in found], pa.binary()), none, none], names
            )
            for x, p in zip(found, prints, strict=True):
                if p not in seen:
                    seen.add(p)
                    held.append(x)
                    size += len(x)
            if size > window:
                yield common()
                seen, held, size = set(), [], 0
        yield common()

    return docs.mapInArrow(of, "id long, n long, fingerprint binary, signature binary, common array<long>, counts array<long>")


def bands(n: int, percent: int) -> list[int]:
    """The size bands of a set of ``n``: its own and, if another, that of the largest set it can link with."""
    own, last = n.bit_length(), (100 * n // percent).bit_length()
    return [own] if own == last else [own, last]


def tile_numbers(prefix: np.ndarray, band: int) -> np.ndarray:
    """The numbers of the tiles of these shingles in a band."""
    return prefix ^ np.uint64(band * 0xD6E8FEB86659FD93 % 2**64)


def _entries(docs: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """``(tile, id, pos, rank)`` of each set's prefix, common shingles last; the more of a set is common, the lower its rank."""
    last = docs.sparkSession.sparkContext.broadcast(common)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts: list[tuple[np.ndarray, int, int, int]] = []
            for id_, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width), strict=True):
                need, rank = prefix_length(len(x), percent) if len(x) else 0, 0
                if len(last.value) and need:
                    at = np.searchsorted(last.value, x)
                    is_common = last.value[np.minimum(at, len(last.value) - 1)] == x
                    rank = -int(is_common.sum())
                    x = np.concatenate([x[~is_common], x[is_common]]) if rank else x
                parts += [(tile_numbers(x[:need], band), id_, need, rank) for band in bands(len(x), percent)]
            sizes = [k for _, _, k, _ in parts]
            columns = [
                pa.array(np.concatenate([t for t, *_ in parts]).view(np.int64) if parts else [], pa.int64()),
                pa.array(np.repeat([i for _, i, _, _ in parts], sizes), pa.int64()),
                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]) if parts else [], pa.int32()),
                pa.array(np.repeat([r for *_, r in parts], sizes), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tile", "id", "pos", "rank"])

    return docs.mapInArrow(of, "tile long, id long, pos int, rank int")


def _only(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """The documents of these distinct ids; the ids are broadcast up to a size, beyond it both sides are shuffled."""
    small = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def _able(low_a: Column, low_b: Column, high_a: Column, high_b: Column, tiles_a: Column, tiles_b: Column, percent: int) -> Column:
    """Whether two sets can link by their sizes and tiles.

    Of the shingles that two sets share, those up to the end of the prefix that ends first open tiles that both
    are in, and no more than the rest of that set come after it.
    """
    sized = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    needed = F.ceil(percent * (low_a + low_b) / (100 + percent))
    behind = F.ceil(percent * F.greatest(high_a, high_b) / 100) - 1
    return sized & (F.least(tiles_a, tiles_b) + behind >= needed)


def _measured(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int, broadcast_ids: int) -> DataFrame:
    """Each pair ``(a, b)`` of one size band with bounds on its Jaccard distance: ``low``, ``high``, and ``linked``.

    Where the signatures leave a link open both bounds are the exact distance, else ``high`` is 1.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            rows = zip(*(b.column(k).to_pylist() for k in ("sa", "sb", "na", "nb")), strict=True)
            most = [(most_shared(x, y, m, n), m, n) for x, y, m, n in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b"), pa.array([1 - k / (m + n - k) for k, m, n in most]), pa.array([linked(k, m, n, percent) for k, m, n in most])], ["a", "b", "low", "open"]
            )

    side = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("tiles").alias(f"t{c}"), F.col("signature").alias(f"s{c}"))
    banded = pairs.join(side("a"), "a").join(side("b"), "b").where(_able(*map(F.col, ("na", "nb", "na", "nb", "ta", "tb")), percent)).select("a", "b", "na", "nb", "sa", "sb")
    tested = cut(banded.mapInArrow(bounded, "a long, b long, low double, open boolean").groupBy("a", "b").agg(F.min("low").alias("low"), F.max("open").alias("open")), "bounded-pairs")
    passed = tested.where("open")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1), width)], pa.binary())], ["id", "x"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            far, keep = [], []
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                k = len(np.intersect1d(p, q, assume_unique=True))
                far.append(1 - k / max(len(p) + len(q) - k, 1))
                keep.append(linked(k, len(p), len(q), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(far, pa.float64()), pa.array(keep, pa.bool_())], ["a", "b", "d", "linked"])

    ids = passed.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_only(docs, ids, broadcast_ids).mapInArrow(arrays, "id long, x binary"), "shingle-arrays")
    left, right = sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), sets.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    known = passed.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(exact, "a long, b long, d double, linked boolean")
    # An id with several texts has several distances: the least and the greatest bound them all.
    known = cut(known.groupBy("a", "b").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("linked").alias("linked")), "measured-pairs")
    drop(sets)
    return known.unionByName(tested.where("NOT open").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked")))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of the links ``(a, b)``, the smallest id of each component.

    Large-star and small-star steps alternate on written edge tables until nothing changes; the number of
    rounds grows with the logarithm of a component's size. Minima are merged before the shuffle and joined
    back, so the neighbours of one node need not meet in one task.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    least = lambda e: e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    before = mark(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = cut(large, "stars")
        found, old = least(large), edges
        edges = cut(found.select("u", F.col("m").alias("v")).union(found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        drop(large, old)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def join(
    docs: DataFrame, width: int = 5, percent: int = 80, common_over: int = 32, most_common: int = 1_000_000, broadcast_ids: int = 1_000_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs (doc_id, text)`` to ``(rows, classes, links)``.

    ``rows``: ``id, n, fingerprint`` of each row. ``classes``: ``fingerprint, id, n``, each distinct set under its
    smallest id. ``links``: verified pairs ``(a, b)`` of class ids, enough for all components. ``common_over``
    and ``most_common`` say which shingles are ordered last; they change the work, not the result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = cut(_sets(docs, width), "sets")
    rows = sets.where("common IS NULL").select("id", "n", "fingerprint", "signature")
    counted = sets.where("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "counts")).alias("x")).groupBy("x.common").agg(F.sum("x.counts").alias("c"))
    common = counted.where(F.col("c") > common_over).orderBy(F.desc("c"), "common").limit(most_common).select("common").toPandas()["common"]
    common = np.sort(common.to_numpy(np.int64).view(np.uint64))

    full = rows.where("id IS NOT NULL AND n > 0")
    classes = cut(full.groupBy("fingerprint").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes")
    ids = classes.select("id").distinct()
    docs = docs.where("id IS NOT NULL")
    entries = cut(_entries(_only(docs, ids, broadcast_ids), common, width, percent), "entries")
    # The pivot of a tile is the class with the most common shingles: the copy that others differ from least.
    opened = entries.groupBy("tile").agg(F.count("*").alias("members"), F.min(F.struct("rank", "id")).alias("pivot")).where("members > 1")
    shared = cut(entries.join(opened.select("tile", F.col("pivot.id").alias("pivot")), "tile").select("tile", "id", "pos", "pivot"), "shared")
    drop(entries)
    # A shingle of both bands counts once.
    onward = F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("pos"))).cast("long")
    tiles = cut(shared.select("tile", "id", onward.alias("onward"), "pivot"), "tiles")
    drop(shared)
    sizes = cut(classes.select("id", "n", "signature").join(tiles.groupBy("id").agg(F.max("onward").alias("tiles")), "id"), "sizes")
    stars = cut(tiles.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    measured = cut(_measured(stars, sizes, docs, width, percent, broadcast_ids), "star-distances")
    links = measured.where("linked").select("a", "b")

    found = components(links)
    placed = cut(tiles.join(found, "id", "left").select("tile", "id", "onward", "pivot", F.coalesce("component", "id").alias("component")), "placed")
    open_ = placed.groupBy("tile").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("tile")
    mixed = placed.join(open_, "tile").join(sizes.groupBy("id").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high")), "id")
    to_pivot = measured.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "low", "high")
    is_pivot = F.col("id") == F.col("pivot")
    mixed = cut(
        mixed.join(to_pivot, ["pivot", "id"], "left").select(
            "tile",
            "id",
            "component",
            "n_low",
            "n_high",
            "onward",
            F.when(is_pivot, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"),
            F.when(is_pivot, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high"),
        ),
        "mixed-tiles",
    )
    # Distances obey the triangle inequality: two classes as far apart as their distances to the pivot differ cannot link.
    a, b = mixed.alias("a"), mixed.alias("b")
    most = 1 - percent / 100 + 1e-9
    near = (F.col("a.low") - F.col("b.high") <= most) & (F.col("b.low") - F.col("a.high") <= most)
    # In the first tile that a pair shares, no shared tile lies before: what is onward bounds the overlap (positional filter).
    able = _able(*(F.col(f"{x}.{c}") for c in ("n_low", "n_high", "onward") for x in "ab"), percent)
    across = a.join(b, (F.col("a.tile") == F.col("b.tile")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.id") < F.col("b.id")) & able & near)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cut(across.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    drop(placed, mixed)
    links = links.union(_measured(rest, sizes, docs, width, percent, broadcast_ids).where("linked").select("a", "b"))
    return rows, classes, links


def duplicates(docs: DataFrame, **kw: int) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``; the component is the smallest id that links reach."""
    rows, classes, links = join(docs, **kw)
    # A class holds ids besides its own: each joins the graph through the class.
    full = rows.where("id IS NOT NULL AND n > 0").select("id", "fingerprint").distinct()
    named = full.join(classes.select("fingerprint", F.col("id").alias("class_id")), "fingerprint")
    several = named.groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("texts"))
    extra = named.join(several.where("texts > 1").select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    found = components(links.union(extra)).withColumnRenamed("id", "class_id")
    of_id = several.join(found, "class_id", "left").select("id", F.coalesce("component", "class_id").alias("component_id"))
    return rows.join(of_id, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_duplicates(docs: DataFrame, broadcast_ids: int = 1_000_000, **kw: int) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns.

    An id's rows with different texts are one document and stay or go together; of its rows that are equal in text one stays.
    Rows with empty sets link with nothing and stay, also where other rows of their id go; rows without id all stay.
    """
    rated = duplicates(docs.select("doc_id", "text"), broadcast_ids=broadcast_ids, **kw)
    gone = cut(rated.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & worded, "left_anti")
    again = cut(left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("__repeated")), "repeated-ids")
    if again.isEmpty():
        return left
    small = again.limit(broadcast_ids + 1).count() <= broadcast_ids
    own = left.join(F.broadcast(again) if small else again, F.col("doc_id") == F.col("__repeated"), "left")
    return own.where("__repeated IS NULL").unionByName(own.where("__repeated IS NOT NULL").dropDuplicates(["doc_id", "text"])).drop("__repeated")
