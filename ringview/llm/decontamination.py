"""Benchmark decontamination with DataFrame functions only.

Every benchmark item gives its windows of ``width`` consecutive words; an item with fewer words is one window.
The hashes of all distinct windows are a set of 64-bit numbers that is broadcast. One scan over the
documents hashes each window of a text from the hashes of its words and probes the set; windows that hit are compared word by
word with the benchmark's, so a hash never decides alone. Verified spans are gathered by row; hit words are the union of its spans.

Up to ``broadcast_windows`` hashes are broadcast at once; a larger benchmark is taken in blocks of about that many,
one scan for each, so the set in memory stays bounded and no text is shuffled.

A row is known by its id and a hash of its text, so equal rows give equal results and rows that only share an
id stay apart. Null text has no words, and neither has a null item; a null item id counts as an item but has
no name in the digest; empty tables give no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import ascii_lower, cut

#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13


def words_of(text: Column) -> Column:
    """Lower-cased words as an array; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct ``(item_id, window)`` of the benchmark."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = f"sequence(1, greatest(1, size(w) - {width - 1}))"
    return items.select("item_id", F.explode(F.expr(f"transform({starts}, i -> slice(w, i, {width}))")).alias("window")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words_of(F.col("text")).alias("w"))


def _hashes(length: int) -> str:
    """SQL for the hash of each window of ``length`` words, from the array ``h`` of word hashes."""
    return f"if(size(h) >= {length}, transform(sequence(1, size(h) - {length - 1}), i -> xxhash64(slice(h, i, {length}))), array())"


def window_index(benchmark: DataFrame, width: int) -> DataFrame:
    """``(hash, length, window, items, unnamed)`` of each distinct window."""
    wins = windows(benchmark, width).groupBy("window").agg(F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    return wins.select(F.expr("xxhash64(transform(window, x -> xxhash64(x)))").alias("hash"), F.size("window").alias("length"), "window", "items", "unnamed")


def hit_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``(doc_id, text_hash, start, length, items, unnamed)``: every place in a document where a window occurs."""
    index = cut(window_index(benchmark, width), "benchmark-windows")
    sizes = index.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row for each length up to width
    lengths, blocks = sorted((r["length"] for r in sizes), reverse=True), max(1, -(-sum(r["n"] for r in sizes) // broadcast_windows))
    # The windows of all lengths stand one after another, so a text is scanned once.
    each = F.expr(f"concat({', '.join(map(_hashes, lengths or [width]))})")
    length, start, before = F.lit(0), F.col("at"), F.lit(0)
    for k in lengths:
        own = (F.col("at") >= before) & (F.col("at") < before + F.greatest(F.col("n") - (k - 1), F.lit(0)))
        length, start = F.when(own, k).otherwise(length), F.when(own, F.col("at") - before).otherwise(start)
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    rows = _rows(docs).select("doc_id", "text_hash", "w", F.size("w").alias("n"), F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    met = []
    for block in range(blocks):
        own = index.where(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else index
        places = rows.select("doc_id", "text_hash", "w", "n", F.posexplode(each).alias("at", "hash"))
        hit = places.join(F.broadcast(own.select("hash").distinct()), "hash", "left_semi")
        hit = hit.select("doc_id", "text_hash", "hash", start.cast("int").alias("start"), F.slice("w", start + 1, length).alias("window"))
        met.append(hit.join(own, ["hash", "window"]).select("doc_id", "text_hash", "start", "length", "items", "unnamed"))
    return reduce(DataFrame.unionByName, met)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Per row ``doc_id, text_hash, n_words, n_hit, n_items, items, spans``; spans are disjoint ``(start, end)`` word ranges."""
    spans = hit_spans(docs, benchmark, width, broadcast_windows)
    by_row = spans.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("s"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.max("unnamed").alias("unnamed"),
    )
    joined = F.expr(
        "aggregate(s, cast(array() as array<struct<start:int,end:int>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= x.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), "
        "concat(a, array(x))))"
    )
    by_row = by_row.select("doc_id", "text_hash", joined.alias("spans"), "items", (F.size("items") + F.col("unnamed").cast("int")).alias("n_items"))
    rows = _rows(docs).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    n_hit = F.expr("aggregate(h.spans, 0L, (a, x) -> a + x.end - x.start)")
    return rows.join(by_row.alias("h"), same, "left").select(
        "d.doc_id", "d.text_hash", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast(ArrayType(benchmark.schema["item_id"].dataType))).alias("items"), F.col("h.spans").alias("spans")
    )


def contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Spans of few hit words are found before the whole rows are touched: only contaminated rows' keys meet the
    documents again, in an anti-join.
    """
    bad = decontaminate(docs.select("doc_id", "text"), benchmark, width).where(contaminated()).select("doc_id", "text_hash").distinct().alias("b")
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    return docs.alias("d").join(bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(text) == F.col("b.text_hash")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, replacement: str = " ") -> DataFrame:
    """``doc_id, text``: lower-cased words outside all hit spans, joined by ``replacement``."""
    found = decontaminate(docs, benchmark, width).select("doc_id", "text_hash", "spans").distinct().alias("h")
    rows = _rows(docs).alias("d")
    keep = F.expr("filter(transform(w, (x, i) -> if(exists(coalesce(spans, array()), s -> s.start <= i and i < s.end), null, x)), x -> x is not null)")
    return rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left").select("d.doc_id", F.array_join(keep, replacement).alias("text"))
