"""License scans with DataFrame functions only.

Two findings are joined. Phrases: every place where a phrase's words stand consecutively. Templates: an exact
set-similarity join of text blocks with license templates that finds every block holding at least ``threshold`` of a
template's distinct words. Blocks are the lines of up to ``LONGEST_LINE`` words; for notices wrapped over lines and for longer lines there are also runs, which cross line
breaks: each word counts that stands within ``slack`` places of its own in the template, laid at any word of the
text, and ``slack`` is how many words may be missing. Template words are ordered by their frequency over the whole
corpus, rarest first. A block and a template can only meet the threshold if they share a word in the first
``size - needed + 1`` of each (prefix filter), if the block has enough template words at all (length filter),
and if enough words are left behind the first shared one on both sides (positional filter); what passes is
intersected in full. A template is laid only where one of its prefix words stands near its place and enough of its words are around.

The score is 1 where a phrase stands, else the best containment of a template that was met, else 0.

Defined results: null text is empty: no words, no labels, score 0; equal rows give equal results, rows that share an
id alone stay apart; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .decontamination import SEPARATORS, words_of

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed wording of license notices; the label of each is the method's own. A name that may be missing at the threshold decides no label.
TEMPLATES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-notice",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-text",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache-text",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of": "gpl-text",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-text",
    "you should have received a copy of the gnu general public license along with this program if not see": "gpl-text",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-text",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit-text",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-text",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-text",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-text",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: A line of more words is no block of its own: words far apart say nothing together.
LONGEST_LINE = 128


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _places(words: Column, parts: list[str], label: str) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: F.slice(words, i + 1, F.lit(len(parts))) == _lit_array(parts))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """``(start, label)`` of every place, in order; words are probed one by one only where all of a phrase's words occur."""
    none = F.array().cast("array<struct<start:int,label:string>>")
    places = none
    for phrase, label in phrases.items():
        parts = phrase.split()
        has = F.lit(True)
        for part in parts:
            has = has & F.array_contains(words, part)
        places = F.concat(places, F.when(has & (F.size(words) >= len(parts)), _places(words, parts, label)).otherwise(none))
    return F.array_sort(places)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def template_index(docs: DataFrame, templates: dict[str, str], threshold: float) -> tuple[dict[str, int], list[tuple[int, list[int], int, str]]]:
    """Ranks of all template words by corpus frequency, and each template as ``(id, ranks, needed, label)``."""
    sets = {t: sorted(set(t.split())) for t in templates}
    vocabulary = sorted({w for s in sets.values() for w in s})
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.col("word").isin(vocabulary))
    counts = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    return rank, [(k, sorted(rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9), templates[t]) for k, (t, s) in enumerate(sets.items())]


def template_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every block that meets a template: ``doc_id, text_hash, block, label, containment``; the block is its line's number, null for runs across lines."""
    spark = docs.sparkSession
    rank, index = template_index(docs, templates, threshold)
    vocabulary, least = sorted(rank), min(needed for _, _, needed, _ in index)
    prefixes = {r for _, ranks, needed, _ in index for r in ranks[: len(ranks) - needed + 1]}
    rare = sorted(w for w, r in rank.items() if r in prefixes)
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    able = _keyed(docs).where(F.arrays_overlap(words_of(F.col("text")), _lit_array(rare)))
    lines = able.select("doc_id", "text_hash", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("block", "line"))
    own = F.filter(F.array_distinct(F.split("line", SEPARATORS)), lambda w: w.isin(vocabulary))
    short = F.size(F.array_remove(F.split("line", SEPARATORS), "")) <= LONGEST_LINE
    blocks = lines.where(short).select("doc_id", "text_hash", "block", F.array_sort(F.transform(own, lambda w: ranks[w])).alias("r")).where(F.size("r") >= least)
    rows = [(k, label, t, needed, pos, token) for k, t, needed, label in index for pos, token in enumerate(t[: len(t) - needed + 1])]
    prefix = F.broadcast(spark.createDataFrame(rows, "template int, label string, t array<int>, needed int, t_pos int, token int"))
    met = blocks.select("*", F.posexplode("r").alias("r_pos", "token")).join(prefix, "token")
    enough = (F.size("r") >= F.col("needed")) & (F.col("r_pos") <= F.size("r") - F.col("needed")) & (F.least(F.size("t") - F.col("t_pos"), F.size("r") - F.col("r_pos")) >= F.col("needed"))
    shared = F.size(F.array_intersect("r", "t"))
    whole = met.where(enough).withColumn("shared", shared).select("doc_id", "text_hash", "block", "label", "t", "needed", "shared")
    runs = _runs(able.where(F.contains("text", F.lit("\n")) | (F.size(words_of(F.col("text"))) > LONGEST_LINE)), templates, rank, index).withColumn("block", F.lit(None).cast("int"))
    return (
        whole.unionByName(runs)
        .where(F.col("shared") >= F.col("needed"))
        .select("doc_id", "text_hash", "block", "label", (F.col("shared") / F.size("t")).alias("containment"))
        .distinct()
    )


def _runs(docs: DataFrame, templates: dict[str, str], rank: dict[str, int], index: list[tuple[int, list[int], int, str]]) -> DataFrame:
    """``shared`` words of the best run around each place of a template's prefix word."""
    rows = []
    for text, (_, t, needed, label) in zip(templates, index, strict=True):
        own = [(rank[w], place) for place, w in enumerate(text.split())]
        rows += [(label, t, needed, own, len(t) - needed, token, place) for token, place in own if token in t[: len(t) - needed + 1]]
    prefix = F.broadcast(docs.sparkSession.createDataFrame(rows, "label string, t array<int>, needed int, own array<struct<r:int,place:int>>, slack int, token int, place int"))
    tokens, reach = sorted({x[5] for x in rows}), max(len(x[3]) + 2 * x[4] for x in rows)
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    words = F.transform(words_of(F.col("text")), lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    marks = F.transform(F.filter(words, lambda x: x["w"].isin(sorted(rank))), lambda x: F.struct(x["at"].alias("at"), ranks[x["w"]].alias("r")))
    numbered = F.transform("marks", lambda x, j: F.struct(x["r"].alias("token"), x["at"].alias("at"), j.alias("j")))
    near = lambda x: F.slice("marks", F.greatest(x["j"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    anchors = F.transform(F.filter(numbered, lambda x: x["token"].isin(tokens)), lambda x: F.struct(x["token"].alias("token"), x["at"].alias("at"), near(x).alias("near")))
    met = docs.select("doc_id", "text_hash", marks.alias("marks")).select("doc_id", "text_hash", F.inline(anchors)).join(prefix, "token")
    around = F.filter("near", lambda x: F.abs(x["at"] - F.col("at")) <= reach)
    stands = lambda e, first: F.exists("near", lambda x: (x["r"] == e["r"]) & (F.abs(x["at"] - first - e["place"]) <= F.col("slack")))
    held = lambda first: F.size(F.array_distinct(F.transform(F.filter("own", lambda e: stands(e, first)), lambda e: e["r"])))
    first = F.col("at") - F.col("place")
    best = F.array_max(F.transform(F.sequence(first - F.col("slack"), first + F.col("slack")), held))
    enough = F.size(F.array_intersect("t", F.transform(around, lambda x: x["r"]))) >= F.col("needed")
    return met.where(enough).select("doc_id", "text_hash", "label", "t", "needed", best.alias("shared"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row ``doc_id, n_words, places, base_labels, labels, score``."""
    docs = docs.select("doc_id", "text")
    found = template_blocks(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best")).alias("m")
    rows = _keyed(docs).select("doc_id", "text_hash", words_of(F.col("text")).alias("w")).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w"), phrases).alias("places")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_hash") == F.col("m.text_hash"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_distinct(F.concat(base, F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.join(found, same, "left").select(F.col("d.doc_id").alias("doc_id"), "n_words", "places", F.array_sort(base).alias("base_labels"), F.array_sort(every).alias("labels"), score.alias("score"))
