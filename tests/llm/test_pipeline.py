from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ringview.llm import quality_classifier, quality_rules
from ringview.llm.tokens import default_tokenizer

from .test_jaccard import brute
from .test_text_operators import brute_kept, brute_shifts, sigmoid, words

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "sequence_id"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rnd = random.Random(31)
    vocabulary = [f"{a}{k}" for a in ("alpha", "beta", "gamma", "delta") for k in range(60)]
    item = [rnd.choice(vocabulary) for _ in range(25)]
    docs, labels = [], []
    for i in range(1400):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", None])
        bad = rnd.random() < (0.6 if source == "b" else 0.15)
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 40, 80, 400]))]
        if bad:
            w = [x + "##" for x in w]
        if rnd.random() < 0.05:
            w = [*w[:20], *item[3:22], *w[20:]]
        if rnd.random() < 0.03:
            w = w[:10] * 9
        if docs and rnd.random() < 0.3:
            w = (docs[rnd.randrange(len(docs))][1] or "a").split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.08:
            w = [*w, "slurone", rnd.choice(["slurtwo", "slurthree"])]
        text = " ".join(w) if i % 97 else None
        docs.append((i, text, lang, source, len(text or ""), 5))
        if rnd.random() < 0.7:
            labels.append((i, int("##" not in (text or "##")), int("slurone" in (text or ""))))
    base = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, sequence_id int").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, labels, " ".join(item)


def test_every_stage_equals_brute_force(spark, world) -> None:
    sf_dir, docs, labels, item = world
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {d[0]: d for d in docs}
    counts = [len(left)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = list(left.values())
        if name == "quality_rules":
            verdict, _ = brute_kept([(i, lang, quality_rules.measure(t or "")) for i, t, lang, *_ in rows], labels)
            keep = {i for i, k in verdict.items() if k}
        elif name == "quality_classifier":
            model = quality_classifier.fit(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            evidence = [(i, s, lang, *model.logits(t or "")) for i, t, lang, s, *_ in rows]
            shifts = brute_shifts(evidence, labels)
            keep = {i for i, s, p, *zs in evidence if math.prod(1 - sigmoid(z + d) for z, d in zip(zs, shifts[s, p], strict=True)) >= 0.5}
        elif name == "jaccard_join":
            keep = {i for i, _, c in brute([(i, t) for i, t, *_ in rows]) if i == c}
        else:
            grams = {tuple(words(item)[k : k + 13]) for k in range(13)}
            keep = set()
            for i, t, *_ in rows:
                w = words(t)
                hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(k, k + 13)}
                if not hit or 20 * len(hit) < len(w):
                    keep.add(i)
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == NAMES
        got = frame.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(keep), name
        assert all(tuple(r) == left[r["doc_id"]] for r in got)
        left = {i: d for i, d in left.items() if i in keep}
        counts.append(len(left))
        frame = spark.createDataFrame(got, frame.schema).repartition(3)
    assert sorted(counts, reverse=True) == counts and len(set(counts)) == 5 and counts[-1] > 200

    truth = Tokenizer.from_file(default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(pieces) == set(left)
    for i, own in pieces.items():
        ids = np.array([*truth.encode(left[i][1] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += len(part)
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
