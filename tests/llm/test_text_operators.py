from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringview.llm import decontamination, elias_fano, html_extraction, licenses, lm, quality_classifier, quality_rules, queries
from ringview.llm import words as hashed
from ringview.llm.elias_fano import EliasFano

DOCS = "doc_id long, text string, lang string, source string, n_words int, score double"
ODD = [None, "", " ", "\n\n", "a", "É é", "x" * 9000, "the cat " * 4000, "a<b>&c #*$%|", "mit license", "CC BY cc by\ncc-by 4", "K license mit"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, **kw):
    return spark.createDataFrame([(kw.get("ids", range(len(texts)))[i], t, ["en", "fr", None][i % 3], ["a", None][i % 2], 1, 2.0) for i, t in enumerate(texts)], DOCS).repartition(2)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


# Licenses


def brute_templates(t):
    """The best containment of each label that is met, over lines and runs around every place of the text."""
    w, found = words(t), {}
    lines = [set(x) for x in map(words, (t or "").split("\n")) if len(x) <= licenses.LONGEST_LINE]
    for template, label in licenses.TEMPLATES.items():
        parts = template.split()
        s = set(parts)
        slack = len(s) - math.ceil(0.8 * len(s) - 1e-9)
        runs = []
        if "\n" in (t or "") or len(w) > licenses.LONGEST_LINE:
            at = {}
            for k, x in enumerate(w):
                at.setdefault(x, []).append(k)
            # A run can only meet the template where one of its words lies within the slack of its place.
            starts = {k - place + d for place, x in enumerate(parts) for k in at.get(x, []) for d in range(-slack, slack + 1)} if len(s & set(w)) >= len(s) - slack else set()
            runs = [{x for k, x in enumerate(parts) if x in w[max(a + k - slack, 0) : max(a + k + slack + 1, 0)]} for a in starts]
        shared = max((len(s & x) for x in [*lines, *runs]), default=0)
        if shared >= len(s) - slack:
            found[label] = max(found.get(label, 0), shared / len(s))
    return found


def test_licenses_equal_a_scan_of_every_block(spark) -> None:
    rnd = random.Random(2)
    notices = [*licenses.TEMPLATES, "Licensed under the Apache License, Version 2.0.", "GNU General Public License"]
    texts = list(ODD)
    for _ in range(120):
        lines = []
        for _ in range(rnd.randrange(4)):
            w = rnd.choice(notices).split()
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = rnd.choice(["foo", "Bar", "the", ""])
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    got = sorted(map(tuple, licenses.scan(frame(spark, texts)).select("doc_id", "n_words", F.col("places.start"), "base_labels", "labels", F.round("score", 9)).collect()))
    for (i, n, starts, base, labels, score), t in zip(got, texts, strict=True):
        w = words(t)
        places = sorted((k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        met = brute_templates(t)
        best, own = max(met.values(), default=0.0), set(met)
        bases = sorted({v for _, v in places})
        assert (n, starts, base, labels) == (len(w), [k for k, _ in places], bases, sorted({*bases, *own})), t
        assert score == pytest.approx(1.0 if places else best)


def test_notices_wrapped_over_lines_are_found(spark) -> None:
    wrapped = {
        "bsd-text": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following holds.",
        "gpl-text": "This program is free software; you can redistribute it and/or\n * modify it under the terms of the Licence as published.",
        "apache-text": "Unless required by applicable law or agreed to in writing,\nsoftware distributed under the License is distributed as is.",
        "isc-text": "Some text before.\nPermission to use, copy, modify, and/or distribute\n this software for any purpose with or without fee is hereby\n\ngranted, provided that the above copyright notice and this permission notice appear in all copies.",
        "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files.",
        "public-domain": "word " * 300 + "This is free and unencumbered software released into the public domain." + " word" * 300,
    }
    rnd = random.Random(6)
    texts = [*wrapped.values(), "all\n" + "word " * 9 + "rights\n" + "word " * 9 + "reserved", "all " + "word " * 90 + "rights " + "word " * 90 + "reserved"]
    for _ in range(150):
        w = [x for _ in range(rnd.randrange(4)) for x in rnd.choice([*licenses.TEMPLATES, "one two of the", "a b c d e f"]).split()]
        for _ in range(rnd.randrange(5) if w else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["foo", "the", "license foo"])
        texts.append("".join(x + rnd.choice([" ", " ", " ", "\n"]) for x in w))
    got = [set(r["labels"]) - set(r["base_labels"]) for r in licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    for label, found in zip(wrapped, got, strict=False):
        assert label in found
    assert not {"reserved"} & (got[len(wrapped)] | got[len(wrapped) + 1])
    for t, found in zip(texts, got, strict=True):
        own = set(brute_templates(t))
        assert found == own, t


# Decontamination


def test_decontamination_equals_all_windows(spark) -> None:
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 5, 13, 30])))) for k in range(12)] + [(100, None), (3, "w1 w2 W3"), (None, "q r s")]
    texts = list(ODD)
    for _ in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = (rnd.choice(items)[1] or "").split()
        texts.append(", ".join(w).title())
    docs = frame(spark, texts, ids=[*range(len(texts) - 1), 4])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sort_array("items"), decontamination.contaminated()).collect()

    def expected(t):
        w, marks, found = words(t), set(), set()
        for i, b in items:
            b = words(b)
            size = min(13, len(b))
            wins = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1 if wins else 0):
                if tuple(w[k : k + size]) in wins:
                    marks.update(range(k, k + size))
                    found.add(i)
        return len(w), len(marks), len(found), sorted(x for x in found if x is not None), bool(marks) and 20 * len(marks) >= len(w)

    ids = [*range(len(texts) - 1), 4]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *expected(t))) for i, t in zip(ids, texts, strict=True))
    kept = sorted((r["doc_id"], r["text"] or "") for r in decontamination.drop_contaminated(docs, bench).collect())
    assert kept == sorted((i, t or "") for i, t in zip(ids, texts, strict=True) if not expected(t)[4])


def test_spans_are_removed(spark) -> None:
    item = " ".join(f"k{i}" for i in range(15))
    docs = frame(spark, [f"before {item} after", "clean text"])
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {0: "before after", 1: "clean text"}


def test_decontamination_of_nothing(spark) -> None:
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(frame(spark, ODD), none).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(spark.createDataFrame([], DOCS), none).count() == 0


# Quality rules


def brute_measure(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marks = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marks)


def test_measures_equal_brute_force(spark) -> None:
    rnd = random.Random(1)
    texts = [*ODD, "日本 語　x\x1cy\x85z", "a b c d e f g h\n" * 3] + [rnd.choice([" ", "\n"]).join(rnd.choice(["a", "b", "#c", "é|"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    got = sorted(quality_rules.features(frame(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert [tuple(r)[1:] for r in got] == [brute_measure(t) for t in texts]


def test_the_bound_is_exact() -> None:
    for lost, good, delta in ((0, 100, 0.05), (3, 200, 0.01), (10, 50, 0.001), (0, 1, 0.5), (40, 45, 0.01), (700, 9000, 0.0005)):
        p = quality_rules.upper_bound(lost, good, delta)
        logs = (math.lgamma(good + 1) - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * math.log(p) + (good - k) * math.log1p(-p) for k in range(lost + 1))
        assert sum(map(math.exp, logs)) == pytest.approx(delta, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def quality_corpus(spark, n=6000):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(50)) for _ in range(40)]
        text = " ".join(x + "###" for x in w) if bad else " ".join(w)
        toxic = i % 7 == 3
        if toxic:
            text += " " + rnd.choice(["slurone", "slurtwo"]) + " end"
        rows.append((i, text, "en", f"s{i % 4}", 1, 1.0))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (10**9, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def test_cutoffs_keep_good_documents_and_reject_bad_ones(spark) -> None:
    docs, labels = quality_corpus(spark)
    rated = quality_rules.assess(docs, labels)
    assert rated.where("doc_id % 5 <> 0 AND NOT kept").count() == 0
    assert rated.where("doc_id % 5 = 0 AND kept").count() == 0
    kept = quality_rules.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == rated.where("kept").count()


def brute_kept(rows, labels, risk=0.02, delta=0.05, weight=4.0, last_lift=1.25, least_good=200, max_strata=1000):
    """Verdicts from loops over documents, with the binomial tail summed term by term; ``rows``: id, language, counts."""
    share = lambda x, y: x / max(y, 1)
    failed = lambda m: m[0] < 20 or 100 * m[4] > 30 * m[0]
    bins = lambda m: [math.ceil(100 * x) for x in (min(share(m[2], m[0]), 1), share(m[4], m[0]), share(m[3], m[5]), share(m[7], m[6]), min(share(m[1], m[0]) / 50, 1))]
    marks = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            marks.setdefault(i, []).append(q == 1)
    seen = [(lang, bins(m), good) for i, lang, m in rows if not failed(m) for good in marks.get(i, [None])]
    goods = Counter(lang for lang, _, g in seen if g)
    own = sorted((x for x in goods if goods[x] >= least_good), key=lambda x: (-goods[x], x is not None, x or ""))[:max_strata]
    group = lambda lang: own.index(lang) if lang in own else -1
    tested = max(1, len({group(lang) for lang, _, g in seen if g}))
    cutoffs = {}
    for g in [*range(len(own)), -1]:
        mine = [x for x in seen if group(x[0]) == g]
        free, bad, good = ([b for _, b, m in mine if m is want] for want in (None, False, True))
        now, best = [100] * 5, (0.0, [100] * 5)
        tails = [[(sum(x[r] > cut for x in free), sum(x[r] > cut for x in bad)) for cut in range(100)] for r in range(5)]
        for step in range(1000):
            lift = 100.0 * (last_lift / 100.0) ** (step / 999)
            before = list(now)
            for r in range(5):
                for cut in range(now[r]):
                    u, b = tails[r][cut]
                    if b and b * max(len(free), 1) >= lift * u * max(len(bad), 1):
                        now[r] = cut
                        break
            if step and before == now:
                continue
            lost = sum(any(x[r] > now[r] for r in range(5)) for x in good)
            # A bound above the risk: so few rejections would be likelier than the level if the true share were the risk.
            likely = sum(math.comb(len(good), k) * risk**k * (1 - risk) ** (len(good) - k) for k in range(lost + 1))
            if not good or lost >= len(good) or likely > delta / tested:
                break
            gain = sum(any(x[r] > now[r] for r in range(5)) for x in bad) - weight * lost
            if gain > best[0]:
                best = (gain, list(now))
        cutoffs[g] = best[1]
    return {i: not failed(m) and not any(b > k for b, k in zip(bins(m), cutoffs[group(lang)], strict=True)) for i, lang, m in rows}, cutoffs


@pytest.mark.parametrize("most", [1000, 1])
def test_verdicts_equal_brute_force(spark, most) -> None:
    rnd = random.Random(17)
    rows, labels = [], []
    for i in range(2400):
        lang = rnd.choice(["en", "en", "de", None, "", "rare", "few"] if i % 3 else ["en"])
        bad = rnd.random() < 0.3
        w = [rnd.choice(["alpha", "beta", "Gamma", "delta", "EPSILON"]) + str(rnd.randrange(50)) for _ in range(rnd.choice([10, 30, 60]))]
        if bad:
            w = [x + rnd.choice(["###", "", "|"]) for x in w] if rnd.random() < 0.6 else [x.upper() for x in w]
        rows.append((i, " ".join(w) + ("\nsame line\nsame line" if rnd.random() < 0.1 else ""), lang, "s", 1, 1.0))
        if rnd.random() < 0.75:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    measured = [(i, lang, quality_rules.measure(t)) for i, t, lang, *_ in rows]
    want, cutoffs = brute_kept(measured, [*labels, labels[0]], max_strata=most)
    assert sum(x != [100] * 5 for x in cutoffs.values()) >= min(most, 2)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs, marks, max_strata=most).collect()}
    assert got == want
    assert {r["doc_id"] for r in quality_rules.drop_rejected(docs, marks, max_strata=most).select("doc_id").collect()} == {i for i, k in want.items() if k}


def test_rules_without_labels_set_no_cutoff(spark) -> None:
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.calibrate(quality_rules.features(frame(spark, ODD)), none) == quality_rules.Cutoffs({}, {})
    assert quality_rules.assess(spark.createDataFrame([], DOCS), none).count() == 0


# Quality classifier


def test_classifier_on_held_out_documents(spark) -> None:
    docs, labels = quality_corpus(spark, 3000)
    rated = quality_classifier.classify(docs, labels)
    odd = rated.where("doc_id % 2 = 1").select("kept", ((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 3)).alias("bad"))
    counts = {(r["bad"], r["kept"]): r["count"] for r in odd.groupBy("bad", "kept").count().collect()}
    assert counts.get((True, True), 0) <= 0.02 * sum(counts.values()) and counts.get((False, False), 0) == 0
    kept = quality_classifier.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == rated.where("kept").count()


def test_sparse_sites_shrink_to_what_is_above(spark) -> None:
    rows = [(i, "big", "x", -3.0, -9.0) for i in range(400)] + [(1000 + i, "bad", "x", 3.0, -9.0) for i in range(200)] + [(2000, "new", "x", 3.0, -9.0)]
    evidence = spark.createDataFrame(rows, "doc_id long, host string, path string, low double, toxic double")
    shift = {r["host"]: r["shift_low"] for r in quality_classifier.site_shifts(evidence, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert shift["big"] < 0 < shift["new"] < shift["bad"]


def sigmoid(z):
    return 0.5 * (1 + math.tanh(z / 2))


def brute_shifts(evidence, labels):
    """Shifts of each site by loops, from the formulas of the module's docstring."""
    known = {}
    for i, q, t in labels:
        if None not in (i, q, t):
            low, toxic = known.get(i, (0, 0))
            known[i] = (max(low, int(q != 1)), max(toxic, int(t == 1)))
    sums = {}
    for i, host, path, *logits in evidence:
        for level in ((host,), (host, path)):
            s = sums.setdefault(level, [0, 0.0, 0.0])
            s[0] += 1
            for k in range(2):
                s[1 + k] += known[i][k] if i in known else sigmoid(logits[k])
    clip, logit = lambda p: min(max(p, 1e-4), 1 - 1e-4), lambda p: math.log(p / (1 - p))
    out = {x: [] for x in sums if len(x) == 2}
    for k in (1, 2):
        rate, strength = clip(sum(s[k] for x, s in sums.items() if len(x) == 1) / len(evidence)), {}
        for level in (1, 2):
            sites = [s for x, s in sums.items() if len(x) == level]
            n = sum(s[0] for s in sites)
            between = max(sum(s[0] * (s[k] / s[0] - rate) ** 2 for s in sites) / n - rate * (1 - rate) * len(sites) / n, 1e-6)
            strength[level] = 50.0 if len(sites) < 2 else min(max(rate * (1 - rate) / between - 1, 2.0), 1e4)
        for x, shifts in out.items():
            h, p = sums[x[:1]], sums[x]
            host = (h[k] + strength[1] * rate) / (h[0] + strength[1])
            shifts.append(logit(clip((p[k] + strength[2] * host) / (p[0] + strength[2]))) - logit(rate))
    return out


def test_sites_turn_verdicts_as_brute_force_does(spark) -> None:
    rnd = random.Random(23)
    rows, labels = [], []
    rates = {("good", "x"): 0.05, ("good", None): 0.1, ("", "x"): 0.9, (None, "x"): 0.2, ("bad", "x"): 0.85, ("bad", "y"): 0.6, ("new", "y"): 0.5}
    sites = list(rates)
    for i in range(1500):
        site = rnd.choice(sites[:-1]) if i else sites[-1]
        bad = rnd.random() < rates[site]
        w = [rnd.choice("alpha beta gamma delta".split()) + str(rnd.randrange(90)) for _ in range(40)]
        mark = "##" if bad and rnd.random() < 0.5 else ""
        rows.append((i, " ".join(x + mark * (k % 3 == 0) for k, x in enumerate(w)), site[1], site[0], 1, 1.0))
        if rnd.random() < 0.6:
            labels.append((i, int(not bad), int(rnd.random() < 0.02)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame([*labels, (labels[0][0], 0, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, marks)
    evidence = [(i, s, p, *model.logits(t)) for i, t, p, s, *_ in rows]
    shifts = brute_shifts(evidence, [*labels, (labels[0][0], 0, 1)])
    score = {i: math.prod(1 - sigmoid(z + d) for z, d in zip(zs, shifts[s, p], strict=True)) for i, s, p, *zs in evidence}
    turned = sum((score[i] >= 0.5) != (math.prod(1 - sigmoid(z) for z in zs) >= 0.5) for i, _, _, *zs in evidence)
    assert turned > 50
    for limit in (100_000, 0):
        got = {r["doc_id"]: r for r in quality_classifier.classify(docs, marks, broadcast_sites=limit).collect()}
        assert {i: r["score"] for i, r in got.items()} == pytest.approx(score, abs=1e-9)
        assert {i: r["kept"] for i, r in got.items()} == {i: x >= 0.5 for i, x in score.items()}
        kept = quality_classifier.drop_rejected(docs, marks, broadcast_sites=limit)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in score.items() if x >= 0.5}


def test_classifier_handles_odd_rows(spark) -> None:
    docs, labels = frame(spark, ODD, ids=[*range(len(ODD) - 2), None, 1]), spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, labels).count() == len(ODD)
    assert quality_classifier.classify(docs, labels.limit(0)).where("score IS NULL").count() == 0
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


# Words


def test_word_hashes_of_bytes(monkeypatch) -> None:
    texts = [None, "", " \t", "a bb  ccc", "A BB\nccc", "é É", "x" * 40, "a " + "z" * 30 + " b", "tail ", "\x0b lead", "a\xa0b"]
    for segment in (5, 1 << 17):
        monkeypatch.setattr(hashed, "SEGMENT", segment)
        hashes, first = hashed.of_column(pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts)))
        own = {}
        for i, t in enumerate(texts):
            wanted = (t or "").encode().lower().split()
            assert first[i + 1] - first[i] == len(wanted)
            for w, h in zip(wanted, hashes[first[i] : first[i + 1]].tolist(), strict=True):
                assert own.setdefault(w, h) == h
            assert (hashed.of_text(t) == hashes[first[i] : first[i + 1]]).all()
        assert len(set(own.values())) == len(own)
    assert [x.tolist() for x in hashed.of_column(pa.array([], pa.string()))] == [[], [0]]


# Language model


def test_elias_fano_finds_what_is_there() -> None:
    rng = np.random.default_rng(4)
    for n, top in ((0, 9), (1, 1), (70, 60), (3000, 10**7), (2000, 2**63)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = EliasFano.build(values)
        assert n == 0 or (coded.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 50).astype(np.uint64)])
        for x, i in zip(asked.tolist(), coded.find(asked).tolist(), strict=True):
            assert values[i] == x if i >= 0 else x not in set(values.tolist())


def test_elias_fano_pairs_and_long_buckets() -> None:
    rng = np.random.default_rng(15)
    dense = np.concatenate([rng.choice(4000, 1500, replace=False), [2**40], 2**41 + rng.choice(9000, 3000, replace=False)])
    for values in (np.sort(dense), np.arange(130) * 999_983, np.array([7]), np.repeat([3, 900], 100)):
        values = values.astype(np.uint64)
        coded, i = EliasFano.build(values), np.arange(len(values))
        here, after = coded.pair(i)
        assert (here == values).all() and (after == np.append(values[1:], values[-1])).all()
        asked = np.concatenate([values, values + np.uint64(1), np.maximum(values, np.uint64(1)) - np.uint64(1)])
        assert ((coded.find(asked) >= 0) == np.isin(asked, values)).all()
        first, last = np.full(len(values), len(values) // 3), np.full(len(values), 2 * len(values) // 3)
        found = coded.find(values, first, last)
        assert ((found >= 0) == np.isin(values, values[len(values) // 3 : 2 * len(values) // 3])).all() and (values[found[found >= 0]] == values[found >= 0]).all()


@pytest.mark.parametrize(("shard_words", "least"), [(1 << 18, 1), (1 << 18, 2), (7, 1), (7, 2)])
def test_scores_equal_a_dictionary_model(spark, shard_words, least) -> None:
    rnd = random.Random(8)
    texts = [*ODD, *(" ".join(rnd.choice("a b c D e f g h i j k".split()) for _ in range(rnd.randrange(30))) for _ in range(80))]
    train = texts[:70]
    model = lm.train(frame(spark, train), shard_words=shard_words, min_count=least)
    got = {r["doc_id"]: r for r in lm.score(frame(spark, texts), model).collect()}
    cut = lambda t: [*(t or "").encode().lower().split(), b" "]
    u, b, t3 = Counter(), Counter(), Counter()
    for t in map(cut, train):
        u.update(t)
        b.update(zip(t, t[1:], strict=False))
        t3.update(zip(t, t[1:], t[2:], strict=False))
    n, v = sum(u.values()), len(u)
    assert (model.tokens, model.words) == (n, v)
    b, t3 = ({k: c for k, c in x.items() if c >= least} for x in (b, t3))
    left2, left3 = Counter(), Counter()
    for k, c in b.items():
        left2[k[0]] += (c - 0.75) / u[k[0]]
    for k, c in t3.items():
        left3[k[:2]] += (c - 0.75) / b[k[:2]]
    for i, t in enumerate(map(cut, texts)):
        score = 0.0
        for k, x in enumerate(t):
            p = (u[x] + 1) / (n + v + 1)
            if k and t[k - 1] in left2:
                p = (1 - left2[t[k - 1]]) * p + (b.get((t[k - 1], x), 0.75) - 0.75) / u[t[k - 1]]
            if k > 1 and (t[k - 2], t[k - 1]) in left3:
                y = (t[k - 2], t[k - 1])
                p = (1 - left3[y]) * p + (t3.get((*y, x), 0.75) - 0.75) / b[y]
            score += math.log10(p)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((u[x] + 1) / (n + v + 1)) for x in t))
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(t), sum(x in u for x in t))
        assert got[i]["score"] == pytest.approx(score, abs=0.05 * len(t))


def test_the_registered_query_keeps_ngrams_that_occur_once(spark, tmp_path) -> None:
    rnd = random.Random(9)
    texts = [*ODD, *(" ".join(rnd.choice("a b c D e f g h i j k l m n o p".split()) for _ in range(rnd.randrange(20))) for _ in range(40))]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_language_model(spark, str(tmp_path)).collect()
    cut = [[*(t or "").encode().lower().split(), b" "] for t in texts]
    train = [cut[r["doc_id"]] for r in got if not r["held_out"]]
    assert 0 < len(train) < len(texts) == len(got)
    u, b, t3 = (Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in (1, 2, 3))
    n, v = sum(u.values()), len(u)
    assert 1 in b.values() and 1 in t3.values()
    left2, left3 = Counter(), Counter()
    for grams, shorter, left in ((b, u, left2), (t3, b, left3)):
        for k, c in grams.items():
            left[k[:-1]] += (c - 0.75) / shorter[k[:-1]]
    for r in got:
        score, t = 0.0, cut[r["doc_id"]]
        for i in range(len(t)):
            p = (u[(t[i],)] + 1) / (n + v + 1)
            for k, grams, shorter, left in ((1, b, u, left2), (2, t3, b, left3)):
                if i >= k and (y := tuple(t[i - k : i])) in left:
                    p = (1 - left[y]) * p + max(grams[(*y, t[i])] - 0.75, 0) / shorter[y]
            score += math.log10(p)
        assert r["score"] == pytest.approx(score, abs=0.02 * len(t))


@pytest.mark.parametrize("least", [1, 2])
def test_no_shard_grows_with_a_word_or_context(spark, least) -> None:
    rnd = random.Random(12)
    texts = [*ODD, *(" ".join(rnd.choice(["the"] * 20 + [f"w{i}" for i in range(60)]) for _ in range(rnd.randrange(60))) for _ in range(60))]
    docs = frame(spark, texts)
    whole, small = (lm.train(docs, min_count=least, group_tokens=n) for n in (10**9, 200))
    sizes = [[0 if f is None else len(lm.Files(f).get("codes")) for f in x] for x in small.folders[1:]]
    assert [len(x) for x in whole.folders] == [1, 1, 1] and max(small.cuts[0].ways) > 1 < max(small.cuts[1].ways)
    assert max(map(max, sizes)) <= 200 and [sum(x) for x in sizes] == [len(lm.Files(x[0]).get("codes")) for x in whole.folders[1:]]
    asked = frame(spark, [*texts, "the w1 the unknown w2 the the", "the " * 50])
    a, b = ({r["doc_id"]: r for r in lm.score(asked, x).collect()} for x in (whole, small))
    for i, r in a.items():
        assert b[i]["score"] == pytest.approx(r["score"], abs=0.02 * r["n_tokens"]) and b[i]["n_known"] == r["n_known"]


def test_a_worker_keeps_few_files_open(spark, monkeypatch) -> None:
    rnd = random.Random(13)
    texts = [" ".join(f"w{rnd.randrange(200)}" for _ in range(80)) for _ in range(60)]
    model = lm.train(frame(spark, texts), group_tokens=100, shard_words=20)
    assert all(len(os.listdir(base.removeprefix("file:"))) == 1 for level in model.folders for base in level if base)
    monkeypatch.setattr(lm, "MAPPED", 8)
    tokens, starts = lm.token_hashes(pa.array(texts))
    few, many = model.walk(tokens, starts, 3)[2], len([f for level in model.folders for f in level if f])
    assert many > 50 and len(model._open) == 8
    files = [os.readlink(x.path) for x in os.scandir("/proc/self/fd") if os.path.islink(x.path)]
    assert len([x for x in files if x.endswith(".npy")]) <= 8
    monkeypatch.setattr(lm, "MAPPED", 10**6)
    assert (model.walk(tokens, starts, 3)[2] == few).all() and len(model._open) == many


def test_an_ngram_that_repeats_and_a_context_of_many_words_cost_one_look_up(spark, monkeypatch) -> None:
    texts = [f"the w{i % 500} is" for i in range(2000)]
    model = lm.train(frame(spark, texts))
    selected, select = [], elias_fano._select_in_word
    monkeypatch.setattr(elias_fano, "_select_in_word", lambda words, rank: selected.append(len(rank)) or select(words, rank))
    tokens, starts = lm.token_hashes(pa.array(texts))
    model.walk(tokens, starts, 3)
    # 503 words, 1,001 bigrams, 1,500 trigrams, the contexts of which are 502 words and 1,000 bigrams
    assert sum(selected) < 8000


def test_a_model_of_many_shards_is_asked_in_larger_windows() -> None:
    sizes = [lm._together(lm.Model(1, 1, [0], [[None] * n] * 3)) for n in (0, 1, 200, 10**6)]
    assert sizes == [1_000_000, 1_000_000, 1_800_000, 4_000_000]
    texts = pa.RecordBatch.from_arrays([pa.array([f"a b{i} c" for i in range(1000)])], ["text"])
    for size in (1, 1500, 10**6):
        windows = list(lm._windows(iter([texts]), size))
        assert sum(len(x) for x, _ in windows) == 4000 and sum(len(x) for _, x in windows) == 1000
        assert len(windows) == {1: 4, 1500: 2, 10**6: 1}[size] and all((np.diff(x) == 4).all() and x[0] == 0 for _, x in windows)


def test_distinct_keys_with_their_places() -> None:
    rng = np.random.default_rng(14)
    for keys, bits in (
        (rng.integers(0, 9, 3000), 4),
        (rng.integers(0, 2**63, 3000), 64),
        (rng.integers(0, 50, 3000) + (5 << 60), 64),  # differ only in bits that places take
        (rng.integers(0, 2**40, 1), 40),
        (np.zeros(0, np.int64), 1),
    ):
        distinct, which, order, begins = lm.distinct_of(keys.astype(np.uint64), bits)
        expected = np.unique(keys.astype(np.uint64), return_inverse=True, return_counts=True)
        assert all((a == b).all() for a, b in zip((distinct, which, np.diff(begins, append=len(keys))), expected, strict=True))
        assert (keys[order] == np.sort(keys)).all()


def test_an_empty_training_set(spark) -> None:
    model = lm.train(spark.createDataFrame([], DOCS))
    assert [r["base_score"] for r in lm.score(frame(spark, ["a b", None]), model).collect()] == [0.0, 0.0]


# HTML


def test_main_text() -> None:
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
    <header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept all of them now.</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text&nbsp;here.<p>Short.</p><div class="ad">Buy this thing now, it is cheap.</div><ul><li>one</li><li>two</li></ul></article>
    <aside><p>Related: a long sentence that looks like text, but is not.</p></aside><div id="comments"><p>I liked this very much, thank you for it.</p></div>
    <form>Sign up <input></form><footer>&copy; 2020 Someone</footer><!-- <p>no</p>"""
    assert html_extraction.extract(page) == "Title & more\nFirst bold text here.\nShort.\none\ntwo"
    assert html_extraction.extract(None) == html_extraction.extract("<p") == html_extraction.extract("") == ""
    layout = '<div class="page with-sidebar"><article class="post"><p>The text of the article, long enough to be it.</p></article><article class="comment"><p>What a reader wrote about all of it, at length.</p></article></div>'
    assert html_extraction.extract(layout) == "The text of the article, long enough to be it."
    plain = "<div><p>A page without an article, but with a long paragraph of text in it.</p><p>Ok.</p><p>And another paragraph, long enough to be text as well.</p></div><div><a href=a>Home</a> <a href=b>About</a></div>"
    assert html_extraction.extract(plain).count("\n") == 2


def test_linked_lists_of_an_article_are_kept() -> None:
    links = [f"A book on tea, no. {i}" for i in range(4)]
    items = "".join(f"<li><a href=b{i}>{x}</a></li>" for i, x in enumerate(links))
    text = "<h1>Tea</h1><p>A paragraph on tea that is long enough to be text.</p><h2>References</h2>"
    for tag in ("article", "main"):
        kept = html_extraction.extract(f"<body><nav><ul>{items}</ul></nav><{tag}>{text}<ul>{items}</ul><p>The end.</p><ul class=menu>{items}</ul></{tag}><ul>{items}</ul>")
        assert kept.split("\n") == ["Tea", "A paragraph on tea that is long enough to be text.", "References", *links, "The end."]


def test_markup_does_not_swallow_text() -> None:
    whole = "One, a paragraph of text.\nTwo two.\nThree."
    page = "<article><p>One, a paragraph of text.</p>{}<p>Two two.</p><p>Three.</p></article>"
    for x in ('<svg viewBox="0 0 1 1"/>', "<math />", "<button>", "<select>", "<noscript>", "<object data='a>b'>", "<iframe src=x>", "<template>", "<svg>", "</button>"):
        assert html_extraction.extract(page.format(x)) == whole, x
        assert html_extraction.extract(page.format(f"<div>{x}</div><div><button>Buy</button></div>")) == whole, x
    for x in ("<svg><g><path d=x/><text>Ax</text></g></svg>", "<svg><svg/><text>Ax</text></svg>", "<button>Buy <b>it</button>", "<noscript><p>On!</p></noscript>", "<select><option>a<option>b</select>", "<object><object>in</object>out</object>"):
        assert html_extraction.extract(page.format(x)) == whole, x
    for x in ('title="The hidden cost of tea"', "data-x='a hidden b'", 'title="aria-hidden=true, display:none"', "data-hidden=1"):
        assert html_extraction.extract(page.format("").replace("<article", f"<article {x}")) == whole, x
    for x in ("hidden", 'class="a" hidden=""', "HIDDEN=hidden", "style='color:red; display: none'", "aria-hidden=true", 'aria-hidden="true"'):
        assert html_extraction.extract(page.format(f"<div {x}><p>Not seen by readers, though long enough.</p></div>")) == whole, x


def test_the_cut_is_of_least_cost() -> None:
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        gain = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 1.5)) for a in range(n) for b in range(a) if rnd.random() < 0.5]

        def cost(label, gain=gain, edges=edges):
            return sum(-g if g < 0 and x else g if g > 0 and not x else 0 for g, x in zip(gain, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

        assert cost(html_extraction.minimum_cut(gain, edges)) == pytest.approx(min(map(cost, product([True, False], repeat=n))))


def test_pages_keep_their_rows(spark) -> None:
    pages = spark.createDataFrame([(1, "u", "<p>Text of a page that is long enough to be content of it.</p>", "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = html_extraction.extract_pages(pages).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) > 50
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
