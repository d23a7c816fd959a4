from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ringview.llm import packing, tokenfile
from ringview.llm.tokens import Encoder, default_tokenizer

DOCS = "doc_id long, text string, n int"
ODD = ["", " ", "  \n", "a  b", "it's\n\nhere", "<|endoftext|> x", "\x01 y \x02", "é, è.\nÇa va", "x" * 5000, "no break 　wide", "word " * 3000, "😀 👍🏽 ok", "a\tb\r\nc"]


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(truth) -> None:
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", "word.", "word.\nNext", "é", "ǅ", "12", "'s", "don't", "-", "\x01", "\x02", "\x85", " ", "<|endoftext|>", "日本", "!?,", "x,\ny"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    got = Encoder.of(default_tokenizer()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [truth(t) for t in texts]


class Counted:
    """A library object that counts the texts it gets."""

    def __init__(self, inner) -> None:
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **more)

    def tokenize(self, word):
        self.texts += 1
        return self.inner.tokenize(word)


def test_the_library_gets_each_short_chunk_once(truth) -> None:
    encoder = Encoder(default_tokenizer())
    encoder._tokenizer, encoder._model = counted = Counted(encoder._tokenizer), Counted(encoder._model)
    texts = [f"{a} {b}{mark}\n{b}\n\n\n{a}{mark}" for a, b in zip("abcdefgh", "stuvwxyz") for mark in ("", ".", "!!", "'", "$$$")]
    ids = [np.array(truth(t), "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == ids and sum(c.texts for c in counted) <= 4 * 8 + 5
    before = sum(c.texts for c in counted)
    assert encoder.encode(texts) == ids and sum(c.texts for c in counted) == before
    long = ["x" * 5000 + " y"]
    assert encoder.encode(long) == encoder.encode(long) == [np.array(truth(long[0]), "<u4").tobytes()]
    assert sum(c.texts for c in counted) == before + 2  # the long chunk is not kept


@pytest.mark.parametrize("kept, size, factor", [(1_500_000, 500_000, None), (40, 30, None), (1_500_000, 500_000, 0)])
def test_ids_of_odd_characters_and_small_bounds(monkeypatch, truth, kept, size, factor) -> None:
    monkeypatch.setattr("ringview.llm.tokens.MAX_KEPT", kept)
    monkeypatch.setattr("ringview.llm.tokens.MAX_TEXT", size)
    encoder = Encoder(default_tokenizer())
    if factor is not None:
        encoder._factors[:] = factor  # all chunks share a hash
    codes = [*range(0x250), *range(0x1670, 0x1690), 0x180E, *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0xFEFF]
    texts = [f"a{c} b{c}\nc{c},{c}{c} {c}'s 1 2  3.{c}" for c in map(chr, codes)] + ODD
    for part in (texts[:300], texts[300:], texts):
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(part)] == [truth(t) for t in part]
    assert len(encoder._met) == encoder._bytes.count == encoder._ids.count == len(encoder._hashes) <= kept


def rows(spark):
    texts = [*ODD, None, "same text here", "same text here"]
    return spark.createDataFrame([(i if i != 5 else None, t, 7) for i, t in enumerate(texts)] + [(3, "a  b", 7), (3, "other", 7)], DOCS)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_covers_every_id_once(spark, truth, capacity) -> None:
    docs = rows(spark)
    pieces = packing.pack(packing.encode_documents(docs, end_id=1), capacity=capacity, group_tokens=capacity * 8).collect()
    expected = sorted(zlib.crc32(np.array([*truth(r["text"]), 1], "<u4").tobytes()) for r in docs.collect())
    by_row = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and 0 < p["length"] <= capacity
        by_row[p["doc_id"], p["doc_tokens"]].append(p)
    whole = []
    for (_, n), own in by_row.items():
        copies = sum(p["length"] for p in own) // n
        assert copies * n == sum(p["length"] for p in own)
        if copies == 1:
            own.sort(key=lambda p: p["start"])
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
            whole.append(zlib.crc32(b"".join(bytes(p["ids"]) for p in own)))
    assert set(whole) <= set(expected) and len(whole) >= len(expected) - 4
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= capacity
    total = sum(p["length"] for p in pieces)
    groups = -(-total // (capacity * 8)) + len({p["sequence_id"] >> 40 for p in pieces})
    assert len(sequences) * capacity - total <= groups * capacity


def test_one_pass_packs_as_two(spark) -> None:
    docs = rows(spark).repartition(2)
    one = packing.pack_documents(docs, end_id=1, capacity=32, group_tokens=200)
    two = packing.pack(packing.encode_documents(docs, end_id=1), capacity=32, group_tokens=200)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and "Exchange" not in one._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    odd = docs.selectExpr("doc_id AS sequence_id", "text AS ids", "7 AS offset")
    assert packing.pack_documents(odd, key="sequence_id", text="ids").count() >= docs.count()


def test_the_lowest_cost_takes_the_next(spark) -> None:
    own = packing.balance(np.array([10, 9, 6, 5, 1, 1]), 16, 1.0, 1.0)
    assert own[0] == [(0, 10, 0, 0)] and own[1] == [(0, 9, 1, 0)]
    assert own[2] == [(0, 6, 1, 9)] and own[3] == [(0, 5, 0, 10)]


def test_packing_nothing(spark) -> None:
    assert packing.pack(packing.encode_documents(spark.createDataFrame([], DOCS))).count() == 0


def test_perfect_hash_is_minimal() -> None:
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    table = tokenfile.PerfectHash.build(keys)
    again, _ = tokenfile.PerfectHash.from_bytes(memoryview(table.to_bytes()))
    assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))


def test_shards_round_trip(spark, truth) -> None:
    docs = rows(spark)
    manifest = tokenfile.write_shards(docs, docs_per_shard=4)
    got = tokenfile.read_shards(manifest).collect()
    # null first, then ascending ids; rows of one id in order of their texts
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    at, expected = 0, []
    for r in order:
        ids = [*truth(r["text"]), 0]
        expected.append((r["doc_id"], at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(((g["doc_id"], g["start"], g["n_tokens"], bytes(g["ids"])) for g in got), key=lambda x: x[1]) == expected


def test_shards_hold_long_texts_whole(spark, truth) -> None:
    texts = ["a1 été, “x” \n\n y.  " * 60_000, "é" * 5_000, "x<|endoftext|> y " * 500, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokenfile.read_shards(tokenfile.write_shards(docs, docs_per_shard=2)).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [[*truth(t), 0] for t in texts]


def test_the_least_key_is_not_null(spark) -> None:
    docs = spark.createDataFrame([(-(2**63), "least", "a", 1), (None, "none", "b", 2), (None, None, "c", 3), (-(2**63), "more", "d", 4)], "doc_id long, text string, base string, n_tokens int")
    for per in (1, 2, 100):
        got = tokenfile.read_shards(tokenfile.write_shards(docs, docs_per_shard=per)).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == [None, None, -(2**63), -(2**63)] and len({bytes(r["ids"]) for r in got}) == 4


def test_a_key_that_is_absent_is_not_found(spark) -> None:
    base = tokenfile.write_shards(spark.createDataFrame([(1, "x", 0), (9, "y z", 0)], DOCS), docs_per_shard=10).first()["base"]
    shard = tokenfile.Shard(base, 2)
    found = list(shard.get(np.array([9, 2, 1, 10**12])))
    assert [len(x) for x in found] == [1, 0, 1, 0]
    shard.close()


def test_no_shards_of_an_empty_table(spark) -> None:
    assert tokenfile.read_shards(tokenfile.write_shards(spark.createDataFrame([], DOCS))).count() == 0
