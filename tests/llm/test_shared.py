"""The helpers that several operators share."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import _spark, bpe
from quern.llm.components import components
from quern.llm.fm_index import Bits, FmIndex

import numpy as np


def test_membership_loses_no_row(spark):
    keys = [0, 1, 63, 64, -1, -(2**63), 2**63 - 1, _spark.MEMBER_BITS, 12345678901, None]
    others = [2, 65, -2, 99]
    known = _spark.members(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    rows = spark.createDataFrame([(k,) for k in keys + others], "k long")
    may = {r["k"] for r in _spark.maybe_members(rows, "k", known).collect()}
    rest = {r["k"] for r in _spark.maybe_members(rows, "k", known, "left_anti").collect()}
    assert set(keys) - {None} <= may and not may & set(others)
    assert rest == {*others, None}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(1005, 1005)]
    pairs = chain + star + [(b, a) for a, b in chain[:50]]
    random.Random(1).shuffle(pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == 301 + 200
    assert all(r["component"] == (0 if r["node"] < 1000 else 1000) for r in got)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_select_is_the_inverse_of_rank():
    rng = np.random.default_rng(3)
    for share in (0, 0.01, 0.5, 1):
        for n in (1, 63, 64, 65, 400):
            bits = rng.random(n) < share
            ones, packed = np.flatnonzero(bits), Bits(bits)
            assert packed.select(np.arange(len(ones))).tolist() == ones.tolist()
            assert packed.rank(np.arange(n)).tolist() == [int(bits[:i].sum()) for i in range(n)]


def test_index_finds_the_first_owner_of_every_window():
    rng = np.random.default_rng(0)
    for w in (1, 2, 3, 5, 6, 50):
        for _ in range(40):
            kinds, longest = rng.choice([1, 2, 4]), 12 if w < 50 else 120
            texts = [rng.integers(0, kinds, rng.integers(1, longest)) for _ in range(rng.integers(1, 8))]
            owners = rng.integers(-5, 100, len(texts))
            index, first = FmIndex(texts, owners, w), {}
            for o, x in zip(owners.tolist(), texts):
                for i in range(len(x) - w + 1):
                    first[tuple(x[i : i + w])] = min(first.get(tuple(x[i : i + w]), 1000), o)
            # the sequences themselves, unlike ones, unknown words, and parts of two sequences together
            others = [rng.integers(-1, kinds + 2, rng.integers(0, 2 * longest)) for _ in range(4)] + [np.r_[texts[0], texts[-1][:60], [9], texts[0]]]
            for x, found in zip([*texts, *others], index.first_owners([*texts, *others])):
                assert [index.names[f] if f >= 0 else None for f in found] == [first.get(tuple(x[i : i + w])) for i in range(max(0, len(x) - w + 1))]


def test_index_is_smaller_than_its_suffix_order():
    texts = [np.random.default_rng(k).integers(0, 1000, 70) for k in range(200)] * 3
    index = FmIndex(texts, np.arange(len(texts)), 50)
    assert index.nbytes < 4 * index.n
    assert not any(isinstance(v, np.ndarray) and len(v) >= index.n for v in vars(index).values())


def test_remembered_chunks_are_bounded():
    known = bpe.Remembered(entries=3, size=10_000)
    known.learn(["a", "b" * 2000, "c"], range(3))
    assert known["b" * 2000] == 1
    known.held = 0
    known.settle()
    assert dict(known) == {"a": 0, "c": 2} and not known.long
    known.learn(list("defg"), [0] * 4)
    known.settle()
    assert not known and not known.held
    known.learn(["x" * 1000, "y" * 1000], [1, 1])
    known.settle()
    assert not known  # by size


def test_texts_without_spaces_are_encoded_alike_when_forgotten(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec = bpe.ByteCodec(open(path, "rb").read())
    codec.known = bpe.Remembered(entries=2, size=100)
    library = Tokenizer.from_file(path)
    texts = ["中文" * 3000, "one two", "a" * 5000, "one two", "<|endoftext|>" * 3, ""]
    for block in (texts[:2], texts[2:], texts):
        assert codec.encode(block) == [library.encode(t, add_special_tokens=False).ids for t in block]
        assert len(codec.known) <= 2


def test_forgotten_checkpoints_are_deleted(spark):
    from pathlib import Path

    before = set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()) if spark.sparkContext.getCheckpointDir() else set()
    kept, gone = _spark.checkpointed(spark.range(5)), _spark.checkpointed(spark.range(7))
    _spark.forget(gone)
    assert kept.count() == 5
    assert len(set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()) - before) == 1
