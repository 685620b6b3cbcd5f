"""Spelling variants against a plain version."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import spelling
from tests.llm.test_operators import AWKWARD, empty, frame


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    total = Counter()
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 5 and k >= 3}
    close = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            close[a].add(b)
            close[b].add(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n}


def invented(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéÀ×ÿz") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    texts = []
    for _ in range(150):
        own = []
        for _ in range(30):
            w = words[int(len(words) * rng.random() ** 3)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzé") + w[k:], w[:k] + rng.choice("abzé") + w[k + 1 :]])
            own.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append(rng.choice([" ", "1", "\n", "Ā"]).join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    texts = AWKWARD + invented(seed) + ["x" * 20_000 + " " + "x" * 19_999 + " " + "x" * 19_999 + "y"] * 3 + ["abcde abcdf abcde", "kettles " * 5 + "kettled " * 2 + "kettleda"] * 4
    docs = frame(spark, texts).unionByName(frame(spark, texts).limit(12))
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:12])] + [(None, "abcde abcdx " * 5)]
    docs = docs.unionByName(spark.createDataFrame([(*rows[-1], 1, "f", [1], -1.0)], docs.schema))
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    expected = plain_variants(rows)
    assert len(got) == len(expected) and set(got) == expected
    assert sum(r[1] is not None and r[1] != r[2] for r in got) > 0


def test_every_exchange_of_one_letter(spark):
    """A clique: all words of one pattern are near one another; anagrams that are not near stay apart."""
    words = [f"abc{c}de" for c in "abcdefghijklmnopqrstuvwxyzàéÿ"] + ["edcbaa", "aabcde", "abcde", "abcdee", "bacde"]
    rows = [(w, k + 3) for k, w in enumerate(words)]
    got = {(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    pairs = spelling.near_words(spark.createDataFrame(rows, "word string, n long")).count()
    expected = {(a, b) for a in words for b in words if near(a, b)}
    assert got == expected and pairs == len(expected)


def test_long_chains_of_forms(spark):
    chain = [("w%03d" % i, "w%03d" % (i + 1) if i < 40 else None) for i in range(41)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w040" for w, _ in chain}


def test_empty_table(spark):
    assert spelling.variants(empty(spark, "doc_id long, text string")).collect() == []
