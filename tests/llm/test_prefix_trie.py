"""The trie of conversations against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quern.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def own_turns(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append(((turn is not None, turn or 0, digest(role, text)[:16]), role, text))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in found.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        remainder = c % 100 if c >= 0 else -(-c % 100)
        out[c] = turns.get(c - remainder, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    rows = set()
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.add((min(own), len(path), parent, len(own), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def invented(seed, n):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "no conversation"), (900, None, "user", "first"), (900, 1, None, None), (900, 1, None, None), (901, 1, "", "tie"), (901, 1, "x", "tie"), (-7, 0, "user", "a"), (-100, 0, "user", "b"), (-203, 3, "s", "")]
    for c in rng.sample(range(1000), n):
        rows += [(c, k, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi", "é" * 5, ""])) for k in range(rng.randint(1, 8))]
    rows += [(1234, k, "user", "again") for k in range(70)]  # deep
    rows += [(c, k, "user", "hi") for c in range(5000, 5030) for k in range(3)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_tries(spark, seed, monkeypatch):
    rows = invented(seed, 300)
    turns = own_turns(rows)
    monkeypatch.setattr(prefix_trie, "ID_CHARS", 60)
    for got, expected in ((prefix_trie.conversation_trie(frame(spark, rows)), plain_trie(turns)), (prefix_trie.rebuilt_trie(frame(spark, rows)), plain_trie(rebuilt(turns)))):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_conversations_that_lose_all_turns(spark):
    convs = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6][:7]
    rows = [(c, 0, "user", f"own {c}") for c in convs]  # no conversation 0 to take turns from
    got = [tuple(r) for r in prefix_trie.rebuilt_trie(frame(spark, rows)).collect()]
    ids = hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()
    assert got == [(min(convs), 0, None, len(convs), 0, 1, 0, ids)]


def test_many_ends_at_one_node(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    got = {r["depth"]: r for r in prefix_trie.conversation_trie(rows).collect()}
    ids = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert got[1]["ends_sha256"] == ids and got[1]["n_convs"] == n and got[1]["saved_tokens"] == 4 * (n - 1) == got[0]["saved_tokens"]


def test_rounds_are_logarithmic(spark, monkeypatch):
    written = []
    plain = prefix_trie.checkpointed
    monkeypatch.setattr(prefix_trie, "checkpointed", lambda df: written.append(1) or plain(df))
    rows = [(1, k, "user", str(k)) for k in range(200)]
    got = prefix_trie.conversation_trie(frame(spark, rows)).collect()
    assert len(got) == 201 and len(written) <= 4 + 8


def test_empty_table(spark):
    assert prefix_trie.rebuilt_trie(frame(spark, [])).collect() == []
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
