"""The pipeline's near-duplicate stage by SimHash alone: copies within three bits are candidates without any sketch."""

import random

import pytest

pytest.importorskip("quern.llm.simhash")

from quern.llm import simhash  # noqa: E402
from tests.llm.test_operators import frame, jaccard, shingles  # noqa: E402


def test_simhash_finds_candidates(spark, monkeypatch):
    rng, texts = random.Random(8), []
    for k in range(60):  # a text and its copy with one word more
        words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words, f"end{k}"])]
    texts += ["a line of five words " * 50 + f"then {k} others of its own kind here, {k}" for k in range(3)]  # strangers but for a repeated line
    prints = [simhash.set_fingerprint(t, 5) for t in texts]
    near = [i for i in range(0, 120, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= simhash.DISTANCE]
    assert len(near) > 40 and all(jaccard(shingles(texts[i]), shingles(texts[i + 1])) >= 0.8 for i in near)
    monkeypatch.setattr(simhash, "sketch_closeness", lambda similarity: lambda rows: lambda i, later: later < 0)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, texts)).collect()}
    assert all(got[i + 1] == i for i in near)
    assert all(got[i] in (i, i - 1) for i in got)  # strangers stay apart
