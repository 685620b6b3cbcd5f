"""The decision of the secret scan, run by run, against a plain Benjamini-Hochberg procedure."""

import math
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import randomness, secret_scan


def plain_p(encoding, n, h):
    """Share of simulated text-like runs that look as random; a power law through the tail's edge below it."""
    text = [float(x) for x in randomness.simulated(encoding, n)[1]]
    m = max(2, int(randomness.TAIL * len(text)))
    share = (1 + sum(x <= h for x in text)) / (len(text) + 1)
    if h >= text[m - 1]:
        return share
    hill = sum(math.log(text[m - 1]) - math.log(max(x, 1e-9)) for x in text[: m - 1]) / (m - 1)
    return min(randomness.TAIL * (max(h, 1e-9) / text[m - 1]) ** (1 / max(hill, 1e-3)), share)


def plain_decision(runs):
    """runs: bins of one class. Which of them are rejected, one after the other by p."""
    kind, bins = runs
    encoding, n = kind // 64, randomness.lengths()[kind % 64]
    p_of = {b: plain_p(encoding, n, (b + 1) / secret_scan.BINS) for b in set(bins)}
    ordered = sorted(bins, key=lambda b: (p_of[b], b))
    rejected = 0
    for k, b in enumerate(ordered, 1):
        if p_of[b] <= secret_scan.FALSE_DISCOVERIES * k / len(ordered):
            rejected = k
    uniform = randomness.simulated(encoding, n)[0]
    reach = int(float(uniform[min(len(uniform) - 1, math.ceil((1 - secret_scan.LOST) * len(uniform)))]) * secret_scan.BINS)
    return Counter(b for b in ordered[:rejected] if b <= reach and b < secret_scan.LAST_BIN)


@pytest.mark.parametrize("seed", range(6))
def test_discoveries_equal_a_plain_procedure(seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(4):
        kind = rng.randrange(len(randomness.ENCODINGS)) * 64 + rng.choice([0, 8, 20])
        low = rng.choice([3, 30, secret_scan.LAST_BIN])
        bins = [rng.randrange(low) for _ in range(rng.choice([1, 5, 40]))] + [rng.randrange(secret_scan.LAST_BIN + 1) for _ in range(rng.choice([0, 20, 300]))]
        last = secret_scan.discovered(dict(Counter(bins)), kind)
        expected = plain_decision((kind, bins))
        assert Counter(b for b in bins if b <= last) == expected
        found += len(expected)
    assert found or seed


def test_thresholds_of_texts_equal_a_plain_procedure(spark):
    rng = random.Random(7)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [key("0123456789ABCDEF", 40) for _ in range(30)] + [key("abcdefghijklmnopqrstuvwxyz0123456789", 36) for _ in range(30)]
    texts += ["_".join(rng.choice(["render", "index", "token", "Value", "2024", "list"]) for _ in range(8)) for _ in range(80)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    scanned = secret_scan.scanned(docs).cache()
    runs = defaultdict(list)
    for row in scanned.select("runs").collect():
        for r in row["runs"]:
            runs[r["class"]].append(r["bin"])
    last = secret_scan.thresholds(scanned)
    scanned.unpersist()
    assert len(runs) > 2
    chosen = {kind: Counter(b for b in bins if b <= last.get(kind, -1)) for kind, bins in runs.items()}
    assert chosen == {kind: plain_decision((kind, bins)) for kind, bins in runs.items()}
    assert sum(map(len, chosen.values())) > 0
