"""The randomness battery's statistic and its calibration, on the driver.

Three tests ask whether a run of symbols is uniform over its alphabet: chi-squared on the
symbols' counts, the number of runs above and below the alphabet's middle, and the serial
correlation of neighbours. Their p-values, by the normal approximation, are combined to
h, the weighted sum of -ln p. The approximation is poor for short runs, so h is not read as a chi-squared
variable: its distribution is simulated by encoding and length, once for uniform symbols
and once for text-like ones (words, numbers, dates, names in the encoding's alphabet).

Nothing here depends on the data; the executors compute h in SQL (``secret_scan``).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order they are tried: name, pattern of the whole run, alphabet. Symbols outside the alphabet are passed over.
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", _LOWER + _DIGITS),
    ("upper36", "^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64url", "^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "_-"),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Symbols below which nothing is tested; z-values beyond which the normal tail is not followed; h of what can't be random.
LEAST, FAR, NEVER = 16, 37.0, 1000.0
#: Simulated runs of a class, and their symbols together, at most; tail share from which p-values are carried on by Hill's estimator.
RUNS, SYMBOLS, TAIL = 20_000, 4_000_000, 0.01
#: Weights of chi-squared, runs and serial correlation in h. With 3 to 1 the simulated power at a level of 1 % is best or within 0.03 of it for most encodings.
WEIGHTS = (3, 1, 1)
#: Polynomial of Hastings for the normal tail. Fixed values.
HASTINGS = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def lengths() -> list[int]:
    """Least lengths of the length classes: an eighth apart, up to 4096."""
    out = [LEAST]
    while out[-1] < 4096:
        out.append(max(out[-1] + 2, out[-1] * 9 // 8))
    return out


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution at z >= 0."""
    t = 1 / (1 + 0.2316419 * z)
    poly = np.zeros_like(t)
    for c in reversed(HASTINGS):
        poly = t * (c + poly)
    return np.maximum(np.exp(-0.5 * z * z) * 0.3989422804014327 * poly, 1e-300)


def combined(codes: np.ndarray, k: int) -> np.ndarray:
    """h of each row of symbol numbers below k; all rows have one length."""
    rows, n = codes.shape
    if n < LEAST:
        return np.full(rows, NEVER)
    counts = np.bincount((np.arange(rows)[:, None] * k + codes).ravel(), minlength=rows * k).reshape(rows, k).astype(float)
    z1 = (k * (counts**2).sum(1) / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    above = 2 * codes >= k
    high = above.sum(1).astype(float)
    expected = 2 * high * (n - high) / n + 1
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(1)
    z2 = np.abs(runs - expected) / np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    off = codes - codes.mean(1, keepdims=True)
    square = (off**2).sum(1)
    z3 = np.where(square > 0, np.abs((off[:, 1:] * off[:, :-1]).sum(1) / np.where(square > 0, square, 1) + 1 / n) * math.sqrt(n), 1e3)
    z1, z2, z3 = (np.minimum(z, FAR) for z in (z1, z2, z3))
    p1 = np.where(z1 >= 0, normal_tail(np.abs(z1)), 1 - normal_tail(np.abs(z1)))
    logs = np.log(p1), np.log(np.minimum(1, 2 * normal_tail(z2))), np.log(np.minimum(1, 2 * normal_tail(z3)))
    return -sum(w * x for w, x in zip(WEIGHTS, logs))


#: Letters by how often texts have them, and words that are spelled in hexadecimal. Fixed values.
_VOWELS, _CONSONANTS = "eeeeeeaaaaiiiiooouuy", "nnnnnrrrrrtttttsssssllllddddcccmmmhhhgggpppbbffvvwkzjxq"
_HEX_WORDS = ("dead", "beef", "cafe", "babe", "face", "feed", "fade", "bad", "add", "c0de", "ff00", "00ff", "ffff", "0000")


def _word(rng) -> str:
    return "".join(rng.choice(list(_CONSONANTS)) * (rng.random() < 0.9) + rng.choice(list(_VOWELS)) + rng.choice(list(_CONSONANTS)) * (rng.random() < 0.3) for _ in range(rng.integers(1, 5)))


def _number(rng) -> str:
    """A year, a date, a time, a padded counter, a round number, or one digit again and again."""
    kind, n = rng.integers(6), int(rng.integers(1, 10 ** int(rng.integers(1, 5))))
    year, month, day = rng.integers(1990, 2030), rng.integers(1, 13), rng.integers(1, 29)
    return (
        f"{year}", f"{year}{month:02}{day:02}", f"{rng.integers(24):02}{rng.integers(60):02}{rng.integers(60):02}", f"{n:0{int(rng.integers(4, 11))}}",
        f"{n}{'0' * int(rng.integers(2, 7))}", str(rng.integers(10)) * int(rng.integers(3, 9)),
    )[kind]


def _piece(rng, name: str) -> str:
    if name == "digits":
        return _number(rng)
    if name in ("hex", "HEX"):
        piece = _number(rng) if rng.random() < 0.6 else str(rng.choice(_HEX_WORDS))
        return piece.upper() if name == "HEX" else piece
    word = _word(rng)
    if name in ("lower36", "upper36", "base32", "base62", "base64", "base64url") and rng.random() < 0.3:
        word += _number(rng)
    if name in ("upper", "upper36", "base32"):
        word = word.upper()
    elif name in ("letters", "base62", "base64", "base64url"):
        word = word if (r := rng.random()) < 0.3 else word.upper() if r < 0.4 else word[:1].upper() + word[1:]
    if name in ("base64", "base64url"):
        word += str(rng.choice(["", "-", "_"] if name == "base64url" else ["", "/", "/", "+"]))
    return word


@lru_cache(64)
def text_like(encoding: int, symbols: int = 100_000) -> np.ndarray:
    """A stream of text-like symbols of an encoding, by number."""
    name, _, alphabet = ENCODINGS[encoding]
    rng, code, out = np.random.default_rng(encoding), {c: i for i, c in enumerate(alphabet)}, []
    while len(out) < symbols:
        out += [code[c] for c in _piece(rng, name) if c in code]
    return np.array(out[:symbols])


@lru_cache(4096)
def simulated(encoding: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted h of uniform and of text-like runs of n symbols."""
    k, rows, stream = len(ENCODINGS[encoding][2]), max(1000, min(RUNS, SYMBOLS // n)), text_like(encoding)
    rng, found = np.random.default_rng([encoding, n]), ([], [])
    for at in range(0, rows, 1000):
        size = min(1000, rows - at)
        found[0].append(combined(rng.integers(0, k, (size, n)), k))
        found[1].append(combined(stream[rng.integers(0, len(stream) - n, size)[:, None] + np.arange(n)], k))
    return tuple(np.sort(np.concatenate(x)) for x in found)


def text_p(encoding: int, n: int, h: np.ndarray) -> np.ndarray:
    """The probability that a text-like run of n symbols looks as random as h, or more.

    From the simulation; below its ``TAIL`` by a power law fitted to the tail (Hill's estimator).
    """
    text = simulated(encoding, n)[1]
    m = max(2, int(TAIL * len(text)))
    edge = text[m - 1]
    exponent = 1 / max(float(np.mean(np.log(edge) - np.log(np.maximum(text[: m - 1], 1e-9)))), 1e-3)
    h = np.maximum(np.asarray(h, float), 1e-9)
    share = (1 + np.searchsorted(text, h, side="right")) / (len(text) + 1)
    return np.where(h < edge, np.minimum(TAIL * (h / edge) ** exponent, share), share)


def random_limit(encoding: int, n: int, lost: float) -> float:
    """The h that uniform runs of n symbols exceed with probability ``lost``."""
    uniform = simulated(encoding, n)[0]
    return float(uniform[min(len(uniform) - 1, math.ceil((1 - lost) * len(uniform)))])
