"""Toxicity by noisy-channel deobfuscation.

Writers hide words by leetspeak, by spacing and by repeating letters. Each such token is a
lattice: every character offers what it may stand for, at a cost. The Viterbi path under
a character trigram model of the corpus restores the text, and the restored words are scored.

The model is counted over all documents; the scorer is fitted on a bounded sample of the
labelled rows (``SAMPLE``) that are not held out.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import checkpointed, map_batches, map_partitions
from quern.llm.bpe import blocks

#: Labelled rows that the scorer is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Features offered to the scorer, the best by evidence; documents a feature must occur in.
CANDIDATES, SEEN = 4096, 5
#: Rounds and shrinkage of the logistic regression.
ROUNDS, SHRINK = 400, 2e-4
#: Every fifth document by CRC-32 of its id is held out.
FOLDS = 5
#: Features that a task adds up before it passes them on.
COUNTED = 200_000
#: Tokens that a worker remembers before it starts afresh.
CACHE_ENTRIES = 120_000

#: What a character may stand for, besides itself or nothing. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "*": "aeiou"}
#: Costs in nats: a stand-in read as its letter, a sign dropped, a sign kept as a word break, a repetition read as two letters.
AS_LETTER, DROPPED, BREAK, DOUBLED = 0.5, 1.5, 2.5, 1.0
#: Further cost of dropping a digit or breaking at one; cost of each digit where a token of digits alone is read as a number.
DIGIT, NUMERAL = 6.0, 4.0

_STRIP = ".,;:!?\"'()[]{}<>*#$%&-_/\\|~`^=+«»“”„’…¿¡"
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_RUNS = re.compile(r"(.)\1*", re.S)
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ .\-_*·](?:[^\W_]|[@$!|+])){2,}(?!\S)")

#: Letters of the character model: a-z, then U+00DF to U+00FF; any other letter; 0 is a word's edge.
_LETTERS, _OTHER = 60, 60
_SIZE = _LETTERS + 1


def letter_codes(text: str) -> np.ndarray:
    """Codes of a text's characters: letters by the model's alphabet, everything else 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    plain = (points >= 97) & (points <= 122)
    latin = (points >= 0xDF) & (points <= 0xFF) & (points != 0xF7)
    codes = np.where(plain, points - 96, np.where(latin, points - 0xDF + 27, 0)).astype(np.int32)
    codes[(points > 0xFF) & (points < 0x2000)] = _OTHER
    return codes


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of the letters' trigrams over all documents: at most ``_SIZE`` cubed rows.

    Each task adds up a fixed table and gives its rows once; the sum by trigram follows.
    """

    def run(batches):
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for texts in blocks(x.as_py() for x in batch.column(0)):
                # texts joined by three spaces share no trigram but the empty one
                c = letter_codes("   ".join(["", *texts, ""]))
                total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], ["gram", "n"])

    return map_partitions(docs.select("text"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Costs (negative log probabilities) of a letter after two others, add-half smoothed."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_SIZE, _SIZE, _SIZE) + 0.5
        table[0, 0, 0] = 0.5  # runs of separators are no text
        self.cost = -np.log(table / table.sum(2, keepdims=True))
        self.nested = self.cost.tolist()
        self._coded: dict[Choices, list[tuple[str, float, tuple[int, ...]]]] = {}

    def coded(self, choices: Choices) -> list[tuple[str, float, tuple[int, ...]]]:
        """Readings with their costs and the codes of their letters."""
        if choices not in self._coded:
            self._coded[choices] = [(out, price, tuple(map(self.code, out))) for out, price in choices]
        return self._coded[choices]

    @staticmethod
    def code(c: str) -> int:
        o = ord(c)
        return o - 96 if 97 <= o <= 122 else o - 0xDF + 27 if 0xDF <= o <= 0xFF and o != 0xF7 else _OTHER if c.isalpha() else 0


#: What a run of equal characters may be read as: texts with their costs.
Choices = tuple[tuple[str, float], ...]


@functools.lru_cache(4096)
def readings(c: str, run: int) -> Choices:
    """What ``run`` times the lower-case character ``c`` may be read as."""
    if c.isalpha():
        return ((c * run, 0.0),) if run < 3 else ((c, 0.0), (c * 2, DOUBLED))
    rare = DIGIT * c.isdigit()
    options = [("", DROPPED + rare), (" ", BREAK + rare)]
    for x in LEET.get(c, ""):
        options.append((x, AS_LETTER))
        if run > 1:
            options.append((x * 2, AS_LETTER + DOUBLED * (run > 2)))
    return tuple(options)


def lattice(token: str) -> list[Choices]:
    """What each run of equal characters of a lower-case token may be read as, with costs."""
    # readings of three or more are those of three
    return [readings(m[0][0], min(len(m[0]), 3)) for m in _RUNS.finditer(token)]


def viterbi(options: list[Choices], model: CharacterModel) -> tuple[float, str]:
    """Cost and text of the cheapest reading of a lattice under the character model, from one word edge to the other.

    A state has its cost and its last reading with a link to the one before, so time and memory grow with the lattice's length.
    """
    cost, coded = model.nested, model.coded
    # state: the last two codes; value: cost so far, and (what came before, last reading)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in options:
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (paid, before) in best.items():
            for out, price, codes in coded(choices):
                x, y, total = a, b, paid + price
                for z in codes:
                    total += cost[x][y][z]
                    x, y = y, z
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, (before, out) if out else before)
        best = step
    ends = [(paid + cost[a][b][0], last) for (a, b), (paid, last) in best.items()]
    least = min(paid for paid, _ in ends)
    return least, min(_read_back(last) for paid, last in ends if paid == least)


def _read_back(last: tuple | None) -> str:
    out = []
    while last is not None:
        last, text = last
        out.append(text)
    return "".join(reversed(out))


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of 4 to 6 letters."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


class Restorer:
    """Restored words of texts; what ordinary tokens restore to is themselves."""

    def __init__(self, counts: np.ndarray):
        self.model = CharacterModel(counts)

    def words(self, token: str) -> list[str]:
        """Restored words of one lower-case token; one with doubled letters is also read with each once."""
        core = token.strip(_STRIP)
        if core.isalpha() and not _TRIPLE.search(core):
            # a stand-in stripped from the edges may have been a letter: $tupid
            edge = token[: token.index(core)][-1:] in LEET and len(token) > len(core)
            once = [_DOUBLE.sub(r"\1", core)] if _DOUBLE.search(core) else []
            return [core, *once, *self.read(lattice(token))] if edge else [core, *once]
        if not any(map(str.isalpha, token)) and not any(c in LEET for c in token):
            return []
        if token.isdecimal():
            # a number, unless its letters make a likelier word; all of its digits are stand-ins then
            price, text = viterbi([tuple(x for x in choices if x[0].isalpha()) for choices in lattice(token)], self.model) if token.isascii() else (math.inf, "")
            return [text] if price < NUMERAL * len(token) else []
        return list(dict.fromkeys(self.read(lattice(token))))

    def read(self, options: list[Choices]) -> list[str]:
        return viterbi(options, self.model)[1].split()

    def spaced(self, text: str) -> list[str]:
        """Restored words of runs of single characters with a gap between each two."""
        found = []
        for m in _SPACED.finditer(text):
            options: list[Choices] = []
            for k, c in enumerate(m[0]):
                options += [(("", 0.0), (" ", BREAK))] if k % 2 else lattice(c)
            found += self.read(options)
        return found


class Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def _features(restorer: Restorer, of_token: Remembered, text: str | None) -> set[str]:
    """Distinct features of one whole text."""
    text = (text or "").lower()
    found: set[str] = set()
    found.update(*map(of_token.__getitem__, set(text.split())))
    if _SPACED.search(text):
        for w in restorer.spaced(text):
            found.update(word_features(w))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled, not held-out rows, each text once.

    The rows are chosen from the labels alone, so at most ``limit`` small rows are broadcast.
    A text labelled both ways counts as toxic.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null and doc_id is not null")
        .where(fold("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    )
    ids = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
    return rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fold(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


class Scorer:
    """A logistic regression over the presence of features."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, features) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(sample: DataFrame, counts: np.ndarray) -> Scorer:
    """Fit the scorer on a bounded sample: choose features by evidence, then gradient descent on the driver.

    What reaches the driver is at most ``CANDIDATES`` features and, for each sampled row, the
    places of those it has. Without toxic or without clean rows every score is the base rate.
    """
    spark = sample.sparkSession
    sent = spark.sparkContext.broadcast(counts)

    def count_work():
        restorer = Restorer(sent.value)
        of_token = Remembered(lambda t: [f for w in restorer.words(t) for f in word_features(w)])

        def counts_of(n):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), *(pa.array([v[k] for v in n.values()], pa.int64()) for k in (1, 0))], ["feature", "toxic", "clean"]
            )

        def each(batch):
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for f in _features(restorer, of_token, text.as_py()):
                    n[f][1 if toxic else 0] += 1
                if len(n) > COUNTED:
                    yield counts_of(n)
                    n.clear()
            yield counts_of(n)

        return each

    base = sample.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, positive = int(base["n"]), int(base["t"])
    bias = math.log((positive + 0.5) / (n - positive + 0.5))
    if not 0 < positive < n:
        return Scorer(bias if n else math.log(0.1), {})
    counted = map_batches(sample, count_work, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log(((F.col("t") + 0.5) / (positive + 1)) / ((F.col("c") + 0.5) / (n - positive + 1)))
    best = counted.where(F.col("t") + F.col("c") >= SEEN).withColumn("evidence", F.abs(odds) * F.col("t")).where(odds > 1).orderBy(F.desc("evidence"), "feature").limit(CANDIDATES)
    names = [r["feature"] for r in best.select("feature").collect()]
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def place_work():
        restorer, at = Restorer(sent.value), place.value
        of_token = Remembered(lambda t: [f for w in restorer.words(t) for f in word_features(w) if f in at])

        def each(batch):
            rows = [sorted(at[f] for f in _features(restorer, of_token, t.as_py()) if f in at) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], ["at", "toxic"])

        return each

    rows = map_batches(sample, place_work, "at array<int>, toxic int").collect()
    y = np.array([bool(r["toxic"]) for r in rows], float)
    sizes = [len(r["at"]) for r in rows]
    columns = np.fromiter((i for r in rows for i in r["at"]), np.int64, sum(sizes))
    lines = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(len(names)), bias
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(lines, w[columns], len(rows)))))
        g = np.r_[np.bincount(columns, (p - y)[lines], len(names)) / len(rows) + SHRINK * w, (p - y).mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Scorer(float(b), {f: float(x) for f, x in zip(names, w) if abs(x) > 0.02})


def character_counts(docs: DataFrame) -> np.ndarray:
    """The trigram table of all documents on the driver; its size is that of the alphabet cubed."""
    counts = np.zeros(_SIZE**3)
    for gram, n in trigram_counts(docs).toPandas().itertuples(index=False):
        counts[gram] = n
    return counts


def _model(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None):
    counts = character_counts(docs)
    scorer = fit(checkpointed(labelled_sample(docs if corpus is None else corpus, labels)), counts)
    return docs.sparkSession.sparkContext.broadcast((counts, scorer.bias, scorer.weights))


def _scores(sent):
    """The function of a batch's text column that gives its scores."""
    counts, bias, weights = sent.value
    restorer, scorer = Restorer(counts), Scorer(bias, weights)
    of_token = Remembered(lambda t: [f for w in restorer.words(t) for f in word_features(w) if f in weights])
    return lambda texts: [scorer.score(f for f in _features(restorer, of_token, t.as_py()) if f in weights) for t in texts]


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``labels`` has (doc_id, toxic); labels of held-out documents are never read. ``corpus``
    (doc_id, text) has the labelled texts, by default ``docs`` itself. Only the text enters a
    score. A null or empty text has no features and so the base score; without labels all
    scores are the base rate.
    """
    sent = _model(docs, labels, corpus)

    def work():
        scores = _scores(sent)

        def each(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

        return each

    scored = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
    return scored.select("doc_id", (F.coalesce(fold("doc_id"), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_filter(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, all columns as they are, without a join."""
    sent = _model(docs, labels, corpus)
    at = docs.columns.index("text")

    def work():
        scores = _scores(sent)

        def each(batch):
            yield batch.filter(pa.array([x < 0.5 for x in scores(batch.column(at))], pa.bool_()))

        return each

    return map_batches(docs, work, docs.schema)
