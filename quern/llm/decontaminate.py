"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are normalised to their words (A-Z lower-cased; runs of digits, letters and non-ASCII
characters), put one space apart with a space at both ends. The automaton holds every window
of 10 consecutive item words, so one scan of a document finds all occurrences; the offset of
a match's end is mapped back to words, and from those to the original text.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import checkpointed, forget, kept, map_batches

#: Words of a window.
WINDOW = 10
#: Characters of items in one automaton (some hundred MB of nodes); more items take further automata.
AUTOMATON_CHARS = 1 << 20
#: Words of an item that are kept together; a longer one is cut, with an overlap, into parts that have the same windows.
PART_WORDS = 8192

#: Byte map: A-Z to a-z, separators to a space, the rest unchanged (bytes from 0x80 on belong to words).
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text; null has none. All ASCII white space has become a space by then."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def _key(words: list[bytes]) -> str:
    # Latin-1 keeps one character a byte, so the automaton walks UTF-8 bytes
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


class Items:
    """The automaton of some items: each window's word count and the items that have it."""

    def __init__(self, items: list[tuple], window: int):
        owners: dict[str, set] = {}
        length: dict[str, int] = {}
        for item_id, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                own = words[i : i + window]
                key = _key(own)
                owners.setdefault(key, set()).add(item_id)
                length[key] = len(own)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (length[key], frozenset(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word intervals (start, end) in merged form, and the items met."""
        if self.empty or not words:
            return [], set()
        found: list[tuple[int, int]] = []
        items: set = set()
        matches = list(self.automaton.iter(_key(words)))
        if matches:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = np.searchsorted(ends, [e for e, _ in matches]) + 1
            for end, (_, (n, ids)) in zip(last.tolist(), matches):
                items |= ids
                start = end - n
                if found and start <= found[-1][1] and start >= found[-1][0]:
                    found[-1] = (found[-1][0], max(end, found[-1][1]))
                else:
                    found.append((start, end))
        return merged(found), items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every normalised word in the original text, in characters."""
    raw = text.encode()
    mapped = raw.translate(_WORD_BYTES)
    starts = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80) - 1  # character of each byte
    spans, at = [], 0
    for w in mapped.split(b" "):
        if w:
            spans.append((int(starts[at]), int(starts[at + len(w) - 1]) + 1))
        at += len(w) + 1
    return spans


def _loaded(sent, window: int) -> Items:
    return kept((window, hashlib.sha256(repr(sent.value).encode()).digest()), lambda: Items(sent.value, window))


def item_parts(words: list[bytes], window: int) -> list[list[bytes]]:
    """Parts of at most ``PART_WORDS`` words (and ``window`` more) whose windows are together those of all words."""
    if len(words) <= PART_WORDS + window:
        return [words] if words else []
    return [words[i : i + PART_WORDS + window - 1] for i in range(0, len(words) - window + 1, PART_WORDS)]


class _ItemBlocks:
    """The distinct parts of the items in blocks of about ``AUTOMATON_CHARS``, written once, measured, and fetched one block at a time."""

    def __init__(self, items: DataFrame, window: int):
        def work():
            def each(batch):
                parts = [(i, b" ".join(p).decode()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for p in item_parts(normal_words(t.as_py()), window)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.string())], ["item_id", "text"])

            return each

        items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
        self.items = checkpointed(map_batches(items, work, "item_id long, text string").distinct())
        size = self.items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.n = max(1, -(-int(size) // AUTOMATON_CHARS))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> list[tuple]:
        if k >= self.n:
            raise IndexError(k)
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n))
        return sorted(((r[0], r[1]) for r in self.items.where(block == k).collect()), key=repr)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, characters: bool = False) -> DataFrame:
    """(doc_id, n_words long, hits array<struct<start, end>>, items array<long>) of every document.

    Hits are in words, or with ``characters`` in characters of the original text.

    ``docs`` has (doc_id, text), ``items`` (item_id, text). The items are measured first: up
    to ``AUTOMATON_CHARS`` they form one automaton that travels to the documents and nothing
    is shuffled; beyond that, blocks of that size are scanned one after the other, each in a job of its
    own that writes the texts with the intervals so far, so a task has one worker with one automaton
    at a time. Items without words have no window; an item without an id hits
    like any other and is not among the items named. Null and empty documents have no words and
    no hits; repeated items and windows count once.
    """
    spark = docs.sparkSession
    schema = "doc_id long, text string, n_words long, hits array<struct<start:int,end:int>>, items array<long>"
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<long>").alias("items"),
    )
    blocks = _ItemBlocks(items, window)
    for k, own in enumerate(blocks):
        last = k == len(blocks) - 1
        sent = spark.sparkContext.broadcast(own)
        scanned = map_batches(df, lambda sent=sent, last=last: _scanner(sent, window, last, characters), schema.replace("text string, ", "") if last else schema)
        df = scanned if last else _written(scanned, df, k)
    return df


def _written(scanned: DataFrame, before: DataFrame, k: int) -> DataFrame:
    """``scanned`` from the checkpoint folder; what the block before wrote is deleted."""
    out = checkpointed(scanned)
    if k:
        forget(before)
    return out


def _scanner(sent, window: int, last: bool, characters: bool):
    items = _loaded(sent, window)
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())]

    def each(batch):
        n, hits, found = [], [], []
        carried = zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist())
        for text, before, known in carried:
            words = normal_words(text.as_py())
            spans, ids = items.scan(words)
            if before:
                spans = merged([*((x["start"], x["end"]) for x in before), *spans])
            n.append(len(words))
            if last and characters and spans:
                places = word_spans(text.as_py())
                spans = [(places[a][0], places[b - 1][1]) for a, b in spans]
            hits.append([{"start": a, "end": b} for a, b in spans])
            found.append(sorted(ids.union(known) - {None}))
        columns = [pa.array(x, k) for x, k in zip((n, hits, found), kinds)]
        names = ["n_words", "hits", "items"]
        if last:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text", *names])

    return each


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = occurrences(docs, items, window)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``items``, all columns as they are.

    Items of up to ``AUTOMATON_CHARS`` filter the rows in place; more take one pass per block, which writes the
    rows that are left.
    """
    at = docs.columns.index("text")
    blocks = _ItemBlocks(items, window)
    for k, own in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def work(sent=sent):
            found = _loaded(sent, window)

            def each(batch):
                clean = [not found.scan(normal_words(t.as_py()))[0] for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

            return each

        left = map_batches(docs, work, docs.schema)
        docs = left if k == len(blocks) - 1 else _written(left, docs, k)
    return docs


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for ``contamination``: every window of a length that items have, joined by its words."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({lower}, '{words}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({lower}, '{words}'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
