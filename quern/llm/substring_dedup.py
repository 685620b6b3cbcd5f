"""Substring dedup: repeated windows of words, found by FM-indexes over content-routed shards.

A window goes to a shard by its anchor, the smallest hash of the 8-word grams within it, so
equal windows meet in one shard whatever documents they are in. Consecutive windows of one
anchor form a piece. Anchors that only one document has cannot hold a repeat; of the
others every distinct piece is fetched once, from its first document, and a shard's
pieces make up one compressed FM-index. The pieces are streamed through it, and their matching
statistics give, for each interval of windows, the first document that has them.

An anchor with many distinct pieces (a passage amid ever other words) is split: windows are told
apart by where the anchor lies in them, in ever narrower ranges, and by the words that all
windows of a range share around the anchor. Those that one document alone has are dropped again,
so the rows follow the distinct pieces and not their windows.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import checkpointed, map_batches, map_partitions, maybe_members, members
from quern.llm.decontaminate import merged
from quern.llm.fm_index import FmIndex

#: Words of a window, and of the grams that anchors are chosen from.
WINDOW, GRAM = 50, 8
#: Words of pieces in one FM-index, about; distinct pieces of an anchor above which it is split, and into how many ranges.
SHARD_WORDS, ANCHOR_PIECES, RANGES = 400_000, 500, 4
#: Words of a document that are handled at once.
BLOCK_WORDS = 1 << 19
CACHE_ENTRIES = 200_000
#: Keys of 8 bytes that are broadcast; more are joined by a shuffle.
FEW_KEYS = 100_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM_STEPS = tuple(map(np.uint64, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)))


class _Hashes(dict):
    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


def gram_words(window: int) -> int:
    """Words of an anchor: a power of two, ``GRAM`` at most and no more than the window has."""
    return min(GRAM, 1 << window.bit_length() - 1)


class Sketcher:
    """Pieces of documents: anchor, two content hashes, first window, number of windows, and words from there to the anchor."""

    def __init__(self, window: int):
        self.window = window
        self.gram = gram_words(window)
        self.hash, self.second = _Hashes(), _Hashes(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, m)], dtype=np.uint64) for m in (_MULTIPLIER, _INVERSE))
        return self.powers[:n], self.inverses[:n]

    def pieces(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """The pieces of all texts, given as words, in order, and before them the number of each one's text.

        Short texts are worked on together and long ones in parts, so arrays have about ``BLOCK_WORDS``.
        """
        found, block, size = [], [], 0
        for k, words in enumerate(texts):
            for at in range(0, len(words) - self.window + 1, BLOCK_WORDS):
                part = words[at : at + BLOCK_WORDS + self.window - 1]
                if size and size + len(part) >= 1 << 20:  # places of anchors have 20 bits
                    found.append(self._block(block))
                    block, size = [], 0
                block.append((k, at, part))
                size += len(part)
        if block:
            found.append(self._block(block))
        if not found:
            return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found)))

    def _block(self, parts: list[tuple[int, int, list[bytes]]]):
        """Text numbers, anchors, content hashes, second content hashes, starts, window counts and anchor places of parts (text, first word, words)."""
        sizes = np.array([len(words) for _, _, words in parts])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        h = np.fromiter(map(self.hash.__getitem__, chain.from_iterable(words for _, _, words in parts)), np.uint64, n)
        power, inverse = self._powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:-1], out=prefix[1:])
        # grams by doubling, then mixed so that their order is random
        g, width = h, 1
        for step in _GRAM_STEPS:
            if 2 * width <= self.gram:
                g, width = g[:-width] * step + g[width:], 2 * width
        g = (g ^ g >> np.uint64(31)) * _GRAM_STEPS[0]
        g ^= g >> np.uint64(29)
        place = np.arange(len(g), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        least, span, across = (g & ~low) | place, 1, self.window - width + 1
        while 2 * span <= across:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < across:
            least = np.minimum(least[: len(least) - (across - span)], least[across - span :])
        # windows that lie in one part; their anchors do too, so a piece does
        inside = np.ones(len(least), bool)
        for end in ends[:-1].tolist():
            inside[end - self.window + 1 : end] = False
        window = np.flatnonzero(inside)
        chosen = (least[window] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        start, count = window[first], np.diff(np.r_[first, len(window)])
        end = start + count + self.window - 1
        content = (prefix[end] - prefix[start]) * inverse[start] + count.astype(np.uint64) * _GRAM_STEPS[1]
        content = (content ^ content >> np.uint64(32)) * _GRAM_STEPS[2]
        h = np.fromiter(map(self.second.__getitem__, chain.from_iterable(words for _, _, words in parts)), np.uint64, n)
        np.cumsum(h * power[:-1], out=prefix[1:])
        second = (prefix[end] - prefix[start]) * inverse[start]
        part = np.searchsorted(ends, start, side="right")
        shift = np.array([at for _, at, _ in parts]) - (ends - sizes)
        return np.array([k for k, _, _ in parts])[part], g[chosen[first]], content, second, start + shift[part], count, chosen[first] - start


_ARRAYS = "anchors array<long>, contents array<binary>, starts array<int>, counts array<int>, places array<int>"


def _sketched(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, the arrays of its pieces) of every row of ``docs`` (doc_id, row, text) with at least one window."""

    def work():
        sketcher = Sketcher(window)

        def each(batch):
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                words = [(t.as_py() or "").encode().split() for t in rows.column(2)]
                long = [k for k, w in enumerate(words) if len(w) >= window]
                yield _arrays(rows.take(pa.array(long, pa.int64())), sketcher.pieces([words[k] for k in long]))

        return each

    return map_batches(docs.select("doc_id", "row", "text"), work, f"doc_id long, row long, {_ARRAYS}")


def _arrays(rows: pa.RecordBatch, pieces: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """The first two columns of some rows beside the arrays of their pieces."""
    text, anchors, first, second, *numbers = pieces
    offsets = pa.array(np.searchsorted(text, np.arange(rows.num_rows + 1)), pa.int32())
    # both content hashes as one key of 16 bytes
    both = pa.py_buffer(np.stack([first, second], 1).tobytes())
    contents = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, both]).cast(pa.binary())
    columns = [pa.array(anchors.view(np.int64)), contents, *(pa.array(c.astype(np.int32)) for c in numbers)]
    lists = [pa.ListArray.from_arrays(offsets, c) for c in columns]
    return pa.RecordBatch.from_arrays([*rows.columns[:2], *lists], ["doc_id", "row", "anchors", "contents", "starts", "counts", "places"])


def _exploded(sketched: DataFrame) -> DataFrame:
    s = F.explode(F.arrays_zip("anchors", "contents", "starts", "counts", "places")).alias("s")
    names = {"anchors": "anchor", "contents": "content", "starts": "start", "counts": "n", "places": "place"}
    return sketched.select("doc_id", "row", s).select("doc_id", "row", *(F.col(f"s.{a}").alias(b) for a, b in names.items()))


def _shared(pieces: DataFrame) -> DataFrame:
    """The distinct pieces (anchor, content) of anchors that more than one document has, with a place each.

    ``low`` and ``high`` are the first and last document of a piece; row, start, n and place are
    one of its places in the first. Anchors are counted by a map-side aggregate of fixed-size rows;
    most pieces then fall to a membership table of fixed size, and equal ones are put
    together before the exact join, so that copies, however many, are one row there.
    """
    anchors = checkpointed(
        pieces.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    )
    likely = maybe_members(pieces, "anchor", members(anchors, "anchor"))
    distinct = likely.groupBy("anchor", "content").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *(F.min_by(c, "doc_id").alias(c) for c in ("row", "start", "n", "place"))
    )
    return checkpointed(distinct.join(anchors, "anchor", "left_semi"))


def _fetched(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(key, content, low, high, place, words) of distinct pieces, read from their first documents."""
    span = F.struct("anchor", "content", "high", "start", "n", "place")
    wanted = checkpointed(shared.groupBy(F.col("low").alias("doc_id"), "row").agg(F.collect_list(span).alias("spans")))

    def work():
        def each(batch):
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for i, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = t.as_py().encode().split()
                for s in spans:
                    text = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                    for column, x in zip(columns, (s["anchor"], s["content"], i, s["high"], s["place"], text)):
                        column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "content", "low", "high", "place", "words"])

        return each

    texts = maybe_members(docs, "doc_id", members(wanted, "doc_id"))
    return map_batches(
        texts.join(wanted, ["doc_id", "row"]).select("doc_id", "text", "spans"), work, "key long, content binary, low long, high long, place int, words binary"
    )


def _split(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """Each piece cut where the anchor's offset in its windows passes a multiple of ``width``.

    A part's key is the hash of the words that all windows of its range share, so equal windows
    keep one key; its content is a 128-bit hash of its words. ``parent`` and ``parent_content`` name
    the piece, ``shift`` is the part's first window in it.
    """
    reach = window - gram_words(window)  # the largest offset

    def work():
        def each(batch):
            out: tuple[list, ...] = tuple([] for _ in range(9))
            for key, content, low, high, place, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                words = text.split(b" ")
                last = place - (len(words) - window)  # the anchor's offset in the last window
                for band in range(last // width, place // width + 1):
                    least, most = band * width, min(band * width + width - 1, reach)
                    first, n = place - min(most, place), min(most, place) - max(least, last) + 1
                    core = b" ".join(words[place - least : place - most + window])
                    own = b" ".join(words[first : first + n + window - 1])
                    signed = xxhash.xxh64_intdigest(core, least * (window + 1) + width)
                    row = (signed - (1 << 64) * (signed >> 63), xxhash.xxh3_128_digest(own), low, high, place - first, own, key, content, first)
                    for column, x in zip(out, row):
                        column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32())
            names = ("key", "content", "low", "high", "place", "words", "parent", "parent_content", "shift")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        return each

    columns = pieces.select("key", "content", "low", "high", "place", "words")
    return map_batches(columns, work, "key long, content binary, low long, high long, place int, words binary, parent long, parent_content binary, shift int")


def _shard_runs(pieces: list[tuple], window: int) -> pa.RecordBatch:
    """For each piece (key, content, low, words) of a shard the runs of its windows with the first document that has them."""
    numbers: dict[bytes, int] = {}
    sequences = [np.array([numbers.setdefault(w, len(numbers)) for w in p[3].split(b" ")], np.int64) for p in pieces]
    index = FmIndex(sequences, np.array([p[2] for p in pieces], np.int64), window)
    runs = []
    for owners in index.first_owners(sequences):
        at = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        ends = np.r_[at[1:], len(owners)]
        runs.append([{"from": a, "to": b, "doc": d} for a, b, d in zip(at.tolist(), ends.tolist(), index.names[owners[at]].tolist())])
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("doc", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.binary()), pa.array(runs, kind)], ["key", "content", "runs"])


_RUNS = "key long, content binary, runs array<struct<from:int,to:int,doc:long>>"


def _matched(pieces: DataFrame, window: int) -> DataFrame:
    """(key, content, runs) of distinct pieces, a shard at a time; shards end between keys."""

    def run(batches):
        held: list[tuple] = []
        words, last = 0, ()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[:2] == last:
                    continue  # a repeated row of the first document
                if words >= SHARD_WORDS and row[0] != last[0]:
                    yield _shard_runs(held, window)
                    held, words = [], 0
                held.append(row)
                words += row[3].count(b" ") + 1
                last = row[:2]
        if held:
            yield _shard_runs(held, window)

    dealt = pieces.select("key", "content", "low", "words").repartition("key").sortWithinPartitions("key", "low", "content")
    return map_partitions(dealt, run, _RUNS)


def _all_runs(pieces: DataFrame, window: int) -> DataFrame:
    """(key, content, runs) of distinct pieces; a piece that was split has several rows."""
    width = window - gram_words(window) + 1
    parts: list[DataFrame] = []  # how the pieces of each level were split
    found: list[DataFrame] = []
    while True:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("n"))
        crowded = checkpointed(sizes.where(F.col("n") > (ANCHOR_PIECES if width > 1 else sys.maxsize)).select("key"))
        n = crowded.count()
        sent = F.broadcast(crowded) if n <= FEW_KEYS else crowded
        runs = checkpointed(_matched(pieces.join(sent, "key", "left_anti") if n else pieces, window))
        for part in reversed(parts):  # back to the pieces of the first level
            shifted = F.transform("runs", lambda r: F.struct((r["from"] + F.col("shift")).alias("from"), (r["to"] + F.col("shift")).alias("to"), r["doc"].alias("doc")))
            runs = part.join(runs, ["key", "content"]).select(F.col("parent").alias("key"), F.col("parent_content").alias("content"), shifted.alias("runs"))
        found.append(runs)
        if not n:
            return reduce(DataFrame.unionByName, found)
        width = -(-width // RANGES)
        split = checkpointed(_split(pieces.join(sent, "key", "left_semi"), window, width))
        parts.append(split.select("key", "content", "parent", "parent_content", "shift"))
        # equal parts are put together where they were made; keys of one document alone are dropped
        distinct = split.groupBy("key", "content").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("place").alias("place"), F.first("words").alias("words"))
        kept = checkpointed(split.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key"))
        sent = F.broadcast(kept) if kept.count() <= FEW_KEYS else kept
        pieces = checkpointed(distinct.join(sent, "key", "left_semi"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` tells rows of one doc_id apart by their texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, spans array<struct<start, stop>>) in words, for rows that repeat a window of a smaller doc_id.

    ``docs`` has (doc_id, text); ``row`` is the text's xxhash64, as rows of one doc_id may have several texts.
    """
    docs = _keyed(docs).where("doc_id is not null")
    pieces = _exploded(checkpointed(_sketched(docs, window)))
    known = checkpointed(_fetched(docs, _shared(pieces), window))
    runs = checkpointed(_all_runs(known, window)).withColumnRenamed("key", "anchor")
    places = pieces.select("doc_id", "row", "anchor", "content", "start", F.xxhash64("anchor", "content").alias("both"))
    met = maybe_members(places, "both", members(runs.select(F.xxhash64("anchor", "content").alias("both")), "both")).drop("both")
    earlier = F.filter("runs", lambda r: r["doc"] < F.col("doc_id"))
    hit = met.join(runs, ["anchor", "content"]).select("doc_id", "row", "start", F.explode(earlier).alias("r"))
    span = F.struct((F.col("start") + F.col("r.from")).alias("start"), (F.col("start") + F.col("r.to") + window - 1).alias("stop"))
    return hit.groupBy("doc_id", "row").agg(F.collect_set(span).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and ``kept``, the text, if ``texts``).

    A word goes if a window of ``window`` words that covers it also starts in a document of
    smaller id. A document of fewer words keeps all; a null or empty text has none. Rows that
    repeat a doc_id are texts of one document, the same or several: each is judged by itself
    against the documents of smaller ids, and they never remove each other. A row without a doc_id
    keeps all its words and removes none.
    """
    docs = _keyed(docs)
    found = checkpointed(repeated_spans(docs, window))
    known = members(found, "doc_id")
    # only texts that may lose words are dealt by id; the others are digested where they are read
    some = maybe_members(docs, "doc_id", known).join(found, ["doc_id", "row"], "left")
    none = maybe_members(docs, "doc_id", known, "left_anti").withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    joined = some.select("doc_id", "text", "spans").unionByName(none.select("doc_id", "text", "spans"))

    def work():
        def each(batch):
            n, removed, digests, kept_texts = [], [], [], []
            for t, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                words = (t.as_py() or "").encode().split()
                kept, at = [], 0
                for a, b in merged([(s["start"], s["stop"]) for s in spans or []]):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                text = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept_texts.append(text.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_texts, pa.string())] if texts else [])], [*names, *(["kept"] if texts else [])])

        return each

    return map_batches(joined, work, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for ``dedup``: every window by its words, with the smallest document that has it."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d WHERE len(w) >= {window})),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM win JOIN f USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
