"""Byte-level BPE: vocabulary files, merging by a contiguous rank array, encoding and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import kept, map_batches

#: Bytes up to which a word is merged by scanning its rank array; longer words use a heap.
SCAN_PARTS = 96
#: The rank of a pair that never merges.
NO_RANK = np.iinfo(np.int32).max
#: Distinct chunks that one worker remembers before it starts afresh, and their bytes; longer chunks are not remembered.
CACHE_ENTRIES, CACHE_BYTES, CACHED_CHARS = 120_000, 48 << 20, 1024
#: Characters of text whose new chunks are merged together.
BLOCK_CHARS = 1_000_000
#: Bytes of a vocabulary file that may be broadcast; it does not grow with the data.
VOCABULARY_BYTES = 64 << 20

#: White space as Unicode's property has it (Python's own classes add U+001C to U+001F). Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The published pre-token patterns of the two vocabularies. Fixed values.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ODD_SPACE = re.compile(rf" [{SPACE}]|[\x1c-\x1f]")
_SAFE_CUT = re.compile(f"(?= [^{SPACE}])")
_SPACE_CLASS = f"[{SPACE}]"


def _exact(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes written out, so that every engine agrees on them."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", _SPACE_CLASS)
    return regex.compile(spelled)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 keeps itself."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """The places of equal lengths, those of length zero left out."""
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 1) :]
    return np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []


class Merges:
    """Pairs of symbols that merge, with their ranks; ``pairs`` has (left, right): (rank, merged symbol)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        rows = [(a, b, r, m) for (a, b), (r, m) in pairs.items()]
        left, right, rank, merged = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        # an open-addressing table, for array lookups
        self.bits = max(4, (4 * len(rows)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank_of, self.merged_of = np.full(size, NO_RANK, np.int32), np.zeros(size, np.int32)
        keys = left << 32 | right
        for key, at, r, m in zip(keys.tolist(), self._slot(keys).tolist(), rank.tolist(), merged.tolist()):
            while self.keys[at] >= 0:
                at = at + 1 & size - 1
            self.keys[at], self.rank_of[at], self.merged_of[at] = key, r, m

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK`` where the pair has none) and merged id of each pair of symbol ids."""
        shape, keys = left.shape, (left.astype(np.int64) << 32 | right).ravel()
        at = self._slot(keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while open_.size:
            at[open_] = at[open_] + 1 & len(self.keys) - 1
            seen = self.keys[at[open_]]
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        ranks = np.where(self.keys[at] == keys, self.rank_of[at], NO_RANK)
        return ranks.reshape(shape), self.merged_of[at].reshape(shape)

    def rows(self, parts: np.ndarray) -> list[list[int]]:
        """What each row of symbols merges to; all rows have one length.

        A contiguous array of parts and one of adjacent ranks per row. In each round every row's least rank
        is found by a scan, leftmost first, the boundary there is deleted, and the two ranks that
        touch the grown part are looked up again. A row leaves when none of its pairs has a rank.
        """
        if parts.shape[1] > SCAN_PARTS:
            return [self._heap(row) for row in parts]
        out: list[list[int]] = [[]] * len(parts)
        rows = np.arange(len(parts))
        ranks, grown = self._look_up(parts[:, :-1], parts[:, 1:])
        while True:
            width = parts.shape[1]
            least = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            going = ranks[line, least] != NO_RANK if width > 1 else np.zeros(len(rows), bool)
            done = ~going
            for r, ids in zip(rows[done].tolist(), parts[done].tolist()):
                out[r] = ids
            if not going.any():
                break
            rows, parts, ranks, grown, least = rows[going], parts[going], ranks[going], grown[going], least[going]
            line, at = np.arange(len(rows)), least[:, None]
            new = grown[line, least]
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > at), 1)
            parts[line, least] = new
            columns = columns[:-1] + (columns[:-1] >= at)
            ranks, grown = np.take_along_axis(ranks, columns, 1), np.take_along_axis(grown, columns, 1)
            for side, rows_there in ((least - 1, least > 0), (least, least < width - 2)):
                l, c = line[rows_there], side[rows_there]
                ranks[l, c], grown[l, c] = self._look_up(parts[l, c], parts[l, c + 1])
        return out

    def _heap(self, symbols: np.ndarray) -> list[int]:
        """The same merges for one long row in n log n: a heap of pairs over a linked list."""
        n = len(symbols)
        first = self._look_up(symbols[:-1], symbols[1:])
        symbols = symbols.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(*(x.tolist() for x in first))) if r != NO_RANK]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            at = self.pairs.get((symbols[i], symbols[j]))
            if at:
                heapq.heappush(heap, (at[0], i, symbols[i], symbols[j], at[1]))

        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has grown or gone meanwhile
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s >= 0]


class Bpe:
    """A vocabulary with its merge ranks, read from the bytes of a tokenizers ``.json`` file."""

    def __init__(self, content: bytes):
        d = json.loads(content)
        model = d["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges({(self.ids[a], self.ids[b]): (i, self.ids[a + b]) for i, (a, b) in enumerate(merges)})
        self.special: dict[str, int] = {a["content"]: a["id"] for a in d["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.letters = byte_letters()
        self.first_ids = np.array([self.ids[c] for c in self.letters], np.int32)
        self.last_ids = np.array([self.ids[c + self.end] for c in self.letters], np.int32)
        self.lower = bool(d["normalizer"])
        self.pattern = _exact(WORD_PATTERN if self.lower else BYTE_PATTERN)
        of_letter = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes: dict[int, bytes] = {}
        for token, i in [*self.ids.items(), *self.special.items()]:
            try:
                self.token_bytes[i] = bytes(of_letter[c] for c in token)
            except KeyError:  # not in the byte alphabet: decoders print it as it is
                self.token_bytes[i] = token.encode()

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (its UTF-8 bytes); words of one length are merged side by side."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for rows in by_length(lengths):
            n = int(lengths[rows[0]])
            raw = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), n)
            parts = self.first_ids[raw]
            parts[:, -1] = self.last_ids[raw[:, -1]]
            for r, ids in zip(rows.tolist(), self.merges.rows(parts)):
                out[r] = ids
        return out

    def whole_tokens(self) -> set[bytes]:
        """Words, as bytes, that are proven to merge to one single token.

        Each vocabulary string is put through the merges once; that it is in the vocabulary
        does not suffice, since merges of lower rank may lead elsewhere.
        """
        of_letter = {c: b for b, c in enumerate(self.letters)}
        stems = [t[: len(t) - len(self.end)] for t in self.ids if t.endswith(self.end)]
        words = [bytes(map(of_letter.__getitem__, t)) for t in stems if t and all(c in of_letter for c in t)]
        return {w for w, ids in zip(words, self.merge(words)) if len(ids) == 1}

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self.special_split.split(text) if self.special_split else [text]

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a piece of text, after the file's normalisation."""
        if self.lower:
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = chunk.lower() if chunk.isascii() else "".join(map(str.lower, chunk))
        return self.pattern.findall(chunk)


def chunks(text: str) -> list[str]:
    """Cuts of a byte-level text that no pre-token crosses; each piece but the first has its space.

    A space before a visible character always begins a pre-token, so such spaces are safe
    cuts. A text with other white space behind a space is cut at those places only.
    """
    if _ODD_SPACE.search(text) or text[-1] == " ":
        return list(filter(None, _SAFE_CUT.split(text)))
    head, *rest = text.split(" ")
    pieces = [" " + c for c in rest]
    return [head, *pieces] if head else pieces


def loaded(content: bytes, kind):
    """One ``kind(content)`` per worker process and vocabulary, while that is in use."""
    return kept(kind.__name__ + hashlib.sha256(content).hexdigest(), lambda: kind(content))


def vocabulary(spark, path: str):
    """A broadcast of a vocabulary file's bytes, checked against ``VOCABULARY_BYTES``."""
    content = Path(path).read_bytes()
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(content)} bytes; at most {VOCABULARY_BYTES} are broadcast")
    return spark.sparkContext.broadcast(content)


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about ``BLOCK_CHARS`` characters; null becomes empty."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


class Remembered(dict):
    """What is known of chunks, bounded by entries and by the chunks' characters.

    ``learn`` also takes what is too long to keep; ``settle`` drops that again, and everything once the
    bounds are passed, so it is called when nothing of a block is needed any more.
    """

    def __init__(self, entries: int = CACHE_ENTRIES, size: int = CACHE_BYTES):
        super().__init__()
        self.entries, self.bytes, self.held, self.long = entries, size, 0, []

    def learn(self, chunks: list[str], values: Iterable) -> None:
        self.update(zip(chunks, values))
        # about what the chunks, their ids and their decoded bytes take
        sizes = list(map(len, chunks))
        self.held += 200 * len(sizes) + 6 * sum(sizes)
        if max(sizes, default=0) > CACHED_CHARS:
            self.long += [c for c in chunks if len(c) > CACHED_CHARS]

    def settle(self) -> None:
        if len(self) > self.entries or self.held > self.bytes:
            self.clear()
            self.held = 0
        for chunk in self.long:
            self.pop(chunk, None)
        self.long.clear()


class ByteCodec:
    """Encodes whole texts and decodes them from the ids, remembering chunks."""

    def __init__(self, content: bytes):
        self.bpe = Bpe(content)
        self.known = Remembered()  # count, joined ids, decoded bytes

    def digest(self, ids: list[int]) -> tuple[int, str, bytes]:
        """Count, joined decimal ids and decoded bytes."""
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.bpe.token_bytes.__getitem__, ids))

    def _learn(self, new: list[str]) -> None:
        words = [[w.encode() for w in self.bpe.words(c)] for c in new]
        distinct = list({w for ws in words for w in ws})
        ids_of = dict(zip(distinct, self.bpe.merge(distinct)))
        ids = (ids_of[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids_of[w]] for ws in words)
        self.known.learn(new, map(self.digest, ids))

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """The digest of each text, its new chunks being merged together first."""
        pieces: list[list[str]] = []
        for text in texts:
            own: list[str] = []
            for k, part in enumerate(self.bpe.segments(text)):
                if k % 2:
                    if part not in self.known:
                        self.known.learn([part], [self.digest([self.bpe.special[part]])])
                    own.append(part)
                elif part:
                    own += chunks(part)
            pieces.append(own)
        self._learn(list(set().union(*pieces) - self.known.keys()))
        for own in pieces:
            if own:
                counts, ids, decoded = zip(*map(self.known.__getitem__, own))
                yield sum(counts), ",".join(ids), b"".join(decoded)
            else:
                yield 0, "", b""
        self.known.settle()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, ids.split(","))) if ids else [] for _, ids, _ in self.texts(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bpe.token_bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row: the general form of the encoder.

    Ids are those of the tokenizers library without added special tokens. A null or
    empty text has an empty array; ties and repeated rows are encoded alike.
    """
    content = vocabulary(docs.sparkSession, path)

    def work():
        codec = loaded(content.value, ByteCodec)

        def each(batch):
            ids = [x for block in blocks(x.as_py() for x in batch.column(1)) for x in codec.encode(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids, special tokens kept; unknown ids are skipped, null ids give ''."""
    content = vocabulary(encoded.sparkSession, path)

    def work():
        codec = loaded(content.value, ByteCodec)

        def each(batch):
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

        return each

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded.select(key, ids), work, f"`{key}` {kind}, text string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, then decoded from its ids.

    One pass without a shuffle. A null or empty text has no ids and two digests of the
    empty string.
    """
    content = vocabulary(docs.sparkSession, path)

    def work():
        codec, sha = loaded(content.value, ByteCodec), hashlib.sha256

        def each(batch):
            n, ids, decoded = [], [], []
            for block in blocks(x.as_py() for x in batch.column(1)):
                for count, joined, raw in codec.texts(block):
                    n.append(count)
                    ids.append(sha(joined.encode()).hexdigest())
                    decoded.append(sha(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
