"""SentencePiece encoding and decoding that keeps offsets.

A text is rewritten by the model's compiled character map, the longest prefix first, and every
character of the result remembers the byte of the original it comes from. The result is cut where no
piece of the vocabulary can cross, the cuts are merged, and each piece's place in the result gives its
bytes in the original.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import string
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import map_batches
from quern.llm.bpe import Merges, Remembered, blocks, by_length, loaded, vocabulary

#: What stands for a blank inside a piece. Fixed value.
BLANK = "▁"
#: Kinds of pieces and of models in the file, and the fields read from it by number. Fixed values.
NORMAL, CONTROL, BYTE = 1, 3, 6
BPE_MODEL = 2
PIECES, TRAINER, NORMALISER = 1, 2, 3


def _fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = raw[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        value, at = raw[at : at + size], at + size
        yield tag >> 3, struct.unpack("<f", value)[0] if tag & 7 == 5 else value


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and the replacements its leaves point to."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self.known: dict[str, bool] = {}

    def _step(self, at: int, raw: bytes) -> int:
        """The place after some bytes, or -1."""
        for byte in raw:
            at ^= byte
            if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
                return -1
            at ^= self._offset(self.units[at])
        return at

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def begins(self, c: str) -> bool:
        """Whether any key begins with this character."""
        if c not in self.known:
            self.known[c] = bool(self.units) and self._step(self._offset(self.units[0]), c.encode()) >= 0
        return self.known[c]

    def longest(self, text: str, start: int) -> tuple[int, str]:
        """Characters of the longest key at ``start`` and its replacement; 0 if there is none."""
        found, at = (0, ""), self._offset(self.units[0])
        for n in range(start, len(text)):
            raw = text[n].encode()
            # the flag of a leaf is in the unit of the key's last byte
            before = self._step(at, raw[:-1])
            last = before ^ raw[-1]
            if before < 0 or last >= len(self.units) or self.units[last] & 0x800000FF != raw[-1]:
                break
            at = last ^ self._offset(self.units[last])
            if self.units[last] >> 8 & 1:
                place = self.units[at] & 0x7FFFFFFF
                found = n + 1 - start, self.texts[place : self.texts.index(0, place)].decode()
        return found


class Normaliser:
    """Rewrites texts and says which byte of the original each character of the result comes from."""

    def __init__(self, compiled: bytes, prefix: bool, squeeze: bool, escape: bool):
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(compiled), prefix, squeeze, escape

    def _rewritten(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Code points after the character map; of each its source byte and the place where its unit begins.

        Then the bytes in all, and the byte of the first unit that is replaced by nothing, or -1.
        """
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))
        starts = np.concatenate(([0], ends[:-1])) if len(points) else ends
        odd = "".join(c for c in set(text) if self.map.begins(c)) if self.map.units else ""
        if not odd:
            return points, starts, np.arange(len(points)), int(ends[-1]), -1
        out: list[np.ndarray] = []
        source: list[np.ndarray] = []
        unit: list[np.ndarray] = []
        done = size = 0
        dropped = -1

        def add(new: np.ndarray, places: np.ndarray, whole: bool) -> None:
            nonlocal size
            out.append(new)
            source.append(places)
            unit.append(np.full(len(new), size) if whole else np.arange(size, size + len(new)))
            size += len(new)

        for m in re.finditer(f"[{re.escape(odd)}]", text):
            at = m.start()
            if at < done:
                continue
            n, new = self.map.longest(text, at)
            if n:
                add(points[done:at], starts[done:at], False)
                add(np.frombuffer(new.encode("utf-32-le"), np.uint32), np.full(len(new), starts[at]), True)
                done = at + n
                dropped = int(starts[at]) if not new and dropped < 0 else dropped
        add(points[done:], starts[done:], False)
        return np.concatenate(out), np.concatenate(source), np.concatenate(unit), int(ends[-1]), dropped

    def run(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form, and the source byte of each of its characters and of its end."""
        if not text:
            return "", np.zeros(1, np.int64)
        points, source, unit, end, dropped = self._rewritten(text)
        blank = points == 32
        first = 0
        if self.squeeze:
            # of blanks in a row one is left, none at the edges; those amid a replacement stay
            written = np.concatenate(([0], np.cumsum(~blank)))
            leading = blank & (written[1:] == written[unit])
            before = np.concatenate(([True], blank))[unit]
            alone = np.flatnonzero(~(blank & (np.bincount(unit, minlength=len(unit))[unit] == 1)))
            others = [int(source[alone[0]])] if len(alone) else []
            if dropped >= 0:
                others.append(dropped)
            if not others:
                return "", np.array([end])
            first = min(others)
            kept = ~(leading & before)
            points, source = points[kept], source[kept]
        if self.escape:
            points = np.where(points == 32, np.uint32(ord(BLANK)), points)
        if self.prefix:
            points = np.concatenate((np.array([ord(BLANK) if self.escape else 32], np.uint32), points))
            source = np.concatenate(([first], source))
        if self.squeeze:
            edge = ord(BLANK) if self.escape else 32
            size = len(points)
            while size and points[size - 1] == edge:
                size -= 1
                end = int(source[size])
            points, source = points[:size], source[:size]
        return points.astype("<u4").tobytes().decode("utf-32-le"), np.append(source, end)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("quern-each-byte", _each_byte)


class Pieces:
    """A BPE model with byte fallback, read from the bytes of a ``.model`` file."""

    def __init__(self, content: bytes):
        parts: dict[int, list] = {PIECES: [], TRAINER: [b""], NORMALISER: [b""]}
        for k, v in _fields(content):
            parts.setdefault(k, []).append(v)
        trainer, normaliser = dict(_fields(parts[TRAINER][-1])), dict(_fields(parts[NORMALISER][-1]))
        rows = [dict(_fields(p)) for p in parts[PIECES]]
        self.texts = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or trainer.get(24) or {*kinds} - {NORMAL, 2, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, without pieces of the user's own, are read")
        self.normaliser = Normaliser(normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode()
        self.kinds = kinds
        of = {t: i for i, t in enumerate(self.texts)}
        self.first, self.last = of[trainer.get(46, b"<s>").decode()], of[trainer.get(47, b"</s>").decode()]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {t: i for i, t in enumerate(self.texts) if kinds[i] == NORMAL}
        # letters that only occur inside longer pieces are symbols too, without an id of the file
        symbols = dict(self.ids)
        for t in self.ids:
            for c in t:
                symbols.setdefault(c, len(self.texts) + len(symbols))
        self.symbol_of = np.full(0x110000, len(self.texts) + len(symbols), np.int32)  # where no piece has the character
        for t, i in symbols.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i
        # any two neighbours whose texts together are a piece merge, the piece of the best score first
        order = {s: r for r, s in enumerate(sorted({rows[i].get(2, 0.0) for i in self.ids.values()}, reverse=True))}
        cuts = ((t[:k], t[k:], i) for t, i in self.ids.items() for k in range(1, len(t)))
        self.merges = Merges({(symbols[a], symbols[b]): (order[rows[i].get(2, 0.0)], i) for a, b, i in cuts if a in symbols and b in symbols})
        self.sizes = [len(t) for t in self.texts]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(BLANK, " ").encode() for i, t in enumerate(self.texts)]
        self.chunk = self._cuts()
        self.known = Remembered()

    def _cuts(self) -> re.Pattern | None:
        """The pattern of chunks that no piece crosses, as far as the vocabulary proves it.

        Cuts are before blanks and between characters of two families: those that are linked to letters by
        standing beside them in pieces, and all others. The others may hold line ends, which are cut off as well
        where no piece has them.
        """
        inside = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        if any(a != BLANK and b == BLANK for a, b in inside):
            return None
        beside: dict[str, set[str]] = {}
        for a, b in inside:
            if a != BLANK:
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        family, new = set(string.ascii_letters), set(string.ascii_letters)
        while new:
            new = set().union(*(beside.get(c, ()) for c in new)) - family
            family |= new
        letters = re.escape("".join(sorted(family)))
        line = "" if "\n" in beside else "\n"
        return re.compile("|".join([f"{BLANK}*[{letters}]+", f"{BLANK}*[^{letters}{BLANK}{line}]+", f"{BLANK}+", *(f"{c}+" for c in line)]))

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(text) if self.chunk else [text] if text else []

    def _merged(self, chunks: list[str]) -> list[list[int]]:
        """Symbols of each chunk; chunks of one length are merged side by side."""
        out: list[list[int]] = [[]] * len(chunks)
        symbols = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        for rows in by_length(lengths):
            for r, merged in zip(rows.tolist(), self.merges.rows(symbols[starts[rows][:, None] + np.arange(lengths[rows[0]])])):
                out[r] = merged
        return out

    def _ids(self, chunk: str, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Ids of a chunk and how many of its characters each covers; of a character's bytes the last covers it."""
        if max(symbols) < len(self.texts):
            return symbols, [self.sizes[s] for s in symbols]
        ids: list[int] = []
        sizes: list[int] = []
        at = 0
        for s in symbols:
            if s < len(self.texts):
                ids.append(s)
                sizes.append(self.sizes[s])
            else:  # one character without an id
                raw = chunk[at].encode()
                ids += map(self.bytes.__getitem__, raw)
                sizes += [0] * (len(raw) - 1) + [1]
            at += sizes[-1]
        return ids, sizes

    def _learn(self, new: list[str]) -> None:
        def known(chunk: str, symbols: list[int]) -> tuple[int, bytes, bytes, bytes]:
            ids, sizes = self._ids(chunk, symbols)
            # a chunk's byte pieces are whole characters, so its text is the bytes of its pieces
            return len(ids), array("I", ids).tobytes(), array("I", sizes).tobytes(), b"".join([self.raw[i] for i in ids])

        self.known.learn(new, map(known, new, self._merged(new)))

    def _said(self, ids: list[int], strip: bool = False) -> str:
        """The text of ids; with ``strip`` the blank that the normal form begins with goes."""
        out: list[str] = []
        held = bytearray()
        at_start, written, taken = strip, False, False
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "quern-each-byte"))
                held.clear()
                written = True
            if written or taken:
                at_start = False
            text, taken = "", False
            if self.kinds[i] == 2:
                text = self.unknown
            elif self.kinds[i] != CONTROL:
                text = self.texts[i]
                if at_start and (self.normaliser.prefix or self.normaliser.squeeze) and text.startswith(BLANK):
                    text, taken = text[1:], not self.normaliser.squeeze
                text = text.replace(BLANK, " ")
            written = written or bool(text)
            out.append(text)
        if held:
            out.append(held.decode("utf-8", "quern-each-byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._said(ids, strip=True)

    def whole(self, texts: list[str]) -> Iterator[tuple[int, bytes, np.ndarray, bytes]]:
        """Of each text, without begin and end: number of ids, ids and ends of their spans, the text decoded from them.

        Ids are little-endian 32-bit integers; span k is from end k to end k + 1, in bytes of the original.
        """
        normal = [self.normaliser.run(t) for t in texts]
        pieces = [self.chunks(t) for t, _ in normal]
        self._learn(list(set().union(*pieces) - self.known.keys()))
        for (_, source), own in zip(normal, pieces):
            n, ids, sizes, said = zip(*map(self.known.__getitem__, own)) if own else ((), (), (), ())
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(sizes), "<u4"), dtype=np.int64)))
            start = self._said(np.frombuffer(ids[0], "<u4").tolist(), strip=True).encode() if own else b""
            yield sum(n), b"".join(ids), source[ends], start + b"".join(said[1:])
        self.known.settle()


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces array<struct<id int, start int, end int>>) of every row, begin and end ids included.

    ``start`` and ``end`` are bytes of the original text; of a character that falls back to bytes the last
    byte's piece has its span and the others an empty one. A null or empty text has the begin and end ids
    alone; repeated rows are encoded alike; further columns are not carried.
    """
    content = vocabulary(docs.sparkSession, path)

    def work():
        model = loaded(content.value, Pieces)

        def each(batch):
            out = []
            for block in blocks(x.as_py() for x in batch.column(1)):
                for t, (_, ids, ends, _) in zip(block, model.whole(block)):
                    size, at = len(t.encode()), ends.tolist()
                    spans = [(model.first, 0, 0), *zip(np.frombuffer(ids, "<u4").tolist(), at, at[1:]), (model.last, size, size)]
                    out.append([{"id": i, "start": a, "end": b} for i, a, b in spans])
            kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [key, "pieces"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, pieces array<struct<id:int,start:int,end:int>>")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids (array<int>); null ids give ''. An id that the model lacks is an error."""
    content = vocabulary(encoded.sparkSession, path)

    def work():
        model = loaded(content.value, Pieces)

        def each(batch):
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

        return each

    kind = encoded.schema[key].dataType.simpleString()
    return map_batches(encoded.select(key, ids), work, f"`{key}` {kind}, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: every text encoded, then decoded from its ids.

    Ids are counted and digested with the begin and end ids. ``spans_sha256`` is of the starts and ends of the
    pieces between those, in bytes of the original, as little-endian 32-bit integers, start then end. One pass
    without a shuffle. A null or empty text has the begin and end ids and decodes to ''.
    """
    content = vocabulary(docs.sparkSession, path)

    def work():
        model, sha = loaded(content.value, Pieces), hashlib.sha256
        first, last = (struct.pack("<I", i) for i in (model.first, model.last))

        def each(batch):
            counts, digests, decoded, spans = [], [], [], []
            for block in blocks(x.as_py() for x in batch.column(1)):
                for n, ids, ends, said in model.whole(block):
                    counts.append(n + 2)
                    digests.append(sha(first + ids + last).hexdigest())
                    decoded.append(sha(said).hexdigest())
                    spans.append(sha(np.repeat(ends, 2)[1:-1].astype("<u4").tobytes()).hexdigest())
            columns = [pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (digests, decoded, spans))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
