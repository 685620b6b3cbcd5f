"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm._spark import map_batches
from quern.llm.bpe import SPACE, Bpe, Remembered, blocks, loaded, vocabulary

_SPLIT = re.compile(f"[^{SPACE}]+")
_PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")


class Counter:
    """Counts tokens; only pre-tokens that are not proven whole tokens are merged."""

    def __init__(self, content: bytes):
        self.bpe = Bpe(content)
        self.whole = self.bpe.whole_tokens()
        self.known = Remembered()  # tokens of runs of visible characters

    def _learn(self, new: list[str]) -> None:
        """Tokens of runs of visible characters."""
        words = [[w.encode() for w in self.bpe.words(c)] for c in new]
        rest = list({w for ws in words for w in ws} - self.whole)
        merged = dict(zip(rest, map(len, self.bpe.merge(rest))))
        self.known.learn(new, (sum(merged.get(w, 1) for w in ws) for ws in words))

    def texts(self, texts: list[str]) -> Iterator[int]:
        runs: list[list[str]] = []
        special: list[int] = []
        for text in texts:
            own: list[str] = []
            segments = self.bpe.segments(text)
            for part in segments[::2]:
                own += _SPLIT.findall(part) if _PYTHON_ONLY_SPACE.search(part) else part.split()
            runs.append(own)
            special.append(len(segments) // 2)
        self._learn(list(set().union(*runs) - self.known.keys()))
        for own, n in zip(runs, special):
            yield n + sum(map(self.known.__getitem__, own))
        self.known.settle()


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text of ``docs`` (doc_id, text).

    ``path`` is a word-level BPE file of the tokenizers library; its counts are matched
    without added special tokens, and special strings inside a text count one each. One pass
    without a shuffle; a null or empty text has 0 bytes and 0 tokens.
    """
    content = vocabulary(docs.sparkSession, path)

    def work():
        counter = loaded(content.value, Counter)

        def each(batch):
            size, n = [], []
            for block in blocks(x.as_py() for x in batch.column(1)):
                size += [len(t.encode()) for t in block]
                n += counter.texts(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
