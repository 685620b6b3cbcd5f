"""SentencePiece encoding against the library, with the model's own character map and with others."""

import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import sentence_pieces
from quern.llm.sentence_pieces import Pieces
from tests.llm.test_operators import AWKWARD, empty, frame, sha

PATH = public_tokenizers.path("piece_bpe_32k.model")
POOL = [*"ab cXYZ  \n\t'’éß12½²,.!?#-_\x00\x1c\x85\xa0 　中क́̈İΣ😀▁①ｱ㌀ﬁ", "'s", "ing", " the", "\n\n", "<s>", "</s>", "<0x41>", "   "]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def message(number, content):
    """A length-delimited field of a protobuf message."""
    size, head = len(content), b""
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + head + bytes([size]) + content


def with_map(rule, prefix, squeeze):
    """The model's vocabulary with one of the library's character maps."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    compiled = dict(sentence_pieces._fields(dict(sentence_pieces._fields(spec))[3])).get(2, b"")
    parts = b"".join(message(k, v) for k, v in sentence_pieces._fields(open(PATH, "rb").read()) if k != 3)
    return parts + message(3, (message(2, compiled) if compiled else b"") + bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1]))


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze", [(1, 0), (1, 1), (0, 1), (0, 0)])
def test_pieces_spans_and_text_equal_the_library(rule, prefix, squeeze):
    content = with_map(rule, prefix, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=content), Pieces(content)
    texts = [t or "" for t in AWKWARD] + ["  a  b  ", "▁▁", " \x1c ", "é" * 200, "ab" * 300, " " * 300] + random_texts(150, 3)
    for t, (n, ids, ends, said) in zip(texts, own.whole(texts)):
        pieces = library.encode(t, return_type="proto").pieces
        expected = [p.id for p in pieces]
        assert (n, np.frombuffer(ids, "<u4").tolist()) == (len(expected), expected), repr(t)[:80]
        assert [*zip(ends.tolist(), ends.tolist()[1:])] == [(p.begin, p.end) for p in pieces], repr(t)[:80]
        assert said.decode() == library.decode(expected) == own.decode(expected), repr(t)[:80]


def test_decoding_of_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(open(PATH, "rb").read())
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_piece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = AWKWARD + random_texts(300, 7) + ["x" * 100_000, "a\n" * 3000]
    docs = frame(spark, texts).unionByName(frame(spark, texts).limit(2))
    got = sentence_pieces.piece_digests(docs, PATH).collect()
    assert len(got) == len(texts) + 2
    pieces = {r["doc_id"]: r["pieces"] for r in sentence_pieces.encode_texts(docs, PATH).collect()}
    ids = spark.createDataFrame([(i, [p["id"] for p in x]) for i, x in pieces.items()], "doc_id long, ids array<int>")
    decoded = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_ids(ids, PATH).collect()}
    for r in got:
        text = texts[r["doc_id"]] or ""
        e = library.encode(text, add_bos=True, add_eos=True)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        own = pieces[r["doc_id"]]
        assert [p["id"] for p in own] == e and [(p["start"], p["end"]) for p in own[1:-1]] == spans
        assert decoded[r["doc_id"]] == library.decode(e)
        raw = struct.pack(f"<{len(e)}I", *e)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(e), sha_bytes(raw), sha(library.decode(e)))
        assert r["spans_sha256"] == sha_bytes(struct.pack(f"<{2 * len(spans)}I", *(x for s in spans for x in s)))
    assert sentence_pieces.piece_digests(empty(spark, "doc_id long, text string"), PATH).collect() == []


def sha_bytes(raw):
    import hashlib

    return hashlib.sha256(raw).hexdigest()


def test_long_text_without_blanks():
    own = Pieces(open(PATH, "rb").read())
    began = time.time()
    ((n, _, ends, said),) = own.whole(["abcdefgh" * 60_000])
    assert time.time() - began < 30 and ends[-1] == 480_000 and said == b"abcdefgh" * 60_000 and n > 1000


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Pieces(b"".join(message(k, v if k != 2 else b"\x18\x01") for k, v in sentence_pieces._fields(open(PATH, "rb").read())))
