"""Operator 4 against the SentencePiece library, as BPE and as unigram model, and exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from feedpulse.llm import pieces

from llm_helpers import ODD_TEXTS, docs, prose

PATH = public_tokenizers.path(pieces.MODEL)


def texts():
    rng = random.Random(8)
    known = sentencepiece.SentencePieceProcessor(model_file=PATH)
    some = [known.id_to_piece(i) for i in range(300, 20000)]
    return [*ODD_TEXTS, "Hello  world\n  x\t y", "   ", " ", "\n", "a▁b", "你好世界" * 40, "the" * 60, "a" * 333, "a b" * 50, "\x00\x1f", "x\u2028y",
            *["".join(rng.choices(some, k=30)) for _ in range(200)], *["".join(rng.choices("abcdest he ing ", k=300)) for _ in range(100)],
            prose(rng, 3000)]


def unigram_file(path):
    """The same pieces and scores as a unigram model: trainer_spec.model_type becomes 1."""
    data = open(PATH, "rb").read()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out, at = bytearray(), 0

    def varint(at):
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    def enc(n):
        b = bytearray()
        while True:
            b.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(b)

    while at < len(data):
        tag, at = varint(at)
        size, at = varint(at)
        body = data[at:at + size]
        at += size
        if tag >> 3 == 2:
            fields = [(n, v) for n, v in pieces._fields(body)]
            assert dict(fields)[3] == pieces.BPE
            i = body.index(bytes([3 << 3, pieces.BPE]))
            body = body[:i] + bytes([3 << 3, pieces.UNIGRAM]) + body[i + 2:]
        out += enc(tag) + enc(len(body)) + body
    path.write_bytes(bytes(out))
    assert model.get_piece_size() == sentencepiece.SentencePieceProcessor(model_file=str(path)).get_piece_size()
    return str(path)


def test_bpe_equals_the_library():
    e, ref = pieces.Encoder(pieces.tables(pieces.load(PATH))), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ts = texts()
    for t, ids in zip(ts, e.encode(ts)):
        assert ids.tolist() == ref.encode(t or ""), t
        assert e.decode(ids) == (t or "").replace("▁", " ") == ref.decode(ids.tolist())


def test_unigram_is_the_best_path(tmp_path):
    """Equal totals with the library's own Viterbi search (paths of one total may differ)."""
    path = unigram_file(tmp_path / "u.model")
    e, ref = pieces.Encoder(pieces.tables(pieces.load(path))), sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [t for t in texts() if t and t.isascii() and t.isprintable()][:150]
    total = lambda ids: sum(ref.get_score(int(i)) for i in ids)
    for t, ids in zip(plain, e.encode(plain)):
        assert ref.decode(ids.tolist()) == t
        if "  " not in t:
            assert total(ids) == pytest.approx(total(ref.encode(t)), rel=1e-6), t


def test_query_round_trip(spark):
    rows = list(enumerate(texts()[:40])) + [(None, "null id"), (2, "again")]
    df = docs(spark, rows, extra=("ids", "n_tokens", "key"))
    got = pieces.encode(df)
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()), True) for i, x in ((i, ref.encode(t or "")) for i, t in rows))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in got.collect()) == want
    back = Counter(map(tuple, pieces.decode(got).collect()))
    assert back == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(df.limit(0)).count() == 0
