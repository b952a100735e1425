"""SentencePiece coding against the original library."""

from __future__ import annotations

import os
import struct

import pytest
import sentencepiece
from cases import documents

from driftgate.llm import sentencepiece_codec as S
from driftgate.llm.queries import TOKENIZERS, sentencepiece_model

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no public tokenizer files")
ODD = ["  hi  there ", "a\nb\tc", "▁x ▁▁y", "<s> </s> <unk> <0x41>", "日本語 テスト 🎉", "é é", "\x00\x01", "end ", " ", "   ", "ﬁ ½ Ⅷ", " nb", "x" * 3000]


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def unigram_model(byte_fallback=True, collapse=True) -> bytes:
    """A small unigram model, written by hand."""
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]
    pieces += [(p, -1.0 - 0.37 * k, S.NORMAL) for k, p in enumerate(["▁", "▁the", "he", "th", "▁a", "an", "n", "t", "h", "e", "a", "d", "and", "▁and", "hen", "en", "▁t"])]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, S.UNIGRAM) + field(35, int(byte_fallback)))
    return out + field(3, field(1, b"identity") + field(3, 1) + field(4, int(collapse)) + field(5, 1))


MODELS = {"bpe": sentencepiece_model, "unigram": unigram_model, "unigram plain": lambda: unigram_model(collapse=False),
          "unigram unknown": lambda: unigram_model(byte_fallback=False)}
PLAIN = ["then the and", "a hen", "thentheandhen", "the  then ", " and", "", "xyz the", "é and"]


@pytest.mark.parametrize("name", MODELS)
def test_ids_are_those_of_the_original(spark, name):
    model = MODELS[name]()
    original = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = (PLAIN + ODD if name == "bpe" else PLAIN) + [None]
    for chunk in (texts, [t for t in texts if not t or "▁" not in t]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(chunk)], "doc_id long, text string").repartition(1)
        rows = S.encode(docs, model, whole=True).collect()
        assert len(rows) == len(chunk)
        for r in rows:
            assert list(r.ids) == original.encode(chunk[r.row.doc_id] or ""), (name, chunk[r.row.doc_id])
            assert r.parity and r.words_parity and r.n_tokens == len(r.ids)
            assert r.round_trip or name == "unigram unknown"


def test_whole_documents(spark):
    model = sentencepiece_model()
    original = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = S.encode(docs, model, whole=True).cache()
    for r in encoded.collect():
        assert list(r.ids) == original.encode(texts[r.row.doc_id] or "")
        assert r.parity and r.words_parity and r.round_trip and r.n_unknown == 0
    back = S.decode(encoded.select("row", "ids"), model)
    assert all(r.text == (texts[r.row.row.doc_id] or "") for r in back.collect())
    assert S.encode(docs.limit(0), model).count() == 0


def test_table_of_words_starts_again_when_full(monkeypatch):
    import numpy as np
    c = S.Codec(sentencepiece_model())
    monkeypatch.setattr(S.Codec, "WORDS", 8)
    for text in ["one two three four five", "six seven eight nine ten", "one two six seven eleven"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, n, good = c.chunk(raw, np.array([0, len(raw)]))
        assert ids.tolist() == c.original.encode(text) and n.tolist() == [len(ids)] and good.all()


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        S.parse_model(field(1, field(1, b"a")) + field(2, field(3, 4)))


def test_words_that_collide_under_polynomial_sums(spark):
    one = "".join("yx"[bin(i).count("1") % 2] for i in range(2048))
    texts = [one, one.translate(str.maketrans("xy", "yx")), one + " " + one[::-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    model = sentencepiece_model()
    original = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in S.encode(docs, model, whole=True).collect():
        assert list(r.ids) == original.encode(texts[r.row.doc_id]) and r.parity


def test_query_decodes_and_compares_whole_texts(spark, tmp_path):
    import hashlib
    from driftgate.llm.queries import op1_sentencepiece
    texts = ["The quick  brown fox.", "", None, "a\nb\tc é 漢字 \U0001f600", "x" * 3000, " lead and trail "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op1_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(r["parity"] for r in got.values())
    assert [got[i]["decoded_sha256"] for i in range(len(texts))] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("name", MODELS)
def test_decoding_is_that_of_the_library(name):
    import numpy as np
    import pyarrow as pa
    c = S.Codec(MODELS[name]())
    size = len(c.model["pieces"])
    rng = np.random.default_rng(5)
    mark = [i for i, (p, _, _) in enumerate(c.model["pieces"]) if p == S.MARK]
    lists = [[int(x) for x in rng.integers(0, size if k % 2 else min(size, 259), k % 9)] for k in range(400)] + [None, [], mark, mark * 3]
    lists += [c.original.encode(t) for t in PLAIN + ODD] + [c.original.encode("é")[:-1] for _ in range(2)]
    halves = [[0xC3 + 3], [0xA9 + 3]]  # two texts that are one character together
    for part in [lists, lists[-len(PLAIN + ODD) - 2:-2], [x for x in lists if not x]] + [halves] * (size > 259):
        whole = pa.array([None, *part, [1]], pa.list_(pa.int32())).slice(1, len(part))
        back = iter(c.tok.decode_batch([x for x in part if x is not None], skip_special_tokens=False))
        assert c.decode(whole).to_pylist() == [None if x is None else next(back) for x in part]


@pytest.mark.parametrize("name", MODELS)
def test_words_are_encoded_many_at_once_and_texts_decoded_without_the_library(name, monkeypatch):
    import numpy as np
    c = S.Codec(MODELS[name]())
    monkeypatch.setattr(S.Codec, "GROUP", 3)
    calls = []
    texts = PLAIN + ["  ", " ", "the end ", "a b  c   d ", "hen\nthe\ta", ""] * 2
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    monkeypatch.setattr(c, "texts", lambda t, own=c.texts: calls.append(t) or own(t))
    ids, n, good = c.chunk(np.frombuffer(b"".join(raw), np.uint8), offsets)
    at = np.cumsum(n)[:-1]
    assert [x.tolist() for x in np.split(ids, at)] == [c.original.encode(t) for t in texts]
    assert good[:, 0].all() and (good[:, 1].all() or name == "unigram unknown")
    if c.by_word:  # models that collapse spaces go by whole texts
        assert all(len(t) == 2 for t in calls), "only the ending space asks for whole texts"


def test_texts_that_differ_are_told_apart():
    import numpy as np
    rows = [([1, 2], [1, 2]), ([], []), ([1], [1, 2]), ([3, 4], [3, 5]), ([], [1]), ([7], [7]), ([], [])]
    flat = [S._flat([r[k] for r in rows]) for k in (0, 1)]
    assert S._alike(*flat[0], *flat[1]).tolist() == [a == b for a, b in rows]
    assert S._is_text(np.frombuffer("é".encode(), np.uint8), np.array([0, 2])) and not S._is_text(np.frombuffer("é".encode(), np.uint8), np.array([0, 1, 2]))
