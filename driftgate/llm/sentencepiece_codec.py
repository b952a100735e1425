"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here, field by field; from it the same tokenizer is
rebuilt with the tokenizers library: the normaliser (precompiled character map, collapsed
spaces, dummy prefix, metaspace marker), the model (unigram scores, or merges ranked by the
scores of a BPE model), and byte fallback, forwards and
backwards. Batches are encoded with
the library's threads, each distinct word of a task once. Decoding joins what the library's
decoder makes of each id. Ids are held against those of the original library: of each distinct
word always, of whole texts on request.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import ship, spans, utf8

ship(__name__)

MARK = "▁"
# Fixed values of the model format: field numbers, piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Text bytes encoded in one call, so that a call's results stay small.
CALL = 1 << 20


# ---------------------------------------------------------------------------- model file
def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4- or 8-byte strings, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at:at + n], at + n
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that matter for encoding."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "suffix": False, "charsmap": b"",
             "dummy_prefix": True, "collapse": True, "escape": True, "unk_surface": " ⁇ "}
    for number, value in fields(data):
        if number == 1:
            p = dict(fields(value))
            score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
            model["pieces"].append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
        elif number == 2:
            t = dict(fields(value))
            model |= {"model_type": t.get(3, UNIGRAM), "byte_fallback": bool(t.get(35, 0)), "suffix": bool(t.get(24, 0))}
            if 44 in t:
                model["unk_surface"] = t[44].decode()
        elif number == 3:
            t = dict(fields(value))
            model |= {"charsmap": t.get(2, b""), "dummy_prefix": bool(t.get(3, 1)), "collapse": bool(t.get(4, 1)), "escape": bool(t.get(5, 1))}
    if model["model_type"] not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model['model_type']}: only unigram and BPE models are supported")
    if model["suffix"] or not model["escape"]:
        raise ValueError("models with the marker as a suffix or without it are not supported")
    return model


def splits_at_marks(model: dict) -> bool:
    """True if no piece has the marker after another character: then no merge or piece
    crosses the start of a word, and words can be encoded one by one (and cached)."""
    return not any(kind in (NORMAL, USER_DEFINED) and MARK in p.lstrip(MARK) for p, _, kind in model["pieces"])


def build(model: dict):
    """The tokenizers.Tokenizer of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    pieces = model["pieces"]
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["model_type"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        usable = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for i, (p, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                merges += [(-score, i, vocab[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=pieces[unk][0], fuse_unk=True,
                          byte_fallback=model["byte_fallback"])
    else:
        # Control, byte and unused pieces are never found in a text: their surface can't occur.
        hidden = {CONTROL, UNUSED, UNKNOWN}
        vocab = [(p if kind not in hidden else f"\x00{i}\x00{p}", score) for i, (p, score, kind) in enumerate(pieces)]
        core = models.Unigram(vocab, unk, model["byte_fallback"])
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["collapse"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?<=[^{MARK}])(?={MARK})"), "isolated")
    user = [AddedToken(p, normalized=False, special=False) for p, _, kind in pieces if kind == USER_DEFINED]
    if user:
        tok.add_tokens(user)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model["dummy_prefix"]:
        back.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(back)
    return tok


# ---------------------------------------------------------------------------- coding
def _byte(piece: str) -> int | None:
    """The byte that a piece stands for, as the library's byte fallback reads it."""
    found = re.fullmatch(r"<0x([0-9A-Fa-f]{2}|\+[0-9A-Fa-f])>", piece)
    return int(found[1], 16) if found else None


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their lengths."""
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(length.sum())), length


def _alike(ids: np.ndarray, length: np.ndarray, others: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Which lists of ids, one after another in two arrays, are the same."""
    out = length == other_length
    if not out.all():
        ids, others = ids[np.repeat(out, length)], others[np.repeat(out, other_length)]
    ends = np.cumsum(np.where(out, length, 0))
    out[np.searchsorted(ends, np.flatnonzero(ids != others), side="right")] = False
    return out


class Codec:
    """Encodes and decodes with one model; lives as long as a task's worker."""

    #: Words kept; a full table starts again.
    WORDS = 1 << 21
    #: Words that go to the library as one text.
    GROUP = 1 << 10

    def __init__(self, data: bytes):
        import sentencepiece
        self.model = parse_model(data)
        self.tok = build(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = self.model["pieces"]
        self.by_word = splits_at_marks(self.model) and not self.model["charsmap"] and not self.model["collapse"]
        kinds = np.array([k for _, _, k in pieces], np.int8)
        self.unknown, self.bytes_ = kinds == UNKNOWN, kinds == BYTE
        # Words can go to the library many at once if the tokens tell where each begins: the
        # marker is a piece, and nothing is taken out of a text before it is normalised.
        self.in_groups = self.by_word and self.model["dummy_prefix"] and (MARK, NORMAL) in {(p, k) for p, _, k in pieces} \
            and not (kinds == USER_DEFINED).any()
        self.marked = np.array([p.startswith(MARK) for p, _, _ in pieces], bool)
        self.only_marks = self.marked & np.array([not p.strip(MARK) for p, _, _ in pieces], bool)
        # What each id is decoded to.
        tokens = [self.tok.id_to_token(i) or "" for i in range(len(pieces))]
        self.surface = pa.array([t.replace(MARK, " ").encode() if (b := _byte(t)) is None else bytes([b]) for t in tokens], pa.binary())
        self._reset()

    def _reset(self):
        self.place: dict[bytes, int] = {}
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parity = np.zeros(0, bool)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def normalise(self, text: str) -> str:
        """The text as the model sees it, the marker written as a space, without the prefix."""
        out = self.tok.normalizer.normalize_str(text).replace(MARK, " ")
        return out[1:] if self.model["dummy_prefix"] and out else out

    def texts(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of whole texts, and (parity, round trip) of each."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        parity = [a == b for a, b in zip(ids, self.original.encode(texts, num_threads=1))]
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        trip = [a == self.normalise(t) for a, t in zip(back, texts)]
        return [np.array(x, np.int32) for x in ids], np.array([parity, trip], bool).T.reshape(-1, 2)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of texts stand for (text ``i`` has ids[ends[i]:ends[i + 1]]),
        without the prefix, and the texts' offsets in them."""
        data, at = utf8(self.surface.take(pa.array(ids)))
        offsets = at[ends]
        if self.model["dummy_prefix"]:
            some = np.flatnonzero(np.diff(offsets))
            some = some[data[offsets[some]] == 32]
            data = np.delete(data, offsets[some])
            less = np.zeros(len(offsets), np.int64)
            less[some + 1] = 1
            offsets = offsets - np.cumsum(less)
        return data, offsets

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: what the library's decoder makes of them, which is asked
        itself for bytes that are no text and for numbers that are no ids."""
        flat = ids.flatten()
        known = not flat.null_count and (not len(flat) or (pc.min(flat).as_py() >= 0 and pc.max(flat).as_py() < len(self.surface)))
        if known:
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
            data, offsets = self.spell(np.asarray(flat), ends)
            if not (data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0 == 0x80).any():  # no text begins inside a character
                empty = pc.is_null(ids)
                valid = pa.py_buffer(np.packbits(~np.asarray(empty), bitorder="little").tobytes())
                raw = pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                try:
                    return raw.cast(pa.string())
                except pa.ArrowInvalid:
                    pass
        lists = ids.to_pylist()
        texts = iter(self.tok.decode_batch([x for x in lists if x is not None], skip_special_tokens=False))
        return pa.array([None if x is None else next(texts) for x in lists], pa.string())

    def _groups(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words (spaces, then others) that are encoded many at once, and their number
        in each; None if the tokens don't tell the words apart."""
        calls = [b"".join(words[k:k + self.GROUP])[1:].decode() for k in range(0, len(words), self.GROUP)]
        ids, _ = _flat([e.ids for e in self.tok.encode_batch_fast(calls, add_special_tokens=False)])
        begins = self.marked[ids]
        begins[1:] &= ~self.only_marks[ids[:-1]]
        at = np.flatnonzero(begins)
        return (ids, np.diff(np.append(at, len(ids)))) if len(at) == len(words) and begins[:1].all() else None

    def _learn(self, words: list[bytes]) -> None:
        lead = int(self.model["dummy_prefix"])
        blank = [w for w in words if not w.strip(b" ")]
        words = [w for w in words if w.strip(b" ")]
        found = self._groups(words) if self.in_groups and words else None
        encoded = lambda some: _flat([e.ids for e in self.tok.encode_batch_fast([w[lead:].decode() for w in some], add_special_tokens=False)])
        ids, length = encoded(words) if found is None else found
        more, more_length = encoded(blank)
        ids, length, words = np.concatenate((ids, more)), np.concatenate((length, more_length)), words + blank
        parity = _alike(ids, length, *_flat(self.original.encode([w[lead:].decode() for w in words], num_threads=1)))
        if lead and b" " in blank:  # the single space that ends a text: no ids of its own so far
            k = words.index(b" ")
            two, sound = self.texts(["x", "x "])
            at = int(length[:k].sum())
            ids = np.concatenate((ids[:at], two[1][len(two[0]):], ids[at + length[k]:]))
            length[k], parity[k] = len(two[1]) - len(two[0]), sound[:, 0].all()
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.first = np.concatenate((self.first, self.used + np.cumsum(length) - length))
        self.used += len(ids)
        self.length, self.parity = np.concatenate((self.length, length)), np.concatenate((self.parity, parity))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` one after another, their number in each text, and
        (parity, round trip) of each text."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if not self.by_word or MARK.encode() in raw or not _is_text(data, offsets):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids, good = self.texts(texts)
            return np.concatenate(ids or [np.zeros(0, np.int32)]), np.array([len(x) for x in ids], np.int64), good
        plain, own = data, offsets
        some = np.flatnonzero(np.diff(offsets))
        if self.model["dummy_prefix"]:  # the prefix, as a space before every text that isn't empty
            data = np.insert(data, offsets[some], 32)
            offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
            raw = data.tobytes()
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[some]] = True
        start = np.flatnonzero(start)
        offs = np.append(start, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        kept, at = utf8(coded.dictionary)
        kept, at = kept.tobytes(), at.tolist()
        words = [kept[a:b] for a, b in zip(at, at[1:])]
        new = [w for w in words if w not in self.place]
        if new:
            if len(self.place) + len(new) > self.WORDS:
                self._reset()
                new = words
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        doc = np.searchsorted(offsets, start, side="right") - 1
        length = self.length[at]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.first[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        count = np.bincount(doc, length, n).astype(np.int64)
        back, back_offsets = self.spell(ids, np.concatenate(([0], np.cumsum(count))))
        trip = _alike(back, np.diff(back_offsets), plain, np.diff(own))
        return ids, count, np.stack([np.bincount(doc, ~self.parity[at], n) == 0, trip], 1)


def _is_text(data: np.ndarray, offsets: np.ndarray) -> bool:
    """True if the bytes of every text are UTF-8."""
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return not (data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0 == 0x80).any()


_CODECS: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def _threads() -> None:
    """As many threads for the library as the task has cores."""
    context = TaskContext.get()
    os.environ.setdefault("RAYON_NUM_THREADS", str(context.cpus() if context else 1))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


def _encoder(sent, with_ids: bool, whole: bool):
    def run(batches):
        _threads()
        c = codec(sent.value)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in spans(offsets, CALL):
                ids, n, good = c.chunk(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ends = np.concatenate(([0], np.cumsum(n)))
                count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[ids])))[ends]).astype(np.int64)
                raw, at = ids.astype("<i4").tobytes(), (ends * 4).tolist()
                sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:])]
                columns = [b.column(0).slice(i, j - i), pa.array(n), pa.array(count(c.unknown)), pa.array(count(c.bytes_)), pa.array(sha, pa.string()),
                           pa.array(good[:, 0]), pa.array(good[:, 1])]
                names = ["row", "n_tokens", "n_unknown", "n_bytes", "ids_sha256", "words_parity", "round_trip"]
                if whole:
                    texts = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist())]
                    columns.append(pa.array(_alike(ids, n, *_flat(c.original.encode(texts, num_threads=1)))))
                    names.append("parity")
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode(docs: DataFrame, model: bytes, text: str = "text", carry: list[str] | None = None, with_ids: bool = True,
           whole: bool = False) -> DataFrame:
    """Encode every text.

    Returns ``row`` (struct of the ``carry`` columns, default all but the text), n_tokens, n_unknown,
    n_bytes (byte pieces), ids_sha256 (of the ids as little-endian 32-bit numbers),
    words_parity (the ids of each of its words are those of the original library, or the whole
    text's where words are not encoded apart), round_trip (decoding gives the normalised text),
    parity (if ``whole``: the whole text's ids, compared with the original library's) and ids
    (if ``with_ids``). A null text counts as empty and has no ids. Repeated
    rows are encoded alike; an empty table gives no rows.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    base = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))
    row = base.schema["row"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"row {row}, n_tokens long, n_unknown long, n_bytes long, ids_sha256 string, words_parity boolean, round_trip boolean"
    return base.mapInArrow(_encoder(sent, with_ids, whole), schema + ", parity boolean" * whole + ", ids array<int>" * with_ids)


def _decoder(sent):
    def run(batches):
        _threads()
        c = codec(sent.value)
        for b in batches:
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))))
            for i, j in spans(offsets, CALL):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), c.decode(b.column(1).slice(i, j - i))], names=["row", "text"])
    return run


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``row`` (struct of all other columns) and ``text``: the decoded ids of every row. Null
    ids give a null text, no ids an empty one."""
    base = encoded.select(F.struct(*[F.col(c) for c in encoded.columns if c != ids]).alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    row = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(_decoder(encoded.sparkSession.sparkContext.broadcast(model)), f"row {row}, text string")
