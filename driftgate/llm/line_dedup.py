"""Reversible line dedup: exact reference counts and sharded cuckoo filters.

A line's key is the line stripped of ASCII white space with A-Z lower-cased, kept as its
128-bit xxh3. The reference table holds, for every key, in how many documents it
stands; it is exact and decides. Keys that reach the threshold are also held in cuckoo
filters, one for each shard of the key space, which answer "certainly not frequent" for
almost all lines before anything is joined. Documents can be added (+1 for each of their
keys) and deleted (-1); keys that cross the threshold are inserted in or deleted from their
shard's filter, so a deletion undoes an insertion.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship, spans, utf8
from driftgate.llm.kernels import CHUNK, SPACE
from driftgate.llm.tokens import FOLD, mix

ship(__name__)

MIN_DOCS = 10
#: Keys for which a shard's filter is laid out, slots of a bucket, moves before it grows.
SHARD_KEYS, SLOTS, MOVES = 1 << 15, 4, 500
#: Filters up to this size in all are sent to the tasks; beyond it lines go straight to the
#: exact join, which gives the same result.
FILTER_BYTES = 64 << 20


# ---------------------------------------------------------------------------- lines
def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents lying one after another: each line's document, start, end, both halves of
    its key, and whether the key is empty. Every document has one line at least."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
    # A newline that ends a document opens an empty line of it, before the next one's start.
    ends = np.sort(np.concatenate((cut, offsets[1:])), kind="stable")
    doc = np.cumsum(np.concatenate(([0], _doc_steps(cut, offsets))))[:len(start)]
    solid = np.flatnonzero(~SPACE[data]) if len(data) else np.zeros(0, np.int64)
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, ends)
    blank = a >= b
    s, e = start.copy(), ends.copy()
    s[~blank] = solid[a[~blank]]
    e[~blank] = solid[b[~blank] - 1] + 1
    e[blank] = s[blank]
    raw = FOLD[data].tobytes()
    keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(s.tolist(), e.tolist())]), "<u8").reshape(-1, 2)
    return doc, start, ends, keys[:, 0].copy(), keys[:, 1].copy(), blank


def _doc_steps(cut: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """After each line end, in order: 1 if it ends a document, 0 if it is a newline."""
    kinds = np.concatenate((np.zeros(len(cut), np.int64), np.ones(len(offsets) - 1, np.int64)))
    at = np.concatenate((cut, offsets[1:]))
    # A newline at the same place as a document's end belongs to the next document.
    return kinds[np.lexsort((1 - kinds, at))]


def _keys_of(batches):
    """(id, text) -> (id, k1, k2): the distinct keys of each document, empty ones left out."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        for i, j in spans(offsets, CHUNK):
            doc, _, _, k1, k2, blank = line_keys(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            order = np.lexsort((k2, k1, doc))
            order = order[~blank[order]]
            d, x, y = doc[order], k1[order], k2[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i).take(pa.array(d[new])), pa.array(x[new].view(np.int64)), pa.array(y[new].view(np.int64))],
                names=["id", "k1", "k2"])


def document_keys(docs: DataFrame, id: str, text: str) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_keys_of, f"id {kind}, k1 long, k2 long")


# ---------------------------------------------------------------------------- cuckoo filters
def _places(k1: np.ndarray, k2: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Tag (never 0) and the two buckets of keys; either bucket and the tag give the other."""
    tag = ((k1 >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
    tag[tag == 0] = 1
    one = (k2 & np.uint64(buckets - 1)).astype(np.int64)
    return tag, one, one ^ _other(tag, buckets)


def _other(tag: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(tag.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


class Cuckoo:
    """One shard's filter: buckets x SLOTS tags, 0 where free."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, buckets: int) -> Cuckoo:
        """A filter of these keys, with twice the buckets whenever they don't fit."""
        while True:
            made = cls(buckets)
            if made.insert(k1, k2):
                return made
            buckets *= 2

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place (the filter is then to be rebuilt, larger)."""
        tag, one, two = _places(k1, k2, self.buckets)
        for t, i, j in zip(tag.tolist(), one.tolist(), two.tolist()):
            if not (self._put(i, t) or self._put(j, t)):
                for step in range(MOVES):  # move a tag to its other bucket
                    at = (t + step) % SLOTS
                    old = int(self.slots[j, at])
                    self.slots[j, at] = t
                    t = old
                    j ^= int(_other(np.array([t], np.uint16), self.buckets)[0])
                    if self._put(j, t):
                        break
                else:
                    return False
        return True

    def _put(self, bucket: int, tag: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = tag
        return bool(len(free))

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that were inserted: one tag of either bucket."""
        tag, one, two = _places(k1, k2, self.buckets)
        for t, i, j in zip(tag.tolist(), one.tolist(), two.tolist()):
            for bucket in (i, j):
                at = np.flatnonzero(self.slots[bucket] == t)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        tag, one, two = _places(k1, k2, self.buckets)
        return ((self.slots[one] == tag[:, None]) | (self.slots[two] == tag[:, None])).any(1)


def _shard_of(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


FILTER_SCHEMA = "shard int, keys long, buckets int, slots binary"


def _unsigned(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["k1"].to_numpy(np.int64).view(np.uint64), pdf["k2"].to_numpy(np.int64).view(np.uint64)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    f = Cuckoo.of(*_unsigned(pdf), 1 << max(4, math.ceil(math.log2(len(pdf) / SLOTS / 0.85 + 1))))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "keys": [len(pdf)], "buckets": [f.buckets], "slots": [f.slots.tobytes()]})


def _change_shard(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its crossing keys: out first, then in. Empty if it overflowed
    (the caller rebuilds the filters from the reference table)."""
    if len(change) == 0:
        return old
    gone, new = change[change["up"] == 0], change[change["up"] == 1]
    n = (int(old["keys"].iloc[0]) if len(old) else 0) + len(new) - len(gone)
    if len(old) == 0:
        return _build_shard(new)
    f = Cuckoo(int(old["buckets"].iloc[0]), old["slots"].iloc[0])
    f.delete(*_unsigned(gone))
    ok = f.insert(*_unsigned(new))
    return pd.DataFrame({"shard": old["shard"], "keys": [n if ok else -1], "buckets": [f.buckets], "slots": [f.slots.tobytes()]})


# ---------------------------------------------------------------------------- the index
@dataclass
class LineIndex:
    """References (k1, k2, n_docs), exact; filters (shard, keys, buckets, slots); shards."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    scratch: Scratch

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, id: str = "doc_id", text: str = "text",
              keys: DataFrame | None = None, scratch: Scratch | None = None) -> LineIndex:
        scratch = scratch or Scratch(docs.sparkSession, "lines")
        keys = document_keys(docs, id, text) if keys is None else keys
        refs = scratch.write(keys.groupBy("k1", "k2").agg(F.count("*").alias("n_docs")))
        filters, shards = cls._filters(refs, min_docs, scratch)
        return cls(refs, filters, shards, min_docs, scratch)

    @staticmethod
    def _filters(refs: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, int]:
        frequent = refs.filter(F.col("n_docs") >= min_docs).select("k1", "k2")
        shards = max(1, math.ceil(frequent.count() / SHARD_KEYS))
        made = frequent.select(_shard_of(shards), "k1", "k2").groupBy("shard").applyInPandas(_build_shard, FILTER_SCHEMA)
        return scratch.write(made), shards

    def _apply(self, docs: DataFrame, sign: int, id: str, text: str) -> LineIndex:
        delta = document_keys(docs, id, text).groupBy("k1", "k2").agg((F.count("*") * sign).alias("by"))
        both = self.refs.join(delta, ["k1", "k2"], "full_outer").select(
            "k1", "k2", F.coalesce("n_docs", F.lit(0)).alias("old"),
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("n_docs"))
        both = self.scratch.write(both)
        refs = both.filter("n_docs != 0").select("k1", "k2", "n_docs")
        m = self.min_docs
        crossed = both.filter((F.col("old") >= m) != (F.col("n_docs") >= m)).select(
            _shard_of(self.shards), "k1", "k2", (F.col("n_docs") >= m).cast("int").alias("up"))
        filters = self.scratch.write(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
                                     .applyInPandas(_change_shard, FILTER_SCHEMA))
        shards = self.shards
        if filters.filter("keys < 0").limit(1).count():
            filters, shards = self._filters(refs, m, self.scratch)
        return LineIndex(refs, filters, shards, m, self.scratch)

    def insert(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> LineIndex:
        return self._apply(docs, 1, id, text)

    def delete(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> LineIndex:
        """Take documents out again that were inserted before."""
        return self._apply(docs, -1, id, text)

    def frequent(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (id, k1, k2) whose key is frequent: what the filters let
        through, confirmed by the reference table."""
        size = self.filters.agg(F.sum(F.col("buckets") * SLOTS * 2)).first()[0] or 0
        if size == 0:
            return keys.limit(0)
        if size <= FILTER_BYTES:
            sent = keys.sparkSession.sparkContext.broadcast(
                {r.shard: (r.buckets, bytes(r.slots)) for r in self.filters.toLocalIterator()})
            keys = keys.mapInArrow(_prober(sent, self.shards), keys.schema)
        exact = self.refs.filter(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        return keys.join(exact, ["k1", "k2"], "left_semi")


def _prober(sent, shards: int):
    def probe(batches):
        filters = {k: Cuckoo(n, slots) for k, (n, slots) in sent.value.items()}
        for b in batches:
            k1, k2 = (np.asarray(b.column(c)).astype(np.int64) for c in (1, 2))
            shard = np.mod(k1, shards)
            keep = np.zeros(b.num_rows, bool)
            for s, f in filters.items():
                at = np.flatnonzero(shard == s)
                keep[at] = f.holds(k1[at].view(np.uint64), k2[at].view(np.uint64))
            yield b.filter(pa.array(keep))
    return probe


# ---------------------------------------------------------------------------- dropping lines
def _drop(batches):
    """(row, text, x, y) -> (row, text, n_lines, n_dropped, kept_sha256); x and y hold the
    frequent keys of the document."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        if not len(data):
            data = np.zeros(0, np.uint8)
        xs, ys = b.column(2), b.column(3)
        texts, lines, dropped, shas = [], [], [], []
        for i, j in spans(offsets, CHUNK):
            own = offsets[i:j + 1] - offsets[i]
            piece = data[offsets[i]:offsets[j]]
            raw = piece.tobytes()
            doc, start, end, k1, k2, blank = line_keys(piece, own)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            for d in range(j - i):
                lo, hi = first[d], first[d + 1]
                kept = raw[own[d]:own[d + 1]]
                n = 0
                if xs[i + d].is_valid and len(xs[i + d].values):
                    x = np.asarray(xs[i + d].values).astype(np.int64).view(np.uint64)
                    y = np.asarray(ys[i + d].values).astype(np.int64).view(np.uint64)
                    pairs = set(zip(x.tolist(), y.tolist()))
                    hit = np.flatnonzero(np.isin(k1[lo:hi], x) & ~blank[lo:hi]).tolist()
                    out = {h for h in hit if (int(k1[lo + h]), int(k2[lo + h])) in pairs}
                    n = len(out)
                    if n:
                        kept = b"\n".join(raw[start[lo + h]:end[lo + h]] for h in range(hi - lo) if h not in out)
                texts.append(kept.decode("utf-8", "replace"))
                lines.append(int(hi - lo))
                dropped.append(n)
                shas.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())],
            names=["row", "text", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id: str = "doc_id", text: str = "text",
               carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Drop from every document the lines whose key stands in ``min_docs`` documents or more.

    Returns ``row`` (struct of the ``carry`` columns, default all but the text), ``text``
    (what is left; only if ``with_text``), ``n_lines``, ``n_dropped``, ``kept_sha256``. A null or empty
    text has one empty line; lines without a key are never dropped. Every row counts as a
    document, repeated rows and rows without an id too. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    # Rows that agree in id and text share a name, and their keys; no others do.
    name = F.struct(F.xxhash64(F.lit(1), F.col(id), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(text), F.col(id)).alias("b"))
    base = docs.select(name.alias("k"), F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))
    keys = scratch.write(document_keys(base, "k", "text"))
    index = LineIndex.build(base, min_docs, "k", "text", keys=keys, scratch=scratch)
    # A key that many documents share is spread by document; a set is bounded by one text.
    found = index.frequent(keys).groupBy(F.col("id").alias("k")).agg(F.collect_set(F.struct("k1", "k2")).alias("s"))
    found = found.select("k", F.col("s.k1").alias("x"), F.col("s.k2").alias("y"))
    joined = base.join(found.hint("shuffle_hash"), "k", "left").select("row", "text", "x", "y")
    row = base.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_drop, f"row {row}, text string, n_lines long, n_dropped long, kept_sha256 string")
    return out if with_text else out.drop("text")
