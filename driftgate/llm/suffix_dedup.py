"""Repeated byte strings by counted fingerprints of sampled suffixes.

No Burrows-Wheeler transform is built (README says why, with figures). What is kept of the
merge of shard transforms is its refinement: intervals of suffixes that agree on a prefix are
split pass by pass, and those that are decided are left alone.

Every shard (a task's documents) samples the suffixes at its minimizers: for each start
``s`` the smallest 16-byte fingerprint of the next WINDOW places names an anchor ``m``, which
depends on the bytes after ``s`` only, so equal strings name equal anchors. A shard's suffixes
are never sorted together with another's. Their common order is refined as when Burrows-
Wheeler transforms are merged: an interval is the set of sampled suffixes that agree on a
common prefix; each pass lengthens the prefix, splits the intervals, and freezes those that
hold one string only. An interval is named by the fingerprint of its prefix, so a pass is one
count of fingerprints, pre-aggregated in every shard, and no interval is gathered in a task.

The symbols before an anchor (what a Burrows-Wheeler transform stores) extend it to the
left: with ``t = m - s``, a block of starts t0..t1 has the core ``[m - t0, m - t1 + LENGTH)``,
which all its windows share, and the string ``[m - t1, m - t0 + LENGTH)``, their union.

* A core found once: no window of the block is repeated. Done.
* A core whose strings are all equal: every window of the block is repeated. Done.
* Otherwise each distinct string is refined in smaller blocks, 256 -> 32 -> 4 -> 1 starts;
  strings found twice or more are repeated anyway and are refined (one of them) only as
  partners of the others.

A block of one start has its window as core and string, so the result is exact. Only distinct
strings of contested intervals are refined, whatever the number of their copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship, spans, utf8
from driftgate.llm.kernels import CHUNK, prefix, prints
from driftgate.llm.tokens import mix

ship(__name__)

LENGTH = 400
GRAM = 16
WINDOW = 256
BLOCKS = [32, 4, 1]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, window: int, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor, for documents lying one after another: document,
    anchor, first start, last start. Only starts whose window lies in their document count."""
    n = len(data)
    grams = n - GRAM + 1
    span = grams - window + 1
    z = np.zeros(0, np.int64)
    room = np.diff(offsets) - length + 1
    docs = np.flatnonzero(room > 0)
    if span <= 0 or not len(docs):
        return z, z, z, z
    at = np.arange(grams, dtype=np.int64)
    # The place in the low half makes the leftmost of equal fingerprints the smallest.
    v = (prints(sums, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -len(v) % window
    blocks = np.concatenate((v, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = (np.minimum(behind[:span], ahead[window - 1:window - 1 + span]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[docs], 1)
    np.add.at(valid, offsets[docs] + room[docs], -1)
    inside = np.cumsum(valid[:span]) > 0
    first = inside.copy()
    first[1:] &= (m[1:] != m[:-1]) | ~inside[:-1]
    starts_doc = np.zeros(n + 1, bool)
    starts_doc[offsets[docs]] = True
    first |= starts_doc[:span] & inside
    lo = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    hi = np.flatnonzero(last)
    return np.searchsorted(offsets, lo, side="right") - 1, m[lo], lo, hi


def _pieces(offsets: np.ndarray, extra: int):
    """(first document, offsets in the piece, byte start, byte end, start of the piece in its
    document). A document over the chunk is cut in pieces that overlap by ``extra`` bytes."""
    for i, j in spans(offsets, CHUNK):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= CHUNK + extra:
            yield i, offsets[i:j + 1] - a, a, b, 0
        else:
            for p in range(a, b, CHUNK):
                q = min(b, p + CHUNK + extra)
                yield i, np.array([0, q - p]), p, q, p - a
                if q == b:
                    break


def _sampler(length: int, window: int):
    def sample(batches):
        """(ka, kb, text) -> the runs with the fingerprints of core and string."""
        for b in batches:
            data, offsets = utf8(b.column(2))
            ka, kb = (np.asarray(b.column(c)) for c in (0, 1))
            for i, own, p, q, base in _pieces(offsets, length + window):
                piece = data[p:q]
                sums = prefix(piece)
                doc, m, lo, hi = anchors(piece, own, length, window, sums)
                if base + len(piece) < offsets[i + 1] - offsets[i] and len(own) == 2:
                    # Not the document's last piece: starts from CHUNK on belong to the next.
                    keep = lo < CHUNK
                    doc, m, lo, hi = doc[keep], m[keep], lo[keep], np.minimum(hi[keep], CHUNK - 1)
                if not len(doc):
                    continue
                core = prints(sums, m, m + length - window + 1)
                string = mix(prints(sums, lo, hi + length) + (m - lo).astype(np.uint64) * np.uint64(window + 1))
                shift = base - own[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ka[i + doc]), pa.array(kb[i + doc])] + [pa.array((x + shift).astype(np.int32)) for x in (m, lo, hi)]
                    + [pa.array(core.view(np.int64)), pa.array(string.view(np.int64))],
                    names=["ka", "kb", "m", "lo", "hi", "core", "string"])
    return sample


def _contexts(length: int):
    def cut(batches):
        """(ka, kb, text, runs) -> one row for each run, with the bytes of its windows."""
        for b in batches:
            data, offsets = utf8(b.column(2))
            runs = b.column(3)
            rows = runs.flatten()
            count = np.diff(np.asarray(runs.offsets))
            if not len(rows):
                continue
            own = np.repeat(np.arange(b.num_rows), count)
            lo, hi = np.asarray(rows.field("lo")).astype(np.int64), np.asarray(rows.field("hi")).astype(np.int64)
            raw = data.tobytes()
            start = offsets[own] + lo
            text = [raw[x:y] for x, y in zip(start.tolist(), (offsets[own] + hi + length).tolist())]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), rows.field("m"), rows.field("lo"), rows.field("hi"),
                 rows.field("active"), pa.array(text, pa.binary())],
                names=["ka", "kb", "m", "lo", "hi", "active", "bytes"])
    return cut


def _refiner(length: int, outer: int, inner: int):
    def refine(batches):
        """(ka, kb, m, lo, hi, active, bytes, t0) -> the blocks of ``inner`` starts in each
        block of ``outer`` starts from t0, cut to the run, with core and string."""
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = utf8(b.column(6))
            m, lo, hi, t0 = (np.asarray(b.column(c)).astype(np.int64) for c in (2, 3, 4, 7))
            for i, j in spans(offsets, CHUNK):
                sums = prefix(data[offsets[i]:offsets[j]])
                parts = outer // inner
                own = np.repeat(np.arange(i, j), parts)
                c0 = t0[own] + np.tile(np.arange(parts) * inner, j - i)
                tl, th = np.maximum(c0, m[own] - hi[own]), np.minimum(c0 + inner - 1, m[own] - lo[own])
                some = tl <= th
                own, c0, tl, th = own[some], c0[some], tl[some], th[some]
                zero = offsets[own] - offsets[i] + m[own] - lo[own]  # the anchor in this piece
                core = mix(prints(sums, zero - c0, zero - c0 - inner + 1 + length) + c0.astype(np.uint64))
                string = mix(prints(sums, zero - th, zero - tl + length) + (th * (outer + 1) + tl).astype(np.uint64))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), pa.array(c0.astype(np.int32)),
                     pa.array((m[own] - th).astype(np.int32)), pa.array((m[own] - tl).astype(np.int32)), b.column(5).take(take),
                     pa.array(core.view(np.int64)), pa.array(string.view(np.int64))],
                    names=["ka", "kb", "run", "t0", "s1", "s2", "active", "core", "string"])
    return refine


def _remover(length: int):
    def remove(batches):
        """(row, text, blocks) -> what is left of each document."""
        for b in batches:
            data, offsets = utf8(b.column(1))
            raw = data.tobytes()
            blocks = b.column(2)
            texts, out = [], []
            for k in range(b.num_rows):
                a, z = int(offsets[k]), int(offsets[k + 1])
                kept, whole, n_spans = raw[a:z], raw[a:z], 0
                if blocks[k].is_valid and len(blocks[k].values):
                    s1 = np.asarray(blocks[k].values.field("s1")).astype(np.int64)
                    s2 = np.asarray(blocks[k].values.field("s2")).astype(np.int64)
                    step = np.zeros(z - a + 1, np.int64)
                    np.add.at(step, s1, 1)
                    np.add.at(step, s2 + length, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    own = data[a:z]
                    kept = own[~gone].tobytes()
                    # Texts lose whole characters only: a character goes if all its bytes do.
                    head = np.flatnonzero((own & 0xC0) != 0x80)
                    whole_gone = np.logical_and.reduceat(gone, head)
                    whole = own[~np.repeat(whole_gone, np.diff(np.append(head, z - a)))].tobytes()
                texts.append(whole.decode("utf-8", "replace"))
                out.append((z - a, z - a - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            n, r, s, h = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())],
                names=["row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return remove


def _intervals(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of rows (rid, core, string, active, ...): those that are repeated, and those to refine
    (one for each string of a contested interval; active: not yet known to be repeated)."""
    groups = rows.groupBy("core").agg(F.count("*").alias("rows"), F.min("string").alias("lo_"), F.max("string").alias("hi_"))
    # Written, so that the join below shuffles both sides alike and a hot interval can be split.
    groups = scratch.write(groups.filter("rows > 1").select("core", (F.col("lo_") == F.col("hi_")).alias("one")))
    shared = scratch.write(rows.join(groups, "core"))
    contested = shared.filter("not one")
    strings = contested.groupBy("core", "string").agg(F.count("*").alias("copies"), F.min("rid").alias("rep"), F.max("active").alias("open"))
    strings = scratch.write(strings)
    undecided = scratch.write(strings.filter("copies = 1 and open").select("core").distinct().withColumn("refine", F.lit(True)))
    strings = strings.join(undecided, "core", "left").select("core", "string", "copies", "rep", F.coalesce("refine", F.lit(False)).alias("refine"))
    strings = scratch.write(strings.filter("copies > 1 or refine"))
    marked = scratch.write(contested.join(strings, ["core", "string"]))
    plain = [c for c in rows.columns]
    repeated = shared.filter("one").select(plain).union(marked.filter("copies > 1").select(plain))
    refine = marked.filter("refine and rid = rep").withColumn("active", F.col("active") & (F.col("copies") == 1)).select(plain)
    return repeated, refine


def repeated_blocks(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """(ka, kb, s1, s2): every ``length``-byte string that starts at s1..s2 of the document
    (ka, kb, text) also starts elsewhere, and no other does."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    window = min(WINDOW, length - GRAM, 2 * length // 3)  # a core is long enough to be rare
    window = 1 << (window.bit_length() - 1)
    runs = docs.mapInArrow(_sampler(length, window), "ka long, kb long, m int, lo int, hi int, core long, string long")
    runs = scratch.write(runs.select(F.monotonically_increasing_id().alias("rid"), "*", F.lit(True).alias("active")))
    repeated, refine = _intervals(runs, scratch)
    found = [repeated.select("ka", "kb", F.col("lo").alias("s1"), F.col("hi").alias("s2"))]
    lists = refine.groupBy("ka", "kb").agg(F.collect_list(F.struct("m", "lo", "hi", "active")).alias("runs"))
    contexts = docs.join(lists.hint("shuffle_hash"), ["ka", "kb"]).select("ka", "kb", "text", "runs") \
        .mapInArrow(_contexts(length), "ka long, kb long, m int, lo int, hi int, active boolean, bytes binary")
    contexts = scratch.write(contexts)
    scratch.drop(runs)
    todo, outer = contexts.withColumn("t0", F.lit(0)), window
    for inner in [b for b in BLOCKS if b < window]:
        cols = ["ka", "kb", "m", "lo", "hi", "active", "bytes", "t0"]
        blocks = todo.select(cols).mapInArrow(
            _refiner(length, outer, inner), "ka long, kb long, run int, t0 int, s1 int, s2 int, active boolean, core long, string long")
        blocks = scratch.write(blocks.select(F.monotonically_increasing_id().alias("rid"), "*"))
        repeated, refine = _intervals(blocks, scratch)
        found.append(repeated.select("ka", "kb", "s1", "s2"))
        todo = contexts.drop("active").join(refine.select("ka", "kb", F.col("run").alias("lo"), "t0", "active"), ["ka", "kb", "lo"])
        outer = inner
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text",
                 carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Remove from every text each byte covered by a ``length``-byte string that also starts
    anywhere else in the table (every copy goes, the first too).

    Returns ``row`` (struct of the ``carry`` columns, default all but the text), ``text``
    (what is left, in whole characters; only if ``with_text``), ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256`` of the bytes left. A null text counts as empty; rows are documents of
    their own, repeated rows too (they are copies). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    # Two 64-bit keys name a document by id and text together; rows that agree in both are
    # alike, and so are their results.
    base = docs.select(F.xxhash64(F.lit(1), F.col(id), F.col(text)).alias("ka"), F.xxhash64(F.lit(2), F.col(text), F.col(id)).alias("kb"),
                       F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).alias("text"))
    blocks = repeated_blocks(base.select("ka", "kb", "text"), length, scratch)
    blocks = blocks.distinct().groupBy("ka", "kb").agg(F.collect_list(F.struct("s1", "s2")).alias("blocks"))
    joined = base.join(blocks.hint("shuffle_hash"), ["ka", "kb"], "left").select("row", "text", "blocks")
    row = base.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_remover(length), f"row {row}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out if with_text else out.drop("text")
