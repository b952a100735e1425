"""Near-duplicate documents by min-max hashing.

Word 5-shingles of every whole text are fingerprinted; under each of 64 hash functions both
the smallest and the largest value are kept, so 128 signature values cost 64 evaluations.
They form 32 bands of four values. Two sets of similarity 0.75 miss all 32 bands with
probability 5e-6. Every candidate is confirmed on the full shingle sets.

Documents with equal shingle sets are one class first (``class``, represented by its smallest
id), so groups of copies cost one member each. Classes that share a band bucket are then
linked without listing all pairs of a bucket:

* each class is first tested against the smallest class of its buckets, and confirmed links
  are joined into components;
* in buckets that still hold several components, members of different components are compared
  inside tasks, a bucket in blocks of a bounded number of shingles. One link for each two
  components of a block leaves the task.

So every candidate pair is either compared or already connected. A bucket that still is open
and larger than a block moves each member's set once for each of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship, spans, utf8
from driftgate.llm.graph import components
from driftgate.llm.kernels import CHUNK, word_prints
from driftgate.llm.tokens import mix

ship(__name__)

SHINGLE = 5
HASHES = 64
BANDS = 32
ROWS = 2 * HASHES // BANDS
SIMILARITY = (75, 100)
#: Size of a block of a bucket's members, in shingles; a member counts for MEMBER more. Two
#: blocks are compared in one task's memory.
BLOCK, MEMBER = 1 << 20, 1 << 10
_RNG = np.random.default_rng(3)
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_SHINGLE_MUL = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each document, one after another, and their
    document numbers. Fewer words than SHINGLE: the whole sequence as one."""
    h, d = word_prints(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(d, minlength=n)
    full = len(h) - SHINGLE + 1
    parts, owner = [], []
    if full > 0:
        own = d[:full] == d[SHINGLE - 1:]
        g = np.zeros(full, np.uint64)
        for j in range(SHINGLE):
            g += h[j:j + full] * _SHINGLE_MUL[j]
        parts.append(mix(g[own]))
        owner.append(d[:full][own])
    first = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        seq = h[first[i]:first[i + 1]]
        parts.append(mix((seq * _SHINGLE_MUL[:len(seq)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(seq))))
        owner.append(np.array([i]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], owner[new]


def signatures(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (sets x BANDS) and set digests (sets x 2) of sets that start at ``first``."""
    sets = len(first)
    values = np.empty((sets, 2 * HASHES), np.uint64)
    for j in range(HASHES):
        v = (g ^ _XOR[j]) * _MUL[j]
        values[:, 2 * j] = np.minimum.reduceat(v, first)
        values[:, 2 * j + 1] = np.maximum.reduceat(v, first)
    bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], sets, 0)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + mix(values[:, r::ROWS]))
    digest = np.stack([np.add.reduceat(g, first), np.add.reduceat(mix(g ^ _XOR[0]), first)], 1)
    return bands, digest


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sign(batches):
    """(id, text) -> (id, n_shingles, d1, d2, bands)."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        for i, j in spans(offsets, CHUNK):
            n = j - i
            g, owner = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            size = np.bincount(owner, minlength=n).astype(np.int64)
            some = np.flatnonzero(size)
            digest = np.zeros((n, 2), np.uint64)
            length = np.zeros(n, np.int64)
            bands = np.zeros((0, BANDS), np.uint64)
            if len(some):
                bands, digest[some] = signatures(g, (np.cumsum(size) - size)[some])
                length[some] = BANDS
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, n), pa.array(size), _longs(digest[:, 0]), _longs(digest[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends), _longs(bands.ravel()))],
                names=["id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches):
    """(id, text) -> (id, set): the sorted 64-bit fingerprints as bytes."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        for i, j in spans(offsets, CHUNK):
            g, owner = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=j - i)))) * 8
            sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(g.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), sets], names=["id", "set"])


def _confirm(batches):
    """(a, b, set_a, set_b) -> the pairs whose sets are similar enough."""
    num, den = SIMILARITY
    for batch in batches:
        sa, sb = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = np.frombuffer(sa[k].as_buffer(), np.uint64), np.frombuffer(sb[k].as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            both = int(np.count_nonzero(y[at] == x))
            keep[k] = den * both >= num * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _shared(first: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers of common elements of the sets ``rows`` with all sets that lie one after another."""
    m = len(first) - 1
    owner = np.repeat(np.arange(m), np.diff(first))
    order = np.argsort(values, kind="stable")
    v, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([True], v[1:] != v[:-1]))) - 1
    place = np.full(m, -1)
    place[rows] = np.arange(len(rows))
    # What stands in one set only, or in none of the rows, counts for no pair.
    used = (np.bincount(column) > 1) & (np.bincount(column, place[owner] >= 0) > 0)
    owner, column = owner[used[column]], column[used[column]]
    both = np.zeros((len(rows), m), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        width = max(1, (1 << 22) // m)
        for c in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, (c, c + width))
            part = np.zeros((m, width), np.float32)
            part[owner[lo:hi], column[lo:hi] - c] = 1
            both += part[rows] @ part.T
    return both


def _compare(table: pa.Table) -> pa.Table:
    """(bucket, i, j, id, comp, set) -> links that join components of a bucket's blocks."""
    num, den = SIMILARITY
    table = table.combine_chunks().sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
    keys = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("bucket", "i", "j")], 1)
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    ids = table.column("id").to_pylist()
    comps = [tuple(c.values()) if isinstance(c, dict) else c for c in table.column("comp").to_pylist()]  # ids of several columns are structs
    data, offsets = utf8(table.column("set"))
    a, b = [], []
    for lo, hi in zip(starts, np.append(starts[1:], len(keys))):
        numbers: dict = {}
        comp = np.array([numbers.setdefault(c, len(numbers)) for c in comps[lo:hi]])
        if len(numbers) < 2:
            continue
        # Only pairs of two components matter, and all but those have a side outside the largest.
        rows = np.flatnonzero(comp != np.bincount(comp).argmax())
        size = np.diff(offsets[lo:hi + 1]) // 8
        both = _shared((offsets[lo:hi + 1] - offsets[lo]) // 8, data[offsets[lo]:offsets[hi]].view(np.uint64), rows)
        x, y = np.nonzero((den * both >= num * (size[rows][:, None] + size[None, :] - both)) & (comp[rows][:, None] != comp[None, :]))
        x = rows[x]
        pair = np.minimum(comp[x], comp[y]) * len(numbers) + np.maximum(comp[x], comp[y])
        _, one = np.unique(pair, return_index=True)  # one link for each two components
        root = list(range(len(numbers)))

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for k, m in zip(x[one].tolist(), y[one].tolist()):
            p, q = find(int(comp[k])), find(int(comp[m]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(ids[lo + k])
                b.append(ids[lo + m])
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id linked directly
    or through others), kept (id = component_id).

    A null, empty or blank text has no shingles and is linked with nothing. A row without an
    id takes no part: no component, kept. Rows that repeat an id and its text get equal
    results; an empty table gives none. Other columns play no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    kind = docs.schema[id].dataType.simpleString()
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sig = scratch.write(base.mapInArrow(_sign, f"id {kind}, n_shingles long, d1 long, d2 long, bands array<long>"))
    some = sig.filter("n_shingles > 0 and id is not null")
    classes = scratch.write(some.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")))

    # Band rows of class representatives, in buckets that hold more than one class.
    reps = classes.select("rep", "d1", "d2", "n_shingles")
    rows = some.join(reps.withColumnRenamed("rep", "id"), ["id", "d1", "d2", "n_shingles"]).dropDuplicates(["id", "d1", "d2"]) \
        .select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    rows = scratch.write(rows)
    size = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("low")).filter("c > 1")
    bands = scratch.write(rows.join(size, "bucket").select("bucket", "id", "n", "low"))
    scratch.drop(rows)

    wanted = bands.select("id").distinct()
    sets = scratch.write(base.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets, f"id {kind}, set binary"))
    num, den = SIMILARITY

    def confirm(pairs: DataFrame) -> DataFrame:
        a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b") \
            .mapInArrow(_confirm, f"a {kind}, b {kind}").distinct()

    # Each class against the smallest class of its buckets.
    low = bands.filter("low < id").groupBy("id").agg(F.min("low").alias("a"))
    links = scratch.write(confirm(low.select("a", F.col("id").alias("b"))))
    comp = scratch.write(components(links, scratch))

    # Buckets that still hold several components, in blocks.
    live = bands.join(comp.withColumnRenamed("node", "id"), "id", "left") \
        .select("bucket", "id", "n", F.coalesce("component", "id").alias("comp"))
    open_ = live.groupBy("bucket").agg(F.sum(F.col("n") + MEMBER).alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")) \
        .filter("lo != hi").select("bucket", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    live = scratch.write(live.join(open_, "bucket"))
    size = live.agg(F.sum((F.col("n") + MEMBER) * F.col("blocks"))).first()[0]
    if size is not None:
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        live = live.withColumn("pair", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(own, b).alias("i"), F.greatest(own, b).alias("j")))))
        group = F.pmod(F.xxhash64("bucket", "pair"), F.lit(int(size // (2 * BLOCK)) + 1)).alias("g")
        members = live.join(sets, "id").select(group, "bucket", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "id", "comp", "set")
        more = members.groupBy("g").applyInArrow(_compare, f"a {kind}, b {kind}")
        links = links.union(scratch.write(more.distinct()))
        comp = scratch.write(components(links, scratch))
    by_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    by_class = scratch.write(by_class)
    out = sig.select("id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2", "n_shingles"], "left")
    comp_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    comp_id = F.when(F.col("id").isNotNull(), comp_id)
    return out.select("id", "n_shingles", comp_id.alias("component_id"),
                      F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
