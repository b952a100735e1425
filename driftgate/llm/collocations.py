"""Phrase collocations by SON partitioning.

The partitions of the input are dealt to shards. Each shard is mined completely at proportionally
lowered support: with ``support`` of the whole and a shard that holds n_s of its language's n
words, phrases of ``ceil(support * n_s / n)`` occurrences or more in the shard. A phrase that
reaches the support in all reaches the lowered one in some shard, so the union of the shards'
phrases misses none; one more pass over all texts counts every candidate of the union exactly.

A shard is a share of the corpus, not a task: its counts are pre-aggregated where the texts
lie and shuffled by phrase, so it may be of any size and a frequent phrase meets in one row a
task. What cannot reach the support is left out before it is counted: words below the support
end a phrase; a phrase must fall into a bucket of a count sketch that reaches it; one of three
or four words is counted only if the two phrases one shorter inside it reached their shard's
support. Sketch and bit tables have a fixed size and never say no wrongly; a wrong yes costs a count, not a
result.

A word is its 64-bit xxh3, which is checked to be one-to-one on the corpus' words (else a
new seed is taken); a phrase is the list of its words' hashes, so equal keys are equal phrases.
Texts are cut into words twice, to count the words and to write the hashes of the frequent
ones; the later passes read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship, spans, utf8
from driftgate.llm.tokens import flags, hash64, mix, segments, tokens

ship(__name__)

SUPPORT, LONGEST, TOP = 30, 4, 2000
#: A longer phrase that stands for at least this share of a phrase's occurrences hides it.
HIDDEN = (80, 100)
#: Shards of the corpus: with 8, a shard of average size keeps what it holds 4 times.
SHARDS = 8
#: Keys over which a frequent word's rows are dealt in joins.
SALTS = 16
#: Bits of a table asked by tasks, buckets of the sketch, and the blocks in which both move.
BITS, SKETCH, BLOCK = 1 << 26, 1 << 24, 1 << 17
#: Bytes of text, bytes of hashes and counted phrases handled at once in a task.
SEGMENT, SLICE, TALLY = 1 << 20, 1 << 20, 1 << 18
PIECE_END = flags(b".,;:!?\n\x0b\x0c\r")
GAP = flags(b".,;:!?\n\x0b\x0c\r \t")
WORDS = ["w1", "w2", "w3", "w4"]
_RNG = np.random.default_rng(13)
_MUL = _RNG.integers(0, 1 << 63, LONGEST + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------------------- bit tables
def _slots(words: list[np.ndarray], salt: np.ndarray, size: int = BITS) -> np.ndarray:
    """A place for each phrase (the arrays hold its first, second ... word) of a language, or
    of a language and shard."""
    g = salt * _MUL[LONGEST + 1] + np.uint64(len(words))
    for j, w in enumerate(words):
        g = g + w * _MUL[j]
    return (mix(g) & np.uint64(size - 1)).astype(np.int64)


def _salts(langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct languages, a number for each, and each row's place among them."""
    coded = langs.dictionary_encode()
    return coded.dictionary, hash64(coded.dictionary, 1), np.asarray(coded.indices).astype(np.int64)


def _of_shard(salt: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return mix(salt + shard.astype(np.uint64))


def _packed_slots(at: np.ndarray):
    """Places as one row a block: (block, places in it as 32-bit numbers)."""
    at = np.unique(at)
    edge = np.flatnonzero(np.concatenate(([True], at[1:] // BLOCK != at[:-1] // BLOCK))) if len(at) else np.zeros(0, np.int64)
    inside = (at % BLOCK).astype("<u4")
    parts = [inside[a:b].tobytes() for a, b in zip(edge.tolist(), np.append(edge[1:], len(at)).tolist())]
    return pa.RecordBatch.from_arrays([pa.array((at[edge] // BLOCK).astype(np.int32)), pa.array(parts, pa.binary())], names=["block", "places"])


def _phrase_slots(length: int, sharded: bool):
    """(packed) phrases of a length, as their language, shard and words -> (block, places)."""
    def run(batches):
        for b in batches:
            for packed in b.column(0):
                c = _unpacked(packed.as_buffer(), length + 3)
                salt = _of_shard(c[0], c[1]) if sharded else c[0]
                yield _packed_slots(_slots(list(c[2:2 + length]), salt))
    return run


def _word_slots(batches):
    """(salt, w1) -> (block, places)."""
    for b in batches:
        salt, w = (np.asarray(b.column(c)).view(np.uint64) for c in (0, 1))
        yield _packed_slots(_slots([w], salt))


def _bit_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOCK, np.uint8)
    for b in batches:
        for places in b.column("places"):
            bits[np.frombuffer(places.as_buffer(), "<u4")] = 1
    out = np.packbits(bits, bitorder="little").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "bits"])


def _collected(blocks: DataFrame, size: int):
    """A broadcast table of ``size`` bits, whatever the rows, from its (block, bits)."""
    table = np.zeros(size // 8, np.uint8)
    for r in blocks.collect():
        table[r.block * (BLOCK // 8):(r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(table)


def _bit_table(places: DataFrame):
    """A broadcast bit table of (block, places)."""
    return _collected(places.groupBy("block").applyInArrow(_bit_block, "block int, bits binary"), BITS)


def _holds(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------------------- texts to words
def _read(batches, seed: int):
    """Per segment of (lang, text): the languages, their numbers, each row's language, the
    distinct words, their hashes, and of each word: its number, row, and piece."""
    for b in batches:
        names, numbers, lang = _salts(b.column(0))
        data, offsets = utf8(b.column(1))
        for lo, own, piece in segments(data, offsets, PIECE_END, SEGMENT):
            words, start, doc = tokens(piece, own, GAP)
            if len(words):
                coded = words.dictionary_encode()
                ends = np.cumsum(PIECE_END[piece], dtype=np.int32)[start]
                yield names, numbers, lang, coded.dictionary, hash64(coded.dictionary, seed), np.asarray(coded.indices), doc + lo, ends


def _words_in(seed: int):
    def run(batches):
        """(lang, text) -> (lang, salt, word, hash, times)."""
        for names, numbers, lang, words, hashes, index, row, _ in _read(batches, seed):
            times = np.bincount(index.astype(np.int64) * len(names) + lang[row], minlength=len(words) * len(names))
            key = np.flatnonzero(times)
            which = key // len(names)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(key % len(names))), pa.array(numbers[key % len(names)].view(np.int64)), words.cast(pa.string()).take(pa.array(which)),
                 pa.array(hashes[which].view(np.int64)), pa.array(times[key].astype(np.int64))], names=["lang", "salt", "word", "hash", "times"])
    return run


def _hashed(seed: int, shards: int, frequent):
    def run(batches):
        """(lang, text) -> (lang, salt, shard, n, words): the language's number, the number of all words, and the hashes of
        the frequent ones with a 0 where a phrase ends: at other words and at pieces' ends."""
        table, shard = frequent.value, TaskContext.get().partitionId() % shards
        for names, numbers, lang, _, hashes, index, row, piece in _read(batches, seed):
            h = hashes[index]
            h[~_holds(table, _slots([h], numbers[lang[row]]))] = 0
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            cut = np.concatenate(([True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])))
            # A 0 before each piece; then no two in a row.
            at = np.arange(len(h)) + np.cumsum(cut)
            out = np.zeros(int(at[-1]) + 1, np.uint64)
            out[at] = h
            begin = at[first] - 1
            keep = np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))
            keep[begin] = True
            ends = np.append(begin, len(out))
            size = np.add.reduceat(keep, begin) * 8
            rows = row[first]
            bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out[keep].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(lang[rows])), pa.array(numbers[lang[rows]].view(np.int64)), pa.array(np.full(len(rows), shard, np.int32)),
                 pa.array(np.diff(np.append(first, len(row))).astype(np.int64)), blobs], names=["lang", "salt", "shard", "n", "words"])
    return run


# ---------------------------------------------------------------------------- words to phrases
def _runs(batches):
    """Per slice of (salt, shard, words): for each word or 0 its hash, its language's number
    and its shard."""
    for b in batches:
        salt, shard = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).astype(np.uint64)
        data, offsets = utf8(b.column(2))
        for i, j in spans(offsets, SLICE):
            h = np.frombuffer(data[offsets[i]:offsets[j]].tobytes(), np.uint64)
            row = np.repeat(np.arange(i, j), np.diff(offsets[i:j + 1]) // 8)
            yield h, salt[row], shard[row]


def _grams(h: np.ndarray, length: int) -> np.ndarray:
    """Where a phrase of ``length`` words starts."""
    n = max(0, len(h) - length + 1)
    some = h != 0
    live = some[:n].copy()
    for j in range(1, length):
        live &= some[j:n + j]
    return np.flatnonzero(live)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    return mix(sum((c * _MUL[j] for j, c in enumerate(columns)), np.uint64(0)))


def _summed(columns: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each distinct row of the columns with the sum of its times, in the order of ``_key``.
    Rows of one key that are not equal may stay apart; they are added up when all meet."""
    order = np.argsort(_key(columns), kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    edge = np.flatnonzero(new)
    return [c[order[edge]] for c in columns], np.add.reduceat(times[order], edge) if len(edge) else times


def _unpacked(buffer, columns: int) -> np.ndarray:
    return np.frombuffer(buffer, np.uint64).reshape(columns, -1)


def _packed(columns: list[np.ndarray], times: np.ndarray) -> bytes:
    return np.stack([*columns, times.astype(np.uint64)]).tobytes()


class _Tally:
    """Counts of a task's phrases, kept together until there are TALLY of them; they leave as
    one row a bucket: (bucket, columns and times of its phrases)."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.rows = buckets, [], 0

    def add(self, columns: list[np.ndarray]):
        self.parts.append(_summed(columns, np.ones(len(columns[0]), np.int64)))
        self.rows += len(self.parts[-1][1])
        if self.rows > TALLY:
            columns, times = self._joined()
            if len(times) > TALLY // 2:
                yield self._batch(columns, times)
                self.parts, self.rows = [], 0
            else:
                self.parts, self.rows = [(columns, times)], len(times)

    def rest(self):
        if self.rows:
            yield self._batch(*self._joined())

    def _joined(self):
        return _summed([np.concatenate(c) for c in zip(*[p[0] for p in self.parts])], np.concatenate([p[1] for p in self.parts]))

    def _batch(self, columns: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
        bucket = (_key(columns) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        some = np.flatnonzero(np.diff(edge))
        blobs = [_packed([c[order[edge[k]:edge[k + 1]]] for c in columns], times[order[edge[k]:edge[k + 1]]]) for k in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "packed"])


def _gathered(batches, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A bucket's phrases from all tasks, each once, with the sum of its times."""
    parts, rows = [], 0
    for b in batches:
        for packed in b.column("packed"):
            c = _unpacked(packed.as_buffer(), width)
            parts.append(c)
            rows += c.shape[1]
            if rows > TALLY and len(parts) > 1:
                parts = [_total(parts)]
                rows = min(parts[0].shape[1], TALLY // 2)
    c = _total(parts)
    return list(c[:-1]), c[-1].astype(np.int64)


def _total(parts: list[np.ndarray]) -> np.ndarray:
    """Equal columns are brought together by sorting on all of them."""
    c = np.concatenate(parts, 1)
    order = np.lexsort(c[:-1])
    c = c[:, order]
    edge = np.flatnonzero(np.concatenate(([True], (c[:-1, 1:] != c[:-1, :-1]).any(0)))) if c.shape[1] else np.zeros(0, np.int64)
    return np.concatenate((c[:-1, edge], np.add.reduceat(c[-1], edge)[None, :] if len(edge) else c[-1:]))


def _count_type(support: int):
    return np.dtype("u1") if support < 256 else np.dtype("<u4")


def _sketch(longest: int, support: int):
    def run(batches):
        """(salt, shard, words) -> (block, counts): the task's phrases in buckets, capped; few
        of them as (place, count) pairs."""
        counts = np.zeros(SKETCH, np.uint16 if support < 256 else np.uint32)
        step = (1 << 16) // LONGEST - support if support < 256 else 1 << 16  # no sum before it is capped can overflow
        for h, salt, _ in _runs(batches):
            at = np.concatenate([_slots([h[g + j] for j in range(n)], salt[g], SKETCH) for n in range(2, longest + 1) for g in [_grams(h, n)]])
            for a in range(0, len(at), step):
                some = at[a:a + step]
                np.add.at(counts, some, counts.dtype.type(1))
                counts[some] = np.minimum(counts[some], support)
        counts = counts.reshape(-1, BLOCK)
        for k in np.flatnonzero(counts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_block_bytes(counts[k], support)], pa.binary())], names=["block", "counts"])
    return run


def _block_bytes(counts: np.ndarray, support: int) -> bytes:
    """A block's counts: all of them, or the places and counts of those above 0, if shorter."""
    kind, at = _count_type(support), np.flatnonzero(counts)
    if len(at) * (4 + kind.itemsize) + 1 >= BLOCK * kind.itemsize:
        return counts.astype(kind).tobytes()
    return b"s" + at.astype("<u4").tobytes() + counts[at].astype(kind).tobytes()


def _add_block(total: np.ndarray, data: bytes, support: int) -> None:
    kind = _count_type(support)
    if len(data) == BLOCK * kind.itemsize:
        np.minimum(total + np.frombuffer(data, kind), support, out=total)
    else:
        n = (len(data) - 1) // (4 + kind.itemsize)
        at = np.frombuffer(data, "<u4", n, 1)
        total[at] = np.minimum(total[at] + np.frombuffer(data, kind, n, 1 + 4 * n), support)


def _add(support: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of a block's counts, capped; at ``last``, as bits: support reached or not."""
        total = np.zeros(BLOCK, np.int64)
        for b in batches:
            for c in b.column("counts"):
                _add_block(total, c.as_py(), support)
        out = np.packbits(total >= support, bitorder="little").tobytes() if last else _block_bytes(total, support)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "bits" if last else "counts"])
    return run


def _local(length: int, buckets: int, full, below):
    def run(batches):
        """(salt, shard, words) -> (bucket, packed): counts of the phrases that may reach their
        shard's support: those of a ``full`` bucket of the sketch, and of three words or more
        only if both parts one shorter are in the shard's bit table ``below``."""
        reached, tally = full.value, _Tally(buckets)
        for h, salt, shard in _runs(batches):
            at = _grams(h, length)
            if length > 2:
                part = _grams(h, length - 1)
                known = np.zeros(len(h) + 1, bool)
                known[part] = _holds(below.value, _slots([h[part + j] for j in range(length - 1)], _of_shard(salt[part], shard[part])))
                at = at[known[at] & known[at + 1]]
            at = at[_holds(reached, _slots([h[at + j] for j in range(length)], salt[at], SKETCH))]
            yield from tally.add([salt[at], shard[at], *[h[at + j] for j in range(length)]])
        yield from tally.rest()
    return run


def _supported(length: int, lowered):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's phrases that reach their shard's lowered support, packed."""
        columns, times = _gathered(batches, length + 3)
        group = columns[0] * _MUL[0] + columns[1]
        _, first, which = np.unique(group, return_index=True, return_inverse=True)
        least = np.array([lowered.value[int(columns[0][k]), int(columns[1][k])] for k in first.tolist()], np.int64)
        keep = times >= least[which]
        yield pa.RecordBatch.from_arrays([pa.array([_packed([c[keep] for c in columns], times[keep])], pa.binary())], names=["packed"])
    return run


def _exact(longest: int, buckets: int, asked):
    def run(batches):
        """(salt, shard, words) -> (bucket, packed): counts of every candidate."""
        table, tally = asked.value, _Tally(buckets)
        for h, salt, _ in _runs(batches):
            for length in range(2, longest + 1):
                at = _grams(h, length)
                at = at[_holds(table, _slots([h[at + j] for j in range(length)], salt[at]))]
                none = np.zeros(len(at), np.uint64)
                yield from tally.add([salt[at], *[h[at + j] if j < length else none for j in range(LONGEST)]])
        yield from tally.rest()
    return run


def _counted(support: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's phrases that reach the support: (salt, w1..w4, f)."""
        columns, times = _gathered(batches, LONGEST + 2)
        keep = times >= support
        yield pa.RecordBatch.from_arrays([*[pa.array(c[keep].view(np.int64)) for c in columns], pa.array(times[keep])], names=["salt", *WORDS, "f"])
    return run


# ---------------------------------------------------------------------------- mining
class Corpus:
    """A corpus as word hashes: ``words`` (lang, salt, word, w1, f) of the support, ``rows``
    (lang, salt, shard, n, words) and ``totals`` (lang, salt, n)."""

    def __init__(self, docs: DataFrame, scratch: Scratch, lang: str, text: str, shards: int, support: int):
        self.scratch, self.support, seed = scratch, support, 0
        base = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
        while True:
            found = base.mapInArrow(_words_in(seed), "lang string, salt long, word string, hash long, times long")
            every = scratch.write(found.groupBy("lang", "salt", "word").agg(F.max("hash").alias("hash"), F.sum("times").alias("times")))
            # Two words of one hash would differ in another hash.
            apart = every.groupBy("hash").agg(F.min(F.xxhash64("word")).alias("a"), F.max(F.xxhash64("word")).alias("b")).filter("a != b or hash = 0")
            if not apart.limit(1).count():
                break
            seed += 1
        frequent = every.filter(F.col("times") >= support).select("lang", "salt", "word", F.col("hash").alias("w1"), F.col("times").alias("f"))
        self.words = scratch.write(frequent.hint("rebalance"))
        scratch.drop(every)
        frequent = _bit_table(self.words.select("salt", "w1").mapInArrow(_word_slots, "block int, places binary"))
        self.rows = scratch.write(base.mapInArrow(_hashed(seed, shards, frequent), "lang string, salt long, shard int, n long, words binary"))
        frequent.destroy()
        sizes = scratch.write(self.rows.groupBy("lang", "salt", "shard").agg(F.sum("n").alias("n_s")))
        self.totals = sizes.groupBy("lang", "salt").agg(F.sum("n_s").alias("n"))
        each = [r.asDict() for r in sizes.collect()]  # one row for each language and shard
        n: dict[int, int] = {}
        for r in each:
            n[r["salt"]] = n.get(r["salt"], 0) + r["n_s"]
        unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
        lowered = {(unsigned(r["salt"]), r["shard"]): -(-support * r["n_s"] // n[r["salt"]]) for r in each}
        self.lowered = docs.sparkSession.sparkContext.broadcast(lowered)
        # Buckets of phrases small enough for a task, whatever the words.
        self.buckets = max(64, sum(n.values()) // 500_000)

    def _phrases(self, task, schema: str) -> DataFrame:
        return self.rows.select("salt", "shard", "words").mapInArrow(task, schema)

    def full_buckets(self, longest: int):
        """The sketch: which buckets of phrases reach the support in all. Summed in two steps."""
        blocks = self._phrases(_sketch(longest, self.support), "block int, counts binary")
        blocks = blocks.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        blocks = blocks.groupBy("block", "part").applyInArrow(_add(self.support, False), "block int, counts binary")
        return _collected(blocks.groupBy("block").applyInArrow(_add(self.support, True), "block int, bits binary"), SKETCH)

    def local(self, length: int, full, below) -> DataFrame:
        """Each shard's phrases of a length at its lowered support, packed."""
        found = self._phrases(_local(length, self.buckets, full, below), "bucket int, packed binary")
        return self.scratch.write(found.groupBy("bucket").applyInArrow(_supported(length, self.lowered), "packed binary"))


def frequent_phrases(corpus: Corpus, longest: int = LONGEST) -> DataFrame:
    """(lang, words, f): the phrases of 2 to ``longest`` words that reach the support, counted
    over all texts; ``words`` holds their hashes."""
    scratch, union = corpus.scratch, None
    full, below = corpus.full_buckets(longest), None
    for length in range(2, longest + 1):
        local = corpus.local(length, full, below)
        if below is not None:
            below.destroy()
        below = _bit_table(local.mapInArrow(_phrase_slots(length, True), "block int, places binary"))
        own = local.mapInArrow(_phrase_slots(length, False), "block int, places binary")
        union = own if union is None else union.union(own)
    below.destroy()
    full.destroy()
    asked = _bit_table(union)
    exact = corpus._phrases(_exact(longest, corpus.buckets, asked), "bucket int, packed binary")
    exact = exact.groupBy("bucket").applyInArrow(_counted(corpus.support), "salt long, " + "".join(f"{w} long, " for w in WORDS) + "f long")
    exact = exact.join(corpus.totals.select("lang", "salt"), "salt")
    out = scratch.write(exact.select("lang", F.filter(F.array(*WORDS), lambda w: w != 0).alias("words"), "f").hint("rebalance"))
    asked.destroy()
    return out


def _scores(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (lang, words, f) with l, r and score of their lowest-scoring cut."""
    size = F.size("words")
    cuts = candidates.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cuts.select("lang", "words", "f", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.slice("words", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("part")))).alias("p"))
    parts = parts.select("lang", "words", "f", "k", "p.left", "p.part")
    # A frequent word is a part of very many candidates: its rows are dealt over SALTS keys.
    salted = counts.select("lang", F.col("words").alias("part"), F.col("f").alias("own"),
                           F.explode(F.when(F.size("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    parts = parts.withColumn("salt", F.when(F.size("part") == 1, F.pmod(F.xxhash64("words"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    found = parts.join(salted, ["lang", "part", "salt"])
    cut = found.groupBy("lang", "words", "f", "k").agg(F.max(F.when(F.col("left"), F.col("own"))).alias("l"), F.max(F.when(~F.col("left"), F.col("own"))).alias("r"))
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(18)) * cast(f as decimal(20))) div (cast(l as decimal(20)) + r)"))
    return cut.groupBy("lang", "words", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")) \
        .select("lang", "words", F.col("f").alias("a"), "c.l", "c.r", "c.score")


def _hidden(candidates: DataFrame) -> DataFrame:
    """(lang, words, most): the most frequent longer candidate around each phrase inside one."""
    size = F.size("words")
    inner = candidates.filter(size > 2).select("lang", "f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("words", at, n))))).alias("words"))
    return inner.groupBy("lang", "words").agg(F.max("f").alias("most"))


def _spell(corpus: Corpus, phrases: DataFrame) -> DataFrame:
    """``phrases`` (lang, words, ...) with their text: words looked up by hash."""
    wanted = corpus.words.select(F.col("w1").alias("w"), "word").distinct()
    each = phrases.select("lang", "words", F.posexplode("words").alias("at", "w"))
    need = each.select("w").distinct().join(wanted, "w")
    salted = need.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int"))
    spelt = each.join(salted, ["w", "salt"]).groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s"))
    spelt = spelt.select("lang", "words", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(spelt, ["lang", "words"])


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, longest: int = LONGEST, shards: int = SHARDS,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's ``top`` phrases: lang, rank (long, from 1), phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words found ``support`` times or more; the score is that of
    the lowest-scoring cut in two, the first such cut if several. Phrases that a longer one
    stands for are dropped. A null language is ``und``; a null or empty text has no words;
    repeated rows count each time; an empty table gives no rows. Other columns play no part.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    scratch = Scratch(docs.sparkSession, "phrases")
    corpus = Corpus(docs, scratch, lang, text, shards, support)
    candidates = frequent_phrases(corpus, longest)
    counts = candidates.union(corpus.words.select("lang", F.array("w1").alias("words"), "f"))
    scored = _scores(candidates, counts).join(_hidden(candidates), ["lang", "words"], "left")
    num, den = HIDDEN
    shown = F.col("most").isNull() | (F.col("most").cast("decimal(20)") * den < F.col("a").cast("decimal(20)") * num)
    scored = scored.filter(shown).drop("most")
    # Only what can be among the first is spelt: all that tie with the last place, too.
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = scratch.write(scored.withColumn("place", F.rank().over(by)).filter(F.col("place") <= top).drop("place"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = _spell(corpus, first).withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(corpus.totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
