"""Exact ranked lexical search with two hierarchies.

A document is a sparse vector: for each of its terms the saturated frequency
``(1000000000 * tf) div (1000 * tf + 8 * m)``; an item's coordinate is the term's weight times
its occurrences in the item. The score is their inner product, all in whole numbers.

Both sides get a hierarchy whose nodes hold the maximum of every coordinate below them:
items -> groups -> batch, documents -> leaves -> branches -> chunk. Documents are first laid
out by their heaviest terms (range partitioned, so a hot term is split), which keeps like
documents in one leaf. The product of two nodes' maxima bounds every score below the pair; if
it is less than the weakest kth score of the pair's items, the whole batch of pairs is
pruned. Nothing else is: a pair is either bounded away or scored exactly.

A first descent (each chunk's most promising leaf of every item) gives every item a kth score
to start from, so that all tasks prune alike; each task raises its own from there. What leaves
a task is at most k rows an item.

Items are taken in passes whose vocabulary stays below VOCABULARY bytes (it is sent to the
tasks); further items take further passes over the documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship, utf8
from driftgate.llm.tokens import flags, segments, tokens

ship(__name__)

K = 10
#: Bytes of a pass's (item, term) table; items of a batch, of a group; documents of a chunk,
#: a branch, a leaf.
VOCABULARY = 32 << 20
BATCH, GROUP = 256, 16
CHUNK, BRANCH, LEAF = 4096, 512, 64
#: Candidates kept for an item before they are cut back to k.
SLACK = 1 << 16
#: What stands between terms: all ASCII but digits and letters.
BETWEEN = flags(bytes(b for b in range(128) if not chr(b).isalnum()))


# ---------------------------------------------------------------------------- vectors
def _item_terms(batches):
    """(key, text) -> (key, term, times)."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        for lo, own, piece in segments(data, offsets, BETWEEN):
            words, _, doc = tokens(piece, own, BETWEEN)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo)), words.cast(pa.string()), pa.array(np.ones(len(doc), np.int64))],
                                             names=["key", "term", "times"])


def _vectorise(sent):
    def run(batches):
        """(doc_id, text) -> (doc_id, n, tids, tfs): all terms are counted in n, the pass's
        are listed."""
        vocabulary = pa.array(sent.value, pa.binary())
        for b in batches:
            data, offsets = utf8(b.column(1))
            n = np.zeros(b.num_rows, np.int64)
            docs, tids = [], []
            for lo, own, piece in segments(data, offsets, BETWEEN):
                words, _, doc = tokens(piece, own, BETWEEN)
                n += np.bincount(doc + lo, minlength=b.num_rows)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                known = np.asarray(pc.index_in(coded.dictionary, vocabulary).fill_null(-1)).astype(np.int64)[np.asarray(coded.indices)]
                docs.append((doc + lo)[known >= 0])
                tids.append(known[known >= 0])
            doc, tid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, tids))
            pair, tf = np.unique(doc * max(len(vocabulary), 1) + tid, return_counts=True)
            doc, tid = pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (tid.astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "tids", "tfs"])
    return run


def _count_terms(batches):
    """(tids) -> (tid, df) of each batch."""
    for b in batches:
        tid, df = np.unique(np.asarray(b.column(0).flatten()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tid.astype(np.int32)), pa.array(df.astype(np.int64))], names=["tid", "df"])


def _coordinates(n_docs: int, n_terms: int, weights):
    def run(batches):
        """(doc_id, n, tids, tfs) -> (doc_id, t1, t2, tids, xs); t1 and t2 name the two heaviest
        terms. Documents without a term of the pass score 0 and are left out."""
        w = weights.value
        for b in batches:
            lists, n = b.column(2), np.asarray(b.column(1))
            tid, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(b.column(3).flatten())
            count = np.diff(np.asarray(lists.offsets))
            some = np.flatnonzero(count)
            if not len(some):
                continue
            m = np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n[some]], np.int64)
            x = (1000000000 * tf) // (1000 * tf + 8 * np.repeat(m, count[some]))
            first = np.concatenate(([0], np.cumsum(count[some])))
            heavy = w[tid] * x
            order = np.lexsort((-heavy, np.repeat(np.arange(len(some)), count[some])))
            t1, t2 = tid[order[first[:-1]]], tid[order[np.minimum(first[:-1] + 1, first[1:] - 1)]]
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v)) for v in (tid.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(t1.astype(np.int32)), pa.array(t2.astype(np.int32)), *lists],
                                             names=["doc_id", "t1", "t2", "tids", "xs"])
    return run


# ---------------------------------------------------------------------------- hierarchies
def _nodes(first: np.ndarray, tid: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Coordinate maxima of runs of ``size`` rows: node offsets, terms, maxima."""
    node = np.repeat(np.arange(len(first) - 1) // size, np.diff(first))
    order = np.lexsort((tid, node))
    node, tid, x = node[order], tid[order], x[order]
    edge = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (tid[1:] != tid[:-1])))) if len(tid) else np.zeros(0, np.int64)
    count = -(-(len(first) - 1) // size)
    top = np.maximum.reduceat(x, edge) if len(edge) else x
    return np.searchsorted(node[edge], np.arange(count + 1)), tid[edge], top


@dataclass
class DocumentTree:
    """A chunk's documents as sparse rows, and the maxima of leaves, branches and chunk."""

    first: np.ndarray
    tid: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.leaves = _nodes(self.first, self.tid, self.x, LEAF)
        self.branches = _nodes(*self.leaves, BRANCH // LEAF)
        self.whole = _nodes(*self.branches, CHUNK // BRANCH)

    def restricted(self, local: np.ndarray) -> DocumentTree:
        """The coordinates that ``local`` numbers (-1: none)."""
        def cut(first, tid, x):
            keep = local[tid] >= 0
            return np.concatenate(([0], np.cumsum(keep)))[first], local[tid[keep]], x[keep]
        out = object.__new__(DocumentTree)
        out.first, out.tid, out.x = cut(self.first, self.tid, self.x)
        out.leaves, out.branches, out.whole = cut(*self.leaves), cut(*self.branches), cut(*self.whole)
        return out


class ItemTree:
    """One batch of items over its own vocabulary, like items side by side."""

    def __init__(self, item: np.ndarray, tid: np.ndarray, value: np.ndarray, terms: int):
        vocabulary, column = np.unique(tid, return_inverse=True)
        items, row = np.unique(item, return_inverse=True)
        # Items are put next to those that share their heaviest term.
        heaviest = np.full(len(items), -1, np.int64)
        order = np.lexsort((value, row))
        heaviest[row[order]] = tid[order]
        place = np.empty(len(items), np.int64)
        place[np.lexsort((items, heaviest))] = np.arange(len(items))
        self.items = items[np.argsort(place)]
        self.local = np.full(terms, -1, np.int64)
        self.local[vocabulary] = np.arange(len(vocabulary))
        # float64 adds whole numbers exactly below 2**53; no partial sum of any bound exceeds this.
        groups = -(-len(items) // GROUP)
        dense = np.zeros((groups * GROUP, len(vocabulary)), np.int64)
        dense[place[row], column] = value
        grouped = dense.reshape(groups, GROUP, -1).max(1)
        top = grouped.max(0)
        if int(top.sum()) * 1000000 < 1 << 53:
            dense, grouped, top = (v.astype(np.float64) for v in (dense, grouped, top))
        self.leaf, self.group, self.top = dense, grouped, top


@dataclass
class Best:
    """Each item's k best scores so far, and the documents that can be among its best."""

    floor: np.ndarray
    k: int

    def __post_init__(self):
        self.top = np.zeros((len(self.floor), self.k), np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, items: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` of documents (rows) for ``items``."""
        scores = scores.astype(np.int64)
        both = np.concatenate((self.top[items], scores.T), 1)
        self.top[items] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k:]
        self.floor[items] = np.maximum(self.floor[items], self.top[items].min(1))
        d, i = np.nonzero(scores >= self.floor[items][None, :])
        if len(d):
            self.found.append((items[i], scores[d, i], rows[d]))
            self.size += len(d)

    def cut(self, ids: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each item, equal scores by id, then by row."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        item, score, row = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((row, ids[row], missing[row], -score, item))
        item, score, row = item[order], score[order], row[order]
        start = np.searchsorted(item, item)
        keep = (np.arange(len(item)) - start < self.k) & (score >= self.floor[item])
        self.found = [(item[keep], score[keep], row[keep])]
        self.size = int(keep.sum())
        return self.found[0]


def _score(tree: ItemTree, docs: DocumentTree, leaf: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of a leaf's documents (rows) and items, and the rows."""
    a, z = leaf * LEAF, min(len(docs.first) - 1, (leaf + 1) * LEAF)
    lo, hi = docs.first[a], docs.first[z]
    t0, t1 = docs.leaves[0][leaf], docs.leaves[0][leaf + 1]
    terms = docs.leaves[1][t0:t1]
    dense = np.zeros((z - a, len(terms)), tree.leaf.dtype)
    dense[np.repeat(np.arange(z - a), np.diff(docs.first[a:z + 1])), np.searchsorted(terms, docs.tid[lo:hi])] = docs.x[lo:hi]
    return dense @ tree.leaf[np.ix_(items, terms)].T, np.arange(a, z)


def _bounds(matrix: np.ndarray, rows: np.ndarray, nodes: tuple[np.ndarray, ...], node: int) -> np.ndarray:
    a, z = nodes[0][node], nodes[0][node + 1]
    return matrix[np.ix_(rows, nodes[1][a:z])] @ nodes[2][a:z].astype(matrix.dtype)


def first_descent(tree: ItemTree, docs: DocumentTree, best: Best, base: int) -> None:
    """Score, for every item, the leaf that promises most."""
    rows = np.arange(len(tree.items))
    n = len(docs.leaves[0]) - 1
    bounds = np.stack([_bounds(tree.leaf, rows, docs.leaves, leaf) for leaf in range(n)])
    for leaf in range(n):
        mine = rows[(bounds.argmax(0) == leaf) & (bounds.max(0) > 0)]
        if len(mine):
            scores, at = _score(tree, docs, leaf, mine)
            best.add(tree.items[mine], scores, base + at)


def search(tree: ItemTree, docs: DocumentTree, best: Best, base: int) -> None:
    """All pairs of the two trees whose bound reaches the items' weakest kth score."""
    floor = np.full(len(tree.leaf), np.iinfo(np.int64).max)
    floor[:len(tree.items)] = best.floor[tree.items]
    weakest = lambda: floor.reshape(-1, GROUP).min(1)
    groups = np.arange(len(tree.group))
    if _bounds(tree.top[None, :], np.array([0]), docs.whole, 0)[0] < floor.min():
        return
    for branch in range(len(docs.branches[0]) - 1):
        reach = _bounds(tree.group, groups, docs.branches, branch)
        live = groups[reach >= weakest()]
        if not len(live):
            continue
        for leaf in range(branch * (BRANCH // LEAF), min((branch + 1) * (BRANCH // LEAF), len(docs.leaves[0]) - 1)):
            near = live[_bounds(tree.group, live, docs.leaves, leaf) >= weakest()[live]]
            if not len(near):
                continue
            items = (near[:, None] * GROUP + np.arange(GROUP)).ravel()
            items = items[items < len(tree.items)]
            items = items[_bounds(tree.leaf, items, docs.leaves, leaf) >= floor[items]]
            if len(items):
                scores, at = _score(tree, docs, leaf, items)
                best.add(tree.items[items], scores, base + at)
                floor[items] = best.floor[tree.items[items]]


# ---------------------------------------------------------------------------- tasks
FOUND = "item long, doc_id long, score long"


def _tables(batches, rows: int):
    """A task's (doc_id, tids, xs) rows, ``rows`` at a time."""
    held, size = [], 0
    for b in batches:
        while b.num_rows:
            take = min(rows - size, b.num_rows)
            held.append(b.slice(0, take))
            size += take
            b = b.slice(take)
            if size == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _searcher(sent, floors, k: int, step):
    """Run ``step`` over every (item batch, document chunk) of a task. ``floors`` holds each
    item's kth score so far (1: a score must be above 0)."""
    def run(batches):
        item, tid, value, terms, n_items = sent.value
        cuts = np.searchsorted(item, np.arange(0, n_items + BATCH, BATCH))
        trees: dict[int, ItemTree] = {}
        best = Best(floors.value.copy(), k)
        ids, missing, base = [], [], 0
        for table in _tables(batches, CHUNK):
            lists = table.column("tids").chunk(0)
            first = np.asarray(lists.offsets).astype(np.int64)
            docs = DocumentTree(first - first[0], np.asarray(lists.flatten()).astype(np.int64), np.asarray(table.column("xs").chunk(0).flatten()))
            own = table.column("doc_id").chunk(0)
            ids.append(np.asarray(own.fill_null(0)).astype(np.int64))
            missing.append(np.asarray(own.is_null()))
            for n, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a == z:
                    continue
                if n not in trees:
                    if len(trees) > 8:  # further batches are built again for each chunk
                        trees.clear()
                    trees[n] = ItemTree(item[a:z], tid[a:z], value[a:z], terms)
                step(trees[n], docs.restricted(trees[n].local), best, base)
            base += table.num_rows
            if best.size > SLACK:
                best.cut(np.concatenate(ids), np.concatenate(missing))
        if not ids:
            return
        ids, missing = np.concatenate(ids), np.concatenate(missing)
        found, score, row = best.cut(ids, missing)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ids[row], pa.int64(), mask=missing[row]), pa.array(score)],
                                         names=["item", "doc_id", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank (from 1), doc_id, score.

    Scores above 0 only, highest first, equal ones by ascending id (integers; rows without an
    id come last). Every row is a document and an item of its own, repeated rows too. A null,
    empty or termless text scores nothing; empty tables give no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "search")
    rows = scratch.write(items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")))
    terms = rows.select("key", "text").mapInArrow(_item_terms, "key long, term string, times long")
    terms = scratch.write(terms.groupBy("key", "term").agg(F.sum("times").alias("times")))
    size = terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    passes = max(1, math.ceil(size / vocabulary))
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = []
    for p in range(passes):
        own = terms.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).toArrow().sort_by([("key", "ascending"), ("term", "ascending")])
        if not own.num_rows:
            continue
        coded = own.column("term").cast(pa.binary()).combine_chunks().dictionary_encode()
        names, tid = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        key, item = np.unique(np.asarray(own.column("key")), return_inverse=True)
        vectors = scratch.write(base.mapInArrow(_vectorise(sc.broadcast(names)), "doc_id long, n long, tids array<int>, tfs array<long>"))
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(names), np.int64)
        for r in vectors.select("tids").mapInArrow(_count_terms, "tid int, df long").groupBy("tid").agg(F.sum("df")).toLocalIterator():
            df[r[0]] = r[1]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        laid = vectors.mapInArrow(_coordinates(n_docs, n_terms, sc.broadcast(weight)), "doc_id long, t1 int, t2 int, tids array<int>, xs array<long>")
        laid = scratch.write(laid)
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        laid = scratch.write(laid.repartitionByRange(parts, "t1", "t2", F.xxhash64("doc_id")).sortWithinPartitions("t1", "t2").select("doc_id", "tids", "xs"))
        sent = sc.broadcast((item, tid, np.asarray(own.column("times")) * weight[tid], len(names), len(key)))
        start = sc.broadcast(np.ones(len(key), np.int64))
        seeds = laid.mapInArrow(_searcher(sent, start, k, first_descent), FOUND)
        floors = np.ones(len(key), np.int64)
        for r in _best(seeds, k).filter(F.col("rank") == k).select("item", "score").toLocalIterator():
            floors[r.item] = max(1, r.score)
        found = laid.mapInArrow(_searcher(sent, sc.broadcast(floors), k, search), FOUND)
        names_of = spark.createDataFrame(pa.table({"item": np.arange(len(key)), "key": key}))
        out.append(scratch.write(_best(found, k).join(names_of, "item").select("key", "rank", "doc_id", "score")))
    if not out:
        return rows.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = out[0]
    for more in out[1:]:
        best = best.union(more)
    return rows.select("key", "item_id").join(best, "key").select("item_id", "rank", "doc_id", "score")
