"""Approximate nearest neighbours by cross-polytope hashing.

Each of TABLES hash tables turns unit vectors by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and assigns them to the nearest signed axis. A query
looks into the PROBES nearest axes of every table; what lies there is ranked by the exact
inner product of the original vectors, in double precision.

Vectors are dealt into ranges of norms, each RATIO wide, and hashed by direction alone; a query
looks into its cells of every range, and the exact scores merge the ranges. Within a range
the largest inner products are nearly the nearest directions, and a vector's cells do not
depend on other norms. The vectors of ranges of at most EXACT vectors are all compared. So are all
vectors of its length for a query that found fewer than K.

A cell (range, table, axis) is cut into blocks of at most BLOCK vectors and QUERY_BLOCK queries, so
a hot cell (many equal vectors) never lands in one task. Only the best K of each block go on.
The cells' sizes, TABLES * 2 * dimension rows a hashed range, and the list of hashed ranges are
the only things broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship

ship(__name__)

TABLES, PROBES, K = 8, 20, 20
BLOCK, QUERY_BLOCK = 4096, 512
#: Largest norm of a range, divided by its smallest, and most vectors of a range that is not hashed.
RATIO, EXACT = 1.25, 4096
#: The range whose vectors are all compared.
WHOLE = -(1 << 31)
SEED = 4


def hadamard(y: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix (their length is a power of two), orthonormal."""
    n, d = y.shape
    h = 1
    while h < d:
        z = y.reshape(n, -1, 2, h)
        y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return y / math.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    d = x.shape[1]
    signs = np.random.default_rng([SEED, table, d]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: 2 * axis + (1 if negative)."""
    both = np.stack((y, -y), 2).reshape(len(y), -1)
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1)


def _vectors(batch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all lists of a column, and each list's begin and length."""
    lists = batch.column(column)
    length = np.diff(np.asarray(lists.offsets))
    return np.asarray(lists.flatten()).astype(np.float64), np.cumsum(length) - length, length


def _ranges(batches):
    """(id, vector, query) -> the same with the vector's length and range of norms."""
    for b in batches:
        flat, first, length = _vectors(b, 1)
        if not len(length):
            continue
        most = np.maximum.reduceat(np.abs(flat), first)  # squares of large or small components leave a double's range
        norm = np.log(np.add.reduceat((flat / np.repeat(most, length)) ** 2, first)) / 2 + np.log(most)
        part = np.rint(norm / math.log(RATIO)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length.astype(np.int32)), pa.array(part)], names=["id", "vector", "query", "dim", "part"])


def _cells(hashed: dict[int, list[int]], whole: set[int], tables: int, probes: int):
    def run(batches):
        """(id, vector, query, dim, part) -> a row for each cell of a vector (data), and for each
        cell that a query looks into. ``hashed``: the hashed ranges of each length; ``whole``:
        lengths with vectors in other ranges."""
        for b in batches:
            flat, first, length = _vectors(b, 1)
            query = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            part = np.asarray(b.column(4))
            out = []  # cell, range, row, query

            def put(cell, part, row, query):
                out.append((np.asarray(cell, np.int64), np.broadcast_to(np.asarray(part, np.int32), len(row)), row, np.full(len(row), query)))

            for d in np.unique(length):
                rows, base = np.flatnonzero(length == d), int(d) << 32
                parts = hashed.get(int(d), [])
                mine = np.isin(part[rows], parts)
                put(np.full((~mine).sum(), base), WHOLE, rows[~mine], False)
                asked = rows[query[rows]]
                if int(d) in whole:
                    put(np.full(len(asked), base), WHOLE, asked, True)
                if not parts:
                    continue
                rows = rows[mine]
                size = 1 << max(1, math.ceil(math.log2(d)))

                def points(of):
                    x = flat[first[of][:, None] + np.arange(d)]
                    x = x / np.abs(x).max(1, keepdims=True)
                    return np.pad(x / np.sqrt((x * x).sum(1, keepdims=True)), ((0, 0), (0, size - d)))

                data, asks = points(rows) if len(rows) else None, points(asked) if len(asked) else None
                for t in range(tables):
                    of = base + t * 2 * size
                    if len(rows):
                        put(of + axes(rotate(data, t), 1)[:, 0], part[rows], rows, False)
                    if len(asked):
                        near = axes(rotate(asks, t), probes)
                        for p in parts:
                            put((of + near).ravel(), p, np.repeat(asked, near.shape[1]), True)
            cell, part, at, role = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 4
            for s in range(0, len(at), 8192):
                take = pa.array(at[s:s + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[s:s + 8192]), pa.array(cell[s:s + 8192]), pa.array(role[s:s + 8192]), b.column(0).take(take), b.column(1).take(take)],
                    names=["part", "cell", "query", "id", "vector"])
    return run


def _rank(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, data = pdf[pdf["query"]], pdf[~pdf["query"]]
        out = []
        if len(asked) and len(data):
            data = data.sort_values("id", kind="stable")
            x = np.stack(data["vector"].to_numpy()).astype(np.float64)
            q = np.stack(asked["vector"].to_numpy()).astype(np.float64)
            ids = data["id"].to_numpy()
            again = data["id"].duplicated().any()
            rough = q @ x.T
            for n, own in enumerate(asked["id"].to_numpy()):
                s = np.where(ids == own, -np.inf, rough[n])
                least = np.partition(s, max(0, len(s) - k))[max(0, len(s) - k)]
                # Matrix products may differ in the last digits from pair to pair; the
                # score is summed in one fixed way, so equal vectors tie exactly.
                near = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) & (ids != own)) if np.isfinite(least) and not again else np.flatnonzero(ids != own)
                score = (x[near] * q[n]).sum(1)
                order = np.lexsort((ids[near], -score))
                if again:  # rows that repeat an id count once
                    order = order[~pd.Series(ids[near[order]]).duplicated().to_numpy()]
                best = near[order := order[:k]]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and has finite components
    only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("vector", lambda c: c != 0.0)
    return vectors.select(F.col(id).alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull()) \
        .filter(~bad & some)


def _compared(cells: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` for every query of each block of its cells."""
    kind = cells.schema["id"].dataType.simpleString()
    count = lambda cond: F.count(F.when(cond, 1))
    sizes = cells.groupBy("part", "cell").agg(
        F.greatest(F.ceil(count(~F.col("query")) / BLOCK), F.lit(1)).cast("int").alias("blocks"),
        F.greatest(F.ceil(count(F.col("query")) / QUERY_BLOCK), F.lit(1)).cast("int").alias("query_blocks"),
        count(F.col("query")).alias("asked"))
    sizes = scratch.write(sizes)
    cut = cells.join(F.broadcast(sizes.filter("asked > 0").drop("asked")), ["part", "cell"])
    h = F.xxhash64("id")
    own = lambda n: F.array(F.pmod(h, F.col(n)).cast("int"))
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cut = cut.withColumn("block", F.explode(F.when(F.col("query"), all_("blocks")).otherwise(own("blocks")))) \
        .withColumn("query_block", F.explode(F.when(F.col("query"), own("query_blocks")).otherwise(all_("query_blocks"))))
    by = ["part", "cell", "block", "query_block"]
    return cut.select(*by, "query", "id", "vector").groupBy(*by) \
        .applyInPandas(lambda pdf: _rank(k)(pdf.drop(columns=by)), f"query_id {kind}, vec_id {kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, id: str = "vec_id", vector: str = "embedding", k: int = K,
            tables: int = TABLES, probes: int = PROBES, exact: int = EXACT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that fits
    ``is_query`` (a condition on the column ``id``), by largest inner product, ties to the
    smaller id; the row itself is no candidate. A query gets fewer only if there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do rows without an id. Vectors of another length are never compared. Rows that repeat an
    id count once in a result. An empty table, or one without queries, gives no rows. Other
    columns play no part.
    """
    scratch = Scratch(vectors.sparkSession, "polytope")
    kind = vectors.schema[id].dataType.simpleString()
    good = usable(vectors, id, vector).select("id", "vector", is_query(F.col("id")).alias("query"))
    good = scratch.write(good.mapInArrow(_ranges, f"id {kind}, vector array<double>, query boolean, dim int, part int"))
    hashed, whole = {}, set()
    for r in good.groupBy("dim", "part").count().collect():
        if r["count"] > exact:
            hashed.setdefault(r["dim"], []).append(r["part"])
        else:
            whole.add(r["dim"])
    cells = scratch.write(good.mapInArrow(_cells(hashed, whole, tables, probes), f"part int, cell long, query boolean, id {kind}, vector array<double>"))
    found = _best(_compared(cells, scratch, k), k)
    if not hashed:
        return found
    found = scratch.write(found)
    of = good.filter(F.col("dim").isin(list(hashed)))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = scratch.write(of.filter("query").join(enough, "id", "left_anti").select("id", "vector", "query", "dim"))
    if not short.limit(1).count():
        return found
    rest = of.select("id", "vector", F.lit(False).alias("query"), "dim").union(short.select("id", "vector", "query", "dim"))
    rest = rest.select(F.lit(WHOLE).alias("part"), F.shiftleft(F.col("dim").cast("long"), 32).alias("cell"), "query", "id", "vector")
    return _best(found.drop("rank").union(_compared(rest, scratch, k).select("query_id", "vec_id", "score")), k)
