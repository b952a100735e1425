"""Joins of a large side to one row for each key, whatever share of the rows a key holds.

A key with so many rows that its partition would outlast the others is joined apart: its one
row on the small side goes to all tasks, and its rows stay where they are. At most as many
keys as there are shuffle partitions are treated so (any further key holds less than an even
share), which bounds what is sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are an ordinary task's work.
HEAVY_ROWS = 200_000


def heavy_keys(many: DataFrame, key: str, rows: int = HEAVY_ROWS) -> list:
    """The keys of ``many`` with more than ``rows`` rows, heaviest first, at most one for each
    shuffle partition: one partial aggregate, and that many rows to the driver."""
    most = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    return [r[0] for r in counts.orderBy(F.col("_n").desc(), key).limit(most).collect()]


def join_one(many: DataFrame, one: DataFrame, key: str, heavy: list | None = None) -> DataFrame:
    """``many`` left-joined to ``one`` (unique by ``key``). ``heavy``: the keys to join apart
    (None: those of ``heavy_keys``); the rows are the same with any list."""
    heavy = heavy_keys(many, key) if heavy is None else heavy
    if not heavy:
        return many.join(one, key, "left")
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    apart = many.filter(hot).join(F.broadcast(one.filter(hot)), key, "left")
    return many.filter(~hot).join(one.filter(~hot), key, "left").unionByName(apart)
