"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the largest capacity. Pieces are dealt to shards of a
bounded number of tokens by a hash of their document (a hot key has no say in it), and each
shard is packed by itself:

* pieces are taken in decreasing order and put where they leave least room (best fit);
* a piece that fits nowhere opens the bin size with the least cost for each token it can
  still be filled with, given what is left to pack;
* at the end each bin is shrunk to the smallest capacity that holds its contents.

The openings are tried for every subset "capacities up to c", and the cheapest plan is kept,
so the permitted lengths are chosen jointly.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch, ship

ship(__name__)

CAPACITIES = (512, 1024, 2048, 4096)
#: Fixed cost of a sequence, in tokens, besides its capacity (padding costs its tokens).
OVERHEAD = 16
#: Tokens of a shard: one shard is packed in one task's memory.
SHARD_TOKENS = 4_000_000


def token_count(text: Column) -> Column:
    """Words of a text, a stand-in for its tokens (another column can be given instead)."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(F.regexp_replace(t, "[\\x09-\\x0D]", " "), " ", -1), "")).cast("long")


class _Open:
    """Open bins by room left: a sorted list of rooms and a stack of bins for each."""

    def __init__(self):
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        if room not in self.bins:
            bisect.insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(number)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with least room that still holds ``size``."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        number = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room], self.rooms[at]
        return room, number


def pack(sizes: list[int], capacities: tuple[int, ...], overhead: float) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sizes in decreasing order), and each bin's capacity."""
    best = None
    for top in range(1, len(capacities) + 1):
        plan = _pack(sizes, capacities, capacities[:top], overhead)
        cost = sum(c + overhead for c in plan[2])
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


def _pack(sizes: list[int], permitted: tuple[int, ...], opened: tuple[int, ...], overhead: float):
    open_, number, offset, used, room_of = _Open(), [], [], [], []
    left = sum(sizes)
    for size in sizes:
        found = open_.take(size)
        if found is None:
            fits = [c for c in opened if c >= size] or [next(c for c in permitted if c >= size)]
            cap = min(fits, key=lambda c: ((c + overhead) / min(c, left) if left else 0, c))
            found = cap, len(used)
            used.append(0)
            room_of.append(cap)
        room, b = found
        number.append(b)
        offset.append(used[b])
        used[b] += size
        left -= size
        if room > size:
            open_.add(room - size, b)
    return number, offset, [permitted[bisect.bisect_left(permitted, u)] for u in used]


def _packer(capacities: tuple[int, ...], overhead: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "ka", "piece", "n"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        number, offset, caps = pack(pdf["size"].tolist(), capacities, overhead)
        number = np.asarray(number, np.int64)
        pdf["bin"], pdf["offset"] = number, np.asarray(offset, np.int64)
        pdf["capacity"] = np.asarray(caps, np.int64)[number]
        return pdf[["shard", "id", "piece", "start", "size", "bin", "offset", "capacity"]]
    return run


def best_fit_pack(docs: DataFrame, id: str = "doc_id", tokens: str | Column | None = None, text: str = "text",
                  capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD,
                  shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces and where they go: id, piece (from 0), start (first token in the document),
    size, bin_id, offset (in the bin), capacity (of the bin, after shrinking).

    ``tokens`` names the token count (default: words of ``text``). No token is dropped: a
    document longer than the largest capacity is cut in pieces of it and a rest. Documents
    without tokens (null, empty) take no room and have no piece. Repeated rows are packed
    each; a null id stays null; an empty table gives no rows. Other columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    n = token_count(F.col(text)) if tokens is None else (F.col(tokens) if isinstance(tokens, str) else tokens)
    items = scratch.write(docs.select(F.col(id).alias("id"), F.coalesce(n, F.lit(0)).cast("long").alias("n")).filter("n > 0"))
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    pieces = items.withColumn("ka", F.xxhash64("id")) \
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int")))) \
        .withColumn("start", F.col("piece").cast("long") * top) \
        .withColumn("size", F.least(F.lit(top).cast("long"), F.col("n") - F.col("start")))
    # Piece by piece, so that neither a very long document nor a repeated id fills a shard.
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("ka", "piece", "n"), F.lit(shards)).cast("int"))
    kind = docs.schema[id].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInPandas(
        _packer(capacities, overhead), f"shard int, id {kind}, piece int, start long, size long, bin long, offset long, capacity long")
    bin_id = F.col("shard").cast("long") * F.lit(1 << 32) + F.col("bin")
    return packed.select("id", "piece", "start", "size", bin_id.alias("bin_id"), "offset", "capacity")
