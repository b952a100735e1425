from __future__ import annotations

from collections import defaultdict

import pytest
from cases import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from driftgate.llm.packing import CAPACITIES, best_fit_pack, pack


def check(pieces, capacities, lengths):
    bins, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p.bin_id].append(p)
        docs[p.id].append(p)
    for b in bins.values():
        b.sort(key=lambda p: p.offset)
        end = 0
        for p in b:  # back to back
            assert p.offset == end
            end += p.size
        caps = {p.capacity for p in b}
        assert len(caps) == 1 and caps <= set(capacities)
        assert min(c for c in capacities if c >= end) == caps.pop()  # shrunk to its contents
    for d, n in lengths.items():
        own = sorted(docs.pop(d, []), key=lambda p: p.start)
        assert sum(p.size for p in own) == n
        assert [p.start for p in own] == [sum(q.size for q in own[:k]) for k in range(len(own))]
        assert [p.piece for p in own] == list(range(len(own)))
    assert not docs


@pytest.mark.parametrize("shard", [4_000_000, 3000])
def test_every_token_is_packed_once(spark, shard):
    docs = documents(spark).dropDuplicates(["doc_id"])
    got = best_fit_pack(docs, shard_tokens=shard, capacities=(64, 128, 512)).collect()
    check(got, (64, 128, 512), {r.doc_id: len(words(r.text)) for r in docs.collect()})


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (2, ""), (3, None)]
    got = best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.size) for r in got) == [(0, 2), (1, 3), (1, 3)]
    assert len({(r.bin_id, r.offset) for r in got}) == 3
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=80))
def test_pack_fits_and_is_no_worse_than_first_largest(sizes):
    sizes.sort(reverse=True)
    number, offset, caps = pack(sizes, CAPACITIES, 16)
    used = defaultdict(int)
    for s, b, o in zip(sizes, number, offset):
        assert o == used[b]
        used[b] += s
    assert all(used[b] <= c for b, c in enumerate(caps))
    alone = sum(min(c for c in CAPACITIES if c >= s) + 16 for s in sizes)
    assert sum(c + 16 for c in caps) <= alone


def test_several_lengths_beat_one():
    sizes = sorted([700] * 40 + [300] * 40 + [100] * 3, reverse=True)
    cost = lambda caps: sum(c + 16 for c in pack(sizes, caps, 16)[2])
    assert cost(CAPACITIES) <= min(cost((c,)) for c in CAPACITIES if c >= 700)
