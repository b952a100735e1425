"""Near-duplicate, line and suffix dedup against brute force on small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import LOWER, documents, texts, words
from pyspark.sql import functions as F

from driftgate.llm.kernels import CHUNK
from driftgate.llm.line_dedup import Cuckoo, LineIndex, line_dedup
from driftgate.llm.minmax_dedup import near_duplicates
from driftgate.llm.suffix_dedup import suffix_dedup

STRIP = " \t\n\x0b\x0c\r"


def shingles(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (i, s) in enumerate(sets):
        for m, both in Counter(m for g in s for m in where[g] if m > k).items():
            j, other = sets[m]
            if 100 * both >= 75 * (len(s) + len(other) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}


def test_near_duplicates_against_all_pairs(spark):
    docs = documents(spark)
    got = near_duplicates(docs).collect()
    expected, sizes = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (expected[r.id], sizes[r.id], expected[r.id] == r.id), r
    assert len(set(expected.values())) < len(expected)


def test_near_duplicates_through_a_chain_of_copies(spark):
    """A long chain in which only neighbours are similar: several rounds and star steps."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        w = base.copy()
        w[:k * 6] = [f"c{i}" for i in range(k * 6)]
        rows.append((1000 - k, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.component_id for r in got.collect()} == brute_components(rows)[0]


def test_near_duplicates_empty_and_without_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.id, r.component_id, r.kept) for r in near_duplicates(same).collect()} == {(None, None, True), (1, 1, True), (2, 1, False)}


def brute_lines(rows, least):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    count = Counter()
    for t in rows:
        count.update({key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        left = "\n".join(kept)
        out.append((len(lines), len(lines) - len(kept), left, hashlib.sha256(left.encode()).hexdigest()))
    return out


def test_line_dedup_against_counts(spark):
    docs = documents(spark)
    rows = docs.collect()
    expected = Counter(zip((r.doc_id for r in rows), brute_lines([r.text for r in rows], 10)))
    got = Counter((r.row.doc_id, (r.n_lines, r.n_dropped, r.text, r.kept_sha256)) for r in line_dedup(docs).collect())
    assert got == expected
    assert sum(x[1][1] for x in got) > 0


def test_line_dedup_of_empty_table_and_null_ids(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a\nb"), (None, "A \nc"), (3, None)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2).collect()
    assert sorted((r.text, r.n_dropped) for r in got) == [("", 0), ("b", 1), ("c", 1)]


def test_line_index_is_reversible(spark):
    docs = documents(spark)
    first, second = docs.filter("doc_id < 24"), docs.filter("doc_id >= 24")
    state = lambda i: sorted(map(tuple, i.refs.collect()))
    keys = lambda i: {tuple(r) for r in i.refs.filter(F.col("n_docs") >= i.min_docs).select("k1", "k2").collect()}
    a = LineIndex.build(first, min_docs=4)
    both = a.insert(second)
    assert state(both) == state(LineIndex.build(docs, min_docs=4))
    back = both.delete(second)
    assert state(back) == state(a)
    for index in (a, both, back):  # every frequent key is in its shard's filter, and they are as many
        rows = {r.shard: Cuckoo(r.buckets, r.slots) for r in index.filters.collect()}
        held = keys(index)
        for k1, k2 in held:
            x, y = (np.array([v], np.int64).view(np.uint64) for v in (k1, k2))
            assert rows[k1 % index.shards].holds(x, y).all()
        assert sum(int((f.slots != 0).sum()) for f in rows.values()) == len(held)
    assert keys(both) != keys(a)


def test_cuckoo_filter_grows_and_deletes():
    rng = np.random.default_rng(5)
    k1, k2 = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    f = Cuckoo.of(k1, k2, 16)
    assert f.holds(k1, k2).all() and f.buckets > 16
    other = rng.integers(0, 1 << 64, (2, 20000), dtype=np.uint64)
    assert f.holds(*other).mean() < 0.002
    f.delete(k1[:4000], k2[:4000])
    assert f.holds(k1[4000:], k2[4000:]).all()
    assert int((f.slots != 0).sum()) == 1000


def brute_suffix(rows, length):
    raw = [(t or "").encode() for t in rows]
    count = Counter(b[s:s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def edges() -> list[str]:
    """Strings that agree in exactly 399, 400 and 401 bytes, at every kind of edge, periodic
    texts, and matches that overlap from several partners."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    shared, out = letters(1500), []
    for n in (399, 400, 401, 655, 656, 657):
        at = int(rng.integers(0, 800))
        out += [letters(300) + shared[at:at + n] + letters(17), shared[at:at + n], letters(3) + shared[at:at + n]]
    out += [shared[100:700] + shared[900:1500], letters(50) + shared[650:1000], "ab" * 450, "ab" * 300 + "c", "z" * 900, letters(700) * 2]
    out += [shared[k:k + 450] for k in range(0, 1000, 37)]
    return out


@pytest.mark.parametrize("length", [400, 64])
def test_suffix_dedup_against_all_windows(spark, length):
    docs = documents(spark, edges())
    rows = docs.collect()
    expected = Counter(zip((r.doc_id for r in rows), brute_suffix([r.text for r in rows], length)))
    got = suffix_dedup(docs, length)
    assert Counter((r.row.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.collect()) == expected
    assert got.filter("n_spans > 0 and n_removed < n_bytes").count() > 5


def test_suffix_dedup_of_documents_over_a_chunk(spark):
    """Documents longer than the piece that is handled at once, with repeats across its edge."""
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    one = letters(CHUNK + 5000)
    rows = [(1, one), (2, letters(2000) + one[CHUNK - 700:CHUNK + 900] + letters(CHUNK)), (3, one[100:450]), (4, one[CHUNK + 3000:CHUNK + 3400])]
    got = {r.row.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2000, 2), 2: (1600, 1), 3: (0, 0), 4: (400, 1)}


def test_suffix_dedup_text_keeps_whole_characters(spark):
    rows = [(1, "é" * 300), (2, "x" + "é" * 300), (3, None)]
    got = {r.row.doc_id: r.text for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "x", 3: ""}
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cases_hold_near_copies():
    assert sum(t is None for t in texts()) == 1


def thue_morse(n: int, x: str, y: str) -> tuple[str, str]:
    """Two strings of n symbols that fingerprints by powers of one odd base modulo 2**64 cannot
    tell apart."""
    one = "".join(y if bin(i).count("1") % 2 else x for i in range(n))
    return one, one.translate(str.maketrans({x: y, y: x}))


def test_strings_that_collide_under_polynomial_sums(spark):
    a, b = thue_morse(2048, "a", "b")
    rows = [(i, a + f"\nline {i}") for i in range(9)] + [(9, b + "\nline 9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup(docs, 10, carry=["doc_id"]).collect()} == {0}
    both = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    assert {r.id: r.component_id for r in near_duplicates(both).collect()} == {0: 0, 1: 1, 2: 0}


def test_lines_of_rows_without_id(spark):
    """Rows without an id, and rows of one id, are documents of their own."""
    rows = [(None, f"shared\nown {i}") for i in range(12)] + [(7, f"Shared \nof seven {i}") for i in range(3)] + [(None, "own 0")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.n_dropped) for r in line_dedup(docs, 10, carry=["doc_id"]).collect())
    assert got == sorted([(f"own {i}", 1) for i in range(12)] + [(f"of seven {i}", 1) for i in range(3)] + [("own 0", 0)] * 2)
