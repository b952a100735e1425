"""Ranked search, secret scan and collocations against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import LOWER, documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from driftgate.llm import collocations as P
from driftgate.llm import dual_tree as T
from driftgate.llm import secret_index as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------------------- ranked search
def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    """docs and items: (id, text) rows. Per item row: its best (id, score), in order."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        found = sorted(found)[:k]
        out.append((item, [(None if none else i, -s) for s, none, i in found]))
    return out


def got_search(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "item_id long, text string, rank string, score double")


def test_search_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(T, "BATCH", 16)
    monkeypatch.setattr(T, "GROUP", 4)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(5)
    some = [t for _, t in rows if t and len(t) > 200]
    items = [(i, " ".join(rng.choice(some).split()[:rng.randint(1, 60)])) for i in range(40)]
    items += [(90, None), (91, ""), (92, "...!"), (93, "Shared LINE shared line"), (94, "日本語 CAFÉ café É"), (95, "zzzzzz qqqqqq")]
    want = {i: [(k + 1, d, s) for k, (d, s) in enumerate(x)] for i, x in brute_search(rows, items) if x}
    table = items_table(spark, items)
    assert got_search(T.lexical_search(docs, table).collect()) == want
    # The same in several passes over the items, and in many chunks and leaves.
    monkeypatch.setattr(T, "CHUNK", 16)
    monkeypatch.setattr(T, "BRANCH", 8)
    monkeypatch.setattr(T, "LEAF", 2)
    assert got_search(T.lexical_search(docs, table, vocabulary=2000).collect()) == want


def test_search_ties_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "alpha beta")] * 2 + [(i, "alpha  BETA") for i in range(30, 0, -1)] + [(5, "alpha beta"), (99, "gamma"), (98, None), (97, "")],
                                 "doc_id long, text string")
    rows = T.lexical_search(docs, items_table(spark, [(1, "alpha"), (None, "gamma gamma")])).collect()
    got = got_search(rows)
    assert [d for _, d, _ in got[1]] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9] and len({s for _, _, s in got[1]}) == 1
    assert [(k, d) for k, d, _ in got[None]] == [(1, 99)]
    few = T.lexical_search(docs.filter("doc_id is null"), items_table(spark, [(1, "alpha")])).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, None), (2, None)]


def test_search_over_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = items_table(spark, [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items_table(spark, [(1, None)])), (spark.createDataFrame([(1, "!"), (2, None)], docs.schema), items)):
        out = T.lexical_search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bounds_prune_and_never_lose(spark):
    """Node-pair bounds hold for every pair below, and some pairs are pruned."""
    rng = np.random.default_rng(4)
    n = 600
    first = np.arange(n + 1) * 6
    tid = np.concatenate([np.sort(rng.choice(300, 6, replace=False)) for _ in range(n)])
    x = rng.integers(1, 1000, 6 * n)
    docs = T.DocumentTree(first, tid, x)
    item, t = np.repeat(np.arange(30), 5), np.concatenate([rng.choice(300, 5, replace=False) for _ in range(30)])
    value = rng.integers(1, 100, 150)
    tree = T.ItemTree(item, t, value, 300)
    dense_d, dense_i = np.zeros((n, 300), np.int64), np.zeros((30, 300), np.int64)
    dense_d[np.repeat(np.arange(n), 6), tid] = x
    dense_i[item, t] = value
    full = dense_i @ dense_d.T
    best, calls = T.Best(np.ones(30, np.int64), 5), []
    score = T._score
    try:
        T._score = lambda tree, docs, leaf, items: calls.append(len(items)) or score(tree, docs, leaf, items)
        T.search(tree, docs.restricted(tree.local), best, 0)
    finally:
        T._score = score
    found, s, row = best.cut(np.arange(n), np.zeros(n, bool))
    for i in range(30):
        mine = sorted(zip(-s[found == i], row[found == i]))
        want = sorted(zip(-full[i], range(n)))[:5]
        assert [m for m in mine] == [w for w in want if w[0] < 0]
    assert sum(calls) < 30 * len(docs.leaves[0])  # fewer (item, leaf) pairs than there are


# ---------------------------------------------------------------------------- secrets
def brute_spans(text, rules):
    hits = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if m.end(r.group) - m.start(r.group) >= r.least:
                hits.append((m.start(), n, m.end()))
    return [(rules[n].kind, s, e) for s, n, e in sorted(hits)]


SECRETS = ['password = "hunter2hunter"', "PassWd:abc", "api_key: 'AAAA+/=._-b'", "apikey=short", "token token=x1y2z3 secret=", "AKIA" + "A1" * 8, "xAKIA" + "B" * 16 + "c",
           "AKIA" + "B" * 15, "é" * 7 + "0123456789abcdef01234567" + "g", "0123456789abcdef0123456", "a" * 30 + "A" + "f" * 24, "ſecret=abcdefgh toKen=abcdefgh",
           "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "ghp_" + "x" * 36, "xoxb-" + "1" * 12, "sk-" + "k" * 20,
           "https://me:pa55@host/x", "password=password=abcdef token: : x", "🎉 secret : 'zzzzzzzz' 🎉"]


def test_spans_against_plain_matching(spark):
    docs = documents(spark, [*SECRETS, "\n".join(SECRETS), " ".join(SECRETS) * 40, "word " * 400_000 + SECRETS[0], "x" * 3_000_000])
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = S.find_secrets(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert [tuple(s) for s in r.spans] == brute_spans(texts[r.row.doc_id], S.RULES), r.row.doc_id
    assert sum(len(r.spans) for r in out) > 500
    assert S.find_secrets(docs.limit(0)).count() == 0 and S.find_secrets(docs.select("text")).count() == len(out)


def test_a_rule_without_trigrams_scans_fully(spark):
    assert S.trigram_query(S.BASE[2].pattern) == S.ANY == S.trigram_query("a?b*") == S.trigram_query("[^x]y.z")
    docs = spark.createDataFrame([(1, "q7"), (2, "Q8 q9")], "doc_id long, text string")
    rule = [S.Rule("odd", r"[qQ]\d")]
    assert {r.row.doc_id: len(r.spans) for r in S.find_secrets(docs, rule).collect()} == {1: 1, 2: 2}


def holds(query, text):
    if query == S.ANY:
        return True
    if query[0] == "tri":
        return query[1] in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


PATTERNS = [r.pattern for r in S.RULES] + ["abc", "(ab|cd)ef?g", "(?i:hello) wor(ld|k)s?", "x{3}yz", "(abc){2,}d", "[a-c][d-f]gh", "^start.*end$", "a(bc)?d(ef|gh)+i", "né{2}d"]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(PATTERNS).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.ASCII)))))
def test_queries_hold_for_every_match(case):
    pattern, text = case
    if re.search(pattern, text, re.ASCII):
        assert holds(S.trigram_query(pattern), text.encode("utf-8", "surrogatepass").lower())


def test_only_candidates_are_matched():
    texts = [b"nothing here", b"a token: abcdefgh", b"to ken oke", b"secret"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    wanted = np.zeros(1 << 24, bool)
    query = S.trigram_query(S.BASE[0].pattern)
    wanted[[S.code(t) for t in S.trigrams(query)]] = True
    assert S.Segment(data, offsets, wanted).answer(query).tolist() == [1, 3]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh and AKIA" + "A" * 16 + " end"), (2, None), (3, "plain"), (4, "secret=" + "0123456789abcdef" * 2)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert got == {1: "a [SECRET] and [SECRET] end", 2: None, 3: "plain", 4: "[SECRET]"}


# ---------------------------------------------------------------------------- collocations
def brute_phrases(rows, support, top, longest=4):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("support,top,shards", [(30, 2000, 8), (3, 40, 8), (5, 7, 1), (300, 2000, 3)])
def test_phrases_against_plain_counts(spark, support, top, shards):
    rng = random.Random(3)
    few = ["the", "of", "new", "york", "city", "Ünter", "日本", "a"]
    more = [" ".join(rng.choice(few) for _ in range(60)) + rng.choice([". ", ", ", "\n", ""]) + "New York City, new york" for _ in range(60)]
    docs = documents(spark, [*more, "the the the the the the", "same\tphrase here. " * 40, "a,b;c:d!e?f\x0bg\x0ch\ri", sentence(rng, 60_000)])
    got = P.collocations(docs.drop("rank"), support=support, top=top, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], support, top)
    assert sorted(map(tuple, got.collect())) == want
    assert want or support == 300


def test_phrases_of_nothing(spark):
    docs = documents(spark)
    assert P.collocations(docs.limit(0)).count() == 0
    bare = spark.createDataFrame([(None, None), ("en", ""), ("en", " . "), ("de", "one")], "lang string, text string")
    assert P.collocations(bare, support=1).count() == 0
    one = P.collocations(spark.createDataFrame([(None, "b a"), ("und", "b a")], "lang string, text string"), support=2).collect()
    assert [tuple(r) for r in one] == [("und", 1, "b a", 2, 2, 2, 4, 1000000)]


def test_word_hashes_that_clash_are_seeded_anew(spark, monkeypatch):
    real = P.hash64
    monkeypatch.setattr(P, "hash64", lambda v, seed=0: real(v, seed) if seed else np.full(len(v), 7, np.uint64))
    docs = spark.createDataFrame([("en", "x y. x y")], "lang string, text string")
    assert [r.phrase for r in P.collocations(docs, support=2).collect()] == ["x y"]
