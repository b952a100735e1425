"""Brute-force versions of the template tree and of packing, and awkward inputs of earlier
operators."""

from __future__ import annotations

import itertools
import os
import random
import re
from collections import defaultdict

import pytest
from cases import documents, sentence, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgate.llm import packing as K
from driftgate.llm import quality_rules as Q
from driftgate.llm import url_templates as U
from driftgate.llm.html_blocks import extract_pages, main_text, threshold
from driftgate.llm.queries import TOKENIZERS, sentencepiece_model
from driftgate.llm.sentencepiece_codec import CALL, encode


# ---------------------------------------------------------------------------- templates
def z(g1, n1, g2, n2):
    n1, n2 = max(n1, 1), max(n2, 1)
    p = (g1 + g2) / (n1 + n2)
    return (g2 / n2 - g1 / n1) / (max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n2)) ** 0.5


def brute_templates(rows):
    """rows: (host, path, label). Each row's template and purity, url by url in plain loops."""
    shapes = [(h, tuple(s for s in re.sub("[0-9]+", "0", p).split("/") if s), label) for h, p, label in rows]
    known = [label for _, _, label in shapes if label is not None]
    prior = (sum(known) + 1) / (len(known) + 2) if known else 1.0
    names = [""] * len(rows)
    for k in range(max((len(s) for _, s, _ in shapes), default=0)):
        below = defaultdict(lambda: defaultdict(list))
        for i, (h, s, label) in enumerate(shapes):
            if len(s) > k:
                below[h, names[i]][s[k]].append(i)
        new = dict(enumerate(names))
        for (_, parent), branches in below.items():
            count = {s: (len(m), sum(shapes[i][2] is not None for i in m), sum(shapes[i][2] is True for i in m)) for s, m in branches.items()}
            pn, pl, pg = (sum(c[j] for c in count.values()) for j in range(3))
            kind, bins = {}, defaultdict(list)
            for s, (n, labels, good) in count.items():
                if labels >= U.MIN_LABELS and pl - labels >= U.MIN_LABELS and abs(z(pg - good, pl - labels, good, labels)) >= U.Z:
                    bins[min(good * U.BINS // labels, U.BINS - 1)].append(s)
                    kind[s] = "group"
                elif "0" in s:
                    kind[s] = "*" + (re.search(r"(\.[A-Za-z]+)$", s) or [""])[0]
                elif n < U.MIN_COUNT or n < pn * U.MIN_SHARE:
                    kind[s] = "*"
                elif labels < U.MIN_LABELS:
                    kind[s] = "~"
                else:
                    bins[-1].append(s)
                    kind[s] = "group"
            groups, last = [], None
            for b in sorted(bins):
                now = tuple(sum(count[s][j] for s in bins[b]) for j in (1, 2))
                if last is None or last[0] == -1 or z(last[1][1], last[1][0], now[1], now[0]) >= U.Z:
                    groups.append([])
                groups[-1] += bins[b]
                last = b, now
            for g in groups:
                for s in g:
                    kind[s] = s if len(g) == 1 else "~" + min(g)
            for s, members in branches.items():
                for i in members:
                    new[i] = parent + "/" + kind[s]
        names = [new[i] for i in range(len(names))]
    tally = defaultdict(lambda: [0, 0])
    for (h, _, label), t in zip(shapes, names):
        tally[h, t][0] += label is True
        tally[h, t][1] += label is not None
    return [(t, (tally[h, t][0] + U.WEIGHT * prior) / (tally[h, t][1] + U.WEIGHT)) for (h, _, _), t in zip(shapes, names)]


def test_templates_against_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for host, sections in (("a.org", ["news", "shop", "casino", "x1", "tag"]), ("b.org", ["p", "q"]), ("tiny.org", ["one"])):
        for n, s in enumerate(sections):
            for i in range(rng.choice([5, 60, 200]) if host != "tiny.org" else 3):
                good = rng.random() < (0.05 if s in ("casino", "q") else 0.4 + 0.15 * n)
                rows.append((f"http://{host}/{s}/" + rng.choice(["", "a/", "b/", f"u{i}/"]) + f"{i}" + rng.choice(["", ".html"]), rng.choice([None, good, good])))
    rows += [(None, None), ("none", True), ("http://a.org", False), ("http://a.org//x///", None), ("http://a.org/" + "y/" * 11, True)]
    df = spark.createDataFrame([(i, u, label, "h", "t") for i, (u, label) in enumerate(rows)], "page_id long, url string, label boolean, host string, template string")
    got = {r.id: r for r in U.url_filter(df.repartition(3), []).collect()}
    parts = [(got[i].host, got[i].path, label) for i, (_, label) in enumerate(rows)]
    for i, (t, purity) in enumerate(brute_templates(parts)):
        assert (got[i].template, round(got[i].purity, 9)) == (t, round(purity, 9)), rows[i]
        assert got[i].verdict == ("block" if purity < U.PURITY else "allow")
    assert {r.verdict for r in got.values()} == {"block", "allow"}


def test_urls_of_nothing_and_very_long_ones(spark):
    schema = "page_id long, url string, label boolean"
    assert U.url_filter(spark.createDataFrame([], schema), []).count() == 0
    rows = [(1, "http://h.org/" + "s/" * 5000 + "x", True), (2, "http://h.org/" + "9" * 100_000, None), (None, "http://" + "h" * 50_000, False), (2, "http://h.org/" + "9" * 100_000, None)]
    got = U.url_filter(spark.createDataFrame(rows, schema), [("block", "org/s/")]).collect()
    assert len(got) == 4 and {r.verdict for r in got if r.rule} == {"block"} and max(len(r.path) for r in got) == 100_001


# ---------------------------------------------------------------------------- packing
def plain_pack(sizes, permitted, opened, overhead):
    """Best fit by looking at every bin."""
    rooms, used, where, left, clock = [], [], [], sum(sizes), itertools.count()
    for size in sizes:
        fits = [(room, -stamp, b) for b, (room, stamp) in enumerate(rooms) if room >= size and room > 0]
        if fits:
            b = min(fits)[2]
        else:
            able = [c for c in opened if c >= size] or [min(c for c in permitted if c >= size)]
            cap = min(able, key=lambda c: ((c + overhead) / min(c, left), c))
            rooms.append((cap, 0))
            used.append(0)
            b = len(rooms) - 1
        where.append((b, used[b]))
        used[b] += size
        left -= size
        rooms[b] = (rooms[b][0] - size, next(clock))
    return where, [min(c for c in permitted if c >= u) for u in used]


def best_cost(sizes, permitted, overhead):
    """The cheapest packing of all, by trying every bin for every piece."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(sizes):
            best[0] = min(best[0], sum(min(c for c in permitted if c >= b) + overhead for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= permitted[-1]:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40))
def test_packing_against_plain_best_fit(sizes):
    sizes.sort(reverse=True)
    permitted = (8, 16, 32, 64)
    plans = [plain_pack(sizes, permitted, permitted[:top], 3) for top in range(1, 5)]
    cost = lambda p: sum(c + 3 for c in p[1])
    where, caps = min(plans, key=cost)
    number, offset, got = K.pack(sizes, permitted, 3)
    assert sum(c + 3 for c in got) == cost((where, caps)) and list(zip(number, offset)) == where and got == caps


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=7))
def test_packing_is_near_the_best_of_all(sizes):
    sizes.sort(reverse=True)
    assert sum(c + 3 for c in K.pack(sizes, (8, 16, 32, 64), 3)[2]) <= 2 * best_cost(sizes, (8, 16, 32, 64), 3)


def test_packing_extra_columns(spark):
    docs = documents(spark).withColumn("bin_id", F.lit(1)).withColumn("piece", F.lit("x")).withColumn("size", F.lit(2.0)).dropDuplicates(["doc_id"])
    got = K.best_fit_pack(docs).groupBy("id").agg(F.sum("size").alias("n")).collect()
    assert {r.id: r.n for r in got} == {r.doc_id: len(words(r.text)) for r in docs.collect() if words(r.text)}


# ---------------------------------------------------------------------------- pages
LONG = "A long paragraph of article text that goes on for a while, with commas and all. " * 5


def test_pages_judged_by_their_distribution():
    long = LONG.strip()
    assert main_text(f"<div>Home</div><div>Products</div><div>Contact us</div><p>{long}</p><div>All rights reserved</div>") == long
    assert main_text(f"<article><p>{long}</p><p class='tags-intro'>{long}</p></article><div class='user-responses'><p>first!</p></div>") == f"{long}\n{long}"
    assert main_text(f"<div><p>{long}</p></div><div class='user-responses'><p>Nice article.</p><p>Agreed.</p></div>") == long
    assert main_text("<body><p><a href=x>This single paragraph is almost wholly one link</a> end</p></body>") == "This single paragraph is almost wholly one link end"
    assert main_text(f"<div>Home</div><div>About</div><div>{long}</div><div>a short one between</div><div>{long}</div><div>Imprint</div>") == f"{long}\na short one between\n{long}"
    assert main_text("<div>short</div><div>lines</div><div>only</div>") == "short\nlines\nonly"


def test_unmarked_copies_of_the_given_pages(spark):
    """The given pages without their article, menu and footer elements, and without the advert's
    name: the same texts, by the distribution alone."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    differ = 0
    for page in pages:
        bare = re.sub(r"</?article[^>]*>|</?(?:nav|footer)>", lambda m: "<div>" if m[0][1] != "/" else "</div>", page).replace('class="ad"', "")
        differ += main_text(bare) != main_text(page)
    assert differ <= 0.02 * len(pages)


def test_the_threshold_parts_long_lines_from_short():
    assert 20 < threshold([4, 8, 10, 400, 19, 600]) < 400 and threshold([50, 60, 55]) == 0 == threshold([]) == threshold([0, 7])


def test_pages_extra_columns_and_repeated_rows(spark):
    rows = [(1, f"<p>{LONG}</p>", "x", "y"), (1, f"<p>{LONG}</p>", "x", "y"), (None, None, None, None)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string, row string, text string")).collect()
    assert sorted(r.text for r in got) == ["", LONG.strip(), LONG.strip()] and {r.row.text for r in got} == {"y", None}


# ---------------------------------------------------------------------------- others
def test_quality_of_long_texts_repeated_rows_and_extra_columns(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(60, 200)), "en", "a") for i in range(260)]
    rows += [(900, sentence(rng, 200_000), "en", "a"), (901, "x" * 2_000_000, None, None), *[rows[5]] * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("row", "counts", "x", "_k", "distance", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    got = defaultdict(list)
    for r in Q.quality_rules(df).collect():
        got[r.row.doc_id].append((r.kept, r.distance, r.counts.n_words, r.row.x))
    assert len(got[5]) == 4 and len(set(got[5])) == 1 and got[900][0][2] == 200_000 and not got[900][0][0]
    assert got[901][0][:1] == (False,) and {v[3] for x in got.values() for v in x} == {"clash"}


@pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no public tokenizer files")
def test_texts_longer_than_a_call_and_extra_columns(spark):
    rng = random.Random(6)
    text = sentence(rng, CALL // 4)
    assert len(text) > CALL
    docs = spark.createDataFrame([(1, text, "a", 2), (2, "short", "b", 3)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.row.doc_id: r for r in encode(docs, sentencepiece_model(), whole=True, with_ids=False).collect()}
    assert got[1].parity and got[1].words_parity and got[1].round_trip and got[1].row.ids == "a" and got[2].row.n_tokens == 3
