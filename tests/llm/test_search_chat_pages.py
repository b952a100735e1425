"""Nearest neighbours, chat windows, url filter and page extraction."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgate.llm import chat_windows as C
from driftgate.llm.cross_polytope import hadamard, nearest, rotate
from driftgate.llm.html_blocks import extract_pages, main_text
from driftgate.llm.queries import CONTROL, RULES, op4_cross_polytope
from driftgate.llm.url_templates import url_filter


# ---------------------------------------------------------------------------- neighbours
def brute(ids, x, query, k=20):
    s = (x * x[query]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in op4_cross_polytope(spark, path).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        expected = brute(ids, x, at)
        assert sorted(found) == list(range(1, len(expected) + 1))
        hits += len({v for v, _ in found.values()} & {v for v, _ in expected})
        total += len(expected)
        for v, s in found.values():
            assert abs(s - float((x[ids == v][0] * x[at]).sum())) < 1e-12
    assert hits / total >= 0.9


def test_ties_bad_vectors_and_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)) * rng.uniform(0.5, 3, (60, 1))
    x[10:40] = x[10]  # a group of equal vectors, larger than what is returned
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + [1.0] * 7), (104, [None] + [1.0] * 7), (105, [float("inf")] * 8), (None, [1.0] * 8),
           (120, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, lambda i: i % 20 == 0, probes=10 ** 6).collect():  # all cells: exact
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.arange(60)
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        assert [(v, pytest.approx(s)) for _, v, s in sorted(found)] == brute(ids, x, q)
    assert nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert nearest(df.filter("vec_id >= 102 and vec_id < 120"), lambda i: i % 20 == 0).count() == 0


def recall(spark, x, **options):
    """The share of the true neighbours found; every query must find 20."""
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, **options).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, len(x), 100)) and {len(v) for v in got.values()} == {20}
    return np.mean([len(set(v) & {i for i, _ in brute(np.arange(len(x)), x, q)}) / 20 for q, v in got.items()])


@pytest.mark.parametrize("norms", ["one outlier", "lognormal"])
def test_recall_whatever_the_norms(spark, norms):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if norms == "one outlier":
        x[77] *= 10
    else:
        x *= rng.lognormal(0, 0.5, (8000, 1))
    assert recall(spark, x, exact=500) >= 0.9


def test_every_query_finds_its_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(700, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x[5:650] = x[5]  # all in one cell of each table
    assert recall(spark, x, exact=10, tables=1, probes=1) >= 0.9
    rows = [(i % 3, [float(v) for v in r]) for i, r in enumerate(x[:90])] + [(k, [0.5] * 32) for k in range(3, 40)]
    once = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert len({r.vec_id for r in once}) == len(once) == 20  # rows that repeat an id leave room for others


def test_rotation_keeps_angles():
    x = np.random.default_rng(2).normal(size=(5, 16))
    y = rotate(x, 3)
    np.testing.assert_allclose(x @ x.T, y @ y.T, atol=1e-9)
    np.testing.assert_allclose(hadamard(hadamard(x)), x, atol=1e-9)


# ---------------------------------------------------------------------------- chat
def conversations(spark):
    rows = [(1, 0, "system", "be kind"), (2, 0, "system", "alone"), (3, 0, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", ""),
            (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (5, 0, "user", "long " * 3000), (5, 1, "assistant", "<|" * 400 + "<\\|x<\\\\|"),
            (6, 1, "role\nwith <|im_end|>\n", "x"), (6, 0, "~user", "<|repeat|>y"), (None, 0, "user", "no id")]
    rows += [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * (k * 7 % 60)) for k in range(1, 90)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))


def test_chat_round_trip(spark):
    c = conversations(spark)
    said = {}
    for r in sorted(c.collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        said.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in C.read_windows(C.chat_windows(c, budget=120, history=3, history_budget=60)).collect()}
    assert set(got) == set(said)
    for k, turns in said.items():
        assert [tuple(t) for t in got[k].turns] == turns, k
        assert list(got[k].targets) == [t for role, t in turns if role == "assistant"]


def test_windows_keep_the_budget_and_the_system_turn(spark):
    c = conversations(spark).filter("conv_id = 1")
    text = {r.turn: r.text for r in c.collect()}
    cost = lambda t: -(-len(t) // 4) + 4
    rows = C.chat_windows(c, budget=120, history=2, history_budget=50).orderBy("window").collect()
    assert len(rows) > 10
    repeats = 0
    for r in rows:
        parts = [p.split("\n", 1) for p in r.formatted.split(C.START)[1:]]
        bodies = [b[:-len(C.END) - 1] for _, b in parts]
        assert sum(map(cost, bodies)) <= 120
        assert bodies[0] == "be kind" and parts[0][0] == ("system" if r.window == 0 else C.REPEAT + "system")
        old = [h for h, _ in parts[1:] if h.startswith(C.REPEAT)]
        repeats += len(old)
        assert len(old) <= 2 and len(r.loss) == sum(h == "assistant" for h, _ in parts)
        for s in r.loss:
            assert r.formatted[s.start:s.start + s.length] in text.values()
    assert repeats > 0
    assert C.chat_windows(c.limit(0)).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    """60,000 turns of one conversation, and 60,000 rows without an id that all say turn 0: the
    windows keep the budget and every turn comes back, in time that grows with the turns."""
    import time
    ids = spark.range(60_000)
    long = ids.select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "assistant")
                      .otherwise("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit(" w"), (F.col("id") % 40).cast("int"))).alias("text"))
    ties = ids.select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    took = time.time()
    w = C.chat_windows(long.union(ties), budget=200, history_budget=40).persist()
    back = {r.conv_id: r for r in C.read_windows(w).select("conv_id", F.size("turns").alias("n"), F.size("targets").alias("t"), F.get("turns", F.lit(59_999))["text"].alias("last"),
                                                           F.get("turns", F.lit(31))["text"].alias("some")).collect()}
    assert time.time() - took < 120
    assert (back[1].n, back[1].t, back[1].last.split()[0], back[1].some.split()[0]) == (60_000, 29_999, "t59999", "t31")
    assert (back[None].n, back[None].t) == (60_000, 0)
    cost = F.aggregate(F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 10**6), F.lit(0).cast("long"), lambda a, p: a + F.ceil(
        (F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(C.END)) / 4) + 4)
    full = w.select(F.max(cost), F.avg(cost)).first()
    assert full[0] <= 200 and full[1] > 120


def test_chat_plan_is_native(spark):
    plan = C.read_windows(C.chat_windows(conversations(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="<|\\ab>\n", max_size=12))
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).first()
    assert row.u == text and "<|" not in row.e


# ---------------------------------------------------------------------------- urls
def brute_rule(host, path):
    best = None
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_rules_and_parts_of_urls(spark):
    cases = {
        "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1"), "https://www.example.com/en/": ("www.example.com", "/en/"),
        "http://x.net/es/": ("x.net", "/es/"), "http://net/fr/a": ("net", "/fr/a"), "http://cnet/fr/a": ("cnet", "/fr/a"), "no scheme": ("", ""),
        "": ("", ""), None: ("", ""), "http://h.com": ("h.com", ""), "http://h.com?a=/b": ("h.com", ""), "a://b://c/d": ("b:", "//c/d"),
        "http://x.net/esx": ("x.net", "/esx"), "http://": ("", ""), "HTTP://ÄB.org/é\nx": ("Äb.org", "/é\nx"),
    }
    rows = [(i, u, None) for i, u in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, label boolean").withColumn("host", F.lit("clash"))
    got = url_filter(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = list(cases.values())[r.id]
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_filter(df.limit(0), RULES).count() == 0


def test_templates_by_purity(spark):
    rows = []
    for i in range(400):  # /good and /blog are alike and merge; /spam differs and is rejected
        rows += [(f"http://h.org/good/{i}", i % 10 > 0), (f"http://h.org/blog/{i}.html", i % 10 > 0), (f"http://h.org/spam/p{i}", i % 10 == 0)]
        rows.append((f"http://h.org/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/about", None))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, label boolean")
    got = {r.path.strip("/").split("/")[0]: r for r in url_filter(df, []).collect()}
    assert (got["good"].template, got["blog"].template) == ("/~blog/*", "/~blog/*.html")
    assert got["spam"].template == "/spam/*" and got["spam"].verdict == "block"
    assert {r.verdict for k, r in got.items() if k != "spam"} == {"allow"}
    assert got["user-aa"].template.startswith("/*/")


def test_small_branches_of_a_hot_host(spark):
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(f"http://h.org/{name(b)}/{i}", True) for b in range(200) for i in range(60)]
    rows += [(f"http://h.org/casino/{i}", False) for i in range(100)]  # under 1 % of the host's urls
    rows += [(f"http://h.org/top{i}/x", False) for i in range(50)] + [(f"http://h.org/mp{i}/x", True) for i in range(50)]
    rows += [(f"http://h.org/casino/{i}", None) for i in range(100, 200)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, label boolean")
    blocked = {r.path.strip("/0123456789x") for r in url_filter(df, []).collect() if r.verdict == "block"}
    assert blocked == {"casino", "top"}


# ---------------------------------------------------------------------------- pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Home</a><p>Site header</p></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side <p>bar</p></aside>
%s<form><label>Mail</label><input name=m><button>Send</button></form>
<section id="comments"><p>First!</p></section><footer>&copy; all</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>One  two\n three<b>four</b>.<p class=lead>Caf&eacute; &#x41;&#66;<br>next</p><div class='ad banner'>Buy</div><!-- <p>no</p> --><ul><li>x<li>y</ul><blockquote>Be.</blockquote>"
TEXT = "A & B\nOne two threefour.\nCafé AB next\nx\ny\nBe."


@pytest.mark.parametrize("holder", ["<article>%s</article>", "<main><article class='post'>%s</article></main>", "<div class='content'>%s</div>"])
def test_main_text(holder):
    assert main_text(PAGE % (holder % BODY)) == TEXT


@pytest.mark.parametrize("wrapper", ["%s", "<div class='form'>%s</div>", "<form id=aspnetForm>%s</form>", "<div class='legal'><div id=side>%s</div></div>"])
def test_unmarked_pages_lose_nothing(wrapper):
    ad, long = "<div class=ad>x</div>", "long text " * 60
    links = "<ul>" + "<li><a href=x>Other page</a></li>" * 5 + "</ul>"
    page = "<body><nav>Menu</nav>" + wrapper % f"<h1>Title</h1>{ad}<p>{long}</p>{ad}<p>closing paragraph</p>{links}<p>A note.</p>" + "<footer>all</footer></body>"
    assert main_text(page) == f"Title\n{long.strip()}\nclosing paragraph\nA note."


def test_cut_off_empty_and_long_pages(spark):
    whole = PAGE % ("<article>" + BODY + "</article>")
    for n in range(0, len(whole), 7):  # a page may end anywhere
        text = main_text(whole[:n])
        assert "no" not in text.split("\n") and "cookies" not in text
    long = "<article>" + "<p>word &lt; word</p>" * 20000 + "</article>"
    rows = [(1, None), (2, ""), (3, long), (4, whole), (4, whole), (5, "<p>only"), (6, "plain &am")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))).collect()
    expected = {1: "", 2: "", 3: "\n".join(["word < word"] * 20000), 4: TEXT, 5: "only", 6: "plain &am"}
    assert len(got) == len(rows) and all(r.text == expected[r.row.page_id] for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
