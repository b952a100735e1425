"""Quality rules against a plain numpy version of the same estimate."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
from cases import documents, sentence, words

from driftgate.llm import quality_rules as Q


def brute_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_counts(spark):
    rows = Q.quality_rules(documents(spark)).collect()
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    assert len(rows) == len(texts) + 1
    for r in rows:
        expected = brute_counts(texts[r.row.doc_id])
        assert r.counts.asDict() == expected, r.row.doc_id
        n, rep = expected["n_words"], expected["n_repeat_words"]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def vector(c):
    one = lambda x: min(1.0, x)
    v = [math.log1p(c["n_words"]), math.log1p(c["word_chars"] / max(1, c["n_words"])), math.sqrt(one(c["n_symbols"] / max(1, c["word_chars"]))),
         math.sqrt(c["n_dup_lines"] / max(1, c["n_lines"])), math.sqrt(one(c["n_repeat_words"] / max(1, c["n_words"])))]
    return [math.floor(x * Q.SCALE + 0.5) for x in v]


def brute_distances(x):
    """Concentration steps on whole distance bins from every start, as the operator defines
    them; the result of least determinant, reweighted."""
    floors = np.array(list(Q.FLOORS.values()))
    real = x / Q.SCALE
    v = np.sort(x // 16, 0) * 16 / Q.SCALE
    at = lambda q: v[math.ceil(len(v) * q) - 1]
    middle, sd = at(0.5), np.maximum((at(0.75) - at(0.25)) / 1.349, floors)
    grid = np.stack([v[max(0, math.ceil(len(v) * round(k * 0.05, 2)) - 1)] for k in range(21)])
    width = grid[12:] - grid[:9]
    first = width.argmin(0)
    pick = lambda a: a[first, np.arange(a.shape[1])]
    short, hd = pick((grid[12:] + grid[:9]) / 2), np.maximum(pick(width) / Q._WIDTH, floors)
    z = (real - short) / hd
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    signs = np.where(norm > 0, z / np.where(norm > 0, norm, 1), 0)

    def distances(mean, cov):
        d = real - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    def moments(use, factor):
        m = real[use].mean(0)
        return m, (real[use].T @ real[use] / use.sum() - np.outer(m, m)) * factor + np.diag(floors ** 2)

    def shape(y):
        r = np.corrcoef(np.floor(y * Q.SCALE + 0.5).T)
        r = np.where(np.isnan(r), 0, r)
        np.fill_diagonal(r, 1)
        return short, r * np.outer(hd, hd) + np.diag(floors ** 2)

    starts = [(middle, np.diag(sd ** 2)), moments(np.ones(len(x), bool), 1.0), (short, np.diag(hd ** 2)), shape(np.tanh(z)), shape(signs)]
    found = []
    for mean, cov in starts:
        for _ in range(Q.STEPS):
            bins = np.floor(np.log2(distances(mean, cov) + 2.0 ** -10) * Q._BINS)
            kept, need = set(), math.ceil(len(x) * Q.H)
            for b, n in sorted(Counter(bins).items()):
                if need <= 0:
                    break
                kept.add(b)
                need -= n
            mean, cov = moments(np.isin(bins, list(kept)), Q.consistency(Q.H))
        found.append((round(np.linalg.slogdet(cov)[1], 6), len(found), mean, cov))
    _, _, mean, cov = min(found, key=lambda f: f[:2])
    mean, cov = moments(distances(mean, cov) <= Q.chi2_quantile(Q.REWEIGHT, Q.P), Q.consistency(Q.REWEIGHT))
    return distances(mean, cov)


def vectors(spark, x):
    """Vectors as the estimate's rows, all of one group."""
    rows = [("g", tuple(int(round(v * Q.SCALE)) for v in r)) for r in x]
    return spark.createDataFrame(rows, "_k string, x struct<" + ",".join(f"{s}:bigint" for s in Q.STATS) + ">")


def fast_mcd(x, h, starts=300, seed=1):
    """An independent estimate: the least determinant over concentration from many random
    subsets of six points, on exact subsets of h points."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        use = rng.choice(len(x), x.shape[1] + 1, replace=False)
        for _ in range(30):
            m, c = x[use].mean(0), np.cov(x[use].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            new = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), kind="stable")[:h]
            if set(new) == set(use):
                break
            use = new
        det = np.linalg.slogdet(np.cov(x[use].T, bias=True))[1]
        if det < best[0]:
            best = (det, set(use.tolist()))
    return best


def test_least_determinant_with_a_contaminated_cluster(spark):
    """35 % of the vectors lie in a cluster apart: the subset is that of an independent search,
    and the cluster is rejected while the rest is kept."""
    from driftgate.llm.common import Scratch
    rng = np.random.default_rng(9)
    mix = rng.normal(size=(5, 5))
    good = rng.normal(size=(650, 5)) @ mix + 5
    bad = rng.normal(size=(350, 5)) @ mix + 5 + 8 * mix.sum(0)
    x = np.round(np.concatenate((good, bad)) * Q.SCALE) / Q.SCALE
    rows = vectors(spark, x).repartition(4)
    est = Q.estimate(rows, Scratch(spark, "t"))
    one = est.first()
    assert est.count() == 1
    d = [r.d for r in rows.join(est, "_k").select(Q._distance(Q.F.col("x")).alias("d"), Q.F.col(f"x.{Q.STATS[0]}").alias("v")).collect()]
    assert len(d) == len(x)
    low = rows.join(est, "_k").select("x", Q._distance(Q.F.col("x")).alias("d")).filter(Q.F.col("d") <= Q.chi2_quantile(Q.REJECT, Q.P)).collect()
    kept = {tuple(r.x) for r in low}
    is_kept = [tuple(int(round(v * Q.SCALE)) for v in r) in kept for r in x]
    assert sum(is_kept[:650]) >= 0.95 * 650 and sum(is_kept[650:]) == 0
    _, subset = fast_mcd(x, math.ceil(len(x) * Q.H))
    centre = x[sorted(subset)].mean(0)
    assert max(subset) < 650 and np.abs(np.array([one[f"m{j}"] for j in range(5)]) - centre).max() < 0.5


def test_outliers_against_numpy(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        text = sentence(rng, rng.randint(60, 400))
        if i % 25 == 0:
            text = text.replace(" ", " %%$ ")
        rows.append((i, text, "en", "a" if i < 260 else f"small{i % 9}"))
    got = {r.row.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    groups = defaultdict(list)
    for i, t, _, s in rows:  # sources of under MIN_GROUP documents are pooled by language
        if not got[i].base_failed:
            groups["a" if s == "a" else "pool"].append(i)
    assert all(len(g) >= Q.MIN_GROUP for g in groups.values())
    for members in groups.values():
        x = np.array([vector(brute_counts(rows[i][1])) for i in members])
        expected = brute_distances(x)
        np.testing.assert_allclose([got[i].distance for i in members], expected, rtol=1e-6)
        assert [got[i].kept for i in members] == (expected <= Q.chi2_quantile(Q.REJECT, Q.P)).tolist()
    assert all(got[i].kept == (i % 25 != 0) for i in got)


def test_outliers_in_one_statistic(spark):
    rng = random.Random(5)
    text = lambda n: sentence(rng, n).split()
    lines = lambda w, n: "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
    clean = [lines(text(rng.randint(150, 250)), 10) for _ in range(400)]
    w = text(220)
    planted = {
        "length": lines(text(4000), 10), "word_length": lines([x + x[:3] for x in text(220)], 10),
        "symbols": lines([x + "#" * (i % 8 == 0) for i, x in enumerate(text(220))], 10),
        "dup_lines": "\n".join(x for i, v in enumerate(w) for x in ([v, "again"] if i % 3 else [v])),  # no 3 words repeat
        "repeats": lines(w[:170] + w[1:51], 11),  # no line repeats
    }
    rows = [(i, t, "en", "a") for i, t in enumerate([*clean, *planted.values()])]
    got = {r.row.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    middle = np.median([vector(brute_counts(t)) for t in clean], 0) / Q.SCALE
    for i, name in enumerate(planted, len(clean)):
        off = np.abs(np.array(vector(brute_counts(rows[i][1]))) / Q.SCALE - middle)
        assert not got[i].base_failed and not got[i].kept, name
        assert name == "dup_lines" or off[Q.STATS.index("dup_lines")] == 0, name
        assert name == "repeats" or off[Q.STATS.index("repeats")] == 0, name
    assert sum(got[i].kept for i in range(len(clean))) >= 0.98 * len(clean)


def test_empty_table(spark):
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_chi_square():
    assert abs(Q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(Q.chi2_cdf(11.0705, 5) - 0.95) < 1e-4


def test_plan_is_native(spark):
    plan = Q.quality_rules(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
