"""Quality rules: robust multivariate outliers by a minimum covariance determinant.

Base counts of every whole text are made with built-in functions only. Five transformed
statistics of each document (length, word length, symbol share, repeated-line share,
repeated-window share) form a vector. For every (language, source) group the minimum
covariance determinant is sought by concentration steps from several deterministic starts:
distances under the present mean and scatter, the ``H`` share of nearest documents, their mean
and scatter, and so on. Of the starts' results the one of least determinant is the group's, and
is reweighted. The starts are medians with quartile spreads; the plain mean and scatter; each
statistic's shortest interval that holds the share ``H`` (its middle and width, which withstand
all but ``H`` of the documents); and that with the correlations of the so standardised
statistics' hyperbolic tangents, and of their spatial signs. Documents whose Mahalanobis distance under the final, reweighted estimate passes the
chi-square cutoff are rejected.

A concentration step never gathers a group: documents fall into logarithmic distance bins,
each (group, bin) keeps a count, five sums and fifteen sums of products (exact integers, so
the result does not depend on partitioning), and the subset is the nearest whole bins that
hold the share. Only these bounded summaries are shuffled; a hot group is reduced map-side.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.common import Scratch

#: Transformed statistics are kept as integers of 1 / SCALE.
SCALE = 4096
#: Share of a group's documents in the concentrated subset.
H = 0.6
STEPS = 6
#: Groups with fewer usable documents are pooled by language, then over all documents.
MIN_GROUP = 200
#: Quantiles of chi-square with five degrees of freedom: reweighting, rejection.
REWEIGHT, REJECT = 0.975, 0.999
#: Resolution of each statistic, a ridge on the estimated scatter (as standard deviation), which
#: keeps it regular where most documents agree exactly: a tenth of a length, the sampling error
#: of the mean word length over the 50 words that the base rules ask for, one symbol in a
#: thousand characters, one line or word in a hundred.
FLOORS = {"length": 0.1, "word_length": 0.05, "symbols": 0.03, "dup_lines": 0.1, "repeats": 0.1}
STATS = list(FLOORS)
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_BINS = 16  # bins for each doubling of the squared distance
WS = "[\\x20\\x09-\\x0D]"


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for odd degrees of freedom, in closed form."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < q else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Factor by which the scatter of the nearest ``share`` of a normal sample is too small."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``_c``: n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words. A null text counts as empty.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes with their
    positions inside the row, so no text of any length is shuffled or compared pairwise.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", F.array_remove(F.split(F.regexp_replace(t, "[\\x09-\\x0D]", " "), " ", -1), ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select("*", F.size("_w").cast("long").alias("_n"), F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
                   (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("_sym"),
                   lines.alias("_lines"))
    grams = F.when(F.col("_n") >= 3, F.transform(
        F.sequence(F.lit(0), (F.col("_n") - 3).cast("int")),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    df = df.withColumn("_g", grams)
    plain = (F.col("_n") < 3) | (F.size(F.array_distinct("_g")) == F.size("_g"))
    df = df.withColumn("_s", F.when(~plain, F.array_sort(F.transform(
        "_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    g = lambda j: F.get("_s", j)["g"]  # noqa: E731  null outside the array
    twice = F.filter(F.transform("_s", lambda x, j: F.when(
        x["g"].eqNullSafe(g(j - 1)) | x["g"].eqNullSafe(g(j + 1)), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_p", F.array_sort(twice))
    covered = F.aggregate(F.transform("_p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - x, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    df = df.withColumn("_c", F.struct(
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_sym").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))
    return df.drop("_w", "_n", "_chars", "_sym", "_lines", "_g", "_s", "_p")


def statistic_vector(c: Column) -> dict[str, Column]:
    """The transformed statistics as integers of 1 / SCALE: logarithms of sizes, square
    roots of shares (their spread does not depend on their size)."""
    one = F.lit(1.0)
    values = {
        "length": F.log1p(c["n_words"].cast("double")),
        "word_length": F.log1p(c["word_chars"] / F.greatest(c["n_words"], F.lit(1))),
        "symbols": F.sqrt(F.least(one, c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1)))),
        "dup_lines": F.sqrt(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))),
        "repeats": F.sqrt(F.least(one, c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1)))),
    }
    return {k: F.round(v * SCALE).cast("long") for k, v in values.items()}


#: Steps of the grid of quantiles between which the shortest interval is sought.
GRID = 0.05
#: Width of the middle ``H`` of a standard normal sample.
_WIDTH = 2 * NormalDist().inv_cdf((1 + H) / 2)


def _medians(rows: DataFrame) -> DataFrame:
    """Per group, of value counts (each statistic has a bounded number of integer values): size,
    medians m and quartile spreads sd, middles h and spreads hd of the shortest intervals."""
    long = rows.select("_k", F.posexplode(F.array(*[F.floor(F.col(f"x.{s}") / 16) for s in STATS])).alias("j", "v"))
    counts = long.groupBy("_k", "j", "v").count()
    w = Window.partitionBy("_k", "j").orderBy("v")
    run = counts.select("_k", "j", "v", F.sum("count").over(w).alias("upto"),
                        F.sum("count").over(Window.partitionBy("_k", "j")).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("v"))) * (16 / SCALE)
    grid = [round(k * GRID, 2) for k in range(round(1 / GRID) + 1)]
    q = run.groupBy("_k", "j").agg(F.max("n").alias("n"), at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("iqr"), F.array(*[at(g) for g in grid]).alias("q"))
    span = round(H / GRID)
    intervals = F.array(*[F.struct((F.get("q", F.lit(k + span)) - F.get("q", F.lit(k))).alias("w"), F.lit(k).alias("k"),
                                   ((F.get("q", F.lit(k + span)) + F.get("q", F.lit(k))) / 2).alias("h")) for k in range(len(grid) - span)])
    q = q.withColumn("short", F.array_min(intervals))
    pick = lambda c, j: F.max(F.when(F.col("j") == j, F.col(c)))
    out = q.groupBy("_k").agg(F.max("n").alias("n"), *[pick(c, j).alias(f"{a}{j}") for c, a in (("m", "m"), ("iqr", "r"), ("short.h", "h"), ("short.w", "v"))
                                                       for j in range(P)])
    return out.select("_k", "n", *[f"{a}{j}" for a in "mh" for j in range(P)],
                      *[F.greatest(F.col(f"r{j}") / 1.349, F.lit(FLOORS[s])).alias(f"sd{j}") for j, s in enumerate(STATS)],
                      *[F.greatest(F.col(f"v{j}") / _WIDTH, F.lit(FLOORS[s])).alias(f"hd{j}") for j, s in enumerate(STATS)])


def _sums(x: list[Column]) -> list[Column]:
    return [F.sum(x[j]).alias(f"s{j}") for j in range(P)] + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS]


def _starts(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """(_k, _s, n, mean, inverse factor, logdet) of every start ``_s``."""
    z = [(F.col(f"x.{s}") / SCALE - F.col(f"h{j}")) / F.col(f"hd{j}") for j, s in enumerate(STATS)]
    norm = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    whole = lambda v: F.round(v * SCALE).cast("long")
    diagonal = lambda k, m, sd: _cholesky(medians.select("_k", F.lit(k).alias("_s"), "n", *[F.col(f"{m}{j}").alias(f"m{j}") for j in range(P)], *[
        (F.col(f"{sd}{i}") * F.col(f"{sd}{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]))
    plain = rows.groupBy("_k").agg(F.count("*").alias("s_n"), *_sums([F.col(f"x.{s}") for s in STATS]))
    made = [diagonal(0, "m", "sd"), _factor(plain.select(F.lit(1).alias("_s"), F.col("s_n").alias("n"), "*"), 1.0), diagonal(2, "h", "hd")]
    joined = rows.join(medians, "_k")
    for k, y in ((3, [F.tanh(v) for v in z]), (4, [F.when(norm > 0, v / norm).otherwise(0.0) for v in z])):
        g = joined.groupBy("_k").agg(F.count("*").alias("s_n"), *_sums([whole(v) for v in y])).join(medians, "_k")
        c = {(i, j): F.col(f"q{i}{j}") / F.col("s_n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("s_n") / F.col("s_n") for i, j in PAIRS}
        both = lambda i, j: F.sqrt(F.greatest(c[i, i], F.lit(1e-9)) * F.greatest(c[j, j], F.lit(1e-9)))
        made.append(_cholesky(g.select("_k", F.lit(k).alias("_s"), "n", *[F.col(f"h{j}").alias(f"m{j}") for j in range(P)], *[
            (F.col(f"hd{i}") * F.col(f"hd{j}") * (F.lit(1.0) if i == j else c[i, j] / both(i, j)) + (FLOORS[STATS[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
            for i, j in PAIRS])))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _distance(x: Column) -> Column:
    """Squared Mahalanobis distance: sum of squares of W (x - m), W the inverse Cholesky
    factor of the scatter."""
    d = [x[s] / SCALE - F.col(f"m{j}") for j, s in enumerate(STATS)]
    total = None
    for i in range(P):
        y = None
        for j in range(i + 1):
            t = F.col(f"w{i}{j}") * d[j]
            y = t if y is None else y + t
        total = y * y if total is None else total + y * y
    return total


def _factor(moments: DataFrame, factor: float) -> DataFrame:
    """Mean and inverse Cholesky factor of the scatter from counts, sums and products."""
    n = F.col("s_n")
    df = moments.select("_k", "_s", "n", "s_n", *[(F.col(f"s{j}") / n / SCALE).alias(f"m{j}") for j in range(P)],
                        *[F.col(f"q{i}{j}") for i, j in PAIRS])
    cov = {}
    for i, j in PAIRS:
        c = (F.col(f"q{i}{j}") / n / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        # The resolution goes on the diagonal, so the scatter stays regular whatever the data.
        cov[i, j] = F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[STATS[i]] ** 2) if i == j else c
    return _cholesky(df.select("*", *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()]))


def _cholesky(df: DataFrame) -> DataFrame:
    """The inverse Cholesky factor of the scatter c, and the logarithm of its determinant."""
    for i in range(P):  # Cholesky factor, then its inverse, one column after another
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i, -1, -1):
            if i == j:
                v = 1 / F.col(f"l{i}{i}")
            else:
                v = F.lit(0.0)
                for k in range(j, i):
                    v = v - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                v = v / F.col(f"l{i}{i}")
            df = df.withColumn(f"w{i}{j}", v)
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return df.select("_k", "_s", "n", *[f"m{j}" for j in range(P)], *[f"w{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _concentrate(rows: DataFrame, est: DataFrame, share: float | None, cutoff: float | None, factor: float, scratch: Scratch) -> DataFrame:
    """One step from every estimate (_k, _s): moments of the nearest ``share`` of each group,
    or of all documents within ``cutoff``, and the estimate they give."""
    d = rows.join(est, "_k").select("_k", "_s", "n", "x", _distance(F.col("x")).alias("d"))
    if cutoff is not None:
        d = d.filter(F.col("d") <= cutoff)
    b = F.floor(F.log2(F.col("d") + 2.0 ** -10) * _BINS).cast("int") if share is not None else F.lit(0)
    x = [F.col(f"x.{s}") for s in STATS]
    names = [f"s{j}" for j in range(P)] + [f"q{i}{j}" for i, j in PAIRS]
    bins = d.groupBy("_k", "_s", b.alias("b")).agg(F.max("n").alias("n"), F.count("*").alias("s_n"), *_sums(x))
    if share is not None:
        # Written, so that a hot group's partial sums meet by bin; the window sees a group's bins only.
        bins = scratch.write(bins)
        before = F.coalesce(F.sum("s_n").over(Window.partitionBy("_k", "_s").orderBy("b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("before", before).filter(F.col("before") < F.ceil(F.col("n") * share))
    # Integer sums of a few bins; decimals keep them exact beyond 64 bits.
    total = bins.groupBy("_k", "_s").agg(F.max("n").alias("n"), F.sum("s_n").alias("s_n"),
                                         *[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in names])
    return _factor(total, factor)


def estimate(rows: DataFrame, scratch: Scratch, steps: int = STEPS, share: float = H) -> DataFrame:
    """The reweighted minimum covariance determinant of every group of ``rows`` (_k, x): of all
    starts' concentrated estimates the one of least determinant (the first, if several)."""
    est = scratch.write(_starts(rows, scratch.write(_medians(rows))))
    for _ in range(steps):
        est = scratch.write(_concentrate(rows, est, share, None, consistency(share), scratch))
    best = est.groupBy("_k").agg(F.min(F.struct(F.round("logdet", 6).alias("logdet"), "_s")).alias("b")).select("_k", F.col("b._s").alias("_s"))
    best = scratch.write(est.join(best, ["_k", "_s"]))
    return scratch.write(_concentrate(rows, best, None, chi2_quantile(REWEIGHT, P), consistency(REWEIGHT), scratch))


def quality_rules(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang",
                  source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Judge every row of ``docs``.

    Returns ``row`` (struct of the ``carry`` columns, default all), ``counts`` (struct of the
    base counts), ``base_failed``, ``distance`` (squared Mahalanobis distance) and ``kept``.
    Null text: no words, so it fails the base rules. Null language or source: a group of its
    own. Repeated rows are judged alike, each on its own. An empty table gives no rows. Other
    columns, whatever their names, only travel inside ``row``.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "quality")
    carry = docs.columns if carry is None else carry
    key = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))
    by_lang = F.to_json(F.struct(F.col(lang).alias("l")))
    one = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), key.alias("_k3"), by_lang.alias("_k2"),
                      F.col(text).alias("_text"))
    one = base_counts(one, "_text").drop("_text")
    c = F.col("_c")
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    one = scratch.write(one.select("row", "_k3", "_k2", F.col("_c").alias("counts"), failed.alias("base_failed"),
                                   F.struct(*[v.alias(k) for k, v in statistic_vector(c).items()]).alias("x")))
    usable = one.filter(~F.col("base_failed"))
    # Which group each document is judged in: its own, its language's, or all documents'.
    sizes = usable.groupBy("_k3", "_k2").count()
    small = sizes.filter(F.col("count") < min_group)
    lang_n = small.groupBy("_k2").agg(F.sum("count").alias("n2"))
    known = one.select("_k3", "_k2").distinct()
    groups = scratch.write(known.join(sizes, ["_k3", "_k2"], "left").join(lang_n, "_k2", "left").select(
        "_k3", "_k2", F.when(F.col("count") >= min_group, F.col("_k3"))
        .when(F.col("n2") >= min_group, F.col("_k2")).otherwise("*").alias("_k")))
    rows = usable.join(groups, ["_k3", "_k2"]).select("_k", "x")
    est = estimate(scratch.write(rows), scratch)
    out = one.join(groups, ["_k3", "_k2"], "left").join(est, "_k", "left").withColumn("distance", _distance(F.col("x")))
    verdict = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(REJECT, P))
    return out.select("row", "counts", "base_failed", "distance", verdict.alias("kept"))
