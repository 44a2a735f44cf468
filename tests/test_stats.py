import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.functions.stats import mann_whitney_p, spearman_p
from tracemill.operators import comparison as G
from tracemill.operators.ranks import average_ranks, rank_sums, spearman

# Published two-sided p by group sizes and larger U.
GOLDEN = {
    (5, 15): {41: 0.8001, 42: 0.7354, 44: 0.6116, 47: 0.4445, 52: 0.2300},
    (11, 9): {52: 0.8792, 53: 0.8197, 64: 0.2875, 65: 0.2545, 68: 0.1715, 71: 0.1106},
    (10, 10): {52: 0.9097, 53: 0.8501, 54: 0.7913, 57: 0.6232, 60: 0.4727, 81: 0.0211},
}


@pytest.mark.parametrize("sizes", GOLDEN)
def test_mann_whitney_golden(sizes):
    for u, p in GOLDEN[sizes].items():
        assert mann_whitney_p(u, *sizes, 0) == pytest.approx(p, abs=6e-5)
        assert mann_whitney_p(sizes[0] * sizes[1] - u, *sizes, 0) == pytest.approx(p, abs=6e-5)


def test_mann_whitney_edges():
    assert mann_whitney_p(0, 1, 5, 0) == 1.0
    assert mann_whitney_p(12.5, 5, 5, 10**3 - 10) == 1.0  # all values equal
    assert 0 < mann_whitney_p(0, 20, 20, 6) < 1e-6


@pytest.mark.parametrize("rho,p", [(0.390, 0.0887), (-0.230, 0.3287), (0.552, 0.0116), (0.511, 0.0214), (0.270, 0.2493), (0.288, 0.2187)])
def test_spearman_golden(rho, p):
    assert spearman_p(rho, 20) == pytest.approx(p, abs=1.5e-3)


def test_spearman_edges():
    assert spearman_p(0.5, 2) == 1.0 and spearman_p(1.0, 9) == 0.0 and spearman_p(0.0, 9) == pytest.approx(1.0)


def plain_ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


def test_ranks_and_correlation(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([rng.randrange(12), rng.random() * 30])), rng.random() < 0.4) for g in "ab" for _ in range(700)] + [("c", 1.0, True), ("c", 1.0, False), ("c", 1.0, True), ("d", 1.0, True), ("d", 2.0, False)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean")
    got = {(r.g, r.x): (r.n, r.rank) for r in average_ranks(df, ["g"], "x", {}).collect()}
    sums, rho = {r.g: r for r in rank_sums(df, ["g"], "x", "y").collect()}, {r.g: r.rho for r in spearman(df.withColumn("y", F.col("y").cast("int")), ["g"], "x", "y").collect()}
    for g in "abcd":
        x, y = [r[1] for r in rows if r[0] == g], [int(r[2]) for r in rows if r[0] == g]
        ranks = plain_ranks(x)
        assert all(got[g, v] == (x.count(v), k) for v, k in zip(x, ranks))
        n1 = sum(y)
        assert sums[g].u == pytest.approx(sum(k for k, b in zip(ranks, y) if b) - n1 * (n1 + 1) / 2)
        assert sums[g].ties == sum(x.count(v) ** 3 - x.count(v) for v in set(x))
        ry, m = plain_ranks(y), (len(x) + 1) / 2
        cov, vx, vy = sum((a - m) * (b - m) for a, b in zip(ranks, ry)), sum((a - m) ** 2 for a in ranks), sum((b - m) ** 2 for b in ry)
        want = cov / math.sqrt(vx * vy) if vx * vy and len(x) >= 3 else 0.0
        assert rho[g] == pytest.approx(want, abs=1e-12)


def test_group_comparison_small_and_constant(spark):
    rows = [("f", True, 1.0), ("f", True, 1.0), ("f", False, 1.0), ("f", False, 1.0), ("g", True, 1.0), ("g", False, 2.0), ("g", False, 3.0)]
    long = spark.createDataFrame(rows, "feature string, is_correct boolean, value double").withColumn("m", F.lit("x"))
    got = {r.feature: r for r in G.with_p(G.group_comparison(long, ["m"])).collect()}
    assert got["f"].cohens_d == 0.0 and got["f"].p == 1.0 and not got["f"].significant and got["f"].note is None
    assert got["g"].p == 1.0 and got["g"].cohens_d == 0.0 and got["g"].note == "insufficient_data"
    other = {r.feature: r.cohens_d for r in G.group_comparison(long, ["m"], 1e-9).collect()}
    assert other["f"] == 0.0


def test_minus_one_is_left_out_of_every_feature(spark):
    f = spark.createDataFrame([("m", True, -1, 0.5), ("m", False, 3, -1.0)], "model_name string, is_correct boolean, a int, b double")
    got = {(r.feature, r.value) for r in G.long_features(f, ["model_name"], ["a", "b"]).collect()}
    assert got == {("a", 3.0), ("b", 0.5)}


def _table_tail(u, n1, n2):
    """The exact tail from the whole distribution, value by value."""
    counts = [1]
    few, many = sorted((n1, n2))
    for i in range(1, few + 1):  # times (1 - q^(many + i)) / (1 - q^i)
        counts = counts + [0] * (few * many + 1 - len(counts)) if len(counts) < few * many + 1 else counts
        for k in range(few * many, many + i - 1, -1):
            counts[k] -= counts[k - many - i]
        for k in range(i, few * many + 1):
            counts[k] += counts[k - i]
    low = math.floor(min(u, n1 * n2 - u) + 1e-9)
    return min(1.0, 2 * sum(counts[: low + 1]) / math.comb(n1 + n2, few))


def test_exact_tail_against_the_whole_distribution():
    for n1, n2 in [(2, 2), (3, 9), (5, 15), (8, 8), (8, 40), (7, 100), (1, 5)]:
        for u in range(n1 * n2 + 1):
            assert math.isclose(stats.exact_u_tail(u, n1, n2), _table_tail(u, n1, n2), rel_tol=1e-12), (u, n1, n2)


def test_exact_tail_of_large_groups():
    """8 against 10^8 in little memory; near the normal approximation, as it must be."""
    import time
    import tracemalloc

    n1, n2 = 8, 10**8
    mean, sd = n1 * n2 / 2, math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    tracemalloc.start()
    began = time.time()
    for z in (0.0, 0.5, 1.0, 2.0, 3.0):
        p = stats.exact_u_tail(float(round(mean + z * sd)), n1, n2)
        assert abs(p - math.erfc(z / math.sqrt(2))) < 0.01
    assert stats.exact_u_tail(0, n1, n2) == pytest.approx(2 * math.factorial(8) / n2**8, rel=1e-6)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and time.time() - began < 20
    tracemalloc.stop()
