"""R1/R3/R5, W7, M5 on the hand fixtures."""
import math

import pytest

from geolex.functions import stats as stx
from geolex.operators import wordmodel


def p_of(spark, pairs):
    df = spark.createDataFrame(pairs, "r double, n int")
    return [r[0] for r in df.select(stx.corr_p_value("r", "n")).collect()]


def test_r3_table_points(spark):
    # critical t values at p = 0.05 converted to r = t / sqrt(t^2 + nu)
    pts = [(12.706205, 1), (2.228139, 10), (2.085963, 20)]
    pairs = [(t / math.sqrt(t * t + nu), nu + 2) for t, nu in pts]
    for p in p_of(spark, pairs):
        assert p == pytest.approx(0.05, abs=2e-7)


def test_r3_edges(spark):
    out = p_of(spark, [(1.0, 10), (0.0, 10), (None, 10), (-0.982708, 4), (0.3, 3203)])
    assert out[0] == 0.0 and out[1] == pytest.approx(1.0) and out[2] is None
    assert out[3] == pytest.approx(0.017292, abs=1e-6)
    assert 0.0 < out[4] < 1e-60


def obs_df(spark, xs, ys):
    rows = [(i, "w", x, y, y, y, y) for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "fip int, word string, x double, y0 double, y1 double, y2 double, y3 double")


@pytest.mark.parametrize("xs,ys,r,p", [
    ([.1, .2, .3, .4], [.10, .20, .30, .50], 0.982708, 0.017292),
    ([.1, .2, .3, .4, .5], [.3, .1, .4, .2, .5], 0.5, 0.391002),
])
def test_r1_regression(spark, xs, ys, r, p):
    m = wordmodel.fit_word_model(obs_df(spark, xs, ys), min_n=3, bonferroni=False, gate=False)
    rows = m.filter("level = 0").collect()
    assert rows[0].slope == pytest.approx(r, abs=1e-6)
    assert rows[0].pval == pytest.approx(p, abs=1e-6)
    assert rows[0]["count"] == len(xs)


def test_r1_constant_x_is_null_and_weight_zero(spark):
    df = obs_df(spark, [.1, .1, .1, .1], [.1, .2, .3, .4])
    raw = wordmodel.fit_word_model(df, bonferroni=False, gate=False).collect()
    assert all(r.slope is None and r.pval is None for r in raw)
    gated = wordmodel.fit_word_model(df, bonferroni=False, gate=True).collect()
    assert all(r.slope == 0.0 for r in gated)


def test_a5_min_n(spark):
    df = obs_df(spark, [.1, .2, .3], [.1, .2, .3])
    assert wordmodel.fit_word_model(df, min_n=3).count() == 0


def test_r5_gate_and_r4_bonferroni(spark):
    words = []
    # word a: strong correlation, word b..: weak
    for w, ys in [("a", [.1, .2, .3, .4, .5, .6]), ("b", [.3, .1, .4, .2, .5, .1])]:
        for i, (x, y) in enumerate(zip([.1, .2, .3, .4, .5, .6], ys)):
            words.append((i, w, x, y, y, y, y))
    df = spark.createDataFrame(words, "fip int, word string, x double, y0 double, y1 double, y2 double, y3 double")
    raw = {r.word: r for r in wordmodel.fit_word_model(df, bonferroni=False, gate=False).filter("level=0").collect()}
    cor = {r.word: r for r in wordmodel.fit_word_model(df, bonferroni=True, gate=True).filter("level=0").collect()}
    assert cor["a"].pval == pytest.approx(raw["a"].pval * 2)
    assert cor["a"].slope == pytest.approx(1.0)
    assert cor["b"].slope == 0.0


def test_w7_argmax_first(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0],), ([0.1, 0.3, 0.3, 0.0],)], "s array<double>")
    assert [r[0] for r in df.select(stx.argmax_first("s")).collect()] == [0, 1]


def test_r3_matches_series_definition(spark):
    # direct summation of the same closed form in Python, for several nu
    def p_py(r, n):
        nu, a = n - 2, abs(r)
        c2 = 1 - a * a
        if nu % 2 == 0:
            s, term = 0.0, 1.0
            for k in range(nu // 2):
                if k:
                    term *= (2 * k - 1) / (2 * k)
                s += term * c2 ** k
            return 1 - a * s
        s, term = 0.0, 1.0
        for k in range((nu - 3) // 2 + 1) if nu >= 3 else []:
            if k:
                term *= (2 * k) / (2 * k + 1)
            s += term * c2 ** k
        return 1 - 2 / math.pi * (math.asin(a) + a * math.sqrt(c2) * s)
    pairs = [(r, n) for r in (0.05, 0.3, 0.77) for n in (3, 4, 5, 8, 13, 50)]
    for (r, n), p in zip(pairs, p_of(spark, pairs)):
        assert p == pytest.approx(p_py(r, n), abs=1e-12)


def exact_p(r, n):
    """The finite sum for an even n - 2, in exact rational arithmetic."""
    from fractions import Fraction
    a = abs(Fraction(r))
    total = term = Fraction(1)
    for k in range(1, (n - 2) // 2):
        term = term * Fraction(2 * k - 1, 2 * k) * (1 - a * a)
        total += term
    return 1 - a * total


@pytest.mark.parametrize("r", [0.001, 0.05, 0.1, 0.3, 0.5, 0.7071, 0.77, 0.9, 0.99, 0.9999])
def test_r3_keeps_its_relative_precision_in_the_tail(spark, r):
    pairs = [(r, n) for n in (4, 6, 8, 10, 14, 20, 50, 102, 202)]
    for (_, n), p in zip(pairs, p_of(spark, pairs)):
        want = float(exact_p(r, n))
        assert want < 1e-300 or p == pytest.approx(want, rel=1e-10, abs=0)


def test_r3_far_tail_and_large_n(spark):
    # n - 2 = 398 and r^2 = 0.9: x^199 is 1e-199
    (p,) = p_of(spark, [(math.sqrt(0.9), 400)])
    assert p == pytest.approx(float(exact_p(math.sqrt(0.9), 400)), rel=1e-10, abs=0) and p < 1e-199
    df = spark.createDataFrame([(1e-5, 10**11), (1e-5, 3 * 10**9)], "r double, n long")
    far, near = [row[0] for row in df.select(stx.corr_p_value("r", "n")).collect()]
    # the normal limit: t = r sqrt(n)
    assert near == pytest.approx(math.erfc(1e-5 * math.sqrt(3e9) / math.sqrt(2)), rel=1e-6)
    assert far == pytest.approx(math.erfc(1e-5 * math.sqrt(1e11) / math.sqrt(2)), rel=1e-6)
