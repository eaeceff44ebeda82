from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tabguard.operators import ks


def counted(gap, n, m):
    """Share of all orders of n + m values whose gap reaches ``gap``, one order after the other."""
    far = 0
    for places in combinations(range(n + m), n):
        i = j = worst = 0
        for at in range(n + m):
            i, j = (i + 1, j) if at in places else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        far += worst >= gap
    return Fraction(far, comb(n + m, n))


@pytest.mark.parametrize("n,m", [(1, 1), (1, 5), (4, 4), (6, 3), (5, 7)])
def test_equal_to_counted_orders(n, m):
    for gap in range(0, n * m + 2):
        assert ks.exact_p(gap, n, m) == pytest.approx(float(counted(gap, n, m)), abs=1e-14)
        assert ks.exact_p(gap, n, m) == pytest.approx(ks.exact_p(gap, m, n), abs=1e-14)


def test_small_p_keeps_its_digits():
    # Samples that do not overlap: two of all orders.
    assert ks.exact_p(40 * 30, 40, 30) == pytest.approx(2 / comb(70, 30), rel=1e-9)


def test_nears_the_series(spark):
    draw = np.random.default_rng(1)
    real = spark.createDataFrame([(float(x),) for x in draw.normal(size=1200)], "x double")
    synth = spark.createDataFrame([(float(x),) for x in draw.normal(size=900) + 0.06], "x double")
    exact, series, above = ks.ks_exact(real, synth).first(), ks.ks_test(real, synth).first(), ks.ks_exact(real, synth, largest=1000).first()
    assert exact.exact and not above.exact
    assert (above.ks_statistic, above.p_value) == (series.ks_statistic, series.p_value)
    assert exact.ks_statistic == series.ks_statistic and exact.p_value == pytest.approx(series.p_value, abs=0.02)


def test_nulls_ties_and_absent_columns(spark):
    schema = "x double, only double, none double, same double"
    real = spark.createDataFrame([(1.0, 2.0, 1.0, 5.0), (2.0, 2.0, 2.0, 5.0), (None, 1.0, 3.0, 5.0)], schema)
    synth = spark.createDataFrame([(3.0, None, 5.0), (4.0, None, 5.0), (5.0, None, 5.0)], "x double, none double, same double")
    rows = {r.column: r for r in ks.ks_exact(real, synth).collect()}
    assert (rows["x"].ks_statistic, rows["x"].p_value, rows["x"].exact) == (1.0, 0.2, True)
    assert (rows["same"].ks_statistic, rows["same"].p_value) == (0.0, 1.0)
    assert rows["only"].p_value is None and rows["only"].exact is None
    assert rows["none"].p_value is None and not rows["none"].exact
    assert ks.ks_exact(real.select("x"), synth.select("same")).first().exact is None
