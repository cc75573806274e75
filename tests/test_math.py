"""The SQL formulas against Python's own normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest

from regulonspark.functions import mathx

N = NormalDist()


def _values(spark, xs, **columns):
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").selectExpr("x", *[f"{sql} AS {k}" for k, sql in columns.items()])
    return rows.collect()


def test_quantile(spark):
    for r in _values(spark, [1e-12, 1e-5, 0.01, 0.08, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9], q=mathx.ppf("x")):
        assert r.q == pytest.approx(N.inv_cdf(r.x), rel=1e-9, abs=1e-12)


def test_tails(spark):
    for r in _values(spark, [-6, -1.5, 0, 0.3, 2, 5, 7, 8.5, 20], s=mathx.sf("x"), l=mathx.logsf("x"), c=mathx.cdf("x")):
        want = 0.5 * math.erfc(r.x / math.sqrt(2))
        assert r.s == pytest.approx(want, rel=1e-6)
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-6)
        assert r.l == pytest.approx(math.log(want), rel=1e-6, abs=1e-9)


def test_log_quantile_inverts_logsf(spark):
    for r in _values(spark, [0.1, 1, 3, 6, 12, 30], q=mathx.log_quantile(f"({mathx.logsf('x')})")):
        assert r.q == pytest.approx(r.x, rel=1e-6)
