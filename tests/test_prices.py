"""Adjusted prices against plain products."""

import math
import random

import pytest

from loamline.sources.prices import adjusted_history


def test_a_price_is_adjusted_by_every_later_factor(spark):
    rng = random.Random(0)
    prices = [(rng.choice(["A", "B", None]), rng.randint(0, 50), round(rng.random(), 3), "x") for _ in range(300)] + [("C", 1, 2.0, "x"), ("A", None, 1.0, "x"), ("A", 3, 1.0, "x"), ("A", 3, 1.0, "x")]
    factors = [(rng.choice(["A", "B"]), rng.randint(0, 50), rng.choice([0.5, 2.0, 0.98])) for _ in range(30)] + [("A", 7, 0.5), ("A", 7, 0.5), ("A", None, 0.1), (None, 5, 0.1), ("A", 5, None)]
    found = adjusted_history(spark.createDataFrame(prices, "symbol string, day long, close double, factor string").repartition(4), spark.createDataFrame(factors, "symbol string, ts long, factor double"), "day")
    assert found.columns == ["symbol", "day", "close", "factor", "adjustment", "adjusted_close"]
    got = sorted(map(tuple, found.collect()), key=str)
    wanted = []
    for symbol, day, close, other in prices:
        later = [f for s, t, f in factors if s == symbol and symbol is not None and t is not None and f is not None and day is not None and t > day]
        wanted.append((symbol, day, close, other, math.prod(later), close * math.prod(later)))
    for a, b in zip(got, sorted(wanted, key=str), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-12) and a[5] == pytest.approx(b[5], rel=1e-12)


def test_without_factors_prices_stay(spark):
    prices = spark.createDataFrame([("A", 1, 2.5)], "symbol string, day long, close double")
    none = spark.createDataFrame([], "symbol string, ts long, factor double")
    assert tuple(adjusted_history(prices, none, "day").first()) == ("A", 1, 2.5, 1.0, 2.5)
