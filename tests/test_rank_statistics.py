"""Kendall's τ-b, adjusted mutual information and multi-class AUC against direct forms."""

import math
import random

import numpy as np
import pytest

from quarry.operators import metrics as M
from quarry.operators import profile as P


def tau_b(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    num = nx = ny = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            sx, sy = (a > c) - (a < c), (b > d) - (b < d)
            num, nx, ny = num + sx * sy, nx + sx * sx, ny + sy * sy
    return num / (math.sqrt(nx) * math.sqrt(ny)) if nx and ny else None


@pytest.mark.parametrize("distinct", [3, 20, 10_000])
def test_kendall(spark, distinct):
    rnd = random.Random(distinct)
    rows = [(rnd.randint(0, distinct), rnd.randint(0, distinct)) for _ in range(300)]
    rows = [(x, y + x // 2) for x, y in rows] + [(None, 1), (2, None)] + [(1, 1)] * 100
    df = spark.createDataFrame(rows, "a int, b int")
    assert P.kendall(df, "a", "b") == pytest.approx(tau_b(rows))


def test_kendall_without_order(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    assert P.kendall(df, "a", "b") is None and P.kendall(df.where("b = 2"), "a", "b") is None
    assert P.kendall(df, "b", "b") == 1.0


def test_inversions_with_huge_weights():
    assert P.inversions(np.array([3, 1, 2]), np.array([10**12, 10**12, 10**12])) == 2 * 10**24
    assert P.inversions(np.array([], np.int64), np.array([], np.int64)) == 0


def test_all_columns_stay():
    cols = [f"c{i}" for i in range(40)]
    assert P.top_variance_columns(None, cols) == cols


def information(a, b, n):
    total = 0.0
    for k in range(max(1, a + b - n), min(a, b) + 1):
        p = math.comb(a, k) * math.comb(n - a, b - k) / math.comb(n, b)
        total += p * k / n * math.log(n * k / (a * b))
    return total


@pytest.mark.parametrize("a,b,n", [(1, 1, 1), (1, 1, 9), (3, 5, 9), (8, 8, 9), (20, 30, 60), (150, 40, 400)])
def test_expected_information(a, b, n):
    assert M.expected_information(a, b, n) == pytest.approx(information(a, b, n), abs=1e-12)


def test_expected_information_of_large_sizes():
    # For large counts it tends to 1 / (2 n) for each cell of a large table.
    n = 10**9
    assert 2 * M.expected_information(n // 10, n // 10, n) == pytest.approx(0.0, abs=1e-8)


def test_adjusted_information_of_equal_and_single_labels(spark):
    df = spark.createDataFrame([(i % 4, i % 4 + 10, 0) for i in range(40)], "a int, b int, one int")
    assert M.adjusted_mutual_info(df, "a", "b").first()["adjusted_mutual_info"] == pytest.approx(1.0)
    assert M.adjusted_mutual_info(df, "one", "one").first()["adjusted_mutual_info"] == 1.0
    assert M.adjusted_mutual_info(df, "a", "one").first()["adjusted_mutual_info"] == pytest.approx(0.0, abs=1e-9)
    assert M.adjusted_mutual_info(df.where("a > 9"), "a", "b").first()["adjusted_mutual_info"] == 1.0
