import math

import numpy as np
import pytest

from tideline.functions.distinct import digamma, horvitz_thompson, miss, moment_estimate
from tideline.functions.forecast import forecast_columns, lines, recursive_forecast, running_mean, select_forecast, smooth, trends, window_forecast


def test_smoothing_values():
    t, v = np.array([1.0, 2, 3, 5, 10000]), np.array([1.0, 4, -5.75, 15.25, 100])
    assert smooth(t, v).tolist() == [1, 3, -2, 10, 100]


def test_trend_values():
    t = np.array([1.0, 2, 3, 5])
    v = np.array([1.0, 2, -6, 27])
    assert (v + trends(t, v) * (10 - t)).tolist() == [10, 10, -62, 109.5]
    v = np.array([1.0, 1.5, 3, 7])
    assert (v + running_mean(trends(t, v)) * (10 - t)).tolist() == [10, 7.5, 10, 13.25]
    v = np.array([1.0, 1.25, 1.4, 2])
    assert (v + smooth(t, trends(t, v)) * (10 - t)) == pytest.approx([10, 5.25, 3.5, 3.5])


def test_line_values():
    t = np.array([1.0, 2, 2, 3, 3, 5])
    slope, start = lines(t, np.array([1.0, 2.5, 1.5, 2.5, 3.5, 5]))
    assert slope[0] == 0 and (slope[-1], start[-1]) == pytest.approx((1, 0), abs=1e-9)


def test_selector():
    t = np.array([1.0, 2, 3, 5, 10, 12])
    assert select_forecast(t, 5 * t + 10, 20)[-1] == pytest.approx(110)
    t = np.arange(1.0, 102)
    assert abs(select_forecast(t, 100 - 100 / t, 1100)[-1] - 100) < 10
    t = np.arange(1.0, 100)
    assert abs(select_forecast(t, np.log(t), 200)[-1] - math.log(200)) < 1


def test_forecasts_of_frames(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(1, 6)] + [("b", 1.0, 4.0)], "k string, t double, v double")
    for method in ("tail", "mean", "ols", "trend"):
        assert window_forecast(df, ["k"], 10.0, method).count() == 6
    last = window_forecast(df, ["k"], 10.0, "ols").where("k = 'a' and t = 5").first()
    assert last.forecast == pytest.approx(21)
    assert recursive_forecast(df, ["k"], 10.0).where("k = 'b'").first().forecast == 4
    with pytest.raises(ValueError):
        window_forecast(df, ["k"], 10.0, "none")


def test_digamma():
    assert digamma(1) == pytest.approx(-0.5772156649)
    assert digamma(10) == pytest.approx(2.2517525890)


@pytest.mark.parametrize("fraction", [0.05, 0.2, 0.5, 0.9])
def test_moment_estimate_finds_equal_frequencies(fraction):
    true, total = 400, 5000
    n = total * fraction
    d = true * (1 - miss(total / true, n, total))
    assert moment_estimate(d, n, total) == pytest.approx(true, rel=1e-3)


def test_distinct_edges():
    assert moment_estimate(7, 7, 100) == 7
    assert moment_estimate(5, 100, 100) == 5
    assert moment_estimate(0, 10, 100) == 0
    assert moment_estimate(9, 10, 50) <= 50
    assert horvitz_thompson(3, 10, 1.0) == 1
    assert horvitz_thompson(1, 100, 0.5) == pytest.approx(1 / (1 - miss(2, 100, 200)))


def test_row_forecast(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0) for i in range(1, 8)], "t double, a double, b double")
    last = forecast_columns(df, [], ["a", "b"], 10.0).where("t = 7").first()
    assert (last.a, last.b) == pytest.approx((20, 5))
