import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.exact import STATE, exact_sum, merge_state, state_value, sum_state
from ledgerloom.functions.ordered import number_rows, running_total
from ledgerloom.functions.text import json_list, number_text
from ledgerloom.operators import distribution
from ledgerloom.operators.distribution import median, shape, rank_values


def test_number_text_is_the_shortest_form(spark):
    values = [0.0, -0.0, 1.0, 42.5, -5.0, 12345678.9, 0.1, 0.0005, 1e-4, 1.5e-5, 1e15, 1e16,
              1.5e300, -2.5e-7, 1e100, 123456789.123, math.inf, -math.inf, math.nan, 68423.46]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [repr(v) for v in values]


def test_json_list(spark):
    values = F.array(F.lit("a"), F.lit('b"c'))
    assert spark.range(1).select(json_list(values)).first()[0] == '["a", "b\\"c"]'


def test_exact_sum_has_no_rounding_drift(spark):
    rng = random.Random(7)
    cents = [rng.randrange(-10**9, 10**9) for _ in range(5000)]
    df = spark.createDataFrame([(c / 100,) for c in cents], "x double")
    expected = float(Decimal(sum(cents)) / 100)
    for parts in (1, 3, 16):
        assert df.repartition(parts).agg(exact_sum(F.col("x"))).first()[0] == expected


def test_exact_sum_in_levels(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"),
                                  (F.col("id") * 0.01).alias("x"))
    cells = df.groupBy("a", "b").agg(*sum_state(F.col("x")))
    merged = cells.groupBy("a").agg(*merge_state())
    merged = merged.select("a", state_value(*(F.col(c) for c in STATE)).alias("s"))
    direct = df.groupBy("a").agg(exact_sum(F.col("x")).alias("s"))
    assert sorted(merged.collect()) == sorted(direct.collect())


def test_exact_sum_of_special_values(spark):
    df = spark.createDataFrame(
        [("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("big", 1e17), ("big", 1.0),
         ("null", None), ("over", 9e15), ("over", -0.5)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert math.isnan(got["nan"])
    assert got["inf"] == math.inf
    assert got["big"] == 1e17 + 1
    assert got["null"] is None
    assert got["over"] == 9e15 - 0.5


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    out = number_rows(df, ["h"], "n", start=10).orderBy("n").collect()
    assert [r.n for r in out] == list(range(11, 5011))
    assert [r.h for r in out] == sorted(r.h for r in out)


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.range(0), ["id"], "n").count() == 0


def test_running_total(spark):
    df = spark.range(3000).select("id", (F.col("id") % 5).alias("w"))
    out = running_total(df, ["id"], "w", "t").orderBy("id").collect()
    assert [r.t for r in out] == np.cumsum([i % 5 for i in range(3000)]).tolist()


def test_median_even_odd_hot_and_null(spark):
    for values in ([1.0, 2.0, 10.0], [1.0, 2.0, 4.0, 10.0], [5.0] * 500 + [1.0, 9.0],
                   [float(x % 97) for x in range(1001)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert median(df, "x").first().median == np.median(values)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_without_a_sort(spark, monkeypatch, seed):
    monkeypatch.setattr(distribution, "_FEW", 50)
    rng = np.random.default_rng(seed)
    values = np.concatenate([
        rng.standard_normal(3000) * 10.0 ** rng.integers(-200, 200, 3000), np.full(4000, 7.0), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    ranks = [1, 2, 1700, 3501, 5000, 7000, 7002]
    assert rank_values(df, "x", ranks) == [np.sort(values)[r - 1] for r in ranks]
    plan = median(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert median(df.limit(0), "x").first().median is None


def test_shape(spark):
    values = [1.0, 1.0, 2.0, 3.0, 50.0]
    row = shape(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    mean = np.mean(values)
    skew = np.mean((np.array(values) - mean) ** 3) / np.std(values) ** 3
    assert math.isclose(row.skewness, skew)
    assert (row["mean"], row.median, row.non_positive) == (mean, 2.0, 0)
