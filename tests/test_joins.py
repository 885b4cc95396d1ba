"""Point-in-time and overlap joins on keys with very many versions."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from conftest import rows_of
from ledgerloom.operators import joins as J

DAY = dt.datetime(2000, 1, 1)
DIM = "account_id string, account_sk long, valid_from timestamp, valid_to timestamp"
FACT = "transaction_id string, account_id string, transaction_timestamp timestamp"


def daily(key, n, first=0, gap=1):
    """A version a day; the last one is open."""
    return [
        (key, first + i, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i + gap) if i < n - 1 else None)
        for i in range(n)
    ]


def facts(seed, keys, n, span):
    rng = random.Random(seed)
    return [
        (f"t{i}", rng.choice(keys), None if i % 97 == 0 else DAY + dt.timedelta(hours=rng.randint(-100, 24 * span)))
        for i in range(n)
    ]


def matched(rows, dim):
    far = dt.datetime(9999, 12, 31, 23, 59, 59)
    out = []
    for t, key, at in rows:
        hits = [s for k, s, a, b in dim if k == key and key is not None and at and a <= at < (b or far)]
        out += [(t, s) for s in hits] or [(t, -1)]
    return sorted(out)


def joins_of(plan, found):
    """Rows that leave each join of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joins_of(plan.executedPlan(), found)
    if "QueryStage" in name:
        return joins_of(plan.plan(), found)
    if "Join" in name:
        found.append(plan.metrics().apply("numOutputRows").value())
    for i in range(plan.children().size()):
        joins_of(plan.children().apply(i), found)
    return found


def test_a_fact_meets_one_of_ten_thousand_versions(spark):
    dim = daily("hot", 10_000)
    rows = facts(1, ["hot"], 600, 10_100)
    out = J.pit_join(spark.createDataFrame(rows, FACT), spark.createDataFrame(dim, DIM))
    out = out.select("transaction_id", "account_sk")
    assert sorted(tuple(r) for r in out.collect()) == matched(rows, dim)
    # 10,000 is the semi join that picks the versions of crowded keys.
    assert max(joins_of(out._jdf.queryExecution().executedPlan(), [])) <= 10_000


@pytest.mark.parametrize("seed", [1, 2])
def test_all_kinds_of_keys(spark, seed):
    rng = random.Random(seed)
    overlapping = [(k, s, a, a + dt.timedelta(days=2)) for k, s, a, _ in daily("twice", 30, 500)]
    empty = [("gone", 900 + i, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i - i % 2)) for i in range(40)]
    dim = [*daily("one", 1), *daily("some", 9, 100), *daily("many", 60, 200), *overlapping, *empty, *daily("holes", 50, 600)[::2],
           (None, 999, DAY, None)]
    rng.shuffle(dim)
    rows = facts(seed, ["one", "some", "many", "twice", "gone", "holes", "none", None], 500, 80)
    for heavy in (None, spark.createDataFrame([("many",), ("some",)], "account_id string")):
        out = J.pit_join(spark.createDataFrame(rows, FACT), spark.createDataFrame(dim, DIM), heavy=heavy)
        assert out.columns == ["transaction_id", "account_id", "transaction_timestamp", "account_sk"]
        assert sorted(tuple(r) for r in out.select("transaction_id", "account_sk").collect()) == matched(rows, dim)


def pairs(dim):
    far = dt.datetime(9999, 12, 31)
    rows = sorted(((k, a, s, b or far) for k, s, a, b in dim if k is not None and s is not None and a), key=lambda r: r[:3])
    out = []
    for i, (k, a, s, b) in enumerate(rows):
        for k2, a2, s2, b2 in rows[i + 1 :]:
            if k2 == k and s != s2 and a2 < b and a < b2:
                out.append((k, min(s, s2), max(s, s2)))
    return sorted(out, key=repr)


def test_overlaps_of_all_kinds(spark):
    rng = random.Random(3)
    dim = [
        (rng.choice("abc"), i, DAY + dt.timedelta(days=rng.randint(0, 90)), None) for i in range(120)
    ]
    dim = [(k, s, a, None if s % 31 == 0 else a + dt.timedelta(days=rng.randint(-2, 9))) for k, s, a, _ in dim]
    dim += [("a", None, DAY, None), (None, 500, DAY, None), ("b", 501, None, None), ("b", 7, DAY, None)]
    assert rows_of(J.overlapping_pairs(spark.createDataFrame(dim, DIM))) == pairs(dim)


def test_few_overlaps_among_fifty_thousand_versions(spark):
    dim = [(k, s, a, b) for k, s, a, b in daily("hot", 50_000)]
    hour = dt.timedelta(hours=1)
    for i in (5, 20_000, 49_000):
        dim[i] = (*dim[i][:3], dim[i][3] + hour)
    out = J.overlapping_pairs(spark.createDataFrame(dim, DIM))
    assert rows_of(out) == sorted((("hot", i, i + 1) for i in (5, 20_000, 49_000)), key=repr)
    rows = joins_of(out._jdf.queryExecution().executedPlan(), [])
    # Counts join once a row; what meets in pairs is the three.
    assert max(rows) <= 2 * 50_000
    assert 3 in rows
