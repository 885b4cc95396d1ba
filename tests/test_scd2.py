import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import instant, rows_of, staged_frame
from ledgerloom import schemas, stage
from ledgerloom.operators import scd2 as V
from ledgerloom.operators.joins import heavy_keys, overlapping_pairs, pit_join
from ledgerloom.operators.quality import single_current

D = dt.date


def facts(spark, *groups):
    """Groups of (account, currency, count, date)."""
    rows, n = [], 0
    for account, currency, count, day in groups:
        for _ in range(count):
            rows.append((f"t{n}", 10.0 + n, currency, "Food", account, "debit", "completed", day))
            n += 1
    return staged_frame(spark, rows)


def empty(spark):
    return spark.createDataFrame([], schemas.DIM_ACCOUNTS)


def build(spark, dim, stg, day, run_id, **options):
    profiles = V.account_profiles(stg)
    merged = V.scd2_merge(dim, profiles, day, run_id, **options)
    return merged, tuple(V.scd2_counts(merged, profiles, run_id).first())[1:]


def test_profiles(spark):
    got = {r.account_id: r for r in V.account_profiles(staged_frame(spark)).collect()}
    one, two = got["ACC-00001"], got["ACC-00002"]
    assert (one.primary_currency, one.primary_category, one.transaction_count,
            one.total_spend) == ("GBP", "Bread", 5, 367.0)
    assert (two.primary_currency, two.primary_category, two.transaction_count,
            two.total_spend) == ("USD", "Rent", 4, 266.0)
    assert one.first_seen == D(2026, 1, 10)


def test_row_hash_is_over_plain_text(spark):
    import hashlib

    row = V.account_profiles(staged_frame(spark)).where("account_id = 'ACC-00001'").first()
    text = "GBP|Bread|5|367.0|2026-01-10|2026-01-11"
    assert row.row_hash == hashlib.md5(text.encode()).hexdigest()


def test_first_build_and_tie(spark):
    groups = [(f"ACC-{i}", "USD", 2, "2026-01-15") for i in range(4)]
    groups += [("ACC-TIE", "USD", 3, "2026-01-15"), ("ACC-TIE", "EUR", 3, "2026-01-15")]
    dim, counts = build(spark, empty(spark), facts(spark, *groups), D(2026, 2, 26), "r1")
    assert counts == (5, 5, 0)
    assert dim.where("is_current AND valid_to IS NULL").count() == 5
    assert dim.where("account_id = 'ACC-TIE'").first().primary_currency == "EUR"
    assert sorted(r.account_sk for r in dim.collect()) == [1, 2, 3, 4, 5]


def test_changed_account_gets_a_version(spark):
    before = [(f"ACC-00{i}", "USD", 2, "2026-01-15") for i in (1, 2, 3)]
    dim, counts = build(spark, empty(spark), facts(spark, *before), D(2026, 2, 26), "r1")
    assert counts == (3, 3, 0)
    after = before + [("ACC-001", "EUR", 4, "2026-02-26")]
    dim, counts = build(spark, dim, facts(spark, *after), D(2026, 2, 27), "r2")
    assert counts == (3, 1, 2)
    old, new = dim.where("account_id = 'ACC-001'").orderBy("account_sk").collect()
    assert (old.is_current, new.is_current) == (False, True)
    # The closed version ends the day before the new one starts.
    assert old.valid_to == dt.datetime(2026, 2, 26)
    assert new.valid_from == dt.datetime(2026, 2, 27)
    assert new.account_sk == 4


def test_same_input_changes_nothing(spark):
    stg = facts(spark, ("A", "USD", 2, "2026-01-15"), ("B", "USD", 1, "2026-01-15"))
    dim, _ = build(spark, empty(spark), stg, D(2026, 2, 1), "r1")
    again, counts = build(spark, dim, stg, D(2026, 2, 2), "r2")
    assert counts == (2, 0, 2)
    assert rows_of(again) == rows_of(dim)


def test_absent_accounts_stay(spark):
    dim, _ = build(spark, empty(spark), facts(spark, ("A", "USD", 1, "2026-01-01")),
                   D(2026, 2, 1), "r1")
    dim, _ = build(spark, dim, facts(spark, ("B", "USD", 1, "2026-01-01")), D(2026, 2, 2), "r2")
    assert rows_of(dim.where("is_current"), "account_id") == [("A",), ("B",)]


def test_two_current_rows_are_both_closed(spark):
    dim, _ = build(spark, empty(spark), facts(spark, ("A", "USD", 1, "2026-01-01")),
                   D(2026, 2, 1), "r1")
    twin = dim.withColumns({"account_sk": F.lit(2).cast("long"), "row_hash": F.lit("other")})
    broken = dim.unionByName(twin)
    assert rows_of(single_current(broken)) == [("A", 2)]
    merged, _ = build(spark, broken, facts(spark, ("A", "USD", 1, "2026-01-01")),
                      D(2026, 2, 2), "r2")
    assert merged.where("is_current").count() == 1
    assert merged.count() == 3


def test_history_numbers_and_lengths(spark):
    one = [("A", "USD", 1, "2026-01-01")]
    dim, _ = build(spark, empty(spark), facts(spark, *one), D(2026, 1, 10), "r1")
    dim, _ = build(spark, dim, facts(spark, *one, ("A", "USD", 1, "2026-01-02")),
                   D(2026, 1, 15), "r2")
    got = rows_of(V.account_history(dim, D(2026, 1, 20)), "version_number",
                  "version_duration_days")
    assert got == [(1, 4), (2, 5)]


@pytest.mark.parametrize("contiguous", [False, True])
def test_merging_in_turn_equals_all_at_once(spark, contiguous):
    rng = random.Random(3)
    rows = [
        (f"t{n}", float(rng.randrange(1, 999)), rng.choice(["USD", "EUR"]),
         rng.choice(["Food", "Fuel"]), f"ACC-{rng.randrange(12)}", "debit", "completed",
         str(D(2026, 1, 1) + dt.timedelta(days=rng.randrange(60))))
        for n in range(120)
    ]
    stg = staged_frame(spark, rows)
    days = [D(2026, 1, 5), D(2026, 1, 10), D(2026, 1, 11), D(2026, 2, 20), D(2026, 3, 15)]
    snapshots = V.account_profiles(stg, days)
    dim = empty(spark)
    for day in days:
        seen = snapshots.where(F.col("run_date") == F.lit(day)).drop("run_date")
        expected = V.account_profiles(stg.where(F.col("transaction_date") < F.lit(day)))
        assert rows_of(seen) == rows_of(expected)
        dim = stage(V.scd2_merge(dim, seen, day, f"run-{day}", contiguous=contiguous))
    assert rows_of(V.scd2_from_snapshots(snapshots, contiguous=contiguous)) == rows_of(dim)


def interval(account, sk, start, end):
    return (sk, account, "USD", "Food", 1, 1.0, D(2026, 1, 1), D(2026, 1, 1), "h",
            instant(start), instant(end) if end else None, end is None, "r")


def dim_of(spark, *rows):
    return spark.createDataFrame([interval(*r) for r in rows], schemas.DIM_ACCOUNTS)


def test_point_in_time_join(spark):
    dim = dim_of(spark, ("A", 1, "2026-01-01", "2026-02-09"), ("A", 2, "2026-02-10", None))
    stg = facts(spark, ("A", "USD", 1, "2025-12-31"), ("A", "USD", 1, "2026-01-01"),
                ("A", "USD", 1, "2026-02-08"), ("A", "USD", 1, "2026-02-09"),
                ("A", "USD", 1, "2026-02-10"), ("B", "USD", 1, "2026-02-10"))
    for heavy in (None, spark.createDataFrame([("A",)], "account_id string")):
        got = rows_of(pit_join(stg, dim, heavy=heavy), "transaction_id", "account_sk")
        # The day before a new version starts is covered by none.
        assert got == [("t0", -1), ("t1", 1), ("t2", 1), ("t3", -1), ("t4", 2), ("t5", -1)]
    nulls = pit_join(stg, dim, unknown=None).where("account_sk IS NULL").count()
    assert nulls == 3


def test_contiguous_versions_leave_no_hole(spark):
    one = [("A", "USD", 1, "2026-01-01")]
    dim, _ = build(spark, empty(spark), facts(spark, *one), D(2026, 1, 10), "r1")
    more = facts(spark, *one, ("A", "USD", 1, "2026-01-14"))
    dim, _ = build(spark, dim, more, D(2026, 1, 15), "r2", contiguous=True)
    got = pit_join(more.where("transaction_date = '2026-01-14'"), dim).first()
    assert got.account_sk == 1


def test_heavy_keys_are_few(spark):
    w = spark.createDataFrame([("a", 60), ("b", 39), ("c", 1)], "k string, n long")
    assert rows_of(heavy_keys(w, "k", "n", share=0.3)) == [("a",), ("b",)]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for sk in range(1, 160):
        start = D(2025, 1, 1) + dt.timedelta(days=rng.randrange(400))
        end = None if rng.random() < 0.1 else str(start + dt.timedelta(days=rng.randrange(-2, 60)))
        rows.append((rng.choice("AAAAABC"), sk, str(start), end))
    rng.shuffle(rows)
    far = "9999-12-31"
    expected = sorted(
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1]
        and a[2] < (b[3] or far) and b[2] < (a[3] or far)
    )
    assert expected
    assert rows_of(overlapping_pairs(dim_of(spark, *rows))) == sorted(expected, key=repr)


def test_clean_history_has_no_overlaps(spark):
    dim = dim_of(spark, ("A", 1, "2026-01-01", "2026-02-09"), ("A", 2, "2026-02-10", None),
                 ("B", 3, "2026-01-01", None))
    assert overlapping_pairs(dim).count() == 0
