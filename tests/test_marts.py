import datetime as dt

from conftest import MODEL_ROWS, rows_of, staged_frame
from ledgerloom.operators import marts as A

D = dt.date


def test_daily_spend(spark):
    got = rows_of(A.daily_spend(staged_frame(spark)))
    assert got == sorted([
        (D(2026, 1, 10), "Bread", "GBP", 20.0, 2, 10.0),
        (D(2026, 1, 10), "Rent", "USD", 60.0, 1, 60.0),
        (D(2026, 1, 11), "Tools", "GBP", 40.0, 1, 40.0),
        (D(2026, 2, 2), "Rent", "USD", 90.0, 1, 90.0),
    ], key=repr)


def test_monthly_summary(spark):
    got = rows_of(A.monthly_account_summary(staged_frame(spark)))
    assert got == sorted([
        (D(2026, 1, 1), "ACC-00001", "GBP", 60.0, 300.0, 240.0, 4),
        (D(2026, 1, 1), "ACC-00002", "USD", 60.0, 0.0, -60.0, 1),
        (D(2026, 2, 1), "ACC-00002", "USD", 90.0, 0.0, -90.0, 1),
        (D(2026, 2, 1), "ACC-00002", "JPY", 0.0, 110.0, 110.0, 1),
    ], key=repr)


def test_top_merchants_count_all_statuses(spark):
    top = A.top_merchants(staged_frame(spark)).collect()
    assert [tuple(r) for r in top] == [("Shop", 223.0, 7)]


def test_currency_breakdown(spark):
    got = [tuple(r) for r in A.currency_breakdown(staged_frame(spark)).collect()]
    assert got == [
        ("GBP", 5, 367.0, 73.4), ("USD", 3, 156.0, 52.0), ("JPY", 1, 110.0, 110.0)]


def test_marts_of_nothing(spark):
    none = staged_frame(spark).limit(0)
    assert A.daily_spend(none).count() == 0
    assert A.monthly_account_summary(none).count() == 0


def test_reports_and_activity(spark):
    stg = staged_frame(spark)
    assert A.monthly_report(A.monthly_account_summary(stg)).first().month == D(2026, 2, 1)
    assert A.daily_spend_report(A.daily_spend(stg)).first().category == "Bread"
    assert {r.transaction_date: r.transaction_count for r in A.daily_activity(stg).collect()} == {
        D(2026, 1, 10): 3, D(2026, 1, 11): 4, D(2026, 2, 2): 2}
    assert A.lineage_counts(stg).first().transaction_count == len(MODEL_ROWS)
