import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import instant, landing_frame, landing_row, rows_of
from ledgerloom.functions.rules import Rule
from ledgerloom.operators import rows as P


def verdict(spark, **changes):
    return P.validate(landing_frame(spark, [landing_row(**changes)])).first()


@pytest.mark.parametrize(("changes", "messages"), [
    ({}, []),
    ({"amount": -5.0}, ["amount is null or not positive"]),
    ({"amount": 0.0}, ["amount is null or not positive"]),
    ({"amount": None}, ["amount is null or not positive"]),
    ({"amount": math.nan}, []),
    ({"amount": math.inf}, []),
    ({"currency": "XXX"}, ["currency not in allowed values"]),
    ({"currency": None}, ["currency is null or empty"]),
    ({"currency": ""}, ["currency is null or empty", "currency not in allowed values"]),
    ({"transaction_type": "refund"}, ["transaction_type not in allowed values"]),
    ({"status": "invalid_status"}, ["status not in allowed values"]),
    ({"transaction_id": None}, ["transaction_id is null or empty"]),
    ({"merchant_name": ""}, ["merchant_name is null or empty"]),
    ({"timestamp": None}, ["timestamp is null"]),
    ({"account_id": "BAD-00001"}, ["account_id does not match ACC-XXXXX pattern"]),
    ({"account_id": "ACC-123456"}, ["account_id does not match ACC-XXXXX pattern"]),
    ({"account_id": "ACC-00001\n"}, ["account_id does not match ACC-XXXXX pattern"]),
    ({"account_id": "ACC-٠٠٠٠١"}, []),
    ({"amount": -1.0, "currency": "XXX"},
     ["amount is null or not positive", "currency not in allowed values"]),
])
def test_rules(spark, changes, messages):
    row = verdict(spark, **changes)
    assert row._reasons == messages
    assert row._is_valid == (not messages)
    assert [part for part in row._rejection_reason.split("; ") if part] == messages


def test_reason_text_keeps_empty_slots(spark):
    text = verdict(spark, amount=-5.0)._rejection_reason
    assert text.count("; ") == 12
    assert text == "; " * 8 + "amount is null or not positive" + "; " * 4


def test_unknown_outcome_is_a_failure(spark):
    df = landing_frame(spark, [landing_row(currency=None)])
    row = P.validate(df, [Rule("not usd", F.col("currency") == "USD")]).first()
    assert row._is_valid is False
    valid, invalid = P.split(P.validate(df, [Rule("not usd", F.col("currency") == "USD")]))
    assert valid.count() == 0
    assert invalid.count() == 1


def test_quarantine_record_is_text(spark):
    rows = [landing_row(amount=-12345678.5, category=None, merchant_name='Joe "J" Ltd')]
    df = landing_frame(spark, rows).withColumns(
        {"source_file": F.lit("f.parquet"), "_source_row": F.lit(0)}
    )
    _, invalid = P.split(P.validate(df))
    out = P.to_quarantine(invalid, "run-1", instant("2026-01-20"), start=7).first()
    assert out.quarantine_id == 8
    assert json.loads(out.record_data) == {
        "transaction_id": rows[0][0], "timestamp": "2026-01-15T07:05:00+00:00",
        "amount": "-12345678.5", "currency": "GBP", "merchant_name": 'Joe "J" Ltd',
        "category": "null", "account_id": "ACC-00001", "transaction_type": "debit",
        "status": "completed",
    }


def test_enrich_adds_lineage(spark):
    df = landing_frame(spark, [landing_row(timestamp="2026-01-15 23:59:59")])
    row = P.enrich(df.withColumn("source_file", F.lit("f.parquet")), "r", instant("2026-01-20"))
    assert rows_of(row, "source_file", "run_id") == [("f.parquet", "r")]
    assert str(row.first().transaction_date) == "2026-01-15"
    assert len(row.columns) == 13


def test_staging_renames_timestamp(spark):
    df = landing_frame(spark, [landing_row()]).withColumn("source_file", F.lit("f.parquet"))
    stg = P.staging(P.enrich(df, "r", instant("2026-01-20")))
    assert "transaction_timestamp" in stg.columns
    assert "timestamp" not in stg.columns
    assert stg.count() == 1
