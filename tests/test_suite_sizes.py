"""What a suite of checks writes."""

from ledgerloom.operators import quality as Q
from ledgerloom.plans.registry import QUERIES
from ledgerloom.session import workspace
from ledgerloom.sources.files import child_names

SF_DIR = "/root/testdata/sf0.001"


def test_suites_write_the_columns_checks_read(spark):
    before = set(child_names(spark, workspace(spark)))
    QUERIES["check_suite"](spark, SF_DIR)
    new = set(child_names(spark, workspace(spark))) - before
    facts = next(name for name in new if name.startswith("fct_transactions-"))
    assert spark.read.parquet(f"{workspace(spark)}/{facts}").columns == Q.FACT_KEYS
