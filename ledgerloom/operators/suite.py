"""Running a suite of checks and rating the outcome."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import value_text

CRITICAL, WARN = "critical", "warn"
PASS, FAIL, ERROR = "pass", "fail", "error"
SAMPLES = 5

RESULTS = (
    "check_name string, severity string, description string, status string, "
    "violation_count long, sample_violations string, elapsed_seconds double, "
    "error_message string"
)


@dataclass(frozen=True)
class Check:
    """A named query of violations, built only when it runs."""

    name: str
    violations: Callable[[], DataFrame]
    severity: str = WARN
    description: str = ""


def _outcome(check: Check, samples: int) -> tuple:
    started = time.monotonic()
    count, sample, failure = 0, None, None
    try:
        count, sample = count_and_sample(check.violations(), samples)
        status = FAIL if count else PASS
    except Exception as error:  # one broken check must not stop the others
        status, count, failure = ERROR, 0, str(error)
    return (check.name, check.severity, check.description, status, count, sample,
            time.monotonic() - started, failure)


def count_and_sample(violations: DataFrame, n: int = SAMPLES) -> tuple[int, str | None]:
    """How many violations there are, and the first ``n`` of them, in one job.

    They are ordered by the text of their columns, so a rerun shows the same ones; a
    task passes on ``n`` rows at most.  They come as a JSON array of objects, NULL for none.
    """
    texts = violations.select(
        *(value_text(f.name, f.dataType).alias(f.name) for f in violations.schema)
    )
    seen = Observation()
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")
    order = [F.asc_nulls_first(name) for name in texts.columns]
    first = texts.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(n).select(whole).collect()
    rows = [row.row for row in first]
    return seen.get.get("n", len(rows)), f"[{','.join(rows)}]" if rows else None


def run_suite(
    spark: SparkSession, checks: Sequence[Check], samples: int = SAMPLES, parallel: int = 4
) -> DataFrame:
    """One result row per check, in the given order.

    Violations are counted where they are; only counts and a few samples come
    back, from one job a check.  Independent checks are submitted side by side.
    """
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(lambda check: _outcome(check, samples), checks))
    return spark.createDataFrame(rows, RESULTS)


def suite_status(results: DataFrame) -> DataFrame:
    """Counters and overall status of a run.

    A failed critical check fails the run.  Otherwise a failed warning, or an
    error of any severity, makes it a warning; an empty suite has passed.
    """
    def is_status(value: str):
        return F.col("status") == value

    critical = F.count_if(is_status(FAIL) & (F.col("severity") == CRITICAL)) > 0
    warned = F.count_if((is_status(FAIL) & (F.col("severity") == WARN)) | is_status(ERROR)) > 0
    return results.agg(
        F.count("*").alias("total_checks"),
        F.count_if(is_status(PASS)).alias("checks_passed"),
        F.count_if(is_status(FAIL)).alias("checks_failed"),
        F.count_if(is_status(ERROR)).alias("checks_errored"),
        F.when(critical, "failed").when(warned, "warn").otherwise("passed").alias("status"),
    )
