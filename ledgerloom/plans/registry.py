"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators import catalog as C
from ledgerloom.operators import dedup as D
from ledgerloom.operators import distribution as S
from ledgerloom.operators import marts as A
from ledgerloom.operators import quality as Q
from ledgerloom.operators import rows as P
from ledgerloom.operators import runs as R
from ledgerloom.operators import scd2 as V
from ledgerloom.operators.suite import run_suite, suite_status
from ledgerloom.plans import testdata as td
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.plans.warehouse import build_catalog, build_models, check_warehouse, warehouse_checks
from ledgerloom.session import configure, freed_shuffles, stage, workspace
from ledgerloom.sources import manifest as M
from ledgerloom.sources.files import child_names
from ledgerloom.sources.key_index import KeyIndex
from ledgerloom.sources.landing import file_sums, hash_files, landing_files, schema_errors
from ledgerloom.sources.tables import export, publish, read_export, read_table, replace_table, replace_view
from ledgerloom.streaming import ingest as Stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AT = datetime(2003, 1, 1, tzinfo=UTC)
AS_OF = date(2003, 1, 1)
_GIVEN = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)


def query(build: Query, shared: bool = False) -> Query:
    """Register a query under its function name; instants leave as UTC wall time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with td.call(shared):
            df = build(configure(spark), sf_dir)
        return df.withColumns({
            f.name: F.col(f.name).cast("timestamp_ntz")
            for f in df.schema
            if isinstance(f.dataType, T.TimestampType)
        })

    QUERIES[build.__name__] = run
    return build


def shared(build: Query) -> Query:
    """Register a query that goes over the landed rows more than once."""
    return query(build, shared=True)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return P.validate(td.landing_dirty(spark, sf))


# --- rows -------------------------------------------------------------------


@query
def validate_split(spark, sf):
    return _judged(spark, sf).select("transaction_id", F.col(P.VALID).alias("is_valid"))


@query
def rejection_text(spark, sf):
    _, invalid = P.split(_judged(spark, sf))
    return invalid.select("transaction_id", F.col(P.REASON).alias("rejection_reason"))


@query
def quarantine_reasons(spark, sf):
    _, invalid = P.split(_judged(spark, sf))
    reasons = invalid.select(F.explode(P.REASONS).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("row_count"))


@query
def quarantine_records(spark, sf):
    _, invalid = P.split(_judged(spark, sf))
    return P.quarantine_rows(invalid, "run-1", AT)


@query
def lineage_enrich(spark, sf):
    valid, _ = P.split(_judged(spark, sf))
    return P.enrich(valid, "run-1", AT)


@query
def staging(spark, sf):
    return td.stg(spark, sf)


@query
def date_range_slice(spark, sf):
    return P.date_slice(td.stg(spark, sf), "1997-03-01", "1997-03-31")


# --- duplicates -------------------------------------------------------------


@query
def dedup_first(spark, sf):
    valid, _ = P.split(_judged(spark, sf))
    return D.dedup_first(valid, order=td.ROW_ORDER)


@shared
def dedup_cross_batch(spark, sf):
    landed = td.landing(spark, sf)
    old, new = "batch_1998.parquet", F.col("source_file") > "batch_1998.parquet"
    index = KeyIndex(spark, _new_folder(spark, "known_ids"), D.KEY)
    history = landed.where(F.col("source_file") <= old)
    index.rebuild(history.select(D.KEY, F.col("source_file").alias("part")))
    fresh = stage(D.dedup_first(landed.where(new), order=td.ROW_ORDER), "fresh")
    return fresh.join(index.known(fresh), D.KEY, "left_anti")


@query
def ingest_counts(spark, sf):
    history = td.landing(spark, sf).where(F.col("source_file") == "batch_1996.parquet")
    judged = stage(_judged(spark, sf).select(D.KEY, "source_file", P.VALID), "judged")
    return D.ingest_counts(judged, D.known_keys(judged.where(F.col(P.VALID)), history))


@query
def run_totals(spark, sf):
    return D.run_totals(D.ingest_counts(_judged(spark, sf)))


# --- marts and analytics ----------------------------------------------------


@query
def daily_spend(spark, sf):
    return A.daily_spend(td.stg(spark, sf))


@query
def monthly_account_summary(spark, sf):
    return A.monthly_account_summary(td.stg(spark, sf))


@query
def top_merchants(spark, sf):
    return A.top_merchants(td.transactions(spark, sf))


@query
def currency_breakdown(spark, sf):
    return A.currency_breakdown(td.transactions(spark, sf))


@shared
def fact_summary(spark, sf):
    return A.fact_summary(td.fact(spark, sf))


@query
def daily_activity(spark, sf):
    return A.daily_activity(td.transactions(spark, sf))


@query
def lineage_counts(spark, sf):
    return A.lineage_counts(td.transactions(spark, sf))


@query
def daily_spend_report(spark, sf):
    return A.daily_spend_report(A.daily_spend(td.stg(spark, sf)))


@query
def monthly_report(spark, sf):
    return A.monthly_report(A.monthly_account_summary(td.stg(spark, sf)))


# --- account dimension and facts --------------------------------------------


@query
def account_profiles(spark, sf):
    return V.account_profiles(td.stg(spark, sf))


@query
def primary_mode(spark, sf):
    profiles = V.account_profiles(td.stg(spark, sf), td.RUN_DATES)
    return profiles.select("account_id", "run_date", "primary_currency", "primary_category")


@query
def scd2_versions(spark, sf):
    return td.dimension(spark, sf)


@query
def scd2_contiguous(spark, sf):
    profiles = V.account_profiles(td.stg(spark, sf), td.RUN_DATES)
    return V.scd2_from_snapshots(profiles, contiguous=True)


def _merge_runs(spark, sf, dates):
    dim = spark.createDataFrame([], schemas.DIM_ACCOUNTS)
    snapshots = stage(V.account_profiles(td.stg(spark, sf), dates), "profiles")
    for day in dates:
        profiles = snapshots.where(F.col("run_date") == F.lit(day)).drop("run_date")
        dim = stage(V.scd2_merge(dim, profiles, day, f"run-{day}"), "dim")
    return dim, profiles


@query
def scd2_merge_two_runs(spark, sf):
    return _merge_runs(spark, sf, td.RUN_DATES[:2])[0]


@query
def scd2_counts(spark, sf):
    dim, profiles = _merge_runs(spark, sf, td.RUN_DATES[:2])
    return V.scd2_counts(dim, profiles, f"run-{td.RUN_DATES[1]}")


@query
def account_history(spark, sf):
    return V.account_history(td.dimension(spark, sf), AS_OF)


@shared
def fact_point_in_time(spark, sf):
    return td.fact(spark, sf)


@shared
def fact_unknown_members(spark, sf):
    facts = td.fact(spark, sf)
    return facts.groupBy("source_file").agg(
        F.count("*").alias("fact_count"),
        F.count_if(F.col("account_sk") == -1).alias("unknown_count"),
    )


# --- checks on tables with faults -------------------------------------------


@shared
def check_row_count_staging(spark, sf):
    return Q.row_count_staging(td.transactions(spark, sf), td.thinned(td.stg(spark, sf)))


@shared
def check_mart_not_empty(spark, sf):
    rows = td.stg(spark, sf)
    nothing = rows.where(F.col("status") == "unknown")
    return Q.mart_not_empty(
        A.daily_spend(rows), A.monthly_account_summary(nothing), td.fact(spark, sf)
    )


@query
def check_freshness(spark, sf):
    return Q.freshness(td.stg(spark, sf), AT)


@query
def check_unique_daily_spend_grain(spark, sf):
    mart = A.daily_spend(td.stg(spark, sf))
    return Q.unique_daily_spend_grain(td.repeated(mart, "category", "ECONOMY"))


@query
def check_unique_monthly_summary_grain(spark, sf):
    mart = A.monthly_account_summary(td.stg(spark, sf))
    return Q.unique_monthly_summary_grain(td.repeated(mart, "currency", "JPY"))


@query
def check_accepted_values_currency(spark, sf):
    return Q.accepted_values_currency(td.stg(spark, sf))


@shared
def check_fct_unique_transaction_id(spark, sf):
    return Q.fct_unique_transaction_id(td.fact(spark, sf))


@shared
def check_fct_no_null_account_sk(spark, sf):
    return Q.fct_no_null_account_sk(td.unkeyed_fact(spark, sf))


@shared
def check_fct_no_unknown_account_sk(spark, sf):
    return Q.fct_no_unknown_account_sk(td.fact(spark, sf))


@shared
def check_fct_row_count_matches_staging(spark, sf):
    return Q.fct_row_count_matches_staging(td.thinned(td.stg(spark, sf)), td.fact(spark, sf))


@query
def check_dim_accounts_single_current(spark, sf):
    return Q.dim_accounts_single_current(td.all_current(td.dimension(spark, sf)))


@query
def check_dim_accounts_no_overlapping_ranges(spark, sf):
    return Q.dim_accounts_no_overlapping_ranges(td.stretched(td.dimension(spark, sf)))


@query
def check_dim_accounts_no_null_sk(spark, sf):
    return Q.dim_accounts_no_null_sk(td.keyless(td.dimension(spark, sf)))


def _suite(spark, sf):
    return run_suite(spark, warehouse_checks(td.warehouse_tables(spark, sf, columns=Q.FACT_KEYS), AT))


@shared
def check_suite(spark, sf):
    return _suite(spark, sf).select("check_name", "severity", "status", "violation_count")


@shared
def check_samples(spark, sf):
    """The first violations of two checks, as a run reports them."""
    rows = td.stg(spark, sf)
    # Each table is read by one check, which needs few of its columns.
    tables = {
        "stg_transactions": rows, "daily_spend_by_category": A.daily_spend(rows),
        "fct_transactions": td.fact(spark, sf),
    }
    wanted = ("accepted_values_currency", "fct_unique_transaction_id", "unique_daily_spend_grain")
    checks = [c for c in warehouse_checks(tables, AT) if c.name in wanted]
    return run_suite(spark, checks).select("check_name", "violation_count", "sample_violations")


@shared
def suite_rating(spark, sf):
    return suite_status(_suite(spark, sf))


@shared
def suite_with_missing_table(spark, sf):
    tables = td.warehouse_tables(spark, sf, without=("fct_transactions",))
    results = run_suite(spark, warehouse_checks(tables, AT))
    return results.select("check_name", "severity", "status", "violation_count")


# --- distribution and correctness -------------------------------------------


@query
def distribution_share(spark, sf):
    return S.value_shares(td.transactions(spark, sf), "currency")


@query
def share_within(spark, sf):
    expected = {"USD": 0.2, "EUR": 0.2, "GBP": 0.2, "JPY": 0.05, "XXX": 0.1}
    return Q.share_within(td.transactions(spark, sf), "currency", expected, 0.03)


@shared
def amount_shape(spark, sf):
    found = S.shape(td.transactions(spark, sf), "amount")
    return found.withColumns({
        "mean": F.round("mean", 6), "skewness": F.round("skewness", 6),
    })


@shared
def amount_shape_violations(spark, sf):
    found = Q.shape_violations(td.transactions(spark, sf), "amount")
    return found.select("median", "non_positive")


@query
def functional_dependency(spark, sf):
    return S.functional_dependency(td.transactions(spark, sf), "merchant_name", "category")


@query
def distinct_accounts(spark, sf):
    return S.distinct_count(td.transactions(spark, sf), "account_id")


@query
def row_conformance(spark, sf):
    dirty = td.landing_dirty(spark, sf)
    stored = P.enrich(dirty, "run-1", AT).withColumn(
        "transaction_date",
        F.date_add("transaction_date", F.when(td.order_number() % 60 == 0, 1).otherwise(0)),
    )
    return Q.row_conformance(stored)


@query
def run_per_file(spark, sf):
    mixed = F.concat(F.lit("run-"), F.year("timestamp") - F.year("timestamp") % 3)
    rows = td.transactions(spark, sf).withColumns({
        "source_file": F.concat(F.lit("half_"), F.floor((F.year("timestamp") - 1990) / 4)),
        "run_id": mixed,
    })
    return Q.run_per_file(rows)


@shared
def run_totals_match(spark, sf):
    return Q.run_totals_match(td.transactions(spark, sf), td.ingestion_runs(spark, sf))


def _altered(mart: DataFrame, column: str, where) -> DataFrame:
    return mart.withColumn(column, F.when(where, F.col(column) + 1).otherwise(F.col(column)))


@shared
def daily_spend_recompute(spark, sf):
    rows = td.stg(spark, sf)
    mart = _altered(A.daily_spend(rows), "transaction_count", F.col("category") == "SMALL")
    return Q.daily_spend_matches(rows, mart)


@shared
def monthly_summary_recompute(spark, sf):
    rows = td.stg(spark, sf)
    mart = A.monthly_account_summary(rows)
    mart = _altered(mart, "transaction_count", td.account_number() % 50 == 0)
    return Q.monthly_summary_matches(rows, mart)


# --- catalog ----------------------------------------------------------------


def _given(spark, sf):
    tables = {name: spark.read.parquet(f"{sf}/{name}.parquet") for name in _GIVEN}
    return tables | {"stg_transactions": td.stg(spark, sf), "dim_accounts": td.dimension(spark, sf)}


_VIEWS = {"stg_transactions"}
#: What the owner of the given tables would say about some of them.
_ABOUT_TABLES = [
    ("orders", "raw", "What customers ordered, and when.", "sales"),
    ("documents", "", "Texts to train on.", "corpus team"),
    ("dim_accounts", "", "How each account changed over time.", ""),
]
_ABOUT_MODELS = [("stg_transactions", "staging", "lineitem, orders", "Order lines as payments.")]
_ABOUT_COLUMNS = [("stg_transactions", "transaction_id", "Order and line number.", True)]


@query
def table_profile(spark, sf):
    return C.table_profile(_given(spark, sf), _VIEWS)


@shared
def column_profile(spark, sf):
    return C.column_profile(_given(spark, sf), _VIEWS, keys={("nation", "n_nationkey")})


@query
def zone_infer(spark, sf):
    names = td.transactions(spark, sf).select(
        F.explode(
            F.array(*(
                F.concat(F.lit(prefix), F.lower("category"), F.lit(suffix))
                for prefix in ("stg_", "dim_", "fct_", "catalog_", "")
                for suffix in ("_runs", "_results", "")
            ))
        ).alias("table_name")
    )
    zones = names.distinct()
    return zones.withColumn("zone", C.infer_zone("table_name"))


def _catalog(spark, sf):
    return C.overlay(
        C.table_profile(_given(spark, sf), _VIEWS),
        spark.createDataFrame(_ABOUT_TABLES, C.TABLE_METADATA),
        spark.createDataFrame(_ABOUT_MODELS, C.MODEL_METADATA),
    )


@query
def catalog_overlay(spark, sf):
    return _catalog(spark, sf)


@query
def catalog_tables_report(spark, sf):
    return C.all_tables(_catalog(spark, sf))


@query
def zone_rollup(spark, sf):
    return C.zone_rollup(_catalog(spark, sf))


def _catalog_columns(spark, sf):
    return C.overlay_columns(
        C.column_profile(_given(spark, sf), _VIEWS),
        spark.createDataFrame(_ABOUT_COLUMNS, C.COLUMN_METADATA),
    )


@shared
def catalog_columns_report(spark, sf):
    return C.all_columns(_catalog_columns(spark, sf), _catalog(spark, sf))


@query
def column_name_policy(spark, sf):
    return Q.column_names(_catalog_columns(spark, sf))


@shared
def catalog_built(spark, sf):
    """The catalog of a loaded warehouse after two full rebuilds, its audit tables aside."""
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    house.append_transactions(td.transactions(spark, sf))
    for _ in range(2):
        build_models(house)
        tables, _columns = build_catalog(house, AT)
    return tables.where("zone <> 'metadata' AND NOT endswith(table_name, '_runs')").select(
        "table_name", "table_type", "zone", "row_count", "column_count", "last_built_at"
    )


# --- run analytics ----------------------------------------------------------


@shared
def run_timeline(spark, sf):
    return R.timeline(
        td.ingestion_runs(spark, sf), td.transform_runs(spark, sf), td.check_runs(spark, sf)
    )


@query
def latest_ingestion(spark, sf):
    return R.latest_ingestion_detail(td.ingestion_runs(spark, sf))


@query
def latest_transform(spark, sf):
    return R.latest_transform(td.transform_runs(spark, sf))


@query
def latest_check(spark, sf):
    return R.latest_check_summary(td.check_runs(spark, sf))


@query
def ingestion_history(spark, sf):
    return R.ingestion_history(td.ingestion_runs(spark, sf))


@query
def records_trend(spark, sf):
    return R.records_trend(td.ingestion_runs(spark, sf))


@query
def latest_check_results(spark, sf):
    return R.latest_check_results(td.check_results(spark, sf), td.check_runs(spark, sf))


@query
def check_outcomes(spark, sf):
    return R.check_outcomes(td.check_runs(spark, sf))


@query
def all_check_results(spark, sf):
    return R.all_check_results(td.check_results(spark, sf))


# --- files, pipeline and streams --------------------------------------------


def _table_file() -> Column:
    """What lies in the given folder: a table's file, or its folder with the files of its parts."""
    return F.split_part("file_path", F.lit("/"), F.lit(1)).alias("file_path")


@query
def landing_listing(spark, sf):
    """Each table, and whether the sizes and hashes, read in pieces, of its files are those of their bytes."""
    files = hash_files(landing_files(spark, sf, nested=True))
    return files.join(file_sums(spark, sf, nested=True), "path", "left").groupBy(_table_file()).agg(
        F.bool_and(F.col("file_hash").eqNullSafe(F.col("sha"))).alias("same_hash"),
        F.bool_and(F.col("file_size_bytes").eqNullSafe(F.col("length"))).alias("same_size"),
    )


@query
def schema_audit(spark, sf):
    """Each table with what is wrong with its files; parts with unlike faults give a row each."""
    return schema_errors(landing_files(spark, sf, nested=True)).select(_table_file(), "error").distinct()


@query
def manifest_pending(spark, sf):
    """Tables with files left after those an audit of their schema accepts are marked done."""
    files = stage(hash_files(landing_files(spark, sf, nested=True)), "files")
    manifest = spark.createDataFrame([], schemas.FILE_MANIFEST)
    errors = schema_errors(files).select("file_path", "error")
    manifest = M.update_manifest(manifest, M.manifest_entries(files, "run-1", AT, errors))
    return M.pending_files(files, manifest).select(_table_file()).distinct()


def _deliveries(spark, sf):
    """The yearly files of the landed rows; the first list ends with 1998, and 1997 changes."""
    files = td.landing(spark, sf).groupBy(F.col("source_file").alias("file_path")).agg(
        F.count("*").alias("file_size_bytes"), F.max("timestamp").cast("double").alias("file_mtime")
    )

    def listed(extra):
        size = F.col("file_size_bytes") + extra
        return files.select(
            "file_path", F.col("file_path").alias("path"), size.alias("file_size_bytes"), "file_mtime",
            F.sha2(F.concat_ws("|", "file_path", size), 256).alias("file_hash"),
        )

    is_changed = F.col("file_path") == "batch_1997.parquet"
    first = listed(F.lit(0)).where(F.col("file_path") < "batch_1999.parquet")
    return stage(first, "files"), stage(listed(F.when(is_changed, 1).otherwise(0)), "files")


def _manifests(spark, sf):
    """The manifest after a run in which 1996 failed, after the next one, and when reset."""
    first, second = _deliveries(spark, sf)
    none = spark.createDataFrame([], schemas.FILE_MANIFEST)
    broken = F.when(F.col("file_path") == "batch_1996.parquet", "damaged").alias("error")
    held = stage(
        M.update_manifest(none, M.manifest_entries(first, "run-1", AT, first.select("file_path", broken))),
        "manifest",
    )
    pending = M.pending_files(second, held)
    sound = second.select("file_path", F.lit(None).cast("string").alias("error"))
    then = M.update_manifest(held, M.manifest_entries(pending, "run-2", AT, sound))
    return second, {"first": held, "second": then, "reset": M.reset_manifest(then, "run-3", AT)}


@shared
def manifest_states(spark, sf):
    _, states = _manifests(spark, sf)
    return reduce(DataFrame.unionByName, (
        held.select(F.lit(step).alias("step"), "file_path", "file_size_bytes", "status", "run_id", "error_message")
        for step, held in states.items()
    ))


@shared
def manifest_pending_modes(spark, sf):
    """What each mode leaves to read after the first run."""
    files, states = _manifests(spark, sf)
    held = states["first"]
    meta = spark.createDataFrame([], schemas.MANIFEST_METADATA)
    mark = M.read_watermark(M.advance_watermark(meta, held, "landing", AT), "landing")
    left = {
        "hash": M.pending_files(files, held),
        "stat": M.pending_files(M.changed_files(files, held), held, mode="stat"),
        "watermark": M.pending_files(files, held, mark, mode="watermark"),
        "full_refresh": M.pending_files(files, held, full_refresh=True),
    }
    return reduce(DataFrame.unionByName, (
        df.select(F.lit(mode).alias("mode"), "file_path") for mode, df in left.items()
    ))


@shared
def watermark_steps(spark, sf):
    """The watermark after each run; one whose only success is old moves it down."""
    files, states = _manifests(spark, sf)
    meta = spark.createDataFrame([], schemas.MANIFEST_METADATA)
    old = files.where(F.col("file_path") == "batch_1997.parquet")
    no_error = old.select("file_path", F.lit(None).cast("string").alias("error"))
    found = []
    for step, entries in (
        ("first", states["first"]), ("second", states["second"]),
        ("nothing read", states["first"].where("status = 'failed'")),
        ("only 1997", M.manifest_entries(old, "run-4", AT, no_error)),
    ):
        meta = stage(M.advance_watermark(meta, entries, "landing", AT), "metadata")
        found.append(meta.select(F.lit(step).alias("step"), "source_dir", "watermark_mtime"))
    found.append(M.drop_watermark(meta, "landing").select(F.lit("dropped"), "source_dir", "watermark_mtime"))
    return reduce(DataFrame.union, found)


@query
def audit_rows(spark, sf):
    """What two runs over the same files leave in the audit table."""
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    folder = _landing_folder(spark, sf)
    for run_id in ("run-1", "run-2"):
        run_ingest(house, folder, run_id, AT)
    runs = house.runs("ingestion_runs", schemas.INGESTION_RUNS)
    return runs.select(
        "run_id", "started_at", "status", "records_loaded", "records_quarantined", "duplicates_skipped",
        (F.col("files_checked") == F.col("files_skipped") + F.col("files_processed")).alias("files_add_up"),
        (F.col("completed_at") > F.col("started_at")).alias("has_ended"),
    )


@shared
def own_run_timeline(spark, sf):
    """The timeline of runs as their own audit tables have it."""
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    run_ingest(house, _landing_folder(spark, sf), "run-1", AT)
    build_models(house, "models-1")
    check_warehouse(house, td.warehouse_tables(spark, sf, columns=Q.FACT_KEYS), "check-1", AT)
    line = R.timeline(*(
        house.runs(f"{kind}_runs", getattr(schemas, f"{kind.upper()}_RUNS"))
        for kind in ("ingestion", "transform", "check")
    ))
    return line.select("run_type", "run_id", "status", "key_metric")


@shared
def month_slice(spark, sf):
    """A range of dates of the raw table as it lies on disk, by month."""
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    house.append_transactions(td.transactions(spark, sf))
    return house.transactions("1997-02-15", "1997-04-02").select("transaction_id", "transaction_date", "run_id")


@query
def table_replaced(spark, sf):
    """The daily mart through a view of a table that replaced another."""
    name = f"mart_{uuid.uuid4().hex}"
    mart = A.daily_spend(td.stg(spark, sf))
    replace_table(mart.limit(3), name)
    replace_table(mart, name, A.DAILY_GRAIN)
    replace_view(read_table(spark, name).where("transaction_count > 1"), f"{name}_view")
    return read_table(spark, f"{name}_view")


@query
def table_order(spark, sf):
    """Whether each row of the written daily mart stands behind the one before in its file."""
    root = _new_folder(spark, "mart")
    publish(A.daily_spend(td.stg(spark, sf)), root, A.DAILY_GRAIN)
    rows = spark.read.parquet(f"{root}/data/*").select(
        *A.DAILY_GRAIN, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    grain = F.struct(*A.DAILY_GRAIN)
    before = F.lag(grain).over(Window.partitionBy("_file").orderBy("_row"))
    return rows.select(*A.DAILY_GRAIN, F.coalesce(before < grain, F.lit(True)).alias("in_order"))


def _landing_folder(spark, sf) -> str:
    """Landing files whose (name, row) order is the total order of the rows."""
    folder = _new_folder(spark, "landing_files")
    with freed_shuffles(spark):
        td.landing_in_order(spark, sf).select(*schemas.LANDING.names).write.parquet(folder)
    return folder


def _without_lineage(df: DataFrame) -> DataFrame:
    return df.drop("source_file", "ingested_at", "run_id")


@query
def ingest_pipeline(spark, sf):
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    run_ingest(house, _landing_folder(spark, sf), "run-1", AT)
    return _without_lineage(house.transactions())


@query
def ingest_pipeline_quarantine(spark, sf):
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    run_ingest(house, _landing_folder(spark, sf), "run-1", AT)
    return house.quarantine().select("quarantine_id", "record_data", "rejection_reason", "run_id")


@query
def stream_ingest(spark, sf):
    house = Warehouse(spark, _new_folder(spark, "warehouse"))
    run = Stream.ingest_stream(
        spark, _landing_folder(spark, sf), house, _new_folder(spark, "progress")
    )
    run.awaitTermination()
    return _without_lineage(house.transactions())


@query
def stream_daily_spend(spark, sf):
    """The daily mart of staged rows that come in two batches."""
    files = _new_folder(spark, "staged_files")
    rows = td.stg(spark, sf).select(*A.DAILY_GRAIN, "amount", "transaction_type", "status")
    rows.repartition("transaction_date").write.parquet(files)
    written = [name for name in child_names(spark, files) if name.endswith(".parquet")]
    stream = (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", max(1, -(-len(written) // 2))).parquet(files)
    )
    out = _new_folder(spark, "daily_spend")
    Stream.write_daily_spend(stream, out, _new_folder(spark, "progress"), every=2).awaitTermination()
    return Stream.read_daily_spend(spark, out)


@query
def stream_dedup(spark, sf):
    """Distinct ids after thinning a stream whose watermark spans the whole history."""
    files = _new_folder(spark, "landed_files")
    rows = td.landing(spark, sf)
    rows.write.parquet(files)
    stream = spark.readStream.schema(rows.schema).parquet(files)
    out = _new_folder(spark, "thinned")
    thinned = Stream.dedup_stream(stream, "20000 days").select("transaction_id")
    (
        thinned.writeStream.format("parquet")
        .option("checkpointLocation", _new_folder(spark, "progress"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema("transaction_id string").parquet(out)


def _export_roundtrip(spark, sf, fmt):
    folder = _new_folder(spark, f"export_{fmt}")
    export(td.landing(spark, sf).select(*schemas.LANDING.names), folder, fmt)
    return read_export(spark, folder, fmt, schemas.LANDING)


@query
def export_csv(spark, sf):
    return _export_roundtrip(spark, sf, "csv")


@query
def export_parquet(spark, sf):
    return _export_roundtrip(spark, sf, "parquet")
