"""The data catalog: table and column profiles, zones and business metadata."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.smallest import smallest
from ledgerloom.functions.text import json_list, number_text

BASE_TABLE, VIEW = "BASE TABLE", "VIEW"

# SQL names of column types.
_SQL_TYPES = {
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.TimestampNTZType: "TIMESTAMP",
    T.BinaryType: "BLOB",
}


def sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"{sql_type(kind.elementType)}[]"
    return _SQL_TYPES.get(type(kind), kind.simpleString().upper())


def infer_zone(name: Column | str) -> Column:
    """Zone by naming convention; the first rule that fits decides.

    Fixed values: the prefixes, suffixes and names, and the order of the rules.
    """
    name = F.col(name) if isinstance(name, str) else name
    return (
        F.when(name.startswith("stg_"), "staging")
        .when(name.startswith("dim_"), "dimension")
        .when(name.startswith("fct_"), "fact")
        .when(name.isin("transactions", "quarantine"), "raw")
        .when(name.endswith("_runs") | name.endswith("_results"), "metadata")
        .when(name.startswith("catalog_"), "metadata")
        .otherwise("mart")
    )


def table_profile(tables: Mapping[str, DataFrame], views: Collection[str] = ()) -> DataFrame:
    """Type, zone, rows and columns per table; a view is not counted."""
    rows = []
    for name, df in sorted(tables.items()):
        if name in views:
            counted = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("row_count"))
        else:
            counted = df.agg(F.count("*").alias("row_count"))
        rows.append(
            counted.select(
                F.lit(name).alias("table_name"),
                F.lit("main").alias("table_schema"),
                F.lit(VIEW if name in views else BASE_TABLE).alias("table_type"),
                infer_zone(F.lit(name)).alias("zone"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


_COLUMN_PROFILE = (
    "table_name string, column_name string, ordinal_position int, data_type string, "
    "is_nullable boolean, is_pk boolean, sample_values string"
)


def _samples(df: DataFrame, k: int) -> DataFrame:
    """One row: per column, up to ``k`` sample values as a JSON array of text, in one scan."""
    fields = {f.name: f.dataType for f in df.schema if _orderable(f.dataType)}

    def sample(name: str) -> Column:
        texts = F.transform(name, _as_text(fields[name]))
        return F.when(F.size(texts) > 0, json_list(texts)).alias(name)

    return smallest(df, list(fields), k).select(*(sample(name) for name in fields))


def column_profile(
    tables: Mapping[str, DataFrame],
    views: Collection[str] = (),
    keys: Collection[tuple[str, str]] = (),
    k: int = 3,
    parallel: int = 4,
) -> DataFrame:
    """One row per column: position, type, nullability and up to ``k`` sample values.

    Samples are the smallest distinct non-null values, as a JSON array of
    text; a view, or a column without values, has none.  Tables are profiled
    side by side, and one row of samples per table comes back.
    """

    def described(table: str) -> list[tuple]:
        df = tables[table]
        samples = {} if table in views else _samples(df, k).first().asDict()
        return [
            (table, f.name, position, sql_type(f.dataType), f.nullable,
             (table, f.name) in keys, samples.get(f.name))
            for position, f in enumerate(df.schema, start=1)
        ]

    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = [row for found in pool.map(described, sorted(tables)) for row in found]
    return spark.createDataFrame(rows, _COLUMN_PROFILE)


def _as_text(kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text
    if isinstance(kind, T.ArrayType):
        item = _as_text(kind.elementType)
        return lambda value: F.concat(
            F.lit("["),
            F.array_join(F.transform(value, lambda x: F.coalesce(item(x), F.lit("NULL"))), ", "), F.lit("]"),
        )
    return lambda value: value.cast("string")


# --- business metadata ------------------------------------------------------

TABLE_METADATA = "table_name string, zone string, description string, owner string"
COLUMN_METADATA = "table_name string, column_name string, description string, is_pk boolean"
MODEL_METADATA = "table_name string, source string, depends_on string, description string"

def _given(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def no_metadata(spark: SparkSession, shape: str = TABLE_METADATA) -> DataFrame:
    """Metadata of nothing, for callers that have none."""
    return spark.createDataFrame([], shape)


def overlay(
    profile: DataFrame, metadata: DataFrame, models: DataFrame | None = None
) -> DataFrame:
    """Lay business metadata over table profiles.

    Zone: metadata before the inferred one.  Description: metadata before the
    model's own.  Owner: metadata only.  Empty text counts as not given.
    """
    spark = profile.sparkSession
    models = no_metadata(spark, MODEL_METADATA) if models is None else models
    m = metadata.select(
        "table_name",
        _given("zone").alias("_zone"),
        _given("description").alias("_description"),
        _given("owner").alias("_owner"),
    )
    s = models.select(
        "table_name",
        F.col("source").alias("source_sql_file"),
        _given("depends_on").alias("depends_on"),
        _given("description").alias("_model_description"),
    )
    blank = F.lit("")
    return (
        profile.join(m, "table_name", "left")
        .join(s, "table_name", "left")
        .select(
            "table_name",
            "table_schema",
            "table_type",
            F.coalesce("_zone", "zone").alias("zone"),
            F.coalesce("_description", "_model_description", blank).alias("description"),
            F.coalesce("_owner", blank).alias("owner"),
            "source_sql_file",
            "depends_on",
            "row_count",
            "column_count",
        )
    )


def overlay_columns(profile: DataFrame, metadata: DataFrame) -> DataFrame:
    """Lay column descriptions and key marks over column profiles."""
    m = metadata.select(
        "table_name", "column_name", "description", F.col("is_pk").alias("_is_pk")
    )
    return profile.join(m, ["table_name", "column_name"], "left").select(
        F.sha2(F.concat_ws(".", "table_name", "column_name"), 256).alias("id"),
        "table_name",
        "column_name",
        "ordinal_position",
        "data_type",
        "is_nullable",
        F.coalesce("_is_pk", "is_pk").alias("is_pk"),
        F.coalesce("description", F.lit("")).alias("description"),
        "sample_values",
    )


# --- catalog queries --------------------------------------------------------


def zone_rollup(catalog_tables: DataFrame) -> DataFrame:
    """Tables, rows and columns per zone; a view adds no rows."""
    return catalog_tables.groupBy("zone").agg(
        F.count("*").alias("table_count"),
        F.sum(F.coalesce("row_count", F.lit(0))).alias("total_rows"),
        F.sum("column_count").alias("total_columns"),
    ).orderBy("zone")


def all_tables(catalog_tables: DataFrame) -> DataFrame:
    return catalog_tables.orderBy("zone", "table_name").select(
        "table_name", "table_type", "zone",
        F.coalesce("description", F.lit("")).alias("description"),
        "row_count", "column_count",
        F.coalesce("depends_on", F.lit("")).alias("depends_on"),
    )


def all_columns(catalog_columns: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    zones = catalog_tables.select("table_name", "zone")
    return (
        catalog_columns.join(zones, "table_name")
        .orderBy("zone", "table_name", "ordinal_position")
        .select(
            "table_name", "zone", "column_name", "data_type", "is_nullable", "is_pk",
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        )
    )
