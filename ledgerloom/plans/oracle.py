"""Plain SQL over the given tables for each registered query.

Written independently of the operators, for another SQL engine to run; files
and footers are not visible to SQL, so the queries over them have none.
"""

from __future__ import annotations

_SRC = """
src AS (
  SELECT concat(cast(l.l_orderkey AS varchar), '-', cast(l.l_linenumber AS varchar)) AS transaction_id,
         l.l_shipdate AS ts,
         l.l_extendedprice AS amount,
         CASE c.c_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
              WHEN 3 THEN 'JPY' ELSE 'CHF' END AS currency,
         su.s_name AS merchant_name,
         p.p_type AS category,
         concat('ACC-', lpad(cast(o.o_custkey AS varchar), cast(greatest(5, length(cast(o.o_custkey AS varchar))) AS integer), '0')) AS account_id,
         CASE WHEN l.l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS transaction_type,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
         cast(l.l_shipdate AS date) AS transaction_date,
         concat('batch_', cast(year(l.l_shipdate) AS varchar), '.parquet') AS source_file,
         cast(cast(l.l_shipdate AS date) + 1 AS timestamp) AS ingested_at,
         concat('run-', cast(year(l.l_shipdate) AS varchar)) AS run_id,
         l.l_orderkey AS k,
         cast(substr(concat('ACC-', lpad(cast(o.o_custkey AS varchar), cast(greatest(5, length(cast(o.o_custkey AS varchar))) AS integer), '0')), 5) AS bigint) AS acc
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier su ON l.l_suppkey = su.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

_STG_COLUMNS = """transaction_id, ts AS transaction_timestamp, transaction_date, amount, currency,
  merchant_name, category, account_id, transaction_type, status, source_file, ingested_at, run_id"""

_DIRTY = """
dirty AS (
  SELECT transaction_id, ts,
         CASE WHEN k % 97 = 0 THEN -amount WHEN k % 101 = 0 THEN NULL ELSE amount END AS amount,
         currency,
         CASE WHEN k % 89 = 0 THEN '' ELSE merchant_name END AS merchant_name,
         CASE WHEN k % 73 = 0 THEN NULL ELSE category END AS category,
         CASE WHEN k % 83 = 0 THEN concat('BAD-', substr(account_id, 5)) ELSE account_id END AS account_id,
         transaction_type,
         CASE WHEN k % 79 = 0 THEN 'unknown' ELSE status END AS status,
         transaction_date, source_file, k
  FROM src
),
tested AS (
  SELECT *,
    CASE WHEN coalesce(transaction_id, '') = '' THEN 'transaction_id is null or empty' ELSE '' END AS r1,
    CASE WHEN coalesce(currency, '') = '' THEN 'currency is null or empty' ELSE '' END AS r2,
    CASE WHEN coalesce(merchant_name, '') = '' THEN 'merchant_name is null or empty' ELSE '' END AS r3,
    CASE WHEN coalesce(category, '') = '' THEN 'category is null or empty' ELSE '' END AS r4,
    CASE WHEN coalesce(account_id, '') = '' THEN 'account_id is null or empty' ELSE '' END AS r5,
    CASE WHEN coalesce(transaction_type, '') = '' THEN 'transaction_type is null or empty' ELSE '' END AS r6,
    CASE WHEN coalesce(status, '') = '' THEN 'status is null or empty' ELSE '' END AS r7,
    CASE WHEN ts IS NULL THEN 'timestamp is null' ELSE '' END AS r8,
    CASE WHEN amount IS NULL OR amount <= 0 THEN 'amount is null or not positive' ELSE '' END AS r9,
    CASE WHEN currency NOT IN ('USD', 'EUR', 'GBP', 'JPY') THEN 'currency not in allowed values' ELSE '' END AS r10,
    CASE WHEN transaction_type NOT IN ('debit', 'credit') THEN 'transaction_type not in allowed values' ELSE '' END AS r11,
    CASE WHEN status NOT IN ('completed', 'pending', 'failed') THEN 'status not in allowed values' ELSE '' END AS r12,
    CASE WHEN NOT regexp_full_match(account_id, 'ACC-[0-9]{5}') THEN 'account_id does not match ACC-XXXXX pattern' ELSE '' END AS r13
  FROM dirty
),
judged AS (
  SELECT *, concat_ws('; ', r1, r2, r3, r4, r5, r6, r7, r8, r9, r10, r11, r12, r13) AS reason,
         [r1, r2, r3, r4, r5, r6, r7, r8, r9, r10, r11, r12, r13] AS reasons,
         concat(r1, r2, r3, r4, r5, r6, r7, r8, r9, r10, r11, r12, r13) = '' AS is_valid
  FROM tested
),
valid AS (SELECT * FROM judged WHERE is_valid),
invalid AS (SELECT * FROM judged WHERE NOT is_valid)"""

_ORDER = "ts, amount, merchant_name, category, account_id, transaction_type, status"

# Orders with NULLs first, as the engine under test sorts them.
_ORDER_NULLS = ", ".join(f"{c} NULLS FIRST" for c in _ORDER.split(", "))

_FIRST = f"""
firsts AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY {_ORDER}) = 1
)"""

_SUM_EXACT = "SUM(CAST(amount AS DECIMAL(18,2)))"
_SUM = f"CAST({_SUM_EXACT} AS DOUBLE)"


def _sum_if(kind: str) -> str:
    return (
        "CAST(SUM(CASE WHEN transaction_type = "
        f"'{kind}' THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)"
    )


_MARTS = f"""
daily AS (
  SELECT transaction_date, category, currency, {_SUM} AS total_amount,
         COUNT(*) AS transaction_count, {_SUM} / COUNT(*) AS avg_amount
  FROM src WHERE transaction_type = 'debit' AND status = 'completed'
  GROUP BY ALL
),
monthly AS (
  SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, account_id, currency,
         {_sum_if('debit')} AS total_debits, {_sum_if('credit')} AS total_credits,
         {_sum_if('credit')} - {_sum_if('debit')} AS net_flow,
         COUNT(*) AS transaction_count
  FROM src WHERE status = 'completed'
  GROUP BY ALL
)"""


def _profiles(run_dates: list[str]) -> str:
    values = ", ".join(f"(DATE '{day}')" for day in run_dates)
    return f"""
run_days AS (SELECT * FROM (VALUES {values}) v(run_date)),
upto AS (SELECT r.run_date, s.* FROM src s JOIN run_days r ON s.transaction_date < r.run_date),
{_profile_body('run_date, ')}"""


def _profile_body(by: str) -> str:
    """Profiles by definition: the favourite of a kind has most votes, then the first name."""
    return f"""cells AS (
  SELECT {by}account_id, currency, category, COUNT(*) AS n, {_SUM_EXACT} AS spend,
         MIN(transaction_date) AS since, MAX(transaction_date) AS until
  FROM upto GROUP BY ALL
),
votes AS (
  SELECT {by}account_id, vote.kind AS kind, vote.name AS name, SUM(n) AS n
  FROM (SELECT *, unnest([{{'kind': 1, 'name': currency}}, {{'kind': 2, 'name': category}}]) AS vote
        FROM cells)
  GROUP BY ALL
),
favourites AS (
  SELECT {by}account_id, (MIN({{'less': -n, 'name': name}}) FILTER (kind = 1)).name AS primary_currency,
         (MIN({{'less': -n, 'name': name}}) FILTER (kind = 2)).name AS primary_category
  FROM votes GROUP BY ALL
),
totals AS (
  SELECT {by}account_id, CAST(SUM(n) AS BIGINT) AS transaction_count,
         CAST(SUM(spend) AS DOUBLE) AS total_spend, MIN(since) AS first_seen, MAX(until) AS last_seen
  FROM cells GROUP BY ALL
),
profiles AS (
  SELECT *, md5(concat_ws('|', primary_currency, primary_category, transaction_count, total_spend,
                          first_seen, last_seen)) AS row_hash
  FROM totals NATURAL JOIN favourites
)"""


def _dim(gap_days: int) -> str:
    return f"""
compared AS (
  SELECT *, lag(row_hash) OVER (PARTITION BY account_id ORDER BY run_date) AS prev FROM profiles
),
starts AS (SELECT * FROM compared WHERE prev IS NULL OR prev <> row_hash),
dim AS (
  SELECT row_number() OVER (ORDER BY run_date, account_id) AS account_sk, account_id,
         primary_currency, primary_category, transaction_count, total_spend, first_seen, last_seen,
         row_hash, CAST(run_date AS TIMESTAMP) AS valid_from,
         CAST(lead(run_date) OVER (PARTITION BY account_id ORDER BY run_date) - {gap_days} AS TIMESTAMP) AS valid_to,
         lead(run_date) OVER (PARTITION BY account_id ORDER BY run_date) IS NULL AS is_current,
         concat('run-', CAST(run_date AS VARCHAR)) AS run_id,
         CAST(substr(account_id, 5) AS BIGINT) AS acc
  FROM starts
)"""


_RUN_DATES = ["1998-01-01", "2000-01-01", "2002-01-01"]
_FCT = f"""
fct AS (
  SELECT s.transaction_id, s.ts AS transaction_timestamp, s.transaction_date,
         coalesce(d.account_sk, -1) AS account_sk, d.account_sk AS found_sk, s.account_id, s.amount,
         s.currency, s.merchant_name, s.category, s.transaction_type, s.status, s.source_file,
         s.ingested_at, s.run_id, s.k
  FROM src s LEFT JOIN dim d
    ON s.account_id = d.account_id AND s.ts >= d.valid_from
   AND s.ts < coalesce(d.valid_to, TIMESTAMP '9999-12-31 23:59:59')
)"""

_DIM_COLUMNS = """account_sk, account_id, primary_currency, primary_category, transaction_count,
  total_spend, first_seen, last_seen, row_hash, valid_from, valid_to, is_current, run_id"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join((_SRC, *parts))


_W_SRC = _with()
_W_DIRTY = _with(_DIRTY)
_W_FIRST = _with(_DIRTY, _FIRST)
_W_MARTS = _with(_MARTS)
_W_DIM = _with(_profiles(_RUN_DATES), _dim(1))
_W_FCT = _with(_profiles(_RUN_DATES), _dim(1), _FCT)
_W_ALL = _with(_MARTS, _profiles(_RUN_DATES), _dim(1), _FCT)

# Audit tables with one run per period.
_RUNS = """
ingestion_runs AS (
  SELECT concat('ingest-', CAST(month AS VARCHAR)) AS run_id, CAST(month AS TIMESTAMP) AS started_at,
         CASE WHEN records_quarantined > records_loaded THEN 'failed' ELSE 'completed' END AS status,
         * EXCLUDE (month)
  FROM (
    SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month,
           COUNT(DISTINCT source_file) AS files_processed,
           COUNT(*) FILTER (WHERE currency <> 'CHF') AS records_loaded,
           COUNT(*) FILTER (WHERE currency = 'CHF') AS records_quarantined,
           COUNT(DISTINCT merchant_name) AS duplicates_skipped,
           CAST(COUNT(*) AS DOUBLE) / 64 AS elapsed_seconds
    FROM src GROUP BY 1)
),
transform_runs AS (
  SELECT concat('models-', CAST(q AS VARCHAR)) AS run_id,
         CAST(q AS TIMESTAMP) + INTERVAL 1 HOUR AS started_at, 'completed' AS status,
         * EXCLUDE (q)
  FROM (
    SELECT CAST(date_trunc('quarter', transaction_date) AS DATE) AS q,
           COUNT(DISTINCT category) AS models_executed,
           CAST(COUNT(*) AS DOUBLE) / 64 AS elapsed_seconds
    FROM src GROUP BY 1)
),
check_results AS (
  SELECT concat('check-', CAST(y AS VARCHAR)) AS run_id,
         CAST(y AS TIMESTAMP) + INTERVAL 2 HOUR AS started_at,
         concat('currency_', lower(category)) AS check_name,
         CASE WHEN category LIKE 'S%' THEN 'critical' ELSE 'warn' END AS severity,
         concat('Currencies of ', category) AS description,
         CASE WHEN violation_count * 5 > n THEN 'fail' ELSE 'pass' END AS status,
         violation_count, CAST(n AS DOUBLE) / 64 AS elapsed_seconds
  FROM (
    SELECT CAST(date_trunc('year', transaction_date) AS DATE) AS y, category,
           COUNT(*) FILTER (WHERE currency = 'CHF') AS violation_count, COUNT(*) AS n
    FROM src GROUP BY 1, 2)
),
check_runs AS (
  SELECT run_id, started_at,
         CASE WHEN COUNT(*) FILTER (WHERE status = 'fail' AND severity = 'critical') > 0 THEN 'failed'
              WHEN COUNT(*) FILTER (WHERE status = 'fail') > 0 THEN 'warn' ELSE 'passed' END AS status,
         COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE status = 'pass') AS checks_passed,
         COUNT(*) FILTER (WHERE status = 'fail') AS checks_failed, CAST(0 AS BIGINT) AS checks_errored,
         SUM(elapsed_seconds) AS elapsed_seconds
  FROM check_results GROUP BY run_id, started_at
)"""
_W_RUNS = _with(_RUNS)

# Business metadata of the two warehouse tables among the profiled ones.
_GIVEN = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)
_ABOUT = {
    "orders": ("raw", "What customers ordered, and when.", "sales"),
    "documents": ("mart", "Texts to train on.", "corpus team"),
}


def _catalog() -> str:
    given = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'BASE TABLE' AS table_type, "
        f"'{_ABOUT.get(t, ('mart',))[0]}' AS zone, "
        f"(SELECT COUNT(*) FROM {t}) AS row_count, "
        f"(SELECT CAST(COUNT(*) AS INTEGER) FROM (DESCRIBE {t})) AS column_count, "
        f"'{_ABOUT.get(t, ('', ''))[1]}' AS description, "
        f"'{_ABOUT.get(t, ('', '', ''))[2]}' AS owner, NULL AS source_sql_file, NULL AS depends_on"
        for t in _GIVEN
    )
    return f"""
catalog AS (
  {given}
  UNION ALL SELECT 'dim_accounts', 'BASE TABLE', 'dimension', (SELECT COUNT(*) FROM dim), 13,
    'How each account changed over time.', '', NULL, NULL
  UNION ALL SELECT 'stg_transactions', 'VIEW', 'staging', NULL, 13,
    'Order lines as payments.', '', 'staging', 'lineitem, orders'
)"""


_W_CATALOG = _with(_profiles(_RUN_DATES), _dim(1), _catalog())

_TABLE_COLUMNS = {
    "benchmark": "item_id:BIGINT text:VARCHAR",
    "conversations": "conv_id:BIGINT turn:BIGINT role:VARCHAR text:VARCHAR",
    "documents": "doc_id:BIGINT text:VARCHAR lang:VARCHAR source:VARCHAR n_chars:BIGINT",
    "embeddings": "vec_id:BIGINT embedding:FLOAT[] label:INTEGER",
    "events": "event_id:BIGINT ts:TIMESTAMP user_id:BIGINT event_type:VARCHAR value:DOUBLE props:VARCHAR",
    "labels": "doc_id:BIGINT quality:INTEGER toxic:INTEGER",
    "pages": "page_id:BIGINT url:VARCHAR html:VARCHAR",
    "customer": "c_custkey:BIGINT c_name:VARCHAR c_nationkey:INTEGER c_acctbal:DOUBLE c_mktsegment:VARCHAR",
    "lineitem": "l_orderkey:BIGINT l_partkey:BIGINT l_suppkey:BIGINT l_linenumber:INTEGER "
                "l_quantity:DOUBLE l_extendedprice:DOUBLE l_discount:DOUBLE l_tax:DOUBLE "
                "l_returnflag:VARCHAR l_linestatus:VARCHAR l_shipdate:TIMESTAMP",
    "nation": "n_nationkey:INTEGER n_name:VARCHAR n_regionkey:INTEGER",
    "orders": "o_orderkey:BIGINT o_custkey:BIGINT o_orderstatus:VARCHAR o_totalprice:DOUBLE "
              "o_orderdate:TIMESTAMP o_orderpriority:VARCHAR",
    "part": "p_partkey:BIGINT p_name:VARCHAR p_brand:VARCHAR p_type:VARCHAR p_size:INTEGER "
            "p_retailprice:DOUBLE",
    "region": "r_regionkey:INTEGER r_name:VARCHAR",
    "supplier": "s_suppkey:BIGINT s_name:VARCHAR s_nationkey:INTEGER s_acctbal:DOUBLE",
}
_STG_TYPES = (
    "transaction_id:VARCHAR transaction_timestamp:TZ transaction_date:DATE amount:DOUBLE "
    "currency:VARCHAR merchant_name:VARCHAR category:VARCHAR account_id:VARCHAR "
    "transaction_type:VARCHAR status:VARCHAR source_file:VARCHAR ingested_at:TZ run_id:VARCHAR"
)


_DIM_TYPES = (
    "account_sk:BIGINT account_id:VARCHAR primary_currency:VARCHAR primary_category:VARCHAR "
    "transaction_count:BIGINT total_spend:DOUBLE first_seen:DATE last_seen:DATE row_hash:VARCHAR "
    "valid_from:TZ valid_to:TZ is_current:BOOLEAN run_id:VARCHAR"
)


def _columns(table: str, text: str, sampled: bool, source: str | None = None) -> list[str]:
    rows = []
    for position, item in enumerate(text.split(), start=1):
        name, kind = item.split(":")
        kind = kind.replace("TZ", "TIMESTAMP WITH TIME ZONE")
        sample = "CAST(NULL AS VARCHAR)"
        if sampled:
            sample = (
                f"(SELECT '[' || string_agg(to_json(CAST(v AS VARCHAR)), ', ' ORDER BY v) || ']' "
                f"FROM (SELECT DISTINCT {name} AS v FROM {source or table} WHERE {name} IS NOT NULL "
                "ORDER BY v LIMIT 3))"
            )
        rows.append(
            f"SELECT '{table}' AS table_name, '{name}' AS column_name, {position} AS ordinal_position, "
            f"'{kind}' AS data_type, true AS is_nullable, "
            f"{'true' if (table, name) in _PK else 'false'} AS is_pk, {sample} AS sample_values"
        )
    return rows


def _column_profile() -> str:
    return _with(_profiles(_RUN_DATES), _dim(1)) + " " + " UNION ALL ".join([
        *(row for table, text in _TABLE_COLUMNS.items() for row in _columns(table, text, True)),
        *_columns("dim_accounts", _DIM_TYPES, True, "dim"),
        *_columns("stg_transactions", _STG_TYPES, False),
    ])


_PK = {("nation", "n_nationkey")}
_COLUMN_PROFILE = _column_profile()
_PK = {("stg_transactions", "transaction_id")}
_COLUMN_REPORT = _column_profile()

_SUITE = """
suite AS (
  SELECT 'accepted_values_currency' AS check_name, 'warn' AS severity,
         (SELECT COUNT(*) FROM src WHERE currency NOT IN ('USD', 'EUR', 'GBP', 'JPY')) AS n
  UNION ALL SELECT 'dim_accounts_no_null_sk', 'critical', (SELECT COUNT(*) FROM dim WHERE account_sk IS NULL)
  UNION ALL SELECT 'dim_accounts_no_overlapping_ranges', 'critical', (
    SELECT COUNT(*) FROM dim a JOIN dim b ON a.account_id = b.account_id AND a.account_sk < b.account_sk
    WHERE a.valid_from < coalesce(b.valid_to, TIMESTAMP '9999-12-31')
      AND b.valid_from < coalesce(a.valid_to, TIMESTAMP '9999-12-31'))
  UNION ALL SELECT 'dim_accounts_single_current', 'critical', (
    SELECT COUNT(*) FROM (SELECT account_id FROM dim WHERE is_current GROUP BY 1 HAVING COUNT(*) > 1))
  UNION ALL SELECT 'fct_no_null_account_sk', 'critical', (SELECT COUNT(*) FROM fct WHERE account_sk IS NULL)
  UNION ALL SELECT 'fct_no_unknown_account_sk', 'warn', (SELECT COUNT(*) FROM fct WHERE account_sk = -1)
  UNION ALL SELECT 'fct_row_count_matches_staging', 'critical',
    (SELECT CASE WHEN (SELECT COUNT(*) FROM src) <> (SELECT COUNT(*) FROM fct) THEN 1 ELSE 0 END)
  UNION ALL SELECT 'fct_unique_transaction_id', 'critical', (
    SELECT COUNT(*) FROM (SELECT transaction_id FROM fct GROUP BY 1 HAVING COUNT(*) > 1))
  UNION ALL SELECT 'freshness', 'warn', (SELECT CASE WHEN MAX(ingested_at)
    < TIMESTAMP '2003-01-01' - INTERVAL 48 HOUR THEN 1 ELSE 0 END FROM src)
  UNION ALL SELECT 'mart_not_empty', 'critical',
    (SELECT COUNT(*) FROM (SELECT (SELECT COUNT(*) FROM daily) AS c UNION ALL
     SELECT (SELECT COUNT(*) FROM monthly) UNION ALL SELECT (SELECT COUNT(*) FROM fct)) WHERE c = 0)
  UNION ALL SELECT 'row_count_staging', 'critical', (SELECT CASE WHEN (SELECT COUNT(*) FROM src) <>
    (SELECT COUNT(*) FROM (SELECT transaction_id FROM src)) THEN 1 ELSE 0 END)
  UNION ALL SELECT 'unique_daily_spend_grain', 'critical', (SELECT COUNT(*) FROM (
    SELECT 1 FROM daily GROUP BY transaction_date, category, currency HAVING COUNT(*) > 1))
  UNION ALL SELECT 'unique_monthly_summary_grain', 'critical', (SELECT COUNT(*) FROM (
    SELECT 1 FROM monthly GROUP BY month, account_id, currency HAVING COUNT(*) > 1))
),
rated AS (
  SELECT check_name, severity, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status,
         n AS violation_count FROM suite
)"""
_W_SUITE = _W_ALL + "," + _SUITE

_JSON_FIELDS = {
    "transaction_id": "transaction_id",
    "timestamp": "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'",
    "amount": "CAST(amount AS VARCHAR)",
    "currency": "currency",
    "merchant_name": "merchant_name",
    "category": "category",
    "account_id": "account_id",
    "transaction_type": "transaction_type",
    "status": "status",
}
_RECORD = (
    "'{' || "
    + " || ',' || ".join(
        f"""'"{name}":"' || coalesce({value}, 'null') || '"'"""
        for name, value in _JSON_FIELDS.items()
    )
    + " || '}'"
)

_LANDED = """transaction_id, ts AS "timestamp", amount, currency, merchant_name, category,
  account_id, transaction_type, status"""

_FILES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)
_LANDING_COLUMNS = sorted([
    "transaction_id", "timestamp", "amount", "currency", "merchant_name", "category",
    "account_id", "transaction_type", "status",
])


def _schema_audit() -> str:
    tables = " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS file_path, "
        f"(SELECT list(column_name ORDER BY column_name) FROM (DESCRIBE {name})) AS found"
        for name in _FILES
    )
    names = ", ".join(f"'{name}'" for name in _LANDING_COLUMNS)

    def text(label: str, items: str) -> str:
        quoted = f"list_transform({items}, lambda x: chr(39) || x || chr(39))"
        return f"'{label} columns: [' || array_to_string({quoted}, ', ') || ']'"

    return f"""WITH audited AS (
          SELECT file_path,
            list_filter([{names}], lambda x: NOT list_contains(found, x)) AS missing,
            list_filter(found, lambda x: NOT list_contains([{names}], x)) AS extra
          FROM ({tables}))
        SELECT file_path, {text('Missing', 'missing')} || '; ' || {text('Unexpected', 'extra')} AS error
        FROM audited"""


_W_FILES = f"""{_W_SRC}, files AS (
          SELECT source_file AS file_path, CAST(substr(source_file, 7, 4) AS INTEGER) AS y, COUNT(*) AS n,
            epoch(MAX(ts)) AS mtime FROM src GROUP BY source_file)"""

_PIPELINE = f"SELECT {_LANDED}, transaction_date FROM firsts"

ORACLE_SQL: dict[str, str] = {
    "validate_split": f"{_W_DIRTY} SELECT transaction_id, is_valid FROM judged",
    "rejection_text": f"{_W_DIRTY} SELECT transaction_id, reason AS rejection_reason FROM invalid",
    "quarantine_reasons": f"""{_W_DIRTY}
        SELECT reason, COUNT(*) AS row_count
        FROM (SELECT unnest(reasons) AS reason FROM invalid) WHERE reason <> '' GROUP BY reason""",
    "quarantine_records": f"""{_W_DIRTY}
        SELECT source_file, {_RECORD} AS record_data, reason AS rejection_reason,
               TIMESTAMP '2003-01-01' AS rejected_at, 'run-1' AS run_id FROM invalid""",
    "lineage_enrich": f"""{_W_DIRTY}
        SELECT {_LANDED}, transaction_date, source_file, TIMESTAMP '2003-01-01' AS ingested_at,
               'run-1' AS run_id FROM valid""",
    "staging": f"{_W_SRC} SELECT {_STG_COLUMNS} FROM src",
    "date_range_slice": f"""{_W_SRC} SELECT {_STG_COLUMNS} FROM src
        WHERE transaction_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'""",
    "dedup_first": f"{_W_FIRST} SELECT {_LANDED}, source_file FROM firsts",
    "dedup_cross_batch": f"""{_W_SRC},
        fresh AS (
          SELECT * FROM src s WHERE source_file > 'batch_1998.parquet' AND NOT EXISTS (
            SELECT 1 FROM src h WHERE h.transaction_id = s.transaction_id
              AND h.source_file <= 'batch_1998.parquet')
          QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY {_ORDER}) = 1)
        SELECT {_LANDED}, source_file FROM fresh""",
    "ingest_counts": f"""{_W_DIRTY},
        known AS (SELECT DISTINCT transaction_id FROM src WHERE source_file = 'batch_1996.parquet'),
        ranked AS (
          SELECT source_file, transaction_id,
            row_number() OVER (PARTITION BY transaction_id, source_file ORDER BY {_ORDER}) AS in_file,
            row_number() OVER (PARTITION BY transaction_id ORDER BY source_file, {_ORDER}) AS in_batch,
            transaction_id IN (SELECT transaction_id FROM known) AS is_known
          FROM valid),
        labels AS (
          SELECT source_file, COUNT(*) FILTER (WHERE in_batch = 1 AND NOT is_known) AS loaded,
            COUNT(*) FILTER (WHERE in_file > 1) AS within_file,
            COUNT(*) FILTER (WHERE in_file = 1 AND (in_batch > 1 OR is_known)) AS cross_file
          FROM ranked GROUP BY 1)
        SELECT source_file, COUNT(*) AS rows_read, coalesce(any_value(loaded), 0) AS loaded,
          COUNT(*) FILTER (WHERE NOT is_valid) AS quarantined,
          coalesce(any_value(within_file), 0) AS within_file,
          coalesce(any_value(cross_file), 0) AS cross_file,
          coalesce(any_value(within_file), 0) + coalesce(any_value(cross_file), 0) AS skipped
        FROM judged LEFT JOIN labels USING (source_file) GROUP BY source_file""",
    "run_totals": f"""{_W_DIRTY}
        SELECT COUNT(DISTINCT source_file) AS files_processed,
          COUNT(DISTINCT transaction_id) FILTER (WHERE is_valid) AS records_loaded,
          COUNT(*) FILTER (WHERE NOT is_valid) AS records_quarantined,
          COUNT(*) FILTER (WHERE is_valid)
            - COUNT(DISTINCT transaction_id) FILTER (WHERE is_valid) AS duplicates_skipped
        FROM judged""",
    "daily_spend": f"{_W_MARTS} SELECT * FROM daily",
    "monthly_account_summary": f"{_W_MARTS} SELECT * FROM monthly",
    "top_merchants": f"""{_W_SRC} SELECT merchant_name, {_SUM} AS total_amount,
          COUNT(*) AS transaction_count
        FROM src WHERE transaction_type = 'debit' GROUP BY merchant_name
        ORDER BY total_amount DESC, merchant_name LIMIT 10""",
    "currency_breakdown": f"""{_W_SRC} SELECT currency, COUNT(*) AS transaction_count,
          {_SUM} AS total_amount, ROUND({_SUM} / COUNT(*), 2) AS avg_amount
        FROM src GROUP BY currency""",
    "fact_summary": f"""{_W_FCT} SELECT account_sk, account_id, COUNT(*) AS transaction_count,
          {_SUM} AS total_amount, MIN(transaction_date) AS first_transaction,
          MAX(transaction_date) AS last_transaction
        FROM fct GROUP BY account_sk, account_id""",
    "daily_activity": f"""{_W_SRC} SELECT transaction_date, COUNT(*) AS transaction_count,
          {_SUM} AS total_amount FROM src GROUP BY transaction_date""",
    "lineage_counts": f"""{_W_SRC} SELECT source_file, run_id, COUNT(*) AS transaction_count
        FROM src GROUP BY ALL""",
    "daily_spend_report": f"""{_W_MARTS} SELECT transaction_date, category, total_amount,
          transaction_count FROM daily""",
    "monthly_report": f"""{_W_MARTS} SELECT month, account_id, currency, total_debits,
          total_credits, net_flow, transaction_count FROM monthly""",
    "account_profiles": f"{_with('upto AS (SELECT * FROM src)', _profile_body(''))} SELECT * FROM profiles",
    "primary_mode": f"""{_with(_profiles(_RUN_DATES))}
        SELECT account_id, run_date, primary_currency, primary_category FROM profiles""",
    "scd2_versions": f"{_W_DIM} SELECT {_DIM_COLUMNS} FROM dim",
    "scd2_contiguous": f"{_with(_profiles(_RUN_DATES), _dim(0))} SELECT {_DIM_COLUMNS} FROM dim",
    "scd2_merge_two_runs": f"{_with(_profiles(_RUN_DATES[:2]), _dim(1))} SELECT {_DIM_COLUMNS} FROM dim",
    "scd2_counts": f"""{_with(_profiles(_RUN_DATES[:2]), _dim(1))},
        counted AS (SELECT
          (SELECT COUNT(*) FROM profiles WHERE run_date = DATE '2000-01-01') AS accounts_processed,
          (SELECT COUNT(*) FROM dim WHERE run_id = 'run-2000-01-01' AND is_current) AS new_versions)
        SELECT 'run-2000-01-01' AS run_id, accounts_processed, new_versions,
          accounts_processed - new_versions AS unchanged FROM counted""",
    "account_history": f"""{_W_DIM}
        SELECT account_sk, account_id, primary_currency, primary_category, transaction_count,
          total_spend, first_seen, last_seen, valid_from, valid_to, is_current,
          row_number() OVER (PARTITION BY account_id ORDER BY valid_from) AS version_number,
          CASE WHEN is_current THEN DATE '2003-01-01' - CAST(valid_from AS DATE)
               ELSE CAST(valid_to AS DATE) - CAST(valid_from AS DATE) END AS version_duration_days
        FROM dim""",
    "fact_point_in_time": f"{_W_FCT} SELECT * EXCLUDE (found_sk, k) FROM fct",
    "fact_unknown_members": f"""{_W_FCT} SELECT source_file, COUNT(*) AS fact_count,
          COUNT(*) FILTER (WHERE account_sk = -1) AS unknown_count FROM fct GROUP BY source_file""",
    "check_row_count_staging": f"""{_W_SRC}, counts AS (
          SELECT COUNT(*) AS source_count, COUNT(*) FILTER (WHERE k % 50 <> 0) AS staging_count FROM src)
        SELECT 'stg_transactions' AS check_target, source_count, staging_count FROM counts
        WHERE source_count <> staging_count""",
    "check_mart_not_empty": f"""{_W_ALL}, counts AS (
          SELECT 'daily_spend_by_category' AS table_name, (SELECT COUNT(*) FROM daily) AS row_count
          UNION ALL SELECT 'monthly_account_summary',
            (SELECT COUNT(*) FROM src WHERE status = 'completed' AND status = 'unknown')
          UNION ALL SELECT 'fct_transactions', (SELECT COUNT(*) FROM fct))
        SELECT table_name, row_count FROM counts WHERE row_count = 0""",
    "check_freshness": f"""{_W_SRC}, newest AS (SELECT MAX(ingested_at) AS m FROM src)
        SELECT m AS latest_ingested_at,
          CAST(epoch(TIMESTAMP '2003-01-01') - epoch(m) AS BIGINT) AS staleness_seconds,
          CAST(172800 AS BIGINT) AS threshold_seconds
        FROM newest WHERE m < TIMESTAMP '2003-01-01' - INTERVAL 48 HOUR""",
    "check_unique_daily_spend_grain": f"""{_W_MARTS},
        doubled AS (SELECT * FROM daily UNION ALL SELECT * FROM daily WHERE category = 'ECONOMY')
        SELECT transaction_date, category, currency, COUNT(*) AS row_count FROM doubled
        GROUP BY ALL HAVING COUNT(*) > 1""",
    "check_unique_monthly_summary_grain": f"""{_W_MARTS},
        doubled AS (SELECT * FROM monthly UNION ALL SELECT * FROM monthly WHERE currency = 'JPY')
        SELECT month, account_id, currency, COUNT(*) AS row_count FROM doubled
        GROUP BY ALL HAVING COUNT(*) > 1""",
    "check_accepted_values_currency": f"""{_W_SRC} SELECT transaction_id, currency FROM src
        WHERE currency NOT IN ('USD', 'EUR', 'GBP', 'JPY')""",
    "check_fct_unique_transaction_id": f"""{_W_SRC}
        SELECT transaction_id, COUNT(*) AS occurrence_count FROM src
        GROUP BY transaction_id HAVING COUNT(*) > 1""",
    "check_fct_no_null_account_sk": f"""{_W_FCT}
        SELECT transaction_id, account_id, found_sk AS account_sk FROM fct WHERE found_sk IS NULL""",
    "check_fct_no_unknown_account_sk": f"""{_W_FCT}
        SELECT transaction_id, account_id, account_sk FROM fct WHERE account_sk = -1""",
    "check_fct_row_count_matches_staging": f"""{_W_FCT}, counts AS (
          SELECT (SELECT COUNT(*) FROM src WHERE k % 50 <> 0) AS stg_count,
                 (SELECT COUNT(*) FROM fct) AS fct_count)
        SELECT 'row_count_mismatch' AS check_detail, stg_count, fct_count,
          stg_count - fct_count AS difference FROM counts WHERE stg_count <> fct_count""",
    "check_dim_accounts_single_current": f"""{_W_DIM}
        SELECT account_id, COUNT(*) AS current_count FROM dim WHERE is_current OR acc % 7 = 0
        GROUP BY account_id HAVING COUNT(*) > 1""",
    "check_dim_accounts_no_overlapping_ranges": f"""{_W_DIM}, d AS (
          SELECT account_id, account_sk, valid_from,
            coalesce(CASE WHEN acc % 10 = 0 THEN valid_to + INTERVAL 30 DAY ELSE valid_to END,
                     TIMESTAMP '9999-12-31') AS valid_to FROM dim)
        SELECT a.account_id, a.account_sk, b.account_sk AS b_account_sk
        FROM d a JOIN d b ON a.account_id = b.account_id AND a.account_sk < b.account_sk
        WHERE a.valid_from < b.valid_to AND b.valid_from < a.valid_to""",
    "check_dim_accounts_no_null_sk": f"""{_W_DIM}
        SELECT account_id, valid_from FROM dim WHERE acc % 5 = 0""",
    "check_suite": f"{_W_SUITE} SELECT * FROM rated",
    "suite_rating": f"""{_W_SUITE}
        SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE status = 'pass') AS checks_passed,
          COUNT(*) FILTER (WHERE status = 'fail') AS checks_failed, CAST(0 AS BIGINT) AS checks_errored,
          CASE WHEN COUNT(*) FILTER (WHERE status = 'fail' AND severity = 'critical') > 0 THEN 'failed'
               WHEN COUNT(*) FILTER (WHERE status = 'fail') > 0 THEN 'warn' ELSE 'passed' END AS status
        FROM rated""",
    "suite_with_missing_table": f"""{_W_SUITE}
        SELECT check_name, severity,
          CASE WHEN check_name LIKE 'fct%' OR check_name = 'mart_not_empty' THEN 'error' ELSE status END AS status,
          CASE WHEN check_name LIKE 'fct%' OR check_name = 'mart_not_empty' THEN 0
               ELSE violation_count END AS violation_count
        FROM rated""",
    "distribution_share": f"""{_W_SRC} SELECT currency, COUNT(*) AS row_count,
          CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM src) AS share FROM src GROUP BY currency""",
    "share_within": f"""{_W_SRC},
        found AS (SELECT currency, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM src) AS share
                  FROM src GROUP BY currency),
        wanted AS (SELECT * FROM (VALUES ('USD', 0.2::DOUBLE), ('EUR', 0.2::DOUBLE),
          ('GBP', 0.2::DOUBLE), ('JPY', 0.05::DOUBLE), ('XXX', 0.1::DOUBLE)) v(currency, expected_share)),
        both_sides AS (SELECT currency, coalesce(share, 0) AS share,
          coalesce(expected_share, 0) AS expected_share
          FROM found FULL JOIN wanted USING (currency))
        SELECT * FROM both_sides WHERE abs(share - expected_share) >= 0.03""",
    "amount_shape": f"""{_W_SRC}, m AS (SELECT {_SUM} / COUNT(amount) AS mean FROM src)
        SELECT ROUND(any_value(mean), 6) AS mean, quantile_cont(amount, 0.5) AS median,
          ROUND(avg(power(amount - mean, 3)) / power(avg(power(amount - mean, 2)), 1.5), 6) AS skewness,
          COUNT(*) FILTER (WHERE amount <= 0) AS non_positive
        FROM src, m""",
    "amount_shape_violations": f"""{_W_SRC}
        SELECT quantile_cont(amount, 0.5) AS median, COUNT(*) FILTER (WHERE amount <= 0) AS non_positive
        FROM src HAVING NOT skewness(amount) > 1 OR NOT quantile_cont(amount, 0.5) < avg(amount)""",
    "functional_dependency": f"""{_W_SRC}
        SELECT merchant_name, COUNT(DISTINCT category) AS value_count FROM src
        GROUP BY merchant_name HAVING COUNT(DISTINCT category) > 1""",
    "distinct_accounts": f"{_W_SRC} SELECT COUNT(DISTINCT account_id) AS distinct_count FROM src",
    "row_conformance": f"""{_W_DIRTY},
        failed AS (
          SELECT unnest(list_append(reasons,
            CASE WHEN k % 60 = 0 THEN 'transaction_date differs from timestamp' ELSE '' END)) AS rule
          FROM judged)
        SELECT rule, COUNT(*) AS violation_count FROM failed WHERE rule <> '' GROUP BY rule""",
    "run_per_file": f"""{_W_SRC}
        SELECT concat('half_', CAST((year(ts) - 1990) // 4 AS VARCHAR)) AS source_file,
          COUNT(DISTINCT year(ts) - year(ts) % 3) AS run_count
        FROM src GROUP BY 1 HAVING COUNT(DISTINCT year(ts) - year(ts) % 3) > 1""",
    "run_totals_match": f"""{_W_SRC}, t AS (
          SELECT COUNT(*) FILTER (WHERE currency <> 'CHF') AS logged, COUNT(*) AS stored FROM src)
        SELECT logged, stored FROM t WHERE logged <> stored""",
    "daily_spend_recompute": f"""{_W_MARTS}
        SELECT transaction_date, category, currency, total_amount,
          transaction_count + CASE WHEN f = 'first' THEN 1 ELSE 0 END AS transaction_count,
          avg_amount, f AS found_in
        FROM daily, (VALUES ('first'), ('second')) v(f) WHERE category = 'SMALL'""",
    "monthly_summary_recompute": f"""{_W_MARTS}
        SELECT month, account_id, currency, total_debits, total_credits, net_flow,
          transaction_count + CASE WHEN f = 'first' THEN 1 ELSE 0 END AS transaction_count,
          f AS found_in
        FROM monthly, (VALUES ('first'), ('second')) v(f)
        WHERE CAST(substr(account_id, 5) AS BIGINT) % 50 = 0""",
    "table_profile": f"""{_W_CATALOG}
        SELECT table_name, 'main' AS table_schema, table_type,
          CASE WHEN table_name = 'orders' THEN 'mart' ELSE zone END AS zone, row_count, column_count
        FROM catalog""",
    "column_profile": _COLUMN_PROFILE,
    "zone_infer": f"""{_W_SRC},
        names AS (SELECT DISTINCT concat(a, lower(category), b) AS table_name
          FROM src, (VALUES ('stg_'), ('dim_'), ('fct_'), ('catalog_'), ('')) p(a),
            (VALUES ('_runs'), ('_results'), ('')) s(b))
        SELECT table_name, CASE WHEN starts_with(table_name, 'stg_') THEN 'staging'
          WHEN starts_with(table_name, 'dim_') THEN 'dimension'
          WHEN starts_with(table_name, 'fct_') THEN 'fact'
          WHEN table_name IN ('transactions', 'quarantine') THEN 'raw'
          WHEN ends_with(table_name, '_runs') OR ends_with(table_name, '_results') THEN 'metadata'
          WHEN starts_with(table_name, 'catalog_') THEN 'metadata' ELSE 'mart' END AS zone
        FROM names""",
    "catalog_overlay": f"{_W_CATALOG} SELECT *, 'main' AS table_schema FROM catalog",
    "catalog_tables_report": f"""{_W_CATALOG}
        SELECT table_name, table_type, zone, description, row_count, column_count,
          coalesce(depends_on, '') AS depends_on FROM catalog""",
    "zone_rollup": f"""{_W_CATALOG} SELECT zone, COUNT(*) AS table_count,
          CAST(SUM(coalesce(row_count, 0)) AS BIGINT) AS total_rows,
          CAST(SUM(column_count) AS BIGINT) AS total_columns FROM catalog GROUP BY zone""",
    "catalog_columns_report": f"""WITH c AS ({_COLUMN_REPORT})
        SELECT table_name, CASE table_name WHEN 'stg_transactions' THEN 'staging' WHEN 'orders' THEN 'raw'
          WHEN 'dim_accounts' THEN 'dimension' ELSE 'mart' END AS zone,
          column_name, data_type, is_nullable, is_pk,
          CASE WHEN is_pk THEN 'Order and line number.' ELSE '' END AS description,
          coalesce(sample_values, '') AS sample_values FROM c""",
    "column_name_policy": f"""WITH c AS ({_COLUMN_REPORT})
        SELECT table_name, column_name FROM c
        WHERE regexp_matches(lower(column_name), 'name|email|phone|ssn|dob|birth|address|social')""",
    "catalog_built": f"""{_W_MARTS}, built AS (
          SELECT 'transactions' AS table_name, 'BASE TABLE' AS table_type, 'raw' AS zone,
            (SELECT COUNT(*) FROM src) AS row_count, 13 AS column_count
          UNION ALL SELECT 'stg_transactions', 'VIEW', 'staging', NULL, 13
          UNION ALL SELECT 'daily_spend_by_category', 'BASE TABLE', 'mart', (SELECT COUNT(*) FROM daily), 6
          UNION ALL SELECT 'monthly_account_summary', 'BASE TABLE', 'mart', (SELECT COUNT(*) FROM monthly), 7
          UNION ALL SELECT 'quarantine', 'BASE TABLE', 'raw',
            (SELECT COUNT(*) FROM src WHERE currency IS NULL), 6)
        SELECT *, TIMESTAMP '2003-01-01' AS last_built_at FROM built""",
    "run_timeline": f"""{_W_RUNS}
        SELECT 'ingestion' AS run_type, run_id, started_at, status,
          records_loaded || ' records' AS key_metric, ROUND(elapsed_seconds, 2) AS elapsed_seconds
        FROM ingestion_runs
        UNION ALL SELECT 'transform', run_id, started_at, status, models_executed || ' models',
          ROUND(elapsed_seconds, 2) FROM transform_runs
        UNION ALL SELECT 'check', run_id, started_at, status,
          checks_passed || '/' || total_checks || ' passed', ROUND(elapsed_seconds, 2)
        FROM check_runs""",
    "latest_ingestion": f"""{_W_RUNS} SELECT run_id, started_at, status, records_loaded,
          records_quarantined, duplicates_skipped, elapsed_seconds
        FROM ingestion_runs ORDER BY started_at DESC, run_id LIMIT 1""",
    "latest_transform": f"""{_W_RUNS} SELECT status, models_executed, started_at
        FROM transform_runs ORDER BY started_at DESC, run_id LIMIT 1""",
    "latest_check": f"""{_W_RUNS} SELECT run_id, started_at, status, total_checks, checks_passed,
          checks_failed, checks_errored, ROUND(elapsed_seconds, 2) AS elapsed_seconds
        FROM check_runs ORDER BY started_at DESC, run_id LIMIT 1""",
    "ingestion_history": f"""{_W_RUNS} SELECT run_id, started_at, status, files_processed,
          records_loaded, records_quarantined, duplicates_skipped,
          ROUND(elapsed_seconds, 2) AS elapsed_seconds FROM ingestion_runs""",
    "records_trend": f"""{_W_RUNS} SELECT started_at, records_loaded, records_quarantined,
          duplicates_skipped FROM ingestion_runs""",
    "latest_check_results": f"""{_W_RUNS}
        SELECT check_name, severity, status, violation_count, description FROM check_results
        WHERE run_id = (SELECT run_id FROM check_runs ORDER BY started_at DESC, run_id LIMIT 1)""",
    "check_outcomes": f"""{_W_RUNS} SELECT started_at, checks_passed, checks_failed, checks_errored
        FROM check_runs""",
    "all_check_results": f"""{_W_RUNS} SELECT run_id, check_name, severity, status, violation_count,
          ROUND(elapsed_seconds, 4) AS elapsed_seconds FROM check_results""",
    "schema_audit": _schema_audit(),
    "landing_listing": " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS file_path, true AS same_hash, "
        f"(SELECT COUNT(*) FROM (DESCRIBE {name})) > 0 AS same_size" for name in _FILES
    ),
    "manifest_pending": f"SELECT file_path FROM ({_schema_audit()}) WHERE error IS NOT NULL",
    "manifest_states": f"""{_W_FILES}
        SELECT 'first' AS step, file_path, n AS file_size_bytes,
          CASE WHEN y = 1996 THEN 'failed' ELSE 'success' END AS status, 'run-1' AS run_id,
          CASE WHEN y = 1996 THEN 'damaged' END AS error_message FROM files WHERE y < 1999
        UNION ALL SELECT 'second', file_path, n + CASE WHEN y = 1997 THEN 1 ELSE 0 END, 'success',
          CASE WHEN y IN (1997, 1996) OR y >= 1999 THEN 'run-2' ELSE 'run-1' END, NULL FROM files
        UNION ALL SELECT 'reset', file_path, n + CASE WHEN y = 1997 THEN 1 ELSE 0 END, 'pending', 'run-3', NULL
        FROM files""",
    "manifest_pending_modes": f"""{_W_FILES},
        mark AS (SELECT MAX(mtime) AS m FROM files WHERE y < 1999 AND y <> 1996)
        SELECT mode, file_path FROM files, (VALUES ('hash'), ('stat'), ('watermark'), ('full_refresh')) v(mode)
        WHERE mode = 'full_refresh' OR (mode IN ('hash', 'stat') AND (y IN (1997, 1996) OR y >= 1999))
          OR (mode = 'watermark' AND mtime > (SELECT m FROM mark))""",
    "watermark_steps": f"""{_W_FILES},
        steps AS (
          SELECT 'first' AS step, (SELECT MAX(mtime) FROM files WHERE y < 1999 AND y <> 1996) AS m
          UNION ALL SELECT 'second', (SELECT MAX(mtime) FROM files)
          UNION ALL SELECT 'nothing read', (SELECT MAX(mtime) FROM files)
          UNION ALL SELECT 'only 1997', (SELECT mtime FROM files WHERE y = 1997))
        SELECT step, 'landing' AS source_dir, m AS watermark_mtime FROM steps""",
    "audit_rows": f"""{_W_FIRST}
        SELECT run_id, TIMESTAMP '2003-01-01' AS started_at, 'completed' AS status,
          CASE WHEN run_id = 'run-1' THEN (SELECT COUNT(*) FROM firsts) ELSE 0 END AS records_loaded,
          CASE WHEN run_id = 'run-1' THEN (SELECT COUNT(*) FROM invalid) ELSE 0 END AS records_quarantined,
          CASE WHEN run_id = 'run-1' THEN (SELECT COUNT(*) FROM valid) - (SELECT COUNT(*) FROM firsts)
               ELSE 0 END AS duplicates_skipped,
          true AS files_add_up, true AS has_ended
        FROM (VALUES ('run-1'), ('run-2')) v(run_id)""",
    "own_run_timeline": f"""{_W_SUITE}, {_DIRTY.strip()}, {_FIRST.strip()}
        SELECT 'ingestion' AS run_type, 'run-1' AS run_id, 'completed' AS status,
          (SELECT COUNT(*) FROM firsts) || ' records' AS key_metric
        UNION ALL SELECT 'transform', 'models-1', 'completed', '2 models'
        UNION ALL SELECT 'check', 'check-1',
          CASE WHEN COUNT(*) FILTER (WHERE status = 'fail' AND severity = 'critical') > 0 THEN 'failed'
               WHEN COUNT(*) FILTER (WHERE status = 'fail') > 0 THEN 'warn' ELSE 'passed' END,
          COUNT(*) FILTER (WHERE status = 'pass') || '/' || COUNT(*) || ' passed' FROM rated""",
    "month_slice": f"""{_W_SRC} SELECT transaction_id, transaction_date, run_id FROM src
        WHERE transaction_date BETWEEN DATE '1997-02-15' AND DATE '1997-04-02'""",
    "table_replaced": f"{_W_MARTS} SELECT * FROM daily WHERE transaction_count > 1",
    "table_order": f"{_W_MARTS} SELECT transaction_date, category, currency, true AS in_order FROM daily",
    "check_samples": f"""{_W_ALL},
        unknown AS (SELECT transaction_id, currency FROM src WHERE currency NOT IN ('USD', 'EUR', 'GBP', 'JPY')),
        twice AS (SELECT transaction_id, COUNT(*) AS n FROM fct GROUP BY 1 HAVING COUNT(*) > 1)
        SELECT 'accepted_values_currency' AS check_name, (SELECT COUNT(*) FROM unknown) AS violation_count,
          (SELECT '[' || string_agg('{{"transaction_id":"' || transaction_id || '","currency":"' || currency || '"}}',
             ',' ORDER BY transaction_id, currency) || ']'
           FROM (SELECT * FROM unknown ORDER BY transaction_id, currency LIMIT 5)) AS sample_violations
        UNION ALL SELECT 'fct_unique_transaction_id', (SELECT COUNT(*) FROM twice),
          (SELECT '[' || string_agg('{{"transaction_id":"' || transaction_id || '","occurrence_count":"' || n || '"}}',
             ',' ORDER BY transaction_id) || ']' FROM (SELECT * FROM twice ORDER BY transaction_id LIMIT 5))
        UNION ALL SELECT 'unique_daily_spend_grain', 0, NULL""",
    "ingest_pipeline": f"{_W_FIRST} {_PIPELINE}",
    "ingest_pipeline_quarantine": f"""{_W_DIRTY}
        SELECT row_number() OVER (ORDER BY {_ORDER_NULLS}) AS quarantine_id,
          {_RECORD} AS record_data, reason AS rejection_reason, 'run-1' AS run_id FROM invalid""",
    "stream_ingest": f"{_W_FIRST} {_PIPELINE}",
    "stream_daily_spend": f"{_W_MARTS} SELECT * FROM daily",
    "stream_dedup": f"{_W_SRC} SELECT DISTINCT transaction_id FROM src",
    "export_csv": f"{_W_SRC} SELECT {_LANDED} FROM src",
    "export_parquet": f"{_W_SRC} SELECT {_LANDED} FROM src",
}
