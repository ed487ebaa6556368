"""The same queries in SQL, for the correctness check: ``name -> SQL``."""

from __future__ import annotations

from quaestor import constants as C

ORACLES: dict[str, str] = {}

_STATUS = "CASE WHEN upper(status) IN ('COMPLETED', 'SETTLED', 'OK') THEN 'SUCCESS' ELSE 'FAILED' END"

_FEED_A = """
feed AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS txn_id,
         'acc' || o_custkey AS account_id, o_orderdate AS txn_date, l_shipdate AS ingestion_date,
         l_extendedprice AS amount, 'EUR' AS currency,
         CASE l_returnflag WHEN 'R' THEN 'REFUND' WHEN 'A' THEN 'CARD' WHEN 'N' THEN 'TRANSFER' END AS txn_type,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SETTLED' WHEN 'P' THEN 'PENDING' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

_FEED_B = """
feed AS (
  SELECT 'e' || event_id AS txn_id, 'acc' || user_id AS account_id, ts AS txn_date,
         CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS TIMESTAMP) AS ingestion_date,
         CASE WHEN event_type = 'signup' THEN -(round(value) * 100) ELSE round(value) * 100 END AS amount,
         'EUR' AS currency,
         CASE event_type WHEN 'purchase' THEN 'CARD' WHEN 'error' THEN 'refund' WHEN 'click' THEN 'TRANSFER'
              WHEN 'view' THEN 'DEPOSIT' WHEN 'signup' THEN 'PAYMENT' END AS txn_type,
         CASE event_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'settled' WHEN 2 THEN 'OK'
              WHEN 3 THEN 'PENDING' ELSE 'FAILED' END AS status,
         value, user_id
  FROM events)
"""

_CLEAN = f"""
clean AS (
  SELECT txn_id, account_id, txn_date, CAST(CAST(ingestion_date AS DATE) AS TIMESTAMP) AS ingestion_date,
         amount, currency, txn_type, status,
         {_STATUS} AS status_clean,
         CASE WHEN upper(txn_type) = 'REFUND' THEN -abs(amount) ELSE amount END AS amount_clean,
         date_diff('day', CAST(txn_date AS DATE), CAST(ingestion_date AS DATE)) > 0 AS is_late
  FROM feed),
ledger AS (
  SELECT txn_id, account_id, txn_date, ingestion_date, amount_clean AS amount, currency, txn_type, is_late
  FROM clean WHERE status_clean = 'SUCCESS')
"""

_DIRTY = f"""
{_FEED_B},
dirty AS (
  SELECT CASE WHEN value < 0.3 THEN NULL WHEN value > 150 THEN 'e' || user_id ELSE txn_id END AS txn_id,
         CASE WHEN value BETWEEN 1 AND 1.5 THEN NULL ELSE account_id END AS account_id,
         CASE WHEN value BETWEEN 2 AND 2.5 THEN NULL ELSE txn_date END AS txn_date,
         ingestion_date,
         CASE WHEN value BETWEEN 3 AND 3.5 OR value BETWEEN 4 AND 4.5 OR value BETWEEN 7 AND 7.5 THEN NULL
              ELSE amount END AS amount,
         value BETWEEN 3 AND 3.5 OR value BETWEEN 7 AND 7.5 AS bad_amount, value BETWEEN 7 AND 7.5 AS huge_amount,
         currency,
         CASE WHEN value BETWEEN 100 AND 105 THEN 'crypto' WHEN value BETWEEN 5 AND 5.5 THEN NULL
              ELSE txn_type END AS txn_type,
         CASE WHEN value BETWEEN 6 AND 6.5 THEN NULL ELSE status END AS status
  FROM feed),
clean AS (
  SELECT *, {_STATUS} AS status_clean,
         CASE WHEN upper(txn_type) = 'REFUND' THEN -abs(coalesce(amount, 0.0)) ELSE coalesce(amount, 0.0) END
           AS amount_clean,
         coalesce(date_diff('day', CAST(txn_date AS DATE), CAST(ingestion_date AS DATE)) > 0, FALSE) AS is_late
  FROM dirty),
ledger AS (
  SELECT txn_id, account_id, txn_date, ingestion_date, amount_clean AS amount, currency, txn_type, is_late
  FROM clean WHERE status_clean = 'SUCCESS')
"""

_A = f"WITH {_FEED_A}, {_CLEAN}"
_B = f"WITH {_FEED_B}, {_CLEAN}"
_D = f"WITH {_DIRTY}"

_LEDGER_LIST = ", ".join(C.LEDGER_COLUMNS)
_VALID = ", ".join(f"'{t}'" for t in C.VALID_TXN_TYPES)


def _money(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,10))) AS DOUBLE)"


# --- Sources, validation, transformation --------------------------------------------------------

ORACLES["csv_scan"] = f"""{_B} SELECT txn_id, account_id, txn_date, ingestion_date, amount, currency, txn_type,
status FROM clean"""
ORACLES["ledger_scan"] = f"{_B} SELECT {_LEDGER_LIST} FROM ledger"
ORACLES["duplicate_txn_ids"] = f"""{_D} SELECT txn_id, count(*) AS occurrences FROM dirty GROUP BY txn_id
HAVING count(*) > 1"""
ORACLES["null_counts"] = f"""{_D} SELECT count(*) FILTER (account_id IS NULL) AS account_id_nulls,
count(*) FILTER (status IS NULL) AS status_nulls, count(*) FILTER (txn_type IS NULL) AS txn_type_nulls FROM dirty"""
ORACLES["invalid_txn_types"] = f"""{_D} SELECT txn_type, count(*) AS occurrences FROM dirty
WHERE upper(txn_type) NOT IN ({_VALID}) GROUP BY txn_type"""
ORACLES["unreadable_dates"] = f"""{_D} SELECT count(*) FILTER (txn_date IS NULL) AS txn_date_unreadable,
count(*) FILTER (ingestion_date IS NULL) AS ingestion_date_unreadable FROM dirty"""
ORACLES["amount_parse_failures"] = f"{_D} SELECT count(*) FILTER (bad_amount) AS amount_unreadable FROM dirty"
ORACLES["validation_violations"] = f"""{_D}
SELECT txn_id, 'duplicate_id' AS "check", CAST(count(*) AS VARCHAR) AS detail FROM dirty
GROUP BY txn_id HAVING count(*) > 1
UNION ALL SELECT txn_id, 'not_null', 'account_id' FROM dirty WHERE account_id IS NULL
UNION ALL SELECT txn_id, 'not_null', 'status' FROM dirty WHERE status IS NULL
UNION ALL SELECT txn_id, 'not_null', 'txn_type' FROM dirty WHERE txn_type IS NULL
UNION ALL SELECT txn_id, 'txn_type', txn_type FROM dirty WHERE upper(txn_type) NOT IN ({_VALID})"""
ORACLES["ledger_null_ids"] = f"{_D} SELECT count(*) FILTER (txn_id IS NULL) AS txn_id_nulls FROM ledger"
ORACLES["ledger_duplicate_ids"] = f"""{_D} SELECT txn_id, count(*) AS occurrences FROM ledger GROUP BY txn_id
HAVING count(*) > 1"""
ORACLES["parse_dates"] = f"{_D} SELECT txn_id, txn_date, ingestion_date FROM dirty"
ORACLES["normalize_status"] = f"{_D} SELECT txn_id, status, status_clean FROM clean"
ORACLES["normalize_amount"] = f"{_D} SELECT txn_id, txn_type, amount_clean FROM clean"
ORACLES["late_arrivals"] = f"{_A} SELECT txn_id, is_late FROM clean"
ORACLES["late_arrivals_threshold"] = f"""{_A} SELECT txn_id,
date_diff('day', CAST(txn_date AS DATE), CAST(ingestion_date AS DATE)) > 30 AS is_late FROM clean"""
ORACLES["transform_clean"] = f"{_B} SELECT * FROM clean"
ORACLES["ledger"] = f"{_B} SELECT {_LEDGER_LIST} FROM ledger"

# --- Reconciliation and balances ----------------------------------------------------------------

_RAW = f"""SELECT txn_date, {_money('amount_clean')} AS raw_total FROM clean
WHERE status_clean = 'SUCCESS' GROUP BY txn_date"""
_LEDGER = f"SELECT txn_date, {_money('amount')} AS ledger_total FROM ledger GROUP BY txn_date"


def _recon(date: str, ledger_amount: str) -> str:
    return f"""
r AS (SELECT {date} AS txn_date, sum(CAST(amount_clean AS DECIMAL(28,10))) AS raw_total FROM clean
      WHERE status_clean = 'SUCCESS' GROUP BY 1),
l AS (SELECT {date} AS txn_date, sum(CAST({ledger_amount} AS DECIMAL(28,10))) AS ledger_total FROM ledger GROUP BY 1),
recon AS (SELECT txn_date, coalesce(raw_total, 0) AS raw_total, coalesce(ledger_total, 0) AS ledger_total,
                 coalesce(raw_total, 0) - coalesce(ledger_total, 0) AS diff
          FROM r FULL OUTER JOIN l USING (txn_date))
"""


_RECON_COLUMNS = """SELECT txn_date, CAST(raw_total AS DOUBLE) AS raw_total,
CAST(ledger_total AS DOUBLE) AS ledger_total, CAST(diff AS DOUBLE) AS diff FROM recon"""
_TAMPERED = "CASE WHEN amount > 100000 THEN amount + 10 ELSE amount END"

ORACLES["recon_raw_totals"] = f"{_A} {_RAW}"
ORACLES["recon_ledger_totals"] = f"{_A} {_LEDGER}"
ORACLES["reconciliation"] = f"{_A}, {_recon('txn_date', 'amount')} {_RECON_COLUMNS}"
ORACLES["reconciliation_by_day"] = (
    f"{_B}, {_recon('CAST(CAST(txn_date AS DATE) AS TIMESTAMP)', 'amount')} {_RECON_COLUMNS}"
)
ORACLES["recon_mismatches"] = f"{_A}, {_recon('txn_date', _TAMPERED)} {_RECON_COLUMNS} WHERE abs(diff) > 0.01"
ORACLES["recon_summary"] = f"""{_A}, {_recon('txn_date', _TAMPERED)}
SELECT count(*) AS dates_compared, CAST(max(abs(diff)) AS DOUBLE) AS max_abs_diff FROM recon"""
_NUMBER = "CAST(substr(txn_id, 2) AS BIGINT)"
ORACLES["recon_offending_rows"] = f"""{_B},
damaged AS (
  SELECT txn_date, txn_id, amount + CASE WHEN {_NUMBER} % 89 = 4 THEN 10 ELSE 0 END AS amount FROM ledger
  WHERE {_NUMBER} % 97 <> 1
  UNION ALL SELECT txn_date, txn_id, amount FROM ledger WHERE {_NUMBER} % 101 = 2
  UNION ALL SELECT txn_date, 'x' || txn_id, amount FROM ledger WHERE {_NUMBER} % 103 = 3),
l AS (SELECT txn_date, txn_id, count(*) AS n, sum(CAST(amount AS DECIMAL(28,10))) AS total FROM ledger GROUP BY ALL),
r AS (SELECT txn_date, txn_id, count(*) AS n, sum(CAST(amount AS DECIMAL(28,10))) AS total FROM damaged GROUP BY ALL)
SELECT txn_date, txn_id, CASE WHEN r.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' ELSE 'changed' END AS kind,
       coalesce(l.n, 0) AS raw_rows, coalesce(r.n, 0) AS ledger_rows,
       CAST(l.total AS DOUBLE) AS raw_amount, CAST(r.total AS DOUBLE) AS ledger_amount
FROM l FULL JOIN r USING (txn_date, txn_id)
WHERE l.n IS DISTINCT FROM r.n OR l.total IS DISTINCT FROM r.total"""
ORACLES["ledger_as_of"] = f"""{_B} SELECT {_LEDGER_LIST} FROM ledger WHERE NOT is_late"""
_BALANCE = f"""SELECT account_id, txn_date, {_money('amount')} AS total_amount, count(txn_id) AS txn_count
FROM ledger GROUP BY account_id, txn_date"""
ORACLES["daily_balance"] = f"{_A} {_BALANCE}"
ORACLES["daily_balance_sql"] = f"{_A} {_BALANCE}"
ORACLES["staged_balance"] = f"{_B} {_BALANCE}"
ORACLES["balance_by_currency"] = f"""{_A} SELECT currency, txn_type, {_money('amount')} AS total,
count(txn_id) AS transactions FROM ledger GROUP BY currency, txn_type"""

# --- Quality ------------------------------------------------------------------------------------

ORACLES["quality_row_counts"] = f"""{_A} SELECT (SELECT count(*) FROM feed) AS raw_total,
(SELECT count(*) FROM clean) AS transformed_total, (SELECT count(*) FROM ledger) AS ledger_total,
(SELECT count(*) FROM clean) - (SELECT count(*) FROM ledger) AS skipped_total"""
ORACLES["quality_status"] = f"{_A} SELECT status_clean, count(*) AS row_count FROM clean GROUP BY status_clean"
ORACLES["quality_failure_rate"] = f"""{_A} SELECT count(*) FILTER (status_clean <> 'SUCCESS') AS total_failed,
count(*) FILTER (status_clean <> 'SUCCESS') / count(*) AS failure_rate FROM clean"""
ORACLES["quality_nulls"] = f"""{_D} SELECT count(*) FILTER (txn_id IS NULL) AS txn_id_missing,
count(*) FILTER (account_id IS NULL) AS account_id_missing, count(*) FILTER (txn_date IS NULL) AS txn_date_missing,
count(*) FILTER (amount_clean IS NULL) AS amount_clean_missing FROM clean"""
_DUPLICATES = "count(*) - count(DISTINCT txn_id) - CAST(bool_or(txn_id IS NULL) AS INTEGER)"
ORACLES["quality_duplicates"] = f"{_D} SELECT CAST({_DUPLICATES} AS BIGINT) AS duplicate_txn_ids FROM clean"
ORACLES["quality_late"] = f"{_A} SELECT count(*) FILTER (is_late) AS late_arrivals FROM clean"
_STATS = """count(amount_clean) AS count,
round(CAST(sum(CAST(amount_clean AS DECIMAL(28,10))) AS DOUBLE) / count(amount_clean), 4) AS mean,
round(stddev_samp(amount_clean), 4) AS std, min(amount_clean) AS min,
round(quantile_cont(amount_clean, 0.25), 4) AS p25, round(quantile_cont(amount_clean, 0.5), 4) AS p50,
round(quantile_cont(amount_clean, 0.75), 4) AS p75, max(amount_clean) AS max"""
ORACLES["quality_amount_stats"] = f"{_A} SELECT {_STATS} FROM clean"
_OUTLIERS = """(SELECT count(*) FROM clean, (SELECT avg(amount_clean) AS m, stddev_samp(amount_clean) AS s FROM clean)
WHERE abs(amount_clean - m) > 3 * s) AS amount_outliers"""
ORACLES["quality_outliers"] = f"{_B} SELECT {_OUTLIERS}"
ORACLES["rejection_report"] = f"""{_A} SELECT status_clean, count(txn_id) AS txn_id_count,
count(DISTINCT account_id) AS account_id_nunique, round_even({_money('amount_clean')}, 2) AS amount_clean_sum,
round_even({_money('amount_clean')} / count(amount_clean), 2) AS amount_clean_mean
FROM clean WHERE status_clean <> 'SUCCESS' GROUP BY status_clean"""
ORACLES["quality_metrics"] = f"""{_B} SELECT (SELECT count(*) FROM feed) AS raw_total, count(*) AS transformed_total,
(SELECT count(*) FROM ledger) AS ledger_total, count(*) - (SELECT count(*) FROM ledger) AS skipped_total,
count(*) FILTER (status_clean = 'SUCCESS') AS success_rows, count(*) FILTER (status_clean = 'FAILED') AS failed_rows,
count(*) FILTER (status_clean <> 'SUCCESS') AS total_failed,
count(*) FILTER (status_clean <> 'SUCCESS') / count(*) AS failure_rate,
count(*) FILTER (txn_id IS NULL) AS txn_id_missing, count(*) FILTER (account_id IS NULL) AS account_id_missing,
count(*) FILTER (txn_date IS NULL) AS txn_date_missing, count(*) FILTER (amount_clean IS NULL) AS amount_clean_missing,
CAST({_DUPLICATES} AS BIGINT) AS duplicate_txn_ids, count(*) FILTER (is_late) AS late_arrivals,
{_STATS}, {_OUTLIERS} FROM clean"""

# --- AML ----------------------------------------------------------------------------------------


def _row_window(n: int, label: str, alias: str = "") -> str:
    over = (
        "OVER (PARTITION BY account_id ORDER BY txn_date, txn_id "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )
    total = f"CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) {over} AS DOUBLE)"
    return (
        f"count(txn_id) {over} AS txn_count_{label}, {total} AS amount_sum_{label}, "
        f"round({total} / count(amount) {over}, 6) AS amount_avg_{label}"
    )


def _day_window(n: int, label: str) -> str:
    over = (
        "OVER (PARTITION BY account_id ORDER BY CAST(txn_date AS DATE) "
        f"RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
    )
    total = f"CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) {over} AS DOUBLE)"
    return (
        f"count(txn_id) {over} AS txn_count_{label}, {total} AS amount_sum_{label}, "
        f"round({total} / count(amount) {over}, 6) AS amount_avg_{label}"
    )


_ROWS_3 = ", ".join(_row_window(n, f"{n}d") for n in (1, 7, 30))
_DAYS_3 = ", ".join(_day_window(n, f"{n}d") for n in (1, 7, 30))
_NEAR = "abs(amount) BETWEEN 10000 * 0.9 AND 10000 * 0.99"
_ROUND = "abs(amount) IN (10000, 5000, 1000, 500)"
_NEAR_TXNS = f"""CAST(count(*) FILTER ({_NEAR}) OVER (PARTITION BY account_id ORDER BY CAST(txn_date AS DATE)
RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS near_threshold_txns"""

ORACLES["velocity_rows"] = f"{_A} SELECT txn_id, {_ROWS_3} FROM ledger"
ORACLES["velocity_rows_sliced"] = ORACLES["velocity_rows"]
ORACLES["velocity_custom"] = f"{_B} SELECT txn_id, {_row_window(3, '3d')}, {_row_window(14, '14d')} FROM ledger"
ORACLES["velocity_days"] = f"{_A} SELECT txn_id, {_DAYS_3} FROM ledger"
_TIME = """CAST(hour(txn_date) AS INTEGER) AS hour_of_day, CAST(isodow(txn_date) - 1 AS INTEGER) AS day_of_week,
isodow(txn_date) >= 6 AS is_weekend, hour(txn_date) < 5 AS is_late_night"""
ORACLES["time_features"] = f"{_B} SELECT txn_id, {_TIME} FROM ledger"
_STRUCTURING = f"{_NEAR} AS is_near_threshold, round_even(abs(amount) / 10000 * 100, 2) AS pct_of_threshold"
ORACLES["structuring_features"] = f"{_B} SELECT txn_id, {_STRUCTURING} FROM ledger"
_ROUND_COLUMNS = f"{_ROUND} AS is_large_round, CASE WHEN {_ROUND} THEN abs(amount) END AS round_number_match"
ORACLES["round_number_features"] = f"{_B} SELECT txn_id, {_ROUND_COLUMNS} FROM ledger"
ORACLES["structuring_pattern"] = f"{_B} SELECT txn_id, {_NEAR} AS is_near_threshold, {_NEAR_TXNS} FROM ledger"
ORACLES["aml_features"] = f"{_B} SELECT *, {_ROWS_3}, {_TIME}, {_STRUCTURING}, {_ROUND_COLUMNS} FROM ledger"


def _scored(velocity: str, structuring: str) -> str:
    """Features, flags, score and severity as one more common table each."""
    return f"""
featured AS (SELECT *, {velocity}, {_TIME}, {_STRUCTURING}, {_ROUND_COLUMNS}, {_NEAR_TXNS} FROM ledger),
flagged AS (SELECT *, txn_count_1d > 5 AS rule_velocity_count_flag,
                   amount_sum_1d > 30000 AS rule_velocity_daily_amount_flag,
                   amount_sum_7d > 60000 AS rule_velocity_7d_amount_flag,
                   {structuring} AS rule_structuring_flag, is_large_round AS rule_round_number_flag FROM featured),
risked AS (SELECT *, CAST(least(100, 25 * CAST(rule_velocity_count_flag AS INTEGER)
                   + 30 * CAST(rule_velocity_daily_amount_flag AS INTEGER)
                   + 35 * CAST(rule_velocity_7d_amount_flag AS INTEGER)
                   + 50 * CAST(rule_structuring_flag AS INTEGER)
                   + 15 * CAST(rule_round_number_flag AS INTEGER)) AS DOUBLE) AS risk_score FROM flagged),
scored AS (SELECT *, CASE WHEN risk_score >= 75 THEN 'high' WHEN risk_score >= 50 THEN 'medium'
                          WHEN risk_score >= 25 THEN 'low' ELSE 'none' END AS severity,
                  risk_score >= 25 AS is_alert FROM risked)
"""


_FLAGS = ", ".join(flag for flag, _ in C.AML_RULES.values())
_S = f"{_B}, {_scored(_ROWS_3, 'is_near_threshold')}"
_SD = f"{_B}, {_scored(_DAYS_3, 'is_near_threshold AND near_threshold_txns >= 2')}"

ORACLES["rule_flags"] = f"{_S} SELECT txn_id, {_FLAGS} FROM scored"
ORACLES["risk_score"] = f"{_S} SELECT txn_id, risk_score FROM scored"
ORACLES["severity"] = f"{_S} SELECT txn_id, severity, is_alert FROM scored"
ORACLES["aml_scored"] = f"{_S} SELECT * EXCLUDE (near_threshold_txns) FROM scored"
ORACLES["aml_scored_incremental"] = ORACLES["aml_scored"]
ORACLES["aml_scored_days"] = f"{_SD} SELECT txn_id, {_FLAGS}, risk_score, severity, is_alert FROM scored"
ORACLES["aml_metrics"] = f"""{_S} SELECT count(*) AS total_transactions, count(*) FILTER (is_alert) AS alert_transactions,
{', '.join(f"count(*) FILTER (severity = '{s}') AS {s}_severity" for s in ('high', 'medium', 'low'))},
{', '.join(f'count(*) FILTER ({flag}) AS {rule}_triggers' for rule, (flag, _) in C.AML_RULES.items())} FROM scored"""

_HITS = "hits AS (" + " UNION ALL ".join(
    f"""SELECT account_id, CAST(txn_date AS DATE) AS alert_date, '{rule}' AS rule_id, '{name}' AS rule_name,
txn_id, abs(amount) AS magnitude, risk_score, severity FROM scored WHERE is_alert AND {flag}"""
    for rule, (flag, name) in C.AML_RULES.items()
) + ")"
_ALERTS = f"""{_HITS}, alerts AS (
SELECT account_id, alert_date, rule_id, rule_name, arg_max(severity, risk_score) AS severity,
       max(risk_score) AS risk_score, count(*) AS triggering_txn_count,
       CAST(sum(CAST(magnitude AS DECIMAL(28,2))) AS DOUBLE) AS triggering_amount_sum,
       rule_name || ': ' || count(*) || ' transactions totaling '
         || format('{{:,.2f}}', CAST(sum(CAST(magnitude AS DECIMAL(28,2))) AS DOUBLE)) AS description,
       'open' AS status, string_agg(txn_id, ',' ORDER BY txn_id) AS triggering_txn_ids
FROM hits GROUP BY account_id, alert_date, rule_id, rule_name)"""
ORACLES["aml_alerts"] = f"{_S}, {_ALERTS} SELECT * FROM alerts"
_PARTED = """parted AS (SELECT account_id, alert_date, rule_id, txn_id,
CAST(CAST('0x' || substr(md5(txn_id), 1, 15) AS BIGINT)
  % CAST(ceil(count(*) OVER (PARTITION BY account_id, alert_date, rule_id) / 3.0) AS BIGINT) AS INTEGER) AS ids_part
FROM hits)"""
ORACLES["aml_alert_id_parts"] = f"""{_S}, {_HITS}, {_PARTED} SELECT account_id, alert_date, rule_id, ids_part,
string_agg(txn_id, ',' ORDER BY txn_id) AS triggering_txn_ids FROM parted GROUP BY ALL"""
ORACLES["aml_alerts_days"] = f"{_SD}, {_ALERTS} SELECT * EXCLUDE (triggering_txn_ids) FROM alerts"
ORACLES["aml_alert_numbers"] = f"""{_S}, {_ALERTS}
SELECT 'AML-20240201063000-' || lpad(CAST(row_number() OVER (ORDER BY account_id, alert_date, rule_id) AS VARCHAR), 6, '0')
         AS alert_id, '2024-02-01T06:30:00' AS alert_timestamp, account_id, rule_id, triggering_txn_count, description,
       status FROM alerts"""
ORACLES["aml_alert_transactions"] = f"{_S}, {_HITS} SELECT account_id, alert_date, rule_id, txn_id FROM hits"
ORACLES["aml_alerts_by_severity"] = f"""{_S}, {_ALERTS} SELECT severity, count(*) AS alert_count,
CAST(sum(triggering_txn_count) AS BIGINT) AS txn_count, count(DISTINCT account_id) AS account_count
FROM alerts GROUP BY severity"""

# --- Contracts ----------------------------------------------------------------------------------


def _found(kind: str, column: str, count: str, message: str, severity: str = "error") -> str:
    return f"""SELECT '{kind}' AS constraint_type, '{column}' AS column_name, {message} AS message,
'{severity}' AS severity, CAST(n AS BIGINT) AS violation_count FROM (SELECT {count} AS n FROM dirty) WHERE n > 0"""


def _nulls(column: str) -> str:
    return _found(
        "not_null", column, f"count(*) FILTER ({column} IS NULL)", f"'''{column}'' is empty in ' || n || ' rows'"
    )


_BAD = {
    "txn_type": "txn_type NOT IN ('CARD', 'TRANSFER', 'DEPOSIT', 'PAYMENT')",
    "status": "status NOT IN ('COMPLETED', 'settled', 'OK', 'PENDING')",
}
_C_UNIQUE = _found("unique", "txn_id", _DUPLICATES, "n || ' rows repeat a value of ''txn_id'''")
_C_LOW = _found("range", "amount", "count(*) FILTER (amount < -20000)", "n || ' rows lie under the floor of -20000.0'")
_C_HIGH = _found("range", "amount", "count(*) FILTER (amount > 20000 OR huge_amount)", "n || ' rows lie over the ceiling of 20000.0'")
_C_REGEX = _found(
    "regex",
    "txn_id",
    "count(*) FILTER (NOT regexp_matches(txn_id, '^e[0-9]{3,}$'))",
    "n || ' values of ''txn_id'' do not match ^e[0-9]{3,}$'",
)
_C_SHORT = """SELECT 'custom' AS constraint_type, '*' AS column_name,
count(*) || ' rows, at least 100000000000 expected' AS message, 'error' AS severity,
100000000000 - count(*) AS violation_count FROM dirty"""
_C_LONG = """SELECT 'custom' AS constraint_type, '*' AS column_name,
count(*) || ' rows, at most 100 expected' AS message, 'error' AS severity,
count(*) - 100 AS violation_count FROM dirty HAVING count(*) > 100"""
_C_MISSING = """SELECT 'not_null' AS constraint_type, 'branch' AS column_name,
'the table lacks ''branch''' AS message, 'error' AS severity, CAST(1 AS BIGINT) AS violation_count"""
_C_ENUMS = [
    _found("enum", c, f"count(*) FILTER ({bad})", f"n || ' rows hold a value of ''{c}'' that its list lacks'")
    for c, bad in _BAD.items()
]

ORACLES["contract_not_null"] = f"{_D} {_nulls('account_id')} UNION ALL {_nulls('status')}"
ORACLES["contract_unique"] = f"{_D} {_C_UNIQUE}"
ORACLES["contract_range"] = f"{_D} {_C_LOW} UNION ALL {_C_HIGH}"
ORACLES["contract_enum"] = f"{_D} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS invalid_value, count(*) AS row_count FROM dirty WHERE {bad} GROUP BY {c}"""
    for c, bad in _BAD.items()
)
ORACLES["contract_regex"] = f"{_D} {_C_REGEX}"
ORACLES["contract_row_count"] = f"{_D} {_C_SHORT} UNION ALL {_C_LONG}"
ORACLES["contract_missing_columns"] = f"{_D} {_nulls('account_id')} UNION ALL {_C_MISSING}"
ORACLES["contract_referential"] = """SELECT o_custkey, count(*) AS row_count FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey"""
ORACLES["contract_custom"] = f"{_D} " + _found(
    "custom",
    "ingestion_date",
    "count(*) FILTER (CAST(txn_date AS DATE) = CAST(ingestion_date AS DATE))",
    "'ingested on the day of the transaction'",
    "warning",
)
_C_ALL = " UNION ALL ".join(
    [_nulls("txn_id"), _nulls("account_id"), _nulls("status"), _C_UNIQUE, _C_LOW, _C_HIGH, _C_REGEX]
    + _C_ENUMS
    + [_C_SHORT, _C_LONG, _C_MISSING]
)
ORACLES["contract_violations"] = f"{_D} {_C_ALL}"
ORACLES["contract_result"] = f"""{_D}, v AS ({_C_ALL}) SELECT 'feed' AS contract_name, '2.1.0' AS version,
'violated' AS status, count(*) AS error_count, CAST(0 AS BIGINT) AS warning_count,
(SELECT count(*) FROM dirty) AS row_count, 8 AS column_count FROM v"""

ORACLES["contract_report"] = f"""{_D}, v AS ({_C_ALL}) SELECT 'feed' AS contract_name, 'violated' AS status,
(SELECT count(*) FROM v) AS error_count, (SELECT count(*) FROM dirty) AS row_count, v.* FROM v"""
ORACLES["contract_types_and_age"] = """SELECT 'dtype' AS constraint_type, 'o_totalprice' AS column_name,
'error' AS severity, CAST(1 AS BIGINT) AS violation_count
UNION ALL SELECT 'freshness', 'o_orderdate', 'error', count(DISTINCT 1) FROM orders
HAVING max(o_orderdate) < TIMESTAMP '2029-12-31 00:00:00'"""

# --- Drift --------------------------------------------------------------------------------------


def _observed(table: str, column: str, text: str) -> str:
    return f"""SELECT 'feed' AS source, '{column}' AS column_name, CASE
WHEN count(*) = 0 THEN 'object'
WHEN count(*) FILTER (regexp_matches({text}, '^[+-]?[0-9]+$')) = count(*) THEN 'int64'
WHEN count(*) FILTER ({text} IS NULL
  OR regexp_matches({text}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) = count(*) THEN 'float64'
ELSE 'object' END AS dtype FROM {table}"""


def _text(column: str, amount: str = "CAST(amount AS VARCHAR)") -> str:
    return amount if column == "amount" else f"CAST({column} AS VARCHAR)"


_BEFORE = " UNION ALL ".join(_observed("feed", c, _text(c)) for c in C.REQUIRED_COLUMNS)
_BAD_AMOUNT = "CASE WHEN bad_amount THEN '12,50' ELSE CAST(amount AS VARCHAR) END"
_AFTER = " UNION ALL ".join(
    [_observed("dirty", c, _text(c, _BAD_AMOUNT)) for c in C.REQUIRED_COLUMNS if c != "currency"]
    + [_observed("dirty", "channel", "CAST(length(txn_id) AS VARCHAR)")]
)
_DRIFT = f"""before AS ({_BEFORE}), after AS ({_AFTER}),
drift AS (
  SELECT source, CASE WHEN b.dtype IS NULL THEN 'column_added' WHEN a.dtype IS NULL THEN 'column_removed'
                      ELSE 'type_changed' END AS event_type,
         CASE WHEN column_name = 'amount' AND b.dtype IS NOT NULL THEN 'critical' ELSE 'warning' END AS severity,
         column_name, b.dtype AS expected, a.dtype AS actual,
         CASE WHEN b.dtype IS NULL THEN '''' || column_name || ''' is not in the baseline'
              WHEN a.dtype IS NULL THEN '''' || column_name || ''' is only in the baseline'
              ELSE '''' || column_name || ''' is ' || b.dtype || ' in the baseline, ' || a.dtype || ' now'
              END AS description
  FROM before b FULL OUTER JOIN after a USING (source, column_name)
  WHERE b.dtype IS DISTINCT FROM a.dtype)"""
ORACLES["schema_snapshot"] = f"{_D} {_AFTER}"
ORACLES["schema_drift"] = f"{_D}, {_DRIFT} SELECT * FROM drift"
ORACLES["drift_summary"] = f"""{_D}, {_DRIFT} SELECT count(*) AS total_events,
count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'warning') AS warning_count,
CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM drift"""
ORACLES["drift_recent"] = f"{_D}, {_DRIFT} SELECT * FROM drift ORDER BY source DESC, column_name DESC LIMIT 2"
ORACLES["null_share_drift"] = f"{_D} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name,
(SELECT round(avg(CAST({c} IS NULL AS INTEGER)), 8) FROM feed) AS baseline_share,
(SELECT round(avg(CAST({c} IS NULL AS INTEGER)), 8) FROM dirty) AS current_share"""
    for c in ("txn_id", "account_id", "txn_type", "status")
) + ") WHERE baseline_share <> current_share"
ORACLES["categorical_drift"] = """
WITH pairs AS (SELECT concat_ws('-', user_id, event_type) AS value, ts < TIMESTAMP '2024-01-04' AS early FROM events),
counted AS (SELECT value, count(*) FILTER (early) AS b, count(*) FILTER (NOT early) AS c FROM pairs GROUP BY value)
SELECT 'pair' AS column_name, value, CASE WHEN b = 0 THEN 'value_added' ELSE 'value_removed' END AS event_type,
       b + c AS row_count FROM counted WHERE b = 0 OR c = 0"""

# --- Lineage ------------------------------------------------------------------------------------

ORACLES["lineage_nodes"] = f"""{_B}, n AS (SELECT (SELECT count(*) FROM feed) AS r, (SELECT count(*) FROM clean) AS c,
(SELECT count(*) FROM ledger) AS l)
SELECT 'run_source_raw' AS node_id, 'source' AS node_type, 'raw' AS name, 'load' AS operation, r AS row_count,
       '' AS parents, CAST(NULL AS BIGINT) AS input_rows, CAST(NULL AS BIGINT) AS row_delta FROM n
UNION ALL SELECT 'run_transform_clean', 'transformation', 'clean', 'standardize', c, 'run_source_raw', r, c - r FROM n
UNION ALL SELECT 'run_transform_ledger', 'transformation', 'ledger', 'filter_success', l, 'run_transform_clean',
          c, l - c FROM n
UNION ALL SELECT 'run_sink_ledger_output', 'sink', 'ledger_output', 'persist', l, 'run_transform_ledger', NULL, NULL
FROM n"""
_EDGES = """edges AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS parent FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
ORACLES["lineage_chain"] = f"""WITH RECURSIVE {_EDGES}, walk AS (
SELECT DISTINCT node AS start, node, 0 AS steps FROM edges
UNION SELECT w.start, e.parent, w.steps + 1 FROM walk w JOIN edges e ON e.node = w.node)
SELECT start, node, steps FROM walk"""
ORACLES["lineage_deep_chain"] = """SELECT first_value(o_orderkey) OVER w AS start, o_orderkey AS node, row_number() OVER w - 1 AS steps
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)"""
ORACLES["lineage_first_parents"] = """SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS steps FROM customer
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer"""
ORACLES["lineage_impact"] = f"""WITH RECURSIVE {_EDGES}, walk AS (
SELECT DISTINCT parent AS start, parent AS node, 0 AS steps FROM edges
UNION SELECT w.start, e.node, w.steps + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT start, node, steps FROM walk WHERE steps > 0"""
ORACLES["source_fingerprint"] = """WITH hashed AS (
SELECT md5(concat_ws(chr(31), event_id, user_id, event_type, props)) AS h FROM events)
SELECT count(*) AS row_count, sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) || '-' ||
       sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS fingerprint FROM hashed"""

# --- SLA ----------------------------------------------------------------------------------------

_FRESH = """fresh AS (
SELECT table_name, last_updated, date_diff('microsecond', last_updated, TIMESTAMP '2024-02-07') / 3600000000.0
         AS data_age_hours, CAST(200.0 AS DOUBLE) AS max_age_hours
FROM (SELECT 'orders' AS table_name, max(o_orderdate) AS last_updated FROM orders
      UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', max(ts) FROM events)),
freshness AS (SELECT *, CASE WHEN data_age_hours > 200 THEN 'stale' WHEN data_age_hours > 160 THEN 'warning'
                             ELSE 'fresh' END AS status FROM fresh)"""
_LATENCY = """latency AS (
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS process, l_shipdate AS ended,
       CAST(date_diff('minute', o_orderdate, l_shipdate) AS DOUBLE) AS minutes,
       CASE WHEN date_diff('minute', o_orderdate, l_shipdate) > 86400 THEN 'violated'
            WHEN date_diff('minute', o_orderdate, l_shipdate) > 69120 THEN 'warning' ELSE 'compliant' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_METRICS = f"""{_FRESH}, {_LATENCY}, metrics AS (
SELECT 'processing_latency' AS metric_name, process AS subject, ended AS measured_at, minutes AS value,
       CAST(86400 AS DOUBLE) AS threshold, 'minutes' AS unit, status FROM latency
UNION ALL SELECT 'data_freshness', table_name, TIMESTAMP '2024-02-07', data_age_hours, 200, 'hours', status
FROM freshness)"""
ORACLES["freshness"] = f"""WITH {_FRESH} SELECT table_name, last_updated, round(data_age_hours, 4) AS data_age_hours,
max_age_hours, status FROM freshness"""
ORACLES["latency"] = f"WITH {_LATENCY} SELECT process, minutes, status FROM latency"
ORACLES["sla_report"] = f"""WITH {_METRICS} SELECT count(*) AS total_metrics,
count(*) FILTER (status IN ('compliant', 'fresh')) AS compliant, count(*) FILTER (status = 'warning') AS warnings,
count(*) FILTER (status IN ('violated', 'stale')) AS violations,
round(count(*) FILTER (status IN ('compliant', 'fresh')) / count(*), 8) AS compliance_rate FROM metrics"""
ORACLES["sla_summary"] = f"""WITH {_METRICS} SELECT count(*) AS total_checks,
CASE WHEN count(*) FILTER (status IN ('violated', 'stale')) > 0 THEN 'degraded' ELSE 'healthy' END AS status,
count(*) FILTER (status IN ('violated', 'stale')) AS violation_count,
count(*) FILTER (status = 'warning') AS warning_count FROM metrics"""
ORACLES["sla_recent_violations"] = f"""WITH {_METRICS} SELECT metric_name, subject, measured_at,
round(value, 4) AS value, threshold FROM metrics WHERE status IN ('violated', 'stale')
ORDER BY measured_at DESC, metric_name, subject LIMIT 5"""

# --- Alert events -------------------------------------------------------------------------------

_ALERT_ROWS = """alert_rows AS (
SELECT event_id, ts AS event_at, CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'info'
       ELSE 'warning' END AS severity, event_type AS category, 'user ' || user_id AS title, value,
       event_type || '_user_' || user_id || '_' || strftime(ts, '%Y%m%d%H%M') AS alert_id FROM events)"""
# Each event points to the first one of its key that is far enough behind; the chain from the
# first event of a key is what gets sent.
_SENT = f"""{_ALERT_ROWS},
passing AS (SELECT * FROM alert_rows WHERE severity <> 'info'),
pointed AS (
  SELECT a.event_id, arg_min(b.event_id, b.event_at) AS following
  FROM passing a LEFT JOIN passing b
    ON a.category = b.category AND a.title = b.title AND b.event_at >= a.event_at + INTERVAL 2880 MINUTE
  GROUP BY a.event_id),
sent AS (
  SELECT arg_min(event_id, event_at) AS event_id FROM passing GROUP BY category, title
  UNION ALL SELECT p.following FROM sent s JOIN pointed p ON p.event_id = s.event_id WHERE p.following IS NOT NULL)"""
ORACLES["alert_filter"] = f"""WITH {_ALERT_ROWS} SELECT event_id, severity, category, title FROM alert_rows
WHERE severity <> 'info'"""
ORACLES["alert_ids"] = f"WITH {_ALERT_ROWS} SELECT event_id, alert_id FROM alert_rows"
ORACLES["alert_throttle"] = f"""WITH RECURSIVE {_SENT}
SELECT event_id, event_at, alert_id FROM passing WHERE event_id IN (SELECT event_id FROM sent)"""
ORACLES["alert_throttle_hot"] = ORACLES["alert_throttle"]
ORACLES["active_alerts"] = f"""WITH {_ALERT_ROWS},
acks AS (SELECT alert_id, count(*) AS n FROM alert_rows WHERE value > 40 GROUP BY alert_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_at) AS nth FROM alert_rows)
SELECT event_id, alert_id FROM placed LEFT JOIN acks USING (alert_id)
WHERE nth > coalesce(n, 0) AND severity = 'critical'"""
ORACLES["alert_events"] = f"""{_D}, {_DRIFT}, {_METRICS}, v AS ({_C_ALL})
SELECT TIMESTAMP '2024-02-01 06:30:00' AS event_at, severity, 'quality' AS category,
       'Contract feed: ' || constraint_type || ' ' || column_name AS title, message, 'data_quality' AS source FROM v
UNION ALL SELECT measured_at, 'error', 'sla', 'SLA Violation: ' || metric_name || ' ' || subject,
       format('{{:.1f}}', value) || ' ' || unit || ' (limit ' || format('{{:.1f}}', threshold) || ')', 'sla_monitor'
FROM metrics WHERE status IN ('violated', 'stale')
UNION ALL SELECT TIMESTAMP '2024-02-01 06:30:00', severity, 'schema', 'Schema of ' || source || ': ' || event_type,
       description, 'schema_drift' FROM drift"""

# --- Jobs ---------------------------------------------------------------------------------------

ORACLES["ledger_job_ledger"] = ORACLES["ledger"]
ORACLES["ledger_job_balance"] = ORACLES["staged_balance"]
ORACLES["ledger_job_quality"] = ORACLES["quality_row_counts"].replace(_A, _B)
ORACLES["aml_job_scored"] = f"{_S} SELECT txn_id, risk_score, severity, is_alert FROM scored"
ORACLES["aml_job_alerts"] = ORACLES["aml_alert_numbers"].replace(
    "triggering_txn_count, description,\n       status", "triggering_txn_ids"
)

# --- Streaming ----------------------------------------------------------------------------------

ORACLES["stream_ledger"] = ORACLES["ledger"]
ORACLES["stream_deduplicated"] = ORACLES["ledger"]
ORACLES["stream_balances"] = ORACLES["stream_balances_deltas"] = ORACLES["staged_balance"]
ORACLES["stream_velocity"] = f"""{_B},
placed AS (SELECT *, CAST(CAST(txn_date AS DATE) - CAST(b.back AS INTEGER) AS TIMESTAMP) AS window_start
           FROM ledger, (SELECT unnest(range(7)) AS back) b)
SELECT account_id, window_start, window_start + INTERVAL 7 DAY AS window_end, count(txn_id) AS txn_count,
       {_money('abs(amount)')} AS amount_sum FROM placed
GROUP BY account_id, window_start"""
ORACLES["stream_throttle"] = ORACLES["stream_throttle_batches"] = ORACLES["alert_throttle"]
