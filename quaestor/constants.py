"""Column lists, word lists, names and thresholds that results depend on."""

# --- Fixed values: feed and ledger layout -------------------------------------------------------

REQUIRED_COLUMNS = (
    "txn_id",
    "account_id",
    "txn_date",
    "ingestion_date",
    "amount",
    "currency",
    "txn_type",
    "status",
)

LEDGER_COLUMNS = (
    "txn_id",
    "account_id",
    "txn_date",
    "ingestion_date",
    "amount",
    "currency",
    "txn_type",
    "is_late",
)

NOT_NULL_COLUMNS = ("account_id", "status", "txn_type")

QUALITY_NULL_COLUMNS = ("txn_id", "account_id", "txn_date", "amount_clean")

# --- Fixed values: words the CSV reader takes as missing (the pandas documentation's list) -------

NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- Fixed values: business rules ---------------------------------------------------------------

SUCCESS_STATUSES = ("COMPLETED", "SETTLED", "OK")
REFUND_TYPES = ("REFUND",)
VALID_TXN_TYPES = (
    "CARD",
    "CASH",
    "REFUND",
    "DEBIT",
    "CREDIT",
    "TRANSFER",
    "WITHDRAWAL",
    "FEE",
    "DEPOSIT",
    "PAYMENT",
)

# --- Fixed values: AML rules --------------------------------------------------------------------

VELOCITY_WINDOWS = ("1D", "7D", "30D")
ROUND_AMOUNTS = (10000.0, 5000.0, 1000.0, 500.0)

# rule id -> (flag column, name shown in alerts)
AML_RULES = {
    "velocity_count": ("rule_velocity_count_flag", "Daily Transaction Count Exceeded"),
    "velocity_daily_amount": ("rule_velocity_daily_amount_flag", "Daily Amount Threshold Exceeded"),
    "velocity_7d_amount": ("rule_velocity_7d_amount_flag", "7-Day Amount Threshold Exceeded"),
    "structuring": ("rule_structuring_flag", "Potential Structuring Detected"),
    "round_number": ("rule_round_number_flag", "Large Round Number Transaction"),
}

AML_ALERT_COLUMNS = (
    "alert_id",
    "alert_timestamp",
    "account_id",
    "rule_id",
    "rule_name",
    "severity",
    "risk_score",
    "triggering_txn_ids",
    "triggering_txn_count",
    "triggering_amount_sum",
    "description",
    "status",
)

# --- Fixed values: event severities and presets (preset -> category, source, default severity) ---

EVENT_SEVERITIES = ("info", "warning", "error", "critical")
EVENT_PRESETS = {
    "quality": ("quality", "data_quality", "warning"),
    "sla": ("sla", "sla_monitor", "error"),
    "schema": ("schema", "schema_drift", "warning"),
    "run": ("pipeline", "pipeline", "critical"),
}
