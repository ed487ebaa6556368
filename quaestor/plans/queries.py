"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import lenient_double
from quaestor.operators import (
    balance,
    contracts,
    drift,
    events,
    features,
    incremental,
    lineage,
    quality,
    recon_tree,
    reconcile,
    rules,
    sla,
    transform,
    validate,
    velocity,
)
from quaestor.operators import aml_alerts as alerting
from quaestor.operators.contracts import ColumnRule, Contract, Freshness, Reference
from quaestor.params import AmlParams, FeedParams, JobParams, SkewParams, TrustParams
from quaestor.plans import jobs
from quaestor.plans.stages import StageStore
from quaestor.session import cut_lineage, scratch_path
from quaestor.sources import commits, sinks
from quaestor.sources.feed import as_feed, events_feed, orders_feed, read_feed_csv, read_ledger, table
from quaestor.streaming import balance_deltas, ledger_stream, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AML = AmlParams(
    daily_txn_count_threshold=5, daily_amount_threshold=30_000.0, seven_day_amount_threshold=60_000.0
)
AML_DAYS = AmlParams(
    daily_txn_count_threshold=5,
    daily_amount_threshold=30_000.0,
    seven_day_amount_threshold=60_000.0,
    velocity_frame="days",
    min_structuring_txns=2,
)
RUN_TIME = datetime(2024, 2, 1, 6, 30, 0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- Inputs -------------------------------------------------------------------------------------


def dirty_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events feed as text, with faults wherever ``value`` falls in certain ranges."""
    text = [F.col(c).cast("string").alias(c) for c in C.REQUIRED_COLUMNS]
    feed = as_feed(table(spark, sf_dir, "events"), "value", "user_id").select(*text, "value", "user_id")
    v = F.col("value")
    return feed.select(
        F.when(v < 0.3, None)
        .when(v > 150, F.concat(F.lit("e"), "user_id"))
        .otherwise(F.col("txn_id"))
        .alias("txn_id"),
        F.when(v.between(1, 1.5), None).otherwise(F.col("account_id")).alias("account_id"),
        F.when(v.between(2, 2.5), "not-a-date").otherwise(F.col("txn_date")).alias("txn_date"),
        "ingestion_date",
        F.when(v.between(3, 3.5), "12,50")
        .when(v.between(7, 7.2), "inf")
        .when(v.between(7, 7.5), "1e19")
        .when(v.between(4, 4.5), None)
        .otherwise(F.col("amount"))
        .alias("amount"),
        "currency",
        F.when(v.between(100, 105), "crypto")
        .when(v.between(5, 5.5), None)
        .otherwise(F.col("txn_type"))
        .alias("txn_type"),
        F.when(v.between(6, 6.5), None).otherwise(F.col("status")).alias("status"),
    )


def _clean_a(spark, d):
    return transform.clean_transactions(orders_feed(spark, d))


def _ledger_a(spark, d):
    return transform.ledger_of(_clean_a(spark, d))


def _clean_b(spark, d):
    return transform.clean_transactions(events_feed(spark, d))


def _ledger_b(spark, d):
    return transform.ledger_of(_clean_b(spark, d))


def _clean_dirty(spark, d):
    return transform.clean_transactions(dirty_feed(spark, d))


def _scored(spark, d, params=AML):
    return rules.apply_rules(features.aml_features(_ledger_b(spark, d), params), params)


def _hits(spark, d, params=AML):
    """Alerted transactions by rule, stored once for the several uses alerts make of them."""
    return cut_lineage(alerting.triggered(_scored(spark, d, params)))


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- Sources and sinks --------------------------------------------------------------------------


@query
def csv_scan(spark, d):
    path = scratch_path(spark, "feed")
    feed = events_feed(spark, d)
    text = feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])
    text.write.option("header", True).csv(path)
    raw = read_feed_csv(spark, path)
    parsed = transform.parse_dates(raw)
    return parsed.withColumn("amount", lenient_double(F.col("amount"), raw.schema["amount"].dataType))


@query
def ledger_scan(spark, d):
    path = scratch_path(spark, "ledger")
    return read_ledger(spark, sinks.write_ledger(_ledger_b(spark, d), path))


@query
def staged_balance(spark, d):
    """Stage tables: build, interrupt, resume from the stored stage."""
    base = scratch_path(spark, "stages")
    build = lambda: {"clean": _clean_b(spark, d)}
    StageStore(spark, base, AML, [f"{d}/events.parquet"]).run("transform", build, resume=False)
    resumed = StageStore(spark, base, AML, [f"{d}/events.parquet"])
    clean = resumed.run("transform", dict, resume=True)["clean"]
    return balance.daily_balance(transform.ledger_of(clean))


# --- Validation ---------------------------------------------------------------------------------


@query
def duplicate_txn_ids(spark, d):
    return validate.duplicate_ids(dirty_feed(spark, d))


@query
def null_counts(spark, d):
    return validate.null_counts(dirty_feed(spark, d))


@query
def invalid_txn_types(spark, d):
    return validate.invalid_txn_types(dirty_feed(spark, d))


@query
def unreadable_dates(spark, d):
    return validate.unreadable_dates(dirty_feed(spark, d))


@query
def amount_parse_failures(spark, d):
    return validate.unreadable_amounts(dirty_feed(spark, d))


@query
def validation_violations(spark, d):
    return validate.violations(dirty_feed(spark, d))


@query
def ledger_null_ids(spark, d):
    return validate.null_counts(transform.ledger_of(_clean_dirty(spark, d)), ["txn_id"])


@query
def ledger_duplicate_ids(spark, d):
    return validate.duplicate_ids(transform.ledger_of(_clean_dirty(spark, d)))


# --- Transformation -----------------------------------------------------------------------------


@query
def parse_dates(spark, d):
    return transform.parse_dates(dirty_feed(spark, d)).select("txn_id", "txn_date", "ingestion_date")


@query
def normalize_status(spark, d):
    return _clean_dirty(spark, d).select("txn_id", "status", "status_clean")


@query
def normalize_amount(spark, d):
    return _clean_dirty(spark, d).select("txn_id", "txn_type", "amount_clean")


@query
def late_arrivals(spark, d):
    return _clean_a(spark, d).select("txn_id", "is_late")


@query
def late_arrivals_threshold(spark, d):
    """Late only when more than 30 days pass."""
    return transform.clean_transactions(orders_feed(spark, d), FeedParams(late_days=30)).select(
        "txn_id", "is_late"
    )


@query
def transform_clean(spark, d):
    return _clean_b(spark, d)


@query
def ledger(spark, d):
    return _ledger_b(spark, d)


# --- Reconciliation -----------------------------------------------------------------------------


@query
def recon_raw_totals(spark, d):
    return _doubles(reconcile.raw_totals(_clean_a(spark, d)), "raw_total")


@query
def recon_ledger_totals(spark, d):
    return _doubles(reconcile.ledger_totals(_ledger_a(spark, d)), "ledger_total")


@query
def reconciliation(spark, d):
    clean = _clean_a(spark, d)
    recon = reconcile.reconciliation(clean, transform.ledger_of(clean))
    return _doubles(recon, "raw_total", "ledger_total", "diff")


@query
def reconciliation_by_day(spark, d):
    clean = _clean_b(spark, d)
    recon = reconcile.reconciliation(clean, transform.ledger_of(clean), "day")
    return _doubles(recon, "raw_total", "ledger_total", "diff")


def _tampered(spark, d):
    """Reconciliation of the order feed against a ledger whose largest amounts were changed."""
    clean = _clean_a(spark, d)
    altered = F.when(F.col("amount") > 100_000, F.col("amount") + 10).otherwise(F.col("amount"))
    return reconcile.reconciliation(clean, transform.ledger_of(clean).withColumn("amount", altered))


@query
def recon_mismatches(spark, d):
    return _doubles(reconcile.mismatches(_tampered(spark, d)), "raw_total", "ledger_total", "diff")


@query
def recon_summary(spark, d):
    return reconcile.recon_summary(_tampered(spark, d))


def _damaged(ledger: DataFrame) -> DataFrame:
    """A ledger that lost, repeats, invents and changes rows."""
    number = F.substring("txn_id", 2, 18).cast("long")
    kept = ledger.filter(number % 97 != 1)
    repeated = ledger.filter(number % 101 == 2)
    invented = ledger.filter(number % 103 == 3).withColumn("txn_id", F.concat(F.lit("x"), "txn_id"))
    altered = F.when(number % 89 == 4, F.col("amount") + 10).otherwise(F.col("amount"))
    return kept.withColumn("amount", altered).unionByName(repeated).unionByName(invented)


@query
def recon_offending_rows(spark, d):
    """The transactions that are missing, extra or changed, found through differing digests."""
    clean = _clean_b(spark, d)
    bad = recon_tree.offending_rows(clean, _damaged(transform.ledger_of(clean)))
    return _doubles(bad, "raw_amount", "ledger_amount")


@query
def ledger_as_of(spark, d):
    """The first version of a ledger table that was replaced by a second one and appended to by a third."""
    path, full = scratch_path(spark, "versions"), _ledger_b(spark, d)
    first = sinks.commit_ledger(full.filter("NOT is_late"), path, None)
    second = sinks.commit_ledger(full.filter("amount > 0"), path, first)
    commits.commit(full.filter("amount <= 0"), path, second, append=True)
    return commits.read(spark, path, first.version)


# --- Balances and quality -----------------------------------------------------------------------


@query
def daily_balance(spark, d):
    return balance.daily_balance(_ledger_a(spark, d))


@query
def daily_balance_sql(spark, d):
    return balance.daily_balance_sql(_ledger_a(spark, d))


@query
def balance_by_currency(spark, d):
    return balance.daily_balance(
        _ledger_a(spark, d), ("currency", "txn_type"), {"total": "sum", "transactions": "count"}
    )


@query
def quality_row_counts(spark, d):
    clean = _clean_a(spark, d)
    return quality.row_counts(orders_feed(spark, d), clean, transform.ledger_of(clean))


@query
def quality_status(spark, d):
    return quality.status_counts(_clean_a(spark, d))


@query
def quality_failure_rate(spark, d):
    return quality.failure_rate(_clean_a(spark, d))


@query
def quality_nulls(spark, d):
    return quality.null_flags(_clean_dirty(spark, d))


@query
def quality_duplicates(spark, d):
    return quality.duplicate_count(_clean_dirty(spark, d))


@query
def quality_late(spark, d):
    return quality.late_count(_clean_a(spark, d))


def _rounded_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query
def quality_amount_stats(spark, d):
    return _rounded_stats(quality.amount_stats(_clean_a(spark, d)))


@query
def quality_outliers(spark, d):
    return quality.outlier_count(_clean_b(spark, d))


@query
def rejection_report(spark, d):
    return quality.rejection_report(_clean_a(spark, d))


@query
def quality_metrics(spark, d):
    clean = _clean_b(spark, d)
    metrics = quality.quality_metrics(events_feed(spark, d), clean, transform.ledger_of(clean))
    flat = metrics.select(
        "row_counts.*",
        F.col("rejection_reasons.by_status")["SUCCESS"].alias("success_rows"),
        F.col("rejection_reasons.by_status")["FAILED"].alias("failed_rows"),
        "rejection_reasons.total_failed",
        "rejection_reasons.failure_rate",
        "data_quality_flags.*",
    )
    return _rounded_stats(flat.select("*", "amount_statistics.*").drop("amount_statistics"))


# --- AML ----------------------------------------------------------------------------------------


def _rounded_velocity(df: DataFrame, windows=C.VELOCITY_WINDOWS) -> DataFrame:
    rounded = {}
    for w in (label.lower() for label in windows):
        rounded[f"amount_sum_{w}"] = F.round(f"amount_sum_{w}", 2)
        rounded[f"amount_avg_{w}"] = F.round(f"amount_avg_{w}", 6)
    return df.withColumns(rounded)


def _velocity(spark, d, ledger_, windows=C.VELOCITY_WINDOWS, frame="rows", skew=SkewParams()):
    kept = ["txn_id", *[f"{k}_{w.lower()}" for w in windows for k in ("txn_count", "amount_sum", "amount_avg")]]
    return _rounded_velocity(velocity.velocity(ledger_, windows, frame, skew), windows).select(*kept)


@query
def velocity_rows(spark, d):
    return _velocity(spark, d, _ledger_a(spark, d))


@query
def velocity_rows_sliced(spark, d):
    """The same windows with most accounts cut into slices."""
    split = SkewParams(min_hot_rows=10, slice_rows=5_000)
    return _velocity(spark, d, _ledger_a(spark, d), skew=split)


@query
def velocity_custom(spark, d):
    return _velocity(spark, d, _ledger_b(spark, d), ("3D", "14D"))


@query
def velocity_days(spark, d):
    return _velocity(spark, d, _ledger_a(spark, d), frame="days")


@query
def time_features(spark, d):
    return features.time_features(_ledger_b(spark, d)).select(
        "txn_id", "hour_of_day", "day_of_week", "is_weekend", "is_late_night"
    )


@query
def structuring_features(spark, d):
    return features.structuring_features(_ledger_b(spark, d)).select(
        "txn_id", "is_near_threshold", "pct_of_threshold"
    )


@query
def round_number_features(spark, d):
    return features.round_number_features(_ledger_b(spark, d)).select(
        "txn_id", "is_large_round", "round_number_match"
    )


@query
def structuring_pattern(spark, d):
    near = features.structuring_features(_ledger_b(spark, d))
    return features.structuring_pattern(near).select("txn_id", "is_near_threshold", "near_threshold_txns")


@query
def aml_features(spark, d):
    return _rounded_velocity(features.aml_features(_ledger_b(spark, d), AML))


def _flag_columns():
    return [flag for flag, _ in C.AML_RULES.values()]


@query
def rule_flags(spark, d):
    featured = features.aml_features(_ledger_b(spark, d), AML)
    return rules.rule_flags(featured, AML).select("txn_id", *_flag_columns())


@query
def risk_score(spark, d):
    return _scored(spark, d).select("txn_id", "risk_score")


@query
def severity(spark, d):
    return _scored(spark, d).select("txn_id", "severity", "is_alert")


@query
def aml_scored(spark, d):
    return _rounded_velocity(_scored(spark, d))


@query
def aml_scored_incremental(spark, d):
    """Four deliveries: the first and the second half of the time, then two that are late, over all of it."""
    path = scratch_path(spark, "scored")
    ledger = cut_lineage(_ledger_b(spark, d))
    ends = ledger.agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last")).first()
    if ends.first is None:
        return _rounded_velocity(rules.apply_rules(features.aml_features(ledger, AML), AML))
    early = F.col("txn_date") <= F.lit(ends.first + (ends.last - ends.first) / 2)
    late = F.pmod(F.xxhash64("txn_id"), F.lit(40))
    number = F.when(late < 2, 2 + late).when(early, 0).otherwise(1)
    for delivery in range(4):
        incremental.score_delivery(ledger.filter(number == delivery), delivery, path, AML)
    return _rounded_velocity(incremental.scored(spark, path))


@query
def aml_scored_days(spark, d):
    return _scored(spark, d, AML_DAYS).select(
        "txn_id", *_flag_columns(), "risk_score", "severity", "is_alert"
    )


@query
def aml_metrics(spark, d):
    return rules.aml_metrics(_scored(spark, d))


def _joined_ids(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("triggering_txn_ids", F.array_join("triggering_txn_ids", ","))


@query
def aml_alerts(spark, d):
    return _joined_ids(alerting.deduplicated_alerts(_hits(spark, d)).drop("ids_part"))


@query
def aml_alert_id_parts(spark, d):
    """Ids in parts of about three, so that the layout of large alerts is checked too."""
    return _joined_ids(alerting.id_parts(_hits(spark, d), 3))


@query
def aml_alert_numbers(spark, d):
    return alerting.numbered_alerts(_hits(spark, d), RUN_TIME).select(
        "alert_id", "alert_timestamp", "account_id", "rule_id", "triggering_txn_count", "description", "status"
    )


@query
def aml_alert_transactions(spark, d):
    return alerting.alert_transactions(alerting.triggered(_scored(spark, d)))


@query
def aml_alerts_by_severity(spark, d):
    return alerting.alerts_by_severity(alerting.alert_totals(alerting.triggered(_scored(spark, d))))


@query
def aml_alerts_days(spark, d):
    return alerting.alert_totals(alerting.triggered(_scored(spark, d, AML_DAYS)))


# --- Contracts ----------------------------------------------------------------------------------

FEED_CONTRACT = Contract(
    name="feed",
    version="2.1.0",
    columns=(
        ColumnRule("txn_id", dtype="string", unique=True, regex_pattern=r"^e[0-9]{3,}$"),
        ColumnRule("account_id", dtype="string"),
        ColumnRule("amount", nullable=True, min_value=-20_000.0, max_value=20_000.0),
        ColumnRule("txn_type", nullable=True, allowed_values=("CARD", "TRANSFER", "DEPOSIT", "PAYMENT")),
        ColumnRule("status", allowed_values=("COMPLETED", "settled", "OK", "PENDING")),
        ColumnRule("branch"),
    ),
    row_count_min=100_000_000_000,
    row_count_max=100,
)


def _only(*names: str, **fields) -> Contract:
    """A contract with the given columns' rules out of the feed contract."""
    return Contract("feed", tuple(r for r in FEED_CONTRACT.columns if r.name in names), **fields)


def _violations(spark, d, contract, kind=None, df=None, validators=None):
    out = contracts.contract_violations(dirty_feed(spark, d) if df is None else df, contract, validators)
    return out if kind is None else out.filter(F.col("constraint_type") == kind)


@query
def contract_not_null(spark, d):
    return _violations(spark, d, _only("account_id", "status"), "not_null")


@query
def contract_unique(spark, d):
    return _violations(spark, d, _only("txn_id"), "unique")


@query
def contract_range(spark, d):
    return _violations(spark, d, _only("amount"), "range")


@query
def contract_enum(spark, d):
    return contracts.invalid_values(dirty_feed(spark, d), _only("txn_type", "status"))


@query
def contract_regex(spark, d):
    return _violations(spark, d, _only("txn_id"), "regex")


@query
def contract_row_count(spark, d):
    return _violations(spark, d, _only(row_count_min=100_000_000_000, row_count_max=100))


@query
def contract_missing_columns(spark, d):
    return _violations(spark, d, _only("account_id", "branch"))


@query
def contract_referential(spark, d):
    """Customers of orders that are not among the customers with a positive balance."""
    solvent = table(spark, d, "customer").filter("c_acctbal > 0")
    reference = Reference("o_custkey", solvent, "c_custkey")
    return contracts.orphans(table(spark, d, "orders"), reference)


def _early_ingestion(df: DataFrame) -> DataFrame:
    """Custom validator: a feed must not be ingested on the day of the transaction."""
    dated = transform.parse_dates(df)
    same_day = F.count_if(F.to_date("txn_date") == F.to_date("ingestion_date"))
    return dated.agg(
        F.lit("custom").alias("constraint_type"),
        F.lit("ingestion_date").alias("column_name"),
        F.lit("ingested on the day of the transaction").alias("message"),
        F.lit("warning").alias("severity"),
        same_day.alias("violation_count"),
    ).filter("violation_count > 0")


@query
def contract_custom(spark, d):
    contract = _only(custom_validators=("early_ingestion",))
    return _violations(spark, d, contract, validators={"early_ingestion": _early_ingestion})


@query
def contract_violations(spark, d):
    return _violations(spark, d, FEED_CONTRACT)


@query
def contract_result(spark, d):
    df = dirty_feed(spark, d)
    return contracts.contract_result(df, FEED_CONTRACT, contracts.contract_violations(df, FEED_CONTRACT))


@query
def contract_report(spark, d):
    """The stored report, read back with a row per violation."""
    df, path = dirty_feed(spark, d), scratch_path(spark, "contract")
    report = contracts.contract_report(df, FEED_CONTRACT, contracts.contract_violations(df, FEED_CONTRACT))
    sinks.write_contract_report(report, path)
    stored_report = sinks.read_contract_report(spark, path)
    return stored_report.select("contract_name", "status", "error_count", "row_count", F.inline("violations"))


@query
def contract_types_and_age(spark, d):
    """A declared type that differs, and a table whose newest row is too old."""
    contract = Contract(
        "orders",
        (ColumnRule("o_totalprice", dtype="string"), ColumnRule("o_orderkey")),
        freshness=Freshness("o_orderdate", 24.0, datetime(2030, 1, 1)),
    )
    return _violations(spark, d, contract, df=table(spark, d, "orders")).drop("message")


# --- Drift --------------------------------------------------------------------------------------


def _text_feed(spark, d):
    feed = events_feed(spark, d)
    return feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])


def _changed_feed(spark, d):
    """The dirty feed without its currency, with a channel."""
    return dirty_feed(spark, d).drop("currency").withColumn("channel", F.length("txn_id").cast("string"))


TRUST = TrustParams(critical_columns=("amount",))


def _feed_drift(spark, d):
    before = drift.observed_snapshot(_text_feed(spark, d), "feed")
    after = drift.observed_snapshot(_changed_feed(spark, d), "feed")
    return drift.schema_drift(before, after, TRUST)


@query
def schema_snapshot(spark, d):
    return drift.observed_snapshot(_changed_feed(spark, d), "feed")


@query
def schema_drift(spark, d):
    return _feed_drift(spark, d)


@query
def drift_summary(spark, d):
    return drift.drift_summary(_feed_drift(spark, d))


@query
def drift_recent(spark, d):
    return drift.recent_events(_feed_drift(spark, d), ("source", "column_name"), 2)


@query
def null_share_drift(spark, d):
    columns = ("txn_id", "account_id", "txn_type", "status")
    out = drift.null_share_drift(_text_feed(spark, d), dirty_feed(spark, d), columns)
    return out.withColumns({c: F.round(c, 8) for c in ("baseline_share", "current_share")})


@query
def categorical_drift(spark, d):
    """Pairs of account and type that are new, or no longer seen, after the first days."""
    pairs = table(spark, d, "events").withColumn("pair", F.concat_ws("-", "user_id", "event_type"))
    split = F.lit("2024-01-04").cast("timestamp_ntz")
    return drift.categorical_drift(pairs.filter(F.col("ts") < split), pairs.filter(F.col("ts") >= split), "pair")


# --- Lineage ------------------------------------------------------------------------------------


@query
def lineage_nodes(spark, d):
    raw = events_feed(spark, d)
    clean = transform.clean_transactions(raw)
    kept = transform.ledger_of(clean)
    nodes = (
        lineage.source_node(raw, "run", "raw", "feed")
        .unionByName(lineage.transformation_node(raw, clean, "run", "clean", "standardize", "run_source_raw"))
        .unionByName(
            lineage.transformation_node(clean, kept, "run", "ledger", "filter_success", "run_transform_clean")
        )
        .unionByName(lineage.sink_node(kept, "run", "ledger_output", "ledger", "run_transform_ledger"))
    )
    return nodes.select(
        "node_id",
        "node_type",
        "name",
        "operation",
        "row_count",
        F.array_join("parent_nodes", ",").alias("parents"),
        "input_rows",
        "row_delta",
    )


def _edges(spark, d):
    """Customers below nations below regions, as child -> parent."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    up = table(spark, d, "customer").select(
        name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")
    )
    return up.unionByName(
        table(spark, d, "nation").select(
            name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent")
        )
    )


@query
def lineage_chain(spark, d):
    edges = _edges(spark, d)
    return lineage.lineage_chain(edges, edges.select("node"))


@query
def lineage_deep_chain(spark, d):
    """Each customer's orders as one chain, the order before as the parent, walked back from the last one."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("node"),
        F.lag("o_orderkey").over(before).alias("parent"),
        F.lead("o_orderkey").over(before).isNull().alias("is_last"),
    )
    return lineage.lineage_chain(orders.where("parent is not null"), orders.where("is_last"))


@query
def lineage_first_parents(spark, d):
    """Nodes with several parents: of a customer's, the nation comes first, then the segment."""
    nodes = table(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("node_id"),
        F.array(F.concat(F.lit("n"), "c_nationkey"), F.col("c_mktsegment")).alias("parent_nodes"),
    )
    edges = lineage.first_parents(nodes)
    return lineage.lineage_chain(edges, edges.select("node"))


@query
def lineage_impact(spark, d):
    edges = _edges(spark, d)
    return lineage.lineage_impact(edges, edges.select(F.col("parent").alias("node")))


@query
def source_fingerprint(spark, d):
    return lineage.table_fingerprint(table(spark, d, "events"), ("event_id", "user_id", "event_type", "props"))


# --- SLA ----------------------------------------------------------------------------------------

FRESH = TrustParams(max_data_age_hours=200.0, max_processing_minutes=60.0 * 24 * 60)


def _freshness(spark, d):
    updates = sla.last_updates(
        {
            "orders": (table(spark, d, "orders"), "o_orderdate"),
            "lineitem": (table(spark, d, "lineitem"), "l_shipdate"),
            "events": (table(spark, d, "events"), "ts"),
        }
    )
    return sla.freshness(updates, datetime(2024, 2, 7), FRESH)


def _latency(spark, d):
    """Every order line as a run from its order date to its ship date."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    runs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("process"),
        F.col("o_orderdate").alias("started"),
        F.col("l_shipdate").alias("ended"),
    )
    return sla.latency(runs, FRESH)


def _sla_metrics(spark, d):
    at = F.lit("2024-02-07").cast("timestamp_ntz")
    return sla.latency_metrics(_latency(spark, d), FRESH.max_processing_minutes).unionByName(
        sla.freshness_metrics(_freshness(spark, d), at)
    )


@query
def freshness(spark, d):
    return _freshness(spark, d).withColumn("data_age_hours", F.round("data_age_hours", 4))


@query
def latency(spark, d):
    return _latency(spark, d).select("process", "minutes", "status")


@query
def sla_report(spark, d):
    return sla.sla_report(_sla_metrics(spark, d)).withColumn("compliance_rate", F.round("compliance_rate", 8))


@query
def sla_summary(spark, d):
    return sla.sla_summary(_sla_metrics(spark, d))


@query
def sla_recent_violations(spark, d):
    return sla.recent_violations(_sla_metrics(spark, d)).withColumn("value", F.round("value", 4))


# --- Alert events -------------------------------------------------------------------------------

NOISY = TrustParams(throttle_minutes=2_880.0)


def _event_rows(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    severity_ = F.when(kind == "error", "critical").when(kind == "signup", "info").otherwise("warning")
    return df.select(
        "event_id",
        F.col("ts").alias("event_at"),
        severity_.alias("severity"),
        kind.alias("category"),
        F.concat(F.lit("user "), "user_id").alias("title"),
        F.concat(kind, F.lit(" of "), F.col("value").cast("string")).alias("message"),
        F.lit("events").alias("source"),
        "value",
    )


def _alerts(spark, d):
    return _event_rows(table(spark, d, "events"))


@query
def alert_filter(spark, d):
    passing = events.filter_severity(_alerts(spark, d), TrustParams().severity_filter)
    return passing.select("event_id", "severity", "category", "title")


@query
def alert_throttle(spark, d):
    return events.send_events(_alerts(spark, d), "event_id", NOISY).select("event_id", "event_at", "alert_id")


@query
def alert_throttle_hot(spark, d):
    """The same with every key of several events cut into stretches."""
    split = SkewParams(min_hot_rows=1, slice_rows=100)
    sent = events.send_events(_alerts(spark, d), "event_id", NOISY, split)
    return sent.select("event_id", "event_at", "alert_id")


@query
def alert_ids(spark, d):
    return _alerts(spark, d).select("event_id", events.alert_id().alias("alert_id"))


@query
def active_alerts(spark, d):
    """Alerts left open after every one above a value was acknowledged by its id."""
    alerts = _alerts(spark, d).withColumn("alert_id", events.alert_id())
    acks = alerts.filter("value > 40").select("alert_id", F.lit("desk").alias("by"), F.col("event_at").alias("at"))
    return events.active_alerts(alerts, acks, "critical").select("event_id", "alert_id")


@query
def alert_events(spark, d):
    """Contract violations, SLA violations and schema drift of the whole tables as events."""
    violated = contracts.contract_violations(dirty_feed(spark, d), FEED_CONTRACT)
    return (
        events.contract_events(violated, "feed", RUN_TIME)
        .unionByName(events.sla_events(_sla_metrics(spark, d)))
        .unionByName(events.drift_events(_feed_drift(spark, d), RUN_TIME))
    )


# --- Jobs ---------------------------------------------------------------------------------------


def _ledger_job(spark, d) -> dict[str, str]:
    """The ledger job over the events feed, written as CSV first."""
    path = scratch_path(spark, "job")
    feed = events_feed(spark, d)
    text = feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])
    text.write.option("header", True).csv(f"{path}/feed")
    params = JobParams(feed=FeedParams(valid_txn_types=None), aml=AML)
    return jobs.run_ledger_job(spark, f"{path}/feed", f"{path}/out", params)


def _aml_job(spark, d) -> dict:
    paths = _ledger_job(spark, d)
    return jobs.run_aml_job(spark, paths["ledger"], paths["trust"].removesuffix("/trust"), AML, RUN_TIME)


@query
def ledger_job_ledger(spark, d):
    return read_ledger(spark, _ledger_job(spark, d)["ledger"])


@query
def ledger_job_balance(spark, d):
    return spark.read.parquet(_ledger_job(spark, d)["daily_balance"])


@query
def ledger_job_quality(spark, d):
    return spark.read.json(_ledger_job(spark, d)["quality"]).select("row_counts.*")


@query
def aml_job_scored(spark, d):
    scored = spark.read.parquet(_aml_job(spark, d)["scored_transactions_path"])
    return scored.select("txn_id", "risk_score", "severity", "is_alert")


@query
def aml_job_alerts(spark, d):
    alerts = spark.read.parquet(_aml_job(spark, d)["alerts_path"])
    return alerts.select("alert_id", "alert_timestamp", "account_id", "rule_id", "triggering_txn_ids")


# --- Streaming ----------------------------------------------------------------------------------


def _stream_events(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(spark, name: str, rows: DataFrame) -> DataFrame:
    """Run a stream over all available input into a table and read that table."""
    path = scratch_path(spark, name)
    ledger_stream.run_to_table(rows, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/table")


@query
def stream_ledger(spark, d):
    return _drained(spark, "ledger", ledger_stream.stream_ledger(as_feed(_stream_events(spark, d))))


@query
def stream_deduplicated(spark, d):
    """A feed that delivers every row twice."""
    twice = _stream_events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drained(spark, "dedup", ledger_stream.deduplicate(ledger_stream.stream_ledger(as_feed(twice))))


@query
def stream_balances(spark, d):
    """A CSV feed that arrives in two deliveries; the second has late rows for days of the first."""
    path = scratch_path(spark, "balances")
    feed = events_feed(spark, d)
    text = feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])
    early = F.col("txn_type").isin("CARD", "TRANSFER")
    for delivery in (early, ~early):
        text.filter(delivery).write.mode("append").option("header", True).csv(f"{path}/feed")
        kept = ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, f"{path}/feed"))
        ledger_stream.repair_balances(
            kept, f"{path}/ledger", f"{path}/balance", f"{path}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{path}/balance").drop("txn_day")


@query
def stream_balances_deltas(spark, d):
    """The same deliveries, five files a batch; sums of batches are added, and days are compacted."""
    path = scratch_path(spark, "deltas")
    feed = events_feed(spark, d)
    text = feed.select(*[F.col(c).cast("string").alias(c) for c in feed.columns])
    early = F.col("txn_type").isin("CARD", "TRANSFER")
    for delivery in (early, ~early):
        dealt = text.filter(delivery).repartition(15, "txn_id")
        dealt.write.mode("append").option("header", True).csv(f"{path}/feed")
        kept = ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, f"{path}/feed", max_files=5))
        balance_deltas.run_balance_deltas(kept, f"{path}/balance", f"{path}/checkpoint").awaitTermination()
    return balance_deltas.balances(spark, f"{path}/balance")


@query
def stream_velocity(spark, d):
    """All windows, those too that later rows may still change."""
    path = scratch_path(spark, "velocity")
    windows = ledger_stream.event_time_velocity(ledger_stream.stream_ledger(as_feed(_stream_events(spark, d))))
    ledger_stream.run_to_versions(windows, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    keys = ["account_id", "window_start", "window_end"]
    return ledger_stream.newest_versions(spark, f"{path}/table", windows.schema, keys)


def _in_deliveries(spark, d, path: str, send) -> None:
    """Alert events in three deliveries, one after the other in time; ``send`` runs after each."""
    alerts = _alerts(spark, d).drop("value")
    at = F.col("event_at")
    first, second = (F.lit(day).cast("timestamp_ntz") for day in ("2024-01-11", "2024-01-21"))
    for delivery in (at < first, (at >= first) & (at < second), at >= second):
        alerts.filter(delivery).write.mode("append").parquet(f"{path}/alerts")
        send(spark.readStream.schema(alerts.schema).parquet(f"{path}/alerts")).awaitTermination()


@query
def stream_throttle(spark, d):
    """The last sent time of each key is kept in the state store."""
    path = scratch_path(spark, "throttle")
    _in_deliveries(
        spark, d, path, lambda s: stateful.run_throttle(s, "event_id", f"{path}/sent", f"{path}/checkpoint", NOISY)
    )
    return spark.read.parquet(f"{path}/sent").filter("not late").select("event_id", "event_at", "alert_id")


@query
def stream_throttle_batches(spark, d):
    """Batch by batch through the batch operator, which splits keys of any size."""
    path = scratch_path(spark, "throttle")
    paths = (f"{path}/sent", f"{path}/state", f"{path}/checkpoint")
    _in_deliveries(spark, d, path, lambda s: ledger_stream.throttle_stream(s, "event_id", *paths, NOISY))
    return spark.read.parquet(f"{path}/sent").select("event_id", "event_at", "alert_id")
