"""The two jobs: feed to ledger and balances, and ledger to AML alerts."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import micros
from quaestor.operators import aml_alerts, drift, events, lineage, sla
from quaestor.operators.balance import daily_balance
from quaestor.operators.features import aml_features
from quaestor.operators.quality import quality_metrics, rejection_report
from quaestor.operators.reconcile import mismatches, raise_on_mismatch, recon_summary, reconciliation
from quaestor.operators.rules import aml_metrics, apply_rules
from quaestor.operators.transform import clean_transactions, ledger_of
from quaestor.operators.validate import null_counts, validate_feed
from quaestor.params import AmlParams, JobParams
from quaestor.plans.stages import StageStore
from quaestor.session import cut_lineage
from quaestor.sources import fs, sinks
from quaestor.sources.feed import read_feed_csv, read_ledger


class AmlDetectionError(RuntimeError):
    """The AML job failed."""


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class _Trust:
    """Collects what a run learns about itself and appends it to tables under ``out/trust``."""

    def __init__(self, spark: SparkSession, out: str, params: JobParams):
        self.spark, self.params = spark, params.trust
        self.root = f"{out}/trust"
        self.run_id = uuid.uuid4().hex[:8]
        self.nodes: list[DataFrame] = []
        self.drifts: list[DataFrame] = []
        self.runs: list[tuple] = []
        self.freshness: list[tuple] = []

    def timed(self, process: str, started: datetime) -> None:
        self.runs.append((process, started, _now()))

    def check_drift(self, df: DataFrame, source: str) -> None:
        found = drift.detect_drift(df, source, f"{self.root}/schema_baselines", _now(), self.params)
        self.drifts.append(found)
        self.emit(events.drift_events(found, _now()))

    def emit(self, rows: DataFrame) -> None:
        """Append the events that pass the severity filter and the throttle, also against earlier runs."""
        path, known = f"{self.root}/events", None
        if fs.exists(self.spark, path):
            schema = "event_at timestamp_ntz, category string, title string"
            earlier = self.spark.read.schema(schema).json(path)
            at = F.max(micros(F.col("event_at"))).alias("last_us")
            known = earlier.groupBy(events.throttle_key().alias("key")).agg(at)
        sinks.append_events_json(events.send_events(rows, "message", self.params, last_sent=known), path)

    def sla_metrics(self) -> DataFrame:
        runs = self.spark.createDataFrame(self.runs, "process string, started timestamp_ntz, ended timestamp_ntz")
        metrics = sla.latency_metrics(sla.latency(runs, self.params), self.params.max_processing_minutes)
        if self.freshness:
            seen = self.spark.createDataFrame(self.freshness, "table_name string, last_updated timestamp_ntz")
            now = _now()
            report = sla.freshness(seen, now, self.params)
            metrics = metrics.unionByName(sla.freshness_metrics(report, F.lit(now).cast("timestamp_ntz")))
        return metrics

    def finish(self) -> None:
        sinks.append_events_json(reduce(DataFrame.unionByName, self.nodes), f"{self.root}/lineage")
        found = reduce(DataFrame.unionByName, self.drifts)
        sinks.append_events_json(found, f"{self.root}/drift_events")
        sinks.write_report_json(drift.drift_summary(found), f"{self.root}/drift_summary")
        recent = drift.recent_events(found, ("source", "column_name"))
        sinks.write_report_json(recent, f"{self.root}/drift_recent")
        metrics = self.sla_metrics()
        sinks.append_events_json(metrics, f"{self.root}/sla_metrics")
        sinks.write_report_json(sla.sla_report(metrics), f"{self.root}/sla_report")
        self.emit(events.sla_events(metrics))


def run_ledger_job(
    spark: SparkSession,
    feed_path: str,
    out: str,
    params: JobParams = JobParams(),
    resume: bool = False,
) -> dict[str, str]:
    """Feed -> ledger, daily balances and reports under ``out``; returns the paths.

    Stages are kept under ``out/stages`` until the run succeeds. ``resume=True`` goes on from
    the finished ones of the same configuration and input; by default a run starts afresh.
    """
    out = out.rstrip("/")
    paths = {
        "ledger": f"{out}/ledger_transactions.parquet",
        "daily_balance": f"{out}/daily_account_balance.parquet",
        "quality": f"{out}/data_quality_metrics",
        "rejections": f"{out}/rejection_report",
        "reconciliation": f"{out}/reconciliation.parquet",
        "trust": f"{out}/trust",
    }
    if not fs.exists(spark, feed_path):
        raise FileNotFoundError(feed_path)
    trust = _Trust(spark, out, params)
    store = StageStore(spark, f"{out}/stages", params, [feed_path])
    if not resume:
        store.clear()
    try:
        _ledger_steps(spark, feed_path, paths, params, resume, trust, store)
    except Exception as error:
        trust.emit(events.run_event(spark, "Ledger Run Failed", str(error), _now(), failed=True))
        raise
    store.clear()
    return paths


def _ledger_steps(spark, feed_path, paths, params, resume, trust, store) -> None:
    run = trust.run_id

    def extract():
        raw = read_feed_csv(spark, feed_path, params.feed.required_columns)
        return {"raw": validate_feed(raw, params.feed)}

    started = _now()
    raw = store.run("extract", extract, resume)["raw"]
    modified = datetime.fromtimestamp(fs.last_modified_ms(spark, feed_path) / 1000, timezone.utc)
    trust.freshness.append(("raw_transactions", modified.replace(tzinfo=None)))
    trust.nodes.append(lineage.source_node(raw, run, "raw_transactions", feed_path))
    trust.check_drift(raw, "raw_transactions")
    trust.timed("extract_step", started)

    started = _now()
    clean = store.run("transform", lambda: {"clean": clean_transactions(raw, params.feed)}, resume)["clean"]
    ledger = ledger_of(clean)
    raw_node = f"{run}_source_raw_transactions"
    clean_node, ledger_node = f"{run}_transform_clean", f"{run}_transform_ledger"
    trust.nodes.append(
        lineage.transformation_node(raw, clean, run, "clean", "standardize", raw_node)
    )
    trust.nodes.append(
        lineage.transformation_node(clean, ledger, run, "ledger", "filter_success", clean_node)
    )
    trust.check_drift(clean, "transformed")
    trust.check_drift(ledger, "ledger")
    trust.timed("transform_step", started)

    sinks.write_report_json(quality_metrics(raw, clean, ledger), paths["quality"])
    sinks.write_rejections_csv(rejection_report(clean), paths["rejections"])

    started = _now()
    recon = store.run(
        "reconcile", lambda: {"recon": reconciliation(clean, ledger, params.reconcile.grain)}, resume
    )["recon"]
    tolerance = params.reconcile.tolerance
    trust.emit(events.mismatch_events(mismatches(recon, tolerance), _now()))
    if params.reconcile.fail_on_mismatch:
        raise_on_mismatch(recon, tolerance)
    trust.nodes.append(
        lineage.transformation_node(clean, recon, run, "reconcile", "compare_totals", ledger_node)
    )
    sinks.replace_parquet(recon, paths["reconciliation"])
    sinks.write_report_json(recon_summary(recon), f"{paths['trust']}/reconciliation_summary")
    trust.timed("reconcile_step", started)

    started = _now()
    if not (resume and store.is_done("load")):
        sinks.write_ledger(ledger, paths["ledger"])
        store.save("load", {})
    stored = spark.read.parquet(paths["ledger"])
    trust.nodes.append(
        lineage.sink_node(stored, run, "ledger_output", paths["ledger"], f"{run}_transform_reconcile")
    )
    trust.timed("load_step", started)

    sinks.write_daily_balance(daily_balance(stored), paths["daily_balance"])
    trust.finish()
    trust.emit(events.run_event(spark, "Ledger Run Completed", f"run {run}", _now(), failed=False))


def run_aml_job(
    spark: SparkSession,
    ledger_path: str,
    out: str,
    params: AmlParams = AmlParams(),
    run_time: datetime | None = None,
) -> dict:
    """Ledger -> scored transactions and alerts under ``out``; returns paths and metrics.

    Alerts are derived from the written scored table, so the windows run once; the alert table has one row per
    alert. ``aml_alert_ids`` has the ids of each alert in parts of bounded length, and ``aml_alert_transactions``
    lists every transaction of every alert with its ``alert_id``.
    """
    if not params.enabled:
        return {"status": "disabled"}
    out = out.rstrip("/")
    scored_path = f"{out}/aml_scored_transactions.parquet"
    alerts_path = f"{out}/aml_alerts.parquet"
    parts_path = f"{out}/aml_alert_ids.parquet"
    members_path = f"{out}/aml_alert_transactions.parquet"
    ledger = read_ledger(spark, ledger_path)
    try:
        without_account = null_counts(ledger, ["account_id"]).first()[0]
        if without_account:
            raise ValueError(f"Column account_id has {without_account} null values")
        sinks.replace_parquet(apply_rules(aml_features(ledger, params), params), scored_path)
        scored = spark.read.parquet(scored_path)
        hits = aml_alerts.triggered(scored)
        numbered = cut_lineage(aml_alerts.numbered_alerts(hits, run_time or _now()))
        sinks.write_aml_alerts(aml_alerts.whole_alerts(numbered, hits), alerts_path)
        parts = aml_alerts.with_ids(numbered, hits).select("alert_id", "ids_part", "triggering_txn_ids")
        sinks.write_aml_alerts(parts, parts_path)
        sinks.replace_parquet(aml_alerts.alert_transactions(hits, numbered), members_path)
        metrics = aml_metrics(scored).first().asDict()
        metrics["alerts_generated"] = numbered.count()
    except Exception as error:
        raise AmlDetectionError(f"AML detection failed: {error}") from error
    return {
        "status": "success",
        "scored_transactions_path": scored_path,
        "alerts_path": alerts_path,
        "alert_ids_path": parts_path,
        "alert_transactions_path": members_path,
        "alert_count": metrics["alerts_generated"],
        "high_risk_count": metrics["high_severity"],
        "metrics": metrics,
        "rules": {rule: metrics[f"{rule}_triggers"] for rule in C.AML_RULES},
    }
