"""Scoring by deliveries: only new rows are scored, with what the last run carried over as their context.

Windows of an account look back a bounded way: N-1 rows, or the days of the longest window. Each delivery therefore
leaves the last such rows of the accounts it touched, and the next one scores its rows behind them. An account whose
new rows do not all come after its old ones is late: old rows behind the first new one see other windows now, so
these are scored again from the account's history. Nothing is rewritten for that. A restart notes account, delivery
and the position from which rows of earlier deliveries no longer count, and :func:`scored` leaves those out.

The table has a commit log (:mod:`quaestor.sources.commits`) with three parts: ``scored``, ``restarts`` and ``recent``.
One manifest publishes all three, so a failed delivery leaves no trace and a repeated one changes nothing.

Positions are (``txn_date``, ``txn_id``), nulls first, as in the row windows; with calendar windows a position is the
start of its day, as all rows of a day see the whole day. Null accounts are one account. Rows equal in account, date
and id have no order among themselves, here as in the windows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaestor.operators.features import aml_features
from quaestor.operators.rules import apply_rules
from quaestor.operators.velocity import window_length
from quaestor.params import AmlParams
from quaestor.session import cut_lineage
from quaestor.sources import commits

#: Folders of carried rows before they are merged.
MAX_FOLDERS = 4
DELIVERY, FROM, NEW = "_delivery", "_from", "_new"


def _longest_days(params: AmlParams) -> int:
    """Days that calendar windows look back on, today included; 0 if there are none."""
    days = [window_length(w) for w in params.velocity_windows] if params.velocity_frame == "days" else []
    return max([*days, *([params.structuring_window_days] if params.min_structuring_txns is not None else [])], default=0)


def _longest_rows(params: AmlParams) -> int:
    return max(map(window_length, params.velocity_windows)) if params.velocity_frame == "rows" else 1


def _position() -> Column:
    return F.struct(F.col("txn_date").alias("at"), F.col("txn_id").cast("string").alias("id"))


def _first_changed(params: AmlParams) -> Column:
    """The position from which a row can change what other rows see."""
    if not _longest_days(params):
        return _position()
    day = F.to_date("txn_date").cast("timestamp_ntz")
    return F.struct(day.alias("at"), F.lit(None).cast("string").alias("id"))


def _by_account(left: DataFrame, right: DataFrame, how: str, *more: Column) -> DataFrame:
    """Joins on the account, nulls equal; the account of ``right`` is named ``_account``."""
    on = F.col("account_id").eqNullSafe(F.col("_account"))
    for condition in more:
        on = on & condition
    return left.join(right, on, how).drop("_account")


def carried(rows: DataFrame, params: AmlParams = AmlParams()) -> DataFrame:
    """The rows of each account that later rows can still see, at least its last one."""
    last = Window.partitionBy("account_id").orderBy(F.col("txn_date").desc(), F.col("txn_id").desc())
    ranked = rows.withColumn("_rank", F.row_number().over(last))
    near, days = F.col("_rank") <= max(1, _longest_rows(params) - 1), _longest_days(params)
    if not days:
        return ranked.filter(near).drop("_rank")
    ends = rows.groupBy(F.col("account_id").alias("_account")).agg(F.max(F.to_date("txn_date")).alias("_end"))
    kept = near | (F.to_date("txn_date") > F.date_sub("_end", days))
    return _by_account(ranked, ends, "inner").filter(kept).drop("_rank", "_end")


def _read(spark: SparkSession, path: str, base: commits.Manifest | None, part: str, schema: StructType) -> DataFrame:
    folders = base.parts.get(part, []) if base else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _newest(recent: DataFrame) -> DataFrame:
    """Of the carried rows those of each account's last delivery."""
    last = recent.groupBy(F.col("account_id").alias("_account")).agg(F.max(DELIVERY).alias("_last"))
    return _by_account(recent, last, "inner", F.col(DELIVERY) == F.col("_last")).drop("_last")


def _counting(spark: SparkSession, path: str, base: commits.Manifest) -> DataFrame:
    """Scored rows that no restart has replaced."""
    rows = _read(spark, path, base, "scored", StructType.fromJson(json.loads(base.schema)))
    if not base.parts.get("restarts"):
        return rows
    restarts = _read(spark, path, base, "restarts", StructType.fromJson(base.notes["restarts"]))
    restarts = restarts.withColumnRenamed(DELIVERY, "_since")
    replaced = (F.col(DELIVERY) < F.col("_since")) & (_position() >= F.col(FROM))
    return _by_account(rows, restarts, "left_anti", replaced)


def score_delivery(ledger: DataFrame, delivery: int, path: str, params: AmlParams = AmlParams()) -> commits.Manifest:
    """Score the rows of a delivery and commit them; numbers ascend, one that was committed changes nothing.

    The same ``params`` and columns belong to a table for good.
    """
    spark, path = ledger.sparkSession, path.rstrip("/")
    base = commits.manifest(spark, path)
    if base is not None and base.notes["delivery"] >= delivery:
        return base
    kind, settings = ledger.schema, repr(params)
    if base is not None and (base.notes["params"] != settings or base.notes["columns"] != ledger.columns):
        raise ValueError("the table was scored with other parameters or columns")
    recent_kind = StructType(kind.fields).add(DELIVERY, "long")
    recent = _read(spark, path, base, "recent", recent_kind)
    ledger = cut_lineage(ledger)
    touched = ledger.groupBy(F.col("account_id").alias("_account")).agg(F.min(_first_changed(params)).alias("_first"))
    context = cut_lineage(_by_account(_newest(recent), touched.select("_account"), "left_semi").select(*kind.names))
    ends = context.groupBy("account_id").agg(F.max(_position()).alias("_end"))
    late = cut_lineage(
        _by_account(ends, touched, "inner").filter(F.col("_first") <= F.col("_end")).select(
            F.col("account_id").alias("_account"), F.col("_first").alias(FROM)
        )
    )
    any_late = not late.isEmpty()
    none = F.lit(None).cast(late.schema[FROM].dataType)
    old = context.withColumn(FROM, none)
    if any_late:
        history = _by_account(_counting(spark, path, base).select(*kind.names), late, "inner")
        old = _by_account(context, late.select("_account"), "left_anti").withColumn(FROM, none).unionByName(history)
    flagged = ledger.withColumn(FROM, none).withColumn(NEW, F.lit(True))
    rows = cut_lineage(flagged.unionByName(old.withColumn(NEW, F.lit(False))))
    changed = F.col(NEW) | F.coalesce(_position() >= F.col(FROM), F.lit(False))
    result = apply_rules(aml_features(rows, params), params).filter(changed).drop(NEW, FROM)
    result = result.withColumn(DELIVERY, F.lit(delivery).cast("long"))

    parts = {k: list(v) for k, v in base.parts.items()} if base else {"scored": [], "restarts": [], "recent": []}
    parts["scored"].append(commits.write_folder(result, path))
    restarts = late.select("_account", FROM, F.lit(delivery).cast("long").alias(DELIVERY))
    if any_late:
        parts["restarts"].append(commits.write_folder(restarts, path))
    kept = carried(rows.select(*kind.names), params).withColumn(DELIVERY, F.lit(delivery).cast("long"))
    parts["recent"].append(commits.write_folder(kept.select(*recent_kind.names), path))
    if len(parts["recent"]) > MAX_FOLDERS:
        pieces = spark.read.schema(recent_kind).parquet(*[f"{path}/{f}" for f in parts["recent"]])
        parts["recent"] = [commits.write_folder(_newest(pieces), path)]
    notes = {
        "delivery": delivery,
        "params": settings,
        "columns": ledger.columns,
        "restarts": json.loads(restarts.schema.json()),
    }
    version = base.version + 1 if base else 0
    return commits.publish(spark, path, commits.Manifest(version, result.schema.json(), parts, notes))


def scored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Every row once, as if all deliveries had been scored together; of the newest or of an older version."""
    path = path.rstrip("/")
    base = commits.manifest(spark, path, version)
    if base is None:
        raise LookupError(f"{path} has no version")
    return _counting(spark, path, base).drop(DELIVERY)


def merge_restarts(spark: SparkSession, path: str) -> commits.Manifest:
    """The next version, with replaced rows left out for good and no restarts; run it when they have become many."""
    path = path.rstrip("/")
    base = commits.manifest(spark, path)
    if base is None or not base.parts["restarts"]:
        return base
    folder = commits.write_folder(_counting(spark, path, base), path)
    parts = {**base.parts, "scored": [folder], "restarts": []}
    return commits.publish(spark, path, commits.Manifest(base.version + 1, base.schema, parts, base.notes))
