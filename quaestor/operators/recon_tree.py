"""Which transactions make feed and ledger differ, found by descending a tree of digests.

Both sides are reduced once to digests per date and leaf bucket (a hash of ``txn_id``): number of rows, and the exact sum of
row hashes, which does not depend on order and counts repeated rows. Coarser levels are sums of these. From the dates down, only
the buckets under a differing parent are compared, so what is looked at shrinks level by level; at the end only rows of
differing leaves meet in a join by ``txn_id``. Equal sides end at the dates.

Rows without a date are in no total and are left out, as in the reconciliation. A null ``txn_id`` is a value of its own.
Ids may repeat: rows of an id are compared by number and exact sum of amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import exact_sum
from quaestor.operators.validate import check_columns
from quaestor.session import cut_lineage

#: Buckets under each node, and levels below the date.
FAN_OUT = 16
LEVELS = 3


def _side(df: DataFrame, amount: str, fan_out: int, levels: int) -> DataFrame:
    """txn_date, txn_id, amount and ``leaf``, the bucket at the lowest level."""
    leaf = F.pmod(F.xxhash64(F.lit("leaf"), F.col("txn_id")), F.lit(fan_out**levels))
    rows = df.filter(F.col("txn_date").isNotNull())
    return rows.select("txn_date", "txn_id", F.col(amount).cast("decimal(28,10)").alias("amount"), leaf.alias("leaf"))


def _digest() -> tuple[Column, Column]:
    row = F.xxhash64("txn_id", F.col("txn_id").isNull(), "amount", F.col("amount").isNull())
    return F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("digest")


def differing_leaves(clean: DataFrame, ledger: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """(txn_date, leaf) of the leaves where successful feed rows and ledger rows differ."""
    return _differing(*_sides(clean, ledger, fan_out, levels), fan_out, levels)


def _sides(clean: DataFrame, ledger: DataFrame, fan_out: int, levels: int) -> tuple[DataFrame, DataFrame]:
    check_columns(clean, ["txn_id", "status_clean", "amount_clean", "txn_date"], "raw columns")
    check_columns(ledger, ["txn_id", "amount", "txn_date"], "ledger columns")
    success = clean.filter(F.col("status_clean") == "SUCCESS")
    return _side(success, "amount_clean", fan_out, levels), _side(ledger, "amount", fan_out, levels)


def _differing(raw: DataFrame, kept: DataFrame, fan_out: int, levels: int) -> DataFrame:
    leaves = [side.groupBy("txn_date", "leaf").agg(*_digest()) for side in (raw, kept)]
    signed = leaves[0].unionByName(leaves[1].withColumns({"rows": -F.col("rows"), "digest": -F.col("digest")}))
    # One row per date and leaf: what the sides differ by. Sums of these are the differences of the coarser levels.
    diffs = signed.groupBy("txn_date", "leaf").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
    diffs = cut_lineage(diffs)
    found = None
    for level in range(levels + 1):
        node = F.floor(F.col("leaf") / F.lit(fan_out ** (levels - level))).alias("node")
        here = diffs.select("txn_date", node, "leaf", "rows", "digest")
        if found is not None:
            parents = found.withColumnRenamed("node", "parent")
            under = here.withColumn("parent", F.floor(F.col("node") / F.lit(fan_out)))
            here = under.join(parents, ["txn_date", "parent"], "left_semi").drop("parent")
        sums = here.groupBy("txn_date", "node").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
        found = sums.filter("rows <> 0 OR digest <> 0").select("txn_date", "node")
    return found.withColumnRenamed("node", "leaf")


def offending_rows(clean: DataFrame, ledger: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """txn_date, txn_id, kind, raw_rows, ledger_rows, raw_amount, ledger_amount of what differs.

    ``kind``: ``missing`` (not in the ledger), ``extra`` (only there) or ``changed`` (other amounts or number of rows).
    """
    raw, kept = _sides(clean, ledger, fan_out, levels)
    leaves = cut_lineage(_differing(raw, kept, fan_out, levels))
    sides = []
    for side, name in ((raw, "raw"), (kept, "ledger")):
        rows = side.join(leaves, ["txn_date", "leaf"], "left_semi").groupBy("txn_date", "txn_id")
        count = F.count(F.lit(1)).alias(f"{name}_rows")
        # A null amount is told from 0 by the number of amounts.
        amounts = F.count("amount").alias(f"{name}_amounts")
        sides.append(rows.agg(count, exact_sum(F.col("amount")).alias(f"{name}_amount"), amounts))
    left, right = sides[0].alias("l"), sides[1].alias("r")
    same = F.col("l.txn_id").eqNullSafe(F.col("r.txn_id")) & (F.col("l.txn_date") == F.col("r.txn_date"))
    joined = left.join(right, same, "full_outer").select(
        F.coalesce("l.txn_date", "r.txn_date").alias("txn_date"),
        F.coalesce("l.txn_id", "r.txn_id").alias("txn_id"),
        *(F.coalesce(f"{n}_{c}", F.lit(0)).cast("long").alias(f"{n}_{c}") for n in ("raw", "ledger") for c in ("rows", "amounts")),
        *("raw_amount", "ledger_amount"),
    )
    changed = (
        (F.col("raw_rows") != F.col("ledger_rows"))
        | (F.col("raw_amounts") != F.col("ledger_amounts"))
        | ~F.col("raw_amount").eqNullSafe(F.col("ledger_amount"))
    )
    kind = F.when(F.col("ledger_rows") == 0, "missing").when(F.col("raw_rows") == 0, "extra").when(changed, "changed")
    return joined.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "txn_date", "txn_id", "kind", "raw_rows", "ledger_rows", "raw_amount", "ledger_amount"
    )
