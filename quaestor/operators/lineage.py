"""Lineage: nodes for sources, transformations and sinks; walking the graph; fingerprints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.session import stored


def _node(df: DataFrame, node_id: str, node_type: str, name: str, operation: str, **extra) -> DataFrame:
    """One row about ``df``; the row count is an aggregation, nothing is collected."""
    schema = F.lit(df.schema.simpleString())
    fields = {
        "node_id": F.lit(node_id),
        "node_type": F.lit(node_type),
        "name": F.lit(name),
        "operation": F.lit(operation),
        "row_count": F.count(F.lit(1)),
        "input_schema": F.lit(None).cast("string"),
        "output_schema": schema,
        "file_path": F.lit(None).cast("string"),
        "file_hash": F.lit(None).cast("string"),
        "parent_nodes": F.array().cast("array<string>"),
        "input_rows": F.lit(None).cast("bigint"),
        "row_delta": F.lit(None).cast("bigint"),
    }
    fields.update(extra)
    return df.agg(*[c.alias(k) for k, c in fields.items()])


def source_node(df: DataFrame, run_id: str, name: str, path: str, file_hash: str | None = None) -> DataFrame:
    """A source; without a ``file_hash`` its content is fingerprinted in the pass that counts."""
    content = _content_sum(df.columns).cast("string") if file_hash is None else F.lit(file_hash)
    return _node(
        df,
        f"{run_id}_source_{name}",
        "source",
        name,
        "load",
        file_path=F.lit(path),
        file_hash=content,
    )


def transformation_node(
    before: DataFrame, after: DataFrame, run_id: str, name: str, operation: str, parent: str | None
) -> DataFrame:
    """Row counts of input and output and their difference."""
    node = _node(
        after,
        f"{run_id}_transform_{name}",
        "transformation",
        name,
        operation,
        input_schema=F.lit(before.schema.simpleString()),
        parent_nodes=F.array(*([F.lit(parent)] if parent else [])).cast("array<string>"),
    )
    rows_in = before.agg(F.count(F.lit(1))).scalar()
    return node.withColumns({"input_rows": rows_in, "row_delta": F.col("row_count") - rows_in})


def sink_node(df: DataFrame, run_id: str, name: str, path: str, parent: str | None) -> DataFrame:
    return _node(
        df,
        f"{run_id}_sink_{name}",
        "sink",
        name,
        "persist",
        input_schema=F.lit(df.schema.simpleString()),
        output_schema=F.lit(None).cast("string"),
        file_path=F.lit(path),
        parent_nodes=F.array(*([F.lit(parent)] if parent else [])).cast("array<string>"),
    )


def first_parents(nodes: DataFrame) -> DataFrame:
    """Edges ``(node, parent)`` to the first parent of each node that has one."""
    return nodes.select(F.col("node_id").alias("node"), F.get("parent_nodes", F.lit(0)).alias("parent")).filter(
        "parent IS NOT NULL"
    )


def all_parents(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("node"), F.explode("parent_nodes").alias("parent"))


def lineage_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, node, steps)``: each start and its ancestors, ``steps`` edges away.

    ``edges`` holds one parent per node. Order a chain by descending ``steps`` to read it from its
    source. All starts advance together by doubling: after k rounds they know what is less than 2**k
    edges away, and a jump table leads from every node to what is 2**k edges away. So the rounds are
    the logarithm of the longest chain, and the jump table never has more rows than ``edges``. A node
    met again on the same chain keeps its smaller distance, so cycles are safe.
    """
    jumps = edges.select(F.col("node").alias("_from"), F.col("parent").alias("_to")).distinct()
    reached = starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("steps")).distinct()
    jumps, reached = stored(jumps, "jumps"), stored(reached, "reached")
    for k in count():
        further = (
            reached.join(jumps, reached.node == jumps._from)
            .select("start", F.col("_to").alias("node"), (F.col("steps") + (1 << k)).alias("steps"))
            .groupBy("start", "node")
            .agg(F.min("steps").alias("steps"))
            .join(reached, ["start", "node"], "left_anti")
        )
        further = stored(further, "reached")
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        middle = jumps.select(F.col("_from").alias("_middle"), F.col("_to").alias("_end"))
        jumps = stored(
            jumps.join(middle, jumps._to == middle._middle).select("_from", F.col("_end").alias("_to")).distinct(), "jumps"
        )
        if jumps.isEmpty():
            return reached


def lineage_impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start, node, steps)``: everything downstream of each start, once, by shortest path."""
    downstream = edges.select(F.col("parent").alias("_from"), F.col("node").alias("_to"))
    return _walk(downstream, starts).filter("steps > 0")


def _walk(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Breadth-first from all starts; each level is stored to keep plans short. Of what was reached
    before, a level meets only the rows of starts that still advance."""
    frontier = stored(
        starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("steps")).distinct(), "reached"
    )
    reached = frontier
    for depth in count(1):
        step = (
            frontier.join(edges, frontier.node == edges._from)
            .select("start", F.col("_to").alias("node"), F.lit(depth).alias("steps"))
            .distinct()
        )
        active = reached.join(frontier.select("start").distinct(), "start", "left_semi")
        frontier = stored(step.join(active, ["start", "node"], "left_anti"), "reached")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of each file, first 32 digits. For feed files, up to Spark's limit of 2 GB each;
    larger tables have :func:`table_fingerprint`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "length",
        F.substring(F.sha2("content", 256), 1, 32).alias("file_hash"),
    )


def table_fingerprint(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: row count and the sums of both halves of per-row MD5s, the same for any order of rows.

    Every row is hashed where it is read and only sums travel, at any size of table. Give exact
    columns (integers, strings, dates); null is marked apart from the empty string.
    """
    return df.agg(F.count(F.lit(1)).alias("row_count"), _content_sum(columns).alias("fingerprint"))


def _content_sum(columns) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    halves = [F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    return F.concat_ws("-", *[F.sum(half).cast("string") for half in halves])
