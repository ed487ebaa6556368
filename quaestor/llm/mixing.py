"""Mixing sources to target weights, on blocks of words joined by index.

The words of a source form one stream: its documents in a pseudorandom order, cut into blocks of
``block`` words. The plan on the driver has one row per source and one multinomial draw per output shard,
each from the slots the sources have left, so the totals meet the targets to within one block. Slot j of
a source takes block ``perm(j mod n_blocks)`` of pass ``j div n_blocks``, where every pass has its own
pseudorandom permutation; blocks and documents meet in a join on source and block index.

Targets: sources in order of code point, null last, weigh 5, 2, 1, repeating, and share ``share`` of all
words. A target stops at ``limit`` times its source, and the excess is shared anew by weight.

Null text has size 0. A document of size 0 is returned with ``taken`` 0. Every row has a number of its own, stored
with its size, so rows that repeat a ``doc_id`` or are equal throughout have their own place in the stream and their own
part of what is taken; of equal rows it does not matter which has which. Of the columns of documents those there are
are read, others are not. The sources are collected (one row each, with counts).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import SPACE, WORD, buckets_for, n_words, running_offsets, stored

NAMES = ("doc_id", "text", "lang", "source", "n_chars")
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 32
SHARDS = 64
#: Slots that one task makes.
SLOTS_PER_TASK = 250_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: int = LIMIT) -> list[float]:
    """Words each source gives: by weight, at most ``limit`` times its size, the excess shared anew."""
    goal, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        left = goal - sum(out[i] for i in range(len(sizes)) if i not in open_)
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > limit * sizes[i]}
        for i in over or open_:
            out[i] = float(limit * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        open_ -= over
    return out


def draw(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots per shard and source: multinomial draws from what is left, so columns sum to ``quotas``."""
    rng, left = np.random.default_rng(seed), np.array(quotas, dtype=np.int64)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    for shard in range(shards):
        slots = round(left.sum() / (shards - shard))
        while slots:
            taken = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            out[shard] += taken
            left -= taken
            slots -= int(taken.sum())
    return out


def _identity(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Two hashes that rows share only if they are equal: of id and text, and of all columns of documents."""
    there = [F.col(n).isNull() if null else F.col(n) for n in NAMES if n in docs.columns for null in (True, False)]
    first = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.lit(seed))
    return first.alias("row"), F.xxhash64(F.lit(seed), *there).alias("row2")


def _steps(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """A step coprime to ``n`` and a start: i -> (step * i + start) mod n is a permutation."""
    if n < 2:
        return 1, 0
    step = int(rng.integers(max(1, n // 3), n))
    while math.gcd(step, n) != 1:
        step = step % n + 1
    return step, int(rng.integers(n))


def mix(
    docs: DataFrame, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, shards: int = SHARDS, seed: int = 9
) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents with size, source_size and target; and what is taken.

    ``taken``: shard, slot, pass, row, row2, number, word_from, word_to. ``number`` names the row of the first table,
    ``row`` and ``row2`` its content; words are counted from 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        *_identity(docs, seed),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = stored(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r.size for r in found]
    goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], share, limit)
    blocks = [-(-s // block) for s in sizes]
    quotas = [min(limit * b, round(g * b / s)) if s else 0 for g, b, s in zip(goals, blocks, sizes, strict=True)]
    rng = np.random.default_rng(seed)
    sources = [
        (i, r.source, r.size, goals[i], blocks[i], [_steps(blocks[i], rng) for _ in range(limit)])
        for i, r in enumerate(found)
    ]
    kind = "source_no int, s_source string, source_size long, target double, n_blocks long, steps array<struct<step:long, start:long>>"
    table = spark.createDataFrame(sources, kind)
    counts = draw(quotas, shards, seed) if sum(quotas) else np.zeros((shards, len(quotas)), dtype=np.int64)
    first = counts.cumsum(axis=0) - counts
    plan = [
        (s, i, int(first[s, i]), int(counts[s, i]))
        for s in range(shards)
        for i in range(len(quotas))
        if counts[s, i]
    ]
    plan = spark.createDataFrame(plan, "shard int, source_no int, first long, slots long")

    # Slots: a shard's range is cut into chunks, so that no row expands into an unbounded array.
    chunk = 10_000
    # By number: the adaptive plan would merge the few plan rows into one task, which then made all slots.
    tasks = max(1, -(-sum(quotas) // SLOTS_PER_TASK))
    slots = (
        plan.join(table.select("source_no", "n_blocks", "steps"), "source_no")
        .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long"))))
        .repartition(tasks, "source_no", "shard", "at")
        .withColumn(
            "j", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + chunk, "slots") - 1))
        )
        .withColumns({"pass": F.floor(F.col("j") / F.col("n_blocks")).cast("int"), "i": F.col("j") % F.col("n_blocks")})
        .withColumn("move", F.get("steps", F.col("pass")))
    )
    index = (F.col("i").cast("decimal(19,0)") * F.col("move.step") + F.col("move.start")) % F.col("n_blocks")
    slots = slots.select("source_no", "shard", F.col("j").alias("slot"), "pass", index.cast("long").alias("block"))

    total = sum(r.n for r in found)
    given = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "steps")
    streams = running_offsets(
        given.where("size > 0"), ["source_no"], ["row", "row2"], F.col("size"), buckets_for(total), "start"
    )
    step = F.lit(block).cast("long")
    parts = streams.select(
        "source_no",
        *("row", "row2", "number"),
        "start",
        "size",
        F.explode(
            F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("size") - 1) / step))
        ).alias("block"),
    ).select(
        "source_no",
        *("row", "row2", "number"),
        "block",
        (F.greatest(F.col("block") * step, "start") - F.col("start")).alias("word_from"),
        (F.least((F.col("block") + 1) * step, F.col("start") + F.col("size")) - F.col("start")).alias("word_to"),
    )
    # Slots are exploded from a few plan rows, from whose size the adaptive plan would conclude to broadcast them.
    taken = parts.join(slots.hint("merge"), ["source_no", "block"]).select(
        "shard", "slot", "pass", "row", "row2", "number", "word_from", "word_to"
    )
    return given.select("doc_id", "number", "size", "source_size", "target"), taken


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words the mix takes, repeats counted."""
    given, taken = mix(docs, **options)
    sums = taken.groupBy("number").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return given.join(sums, "number", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass that takes words of a document one row with these words.

    A pass that takes the whole document keeps its text; otherwise the taken words keep the white space after them, but
    for the last. Columns are those of ``docs``; ``n_chars`` is that of the new text. Equal rows have one text, read once.
    """
    _, taken = mix(docs, **options)
    spans = F.sort_array(F.collect_list(F.struct("word_from", "word_to")))
    passes = taken.groupBy("row", "row2", "number", "pass").agg(spans.alias("spans"))
    own = docs.select(*NAMES, *_identity(docs, options.get("seed", 9))).dropDuplicates(["row", "row2"])
    words = F.regexp_extract_all("text", F.lit(f"({WORD}[{SPACE}]*)"), 1)
    count = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["word_to"] - s["word_from"])
    joined = own.join(passes, ["row", "row2"]).withColumn("words", words).withColumn("whole", count == F.size("words"))
    cut = F.flatten(
        F.transform("spans", lambda s: F.slice(F.col("words"), s["word_from"].cast("int") + 1, (s["word_to"] - s["word_from"]).cast("int")))
    )
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.regexp_replace(F.array_join(cut, ""), rf"[{SPACE}]+\z", ""))
    return joined.withColumn("mixed", text).select(
        "doc_id", F.col("mixed").alias("text"), "lang", "source", F.length("mixed").cast("long").alias("n_chars")
    )
