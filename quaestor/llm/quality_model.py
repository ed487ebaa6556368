"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Documents with the same
votes are alike to the label model, so expectation-maximisation runs over the counts of vote patterns (at
most 3 to the number of labellers, whatever the corpus) and estimates the accuracy of each labeller. The
posteriors of a bounded sample of documents (``TRAIN_DOCS``, drawn by a hash of doc_id) train a linear
scorer on hashed byte trigrams, which scores every whole text.

A null or empty text is scored like any other (0 trigrams; it has too few words, so its posterior is bad).
Columns other than doc_id and text are not read; labels of the corpus are never used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm import quality_rules
from quaestor.llm.linear import squared_hinge, trigram_vector, vectors

TRAIN_DOCS = 3_000

#: Each votes bad if the first condition holds, good if the second does, else abstains.
LABELLERS = (
    ("words", "n_words < 10", "n_words >= 30"),
    ("repeated words", "100 * n_repeat_words > 20 * n_words", "20 * n_repeat_words <= n_words and n_words >= 10"),
    ("symbols", "10 * n_symbols > n_words and n_words > 0", "100 * n_symbols <= n_words and n_words >= 10"),
    ("shouting", "10 * n_shouted > 3 * n_words and n_words > 0", "100 * n_shouted <= 5 * n_words and n_words >= 10"),
    ("stop words", "n_words >= 20 and 100 * n_stop_words < 3 * n_words", "n_words >= 20 and 100 * n_stop_words >= 8 * n_words"),
    ("lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines", "n_lines >= 4 and n_dup_lines = 0"),
    ("word length", "n_words > 0 and not (word_chars between 3 * n_words and 9 * n_words)", "word_chars between 4 * n_words and 7 * n_words"),
)


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each pattern (b, g or - per labeller), and P(vote | class) per labeller."""
    if not patterns:
        return {}, np.zeros((0, 3, 2))
    votes = np.array([["bg-".index(v) for v in p] for p in patterns]).reshape(len(patterns), -1)
    n = np.array(counts, dtype=float)
    good = (votes == 1).sum(axis=1)
    posterior = (good + 1) / (good + (votes == 0).sum(axis=1) * 2 + 2)
    table = np.zeros((votes.shape[1], 3, 2))
    for _ in range(rounds):
        each = np.stack([n * (1 - posterior), n * posterior], axis=1)
        for k in range(votes.shape[1]):
            for v in range(3):
                table[k, v] = each[votes[:, k] == v].sum(axis=0) + 1
        table /= table.sum(axis=1, keepdims=True)
        log = np.log(each.sum(axis=0) + 1)
        for k in range(votes.shape[1]):
            log = log + np.log(table[k, votes[:, k]])
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return dict(zip(patterns, posterior.tolist(), strict=True)), table


def voted(docs: DataFrame) -> DataFrame:
    """The row of each document, and its votes as a string of b, g and -."""
    rows = quality_rules.measured(docs, ("doc_id", "text"))
    vote = [F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for _, bad, good in LABELLERS]
    return rows.select("row.doc_id", "row.text", F.concat(*vote).alias("votes"))


def score(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, votes, weak_label (posterior of good), score (0 to 1) and kept."""
    rows = voted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = rows.groupBy("votes").count().orderBy("votes").collect()
    posterior, _ = expectation_maximisation([r.votes for r in found], [r["count"] for r in found])
    total = sum(r["count"] for r in found)
    table = rows.sparkSession.createDataFrame(list(posterior.items()), "votes string, weak_label double")
    labelled = rows.join(F.broadcast(table), "votes")
    # By id and text, so that rows without id are drawn one by one; never more than ``train_docs`` rows.
    chance = F.pmod(F.xxhash64(F.lit(2), F.col("doc_id").isNull(), "doc_id", "text"), F.lit(1_000_000))
    drawn = labelled.where(chance < int(1e6 * min(1.0, train_docs / max(total, 1)) + 1))
    drawn = drawn.orderBy(F.xxhash64("text", "doc_id")).limit(train_docs)
    x, y = vectors(drawn, "weak_label", "double")
    y = np.array(y, dtype=float)
    sides = [(y > 0.5).sum(), (y <= 0.5).sum()]
    weights = np.zeros((1 << 12) + 1)
    if min(sides):
        sign = np.where(y > 0.5, 1.0, -1.0)
        weights = squared_hinge(x, sign, np.abs(2 * y - 1) / np.where(sign > 0, *sides) / 2)
    elif len(y):
        weights[-1] = 1.0 if sides[0] else -1.0
    weights = weights.astype(np.float32)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([float(weights[:-1] @ trigram_vector(t.as_py() or "") + weights[-1]) for t in batch.column(3)])
            scores = 1 / (1 + np.exp(-4 * margins))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.float64()), pa.array(scores >= 0.5, pa.bool_())]
            yield pa.record_batch(columns, ["doc_id", "votes", "weak_label", "score", "kept"])

    out = labelled.select("doc_id", "votes", "weak_label", "text")
    return out.mapInArrow(each, "doc_id long, votes string, weak_label double, score double, kept boolean")
