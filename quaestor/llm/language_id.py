"""Language identification: the family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the whole text, letters in lower case and other ASCII as blanks.
Family and languages are each told apart by linear support vector machines, one for each pair. They are
fitted on at most ``TRAIN_DOCS`` labelled rows, the same number per language, drawn by a hash of doc_id;
predictions use the text alone.

Rows whose crc32 of doc_id has the remainder 2 by 4 are held out. Rows without doc_id or lang are not
learned from. A null text or one without a letter is ``und`` with score 0; so is every text if no labelled
row is left to learn from. A single learned language is always predicted. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.linear import LETTERS, squared_hinge, trigram_vector, vectors

TRAIN_DOCS = 2_400

#: Language families. Languages that are not listed are each a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sr", "hr", "sl"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _pairs(x: np.ndarray, names: list[str]) -> list[tuple[str, str, np.ndarray]]:
    """One machine for each pair of names; both sides have the same weight."""
    names = np.array(names)
    out = []
    for a, b in combinations(sorted(set(names.tolist())), 2):
        own = (names == a) | (names == b)
        y = np.where(names[own] == a, 1.0, -1.0)
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        out.append((a, b, squared_hinge(x[own], y, weight).astype(np.float32)))
    return out


def train(x: np.ndarray, langs: list[str]) -> dict:
    """{"families": machines, "languages": {family: (languages, machines)}}"""
    families = [family_of(lang) for lang in langs]
    model = {"families": (sorted(set(families)), _pairs(x, families)), "languages": {}}
    for family in model["families"][0]:
        own = np.array([f == family for f in families])
        names = [lang for lang in langs if family_of(lang) == family]
        model["languages"][family] = (sorted(set(names)), _pairs(x[own], names))
    return model


def _decide(names: list[str], machines: list, x: np.ndarray) -> tuple[str, float]:
    """The name with most wins, then the largest sum of margins, and its certainty."""
    wins = {name: [0, 0.0, 1.0] for name in names}
    for a, b, w in machines:
        margin = float(w[:-1] @ x + w[-1])
        for name, m in ((a, margin), (b, -margin)):
            wins[name][0] += m >= 0 if name == a else m > 0
            wins[name][1] += m
            wins[name][2] = min(wins[name][2], 1 / (1 + np.exp(-4 * m)))
    best = max(names, key=lambda n: (wins[n][0], wins[n][1], n))
    return best, float(wins[best][2])


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if not text or not model["families"][0] or not any(map(str.isalpha, text)):
        return "und", 0.0
    x = trigram_vector(text, LETTERS)
    family, sure = _decide(*model["families"], x)
    lang, within = _decide(*model["languages"][family], x)
    return lang, min(1.0, sure * within)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """The model of the labelled rows that are not held out."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {"families": ([], []), "languages": {}}
    each = max(1, train_docs // len(counts))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1_000_000))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1e6 * min(1.0, each / n) + 1)))])
    x, langs = vectors(rows.where(chance < share[F.col("lang")]), "lang", "string", LETTERS)
    return train(x, langs)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    names = ("doc_id", "text", "lang")
    docs = docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string").alias(c) for c in names])
    model = fit(docs, train_docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, text.as_py()) for text in batch.column(2)]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), langs, scores], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")
