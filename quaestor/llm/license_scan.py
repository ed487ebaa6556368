"""Licence scans by a positional index of rare words, with DataFrame operations only.

The templates are licence notices and the sentences that identify licence texts. Words of templates are weighted by
their inverse document frequency, counted over all documents. The index holds, for every template, the positions of its
``RARE`` rarest words and of its mandatory key phrases. A document with any rare word looks up all its
words of the index; a posting at position q of a template, met at position p of the document, says that the template
begins at p - q. Postings that agree on the beginning are summed. A template is found where all words of its key phrases
agree, and all that agree hold at least ``SHARE`` of the weight of its postings. There is no cap: every rare word of
a document and every place counts. The rarest words are those of each template, so that a corpus in which licences
are frequent is indexed as well.

The base labels are those of ``BASE``: phrases whose words stand consecutively, anywhere.

A null or empty text has no words, no labels and score 0. Rows with null or repeated doc_id are scanned each on its own
(rows are told apart by a stored number). An empty table gives an empty result. Other columns are not read. Memory
grows with the longest text, which is split into words in its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import stored

#: What separates words, after lower-casing A-Z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest words of a template that are indexed, and the share of its indexed weight that has to agree.
RARE = 6
SHARE = 0.6
#: Weights are whole numbers: so many units for a unit of the logarithm.
UNITS = 1000

#: Phrases of the base and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, template, and the phrases of it that must be there (separated by |).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted|copy of this software"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use|source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "with or without fee"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
)


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, BREAK), lambda w: w != "")


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of a fixed list, over the whole table."""
    wanted = F.array(*[F.lit(w) for w in words])
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), wanted), F.lit(""))).alias("w"))
    counts = {r.w: r["count"] for r in found.groupBy("w").count().collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in words}


def _mandatory(words: list[str], phrases: str) -> set[int]:
    """Positions of the key phrases in a template."""
    out = set()
    for phrase in phrases.split("|"):
        parts = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
        out |= set(range(at, at + len(parts)))
    return out


def postings(templates: tuple, total: int, frequency: dict[str, int], rare: int = RARE) -> list[tuple]:
    """Rows of the index: word, template, position, weight, mandatory, rare."""
    weight = {w: round(UNITS * (1 + math.log((1 + total) / (1 + n)))) for w, n in frequency.items()}
    out = []
    for number, (_, text, phrases) in enumerate(templates):
        words = text.split()
        rarest = set(sorted(set(words), key=lambda w: (-weight[w], w))[:rare])
        needed = _mandatory(words, phrases)
        for at, word in enumerate(words):
            if word in rarest or at in needed:
                out.append((word, number, at, weight[word], at in needed, word in rarest))
    return out


def _padded(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _words_in(padded: Column) -> Column:
    """Number of words of a padded text: each has two blanks."""
    return (F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(" "), F.lit("")))) / 2


def _base(base: tuple) -> list[Column]:
    """Places, first and last word, and label of every phrase, in the column ``padded``.

    Words are padded on both sides, so phrases that follow each other do not share a blank.
    """
    out = []
    for phrase, label in base:
        words = phrase.split()
        if any(words[:k] == words[-k:] for k in range(1, len(words))):
            raise ValueError(f"places of {phrase!r} can overlap")
        mark = _padded(phrase)
        without = F.octet_length(F.replace("padded", F.lit(mark), F.lit("")))
        n = ((F.octet_length("padded") - without) / len(mark.encode())).cast("long")
        first = _words_in(F.substring_index("padded", mark, 1)).cast("long")
        last = F.col("n_words") - len(words) - _words_in(F.substring_index("padded", mark, -1)).cast("long")
        there = F.contains("padded", F.lit(mark))
        out.append(F.when(there, F.struct(n.alias("n"), first.alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    return out


def scanned(docs: DataFrame, index: list[tuple], base: tuple = BASE) -> DataFrame:
    """row, doc_id, n_words, the base's places, and ``hits`` (word, place) of the documents with a rare word."""
    rare = F.array(*[F.lit(w) for w in sorted({w for w, *_, is_rare in index if is_rare})])
    indexed = sorted({w for w, *_ in index})
    last_words = F.array(*[F.lit(w) for w in sorted({p.split()[-1] for p, _ in base})])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    pad = F.array_join(F.transform("words", lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    places = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", last_words), pad).alias("padded"),
        F.when(F.arrays_overlap("words", rare), F.filter(places, lambda x: x["word"].isin(indexed))).alias("hits"),
    )
    rows = rows.withColumn("found", F.array_compact(F.array(*_base(base))))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
        F.array_min(F.transform("found", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("found", lambda x: x["last"])).alias("last_word"),
        F.array_distinct(F.transform("found", lambda x: x["label"])).alias("base"),
        "hits",
    )


def found_templates(rows: DataFrame, index: list[tuple], templates: tuple = TEMPLATES, share: float = SHARE) -> DataFrame:
    """row, template, label, start (place of the template's first word) and score of every template found."""
    spark = rows.sparkSession
    kind = "word string, template int, position int, weight long, needed boolean, rare boolean"
    # The index has a row per indexed position of the fixed templates.
    table = F.broadcast(spark.createDataFrame(index, kind))
    totals: dict[int, list[int]] = {}
    for _, number, _, weight, needed, _ in index:
        total = totals.setdefault(number, [0, 0])
        total[0] += weight
        total[1] += needed
    bounds = [(n, templates[n][0], w, k) for n, (w, k) in totals.items()]
    bounds = F.broadcast(spark.createDataFrame(bounds, "template int, label string, total long, phrases long"))
    met = rows.where("hits is not null").select("row", F.inline("hits")).join(table, "word")
    agreed = met.groupBy("row", "template", (F.col("place") - F.col("position")).alias("start")).agg(
        F.sum("weight").alias("weight"), F.sum(F.col("needed").cast("long")).alias("there")
    )
    score = F.col("weight") / F.col("total")
    agreed = agreed.join(bounds, "template").where(F.col("there") == F.col("phrases")).withColumn("score", score)
    return agreed.where(F.col("score") >= share).select("row", "template", "label", "start", "score")


def _index(spark: SparkSession, docs: DataFrame, templates: tuple) -> list[tuple]:
    total, frequency = document_frequency(docs, sorted({w for _, text, _ in templates for w in text.split()}))
    return postings(templates, total, frequency)


def license_labels(docs: DataFrame, templates: tuple = TEMPLATES, base: tuple = BASE, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are sorted and joined by commas; ``score`` is the best agreed share of weight of a template found, else 0.
    """
    index = _index(docs.sparkSession, docs, templates)
    rows = stored(scanned(docs, index, base), "licence-words")
    found = found_templates(rows, index, templates, share)
    # A row has at most one label per template here.
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    every = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return rows.join(best, "row", "left").select(
        "doc_id",
        "n_words",
        F.col("n").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
