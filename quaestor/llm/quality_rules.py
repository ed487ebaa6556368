"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

``measured`` adds the counts of a text as columns, ``verdict`` compiles the rows of ``RULES`` into one
boolean. A null text has no words. A text without words fails the base rule. A rule does not
apply where its denominator is below ``least`` (1 unless stated). Other columns of the input are kept or dropped by the caller and never read.

``n_repeat_words`` counts the words covered by five-word windows that occur twice or more. Windows are
compared by a 64-bit hash first; only windows with an equal hash are compared as texts, so the count is
exact. Every array has its own projection: a lambda that refers to a column reads it, whereas one that
refers to an expression would compute it anew for each element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "was", "be", "it", "as", "are"),
    *("der", "die", "das", "und", "in", "zu", "den", "nicht", "von", "mit", "ist", "ein", "auf", "im"),
    *("le", "la", "les", "de", "des", "et", "un", "une", "en", "dans", "est", "que", "pour", "du", "au"),
    *("el", "los", "las", "y", "del", "se", "por", "con", "una", "para", "es", "al", "lo", "como", "no"),
)


STOP_FORMS = sorted({form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())})


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= numerator / denominator <= high``, or if the denominator is below ``least``."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")
    least: int = 1


#: Columns of ``measured`` that rules may name.
RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols per word", "n_symbols", "n_words", high=0.10),
    Rule("shouted words", "n_shouted", "n_words", high=0.30),
    Rule("stop words", "n_stop_words", "n_words", low=0.02, least=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.30, least=4),
)


def measured(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carried`` columns, under a struct ``row``, and the counts of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*carried).alias("row"), text.alias("t"))
    rows = rows.select(
        "row",
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}{4,}")).cast("long").alias("n_shouted"),
        F.filter(F.split("t", rf"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))).alias("lines"),
    )
    stop_words = F.filter("words", lambda w: w.isin(*STOP_FORMS))
    rows = rows.select(
        "row",
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_shouted",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(stop_words).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"),
    )
    window = F.transform(
        "word_hashes",
        lambda h, i: F.xxhash64(h, *[F.get(F.col("word_hashes"), i + k) for k in range(1, WINDOW)]),
    )
    hashes = F.slice(window, F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn("hashes", hashes)
    # Only texts with an equal pair of hashes go further.
    ranked = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = rows.withColumn("ranked", ranked)

    def next_to(array: str, field: str):
        def equal(x: Column, j: Column) -> Column:
            before = F.get(F.col(array), j - 1)[field] == x[field]
            after = F.get(F.col(array), j + 1)[field] == x[field]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return equal

    rows = rows.withColumn("pairs", F.filter("ranked", next_to("ranked", "h")))
    rows = rows.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                "pairs",
                lambda x: F.struct(
                    F.concat_ws(" ", *[F.get(F.col("words"), x["i"] + k) for k in range(WINDOW)]).alias("w"),
                    x["i"].alias("i"),
                ),
            )
        ),
    )
    rows = rows.withColumn(
        "starts",
        F.sort_array(F.transform(F.filter("windows", next_to("windows", "w")), lambda x: x["i"])),
    )
    gaps = F.transform(
        "starts", lambda s, j: F.least(F.coalesce(F.get(F.col("starts"), j + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))
    )
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    counts = F.struct(
        *("n_words", "word_chars", "n_symbols", "n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *("n_lines", "n_stop_words", "n_shouted"),
    )
    # A generator of one row: a filter on the counts is not pushed below it, into the lambdas.
    return rows.select("row", F.inline_outer(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        of = F.col(rule.denominator)
        ratio = F.col(rule.numerator) / F.greatest(of, F.lit(1))
        passed = passed & ((of < rule.least) | ratio.between(rule.low, rule.high))
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed, and kept: true if neither the base rule nor the table rejects."""
    rows = measured(docs).withColumn("base_failed", base_failed())
    rows = rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.select("row.doc_id", *[c for c in rows.columns if c != "row"])


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    rows = measured(docs, tuple(docs.columns)).where(~base_failed() & verdict(rules))
    return rows.select("row.*")
