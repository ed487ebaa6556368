"""Secret scans: candidates by pattern, and a random forest that removes false positives.

Every run of characters of keys and tokens in a word is looked at with what stands before it, also if a word
holds many (compact JSON, code, URLs); after an assignment the run is the whole value. A run is a candidate if
it holds a digit and at least ``LEAST`` characters, or if an assignment or a hint (password, token, key)
stands before it, in the word or in the two words before; then it may be of any length, without digits.
Its features are expressions of built-in functions: length, changes between kinds of characters, how much
of it common words cover, the path and the assignment around it, and the words before and after it. The
forest is trained from labelled findings: rows of ``LABELLED``, whose form alone decides (known key formats
and assigned credentials, against numbers, dates, addresses and placeholders). At most ``TRAIN_ROWS``
labelled candidates, drawn by a hash, are used; the features do not include these forms themselves.

Rows are told apart by a 128-bit hash of doc_id and text, so rows without id or with one id are scanned each on its own;
rows equal in both have one set of findings, which each of them gets. A null or empty text has no candidates. If the labelled findings have one class only, or there are none, a
candidate's probability is its label, else 0. Each class gives half of the ``TRAIN_ROWS`` at most. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import SPACE, stored

LEAST = 12
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 6

HINT = "(?i)pass|token|secret|key|auth|cred"
ASSIGNED = r"""[=:]["'`(\[{ ]*$"""
#: No assignment to a hint stands before.
UNNAMED = r"""^(?!.*(?i:pass|token|secret|key|auth|cred)[^ ]* ?[=:]["'`(\[{ ]*$)"""

#: Where a pattern is looked for, the pattern, another for what stands before the candidate, and the label.
LABELLED = (
    ("candidate", r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])", None, 1.0),
    ("candidate", r".{8,}", r"""(?i)(password|passwd|secret|api_?key)["'`]?[=:]["'`]?$""", 1.0),
    ("candidate", r"[0-9a-f]{32,}", r"""(?i)(token|secret|key)["'`]? ?[=:]["'` ]*$""", 1.0),
    ("around", r"(?i)https?://|www\.", None, 0.0),
    ("around", r"@[\w-]+\.\w+", None, 0.0),
    ("around", r"^[\d\s()+./:,;-]+$", None, 0.0),
    ("candidate", r"^\d{4}-\d\d-\d\d", None, 0.0),
    ("around", r"(?i)example|placeholder|x{6,}", None, 0.0),
    ("candidate", r"^[\d()+./,;-]+$|^\p{L}\p{Ll}*$", UNNAMED, 0.0),
)
COMMON = "the|and|tion|ing|ent|der|die|und|que|les|ment|con|para|ung|test|data|name|user|file|page"
CORE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: An assigned value, else a run of characters of keys.
PAD = r"(?:={1,2}(?![\w+/-]))?"
RUN = rf"""(?<=[=:]["'`]?)[^{SPACE}"'`<>(){{}}\[\],;&=:]+{PAD}|[A-Za-z0-9+/_-]+{PAD}"""
FEATURES = ("length", "changes", "digits", "upper", "hex", "dictionary", "path", "assigned", "hint_before", "plain_before", "plain_after")


def _shifted(name: str, by: int) -> Column:
    """The array with, at each place, what is ``by`` places on; one pass, however long it is."""
    if by < 0:
        return F.concat(F.array(*[F.lit("")] * -by), name)
    return F.slice(name, by + 1, F.greatest(F.size(name) - by, F.lit(0)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both, in two parts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")
    return rows.withColumns({"tie": F.xxhash64(*both), "tie2": F.xxhash64(F.lit(6), *both)})


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, tie, tie2, word_index, place in the word, candidate, left, around, after.

    ``left`` is what stands before: two words for the first run of a word, else the run before and what is between.
    ``around`` also has the candidate and the two runs after it in the word.
    """
    words = F.filter(F.split("text", rf"[{SPACE}]+"), lambda w: w != "")
    own = ("doc_id", "tie", "tie2")
    rows = _keyed(docs).select(*own, words.alias("words"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    number = F.sequence(F.lit(0), F.size("words"))
    spread = F.arrays_zip(
        number.alias("i"), F.col("words").alias("w"), *(_shifted("words", k).alias(n) for n, k in (("b", -2), ("a", -1), ("after", 1)))
    )
    long_run = lambda c: (F.length(c) >= LEAST) & F.rlike(c, F.lit("[0-9]")) & F.rlike(c, F.lit(CORE))
    wanted = F.filter(
        spread,
        lambda x: x["w"].isNotNull()
        & (
            long_run(x["w"])
            | F.rlike(x["w"], F.lit("[=:]."))
            | F.rlike(x["a"], F.lit(ASSIGNED))
            | F.rlike(F.concat_ws(" ", x["b"], x["a"], x["w"]), F.lit(HINT))
        ),
    )
    rows = rows.withColumn("wanted", wanted).where(F.size("wanted") > 0).select(*own, F.explode("wanted").alias("x"))
    rows = rows.select(
        *own,
        F.col("x.i").alias("word_index"),
        F.col("x.w").alias("word"),
        F.concat_ws(" ", "x.b", "x.a", F.lit("")).alias("before"),
        blank(F.col("x.after")).alias("next"),
    )
    # The sign of an assignment that ends the word before stands before the word, so that its value is one run.
    marked = F.when(F.rlike("before", F.lit(ASSIGNED)), F.concat(F.lit(":"), "word")).otherwise(F.col("word"))
    rows = rows.withColumn("marked", marked)
    rows = rows.withColumns({"runs": F.regexp_extract_all("marked", F.lit(RUN), F.lit(0)), "gaps": F.split("marked", RUN)})
    steps = (("r0", "runs", -1), ("g0", "gaps", 0), ("r1", "runs", 0), ("g1", "gaps", 1), ("r2", "runs", 1), ("g2", "gaps", 2), ("r3", "runs", 2))
    places = F.sequence(F.lit(0), F.size("runs")).alias("place")
    zipped = F.arrays_zip(places, *(_shifted(column, by).alias(name) for name, column, by in steps))
    rows = rows.select(*own, "word_index", "before", "next", F.size("runs").alias("n"), F.explode(zipped).alias("x"))
    rows = rows.where("x.r1 is not null").select(
        *own,
        "word_index",
        F.col("x.place").alias("place"),
        F.col("x.r1").alias("candidate"),
        F.when(F.col("x.place") == 0, F.concat("before", F.regexp_replace("x.g0", "^:", "")))
        .otherwise(F.concat("x.r0", "x.g0"))
        .alias("left"),
        F.concat(*(blank(F.col(f"x.{name}")) for name, _, _ in steps)).alias("around"),
        F.when(F.col("x.place") == F.col("n") - 1, F.col("next")).otherwise("").alias("after"),
    )
    led = F.rlike("left", F.lit(ASSIGNED)) | F.rlike("left", F.lit(HINT))
    return rows.where(long_run(F.col("candidate")) | led)


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.greatest(F.length("candidate"), F.lit(1))


def featured(rows: DataFrame) -> DataFrame:
    flag = lambda c: c.cast("double")
    left = F.length(F.regexp_replace(F.lower("candidate"), COMMON, ""))
    return rows.withColumns(
        {
            "length": F.length("candidate").cast("double"),
            "changes": _share(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"),
            "digits": _share("[0-9]"),
            "upper": _share("[A-Z]"),
            "hex": flag(F.rlike("candidate", F.lit("^[0-9a-fA-F]+$"))),
            "dictionary": 1 - left / F.length("candidate"),
            "path": F.regexp_count("around", F.lit(r"[/\\.]")).cast("double"),
            "assigned": flag(F.rlike("left", F.lit(ASSIGNED))),
            "hint_before": flag(F.rlike("left", F.lit(HINT))),
            "plain_before": flag(F.rlike("left", F.lit(r"(^|\s)\p{L}+[.,]? $"))),
            "plain_after": flag(F.rlike("after", F.lit(r"^\p{L}+[.,]?$"))),
        }
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Adds ``label``: 1 or 0 for labelled findings, else null."""
    label = F.lit(None).cast("double")
    for where, form, left, value in reversed(LABELLED):
        found = F.rlike(where, F.lit(form))
        if left:
            found = found & F.rlike("left", F.lit(left))
        label = F.when(found, F.lit(value)).otherwise(label)
    return rows.withColumn("label", label)


def scan(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, tie, tie2, word_index, candidate, probability, is_secret; once for equal rows."""
    rows = candidates(docs).dropDuplicates(["tie", "tie2", "word_index", "place"])
    rows = stored(labelled(featured(rows)), "candidates")
    per = {r.label: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    if len(per) < 2:
        sure = F.coalesce("label", F.lit(0.0))
    else:
        one, zero = (int(1e6 * min(1.0, train_rows / 2 / per[k]) + 1) for k in (1.0, 0.0))
        share = F.when(F.col("label") == 1, one).otherwise(zero)
        chance = F.pmod(F.xxhash64("tie", "word_index", "place"), F.lit(1_000_000))
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        known = assemble.transform(rows.where("label is not null").where(chance < share))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=6).fit(known.select("features", "label"))
        rows = forest.transform(assemble.transform(rows))
        sure = vector_to_array(F.col("probability"))[1]
    out = rows.select("doc_id", "tie", "tie2", "word_index", "candidate", sure.alias("p"))
    return out.select("doc_id", "tie", "tie2", "word_index", "candidate", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))


def findings(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets and the word indexes of its secrets."""
    found = scan(docs, **options).groupBy("tie", "tie2").agg(
        F.count("*").alias("n_candidates"),
        F.sum(F.col("is_secret").cast("long")).alias("n_secrets"),
        F.sort_array(F.collect_set(F.when(F.col("is_secret"), F.col("word_index")))).alias("secret_words"),
    )
    zero = F.lit(0).cast("long")
    return _keyed(docs).select("doc_id", "tie", "tie2").join(found, ["tie", "tie2"], "left").select(
        "doc_id",
        F.coalesce("n_candidates", zero).alias("n_candidates"),
        F.coalesce("n_secrets", zero).alias("n_secrets"),
        F.coalesce("secret_words", F.array().cast("array<int>")).alias("secret_words"),
    )
