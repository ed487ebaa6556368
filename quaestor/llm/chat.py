"""Chat formatting by schema fingerprints.

The nested field paths of a table, or of each JSON record, are hashed; the hash selects a declarative
mapping that turns the layout into canonical turns (conv_id, turn, role, text). Each mapping hashes only the
paths it knows itself, so extra columns or fields do not hide a layout, those of other layouts neither. Of
several mappings that fit the one with most paths is taken, then the first. The paths of an array are those of
all its elements; an element without role or text has an empty one. An unknown layout is an error for a
table; JSON records of unknown layout, null or broken ones are the rows of ``unmatched_json``.

The template marks each turn and escapes control strings inside roles and texts with a backslash, which
``parsed`` takes out again. Null roles and texts are empty. Turns come in order of turn (null first),
then role and text, so ties and repeated rows have one order. ``formatted`` is one row per turn: a
conversation of any length is never held as a whole. Only its digest needs one pass over a conversation in
order, which ``digests`` streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that chat templates read as control marks.
CONTROL = (OPEN, CLOSE, "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``items`` names an array of messages with fields ``role`` and ``text``, and a ``system`` field comes before them;
    without it, ``fields`` lists (role, field) pairs in order; with neither, every row is a turn with columns
    ``turn``, ``role``, ``text``.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "text"
    fields: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("rows by turn", ("role", "text", "turn")),
    Mapping(
        "messages", ("messages", "messages[].content", "messages[].role"), ("system",), items="messages", text="content"
    ),
    Mapping(
        "conversations",
        ("conversations", "conversations[].from", "conversations[].value"),
        ("system",),
        items="conversations",
        role="from",
        text="value",
    ),
    Mapping(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping("prompt and completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(
        "prompt and response",
        ("prompt", "response"),
        ("system",),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
)


def vocabulary(mapping: Mapping) -> list[str]:
    return sorted({*mapping.paths, *mapping.optional})


def fingerprint(paths) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Of each mapping the fingerprints of its paths with any of the optional ones.
REGISTRY = {
    m: {fingerprint((*m.paths, *extra)) for k in range(len(m.optional) + 1) for extra in combinations(m.optional, k)}
    for m in MAPPINGS
}


def mapping_for(paths) -> Mapping | None:
    """The mapping that fits with most paths."""
    known = [(m, set(paths) & set(vocabulary(m))) for m in MAPPINGS]
    fits = [(m, own) for m, own in known if fingerprint(own) in REGISTRY[m]]
    return max(fits, key=lambda f: len(f[1]))[0] if fits else None


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; elements of arrays are marked by []."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for field in kind.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        out += [path, *schema_paths(field.dataType, path)]
    return out


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _role(column: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.coalesce(column, F.lit(""))], _text(column))


def _turns(df: DataFrame, mapping: Mapping, key: str) -> DataFrame:
    if mapping.items:
        items = F.transform(
            mapping.items,
            lambda m: F.struct(_role(m[mapping.role].cast("string")).alias("role"), _text(m[mapping.text]).alias("text")),
        )
        if "system" in mapping.optional and "system" in df.columns:
            first = F.struct(F.lit("system").alias("role"), _text(F.col("system")).alias("text"))
            items = F.when(F.col("system").isNull(), items).otherwise(F.concat(F.array(first), items))
        rows = df.select(F.col(key).alias("conv_id"), F.posexplode(items).alias("turn", "m"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")
    if not mapping.fields:
        turn = F.col("turn").cast("long").alias("turn")
        return df.select(F.col(key).alias("conv_id"), turn, _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    there = [(role, f) for role, f in mapping.fields if f in df.columns]
    items = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f).cast("string").alias("text")) for role, f in there])
    needed = F.filter(items, lambda x: x["text"].isNotNull() | ~x["role"].isin("system"))
    rows = df.select(F.col(key).alias("conv_id"), F.posexplode(needed).alias("turn", "m"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", _text(F.col("m.text")).alias("text"))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table in any known layout."""
    mapping = mapping_for(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no mapping for the layout of columns {df.columns}")
    return _turns(df, mapping, key)


def _marked(df: DataFrame, key: str, column: str) -> DataFrame:
    """_key, _json and the number of the mapping that fits the record, null if none does."""
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.json_object_keys(column), none)
    for items in sorted({m.items for m in MAPPINGS if m.items}):
        elements = F.from_json(column, f"{items} array<string>")[items]
        inner = F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), none)))
        prefix = F.lit(f"{items}[].")
        inner = F.transform(F.array_distinct(inner), lambda k: F.concat(prefix, k))  # noqa: B023
        paths = F.concat(paths, F.coalesce(inner, none))
    rows = df.select(F.col(key).alias("_key"), F.col(column).alias("_json"), paths.alias("_paths"))
    fits = []
    for number, mapping in enumerate(MAPPINGS):
        own = F.array_sort(F.array_intersect("_paths", F.array(*[F.lit(p) for p in vocabulary(mapping)])))
        fit = F.sha2(F.array_join(own, "\n"), 256).isin(*sorted(REGISTRY[mapping]))
        choice = F.struct(F.size(own).alias("paths"), F.lit(-number).alias("place"))
        fits.append(F.when(fit, choice))
    best = F.array_max(F.array(*fits))
    return rows.select("_key", "_json", (-best["place"]).alias("_mapping"))


def canonical_json(df: DataFrame, key: str = "conv_id", column: str = "json") -> DataFrame:
    """The same for JSON records of mixed layouts, each by its own fingerprint."""
    marked, out = _marked(df, key, column), None
    for number, mapping in enumerate(MAPPINGS):
        if mapping.items:
            kind = f"{mapping.items} array<struct<`{mapping.role}`:string, `{mapping.text}`:string>>, system string"
        elif mapping.fields:
            kind = ", ".join(f"`{f}` string" for _, f in mapping.fields)
        else:
            kind = "turn long, role string, text string"
        rows = marked.where(F.col("_mapping") == number).select("_key", F.from_json("_json", kind).alias("r")).select("_key", "r.*")
        turns = _turns(rows, mapping, "_key")
        out = turns if out is None else out.union(turns)
    return out


def unmatched_json(df: DataFrame, key: str = "conv_id", column: str = "json") -> DataFrame:
    """conv_id and json of the records that ``canonical_json`` finds no mapping for."""
    return _marked(df, key, column).where("_mapping is null").select(F.col("_key").alias("conv_id"), F.col("_json").alias("json"))


def escaped(text: Column, line: bool = False) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    heads = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)
    out = F.regexp_replace(out, f"({heads})", r"$1\\")
    return F.regexp_replace(out, "\n", "\\\\\n") if line else out


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in "\\[]()|<>./?*+^$" else c for c in text)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, piece, loss_from and loss_to (code points in the piece; equal if nothing is learned).

    The formatted conversation is its pieces in order. Null conv_id is a conversation of its own.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line=True), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    begin = F.length("head")
    return rows.select(
        *("conv_id", "turn", "role", "text"),
        F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("piece"),
        begin.alias("loss_from"),
        F.when(F.col("role").isin(*learn), begin + F.length("body")).otherwise(begin).alias("loss_to"),
    )


def parsed(pieces: DataFrame) -> DataFrame:
    """Role and text read back from a piece alone, and the learned text under the mask."""
    form = r"(?s)\A" + _quoted(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + _quoted(CLOSE) + r"\n\z"
    learned = F.substring(F.col("piece"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))
    return pieces.select(
        *("conv_id", "turn", "order_role", "order_text"),
        unescaped(F.regexp_extract("piece", form, 1)).alias("role"),
        unescaped(F.regexp_extract("piece", form, 2)).alias("text"),
        unescaped(learned).alias("learned"),
        F.length("piece").alias("chars"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from its pieces in order; a conversation is streamed, not held."""
    turns = parsed(pieces.withColumnsRenamed({"role": "order_role", "text": "order_text"}))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, begun, state = [], False, None

        def finish() -> None:
            conv, n, turns_hash, loss_chars, loss_hash, chars = state
            done.append((conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))

        for batch in batches:
            for conv, role, text, learned, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != state[0]:
                    if begun:
                        finish()
                    begun, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += chars
            if done:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()
        if begun:
            finish()
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "order_role", "order_text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "learned", "chars")
    return rows.mapInArrow(
        each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
