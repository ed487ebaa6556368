"""Best-fit packing of token sequences by a plan over the histogram of lengths.

Tokenising cuts a document into pieces of at most ``capacity`` tokens. Best fit runs over the counts per
length, longest first, on groups of bins with equal room, so its work depends on ``capacity`` and not
on the number of documents. The plan gives every range of ranks within a length its sequences and
offsets; pieces take their slot by joining on their rank within the length. The histogram (at most
``capacity`` rows) is collected, and the plan is broadcast: for each length best fit touches each group of
equal bins once, so its rows are bounded by the groups, whatever the corpus.

A null text is empty and has one piece, the end token. Rows with equal or null ``doc_id`` are packed
each on its own. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import buckets_for, running_offsets, stored

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words a Python worker remembers before it forgets those it has not met since the last time.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes, equal to what the tokenizer gives for the whole text.

    The tokenizer splits a text into words and encodes each on its own. So words are found with its own
    split pattern and each is encoded once. Texts with characters for which its normaliser is not plain
    lower case, or with its special strings, go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            last[i] = token.endswith("</w>")
        self.last = last
        latin = [chr(i) for i in range(0xA1, 0x250)] + [chr(i) for i in range(0x21, 0x7F)]
        letters = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "L"))
        numbers = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "N"))
        self.words = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\x20\x09-\x0D{letters}{numbers}]+"
        )
        self.plain = re.compile("[\\x09-\\x0D\\x20-\\x7E\\u00A1-\\u012F\\u0131-\\u024F]*")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, words: set[str]) -> None:
        todo = list(words)
        for at in range(0, len(todo), 1000):
            part = todo[at : at + 1000]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer does not mark the end of each word")
            begin = 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.known[word] = ids[begin:end].tobytes()
                begin = end

    def encode(self, text: str) -> bytes:
        if not self.plain.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.words.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {}
            new = {w for w in words if w not in self.known}
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            self._learn({w for w in new if w not in self.known})
            return b"".join(map(self.known.__getitem__, words))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker: later tasks find the words that earlier ones met."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with ``ids`` the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer)
        size = 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokens.encode(text.as_py() or "") + bytes(4)
                for at in range(0, len(data), size):
                    part = data[at : at + size]
                    row = (doc, at // size, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if ids else row)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECES + ", ids array<int>" * ids)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts per length.

    Rows of the plan: length, first rank, end rank, first sequence, pieces a sequence takes, offset of
    the first of them. Rank r of the length goes to sequence ``first + (r - first_rank) // per`` at
    ``offset + (r - first_rank) % per * length``.
    """
    plan, rooms, opened = [], {}, 0  # rooms: room left -> groups of bins (first sequence, number)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, per = capacity, capacity // length
                bins = (opened, -(-left // per))
                opened += bins[1]
            else:
                per, groups = room // length, rooms[room]
                bins = groups.pop()
                if not groups:
                    del rooms[room]
            first, number = bins
            full = min(number, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - room))
                rooms.setdefault(room - per * length, []).append((first, full))
                rank, left, first, number = rank + full * per, left - full * per, first + full, number - full
            if number and left:
                plan.append((length, rank, rank + left, first, left, capacity - room))
                rooms.setdefault(room - left * length, []).append((first, 1))
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            if number:
                rooms.setdefault(room, []).append((first, number))
        rooms.pop(0, None)
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset; with ``ids`` also their tokens."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, ids), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit(histogram, capacity),
        "p_length long, rank_from long, rank_to long, first long, per long, base long",
    )
    ranked = running_offsets(
        pieces,
        ["length"],
        ["doc_id", "piece", "ids_crc32"],
        F.lit(1),
        buckets_for(sum(histogram.values())),
        "rank",
    )
    own = (F.col("length") == F.col("p_length")) & F.col("rank").between(
        F.col("rank_from"), F.col("rank_to") - 1
    )
    place = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(plan), own).select(
        *pieces.columns,
        (F.col("first") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + place % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its tokens, of pieces packed with ``ids``; at most ``capacity`` tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
