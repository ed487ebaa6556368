"""Cross-tokenizer alignment by the byte offsets at which tokens of both tokenizers end.

Per text, the cumulative ends of the tokens of A and of B are kept in two dictionaries from end to index, held as arrays
over the offsets of a window; the intersection of their key sets, in order, slices both lists of ids into groups. Every token has at least one byte (checked
when the vocabularies are loaded), so in each slice one pair of occurrences ends together, and is linked.

How often a pair of ids is linked in the whole corpus is counted in two steps. The tasks that tokenize
gather documents into blocks and count each block's pairs; the blocks' counts are summed by pair. Then every
block asks for the pairs it holds (not every document for its own), the answers meet the block's documents in a
cogroup, and so no list of all pairs is broadcast or collected. A block has about ``BLOCK`` links between distinct
ids; a longer text is a block of its own.

A: space and text; B: the text, its tokenizer adds the space. A text that is null or empty, or whose tokens' joined
bytes differ from space and text in either, has no tokens. Rows with null or repeated doc_id are aligned each on its own.
An empty table gives an empty result. Other columns are not read. Memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import stored

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Distinct pairs of ids, summed over documents, after which a block is closed.
BLOCK = 500_000
#: Bytes of text whose ends are put into the dictionaries at a time.
WINDOW = 1 << 18
#: Texts tokenized at a time.
TEXTS = 64
#: A pair of ids as one number: the id of A times this, and the id of B.
PAIR = 1 << 31


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        # The merges of a byte-level vocabulary are ranked as its ids, so its file also describes this encoder,
        # which gives the same ids; a test compares them.
        model = json.loads(Path(byte_path).read_text(encoding="utf-8"))["model"]["vocab"]
        alphabet = byte_alphabet()
        specials = {"<|endoftext|>"}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model.items() if token not in specials}
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.a_bytes[i] = data
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        unused = [i for i in range(len(self.b_bytes)) if self.b.is_control(i) or self.b.is_unknown(i)]
        if not all(ranks) or any(not data for i, data in enumerate(self.b_bytes) if i not in unused):
            raise ValueError("a token without bytes")
        self.a_lengths = np.array([len(d) for d in self.a_bytes])
        self.b_lengths = np.array([len(d) for d in self.b_bytes])
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.names = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in ids])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none if their bytes are not space and text."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            data = b" " + text.encode("utf-8", "surrogatepass")
            a = self.a.encode_ordinary(" " + text) if text else []
            same = b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if text and same else ([], [])


@cache
def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    """One for each Python worker."""
    return Vocabularies(byte_path, piece_path)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of A and of B that end together, in order."""
    cuts_a, cuts_b = [], []
    size = int(a_ends[-1]) if len(a_ends) else 0
    for low in range(0, size, WINDOW):
        indexes = []
        for ends in (a_ends, b_ends):
            first, last = np.searchsorted(ends, (low, low + WINDOW), side="right").tolist()
            index = np.full(min(WINDOW, size - low) + 1, -1, dtype=np.int64)
            index[ends[first:last] - low] = np.arange(first, last)
            indexes.append(index)
        common = np.flatnonzero((indexes[0] >= 0) & (indexes[1] >= 0))
        cuts_a.append(indexes[0][common])
        cuts_b.append(indexes[1][common])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *cuts_a]), np.concatenate([none, *cuts_b])


def slices(cuts_a: np.ndarray, cuts_b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Bounds of each group in the ids of A and of B."""
    a0 = b0 = 0
    for a1, b1 in zip((cuts_a + 1).tolist(), (cuts_b + 1).tolist(), strict=True):
        yield a0, a1, b0, b1
        a0, b0 = a1, b1


def groups_sha256(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, names: np.ndarray) -> str:
    """Digest of ``a1,a2|b1;a3|b2,b3``; '' without groups.

    ``names``: each id followed by a comma, then each followed by a bar, then each followed by a semicolon, as bytes of
    one width, filled up with zeros.
    """
    if not len(cuts_a):
        return ""
    third = len(names) // 3
    group_a = np.repeat(np.arange(len(cuts_a)), np.diff(cuts_a, prepend=-1))
    group_b = np.repeat(np.arange(len(cuts_b)), np.diff(cuts_b, prepend=-1))
    before = np.concatenate(([0], cuts_b[:-1] + 1))  # tokens of B in earlier groups
    row = np.empty(len(a) + len(b), dtype=np.int64)
    a, b = a.copy(), b.copy()
    a[cuts_a] += third
    b[cuts_b] += 2 * third
    row[np.arange(len(a)) + before[group_a]] = a
    row[np.arange(len(b)) + (cuts_a + 1)[group_b]] = b
    return hashlib.sha256(names[row].tobytes().translate(None, b"\0")[:-1]).hexdigest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str):
    """(doc_id, ids of A, ids of B, cuts of A, cuts of B) of every row."""
    words = vocabularies(byte_path, piece_path)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            ids, texts = (batch.column(k).slice(at, TEXTS).to_pylist() for k in (0, 1))
            for doc_id, (a, b) in zip(ids, words.encode([t or "" for t in texts]), strict=True):
                a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                cuts = common_ends(np.cumsum(words.a_lengths[a]), np.cumsum(words.b_lengths[b]))
                yield doc_id, a, b, *cuts


def token_groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id and its groups, each with the ids of A and of B."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
        for doc_id, a, b, cuts_a, cuts_b in _encoded(batches, byte_path, piece_path):
            groups = [{"a": a[a0:a1], "b": b[b0:b1]} for a0, a1, b0, b1 in slices(cuts_a, cuts_b)]
            yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([groups], pa.list_(one))], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(each, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


BLOCKS = (
    ("block", "long", pa.int64()),
    ("doc_id", "long", pa.int64()),
    ("n_a", "long", pa.int64()),
    ("n_b", "long", pa.int64()),
    ("n_links", "long", pa.int64()),
    ("groups_sha256", "string", pa.string()),
    ("places", "array<int>", pa.list_(pa.int32())),
    ("times", "array<int>", pa.list_(pa.int32())),
    ("pairs", "array<long>", pa.list_(pa.int64())),
    ("counts", "array<long>", pa.list_(pa.int64())),
)


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, block_links: int) -> DataFrame:
    """Rows of documents (their pairs as places in the block's list) and, per block, one row with that list."""
    names, kinds, types = zip(*BLOCKS, strict=True)

    def closed(number: int, rows: list[tuple]) -> pa.RecordBatch:
        pairs, counts = [r[-2] for r in rows], [r[-1] for r in rows]
        own, place = np.unique(np.concatenate(pairs), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
        places = np.split(place.astype(np.int32), np.cumsum([len(p) for p in pairs])[:-1])
        out = [(number, *r[:-2], p, n.astype(np.int32), None, None) for r, p, n in zip(rows, places, counts, strict=True)]
        out.append((number, *[None] * 7, own, sums))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(byte_path, piece_path)
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for doc_id, a, b, cuts_a, cuts_b in _encoded(batches, byte_path, piece_path):
            pairs, counts = np.unique(a[cuts_a] * PAIR + b[cuts_b], return_counts=True)
            if rows and held + len(pairs) > block_links:
                yield closed(number, rows)
                number, rows, held = number + 1, [], 0
            digest = groups_sha256(a, b, cuts_a, cuts_b, words.names)
            rows.append((doc_id, len(a), len(b), len(cuts_a), digest, pairs, counts))
            held += len(pairs)
        if rows:
            yield closed(number, rows)

    kind = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return _texts(docs).mapInArrow(each, kind)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and best (no pair with the same id of B has more)."""
    each = blocks.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "counts")).alias("pair", "n"))
    sums = each.groupBy("pair").agg(F.sum("n").alias("n"))
    same_b = Window.partitionBy(F.col("pair") % F.lit(PAIR))
    return sums.withColumn("best", F.col("n") == F.max("n").over(same_b))


def link_counts(docs: DataFrame, byte_path: str, piece_path: str, block_links: int = BLOCK) -> DataFrame:
    """a_id, b_id, n and best of every pair of ids that is linked in the corpus."""
    counts = _pair_counts(stored(_blocks(docs, byte_path, piece_path, block_links), "blocks"))
    pair = F.col("pair")
    return counts.select(F.floor(pair / F.lit(PAIR)).alias("a_id"), (pair % F.lit(PAIR)).alias("b_id"), "n", "best")


def align(docs: DataFrame, byte_path: str, piece_path: str, block_links: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = stored(_blocks(docs, byte_path, piece_path, block_links), "blocks")
    asked = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(_pair_counts(blocks), "pair").select(F.col("block").alias("asked"), "place", "n", "best")
    own = blocks.where("pairs is null").drop("pairs", "counts")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def each(rows: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("place").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy()
        sums, bests = [], []
        for places, times in zip(rows.column("places"), rows.column("times"), strict=True):
            places, times = places.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            sums.append(int(n[places] @ times))
            bests.append(int(best[places] @ times))
        links = rows.column("n_links")
        columns = [rows.column(c) for c in ("doc_id", "n_a", "n_b")] + [links, links]
        columns += [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), rows.column("groups_sha256")]
        return pa.table(columns, names)

    kind = ", ".join(f"{c} long" for c in names[:-1]) + ", groups_sha256 string"
    return own.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(each, kind)
