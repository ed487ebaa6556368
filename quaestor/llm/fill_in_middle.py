"""Fill-in-the-middle: cuts at token borders found with a wavelet matrix over character classes.

A token is a run of letters A-Z or a-z, or any one other character. Every code point has a class: a letter
that begins a run, a letter within one, or another character. A wavelet matrix over the classes answers
how many characters of a class stand before a place; the ranks of the two classes that begin tokens add up
to the number of tokens that begin before it, and bisection on that sum finds where a given token begins.

The draws depend on the doc_id only: h1 to h4 are the first four groups of eight hex digits of SHA-256 of
``1:`` and the decimal doc_id. A document is left plain if its text is empty or holds one of the three
marks (so that the marks of the output can be told from the text), or for a share of the draws.

Null text is empty. A null doc_id draws with the empty string in place of the number; rows with equal ids draw
alike, each on its own text. An empty table gives an empty result. Other columns are not read. Each row is worked on
alone, without a shuffle; memory grows with the longest text (about ten bytes per code point).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many begin with the suffix.
SHARE, SPM_SHARE = 90, 20
#: Classes of characters.
OTHER, FIRST, INNER = 0, 1, 2
#: Bytes of bits between two entries of the rank directory.
STRIDE = 64


class _Bits:
    """A bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.packbits(bits)
        ones = np.add.reduceat(np.bitwise_count(self.packed), np.arange(0, len(self.packed), STRIDE), dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones))).tolist()
        self.zeros = len(bits) - self.before[-1]

    def rank1(self, at: int) -> int:
        """Ones among the first ``at`` bits."""
        byte, rest = at >> 3, at & 7
        block = byte // STRIDE
        count = self.before[block] + int.from_bytes(self.packed[block * STRIDE : byte].tobytes()).bit_count()
        return count + (int(self.packed[byte]) >> (8 - rest)).bit_count() if rest else count


class WaveletMatrix:
    """Ranks of the symbols of a sequence: one bit vector per bit, zeros moved before ones at each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, _Bits(ones)))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: int, at: int) -> int:
        """How often the symbol stands among the first ``at``."""
        low, high = 0, at
        for bit, level in self.levels:
            low1, high1 = level.rank1(low), level.rank1(high)
            if symbol >> bit & 1:
                low, high = level.zeros + low1, level.zeros + high1
            else:
                low, high = low - low1, high - high1
        return high - low


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lower = points | np.uint32(0x20)
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    return np.where(inner, INNER, np.where(letter, FIRST, OTHER)).astype(np.uint8)


class Borders:
    """Token borders of a text."""

    def __init__(self, text: str):
        self.size = len(text)
        self.matrix = WaveletMatrix(classes(text), 2) if text else None
        self.tokens = self.before(self.size)

    def before(self, at: int) -> int:
        """Tokens that begin before the place."""
        return self.matrix.rank(OTHER, at) + self.matrix.rank(FIRST, at) if self.matrix else 0

    def start(self, token: int) -> int:
        """Where the token (from 0) begins; the end of the text for the number of tokens."""
        if token >= self.tokens:
            return self.size
        low, high = token, self.size - (self.tokens - token)  # every token has a character at least
        while low < high:
            middle = (low + high) // 2
            if self.before(middle + 1) > token:
                high = middle
            else:
                low = middle + 1
        return low


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    borders = Borders(text)
    n, (h1, h2, h3, h4) = borders.tokens, draws(doc_id)
    if not text or h3 % 100 >= SHARE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (borders.start(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SPM_SHARE:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars and the output text."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = batch.column(0).to_pylist()
                rows = [(i, *cut(i, text.as_py() or "")) for i, text in zip(ids, batch.column(1), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(
        each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and the form alone."""
    mark = len(PREFIX)
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one = F.substr(output, F.lit(mark + 1), second - (mark + 1))
    two = F.substr(output, second + mark, third - second - mark)
    middle = F.substr(output, third + mark)
    return (
        F.when(form == "psm", F.concat(one, middle, two))
        .when(form == "spm", F.concat(two, middle, one))
        .otherwise(output)
    )


def digests(transformed: DataFrame) -> DataFrame:
    """The output and the text rebuilt from it as SHA-256 digests, in place of the output."""
    return transformed.select(
        *[c for c in transformed.columns if c != "output"],
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
