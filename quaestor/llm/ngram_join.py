"""N-gram Jaccard join with prefix trees.

Within a block, the sets are stored in a trie along one global order of n-grams: that of their 64-bit hashes, the
same in every trie, so equal beginnings are stored once. A set walks the trie once for all sets below: the overlap
so far is shared along the path, and a subtree is left when the overlap plus what remains on both sides is too
little for its shortest set. At a leaf the overlap is the exact size of the intersection.

Blocks come from a pigeonhole rule, without loss. Sets that link differ in at most
``d = (1-t)/(1+t) * (|x|+|y|)`` n-grams; hashed into ``d + 1 + e`` parts, at least ``1 + e`` parts are equal in both.
A set with at most ``e`` empty parts so shares a part that is not empty, and only such parts count: none depends on
the size alone. A set with more empty parts adds the parts of a second hash, and so on until one hash leaves few empty;
of two sets that link, the one that needs fewer hashes shares a part with the other under its last. A set emits
the parts of its size class, and of the next class if a partner can lie there.

Exact copies are one set (128-bit digest of all n-grams) from the start, represented by the number of one of
its rows, so sets of rows without id take part too. Links are found in two rounds:

1. Each set joins the block of its most shared part, cut into tries of bounded size by a hash; every one
   also holds the block's smallest set, so copies connect across the cuts. A block is done when its sets
   are all connected or were all compared in one trie.
2. The sets of all blocks that are left are compared in full, in pairs of bounded chunks, where sets known to
   be connected are not compared again. Blocks that overlap form a family; it is compared as a whole if that
   moves fewer sets than its blocks one by one. So no link between unconnected sets is missed.

What moves is kept small: parts are emitted once per task and set, and only those met twice are joined to their sets. Only
texts of sets that share a part are fetched, compressed, by a 128-bit hash of their row, and a bitmap keeps nearly
all others from moving; tries hash them again. ``docs`` is read several times and
must not change in between. Stored tables are removed after their last reader.

N-grams are 64-bit hashes. Null or wordless texts have no n-grams and link with nothing. Rows that repeat
a ``doc_id`` count as one document; rows with a null ``doc_id`` are a document each, and their component is the
smallest doc_id that their links reach, null if they reach none. ``first_documents`` takes every row as a
document, whatever its id. Its other columns are carried along; else only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import discard, stored
from quaestor.llm.graph import components

NGRAM = 3
#: Jaccard threshold as a fraction: den * intersection >= num * union.
THRESHOLD = (9, 10)
#: A trie holds about so many sets and n-grams.
TRIE_SETS = 256
TRIE_NGRAMS = 400_000
CLASS_RATIO = 1.5
#: Bits of the map of wanted texts at most (16 MB).
MAP_BITS = 1 << 27
#: Sets that a task remembers, so that it does not emit the parts of a copy again.
REMEMBERED = 200_000


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a one-to-one map that spreads all bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; a shorter text is one n-gram, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    count = len(words)
    if not count:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=count)
    size = min(n, count)
    total = np.full(count - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = _mixed(total + hashes[k : count - size + 1 + k], k)
    return np.unique(total)


def _classes(limit: int) -> list[int]:
    """Lower bounds of the size classes up to one beyond ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


def part_signatures(grams: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Hashes of the parts of a set, for its size class and the next one within reach."""
    num, den = threshold
    n = len(grams)
    if not n:
        return np.empty(0, dtype=np.int64)
    reach = n * den // num
    bounds = _classes(reach + 1)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    out = []
    for k in range(own, int(np.searchsorted(bounds, reach, side="right"))):
        longest = bounds[k + 1] - 1 if k + 1 < len(bounds) else max(bounds[k] + 1, int(bounds[k] * CLASS_RATIO)) - 1
        differ = (den - num) * 2 * longest // (den + num)
        if not differ:
            continue  # only equal sets link
        spare = 1 + differ // 50
        parts = differ + 1 + spare
        for seed in count():
            values = grams if seed == 0 else np.sort(_mixed(grams, 100 + seed))
            cuts = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)
            starts = np.concatenate(([0], np.searchsorted(values, cuts)))
            full = np.flatnonzero(np.diff(np.concatenate((starts, [n]))))
            sums = np.add.reduceat(_mixed(values, 7), starts[full])
            key = full.astype(np.uint64) + (np.uint64(k) << np.uint64(48)) + (np.uint64(seed) << np.uint64(32))
            out.append(_mixed(_mixed(key) + sums))
            if parts - len(full) <= spare:
                break
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


class _Node:
    __slots__ = ("label", "children", "sets", "shortest", "deepest")

    def __init__(self, label: np.ndarray, shortest: int, deepest: int):
        self.label, self.children, self.sets = label, {}, []
        self.shortest, self.deepest = shortest, deepest  # size of the shortest set below; most n-grams below


class Trie:
    """Sets along their ordered n-grams, with runs of single children as one label."""

    def __init__(self, threshold: tuple[int, int]):
        self.root = _Node(np.empty(0, dtype=np.int64), 1 << 60, 0)
        self.num, self.den = threshold

    def insert(self, path: np.ndarray, name: int) -> None:
        node, at, size = self.root, 0, len(path)
        while True:
            node.shortest = min(node.shortest, size)
            node.deepest = max(node.deepest, size - at)
            if at == size:
                node.sets.append(name)
                return
            child = node.children.get(int(path[at]))
            if child is None:
                child = _Node(path[at:], size, 0)
                child.sets.append(name)
                node.children[int(path[at])] = child
                return
            rest = path[at : at + len(child.label)]
            differ = np.flatnonzero(child.label[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.label):
                upper = _Node(child.label[:same], child.shortest, child.deepest + len(child.label) - same)
                child.label = child.label[same:]
                upper.children[int(child.label[0])] = child
                node.children[int(path[at])] = upper
                child = upper
            node, at = child, at + same

    def linked(self, path: np.ndarray, member: np.ndarray) -> Iterator[tuple[int, int]]:
        """Sets of the trie that may link with ``path``, with their overlap; ``member`` marks its n-grams."""
        num, both, size = self.num, self.num + self.den, len(path)
        stack = [(child, 0) for child in self.root.children.values()]
        while stack:
            node, overlap = stack.pop()
            overlap += int(np.count_nonzero(member[node.label]))
            left = size - int(np.searchsorted(path, node.label[-1], side="right"))
            if both * (overlap + min(left, node.deepest)) < num * (size + node.shortest):
                continue
            for name in node.sets:
                yield name, overlap
            stack.extend((child, overlap) for child in node.children.values())


def links_of(names: list, sets: list[np.ndarray], labels: list, sides: list, threshold: tuple[int, int]) -> list[tuple]:
    """A spanning set of the links between sets of different labels; with two sides, only across them."""
    # Numbers in the order of the hashes; the sets are sorted, so their paths are too.
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    paths = np.split(place, np.cumsum([len(s) for s in sets])[:-1])
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    num, den = threshold
    trie, member, out = Trie(threshold), np.zeros(len(grams), dtype=bool), []
    two = len(set(sides)) > 1
    for i in sorted(range(len(sets)), key=lambda i: (sides[i], len(paths[i]))):
        path = paths[i]
        if two and sides[i] == 0:
            trie.insert(path, i)
            continue
        member[path] = True
        for j, overlap in trie.linked(path, member):
            a, b = root(labels[i]), root(labels[j])
            if a != b and (num + den) * overlap >= num * (len(path) + len(paths[j])):
                parent[a] = b
                out.append((names[i], names[j]))
        member[path] = False
        if not two:
            trie.insert(path, i)
    return out


def _fingerprints(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, tie, tie2, n_shingles, set_id, parts (where the task has not emitted those of the set) and ``row``.

    ``row`` is a number that no other row has, once stored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, older = set(), set()
        for batch in batches:
            sizes, digests, parts = [], [], []
            for text in batch.column(3):
                grams = ngram_set(text.as_py(), n)
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
                known = digest is None or digest in met or digest in older
                sizes.append(len(grams))
                digests.append(digest)
                parts.append(None if known else part_signatures(grams, threshold))
                met.add(digest)
                if len(met) > REMEMBERED:
                    met, older = set(), met
            more = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[:3], *more], names)

    names = ["doc_id", "tie", "tie2", "n_shingles", "set_id", "parts"]
    kind = "doc_id long, tie long, tie2 long, n_shingles long, set_id binary, parts array<long>"
    rows = docs.select("doc_id", "tie", "tie2", "text").mapInArrow(each, kind)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``tie`` no row of ``wanted`` has as ``w_tie``; none of the others is lost.

    A bitmap of the wanted numbers, 16 to 32 bits for each and ``MAP_BITS`` in all at most, goes to every task. If
    it gets full, more rows pass; the join that follows is exact.
    """
    bits = min(MAP_BITS, max(1 << 15, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.col("w_tie"), F.lit(bits))
    maps = wanted.select(F.shiftright(place, 15).alias("piece"), (place % F.lit(1 << 15)).alias("bit"))
    maps = maps.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    place = F.pmod(F.col("tie"), F.lit(bits))
    placed = rows.withColumns({"piece": F.shiftright(place, 15), "bit": place % F.lit(1 << 15)})
    byte = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return placed.join(F.broadcast(maps), "piece").where(found).select(*rows.columns)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` (tie, tie2, text) with the text compressed, so that little moves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [zlib.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column(2)]
            yield pa.record_batch([*batch.columns[:2], pa.array(texts, pa.binary())], ["tie", "tie2", "packed"])

    return rows.mapInArrow(each, "tie long, tie2 long, packed binary")


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return ngram_set(zlib.decompress(packed).decode("utf-8", "surrogatepass"), n)


def _linked(entries: DataFrame, contents: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between labels found in each block of ``entries`` (block, side, rep, label); blocks are of bounded size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

        found = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            members = {rep: (label, side, packed) for _, side, rep, label, packed in group}
            labels, sides, texts = zip(*members.values(), strict=True)
            if len(set(labels)) > 1:
                sets = [_unpacked(packed, n) for packed in texts]
                found += links_of(labels, sets, labels, sides, threshold)
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
                found = []
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = entries.join(contents, "rep").select("block", "side", "rep", "label", "packed")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(each, "a long, b long")


def _cuts(sets: str = "sets", grams: str = "grams"):
    """In how many tries so many sets and n-grams go."""
    return F.greatest(
        F.ceil(F.col(sets) / F.lit(TRIE_SETS)), F.ceil(F.col(grams) / F.lit(TRIE_NGRAMS)), F.lit(1)
    ).cast("long")


def _best_blocks(shared: DataFrame) -> DataFrame:
    """(rep, n, block, low): in the first round each set joins the block of its most shared part, led by ``low``."""
    best = shared.groupBy("rep").agg(F.max(F.struct("sharers", "part", "low", "n")).alias("best"))
    chosen = best.select("rep", "best.part", "best.low", "best.n")
    cuts = chosen.groupBy("part").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).select("part", _cuts().alias("cuts"))
    cut = F.pmod(F.xxhash64("rep"), F.col("cuts"))
    return chosen.join(cuts, "part").select("rep", "n", F.xxhash64("part", cut).alias("block"), "low")


def _still_open(shared: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The parts that can hide a link: not all sets connected, and not all compared in one trie just now.

    Parts shared by the same sets count once.
    """
    tried = members.join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"), F.col("block").alias("tried"))
    label = F.col("label")
    parts = shared.join(tried, "rep").groupBy("part").agg(
        *(F.min(label).alias("low"), F.max(label).alias("high")),
        *(F.min("tried").alias("first"), F.max("tried").alias("last")),
        F.count("*").alias("sharers"),
        *(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")),
    )
    parts = parts.where("low < high and first < last").groupBy("sharers", "x", "y").agg(F.min("part").alias("part"))
    return shared.join(parts.select("part"), "part", "left_semi")


def _groups(shared: DataFrame) -> DataFrame:
    """(part, rep) to compare: for every family all its sets as one part, or its parts if these are smaller."""
    first = shared.where("rep = low").select("rep", "sharers")  # one row a part
    edges = shared.select(F.col("rep").alias("a"), F.col("low").alias("b"))
    family = stored(components(edges).toDF("rep", "family"), "families")
    moved = lambda sets: F.col(sets) * F.ceil(F.col(sets) / F.lit(TRIE_SETS))
    whole = family.groupBy("family").agg(F.count("*").alias("members"))
    parts = first.join(family, "rep").groupBy("family").agg(F.sum(moved("sharers")).alias("moved"))
    chosen = whole.join(parts, "family").select("family", (moved("members") <= F.col("moved")).alias("as_whole"))
    plan = stored(family.join(chosen, "family"), "plan")
    wholes = plan.where("as_whole").select(F.xxhash64("family").alias("part"), "rep")
    return wholes.union(shared.join(plan.where("not as_whole"), "rep").select("part", "rep"))


def _all_chunks(shared: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the second round: chunks of every group, in pairs.

    A label with many sets in the group has chunks of its own, small labels share chunks. Two chunks of one
    label are not paired.
    """
    rows = _groups(shared).join(members.select("rep", "n"), "rep").join(labels, "rep", "left")
    rows = stored(rows.select("part", "rep", "n", F.coalesce("label", "rep").alias("label")), "open")
    per = rows.groupBy("part", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).withColumn("cuts", _cuts())
    small = per.where("cuts = 1").groupBy("part").agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams"))
    small = small.select("part", _cuts().alias("bins"))
    per = per.join(small, "part", "left").select("part", "label", "cuts", "bins")
    chunk = F.when(F.col("cuts") > 1, F.xxhash64("label", F.pmod(F.xxhash64("rep"), F.col("cuts")))).otherwise(
        F.pmod(F.xxhash64("label"), F.col("bins"))
    )
    only = F.when(F.col("cuts") > 1, F.col("label"))
    rows = rows.join(per, ["part", "label"]).select("part", "rep", "label", chunk.alias("chunk"), only.alias("only"))
    chunks = rows.select("part", "chunk", "only").distinct()
    right = chunks.toDF("part", "chunk2", "only2")
    pairs = chunks.join(right, "part").where(
        "chunk < chunk2 and (only is null or only2 is null or only <> only2) or chunk = chunk2 and only is null"
    )
    pairs = pairs.select("part", "chunk", "chunk2", F.xxhash64("part", "chunk", "chunk2").alias("block"))
    one = pairs.select("part", "chunk", "block", F.lit(0).alias("side"))
    two = pairs.where("chunk <> chunk2").select("part", F.col("chunk2").alias("chunk"), "block", F.lit(1).alias("side"))
    return rows.join(one.union(two), ["part", "chunk"]).select("block", "side", "rep", "label")


def _labels(shared: DataFrame, contents: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(rep, label) of all linked sets."""
    members = stored(_best_blocks(shared), "members")
    entries = members.select("block", "rep").union(members.select("block", "low")).distinct()
    entries = entries.select("block", F.lit(0).alias("side"), "rep", F.col("rep").alias("label"))
    links = stored(_linked(entries, contents, n, threshold), "links")
    labels = stored(components(links).toDF("rep", "label"), "labels")
    open_ = stored(_still_open(shared, members, labels), "open")
    if not open_.isEmpty():
        more = stored(_linked(_all_chunks(open_, members, labels), contents, n, threshold), "links")
        if not more.isEmpty():
            # A label is the name of a set too, also that of a set not linked before.
            joined = stored(components(more).toDF("label", "joined"), "joined")
            known = labels.join(joined, "label", "left").select("rep", F.coalesce("joined", "label").alias("label"))
            first, labels = labels, stored(known.union(joined).distinct(), "labels")
            discard(first, joined)
        discard(more)
    discard(members, links, open_)
    return labels


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit hash of all columns, in two parts: equal for equal rows only."""
    text = F.col("text").cast("string").alias("text")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *others)
    # A null is told from a value by its place.
    absent = F.array(*[F.col(c).isNull() for c in docs.columns])
    return docs.withColumns({"tie": F.xxhash64(*docs.columns, absent), "tie2": F.xxhash64(F.lit(2), absent, *docs.columns)})


def _components(keyed: DataFrame, n: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Two tables: the rows (doc_id, tie, tie2, n_shingles, set_id, row); and set_id, label (equal for linked
    sets) and ``best``, the first row of the set: the one with the smallest doc_id, then by its hash.
    """
    prints = stored(_fingerprints(keyed, n, threshold), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tie", "tie2", "row")).alias("best")
    sets = prints.where("set_id is not null").groupBy("set_id").agg(best, F.max("n_shingles").alias("n"))
    sets = stored(sets.withColumn("rep", F.col("best.row")), "sets")
    emitting = prints.where("parts is not null")
    reps = stored(emitting.join(sets.select("set_id", "rep", "n"), "set_id").select("row", "rep", "n"), "reps")
    postings = emitting.select("row", F.explode("parts").alias("part"))
    # Parts of two rows at least, told by two numbers per part, so that a part of very many sets is combined before it moves.
    # Rows of one set count twice here; which set a row has is looked up for the few postings that are left.
    several = postings.groupBy("part").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    several = stored(several.where("low < high").select("part"), "several")
    meeting = postings.join(several, "part").join(reps, "row")
    sharing = stored(meeting.select("part", "rep", "n").distinct(), "sharing")
    sharers = sharing.groupBy("part").agg(F.count(F.lit(1)).alias("sharers"), F.min("rep").alias("low")).where("sharers > 1")
    shared = stored(sharing.join(sharers, "part"), "shared")
    rows = stored(prints.drop("parts"), "rows")
    discard(prints, reps, several, sharing)
    ties = F.col("best.tie").alias("w_tie"), F.col("best.tie2").alias("w_tie2")
    wanted = stored(shared.select("rep").distinct().join(sets.select("rep", *ties), "rep"), "wanted")
    packed = _packed(_likely(keyed.select("tie", "tie2", "text"), wanted))
    own = (F.col("tie") == F.col("w_tie")) & (F.col("tie2") == F.col("w_tie2"))
    contents = stored(packed.join(wanted, own).select("rep", "packed"), "contents")
    labels = _labels(shared, contents, n, threshold)
    labelled = sets.join(labels, "rep", "left").select("set_id", F.coalesce("label", "rep").alias("label"), "best")
    labelled = stored(labelled, "labelled")
    discard(shared, wanted, contents, labels, sets)
    return rows, labelled


def _same_ids(prints: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` where those that rows of one doc_id have are linked as well."""
    rows = prints.where("set_id is not null and doc_id is not null").select("doc_id", "set_id")
    again = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(rows.join(again, "doc_id", "left_semi").distinct(), "again")
    if again.isEmpty():
        return sets
    ends = again.join(sets, "set_id").select("doc_id", "label").distinct()
    least = ends.groupBy("doc_id").agg(F.min("label").alias("least"))
    edges = ends.join(least, "doc_id").where("label > least").select(F.col("label").alias("a"), F.col("least").alias("b"))
    joined = components(edges).toDF("label", "joined")
    return sets.join(joined, "label", "left").select("set_id", F.coalesce("joined", "label").alias("label"), "best")


def jaccard_components(docs: DataFrame, n: int = NGRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) per row of ``docs``."""
    prints, sets = _components(_keyed(docs.select("doc_id", "text")), n, threshold)
    sets = _same_ids(prints, sets)
    least = sets.groupBy("label").agg(F.min("best.doc_id").alias("component_id"))
    known = sets.join(least, "label").select("set_id", "component_id")
    return prints.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def first_documents(docs: DataFrame, n: int = NGRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those linked to a row that stays: of each component the first row, by doc_id.

    Every row is a document of its own, also if its doc_id is null or repeated. Of fully equal rows with words one stays.
    """
    keyed = _keyed(docs)
    rows, sets = _components(keyed, n, threshold)
    first = sets.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias("kept_row"))
    judged = rows.where("set_id is not null").join(first, F.col("row") == F.col("kept_row"), "left")
    ties = judged.groupBy("tie", "tie2").agg(F.count("kept_row").alias("kept"), F.count(F.lit(1)).alias("rows"))
    ties = stored(ties.where("kept < rows"), "dropped")
    discard(rows, sets)
    # Rows all of whose equals go, then equal rows of which one stays.
    out = keyed.join(ties.select("tie", "tie2"), ["tie", "tie2"], "left_anti").select(*docs.columns)
    some = ties.where("kept > 0").select("tie", "tie2")
    if some.isEmpty():
        return out
    one = keyed.join(some, ["tie", "tie2"], "left_semi").dropDuplicates(["tie", "tie2"])
    return out.unionByName(one.select(*docs.columns))
