"""Near-duplicate join on word shingles: Jaccard similarity of 0.8 or more, exact, by signature trees.

1. Texts with equal shingle sets are one class, named by a 64-bit hash of the set; from there on
   a row is a class, so groups of copies cost one row.
2. A pair that reaches the threshold shares a shingle among the first ``n - ceil(t n) + 1`` of
   either set in any common order. The order puts shingles last that are frequent in one of ``SAMPLE``
   documents. The sample shapes the order alone: no link depends on it.
3. The smaller set of such a pair has the pair's first common shingle even among its first ``n - ceil(2 t n / (1 + t)) + 1``,
   as the union is at least as large as itself; there it stands in *front*. A shingle that stands in front of no class brings
   no pair together, so the shingles of a template, which come late in the order, gather nobody. Each other shingle that two classes share in
   their prefixes is led by the class with the largest hash; classes gather under the leaders of their shingles, so a pair that
   could link meets under a leader, and copies with many shared shingles meet under a few. Shingles are counted first; those that
   gather somebody fill a Bloom filter, so that only they, and few others by chance, move again with their classes.
4. Groups are cut into blocks of about ``BLOCK``, each with the leader. In a block a signature
   tree over rows in order of their bitmaps holds OR-combined bitmaps, size ranges and least bit
   counts; walking pairs of nodes from the root, those whose greatest possible overlap is too small
   are dropped, down to pairs of rows. A first walk, over bitmaps of four to eight bits for each shingle,
   drops the members that no partner could reach, so whole sets move only for the rest: their texts are found in a scan by a
   Bloom filter of ids and hashes, and no other text moves; a second
   walk verifies on the sets. Pairs already connected are not verified, so a block yields at most as
   many links as rows.
5. Groups of several blocks whose members are then in one component are done. The members of the
   others are cut into blocks by size band; a tree over the *blocks* of each two neighbouring bands
   walks pairs of blocks in the same way, and only the pairs left meet, as blocks of step 4. Blocks
   that lie in the group's largest component don't meet each other, nor do blocks without a class in front. OR-combined
   bitmaps of unlike sets soon hold all bits, so this walk prunes by size and by clusters of like sets; where many unlike classes
   have one frequent shingle in front, pairs of their blocks do meet.
6. Components of all links.

No cap drops a candidate.

Defined cases: words are pieces between U+0020 and U+0009 to U+000D after A-Z are lower-cased;
a text with fewer than five words is one shingle; without words its set is empty and links with
nothing; rows that share an id stay rows of their own and each gets its text's component; rows
with a null id link with nothing and get a null component; ids may be of any type with an order;
texts of any length are taken whole; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, bloom, passes, require, slices
from .components import components

SHINGLE, BLOCK = 5, 128
NUM, DEN = 80, 100  # the threshold as a ratio of integers
#: Rows of a lowest node and children of the others.
LEAF, FAN = 2, 4
#: One of so many documents tells which shingles are frequent: those in at least OFTEN of them, MOST_FREQUENT at most (16 bytes each).
SAMPLE, OFTEN, MOST_FREQUENT = 8, 3, 1_000_000
#: Sizes of sets in neighbouring bands differ by 1.25 at least from band start to band start, as those of a pair do at most.
BAND = 1.25


# --- sets -------------------------------------------------------------------------------------
def shingle_sets(texts: list[bytes], tables: rolling.Powers, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    low = [t.translate(rolling.LOWER) for t in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in low)])
    starts, h = rolling.words(b"\n".join(low), tables)
    at = np.searchsorted(starts, begins).tolist()
    w = rolling.windows(h, n)
    out = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a < n:
            out.append(rolling.mix(rolling.windows(h[a:b], b - a) + rolling.U(b - a)) if b > a else h[:0])
            continue
        s = np.sort(w[a : b - n + 1])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set: texts of one class have equal sets."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (token, n), added up within about a megabyte of text."""
    tables = rolling.Powers()
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            tokens, n = np.unique(np.concatenate(shingle_sets(texts, tables)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])


def frequent_shingles(texts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the sample's frequent shingles with their counts, MOST_FREQUENT at most."""
    some = texts.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    counts = scratch.write(counts, "frequent")
    # Rows by count, capped so that the list stays short: the least count from which on all fit.
    sizes = sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("rows")).collect(), reverse=True)
    total, least = 0, 10_001
    for n, rows in sizes:
        if total + rows > MOST_FREQUENT:
            break
        total, least = total + rows, n
    found = counts.where(F.col("n") >= least).toPandas()
    scratch.drop("frequent")
    tokens = found["token"].to_numpy(np.int64).view(rolling.U)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy(np.int64)[order]


class Frequency:
    """Counts of shingles in the sample; 0 for those that are not frequent."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.tokens, self.counts = tokens, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(tokens)] = True

    @staticmethod
    def _slot(s: np.ndarray) -> np.ndarray:
        return (s >> rolling.U(42)).astype(np.int64)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        at = np.flatnonzero(self.maybe[self._slot(s)])
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[place] == s[at], self.counts[place], 0)
        return out


def _prefixes(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """doc_id, tk, text to doc_id, tk, n_shingles, rep (class), prefix, bits."""
    tables, frequency = rolling.Powers(), Frequency(*frequent.value)
    for batch in batches:
        for at, texts in slices(batch.column(2)):
            sets = shingle_sets(texts, tables)
            sizes = np.array([len(s) for s in sets])
            ends = np.cumsum(sizes)
            every = np.concatenate(sets)
            seen, prefix = frequency.of(every), []
            for s, n, end in zip(sets, sizes.tolist(), ends.tolist(), strict=True):
                k = n - (NUM * n + DEN - 1) // DEN + 1 if n else 0
                mine = seen[end - n : end]
                # Sets are sorted by hash, so the rare ones' order is theirs already; frequent ones follow by count.
                rare = s[mine == 0]
                if len(rare) < k:
                    rest = np.flatnonzero(mine)
                    rare = np.concatenate([rare, s[rest[np.argsort(mine[rest], kind="stable")]]])
                prefix.append(rare[:k].view(np.int64))
            starts = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(prefix), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.slice(at, len(texts)) for c in batch.columns[:2]),
                    pa.array(sizes, pa.int64()),
                    pa.array([class_of(s) for s in sets], pa.int64()),
                    lists,
                    pa.array([signature(s, width(len(s))).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "tk", "n_shingles", "rep", "prefix", "bits"],
            )


def _passing(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows whose second column, a 64-bit hash, passes the filter."""
    for batch in batches:
        yield batch.take(pa.array(passes(bits.value, batch.column(1).to_numpy().view(rolling.U))))


def _sets(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(doc_id, h, text) to (doc_id, h, tokens) where h passes the filter."""
    tables = rolling.Powers()
    for batch in _passing(batches, bits):
        for at, texts in slices(batch.column(2)):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts, tables)]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:2]), pa.array(sets, pa.binary())], names=["doc_id", "h", "tokens"])


# --- signature tree ---------------------------------------------------------------------------
def overlap_needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least intersection of sets of sizes x and y at the threshold."""
    return -((-NUM * (x + y)) // (NUM + DEN))


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a set as uint64 words."""
    flags = np.zeros(bits, np.uint8)
    flags[((s >> rolling.U(8)) & rolling.U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def width(n: int) -> int:
    """Bits of a set's bitmap: four to eight for each member, a power of two. Sets that could link differ by one step at most."""
    return max(256, 1 << max(0, 4 * n - 1).bit_length())


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has with fewer bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """Levels of nodes over rows: OR of bitmaps, least and greatest size, least bit count. Level 0 holds the rows.

    Rows lie in order of their bitmaps, so that like sets share nodes and a node has few bits more than one of its rows.
    """

    def __init__(self, bitmaps: np.ndarray, least: np.ndarray, most: np.ndarray, few: np.ndarray) -> None:
        self.order = np.lexsort((least, *bitmaps[:, :2].T[::-1]))
        nodes = tuple(x[self.order] for x in (bitmaps, least, most, few))
        self.levels, self.fans = [nodes], []
        #: Pairs of nodes tested and kept at each level, for tests and tuning.
        self.walked: dict[int, tuple[int, int]] = {}
        while len(nodes[0]) > 1:
            self.fans.append(FAN if self.fans else LEAF)
            at = np.arange(0, len(nodes[0]), self.fans[-1])
            cut = (np.bitwise_or.reduceat, np.minimum.reduceat, np.maximum.reduceat, np.minimum.reduceat)
            nodes = tuple(f(x, at, axis=0) for f, x in zip(cut, nodes, strict=True))
            self.levels.append(nodes)

    def could(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether any rows below nodes i and j could reach the threshold."""
        bits, least, most, few = self.levels[level]
        fits = DEN * np.minimum(most[i], most[j]) >= NUM * np.maximum(least[i], least[j])
        i, j, out = i[fits], j[fits], fits
        step = max(1, (1 << 22) // bits.shape[1])
        shared = np.concatenate([ones(bits[i[k : k + step]] & bits[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])
        # A set has at least as many members outside the shared bits as it has bits outside them.
        best = np.minimum(most[i] - np.maximum(0, few[i] - shared), most[j] - np.maximum(0, few[j] - shared))
        out[fits] = best >= overlap_needed(least[i], least[j])
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, by their places in the input, that the walk from the root leaves."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self.could(level, i, j) & ((i != j) | (level > 0))
            self.walked[level] = (len(i), int(keep.sum()))
            i, j = i[keep], j[keep]
            if level:
                fan, n = self.fans[level - 1], len(self.levels[level - 1][0])
                a, b = (x.ravel() for x in np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"))
                i, j = ((x[:, None] * fan + y[None]).ravel() for x, y in ((i, a), (j, b)))
                inside = (i <= j) & (j < n)
                i, j = i[inside], j[inside]
        return self.order[i], self.order[j]


def trees(bitmaps: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, Tree, np.ndarray]]:
    """Rows, tree and width of each row: a tree for each width, and one for the sizes near the border of two widths, folded to the smaller."""
    words = np.array([len(b) for b in bitmaps])
    for w in np.unique(words).tolist():
        border = 16 * w  # the largest set of this width
        near = (words == w) & (DEN * sizes >= NUM * border) | (words == 2 * w) & (NUM * sizes <= DEN * border)
        for own in (words == w, near if (words[near] > w).any() else words < 0):
            rows = np.flatnonzero(own)
            if len(rows) > 1:
                cut = np.stack([folded(bitmaps[k], w) for k in rows])
                yield rows, Tree(cut, sizes[rows], sizes[rows], ones(cut)), words[rows]


def pairs(bitmaps: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that could link."""
    for rows, tree, words in trees(bitmaps, sizes):
        i, j = tree.pairs()
        # The border's tree gives the pairs of unlike widths; those of like widths come from their own.
        new = slice(None) if words.min() == words.max() else words[i] != words[j]
        yield rows[i[new]], rows[j[new]]


def alive(sizes: np.ndarray, bitmaps: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Which rows of a block could link with a row of another known component."""
    out = np.zeros(len(sizes), bool)
    for i, j in pairs(bitmaps, sizes):
        new = known[i] != known[j]
        out[i[new]] = out[j[new]] = True
    return out


def links(ids: list[int], sets: list[np.ndarray], known: list[int]) -> list[tuple[int, int]]:
    """Pairs (id, smallest id of its connected rows), as verified links connect a block; rows of one ``known`` component count as connected."""
    first: dict[int, int] = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(known)]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for rows, partners in pairs([signature(s, width(len(s))) for s in sets], np.array([len(s) for s in sets], np.int64)):
        for i, j in zip(rows.tolist(), partners.tolist(), strict=True):
            a, b = root(i), root(j)
            if a == b:
                continue
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            if DEN * both >= NUM * (len(x) + len(y) - both):
                parent[max(a, b)] = min(a, b)
    # Stars rather than the links themselves: the components of all blocks then settle in a few rounds.
    least: dict[int, int] = {}
    for k in first.values():
        least[root(k)] = min(ids[k], least.get(root(k), ids[k]))
    return [(ids[k], least[root(k)]) for k in first.values() if ids[k] != least[root(k)]]


# --- blocks -----------------------------------------------------------------------------------
def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first ``keys`` columns, from batches in their order; a group may go over batches."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != rows[-1][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batches(found: Iterator[tuple], names: str) -> Iterator[pa.RecordBatch]:
    """Tuples of integers as batches."""
    columns, rows = [n.split()[0] for n in names.split(", ")], []
    for row in found:
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=columns)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=columns)


FRONT = f"n_shingles - int(ceil({2 * NUM} * n_shingles / {NUM + DEN})) + 1"
MEMBER, LINK, MEETING = "leader long, block long, rep long, known long", "a long, b long", "leader long, x long, y long"


def _alive_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (leader, block, rep, known, n_shingles, bits) to the members that some other one could link with."""

    def found() -> Iterator[tuple]:
        for rows in _groups(batches, 2):
            if len(rows) > 1:
                keep = alive(np.array([r[4] for r in rows], np.int64), [np.frombuffer(r[5], "<u8") for r in rows], np.array([r[3] for r in rows], np.int64))
                yield from (r[:4] for r, k in zip(rows, keep.tolist(), strict=True) if k)

    return _batches(found(), MEMBER)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (leader, block, rep, known, tokens) to links."""

    def found() -> Iterator[tuple]:
        for rows in _groups(batches, 2):
            if len(rows) > 1:
                yield from links([r[2] for r in rows], [np.frombuffer(r[4], "<u8") for r in rows], [r[3] for r in rows])

    return _batches(found(), LINK)


def _summaries(batches: Iterator[pa.RecordBatch], words: int = 64) -> Iterator[pa.RecordBatch]:
    """Blocks of (leader, band, block, main, n_shingles, bits, front) to one node each: OR of the bitmaps in ``words`` words, sizes, least bit count."""
    names = ["leader", "band", "block", "main", "front", "bits", "least", "most", "few"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    out = []
    for rows in _groups(batches, 3):
        # Short bitmaps are repeated rather than folded, which keeps a bit of every member.
        cut = np.stack([folded(b, words) if len(b) > words else np.resize(b, words) for b in (np.frombuffer(r[5], "<u8") for r in rows)])
        few = min(int(ones(np.frombuffer(r[5], "<u8"))) if len(r[5]) <= 8 * words else int(ones(c)) for r, c in zip(rows, cut, strict=True))
        sizes = [r[4] for r in rows]
        out.append((*rows[0][:3], all(r[3] for r in rows), any(r[6] for r in rows), np.bitwise_or.reduce(cut, axis=0).tobytes(), min(sizes), max(sizes), few))
    for k in range(0, len(out), 1000):
        columns = zip(*out[k : k + 1000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of two neighbouring bands of one leader (leader, at, band, block, main, front, bits, least, most, few) to the pairs of blocks that meet."""

    def found() -> Iterator[tuple]:
        for rows in _groups(batches, 2):
            bits = np.stack([np.frombuffer(r[6], "<u8") for r in rows])
            tree = Tree(bits, *(np.array([r[k] for r in rows], np.int64) for k in (7, 8, 9)))
            i, j = tree.pairs()
            for a, b in [*zip(i.tolist(), j.tolist(), strict=True), *((k, k) for k in range(len(rows)))]:
                # Two blocks of the lower band, or one of each, meet here; those of the upper band among themselves meet in theirs.
                if min(rows[a][2], rows[b][2]) == rows[a][1] and not (rows[a][4] and rows[b][4]) and (rows[a][5] or rows[b][5]):
                    yield rows[a][0], min(rows[a][3], rows[b][3]), max(rows[a][3], rows[b][3])

    return _batches(found(), MEETING)


def _by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _linked(members: DataFrame, classes: DataFrame, texts: DataFrame, firsts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links of members (leader, block, rep, known): first on bitmaps, then on the sets of those left."""
    full = members.join(classes.select("rep", "n_shingles", "bits"), "rep").select("leader", "block", "rep", "known", "n_shingles", "bits")
    left = scratch.write(_by(full, "leader", "block").mapInArrow(_alive_members, MEMBER), f"{name}-alive")
    wanted = left.select("rep").distinct().join(firsts, "rep").select("rep", "first.doc_id", F.xxhash64("first.doc_id", "first.tk").alias("h"))
    wanted = scratch.write(wanted, f"{name}-wanted")
    bits = texts.sparkSession.sparkContext.broadcast(bloom(wanted))
    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h long, tokens binary"
    some = texts.select("doc_id", F.xxhash64("doc_id", "tk").alias("h"), "text").mapInArrow(partial(_sets, bits=bits), kinds)
    # Repeated rows have one id and text; tasks drop them before sets move.
    once = some.groupBy("doc_id", "h").agg(F.any_value("tokens").alias("tokens"))
    sets = scratch.write(once.join(wanted, ["doc_id", "h"]).select("rep", "tokens"), f"{name}-sets")
    found = left.join(sets, "rep").select("leader", "block", "rep", "known", "tokens")
    out = scratch.write(_by(found, "leader", "block").mapInArrow(_join_blocks, LINK), f"{name}-links")
    scratch.drop(f"{name}-alive", f"{name}-wanted", f"{name}-sets")
    return out


def _pmod(x: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(x), n).cast("long")


def _remaining(large: DataFrame, edges: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (leader, block, rep, known) of the pairs of blocks that could still hold links of large groups (leader, rep, front)."""
    known = components(edges).withColumnRenamed("node", "rep")
    labelled = large.join(known, "rep", "left").withColumn("known", F.coalesce("component", "rep")).drop("component")
    labelled = scratch.write(labelled.join(classes.select("rep", "n_shingles"), "rep"), "labelled")
    sizes = labelled.groupBy("leader", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("leader").agg(F.max(F.struct("n", "known")).alias("top"), F.count("*").alias("n_known")).where("n_known > 1")
    still = labelled.join(main.select("leader", F.col("top.known").alias("largest")), "leader").withColumn("main", F.col("known") == F.col("largest"))
    still = still.withColumn("band", F.floor(F.log(F.col("n_shingles")) / float(np.log(BAND))).cast("long"))
    part = ["leader", "band", "main", "front"]
    n_blocks = still.groupBy(*part).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    blocked = still.join(n_blocks, part).withColumn("block", F.xxhash64("band", "main", "front", _pmod(F.col("rep"), F.col("n_blocks"))))
    blocked = scratch.write(blocked.select("leader", "band", "block", "main", "front", "rep", "known", "n_shingles"), "size-blocks")
    full = blocked.join(classes.select("rep", "bits"), "rep").select("leader", "band", "block", "main", "n_shingles", "bits", "front")
    nodes = _by(full, "leader", "band", "block").mapInArrow(_summaries, "leader long, band long, block long, main boolean, front boolean, bits binary, least long, most long, few long")
    # Logarithms may err in the last digit, so neighbours are taken one band further.
    near = nodes.withColumn("at", F.explode(F.array("band", F.col("band") - 1, F.col("band") - 2))).select("leader", "at", "band", "block", "main", "front", "bits", "least", "most", "few")
    met = _by(near, "leader", "at").mapInArrow(_meetings, MEETING)
    met = scratch.write(met.select("leader", F.xxhash64("x", "y").alias("meeting"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "meetings")
    out = blocked.join(met, ["leader", "block"]).select("leader", F.col("meeting").alias("block"), "rep", "known")
    return scratch.write(out, "remaining")


# --- the join ---------------------------------------------------------------------------------
def shared(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Shingles (rep, token, front) of classes (rep, n_shingles, prefix), front where they stand in the class's front: all that two classes have in
    their prefixes and one in its front, and few others."""
    tokens = classes.select("rep", F.expr(FRONT).alias("k"), F.posexplode("prefix").alias("place", "token")).select("rep", "token", (F.col("place") < F.col("k")).alias("front"))
    # Counts are added up in the tasks before they meet.
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.max("front").alias("any")).where("n > 1 and any")
    bits = classes.sparkSession.sparkContext.broadcast(bloom(scratch.write(counts.select(F.col("token").alias("h")), "counts")))
    scratch.drop("counts")
    return scratch.write(tokens.mapInArrow(partial(_passing, bits=bits), "rep long, token long, front boolean"), "tokens")


def gathered(tokens: DataFrame) -> DataFrame:
    """Classes under the leaders of their shingles (rep, token, front): (leader, rep, front), front where one of those shingles stands in the class's front."""
    # Spark splits the join's rows of a frequent shingle.
    leaders = tokens.groupBy("token").agg(F.max("rep").alias("leader"), F.count("*").alias("n"), F.max("front").alias("any")).where("n > 1 and any").select("token", "leader")
    return tokens.join(leaders, "token").groupBy("leader", "rep").agg(F.max("front").alias("front"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    require(docs, "doc_id", "text")
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "near")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, scratch))
    kinds = f"doc_id {id_type}, tk long, n_shingles long, rep long, prefix array<bigint>, bits binary"
    full = scratch.write(texts.mapInArrow(partial(_prefixes, frequent=frequent), kinds), "shingles")
    rows = scratch.write(full.select("doc_id", "tk", "n_shingles", "rep"), "rows")
    linkable = F.expr("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(full.where(linkable).select("rep", "n_shingles", "prefix", "bits").dropDuplicates(["rep"]), "classes")
    scratch.drop("shingles")
    firsts = rows.where(linkable).groupBy("rep").agg(F.min(F.struct("doc_id", "tk")).alias("first"))

    members = scratch.write(gathered(shared(classes, scratch)), "members")
    scratch.drop("tokens")
    n_blocks = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    sized = members.join(n_blocks, "leader")
    others = sized.where("rep != leader").select("leader", _pmod(F.col("rep"), F.col("n_blocks")).alias("block"), "rep")
    led = n_blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), F.col("leader").alias("rep"))
    edges = _linked(others.unionByName(led).withColumn("known", F.col("rep")), classes, texts, firsts, scratch, "first")

    large = sized.where("n_blocks > 1").select("leader", "rep", "front")
    if not large.isEmpty():
        edges = edges.unionByName(_linked(_remaining(large, edges, classes, scratch), classes, texts, firsts, scratch, "second"))
    # Components of classes; texts that share an id may be in different ones.
    linked = components(edges).withColumnRenamed("node", "rep").join(firsts, "rep").select("rep", "component", "first.doc_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_linked = linked.join(least, "component").select("rep", "least")
    of_class = firsts.join(of_linked, "rep", "left").select("rep", F.coalesce("least", "first.doc_id").alias("component_id"))
    out = rows.withColumn("rep", F.when(linkable, F.col("rep"))).join(of_class, "rep", "left")
    scratch.drop("classes", "members", "labelled", "size-blocks", "meetings", "remaining")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
