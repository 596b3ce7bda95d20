"""Phrase collocation mining: phrases of two to five words, by language, that occur together more often than their parts suggest.

1. Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. Counts
   come in passes over all texts: words, then pairs, then three, then four and five words. A phrase can be frequent only
   if its shorter phrases are, so a pass counts the places whose shorter phrases pass a Bloom filter of the frequent ones;
   what passes by chance is dropped by its count. The filter takes at most 32 MB, so a larger vocabulary costs more counting, never a phrase.
2. In a task phrases are counted in a HAT-trie: below language and first word lies a hash container of the remaining words,
   which bursts into a node over its next words when it grows beyond ``BURST``. When a task holds more than ``MOST`` phrases, its
   largest subtrees leave whole as sorted runs. Spark merges the runs by sums for language and phrase: dealt by
   the whole phrase rather than by its prefix, as a frequent first word would otherwise be one task.
3. The cuts of all frequent phrases are joined with the counts of their parts; scores are exact integers.
4. Phrases that lie in a longer one as frequent as themselves go; one word longer is enough to look at, as counts never grow with length.
5. The best of each language are ranked first within shares of its phrases, then among those, so no task sorts a language.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; texts of any length are taken whole; further
columns are ignored; languages without frequent phrases, and empty tables, give no rows. Phrases are told apart by their words in all counts;
64-bit hashes are used in the filter alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, bloom, passes, require

LEAST, LONGEST, TOP, SHARES = 100, 5, 2000, 16
BURST, MOST, SLICE = 16_384, 400_000, 1 << 22
#: Lengths counted in one pass; a pass looks at the filter of the length before its first.
PASSES = ((1,), (2,), (3,), (4, 5))
NONE = "und"
WORD_END, PIECE_END = 1, 2
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = WORD_END
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = PIECE_END


# --- words ------------------------------------------------------------------------------------
class Words:
    """Words of some texts: where they begin and end, their hashes, the piece they lie in."""

    def __init__(self, texts: list[bytes], tables: rolling.Powers) -> None:
        self.data = b"\n".join(texts).translate(rolling.LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        apart = np.ones(len(raw) + 2, bool)
        apart[1:-1] = kind > 0
        edges = np.flatnonzero(apart[1:] != apart[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = rolling.Bytes(raw, tables).of(self.start, self.end)
        self.piece = np.cumsum(kind == PIECE_END)[self.start] if len(raw) else self.start
        #: How many words before each one are not followed by exactly one space.
        self.odd = np.zeros(len(self.start) + 1, np.int64)
        if len(self.start) > 1:
            np.cumsum((self.start[1:] - self.end[:-1] != 1) | (raw[self.end[:-1]] != 0x20), out=self.odd[1:-1])

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The ``n`` words from each place on, joined by a space each."""
        if n == 0:
            return [b""] * len(at)
        data, odd = self.data, self.odd[at + n - 1] != self.odd[at]
        out = [data[a:b] for a, b in zip(self.start[at].tolist(), self.end[at + n - 1].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = b" ".join(data[a:b] for a, b in zip(self.start[at[k] : at[k] + n].tolist(), self.end[at[k] : at[k] + n].tolist(), strict=True))
        return out

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each place on."""
        h = self.hash
        for k in range(1, n):
            h = rolling.mix(h[1:] * rolling.U(rolling.BASE) + self.hash[: len(self.hash) - k]) if len(h) else h
        return h


def keyed(h: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of phrases made hashes of phrases in a language."""
    import xxhash

    return rolling.mix(h ^ rolling.U(xxhash.xxh3_64_intdigest(lang.encode())))


# --- HAT-trie ---------------------------------------------------------------------------------
class Node(dict):
    """Next word to a container or a node; ``b""`` to the count of the phrase that ends here."""


class HatTrie:
    """Counts of phrases below (language, first word)."""

    def __init__(self, burst: int = BURST, most: int = MOST) -> None:
        self.burst, self.most = burst, most
        self.trees: dict[tuple[str, bytes], dict] = {}
        self.held: dict[tuple[str, bytes], int] = {}
        self.total = 0

    def add(self, lang: str, first: bytes, rest: bytes, n: int) -> None:
        key = (lang, first)
        above, name, tree = self.trees, key, self.trees.get(key)
        if tree is None:
            tree = self.trees[key] = {}
            self.held[key] = 0
        while type(tree) is Node:
            word, _, rest = rest.partition(b" ")
            if not word:
                break
            above, name, tree = tree, word, tree.setdefault(word, {})
        old = tree.get(rest)
        if old is not None:
            tree[rest] = old + n
            return
        tree[rest] = n
        self.held[key] += 1
        self.total += 1
        if len(tree) > self.burst and type(tree) is dict and b" " in rest:
            above[name] = self._burst(tree)

    @staticmethod
    def _burst(full: dict) -> Node:
        """A node over containers in a full container's place."""
        node = Node()
        for rest, n in full.items():
            word, _, more = rest.partition(b" ")
            if word:
                node.setdefault(word, {})[more] = n
            else:
                node[b""] = n
        return node

    def _run(self, tree: dict, before: bytes) -> Iterator[tuple[bytes, int]]:
        """Phrases of a subtree in order of their words."""
        for word in sorted(tree):
            below = tree[word]
            name = before + b" " + word if before and word else before or word
            if isinstance(below, dict):
                yield from self._run(below, name)
            else:
                yield name, below

    def spill(self, down_to: int) -> Iterator[tuple[str, bytes, int]]:
        """The largest subtrees as sorted runs, until ``down_to`` phrases are left."""
        for key in sorted(self.held, key=self.held.get, reverse=True):
            if self.total <= down_to:
                return
            for phrase, n in self._run(self.trees[key], key[1]):
                yield key[0], phrase, n
            self.total -= self.held.pop(key)
            del self.trees[key]


# --- counting ---------------------------------------------------------------------------------
def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch (lang, text) by language, some megabytes at a time."""
    groups: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        lang = NONE if lang is None else lang
        held, size = groups.get(lang, ([], 0))
        held.append((text.as_py() or "").encode())
        groups[lang] = (held, size + len(held[-1]))
        if groups[lang][1] >= SLICE:
            yield lang, groups.pop(lang)[0]
    for lang, (held, _) in groups.items():
        yield lang, held


def _places(words: Words, lang: str, n: int, shorter: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``n`` words of one piece begin whose phrases of ``shorter`` words pass the filter, and the hashes of the ``n`` words."""
    h = words.hashes(n)
    if not len(h) or len(words.start) < n:
        return np.zeros(0, np.int64), h[:0]
    fits = words.piece[: len(h)] == words.piece[n - 1 :]
    if bits is not None:
        known = np.zeros(len(words.start) - shorter + 1, bool)
        known[passes(bits, keyed(words.hashes(shorter), lang))] = True
        for k in range(n - shorter + 1):
            fits &= known[k : k + len(h)]
    at = np.flatnonzero(fits)
    return at, h[at]


def _count(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], bits) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(lang, text) to sorted runs of (lang, phrase, n); the first pass also gives all words of a language as a null phrase."""
    tables, trie, totals = rolling.Powers(), HatTrie(), {}
    held = bits.value if bits is not None else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        lang, phrase, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([p.decode() if p is not None else None for p in phrase], pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows:
            out.append(row)
            if len(out) == 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    for batch in batches:
        for lang, texts in by_language(batch):
            words = Words(texts, tables)
            if lengths == (1,):
                totals[lang] = totals.get(lang, 0) + len(words.start)
            for n in lengths:
                at, h = _places(words, lang, n, lengths[0] - 1, held)
                _, first, counts = np.unique(h, return_index=True, return_counts=True)
                at = at[first]
                # A word alone lies in the one container that has no first word.
                heads = words.phrases(at, 1 if n > 1 else 0)
                rests = words.phrases(at + 1, n - 1) if n > 1 else words.phrases(at, 1)
                for head, rest, c in zip(heads, rests, counts.tolist(), strict=True):
                    trie.add(lang, head, rest, c)
                    if trie.total > trie.most:
                        yield from batches_of(trie.spill(trie.most // 2))
    yield from batches_of(trie.spill(0))
    yield from batches_of((lang, None, n) for lang, n in totals.items())


def _hashed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) of ``n`` words each to the hash that a text's place has."""
    tables = rolling.Powers()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        phrases = batch.column(1).to_pylist()
        for lang in set(langs):
            words = Words([p.encode() for g, p in zip(langs, phrases, strict=True) if g == lang], tables)
            yield pa.RecordBatch.from_arrays([pa.array(keyed(words.hashes(n)[::n], lang).view(np.int64))], names=["h"])


def counts(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of one to ``LONGEST`` words (lang, phrase, n_words, f) and all words of each language (lang, n)."""
    require(docs, "text", "lang")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "phrases")
    texts, bits, found, totals = docs.select("lang", "text"), None, [], None
    for lengths in PASSES:
        # A filter broadcast for each pass: it is bounded, see bloom.
        runs = texts.mapInArrow(partial(_count, lengths=lengths, bits=bits), "lang string, phrase string, n long")
        merged = runs.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))
        merged = scratch.write(merged.withColumn("n_words", F.size(F.split("phrase", " "))), f"pass-{lengths[0]}")
        if totals is None:
            totals = merged.where("phrase is null").select("lang", F.col("f").alias("n"))
        frequent = merged.where("phrase is not null").select("lang", "phrase", "n_words", "f")
        found.append(frequent)
        if lengths != PASSES[-1]:
            hashes = scratch.write(frequent.select("lang", "phrase").mapInArrow(partial(_hashed, n=lengths[0]), "h long"), f"hashes-{lengths[0]}")
            bits = spark.sparkContext.broadcast(bloom(hashes))
            scratch.drop(f"hashes-{lengths[0]}")
    return reduce(DataFrame.unionByName, found), totals


# --- scores -----------------------------------------------------------------------------------
def _joined(first: int | str, length: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {first}, {length}), ' ')"


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each frequent phrase by its lowest cut, without those in a longer phrase as frequent."""
    cuts = frequent.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr(_joined(1, "k")), "tail": F.expr(_joined("k + 1", "n_words - k"))})
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = frequent.where("n_words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(F.expr(_joined(1, "n_words - 1")), F.expr(_joined(2, "n_words - 1")))).alias("phrase"))
    left = lowest.join(longer, ["lang", "phrase", "a"], "left_anti")
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` of each language by score and a downwards, then by phrase."""
    frequent, totals = counts(docs, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = scored(frequent, totals).withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
