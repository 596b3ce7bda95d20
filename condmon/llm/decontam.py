"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents are brought to templates: numbers become a number
placeholder, units behind a number a unit placeholder, capitalised words inside a sentence a name placeholder,
all other words, the plain ones, their lower-case letters without outer punctuation. Windows of template words
are hash-joined (hash and template text). A hit lies on a diagonal, place in document less place in item.
On one diagonal each value of a slot must stand for one value throughout; windows that
touch a slot value with two readings are dropped. What is left of an item's words must reach
``least_words`` or the share ``least_share`` of the item.

From each place goes a window of ``n`` words, or longer until it holds ``PLAIN_WORDS`` plain words, so placeholders alone match
nothing and an item dense in numbers has windows too. Beside it goes a window of ``n`` literal words, case folded: a literal
hit needs no plain words and no names marked, and stays whatever its slots. Items shorter than
``n`` words, or with fewer plain words in all, are searched as one window of their own length; those shorter than ``MIN_WORDS`` words, which
chance would find anywhere, only as a document's whole text.

The hashes of the benchmark's windows fill a Bloom filter of bounded size (``common.bloom``), which goes to the tasks; so few
other windows leave the document scan, and more only where the benchmark outgrows the filter. The join itself is on hash and text, in Spark.

Defined cases: null and empty texts match nothing; repeated rows with one id and text count once; rows
that share an id, or have none, are judged text by text (id and 64-bit hash of the text), and ``leaks`` gives
the text of an id that covers most of an item; repeated items match on their own; texts of any length are
searched whole; further columns are ignored by ``leaks`` and kept by ``clean``; with an empty benchmark nothing leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, bloom, let, passes, require

N, PLAIN_WORDS, MIN_WORDS, BATCH_CHARS = 8, 5, 5, 1 << 20
LEAST_WORDS, LEAST_SHARE = 13, 0.6
#: Words that count as units behind a number; signs do anywhere.
UNITS = frozenset(
    "% $ € £ mm cm m km in ft mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres"
    " mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons"
    " s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros degree degrees percent mph kmh km/h kb mb gb".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
GLUED = re.compile(r"(\d)([A-Za-z%$€£]+)(?=[\s.,;:!?)]|$)")
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—¿¡"
PLAIN, NUM, UNIT, NAME = range(4)
MARKS = ("", "<num>", "<unit>", "<name>")


class Words(dict):
    """Raw word to its row in ``columns``: template hash, literal hash, kind, ends a sentence, is capitalised, is a word, is a sign."""

    def __init__(self, most: int = 300_000) -> None:
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[tuple[int, int, int, bool, bool, bool, bool]] = []
        self.core: list[str] = []
        self.columns = [np.zeros(0, t) for t in (rolling.U, rolling.U, np.int64, bool, bool, bool, bool)]

    def __missing__(self, raw: str) -> int:
        core = raw.strip(OUTER)
        low = core.casefold()
        kind = NUM if NUMBER.match(core) else UNIT if low in UNITS else PLAIN
        ends = raw == "\x01" or raw.rstrip("\"'”’)]»")[-1:] in tuple(".!?:;")
        self.fresh.append((self.hash(MARKS[kind] or low), self.hash(low), kind, ends, len(core) > 1 and core[0].isupper() and core[1:].islower(), raw != "\x01" and bool(core), not core.isalpha()))
        self.core.append(low)
        self[raw] = len(self.core) - 1
        return len(self.core) - 1

    def looked_up(self, at: np.ndarray) -> list[np.ndarray]:
        if self.fresh:
            self.columns = [np.concatenate([c, np.array(x, c.dtype)]) for c, x in zip(self.columns, zip(*self.fresh, strict=True), strict=True)]
            self.fresh = []
        return [c[at] for c in self.columns]


def template(texts: list[str], words: Words) -> tuple[np.ndarray, ...]:
    """Of the joined texts: document of each template word, its hash, its literal hash, its kind and its row in ``words``."""
    if len(words.core) > words.most:
        words.reset()
    doc: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    for k, text in enumerate(texts):
        raw = GLUED.sub(r"\1 \2", text).replace("\n", " \x01 ").split()
        ids.append(np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)))
        doc.append(np.full(len(raw), k))
    at, doc_of = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(doc) if doc else np.zeros(0, np.int64)
    if not len(at):
        return doc_of, at.view(rolling.U), at.view(rolling.U), at, at
    h, literal, kind, ends, cap, real, sign = words.looked_up(at)
    after = np.ones(len(at), bool)
    after[1:] = ends[:-1] | (doc_of[1:] != doc_of[:-1])
    # Only what follows a number is a unit.
    behind = np.zeros(len(at), bool)
    behind[1:] = (kind[:-1] == NUM) & (doc_of[1:] == doc_of[:-1])
    stray = (kind == UNIT) & ~behind & ~sign
    kind, h = np.where(stray, PLAIN, kind), np.where(stray, literal, h)
    name = cap & ~after & (kind == PLAIN)
    kind = np.where(name, NAME, kind)
    h = np.where(name, rolling.U(words.hash(MARKS[NAME])), h)
    return doc_of[real], h[real], literal[real], kind[real], at[real]


class Stretches:
    """Hash of any stretch of words from their hashes."""

    def __init__(self, h: np.ndarray, tables: rolling.Powers) -> None:
        up, self.down = tables.to(len(h))
        self.sums = np.zeros(len(h) + 1, rolling.U)
        np.cumsum(rolling.mix(h + rolling.U(1)) * up[: len(h)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return rolling.mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(rolling.U))


def _ends(kind: np.ndarray, n: int) -> np.ndarray:
    """Where the window from each place ends: after ``n`` words at least and with ``PLAIN_WORDS`` plain ones; beyond all words if there are too few."""
    plain = np.flatnonzero(kind == PLAIN)
    at = np.searchsorted(plain, np.arange(len(kind))) + PLAIN_WORDS - 1
    last = np.full(len(kind), 2 * len(kind) + n, np.int64)
    enough = at < len(plain)
    last[enough] = plain[at[enough]]
    return np.maximum(last + 1, np.arange(len(kind)) + n)


def _rows(texts: list[str], words: Words, tables: rolling.Powers, n: int, lengths: list[int], longest: int | None, bits: np.ndarray | None) -> list[tuple]:
    """(text number, place, n, hash, template or literal text, slot values, words of the text, stands for a whole item) of each window.

    ``bits`` is None for items: each takes the windows that its own words ask for. Documents take windows of all whole-item ``lengths``, and others up to ``longest``
    words. A window without placeholders is given once, as its template is its literal text; literal windows have no slots.
    """
    doc, h, folded, kind, row = template(texts, words)
    sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
    close = np.cumsum(sizes)
    begin = close - sizes
    plain_before = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    n_plain = plain_before[close] - plain_before[begin]
    every = np.arange(len(doc))
    stop = close[doc] if len(doc) else every
    own = (sizes < n) | (n_plain < PLAIN_WORDS)
    families = []  # (start, end, literal, whole)
    ends = _ends(kind, n)
    ok = (ends <= stop) if longest is None else (ends <= stop) & (ends - every <= longest)
    families.append((every[ok], ends[ok], False, False))
    ok = every + n <= stop
    families.append((every[ok], every[ok] + n, True, False))
    if bits is None:
        starts = begin[own & (sizes > 0)]
        families += [(starts, stop[starts], literal, True) for literal in (False, True)]
    for m in lengths:
        ok = (every + m <= stop) if m >= MIN_WORDS else (every + m <= stop) & (sizes[doc] == m)
        families += [(every[ok], every[ok] + m, literal, True) for literal in (False, True)]
    hashes = {literal: Stretches(x, tables) for literal, x in ((False, h), (True, folded))}
    out = []
    for start, end, literal, whole in families:
        w = hashes[literal].of(start, end)
        at = passes(bits, w) if bits is not None else np.arange(len(w))
        for p, e, hashed in zip(start[at].tolist(), end[at].tolist(), w[at].view(np.int64).tolist(), strict=True):
            d, kinds, size = int(doc[p]), kind[p:e].tolist(), e - p
            plain = sum(k == PLAIN for k in kinds)
            needed = 2 if size >= n else min(size, max(2, size - 3))
            if plain == size if literal else whole and plain < needed:
                continue
            core = [words.core[k] for k in row[p:e]]
            text = " ".join(core if literal else (MARKS[k] or c for k, c in zip(kinds, core, strict=True)))
            slots = [] if literal else [c for k, c in zip(kinds, core, strict=True) if k != PLAIN]
            out.append((d, p - int(begin[d]), size, hashed, text, slots, int(sizes[d]), whole))
    return out


def _scan(batches: Iterator[pa.RecordBatch], n: int, lengths: list[int], longest: int | None, bits, names: list[str]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    words, tables = Words(), rolling.Powers()
    held = bits.value if bits is not None else None
    for batch in batches:
        at, texts, size = 0, [], 0
        for k in range(batch.num_rows):
            texts.append(batch.column(batch.num_columns - 1)[k].as_py() or "")
            size += len(texts[-1])
            if size >= BATCH_CHARS or k == batch.num_rows - 1:
                if found := _rows(texts, words, tables, n, lengths, longest, held):
                    d, place, size_of, h, text, slots, total, whole = zip(*found, strict=True)
                    rows = pa.array([x + at for x in d])
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(rows) for c in batch.columns[:-1]), pa.array(place, pa.int32()), pa.array(size_of, pa.int32()), pa.array(h, pa.int64()), pa.array(text, pa.string()), pa.array(slots, pa.list_(pa.string())), pa.array(total, pa.int32()), pa.array(whole, pa.bool_())],
                        names=names,
                    )
                at, texts, size = k + 1, [], 0


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id, ipos, n, h, template, islots, n_item, whole of all windows."""
    require(benchmark, "item_id", "text")
    names = ["item_id", "ipos", "n", "h", "template", "islots", "n_item", "whole"]
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, ipos int, n int, h long, template string, islots array<string>, n_item int, whole boolean"
    scan = partial(_scan, n=n, lengths=[], longest=None, bits=None, names=names)
    return benchmark.select("item_id", "text").mapInArrow(scan, schema)


def consistent(hits: Column) -> Column:
    """Windows of one diagonal (ipos, n, islots, dslots) without those that touch a slot value of two readings."""
    pair = lambda w: F.zip_with(w["islots"], w["dslots"], lambda i, d: F.struct(i.alias("i"), d.alias("d")))

    def keep(w: Column, p: Column) -> Column:
        odd = F.filter(p, lambda x: F.exists(p, lambda y: (x["i"] == y["i"]) & (x["d"] != y["d"])))
        return let(F.transform(odd, lambda x: x["i"]), lambda o: F.filter(w, lambda x: ~F.arrays_overlap(x["islots"], o)))

    return let(hits, lambda w: let(F.array_distinct(F.flatten(F.transform(w, pair))), lambda p: keep(w, p)))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``leaks`` for each text (``tk``, its hash) of an id."""
    require(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = scratch.write(item_windows(benchmark, n), "items")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(items.select("h")))
    # Items of a length of their own are short or hold few words but placeholders, so their lengths are few.
    own = items.agg(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("n")))).alias("lengths"), F.max(F.when(~F.col("whole"), F.col("n"))).alias("longest")).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tk", "dpos", "n", "h", "template", "dslots", "n_doc", "doc_whole"]
    scan = partial(_scan, n=n, lengths=own["lengths"], longest=own["longest"] or 0, bits=shared, names=names)
    found = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(scan, f"doc_id {kind}, tk long, dpos int, n int, h long, template string, dslots array<string>, n_doc int, doc_whole boolean")
    joined = found.join(items, ["h", "n", "template"])
    window = F.struct("ipos", "n", "islots", "dslots")
    lines = joined.groupBy("doc_id", "tk", "item_id", "n_item", (F.col("dpos") - F.col("ipos")).alias("diagonal")).agg(F.collect_set(window).alias("w"))
    lines = lines.withColumn("w", consistent(F.col("w"))).where(F.size("w") > 0)
    places = F.flatten(F.transform("w", lambda x: F.sequence(x["ipos"], x["ipos"] + x["n"] - 1)))
    lines = lines.withColumns({"places": F.array_distinct(places), "reworded": F.exists("w", lambda x: x["islots"] != x["dslots"])})
    out = lines.groupBy("doc_id", "tk", "item_id", "n_item").agg(
        F.sum(F.size(F.array_distinct(F.transform("w", lambda x: x["ipos"])))).alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("item_words"), F.max("reworded").alias("reworded")
    )
    out = out.withColumn("share", F.col("item_words") / F.col("n_item"))
    out = out.where((F.col("item_words") >= least_words) | (F.col("share") >= least_share))
    return out.select("doc_id", "tk", "item_id", "n_windows", "item_words", "share", "reworded")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, n_windows (places of the item from which a window was found, on each diagonal), item_words (covered), share, reworded (whether a slot's value differs)."""
    most = F.max(F.struct("share", "item_words", "n_windows", "reworded")).alias("most")
    out = hits(docs, benchmark, n, least_words, least_share).groupBy("doc_id", "item_id").agg(most)
    return out.select("doc_id", "item_id", "most.n_windows", "most.item_words", "most.share", "most.reworded")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` without a leak; all columns stay."""
    found = hits(docs, benchmark, n).select(F.col("doc_id").alias("_leaked"), F.col("tk").alias("_tk")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_leaked")) & (F.xxhash64(docs["text"]) == F.col("_tk")), "left_anti")
