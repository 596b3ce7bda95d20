"""Removal of long repeated byte strings by prefix-free parsing.

Every byte of a ``length``-byte string that also starts anywhere else in the corpus is removed.

*Phrases.* A rolling hash of ``GRAM`` bytes is a trigger where it is the smallest of ``SPREAD``
consecutive ones, so triggers depend on nearby content alone, equal strings are cut at equal
places, and every ``length``-byte window holds one. The phrases between triggers form the
dictionary, the sequence of triggers the parse.

*Corpus order.* In the suffix order that dictionary and parse define together, a window that
starts in a phrase is placed by the rest of that phrase, up to the trigger, and then by the parse
from the trigger on. A window repeats exactly when a neighbour in this order shares its first
``length`` bytes, so only the classes of equal windows are needed, not the order between classes.
They come in three steps, each a count by hash key, never a pair of places:

1. by trigger: K, the bytes behind the trigger that all windows of its phrase share, drops
   phrases met once; C, all bytes of all the phrase's windows, settles phrases with a full twin;
2. K met twice but C differs (a phrase beside an edit): one phrase of each class is cut into runs
   of ``RUN`` windows, with K and C of their own;
3. runs that are still open are settled window by window.

Text moves twice, joined by document, once with the open phrases and once with the removed spans.
Keys are 64-bit hashes: among n places, two different strings meet with probability n*n/2**65.

Texts of any length are hashed in pieces of ``PIECE`` windows, so a task holds a few copies of its longest text and no more.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all; repeated rows
are each other's repeats; ids may be null or repeat; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, require, slices

LENGTH, GRAM, SPREAD, RUN = 400, 12, 256, 16
HOT = 1000
PLACE = 24  # bits of a place beside the trigger's hash
PIECE = 1 << 20  # windows that are hashed at once, fewer than 1 << PLACE
KEY = ["doc_id", "tk"]


def _phrases(data: np.ndarray, ends: np.ndarray, tables: rolling.Powers, length: int, spread: int) -> tuple[np.ndarray, ...]:
    """For joined documents that end at ``ends``: trigger, first and last window start of each phrase, K and C."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(rolling.U), empty.view(rolling.U)
    h = rolling.Bytes(data, tables)
    low = rolling.U((1 << PLACE) - 1)
    grams = np.arange(n - GRAM + 1)
    hashed = (h.of(grams, grams + GRAM) & ~low) | grams.astype(rolling.U)
    trigger = (rolling.sliding_min(hashed, spread)[: n - length + 1] & low).astype(np.int64)
    place = np.arange(len(trigger))
    inside = place + length <= ends[np.searchsorted(ends, place, side="right")]
    start = inside.copy()
    start[1:] &= (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= (trigger[1:] != trigger[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    t = trigger[first]
    k = h.of(t, t + (length - spread + 1))
    reach = (t - first).astype(rolling.U) * rolling.U(1 << 20) + (t - last).astype(rolling.U)
    return t, first, last, k, rolling.mix(h.of(first, last + length) + reach * rolling.U(rolling.BASE))


def _pieces(data: np.ndarray, ends: np.ndarray, tables: rolling.Powers, length: int, spread: int, piece: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of ``piece`` windows at a time, in order, so that memory doesn't grow with the text. A phrase that may go on behind a piece
    opens the next one; it has at most ``spread`` windows, so each piece moves on."""
    begin, windows = 0, len(data) - length + 1
    while begin < windows:
        t, first, last, k, c = _phrases(data[begin : begin + piece + length - 1], ends - begin, tables, length, spread)
        goes_on = begin + piece < windows and len(last) and last[-1] == piece - 1
        keep = slice(None, -1) if goes_on else slice(None)
        yield t[keep] + begin, first[keep] + begin, last[keep] + begin, k[keep], c[keep]
        begin += int(first[-1]) if goes_on else piece


def _first_pass(batches: Iterator[pa.RecordBatch], length: int, spread: int, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """doc_id, tk, text to one row for each phrase; places count from the document's start."""
    tables = rolling.Powers()
    for batch in batches:
        for at, texts in slices(batch.column(2)):
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts), np.uint8)
            del texts
            for t, first, last, k, c in _pieces(data, ends, tables, length, spread, piece):
                doc = np.searchsorted(ends, first, side="right")
                begin = (ends - sizes)[doc]
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array((x - begin).astype(np.int32)) for x in (t, first, last)), pa.array(k.view(np.int64)), pa.array(c.view(np.int64))],
                    names=[*KEY, "t", "first", "last", "k", "c"],
                )


def _run_pass(batches: Iterator[pa.RecordBatch], length: int, run: int, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """doc_id, tk, text, open (t, first, last) to one row for each run of windows, with the windows' hashes. Only the pieces with open
    phrases are hashed, one at a time."""
    tables = rolling.Powers()
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row in range(batch.num_rows):
            data = np.frombuffer((batch.column(2)[row].as_py() or "").encode(), np.uint8)
            begin = end = 0
            for first, last, t in sorted((x["first"], x["last"], x["t"]) for x in batch.column(3)[row].as_py()):
                if last + length > end:
                    begin, end = first, max(first + piece, last + length)
                    h = rolling.Bytes(data[begin:end], tables)
                first, last, t = first - begin, last - begin, t - begin
                p = np.arange(first, last + 1)
                w = h.of(p, p + length)
                j = np.arange((t - last) // run, (t - first) // run + 1)
                lo, hi = np.maximum(first, t - run * j - (run - 1)), np.minimum(last, t - run * j)
                core = h.of(t - run * j, t - run * j - (run - 1) + length)
                reach = (t - lo).astype(rolling.U) * rolling.U(1 << 20) + (t - hi).astype(rolling.U)
                out[0] += [row] * len(j)
                out[1] += (lo + begin).tolist()
                out[2] += (hi + begin).tolist()
                out[3].append(rolling.mix(core + j.astype(rolling.U)))
                out[4].append(rolling.mix(h.of(lo, hi + length) + reach * rolling.U(rolling.BASE)))
                out[5] += [w[a - first : b - first + 1].astype("<u8").tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        if not out[0]:
            continue
        rows = pa.array(out[0])
        k, c = (pa.array(np.concatenate(x).view(np.int64)) for x in out[3:5])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), k, c, pa.array(out[5], pa.binary())],
            names=[*KEY, "first", "last", "k", "c", "ws"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tk, first, ws to one row for each window."""
    for batch in batches:
        ws = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(3)]
        n = [len(x) for x in ws]
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        at = np.repeat(batch.column(2).to_numpy(), n) + np.concatenate([np.arange(x) for x in n] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(np.concatenate(ws) if ws else np.zeros(0, np.int64))],
            names=[*KEY, "at", "w"],
        )


def _twins(rows: DataFrame, on: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Values of ``on`` that stand in two rows or more, with their number."""
    return scratch.write(rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), f"{name}-twins")


def _among(rows: DataFrame, twins: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` is among ``twins``. Values that hold more than one in ``HOT`` of the rows are fewer than ``HOT``, so they are
    broadcast and their rows stay where they are; the others are joined by shuffle."""
    least = (twins.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(twins.where(F.col("n") > least).select(*on)) if least else None
    if hot is None:
        return rows.join(twins.select(*on), on, "left_semi")
    others = rows.join(hot, on, "left_anti").join(twins.where(F.col("n") <= least).select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(others)


def _settle(rows: DataFrame, length: int, carry: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """From rows whose K stands twice: spans of those with a full twin, and one row of each class where classes differ."""
    classes = rows.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, *carry)).alias("row"))
    classes = scratch.write(classes, f"{name}-classes")
    full = _among(rows, classes.where("n > 1").select("k", "c", "n"), ["k", "c"])
    spans = full.select(*KEY, "first", (F.col("last") + length).alias("end"))
    return scratch.write(spans, f"{name}-spans"), _among(classes, _twins(classes, ["k"], scratch, f"{name}-class"), ["k"]).select("row.*")


def removed_spans(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, run: int = RUN) -> DataFrame:
    """doc_id, tk (hash of the text) and ``spans``, an array of (first, end) to remove; overlaps are possible."""
    require(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    kinds = f"{KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {KEY[1]} long"
    phrases = texts.mapInArrow(partial(_first_pass, length=length, spread=spread), f"{kinds}, t int, first int, last int, k long, c long")
    phrases = scratch.write(phrases, "phrases")
    open_rows = scratch.write(_among(phrases, _twins(phrases, ["k"], scratch, "phrase"), ["k"]), "open")
    scratch.drop("phrases")
    spans_1, open_1 = _settle(open_rows, length, ["t", "first", "last"], scratch, "phrase")

    listed = open_1.groupBy(*KEY).agg(F.collect_list(F.struct("t", "first", "last")).alias("open"))
    with_text = texts.join(listed, texts["doc_id"].eqNullSafe(listed["doc_id"]) & (texts["tk"] == listed["tk"]))
    with_text = with_text.select(texts["doc_id"], texts["tk"], "text", "open")
    runs = with_text.mapInArrow(partial(_run_pass, length=length, run=run), f"{kinds}, first int, last int, k long, c long, ws binary")
    runs = scratch.write(runs, "runs")
    scratch.drop("open", "phrase-classes")
    near = scratch.write(_among(runs, _twins(runs, ["k"], scratch, "run"), ["k"]), "near")
    scratch.drop("runs")
    spans_2, open_2 = _settle(near, length, ["first", "last", "ws"], scratch, "run")

    single = scratch.write(open_2.select(*KEY, "first", "ws").mapInArrow(_windows, f"{kinds}, at int, w long"), "windows")
    scratch.drop("near", "run-classes")
    spans_3 = _among(single, _twins(single, ["w"], scratch, "window"), ["w"]).select(*KEY, F.col("at").alias("first"), (F.col("at") + length).alias("end"))
    # Neighbouring phrases with twins overlap, so most of a document's spans merge at once.
    every = spans_1.unionByName(spans_2).unionByName(spans_3)
    found = scratch.write(every.groupBy(*KEY).agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans")
    scratch.drop("windows", "phrase-spans", "run-spans", *[f"{n}-twins" for n in ("phrase", "phrase-class", "run", "run-class", "window")])
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int, str, str]] = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for a, b in sorted((s["first"], s["end"]) for s in spans.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            at, kept = 0, []
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (with U+FFFD where a cut splits a character)."""
    spans = removed_spans(docs, length)
    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["tk"] == spans["tk"]), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select(texts["doc_id"], "text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
