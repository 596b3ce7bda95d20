"""Token ids in patched frame-of-reference blocks.

Documents are range-partitioned by id, encoded by the tokenizers library and written as files in
which a row holds one *segment*: the ids and lengths of its documents and a payload of blocks.
A block of up to ``BLOCK`` ids subtracts the smallest id, packs the rest at the width that a
percentile of the values needs, and stores the values above that width as exceptions (place and
value). The payload starts with the byte offsets of its blocks, so a reader can go to any block.
The container is Parquet, which Spark commits and reads on any store.

Payload: magic ``PFOR``, u32 ids, u32 blocks, u32 offsets; each block: u32 smallest id, u16 ids,
u8 width, u16 exceptions, packed values, u16 places, u32 values. All little-endian.

Texts are cut before a space or line feed that stands between two non-spaces and between a letter
and a sign, which are always edges of the byte-level pre-tokenizer, so a piece's ids don't depend on
its surroundings. All of this runs on whole Arrow columns: the distinct pieces of some megabytes of text are
looked up among those that the Python worker has met, and only new ones are encoded. Texts with other
white space are cut by a slower pattern; those with U+0001 or U+001C to U+001F, where Python's and the
library's white space differ, are encoded whole, as are all texts where the tokenizer has another
pre-tokenizer or a normalizer.

Defined cases: a null text counts as empty and holds the end id alone; documents go by ascending
doc_id (of any type with an order), null first, and equal ids by the 64-bit hash of the text, so
rows of one id spread over tasks; repeated rows are written once each; texts of any length are
written whole; further columns are ignored; an empty table gives no file rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

BLOCK, PERCENTILE, SEGMENT_IDS = 4096, 98.0, 1 << 18
#: Pieces that a worker keeps, and bytes of text that it cuts at once.
KNOWN, SLICE = 1_000_000, 2 << 20
#: Lines encoded as one text.
LINES = 10_000
#: Shards that are added up in one window.
SHARDS = 512
SCHEMA = "shard int, segment int, before long, n_ids long, doc_ids array<{kind}>, doc_lens binary, payload binary"
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
CUT = "\x01"
#: Pieces of texts with white space in a row or other than space and line feed.
PIECES = re.compile(rf"\s*[{LETTERS}]+(?=[\s{SIGNS}|#$%&*]|\Z)|\s*\S+|\s+")
IRREGULAR = r"  |\n | \n|\n\n\n|^[ \n]|[ \n]$|[\t\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = "[\x01\x1c-\x1f]"
LINE = re.compile(r"[ \n]?\S+")


# --- blocks -----------------------------------------------------------------------------------
def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: memoryview, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Payload of ``ids`` (uint32)."""
    blocks = []
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        low = int(part.min())
        rest = (part - np.uint32(low)).astype(np.uint32)
        width = int(np.percentile(rest, percentile, method="higher")).bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        held = rest.copy()
        held[odd] = 0
        head = struct.pack("<IHBH", low, len(part), width, len(odd))
        blocks.append(head + pack_bits(held, width) + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes())
    at = np.cumsum([12 + 4 * len(blocks), *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    return b"PFOR" + struct.pack("<II", len(ids), len(blocks)) + at.astype("<u4").tobytes() + b"".join(blocks)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks from ``first`` up to ``last`` (all by default)."""
    if payload[:4] != b"PFOR":
        raise ValueError("not a PFOR payload")
    data = memoryview(payload)
    n_blocks = struct.unpack_from("<I", data, 8)[0]
    starts = np.frombuffer(data, "<u4", n_blocks, 12)
    out = []
    for at in map(int, starts[first:last]):
        low, n, width, n_odd = struct.unpack_from("<IHBH", data, at)
        at += 9
        size = (n * width + 7) // 8
        ids = unpack_bits(data[at : at + size], n, width)
        if n_odd:
            ids[np.frombuffer(data, "<u2", n_odd, at + size)] = np.frombuffer(data, "<u4", n_odd, at + size + 2 * n_odd)
        out.append(ids + np.uint32(low))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


# --- encoding ---------------------------------------------------------------------------------
class Known:
    """Pieces met so far with their ids, as flat arrays of about 40 bytes a piece; beyond ``most`` they are met anew."""

    def __init__(self, most: int) -> None:
        self.most, self.keys, self.flat, self.ends = most, pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def of(self, pieces: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and where each piece's begin and end."""
        if len(self.keys) > self.most:
            self.__init__(self.most)
        at = pc.index_in(pieces, value_set=self.keys)
        new = pieces.filter(pc.is_null(at))
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new))
        if len(new):
            ids, lens = learn(new.to_pylist())
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
            self.keys = pa.concat_arrays([self.keys, new])
        return spread(self.flat, self.ends[place], self.ends[place + 1] - self.ends[place])


def spread(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after another, and their borders."""
    ends = np.concatenate([[0], np.cumsum(lens)])
    return flat[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])], ends


@lru_cache(2)
def encoder(tokenizer_json: str) -> Callable[[pa.Array], list[np.ndarray]]:
    """Texts to uint32 ids, through the tokenizers library; one encoder for all tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok, conf = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
    raw = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")
    added = [t["content"] for t in conf.get("added_tokens", ())]
    pre, line = conf.get("pre_tokenizer") or {}, raw("\n")
    whole = pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or conf.get("normalizer") or len(line) != 1
    whole = whole or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in conf.get("added_tokens", ()))
    slow = "|".join([IRREGULAR, *map(re.escape, added)])
    known = Known(KNOWN)

    def learn(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new pieces. Those without white space, but for a leading one, go as the lines of one text, whose line feeds are tokens of their own."""
        plain = np.array([LINE.fullmatch(p) is not None for p in new]) & ~np.array([any(a in p for a in added) for p in new])
        lines = [p.lstrip("\n") for p, ok in zip(new, plain.tolist(), strict=True) if ok]
        parts = [np.zeros(0, "<u4")]
        for k in range(0, len(lines), LINES):
            text = "\n".join(lines[k : k + LINES])
            parts += [line[: k > 0], np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")]
        ids = np.concatenate(parts)
        cuts = np.flatnonzero(ids == line[0])
        if len(cuts) != max(0, len(lines) - 1):
            each = [raw(p) for p in new]
            return np.concatenate(each), np.array([len(x) for x in each])
        lens = np.zeros(len(new), np.int64)
        lens[plain] = np.diff([-1, *cuts.tolist(), len(ids)]) - 1 if lines else 0
        flat = np.delete(ids, cuts)
        # What the lines lack: the leading line feeds, and the other pieces.
        feeds = np.flatnonzero(plain & np.array([p[:1] == "\n" for p in new]))
        others = [(k, raw(new[k])) for k in np.flatnonzero(~plain).tolist()]
        put = np.concatenate([feeds, *(np.full(len(own), k) for k, own in others)]).astype(np.int64)
        order = np.argsort(put, kind="stable")
        values = np.concatenate([np.full(len(feeds), line[0]), *(own for _, own in others)])
        flat = np.insert(flat, (np.cumsum(lens) - lens)[put[order]], values[order])
        lens[feeds] += 1
        for k, own in others:
            lens[k] = len(own)
        return flat.astype("<u4"), lens

    def encode(texts: pa.Array) -> list[np.ndarray]:
        if whole:
            return [raw(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, ODD)
        irregular = pc.and_not(pc.match_substring_regex(texts, slow), odd)
        cut = pc.replace_substring_regex(texts, rf"([{LETTERS}])([{SIGNS}])", rf"\1{CUT}\2")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", f"{CUT} "), "\n", f"{CUT}\n")
        cut = pc.replace_with_mask(cut, irregular, pa.array([CUT.join(PIECES.findall(t)) for t in texts.filter(irregular).to_pylist()], pa.string()))
        lists = pc.split_pattern(pc.replace_with_mask(cut, odd, pa.scalar("", pa.string())), CUT)
        index = lists.flatten().dictionary_encode()
        flat, ends = known.of(index.dictionary, learn)
        at = index.indices.to_numpy().astype(np.int64)
        ids, ends = spread(flat, ends[at], ends[at + 1] - ends[at])
        borders = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        out = [ids[a:b] for a, b in zip(borders, borders[1:], strict=False)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = raw(texts[k].as_py())
        return out

    return encode


def by_size(texts: pa.Array, size: int = 0) -> Iterator[tuple[int, pa.Array]]:
    """The column in stretches of about ``size`` bytes, each with its first row; null is empty."""
    texts = texts.cast(pa.string()).fill_null("")
    part = np.cumsum(pc.binary_length(texts).to_numpy()) // (size or SLICE)
    starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()] if len(texts) else []
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=False):
        yield a, texts.slice(a, b - a)


def _segments(batches: Iterator[pa.RecordBatch], tokenizer_json: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    """Documents in their order (doc_id, text) to rows of SCHEMA."""
    from pyspark import TaskContext

    encode, end = encoder(tokenizer_json), np.array([end_id], "<u4")
    shard, segment, before = TaskContext.get().partitionId(), 0, 0
    ids: list[pa.Array] = []
    texts: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        flat = np.concatenate(texts)
        lens = np.array([len(t) for t in texts], "<u4").tobytes()
        every = pa.concat_arrays(ids)
        values = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before]), pa.array([len(flat)]), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)]
        values += [pa.array([lens], pa.binary()), pa.array([pack(flat)], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["shard", "segment", "before", "n_ids", "doc_ids", "doc_lens", "payload"])

    for batch in batches:
        at = 0
        for k, own in enumerate(x for _, part in by_size(batch.column(1)) for x in encode(part)):
            texts.append(np.concatenate([own, end]))
            size += len(texts[-1])
            if size >= segment_ids:
                ids.append(batch.column(0).slice(at, k + 1 - at))
                yield row()
                before, segment, size, ids, texts, at = before + size, segment + 1, 0, [], [], k + 1
        if at < batch.num_rows:
            ids.append(batch.column(0).slice(at))
    if texts:
        yield row()


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, name: str = "tokens", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the files below the shared folder; return the frame that reads them."""
    require(docs, "doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text").repartitionByRange("doc_id", "tk")
    in_order = keyed.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tk", "text").select("doc_id", "text")
    schema = SCHEMA.format(kind=docs.schema["doc_id"].dataType.simpleString())
    rows = in_order.mapInArrow(partial(_segments, tokenizer_json=tokenizer_json, end_id=end_id, segment_ids=segment_ids), schema)
    return written(rows, name)


def shard_starts(files: DataFrame) -> DataFrame:
    """shard, shard_start: ids in all shards before. A shard is a task that wrote, so there are as many rows as there were partitions."""
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("part", F.floor(F.col("shard") / SHARDS))
    earlier = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # One row for SHARDS tasks.
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return sizes.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(parts, "part").select("shard", (F.col("earlier") + F.col("part_start")).alias("shard_start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32."""
    # As many rows as tasks wrote, of 16 bytes; so the payloads stay where they are.
    placed = files.join(F.broadcast(shard_starts(files)), "shard").withColumn("before", F.col("before") + F.col("shard_start"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.select("before", "doc_ids", "doc_lens", "payload").mapInArrow(_documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            before, ids, lens, payload = (c[k] for c in batch.columns)
            n = np.frombuffer(lens.as_py(), "<u4").astype(np.int64)
            flat = unpack(payload.as_py()).astype("<u4")
            ends = np.cumsum(n)
            starts = ends - n
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(starts + before.as_py()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def token_index(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Write the documents' ids and return what the files say of each document."""
    return read_tokens(write_tokens(docs, tokenizer_json, end_id))
