"""Archives: round trips, revisits against a plain version, and what the reader saves from damaged files."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import random
import zlib

import pytest

from condmon.llm import warc as W

DATE = "2024-01-01T00:00:00Z"


def plain(rows, least=0):
    groups: dict = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(data) >= least and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(k, f"http://a.b/{k}", random.Random(k % 7).choice(["x", "é\r\n\r\nWARC/1.1\r\n", "long " * 4000]) + str(k % 7)) for k in range(60)]
ROWS += [(100, None, None), (101, "u\r\nWARC-Type: fake", ""), (102, "ü", "\x1f\x8b\x08 no member"), (None, "n", "x0"), (None, "n", "only null"), (103, "twice", "same"), (103, "twice", "same")]
ROWS += [(104, "big", "wide text " * 700_000)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'clash' as sha", "1 as largest", "'x' as payload")
    path = W.write_archives(df.repartition(5), f"{tmp_path}/w", least, DATE)
    found = W.read_archives(spark, path, "long").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == plain(ROWS, least)
    html = {i: h or "" for i, _, h in ROWS if i is not None}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in found if r["record_type"] == "response" and r["page_id"] is not None)
    assert {r["target_uri"] for r in found if r["page_id"] in (100, 101, 102)} == {None, "u%0D%0AWARC-Type:%20fake", "ü"}
    # Other tools take the files for gzip; members follow each other without a gap.
    for f in glob.glob(f"{path}/part-*"):
        data = open(f, "rb").read()
        records = sorted((r for r in found if r["file"].endswith(f.rsplit("/", 1)[-1])), key=lambda r: r["start"])
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == len(records)
        assert all(b["start"] == a["end"] + len(W.SEPARATOR) for a, b in zip(records, records[1:]))


def test_ids_of_other_types_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("a b%", "u", "x"), ("", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in W.archived(df).collect()}
    assert got == {("a b%", "response", None), ("", "revisit", "a b%"), (None, "response", None)}
    assert W.archived(df.limit(0)).count() == 0


def members(n, compress=True, seed=1):
    rng = random.Random(seed)
    raw = [W.record(k, f"http://x/{k}", rng.randbytes(rng.randint(0, 3000)), None, False, DATE) for k in range(n)]
    return [W.member(x) if compress else x for x in raw]


def ids(found):
    return [f["page_id"] for _, _, f in found if not isinstance(f, str)]


def gaps(found):
    return [(a, b) for a, b, f in found if isinstance(f, str)]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_of_damaged_files(compress):
    rng, ms = random.Random(5), members(12, compress)
    ends = [sum(map(len, ms[: k + 1])) for k in range(12)]
    data = b"".join(ms)
    assert ids(W.salvage(data)) == [str(k) for k in range(12)] and not gaps(W.salvage(data))
    span = lambda k: (ends[k] - len(ms[k]), ends[k])
    for _ in range(40):
        k = rng.randrange(12)
        a, b = span(k)
        p = rng.randrange(a, b)
        flipped = data[:p] + bytes([data[p] ^ (1 << rng.randrange(8))]) + data[p + 1 :]
        found = list(W.salvage(flipped))
        # One bit costs one record at most, and all bytes are a record's or a gap's. Bits that no check covers (a gzip head's time, a date) cost nothing.
        assert [x for x in ids(found) if x != str(k)] == [str(x) for x in range(12) if x != k]
        assert gaps(found) in ([span(k)], []) and [x[0] for x in found] == [0, *[x[1] for x in found[:-1]]] and found[-1][1] == len(data)
    # A hole: the rest of the record before it and the torn one behind it are one gap.
    hole = data[: ends[2] + 20] + data[ends[5] - 10 :]
    found = list(W.salvage(hole))
    assert ids(found) == [str(x) for x in (0, 1, 2, 6, 7, 8, 9, 10, 11)] and gaps(found) == [(ends[2], ends[2] + 30)]
    # Bytes put in, with starts that lead nowhere, and a cut end.
    junk = b"junk\n" + W.MAGIC + b"\x00" * 30 + b"\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n" + b"WARC/1.0"
    found = list(W.salvage(data[: ends[3]] + junk + data[ends[3] : -7]))
    assert ids(found) == [str(x) for x in range(11)] and gaps(found) == [(ends[3], ends[3] + len(junk)), (ends[10] + len(junk), len(data) + len(junk) - 7)]
    assert list(W.salvage(b"")) == [] and gaps(W.salvage(b"nothing here")) == [(0, 12)]


def test_checks_beyond_the_checksum():
    good = W.record(1, "u", b"payload", None, False, DATE)
    for bad, why in (
        (good.replace(b"payload", b"paxload"), "block digest"),
        (good.replace(b"Content-Length: 7", b"Content-Length: 8"), "block digest"),
        (good + b"more", "member goes on behind its record"),
        (good.replace(b"WARC/1.1", b"WARK/1.1"), "no version line"),
        (good[:40], "no end of head"),
    ):
        found = list(W.salvage(W.member(bad) + W.member(good)))
        assert found[0][2] == why and ids(found) == ["1"]
    other = W.record(1, "u", b"other", None, False, DATE).replace(W.digest(b"other").encode(), W.digest(b"x").encode(), 1)
    assert next(W.salvage(W.member(other)))[2] == "payload digest"
    # A member that is whole but for its checksum.
    m = W.member(good)
    assert next(W.salvage(m[:-8] + (zlib.crc32(good) ^ 1).to_bytes(4, "little") + m[-4:]))[2] == "member does not inflate"


def test_gaps_in_spark(spark, tmp_path):
    ms = members(6)
    data = ms[0] + ms[1][:-9] + b".".join(ms[2:])
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = W.read_archives(spark, str(tmp_path), "long").collect()
    assert sorted(r["page_id"] for r in rows if r["problem"] is None) == [0, 2, 3, 4, 5]
    assert sum(r["end"] - r["start"] for r in rows) == len(data) and sum(r["problem"] is not None for r in rows) == 4
