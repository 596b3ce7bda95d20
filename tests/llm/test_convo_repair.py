"""Conversation repair against plain programs over all edit scripts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import pairwise

import pytest

from condmon.llm import convo_repair as C

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Cost, audit and repaired text of damaged rows (role, text): whole strings in each cell."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    def offer(cells, state, new):
        if state not in cells or new[:2] < cells[state][:2]:
            cells[state] = new

    def put(cells):
        for _ in range(3):
            for last, (cost, letters, out) in list(cells.items()):
                for r in ("a",) if last == "u" else ("u",):
                    offer(cells, r, (cost + 2, letters + "I", (*out, ({"u": "user", "a": "assistant"}[r], ""))))
        return cells

    cells = put({"": (0, "", ())})
    for (role, text), fault in zip(rows, faults, strict=True):
        nxt: dict = {}
        for last, (cost, letters, out) in cells.items():
            offer(nxt, last, (cost + 3, letters + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            if role[:1] and role[:1] in fits:
                offer(nxt, role[0], (cost + late, letters + "K", (*out, (role, text))))
            for name in ("user", "assistant"):
                if name[0] in fits:
                    offer(nxt, name[0], (cost + 2 + late, letters + "R", (*out, (name, text))))
        cells = put(nxt)
    cost, letters, out = min((cells[x] for x in ("", "a") if x in cells), key=lambda c: c[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return cost, letters, "\n".join(f"{r}:{t}" for r, t in out)


def summary(rows: list[tuple]) -> tuple:
    """(turn, role, text) rows of one conversation to all result columns but the id."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, blank, duplicate, truncated = set(), 0, 0, 0
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        blank += not body
        duplicate += bool(body) and (role, text) in seen
        truncated += bool(body) and (role, text) not in seen and body[-1] not in ".!?"
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    cost, audit, text = brute([r[1:] for r in rows])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def conversations(rng: random.Random, n: int) -> list[tuple]:
    texts = ["Yes.", "No!", "Why", "  ", "", "Well, then?", "So. \n", "end", None, "é."]
    out = []
    for c in range(n):
        for turn in range(rng.randint(0, 9)):
            out.append((c, None if rng.random() < 0.05 else turn + rng.randint(0, 2), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return out + out[: n // 3]


NAMES = ["gaps", *C.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("parts", [3, 40])
def test_repair_against_plain_programs(spark, parts):
    """With 40 tasks most conversations span several."""
    rows = conversations(random.Random(parts), 60) + [(None, 1, "user", "a row without an id."), (None, 2, "assistant", "another.")]
    rows += [(500, k, "user" if k % 2 else "assistant", f"turn {k % 70}.") for k in range(900)] + [(501, 7, "user", "one row many times.")] * 300
    rows += [(502, k % 4, "assistant", "x" * 50_000 + str(k)) for k in range(8)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'clash' as key", "1 as n", "2 as part", "'x' as letters")
        ids = spark.createDataFrame([(999,)], "conv_id long").unionByName(df.select("conv_id"))
        got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in C.repaired(ids, df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = {c: summary([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    want[999] = (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert got == want


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text. Of {t}!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("modulus", [C.MODULUS, 3, 1])
def test_audits_order_like_strings_whatever_the_hash(modulus):
    rng, audits = random.Random(modulus), C.Audits(modulus)
    strings = ["".join(rng.choices("DK", k=rng.randint(0, 40))) for _ in range(60)] + ["D" * k for k in range(20)]
    nodes = []
    for s in strings:
        node = 0
        for letter in s:
            node = audits.child(node, letter)
        assert audits.text(node) == s
        nodes.append(node)
    for a, x in zip(strings, nodes):
        for b, y in zip(strings, nodes):
            assert audits.less(x, y) == (a < b) and (x == y) == (a == b)


def test_rows_of_other_ids_and_empty_tables(spark):
    rows = [("b", 1, "user", "Hi."), ("b", 2, "assistant", "Yes."), ("a", 1, "system", "Be kind.")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in C.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))[0].collect()}
    assert got == {"b": (0, "KK"), "a": (3, "D")}
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert C.repaired(none, none).count() == 0
