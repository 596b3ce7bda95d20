"""Conversation structure repair: the cheapest edits that give turns ``(s?(ua)+)?``, with an audit of their letters.

1. Equal rows of a conversation (turn, role and text) are one row with a count. A row that repeats role and text of an
   earlier one is a duplicate; the earliest turn of each role and text is counted and joined.
2. Rows, without their texts, are dealt by ranges of (conversation, turn, role, text hash), so a long conversation goes over
   many tasks. Each task runs the dynamic program over its rows. Its cells are the states ``B`` (nothing yet), ``S``, ``U``
   and ``A`` (the last role), each with a cost and a node of ``Audits``: edit prefixes are shared as linked nodes that know
   their ancestors at powers of two and a rolling hash. Ties are settled by the longest common prefix, searched by lifting
   both nodes while their hashes differ; equal hashes are verified, as nodes are kept once for each string.
3. The first and the last conversation of a task may go on in another one; for these the task gives the best edits from each
   state to each state, and such pieces are chained in order. Of equally cheap edits over the same rows none is a
   prefix of another (an Insert costs 2), so the least one of a piece is part of the least one of the whole.
4. The chosen letters are joined with the texts.

No task holds a conversation's texts. One that spans tasks meets as its pieces' letters, at most 16 for each row, in the
one row that returns its audit; its digest, if asked for, is streamed through one task, as SHA-256 has no other way.

Defined cases: a null role or text is one space; null turns come first; rows of one turn go by role and text hash; rows without
a conversation id are one conversation; a role counts by its first character; texts of any length are taken whole; further
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, require

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
B, S, U, A = range(4)
FAULTS = ("blank", "duplicate", "truncated")
#: Multiplier and modulus of the rolling hash.
BASE, MODULUS = 1_000_003, (1 << 61) - 1


# --- damage -----------------------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """Rows broken by ``crc32(conv_id:turn) % 20``: 0 drops one, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user."""
    require(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


# --- audits -----------------------------------------------------------------------------------
class Audits:
    """Strings of edit letters as linked nodes: each knows its last letter, its ancestors 1, 2, 4, ... letters up and a rolling hash."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self.nodes: dict[int, list[int]] = {}

    def child(self, node: int, letter: str) -> int:
        """The node of the string one letter longer. Nodes of one hash are told apart by what they stand for."""
        h = (self.hash[node] * BASE + ord(letter)) % self.modulus
        same = self.nodes.setdefault(h, [])
        for x in same:
            if self.parent[x] == node and self.letter[x] == letter:
                return x
        new, up = len(self.parent), [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        for column, value in ((self.parent, node), (self.letter, letter), (self.depth, self.depth[node] + 1), (self.hash, h), (self.up, up)):
            column.append(value)
        same.append(new)
        return new

    def _lifted(self, x: int, letters: int) -> int:
        while letters > 0:
            k = letters.bit_length() - 1
            x, letters = self.up[x][k], letters - (1 << k)
        return x

    def _same(self, x: int, y: int) -> bool:
        return self.hash[x] == self.hash[y] and x == y

    def less(self, a: int, b: int) -> bool:
        """Whether string a comes before string b: their first difference lies below the longest common prefix."""
        x = self._lifted(a, self.depth[a] - self.depth[b])
        y = self._lifted(b, self.depth[b] - self.depth[a])
        if self._same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self._same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


#: By state, (cost, node) or None.
Cells = list[tuple[int, int] | None]


def _offer(audits: Audits, cells: Cells, state: int, cost: int, node: int, letter: str) -> None:
    old = cells[state]
    if old is None or cost < old[0]:
        cells[state] = (cost, audits.child(node, letter))
    elif cost == old[0]:
        new = audits.child(node, letter)
        if audits.less(new, old[1]):
            cells[state] = (cost, new)


def inserted(audits: Audits, cells: Cells) -> Cells:
    """Cells after Inserts, of which a cheapest path needs two at most in one place."""
    for a, b in ((B, U), (S, U), (A, U), (U, A)):
        if cells[a] is not None:
            _offer(audits, cells, b, cells[a][0] + INSERT, cells[a][1], "I")
    return cells


def stepped(audits: Audits, cells: Cells, initial: str, must_go: bool, truncated: bool) -> Cells:
    """Cells after one row and the Inserts behind it."""
    out: Cells = [None] * 4
    for state, cell in enumerate(cells):
        if cell is None:
            continue
        cost, node = cell
        _offer(audits, out, state, cost + DELETE, node, "D")
        if must_go:
            continue
        cost += TRUNCATED * truncated
        if state == B and initial == "s":
            _offer(audits, out, S, cost + KEEP, node, "K")
        role, to = ("a", A) if state == U else ("u", U)
        _offer(audits, out, to, cost + (KEEP if initial == role else REROLE), node, "K" if initial == role else "R")
    return inserted(audits, out)


# --- pieces -----------------------------------------------------------------------------------
ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.string()), ("n", pa.int64())])
PATH = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("letters", pa.large_string())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns")


def _piece(rows: list[dict], whole: bool) -> dict:
    """What a stretch of one conversation's rows adds up to, with the best edits from state a to state b."""
    letters, faults, illegal, before = [], dict.fromkeys(FAULTS, 0), 0, None
    for r in rows:
        initial = r["role"][:1]
        for k in range(r["n"]):
            fault = "blank" if r["blank"] else "duplicate" if r["duplicate"] or k else "truncated" if r["truncated"] else None
            if fault:
                faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            letters.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
    paths = []
    for start in (B,) if whole else range(4):
        audits = Audits()
        cells: Cells = [None] * 4
        cells[start] = (0, 0)
        if whole:
            inserted(audits, cells)
        for step in letters:
            cells = stepped(audits, cells, *step)
        paths += [{"a": start, "b": b, "cost": c[0], "letters": audits.text(c[1])} for b, c in enumerate(cells) if c is not None and (not whole or b in (B, A))]
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    return {
        "whole": whole, **faults, "illegal": illegal, "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(turns),
        "first_role": rows[0]["role"], "last_role": rows[-1]["role"], "rows": [{k: r[k] for k in ("turn", "role", "key", "n")} for r in rows], "paths": paths,
    }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces; those between the first and the last of a task are whole conversations."""
    part, at, kind, held = TaskContext.get().partitionId(), 0, None, []

    def rows() -> Iterator[dict]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield from batch.to_pylist()

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        column = lambda n, t: pa.array([x[n] for x in found], t)
        names = {"conv_id": kind, "part": pa.int64(), "whole": pa.bool_(), **dict.fromkeys(COUNTS, pa.int64()), "first_role": pa.string(), "last_role": pa.string(), "rows": pa.list_(ROW), "paths": pa.list_(PATH)}
        return pa.RecordBatch.from_arrays([column(n, t) for n, t in names.items()], names=list(names))

    out, size = [], 0
    for conv, group in groupby(rows(), itemgetter("conv_id")):
        if held:
            out.append({"conv_id": held[0]["conv_id"], "part": part, **_piece(held, at > 1)})
            size += len(held)
        held, at = list(group), at + 1
        if size >= 5000:
            yield batch_of(out)
            out, size = [], 0
    if held:
        out.append({"conv_id": held[0]["conv_id"], "part": part, **_piece(held, False)})
    if out:
        yield batch_of(out)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    for _, group in groupby((row for batch in batches for row in batch.to_pylist()), itemgetter(key)):
        yield list(group)


def chained(pieces: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """Cheapest, then least, edits over the pieces of one conversation: cost, and each piece's start state and letters."""
    if pieces[0]["whole"]:
        best = min(pieces[0]["paths"], key=lambda p: (p["cost"], p["letters"]))
        return best["cost"], [(B, best["letters"])]
    # By state: cost, letters so far, and the way there as (way before, start state, letters of the piece).
    cells = {B: (0, "", None), U: (INSERT, "I", None), A: (2 * INSERT, "II", None)}
    begun = {state: cell[1] for state, cell in cells.items()}
    for p in pieces:
        reached: dict[int, tuple] = {}
        for path in p["paths"]:
            if path["a"] in cells:
                cost, letters, way = cells[path["a"]]
                new = (cost + path["cost"], letters + path["letters"])
                if path["b"] not in reached or new < reached[path["b"]][:2]:
                    reached[path["b"]] = (*new, (way, path["a"], path["letters"]))
        cells = reached
    total, _, way = min((cells[x] for x in (B, A) if x in cells), key=lambda c: c[:2])
    out = []
    while way is not None:
        way, state, letters = way
        out.append((state, letters))
    out.reverse()
    state, letters = out[0]
    out[0] = (B, begun[state] + letters)
    return total, out


CHOSEN = "part long, is_first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, state int, letters string, rows array<struct<turn: long, role: string, key: string, n: long>>"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the chosen letters of each, with the conversation's sums on its first piece."""
    names = [c.split()[0] for c in CHOSEN.split(", ")[:11]]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.large_string(), pa.int32(), pa.large_string()]
    out: list[dict] = []
    kind = None

    def seen() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array([x["conv_id"] for x in out], kind), *(pa.array([x.get(n) for x in out], t) for n, t in zip(names, kinds, strict=True)), pa.array([x["rows"] for x in out], pa.list_(ROW))]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names, "rows"])

    for pieces in _grouped(seen(), "conv_id"):
        cost, chosen = chained(pieces)
        least, most = min((p["least"] for p in pieces if p["turns"]), default=None), max((p["most"] for p in pieces if p["turns"]), default=None)
        # Pieces in order share the border's turn at most.
        spans = [p for p in pieces if p["turns"]]
        turns = sum(p["turns"] for p in pieces) - sum(a["most"] == b["least"] for a, b in zip(spans, spans[1:], strict=False))
        sums = {n: sum(p[n] for p in pieces) for n in (*FAULTS, "illegal")}
        sums["illegal"] += sum(a["last_role"][:1] + b["first_role"][:1] not in ("su", "ua", "au") for a, b in zip(pieces, pieces[1:], strict=False))
        sums["gaps"] = most - least + 1 - turns if turns else 0
        sums |= {"cost": cost, "audit": "".join(letters for _, letters in chosen)}
        for k, (p, (state, letters)) in enumerate(zip(pieces, chosen, strict=True)):
            record = {"conv_id": p["conv_id"], "part": p["part"], "is_first": not k, "state": state, "letters": letters, "rows": p["rows"]}
            out.append(record | (sums if not k else {}))
        if len(out) >= 500:
            yield batch_of()
            out = []
    if out:
        yield batch_of()


EDIT = "part long, place long, turn long, role string, key string, new_role string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen letters to one row for each turn that stays or is put in; the latter have no key."""
    names = [c.split()[0] for c in EDIT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for x in batch.to_pylist():
            state, rows = x["state"], (r for r in x["rows"] for _ in range(r["n"]))
            for place, letter in enumerate(x["letters"]):
                row = None if letter == "I" else next(rows)
                if letter == "D":
                    continue
                if letter == "K":
                    role = row["role"]
                    state = {"s": S, "u": U, "a": A}[role[0]]
                else:
                    role, state = ("assistant", A) if state == U else ("user", U)
                known = (row["turn"], row["role"], row["key"]) if row else (None, None, None)
                out.append((x["conv_id"], x["part"], place, *known, role))
        if out:
            conv, *columns = zip(*out, strict=True)
            arrays = [pa.array(conv, batch.schema.field("conv_id").type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names])


# --- the operator -----------------------------------------------------------------------------
def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and repaired turns (conv_id, part, place, role, text), in order of part and place."""
    require(rows, "conv_id", "turn", "role", "text")
    scratch, kind = Scratch(rows.sparkSession, "repair"), rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    equal = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    equal = equal.withColumns({"key": F.md5(F.col("text").cast("binary")), "blank": last == "", "truncated": ~last.isin("", ".", "!", "?")})
    equal = scratch.write(equal, "rows")
    light = equal.drop("text")
    same = ["conv_id", "role", "key"]
    firsts = light.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"))
    firsts = firsts.select(*[F.col(c).alias(f"_{c}") for c in same], "_first")
    joined = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key")))
    marked = joined.select("conv_id", "turn", "role", "key", "n", "blank", "truncated", (~F.col("turn").eqNullSafe(F.col("_first.turn"))).alias("duplicate"))
    order = ["conv_id", "turn", "role", "key"]
    # The ranges are drawn from a sample, so the rows must be the same when they are read again.
    ordered = scratch.write(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order)
    counts = ", ".join(f"{n} long" for n in COUNTS)
    row, path = "struct<turn: long, role: string, key: string, n: long>", "struct<a: int, b: int, cost: long, letters: string>"
    pieces = scratch.write(ordered.mapInArrow(_pieces, f"conv_id {kind}, part long, whole boolean, {counts}, first_role string, last_role string, rows array<{row}>, paths array<{path}>"), "pieces")
    spanning = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    chosen = scratch.write(pieces.where("whole").unionByName(spanning).mapInArrow(_choose, f"conv_id {kind}, {CHOSEN}"), "chosen")
    audits = chosen.where("is_first").select("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit")
    edits = scratch.write(chosen.select("conv_id", "part", "state", "letters", "rows").mapInArrow(_edits, f"conv_id {kind}, {EDIT}"), "edits")
    texts = equal.select(*[F.col(c).alias(f"_{c}") for c in order], "text")
    match = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))
    kept = edits.where("key is not null").join(texts, match).select("conv_id", "part", "place", F.col("new_role").alias("role"), "text")
    put_in = edits.where("key is null").select("conv_id", "part", "place", F.col("new_role").alias("role"), F.lit("").alias("text"))
    scratch.drop("marked", "pieces")
    return audits, kept.unionByName(put_in)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to the SHA-256 of each conversation's ``role:text`` lines, fed turn by turn."""
    held, kind = None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    done.append((held[0], held[1].hexdigest()))
                held = (conv, hashlib.sha256())
            else:
                held[1].update(b"\n")
            held[1].update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([held[1].hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired turns."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def repaired(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """A row for every ``original`` conv_id: the audit of its ``damaged`` rows and the digest of what they become; zeros, no letters and the digest of nothing where none are left."""
    audits, turns = repair(damaged)
    ids = original.select("conv_id").distinct()
    found = audits.withColumnRenamed("conv_id", "_a").join(digests(turns).withColumnRenamed("conv_id", "_d"), F.col("_a").eqNullSafe(F.col("_d")), "left")
    numbers = ["gaps", *FAULTS, "illegal", "cost"]
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_a")), "left")
    filled = {n: F.coalesce(n, F.lit(0)).cast("long") for n in numbers}
    return out.withColumns({**filled, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}).select("conv_id", *numbers, "audit", "repaired_sha256")
