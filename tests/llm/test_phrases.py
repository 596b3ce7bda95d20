"""Phrase mining against plain counting of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from condmon.llm import common, phrases, rolling

from . import brute


def plain(rows, least, top=2000):
    total, found = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.ascii_lower(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, 6):
                for k in range(len(ws) - n + 1):
                    found[lang, tuple(ws[k : k + n])] += 1
    out: dict = {}
    for (lang, ws), a in found.items():
        if len(ws) < 2 or a < least:
            continue
        if any(f >= a and len(v) > len(ws) and g == lang and any(v[j : j + len(ws)] == ws for j in range(len(v))) for (g, v), f in found.items() if f >= least):
            continue
        score, _, left, right = min((1000 * a * total[lang] // (found[lang, ws[:k]] * found[lang, ws[k:]]), k, found[lang, ws[:k]], found[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right, total[lang]))
    return sorted((g, r, p.decode(), -a, x, y, n, -s) for g, rows in out.items() for r, (s, a, p, x, y, n) in enumerate(sorted(rows)[:top], 1))


def texts(rng, n):
    vocabulary = ["new", "york", "city", "The", "of", "É", "é", " x", "a\x1cb", "don't", "naïve", "日本"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["new york city hall", "The city of", *vocabulary]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "-", ""]))
        yield "".join(parts), rng.choice(["en", "en", "de", None, ""])


@pytest.mark.parametrize(("burst", "most", "bits"), [(16_384, 400_000, 1 << 28), (3, 25, 1 << 28), (2, 400_000, 64)])
def test_collocations(spark, burst, most, bits, monkeypatch):
    """Also with containers that burst, subtrees that spill and a filter that lets everything through."""
    whole = phrases.HatTrie
    monkeypatch.setattr(phrases, "HatTrie", lambda: whole(burst, most))
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rows = [*texts(random.Random(burst), 150), (None, "en"), ("", None), (" \t.,", "en"), ("over and over again " * 3000, "en")]
    rows += [("exactly the same text in many rows", "de")] * 40
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'clash' as phrase", "1 as n", "2 as f", "'x' as rank", "3 as score")
    got = sorted(tuple(r) for r in phrases.collocations(df.repartition(5), 7).collect())
    assert got == plain(rows, 7)
    few = sorted(tuple(r) for r in phrases.collocations(df.repartition(5), 7, 3).collect())
    assert few == plain(rows, 7, 3)


def test_trie_bursts_spills_and_keeps_every_count():
    rng = random.Random(4)
    words = [b"a", b"b", b"c", b"dd"]
    trie, want, got = phrases.HatTrie(burst=4, most=50), Counter(), Counter()
    for _ in range(3000):
        p = rng.choices(words, k=rng.randint(2, 5))
        n = rng.randint(1, 3)
        want[b" ".join(p)] += n
        trie.add("x", p[0], b" ".join(p[1:]), n)
        if trie.total > trie.most:
            assert any(type(t) is phrases.Node for t in trie.trees.values())
            run = list(trie.spill(20))
            for _, phrase, n in run:
                got[phrase] += n
            for first in {p.split()[0] for _, p, _ in run}:
                tree = [p.split() for _, p, _ in run if p.split()[0] == first]
                assert tree == sorted(tree)
            assert trie.total <= 20
    for _, phrase, n in trie.spill(0):
        got[phrase] += n
    assert got == want and trie.total == 0


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    frequent = spark.createDataFrame([("en", "a", 1, big // 2), ("en", "b", 1, 3), ("en", "a b", 2, 3), ("en", "c", 1, big // 3), ("en", "a c", 2, big // 7)], "lang string, phrase string, n_words int, f long")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    got = {r["phrase"]: r["score"] for r in phrases.scored(frequent, totals).collect()}
    assert got == {"a b": 1000 * 3 * big // ((big // 2) * 3), "a c": 1000 * (big // 7) * big // ((big // 2) * (big // 3))}


def test_words_and_hashes():
    words = phrases.Words([b"A b,c  d\te", b"", b"A b"], rolling.Powers())
    assert words.phrases(np.arange(7), 1) == [b"a", b"b", b"c", b"d", b"e", b"a", b"b"]
    assert words.phrases(np.array([0, 2]), 2) == [b"a b", b"c d"] and words.phrases(np.array([2]), 3) == [b"c d e"]
    assert words.piece.tolist() == [0, 0, 1, 1, 1, 3, 3]
    h = words.hashes(2)
    assert h[0] == h[5] and len(set(h.tolist())) == 5
