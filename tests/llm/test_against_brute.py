from __future__ import annotations

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from condmon.llm import chat_format, common, decontam, jaccard_join, license_scan, pfp_dedup, quality_rules, token_pack, url_filter
from condmon.llm import queries as Q

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


ODD = [
    (None, "a null id with a few words to fill the line and one more"),
    (-1, None),
    (-2, ""),
    (-3, " \n\t\x0b\x0c\r "),
    (-4, "one two"),
    (-5, "One  TWO"),
    (-6, "x " * 3000),
    (-7, "spam and eggs " * 5000),
    (-8, "All Rights Reserved. all rights reserved CC-BY cc by all all rights reserved"),
    (-8, "A second text under one id, CC BY, with words enough to be kept by the rules"),
    (-9, "é" * 900 + "\x1c \x1d z <|endoftext|> tail  \n\n  end "),
    (-9, "é" * 900 + "\x1c \x1d z <|endoftext|> tail  \n\n  end "),
    (-10, "\u212a cc\u00a0by GENERAL public-License"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "n_words": F.lit("clash"), "score": F.lit("clash"), "token": F.lit(1), "rep": F.lit(1), "h": F.lit(1), "n": F.lit(2)})


def rows_of(df, *names):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def expect(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_quality_rules(spark, docs):
    data = docs + ODD
    df = quality_rules.apply_rules(frame(spark, data).repartition(5))
    got = rows_of(df, "doc_id", *quality_rules.METRICS, "base_failed")
    assert got == expect([(i, *brute.quality(t)) for i, t in data])
    assert df.where("base_failed and kept").count() == 0


def test_rule_order_does_not_change_verdicts(spark, docs):
    rules = quality_rules.default_rules()
    a = rows_of(quality_rules.apply_rules(frame(spark, docs), rules, sample_rows=16), "doc_id", "kept")
    b = rows_of(quality_rules.apply_rules(frame(spark, docs), rules[::-1], sample_rows=200), "doc_id", "kept")
    assert a == b
    ordered = quality_rules.estimated(frame(spark, docs), rules, 64)
    assert [r.rejects / r.cost for r in ordered] == sorted((r.rejects / r.cost for r in ordered), reverse=True)


@pytest.mark.parametrize("most", [100_000, 0])
def test_license_scan(spark, docs, most, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", most)
    lines = ["This work is licensed under the GNU General Public License version 2 only", "This work is licensed under the GNU General Public License version 3."]
    lines += ["licensed under the license apache version 2 0", "Licensed under the Apache License, Version 2.0", "under licensed the version 2 apache license 0 the apache license"]
    lines += ["licensed under cc by nc 4 0 " * 40, "the mit license released under " * 9, "this source code form so is subject to these terms of the mozilla public license", "license " * 3000, "cc by " * 3000]
    data = docs + ODD + [(6000 + k, x) for k, x in enumerate(lines)]
    found = license_scan.scan(frame(spark, data).repartition(5)).collect()
    key = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = []
    for i, t in data:
        labels, score = brute.licenses(t, license_scan.TEMPLATES)
        want.append((i, *brute.phrases(t), labels, round(score, 9)))
    assert key([(*(r[n] for n in names[:-1]), round(r["score"], 9)) for r in found]) == key(want)
    got = {r["doc_id"]: r["labels"].split(",") for r in found}
    assert "gpl-2" in got[6000] and "gpl-3" not in got[6000] and "gpl-3" in got[6001] and "apache" not in got[6002] and "apache" in got[6003]


def test_license_line_with_a_word_put_in(spark):
    text = "some text before released under the fine mit license and after it"
    got = license_scan.scan(frame(spark, [(1, text)])).first()
    assert got["labels"] == "mit" and 0.7 < got["score"] < 1 and got["n_base"] == 0


def text_hash(text):
    """Spark's xxhash64."""
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >= 1 << 63 else h


def test_tokens_of_other_ids(spark):
    rows = [("b", "one text"), ("a", "two texts"), (None, None), ("b", "three\n\ntexts"), ("b", "three\n\ntexts"), ("c", "x" * 3_000_000)]
    files = token_pack.write_tokens(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), Q.tokenizer_json(), 2)
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_pack.read_tokens(files).orderBy("start").collect()]
    assert [i for i, _, _ in got] == [None, "a", "b", "b", "b", "c"] and got[0] == (None, 0, 1)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_starts_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_pack, "SHARDS", 3)
    files = spark.range(40).select((F.col("id") % 20).cast("int").alias("shard"), F.col("id").alias("n_ids"))
    n = [2 * k + 20 for k in range(20)]
    assert {tuple(r) for r in token_pack.shard_starts(files).collect()} == {(k, sum(n[:k])) for k in range(20)}


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    data = docs + ODD
    conf = Q.tokenizer_json()
    tok = Tokenizer.from_str(conf)
    start, rows = 0, []
    for i, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        rows.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = rows_of(token_pack.token_index(frame(spark, data).repartition(7), conf, 2), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expect(rows)


def test_pieces_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    conf = Q.tokenizer_json()
    tok, encode, rng = Tokenizer.from_str(conf), token_pack.encoder(conf), random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x01", "\x85", "a", "Zé", "'s", "don't", "12", "!?", ".", ",", "|", "word", "é", "ß", "_", "'ll", "<|endoftext|>", "<|end", "\ufeff", "日本", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    plain = [" ", " ", " ", "\n", "\n\n", "a", "Zé", "don't", "12", "!?", ".", ",", "word", "x.", "3.5", "e.g.", "...", "<|endoftext|>", "日本"]
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 14))) for _ in range(3000)]
    texts += ["one\n\ntwo, three.\nfour", "a\n\n\nb", " lead", "trail ", "trail\n", "\nlead", "a\n b", "a \nb", "x\u2003y z", "\n", "\n\nq", "Ünd so, weiter: »ja«\n\n<|endoftext|> end", "", "?", "word " * 50_000]
    for size in (1 << 10, 1 << 22):
        got = [x.tolist() for _, part in token_pack.by_size(pa.array([*texts, None], pa.large_string()), size) for x in encode(part)]
        assert len(got) == len(texts) + 1 and got[-1] == []
        for text, ids in zip(texts, got):
            assert ids == tok.encode(text, add_special_tokens=False).ids, repr(text[:200])


def test_blocks_round_trip():
    import numpy as np

    rng = np.random.default_rng(3)
    for ids in ([], [0], [7] * 10, [2**32 - 1, 0], rng.integers(0, 50257, 30_000), np.r_[rng.integers(100, 130, 5000), 2**31, rng.integers(0, 2**32, 50)]):
        ids = np.array(ids, "<u4")
        payload = token_pack.pack(ids, block=1000)
        assert (token_pack.unpack(payload) == ids).all()
        assert (token_pack.unpack(payload, 2, 4) == ids[2000:4000]).all()


@pytest.mark.parametrize("most", [50_000, 0])
def test_urls(spark, sf_dir, most, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    urls = [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "http://COM/", "http://com", "x://a://b.com/", "http://x.Example.com/en/1", "http://xexample.com/en/1", "https://www.example.com/en/?q"]
    urls += ["http://a.www.example.com/en/x#y", "http://a.net/es/", "http://a.net/es", "http://net/fr/\nx", "http://a.net?x=/es/", "http://a.com:80/en/", "http://b.org/EN/", *urls[:5]]
    rows = list(enumerate(urls))
    df = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit("clash")))
    got = {r["page_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, rule, verdict = brute.url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict in (None, got[i]["verdict"])
    extra = url_filter.judge(spark.createDataFrame([(1, "https://spam-farm.example.org/en/1")], "page_id long, url string")).first()
    assert (extra["verdict"], extra["rule"], extra["pattern"]) == ("block", None, "farm")


@pytest.mark.parametrize("most", [50_000, 0])
def test_urls_against_many_rules(spark, most, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rng = random.Random(6)
    given = [(f"h{k}.example" if k % 2 else f"s{k % 50}.h{k // 2}.net", f"/p{k % 7}/", rng.choice(["allow", "block"])) for k in range(1500)]
    rules = url_filter.rule_table(spark, [*(url_filter.host_rule(*r) for r in given), url_filter.pattern_rule("any", "block", r"/bad", ())])
    urls = [f"http://{rng.choice(['', 'www.'])}{h}{p}{rng.choice(['', 'x', 'bad'])}" for h, p, _ in rng.choices(given, k=300)] + ["http://other.org/bad", "http://other.org/", None, None]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute.url(u, given)
        assert got[i] == (rule, verdict or ("block" if "/bad" in path else "allow")), u


@pytest.mark.parametrize("length", [40, 400])
def test_repeats(spark, docs, length):
    rng = random.Random(length)
    data = docs[:60] if length == 40 else docs + [x for x in ODD if x[0] != -7]
    base = [t for _, t in docs if len(t) > 1500][:12]
    for k, t in enumerate(base):  # edits and cuts at chosen places
        p = rng.randint(300, len(t) - 300)
        data.append((1000 + k, t[:p] + "#" + t[p + 1 :]))
        data.append((2000 + k, t[p - 250 : p + 700]))
        data.append((3000 + k, "q" * rng.randint(0, 50) + t[p - 201 : p + 199] + "z" * 30))
        data.append((4000 + k, t[p - 200 : p + 199]))
    data += [(5000, "ab" * 700), (5001, "ab" * 300 + "c" * 900)]
    want = expect([(i, *x) for (i, _), x in zip(data, brute.repeats([t for _, t in data], length), strict=True)])
    df = frame(spark, data).repartition(5)
    spread = 256 if length == 400 else 16
    if length == 400:
        found = pfp_dedup.remove_repeats(df, length)
    else:
        spans = pfp_dedup.removed_spans(df, length, spread, 4)
        texts = df.select("doc_id", F.xxhash64("text").alias("tk"), "text")
        joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["tk"] == spans["tk"]), "left")
        found = joined.select(texts["doc_id"], "text", "spans").mapInArrow(pfp_dedup._cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeats_far_into_a_long_text(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=600))
    filler = rng.randbytes(9_000_000).hex()[:17_500_000]
    long = filler[:17_000_000] + passage + filler[17_000_000:]
    df = spark.createDataFrame([(1, long), (2, "Before it. " + passage + "zzz")], "doc_id long, text string")
    got = rows_of(pfp_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got == [(1, len(long), 600, 1), (2, 614, 600, 1)]


@pytest.mark.parametrize("piece", [17, 300, 4096])
def test_phrases_and_runs_do_not_depend_on_the_pieces(piece):
    import pyarrow as pa

    rng = random.Random(piece)
    texts = [rng.randbytes(rng.randint(0, 900)).hex() for _ in range(20)] + ["ab" * 900, "", None, rng.randbytes(9000).hex()]
    ids, length, spread = list(range(len(texts))), 40, 16
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], names=["doc_id", "tk", "text"])
    rows = lambda found: [r for b in found for r in b.to_pylist()]
    whole = rows(pfp_dedup._first_pass([batch], length, spread))
    assert rows(pfp_dedup._first_pass([batch], length, spread, piece)) == whole and len(whole) > 500
    windows = sorted((r["doc_id"], p) for r in whole for p in range(r["first"], r["last"] + 1))
    assert windows == [(i, p) for i, t in zip(ids, texts, strict=True) for p in range(len(t or "") - length + 1)]
    listed = [[{k: r[k] for k in ("t", "first", "last")} for r in whole if r["doc_id"] == i] for i in ids]
    opened = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts), pa.array(listed)], names=["doc_id", "tk", "text", "open"])
    assert rows(pfp_dedup._run_pass([opened], length, 4, piece)) == rows(pfp_dedup._run_pass([opened], length, 4))


def test_memory_of_a_long_text():
    import tracemalloc

    import pyarrow as pa

    text = random.Random(5).randbytes(15_000_000).hex()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "tk", "text"])
    opened = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text]), pa.array([[{"t": 29_000_100, "first": 29_000_000, "last": 29_000_090}]])], names=["doc_id", "tk", "text", "open"])
    for run in (lambda: pfp_dedup._first_pass([batch], 400, 256), lambda: pfp_dedup._run_pass([opened], 400, 16)):
        tracemalloc.start()
        n = sum(b.num_rows for b in run())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 0 and most < 3 * len(text) + (160 << 20)


def edited(text: str, share: float, rng: random.Random) -> str:
    return " ".join(f"w{rng.randint(0, 10**9)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("block", [128, 6])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(2)
    data = list(docs) + [x for x in ODD if x[0] is not None and x[0] not in (-8, -9)]
    base = [t for _, t in docs if len(t) > 400][:25]
    for k, t in enumerate(base):
        data += [(10_000 + 100 * k + j, edited(t, rng.choice([0.005, 0.01, 0.02, 0.03, 0.04]), rng)) for j in range(6)]
    data += [(90_000 + j, edited(base[0], 0.02, rng)) for j in range(40)]
    want = brute.near([i for i, _ in data], [t for _, t in data])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, data).repartition(5)).collect()}
    assert got == want


def test_trees_prune_unrelated_nodes():
    import numpy as np

    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype("u8"))
    shared = draw(50)
    for sets in (
        [draw(n) for n in [*rng.integers(200, 211, 64), *rng.integers(500, 521, 64)]],
        [np.unique(np.r_[shared, draw(n)]) for n in rng.integers(100, 401, 128)],
    ):
        sizes = np.array([len(s) for s in sets])
        found = list(jaccard_join.trees([jaccard_join.signature(s, jaccard_join.width(len(s))) for s in sets], sizes))
        assert not any(len(tree.pairs()[0]) for _, tree, _ in found)
        tested, kept = (sum(tree.walked[1][k] for _, tree, _ in found) for k in (0, 1))
        assert tested > 500 and kept < tested / 3, (tested, kept)
    # Clusters of near copies: nodes above the lowest are pruned as well.
    sets = [np.unique(np.r_[base, draw(4)]) for base in [draw(300) for _ in range(8)] for _ in range(16)]
    sizes = np.array([len(s) for s in sets])
    cut = np.stack([jaccard_join.signature(s, 2048) for s in sets])
    tree = jaccard_join.Tree(cut, sizes, sizes, jaccard_join.ones(cut))
    i, j = tree.pairs()
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a in range(128) for b in range(a + 1, a // 16 * 16 + 16)}
    assert tree.walked[2][1] < tree.walked[2][0] / 2 and tree.walked[1][1] < 0.7 * tree.walked[1][0], tree.walked


def templated(spark, n, shared=170, own=30, first=0):
    """Pages of one template that share most words and link with nobody."""
    words = F.transform(F.sequence(F.lit(1), F.lit(own)), lambda j: F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("x"), j.cast("string")))
    frame_words = " ".join(f"t{k}" for k in range(shared + 4))
    return spark.range(first, first + n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit(frame_words + " "), F.array_join(words, " ")).alias("text"))


def test_pages_of_one_template_gather_nobody(spark, monkeypatch):
    seen = []
    whole = jaccard_join.gathered
    monkeypatch.setattr(jaccard_join, "gathered", lambda classes: seen.append(whole(classes).count()) or whole(classes))
    for n in (500, 2000):
        got = jaccard_join.near_duplicates(templated(spark, n)).collect()
        assert len(got) == n and all(r["component_id"] == r["doc_id"] for r in got)
    assert seen == [0, 0]
    # Pages with few words of their own do link, and find their way past those with many.
    few = templated(spark, 300, own=15, first=10_000)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(templated(spark, 500).unionByName(few)).collect()}
    assert got == {k: k for k in range(500)} | {10_000 + k: 10_000 for k in range(300)}


def test_only_what_may_link_moves_again(spark, monkeypatch):
    """Shingles of unlike texts don't move behind the counts; what moves gathers the same classes."""
    rng, moved = random.Random(11), []
    words = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    base = words(200)
    rows = [(k, words(rng.randint(50, 150))) for k in range(400)] + [(1000 + k, base.replace(" ", f" y{k} ", 1)) for k in range(8)]
    whole = jaccard_join.shared

    def spied(classes, scratch):
        out = whole(classes, scratch)
        every = classes.selectExpr("rep", f"{jaccard_join.FRONT} as k", "posexplode(prefix) as (place, token)").selectExpr("rep", "token", "place < k as front")
        assert rows_of(jaccard_join.gathered(out), "leader", "rep", "front") == rows_of(jaccard_join.gathered(every), "leader", "rep", "front")
        moved.append((out.count(), every.count()))
        return out

    monkeypatch.setattr(jaccard_join, "shared", spied)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: 1000 if k >= 1000 else k for k, _ in rows}
    assert 8 <= moved[0][0] < 0.1 * moved[0][1]


def test_sets_are_made_of_wanted_texts_alone(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(k, f"one two three four five six n{k}") for k in range(1000)], "doc_id long, text string").withColumn("h", F.xxhash64("doc_id", "text"))
    bits = spark.sparkContext.broadcast(common.bloom(docs.where("doc_id % 100 = 7").select("h")))
    got = pa.Table.from_batches(jaccard_join._sets(iter(docs.select("doc_id", "h", "text").toArrow().to_batches()), bits)).to_pydict()
    assert set(range(7, 1000, 100)) <= set(got["doc_id"]) and len(got["doc_id"]) < 30 and all(len(t) == 24 for t in got["tokens"])


def test_near_duplicates_of_other_ids_and_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(300_000))
    rows = [("b", long), ("a", long.replace("w1", "w2", 3)), ("c", "x" * 3_000_000 + " y"), ("d", "x" * 3_000_000 + " z")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_near_duplicates_of_many_repeated_rows(spark):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("one text that many rows repeat under the same few ids").alias("text"))
    assert {tuple(r) for r in jaccard_join.near_duplicates(docs).collect()} == {(k, 7, 0) for k in range(3)}


def test_near_duplicates_of_null_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (5, "A B C D E F G")]
    got = rows_of(jaccard_join.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == expect([(None, 3, None), (None, 3, None), (3, 3, 3), (4, 0, 4), (5, 3, 3)])


def test_near_duplicates_of_shared_ids(spark):
    x, y = "alone a b c d e f g h", " ".join(f"y{k}" for k in range(60))
    rows = [(5, x), (5, y), (3, y + " more"), (9, y.upper()), (5, x)]
    got = rows_of(jaccard_join.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == expect([(5, 5, 5), (5, 56, 3), (3, 57, 3), (9, 56, 3), (5, 5, 5)])


def test_decontamination(spark):
    q1 = "A train leaves Boston at 9 am with 120 people and Anna counts 40 of them while the train runs at 60 mph for 3 hours."
    q2 = "Every garden has seven trees in five rows and nobody knows which of them will bear fruit first"
    bench = spark.createDataFrame([(1, q1), (2, q2), (3, None), (4, "too short"), (5, "six plain words stand here alone")], "item_id long, text string")
    swap = q1.replace("Boston", "Denver").replace("120", "350").replace("Anna", "Mia").replace("40", "77")
    mixed = "A train leaves Boston at 60 am with 120 people and 60 more of them while the train waits for 60 men."
    rows = [(10, "Some words first. " + q1 + " And more."), (11, "intro\n" + swap), (12, q2.upper()), (13, "Nothing here at all, only some plain words in a row to read."), (14, None), (15, "")]
    rows += [(16, "we say six plain words stand here alone today"), (17, mixed), (10, "Some words first. " + q1 + " And more."), (None, q2)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (16, 5), (None, 2)}
    assert got[11, 1]["reworded"] and not got[10, 1]["reworded"] and not got[12, 2]["reworded"]
    kept = rows_of(decontam.clean(frame(spark, rows), bench), "doc_id")
    assert kept == expect([(13,), (14,), (15,), (17,)])


def test_literal_copies_without_plain_words_or_names(spark):
    tank = "A tank holds 40 kg, 12 cm by 30 cm by 45 cm, and drains 5 kg in 3 hours."
    names = "Anna gave Ben 5 apples, and then Ben gave Carl 3 pears before Anna left the market for Paris with Dora."
    bench = spark.createDataFrame([(1, tank), (2, names)], "item_id long, text string")
    rows = [(10, "Before it. " + tank + " After it."), (11, tank.lower()), (12, tank.upper()), (20, names.lower()), (21, "so " + names.upper()), (22, names)]
    rows += [(30, "A box holds 41 g, 13 mm by 31 mm by 46 mm, or loses 6 g in 4 days."), (31, "12 cm by 30 cm by 45 cm of cloth")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 1), (20, 2), (21, 2), (22, 2)}
    assert all(r["share"] == 1 and not r["reworded"] and r["n_windows"] == r["item_words"] - 7 for r in got.values())


def test_items_dense_in_numbers_with_other_numbers(spark):
    pens = "Tom buys 3 pens for 4 dollars, 5 cups for 6 dollars and 2 hats for 9 dollars in 1 day."
    tank = "A tank holds 40 kg, 12 cm by 30 cm by 45 cm, and drains 5 kg in 3 hours."
    sums = "7 + 8 = 15 and 9 + 4 = 13 or 6 + 5 = 11 ."
    twice = "Tom has 5 red pens and 5 blue ones in his bag."
    bench = spark.createDataFrame([(1, pens), (2, tank), (3, sums), (4, twice), (4, twice), (None, pens)], "item_id long, text string")
    rows = [(10, "So: " + "Tom buys 13 pens for 24 dollars, 35 cups for 46 dollars and 52 hats for 69 dollars in 71 days."), (11, "A tank holds 41 g, 13 mm by 31 mm by 46 mm, and drains 6 g in 4 days.")]
    rows += [(12, "1 + 2 = 3 and 4 + 5 = 9 or 6 + 7 = 8 ."), (13, twice.replace("5", "8")), (14, twice.replace("5", "8", 1).replace("5", "9"))]
    rows += [(15, "Ann sells 3 pens for 4 dollars, or 5 cups for 6 dollars but 2 hats for 9 dollars in 1 day."), (16, "He came in at 5 and m stood for the s in l and g")]
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert got == {(10, 1): True, (10, None): True, (11, 2): True, (12, 3): True, (13, 4): True}
    assert brute.contaminated(rows, [(1, pens), (2, tank), (3, sums), (4, twice)]).keys() == {k for k in got if k[1] is not None}
    assert brute.template_words("in 5 in, a m 3m at $ 4") == [("in", "in", True), ("<num>", "5", False), ("<unit>", "in", False), ("a", "a", True), ("m", "m", True), ("<num>", "3", False), ("<unit>", "m", False), ("at", "at", True), ("<unit>", "$", False), ("<num>", "4", False)]


def test_clean_texts_of_shared_and_null_ids_stay(spark):
    item = "Every garden has seven trees in five rows and nobody knows which of them will bear fruit first, so the owner waits until late in autumn"
    words, fine = item.split(), "Nothing here at all, only some plain words in a row to read."
    halves = [" ".join(["start of it", *words[:8], "then else"]), " ".join(["other one", *words[12:20], "and out"])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, fine), (None, halves[0]), (None, halves[1]), (7, fine), (7, "copied: " + item), (8, halves[0]), (8, halves[1]), (9, None)]
    assert rows_of(decontam.leaks(frame(spark, rows), bench), "doc_id", "item_words") == [(None, len(words)), (7, len(words))]
    kept = rows_of(decontam.clean(frame(spark, rows + rows[:2]), bench), "doc_id", "text")
    assert kept == expect([(None, fine), (None, fine), (None, halves[0]), (None, halves[1]), (7, fine), (8, halves[0]), (8, halves[1]), (9, None)])


@pytest.mark.parametrize("most", [1 << 28, 64])
def test_decontamination_against_brute_force(spark, docs, sf_dir, most, monkeypatch):
    """Also with a filter so small that it lets everything through."""
    monkeypatch.setattr(common, "MOST_BITS", most)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(9001, "Paris"), (9002, "forty two"), (9003, "Anna has 5 apples."), (9004, "On 3 May Anna and Ben ran 10 km in 50 minutes, and Anna won by 2 minutes over Ben."), (9005, None), (9006, "")]
    rng, data = random.Random(12), docs + ODD
    for k, (_, t) in enumerate(items[:40]):
        words = (t or "").split()
        data.append((7000 + k, "Some words before. " + " ".join(words)))
        data.append((7100 + k, " ".join(str(rng.randint(2, 99)) if w.isdigit() else w for w in words)))
        data.append((7200 + k, " ".join(words[: len(words) // 2]) + " and other words " + " ".join(words[len(words) // 2 :])))
    data += [(8001, "Paris"), (8002, "in Paris"), (8003, "Forty  two!"), (8004, "Mia has 7 apples"), (8005, "On 4 June Anna and Ben ran 12 km in 70 minutes, and Anna won by 9 minutes over Ben.")]
    data += [(8006, "On 3 May Anna and Ben ran 10 km in 50 minutes, and Anna won by 2 minutes over Ben. " + "filler words " * 30_000)] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_words"], r["reworded"]) for r in decontam.leaks(frame(spark, data).repartition(5), bench).collect()}
    want = brute.contaminated(data, items)
    assert got == want and {(8001, 9001), (8003, 9002), (8006, 9004)} <= set(got) and (8002, 9001) not in got


def test_a_conversation_of_many_turns(spark):
    """Quadratic copying takes minutes here on a busy machine."""
    n = 20_000
    rows = spark.range(0, n, 1, 4).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    back = chat_format.read_back(chat_format.format_chats(rows)).first()
    assert time.perf_counter() - began < 90
    assert [tuple(t) for t in back["turns"]] == [("assistant" if k % 2 else "user", f"t<|{k}") for k in range(n)]
    assert back["loss_texts"] == [f"t<|{k}" for k in range(1, n, 2)] and back["violation"] is None


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, name, tmp_path):
    for t, schema in {"pages": "page_id long, url string, html string", "conversations": "conv_id long, turn int, role string, text string", "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    # The chat query adds one conversation of its own.
    assert Q.queries()[name](spark, str(tmp_path)).count() == (name == "op4_chat_format")
