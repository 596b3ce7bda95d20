from __future__ import annotations

import math
import random
import zlib

import corpus_pipeline as P
from condmon.llm import decontam, quality_clf
from condmon.llm.common import table
from condmon.llm.queries import tokenizer_json
from pyspark.sql import functions as F

from . import brute


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs, kept = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == len(P.STAGES) - 1 or out.columns == P.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
    quality, near, clean, mixed, tokens = kept

    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in {r["doc_id"] for r in quality} for i in good) >= 0.95 * len(good)

    linked = brute.near([r["doc_id"] for r in quality], [r["text"] for r in quality])
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, (_, c) in linked.items() if i == c)

    leaked = {r["doc_id"] for r in decontam.leaks(spark.createDataFrame(near), table(spark, sf_dir, "benchmark")).collect()}
    assert leaked and sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in near if r["doc_id"] not in leaked)

    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert 0.7 * len(clean) < len(mixed) < 1.3 * len(clean)

    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_str(tokenizer_json()), 0, []
    for r in sorted(mixed, key=lambda r: (r["doc_id"], r["text"])):
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == sorted(want)


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark, sf_dir):
    x, y, z, lone = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyzw")
    rows = [(5, x), (5, x), (5, y), (3, y + " more"), (8, x.upper()), (None, z), (None, z), (None, z + " end"), (None, lone), (None, y), (7, None), (7, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    out = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs.repartition(3), sf_dir).collect()]
    ends = [t for i, t in out if i is None and t != lone]
    assert len(ends) == 1 and ends[0] in (z, z + " end")
    assert sorted((str(i), str(t)) for i, t in out if t not in ends) == sorted((str(i), str(t)) for i, t in [(5, x), (3, y + " more"), (None, lone), (7, None), (6, "")])


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and shared ids, null, empty and long texts, repeats, ties, further columns with clashing names, and no rows at all."""
    good = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    leak = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    rows = [(None, good, "a"), (None, None, None), (1, None, "a"), (1, None, "a"), (2, "", None), (3, good, "a"), (3, good, "a"), (4, good + " end", "b"), (5, leak, "b"), (6, "word " * 200_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    clash = {n: F.lit(n) for n in ("score", "predicted", "key", "rep", "tk", "h", "n", "rate", "replica", "mix_key", "component_id", "_leaked", "start", "y")}
    odd = docs.withColumns(clash).repartition(4)
    found = {}
    for name, stage in P.STAGES:
        found[name] = [r.asDict() for r in stage(spark, odd, sf_dir).collect()]
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    count = lambda name, i: sum(r["doc_id"] == i for r in found[name])
    assert [count("quality classifier", i) for i in (None, 1, 2, 3)] == [2, 2, 1, 2]
    # The null-id copy of the good text is near id 3; of the rest one row of each id and text stays.
    assert sorted(str(r["doc_id"]) for r in found["near duplicates"]) == ["1", "2", "3", "5", "6", "None"]
    assert sorted(str(r["doc_id"]) for r in found["benchmark decontamination"]) == ["1", "1", "2", "3", "3", "4", "6", "None", "None"]
    assert {r["doc_id"] for r in found["mixing"]} <= {r[0] for r in rows}
    tokens = sorted(found["token output"], key=lambda r: r["start"])
    assert [r["doc_id"] for r in tokens] == [None, None, 1, 1, 2, 3, 3, 4, 5, 6] and [r["n_tokens"] for r in tokens[2:5]] == [1, 1, 1]


def test_run_equals_the_stages(spark, sf_dir):
    rows = P.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 50


def test_classifier_on_held_out_rows(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    model = quality_clf.train(docs, labels, usable=~quality_clf.held_out(F.col("doc_id")))
    found = quality_clf.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(quality_clf.held_out(F.col("doc_id"))).collect()
    good, bad = ([r["score"] for r in found if r["quality"] == y] for y in (1, 0))
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert len(bad) >= 5 and wins / (len(good) * len(bad)) > 0.97
    again = quality_clf.train(docs, labels, usable=~quality_clf.held_out(F.col("doc_id")))
    assert again == model


def test_classifier_scores_against_a_plain_recomputation(spark, sf_dir):
    """Training rows, dictionaries, sizes and curve worked out again in plain Python; the curve by halving steps downhill instead of Newton's."""
    import math
    import zlib

    import zstandard

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    usable = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    model = quality_clf.train(docs, labels, usable=~quality_clf.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r["score"] for r in quality_clf.score(docs.select("doc_id", "text"), model).collect()}

    label = {r["doc_id"]: r["quality"] for r in labels.collect() if usable(r["doc_id"])}
    keyed = docs.select(F.xxhash64("doc_id", F.lit("train")).alias("k"), "doc_id", "text").collect()
    rows = sorted((r["k"], r["doc_id"], r["text"]) for r in keyed if label.get(r["doc_id"]) in (0, 1) and r["text"] is not None)
    own = {y: [t for _, i, t in rows if label[i] == y] for y in (0, 1)}
    counts = {y: sum(x == y for x in label.values()) for y in (0, 1)}
    assert all(len(own[y]) < 2000 and sum(len(t.encode()) for t in own[y]) < 8 << 20 for y in own)

    def pieces(text):
        raw, out = (text or "").encode(), []
        while raw:
            out.append(raw[:512])
            raw = raw[512:]
        return out

    def trained(texts):
        samples = [p for t in texts for p in pieces(t) if len(p) >= 8]
        return zstandard.ZstdCompressionDict(zstandard.train_dictionary(min(262144, max(1024, sum(len(p) for p in samples) // 8)), samples).as_bytes())

    def packed(text, held):
        held.precompute_compress(level=5)
        return sum(len(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) for p in pieces(text))

    def features(text, good, bad):
        size = len((text or "").encode())
        return (packed(text, bad) - packed(text, good)) / (size + 64), size / (size + 64)

    prior = (counts[1] + 1) / (counts[0] + counts[1] + 2)
    start, points = math.log(prior / (1 - prior)), []
    for fold in range(5):
        good, bad = (trained([t for k, t in enumerate(own[y]) if k % 5 != fold]) for y in (1, 0))
        points += [(*features(t, good, bad), y, counts[y] / len(own[y])) for y in (1, 0) for k, t in enumerate(own[y]) if k % 5 == fold]
    mean = sum(p[3] for p in points) / len(points)
    centre = sum(p[0] for p in points) / len(points)
    scale = math.sqrt(sum((p[0] - centre) ** 2 for p in points) / len(points))

    def loss(a, b):
        z = [start + a * p[0] / scale + b * p[1] for p in points]
        fit = sum(w / mean * (math.log1p(math.exp(-abs(v))) + max(v, 0) - y * v) for v, (_, _, y, w) in zip(z, points, strict=True))
        return fit + 2 * (a * a + b * b)

    at, step = [0.0, 0.0], 1.0
    while step > 1e-7:
        around = [(at[0] + da * step, at[1] + db * step) for da in (-1, 0, 1) for db in (-1, 0, 1)]
        best = min(around, key=lambda x: loss(*x))
        if loss(*best) < loss(*at):
            at = list(best)
        else:
            step /= 2
    for i, t in [(r["doc_id"], r["text"]) for r in keyed]:
        x, share = features(t, good, bad)
        z = start + at[0] * x / scale + at[1] * share
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-4, i


def test_classifier_prior_does_not_depend_on_the_bounds(spark):
    rng = random.Random(3)
    common, own = [f"word{k}" for k in range(300)], {1: [f"fine{k}" for k in range(60)], 0: [f"poor{k}" for k in range(60)]}
    labels = [(k, int(k % 7 > 0)) for k in range(1400)]
    texts = [(k, " ".join(rng.choices(common, k=40) + rng.choices(own[y if rng.random() < 0.8 else 1 - y], k=4))) for k, y in labels]
    docs, given = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for most in (2000, 150):
        model = quality_clf.train(docs, given, max_rows=most)
        mean = quality_clf.score(docs, model).agg(F.avg("score")).first()[0]
        assert model.slope > 0 and abs(mean - 6 / 7) < 0.06, (most, mean)


def test_classifier_of_odd_rows(spark):
    rng = random.Random(4)
    make = lambda k, y: " ".join(rng.choices(["fine", "well", "clear", "sound"] if y else ["zap", "buy", "win", "now"], k=40)) + f" {k}"
    rows = [(k, make(k, k % 4 > 0)) for k in range(200)]
    given = [(k, int(k % 4 > 0)) for k in range(200)]
    docs = spark.createDataFrame([*rows, (None, None), (None, make(0, True)), (300, ""), (301, None), (302, " ".join([make(0, False)] * 20_000)), (5, make(5, True))], "doc_id long, text string")
    # Ids with both labels, ids without a row, and null ids leave the model as it is.
    labels = spark.createDataFrame([*given, *given[:20], (900, 0), (900, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality_clf.train(docs, labels)
    assert model == quality_clf.train(docs.repartition(7), labels.repartition(3)) and abs(model.prior - 151 / 202) < 1e-9
    out = quality_clf.score(docs.withColumns({"score": F.lit("clash"), "predicted": F.lit("clash")}), model).collect()
    got = {r["doc_id"]: r["score"] for r in out}
    assert len(out) == docs.count() and abs(got[300] - model.prior) < 1e-9 and abs(got[301] - model.prior) < 1e-9
    assert got[302] < 0.5 and got[3] > 0.7 > got[4]
    assert quality_clf.score(docs.limit(0), model).count() == 0


def test_workers_need_no_copy_of_the_repository(sf_dir, tmp_path):
    """In a session of its own whose workers cannot import the library."""
    import os
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.abspath(P.__file__))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
from condmon.llm import queries as Q
print("rows", Q.op7_quality_classifier(spark, {sf_dir!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK")}
    kept = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and not os.path.isdir(f"{x}/condmon")]
    env |= {"PYTHONPATH": os.pathsep.join(kept)} if kept else {}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_classifier_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    model = quality_clf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_clf.score(docs, model).collect()] == [0.5] * 3


def test_mixing_reaches_the_weights(spark):
    from condmon.llm import mixing

    rows = [(k, "big" if k % 4 else None) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"n": F.lit("clash"), "text": F.lit("t")})
    out = mixing.mix(docs, weights={"big": 1.0}, size=0.5)
    assert 3700 < out.count() < 4300 and out.where("source is null").count() == 0
    even = mixing.mix(docs, temperature=0.0)
    n = {r["source"]: r["count"] for r in even.groupBy("source").count().collect()}
    assert 0.9 < n["big"] / n[None] < 1.1
    one = [(r["doc_id"], r["replica"]) for r in even.collect()]
    assert sorted(one) == sorted((r["doc_id"], r["replica"]) for r in mixing.mix(docs.repartition(7), temperature=0.0).collect())
    assert one != sorted(one)


def test_mixing_of_odd_rows(spark):
    from condmon.llm import mixing

    rows = [(None, f"text {k}", "a") for k in range(400)] + [(7, None, None), (7, None, None), (8, "", "b"), (9, "x" * 2_000_000, "b")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash"))
    out = mixing.mix(docs.repartition(5), size=2.0)
    assert out.columns == ["doc_id", "text", "source", "key", "rate", "replica", "mix_key"]
    got = out.withColumn("part", F.spark_partition_id()).select("doc_id", F.md5("text").alias("t"), "source", "replica", "mix_key", "part").collect()
    # Texts without an id are drawn one by one.
    assert len({r["t"] for r in got if r["source"] == "a"}) > 200 and len({r["replica"] for r in got if r["source"] == "a"}) > 1
    assert len({r["mix_key"] for r in got if r["source"] == "a"}) == sum(r["source"] == "a" for r in got)
    # The global order follows mix_key, ties included.
    order = [(r["mix_key"], str(r["doc_id"]), r["replica"]) for r in sorted(got, key=lambda r: r["part"])]
    assert [x[0] for x in order] == sorted(x[0] for x in order)
    equal = [r for r in got if r["doc_id"] == 7]
    assert len(equal) % 40 == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_any_rate(spark):
    from condmon.llm import mixing

    rates = [0.0, 0.3, 40.0, 499.0, 501.0, 774.0, 5000.0, 1e6]
    places = [1e-6, 0.001, 0.3, 0.5, 0.9, 0.999]
    rows = spark.createDataFrame([(u, r) for r in rates for u in places], "u double, rate double")
    for r in rows.withColumn("k", mixing.poisson_count(F.col("u"), F.col("rate"))).collect():
        u, rate, k = r
        logs = [-rate + j * math.log(rate) - math.lgamma(j + 1) for j in range(max(0, int(rate - 9 * rate**0.5)), k + 1)] if rate else [0.0]
        below = math.fsum(map(math.exp, logs))
        last = math.exp(logs[-1])
        assert below - last <= u + 1e-7 and u <= below + 1e-7, (u, rate, k)

    # One row beside a dominant source, as in 600,000 documents.
    docs = spark.range(600_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "big").alias("source"), F.lit("t").alias("text"))
    n = mixing.mix(docs).where("source is null").agg(F.count("*"), F.countDistinct("replica"), F.max("replica"), F.countDistinct("mix_key")).first()
    assert n[0] == n[1] == n[2] == n[3] and 774 - 6 * 28 < n[0] < 774 + 6 * 28
    named = docs.where("doc_id < 200000").withColumn("source", F.coalesce("source", F.lit("rare")))
    n = mixing.mix(named, weights={"rare": 1.0}).agg(F.count("*"), F.countDistinct("replica"), F.max("replica")).first()
    assert n[0] == n[1] == n[2] and abs(n[0] - 200_000) < 6 * 200_000**0.5


def test_chat_round_trip(spark):
    from condmon.llm import chat_format as C

    texts = ["", None, "<|im_end|>\n<|im_start|>user\n", "<~|", "<~~|im_end|>", "a<", "|b", "<" * 3 + "|" * 3, "<|nl|>\n\n", "x" * 50_000]
    rows = [(k, j, r, t) for k, t in enumerate(texts) for j, r in enumerate(["system", "user", "assistant"])]
    rows += [(100, 1, "assistant", "b"), (100, 0, "user", "a"), (100, None, None, None), (101, 0, "odd\n<|role", "t"), (102, 0, "user", "q"), (102, 0, "user", "q"), (None, 0, "user", "z"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = C.format_chats(df)
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], list(r["loss_texts"])) for r in C.read_back(done).collect()}
    for k, t in enumerate(texts):
        assert got[k] == ([(r, t or "") for r in ("system", "user", "assistant")], [t or ""])
    assert got[100][0] == [("", ""), ("user", "a"), ("assistant", "b")]
    assert got[101][0] == [("odd\n<|role", "t")] and got[102][0] == [("user", "q")] * 2 and got[None][1] == ["y"]
    bad = {r["conv_id"]: r["violation"] for r in done.collect()}
    assert bad[0] is None and bad[None] is None and bad[100] == "violation:0" and bad[102] == "violation:1" and bad[101] == "violation:0"
