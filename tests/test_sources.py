"""Landing, merges and pipelines on small files."""

from __future__ import annotations

import contextlib
import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from condmon.operators import quality
from condmon.plans import pipelines
from condmon.sources import landing, merging

NAMES = ["idx_raw", "ts_raw", "value_raw", "active_raw"]
CSV = ",timestamp,value,on\n1,2024-01-01 00:00:00,1.5,1.0\n2,2024-01-01 00:00:10,nan,0.0\n3,2024-01-01 00:00:20\n4,2024-13-01 00:00:30,2,1.0\n5,2024-01-01 00:00:40,3,7\n5,2024-01-01 00:00:50,3,1.0\n"


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "log.csv").write_text(CSV)
    return str(tmp_path / "log.csv")


def test_raw_rows_keep_all_text(spark, csv):
    df = landing.read_log(spark, csv, NAMES, "idx_raw", "abc", "v1")
    rows = df.orderBy("ts_raw").collect()
    assert len(rows) == 6 and rows[0]["source_filename"] == "log.csv"
    assert [r["corrupt_record"] for r in rows if r["idx_raw"] == "3"] == ["3,2024-01-01 00:00:20"]
    first = next(r for r in rows if r["idx_raw"] == "1")
    assert first["record_id"] == hashlib.sha256(b"log|abc|1").hexdigest()


def test_quality_of_a_dirty_file(spark, csv):
    raw = landing.read_log(spark, csv, NAMES, "idx_raw", "abc", "v1").withColumn("asset", F.lit(1))
    got = {(r["idx_raw"], r["ts_raw"]): list(r["reasons"]) for r in quality.annotate(raw, quality.Contract(), "asset", 20).collect()}
    assert got["1", "2024-01-01 00:00:00"] == []
    assert got["2", "2024-01-01 00:00:10"] == ["invalid_value"]
    assert got["3", "2024-01-01 00:00:20"][:1] == ["malformed_csv"]
    assert got["4", "2024-13-01 00:00:30"] == ["invalid_ts"]
    assert got["5", "2024-01-01 00:00:40"] == ["invalid_domain_active", "duplicate_idx"]
    assert got["5", "2024-01-01 00:00:50"] == ["duplicate_idx"]


def test_files_against_a_manifest(spark, csv, tmp_path):
    (tmp_path / "extra.csv").write_text("x")
    found = landing.file_identities(spark, f"{tmp_path}/*.csv")
    good = hashlib.sha256(CSV.encode()).hexdigest()
    manifest = spark.createDataFrame([("log.csv", len(CSV), good.upper()), ("gone.csv", 1, "0")], "name string, size long, sha256 string")
    assert {r["name"]: r["status"] for r in landing.reconcile_files(found, manifest).collect()} == {"log.csv": "ok", "gone.csv": "missing", "extra.csv": "unlisted"}


def test_identity_of_a_file_of_three_gigabytes(spark, tmp_path):
    """A sparse file, streamed: the worker's memory stays far below the file's size."""
    import psutil

    size, tail = 3 << 30, b"the end"
    with open(tmp_path / "large file.bin", "wb") as f:
        f.seek(size - len(tail))
        f.write(tail)
    (tmp_path / "small.bin").write_bytes(b"x")
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            workers = [p for p in psutil.Process().children(recursive=True) if "python" in p.name()]
            with contextlib.suppress(psutil.Error):
                most[0] = max(most[0], *(p.memory_info().rss for p in workers), 0)

    thread = threading.Thread(target=watch)
    thread.start()
    got = {r["name"]: (r["size"], r["sha256"]) for r in landing.file_identities(spark, f"{tmp_path}/*.bin").collect()}
    over.set()
    thread.join()
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size // len(zeros) - 1):
        want.update(zeros)
    want.update(zeros[: -len(tail)] + tail)
    assert got == {"large file.bin": (size, want.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}
    assert 0 < most[0] < 1 << 30


def test_pipeline_reruns_add_nothing(spark, csv, tmp_path):
    with pytest.raises(ValueError, match="repeated_keys': 1"):
        pipelines.land(spark, csv, NAMES, "idx_raw", "abc", "v1", f"{tmp_path}/refused")
    good = "".join(x for x in CSV.splitlines(keepends=True) if not x.endswith("3,7\n"))
    (tmp_path / "good.csv").write_text(good)
    for n in range(2):
        raw = pipelines.land(spark, f"{tmp_path}/good.csv", NAMES, "idx_raw", "abc", "v1", f"{tmp_path}/raw").withColumn("asset", F.lit(1))
        assert raw.count() == 5
        accepted = pipelines.validate(raw, quality.Contract(), f"{tmp_path}/silver-{n}", 20, ["source_sha256"])
        found = pipelines.derive_cycles(accepted, f"{tmp_path}/cycles")
        assert found.count() == accepted.where("active = 1").count() == 2
    assert merging.versions(spark, f"{tmp_path}/cycles") == [1, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        merging.create(raw, f"{tmp_path}/raw")


CYCLE = "cycle_id string, start_record_id string, start_type string, start_ts string, stop_ts string, n_observations long, right_censored boolean"


def test_monotonic_merge(spark):
    target = [("a", "a", "observed", "0", None, 2, True), ("b", "b", "observed", "0", "5", 2, False), ("c", "c", "observed", "0", None, 4, True), ("d", "d", "observed", "0", None, 4, True), ("e", "e", "observed", "0", None, 1, True), ("g", "g", "observed", "0", "1", 1, False)]
    source = [("a", "a", "observed", "0", None, 3, True), ("b", "b", "observed", "0", "6", 2, False), ("c", "c", "observed", "0", None, 3, True), ("d", "x", "observed", "0", None, 9, True), ("e", "e", "observed", "0", "9", 1, False), ("f", "f", "observed", "0", None, 1, True)]
    got = merging.monotonic_merge(spark.createDataFrame(target, CYCLE), spark.createDataFrame(source, CYCLE), ["cycle_id"])
    assert {r["cycle_id"]: (r["action"], r["n_observations"]) for r in got.collect()} == {"a": ("update", 3), "b": ("conflict", 2), "c": ("conflict", 4), "d": ("conflict", 4), "e": ("update", 1), "f": ("insert", 1), "g": ("keep", 1)}


def test_immutable_merge_and_reconciliation(spark):
    t = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    s = spark.createDataFrame([(1, None), (2, "z"), (4, "w")], "k long, v string")
    assert {r["k"]: r["action"] for r in merging.immutable_merge(t, s, ["k"], ["v"]).collect()} == {1: "equal", 2: "conflict", 4: "insert"}
    assert {r["k"]: r["problem"] for r in merging.reconcile(t, s, ["k"], ["v"]).collect()} == {2: "changed", 4: "missing"}


def test_events_and_tables_are_read(spark, csv, tmp_path):
    df = landing.read_events(spark, csv, NAMES, "idx_raw", "abc", "v1", "doc")
    assert df.count() == 6 and {r["document_sha256"] for r in df.collect()} == {"doc"}
    spark.range(3).write.parquet(f"{tmp_path}/t")
    spark.range(4).createOrReplaceTempView("some_table")
    assert landing.read_table(spark, f"{tmp_path}/t").count() == 3 and landing.read_table(spark, "some_table").count() == 4


def test_immutable_sink(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string, version string")
    write = lambda rows: merging.write_immutable(make(rows), f"{tmp_path}/t", ["k"], ["v"], ["version"])
    assert write([(1, "a", "v1"), (2, None, "v1")]) == 2
    assert write([(1, "a", "v1"), (2, None, "v1"), (3, "c", "v1")]) == 1
    assert write([(1, "a", "v1")]) == 0
    with pytest.raises(ValueError, match="1 rows were changed"):
        write([(2, "x", "v1"), (4, "d", "v1")])
    with pytest.raises(ValueError, match="another lineage"):
        write([(5, "e", "v2")])
    with pytest.raises(ValueError, match="more than one lineage"):
        write([(5, "e", "v1"), (6, "f", "v2")])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_split_that_does_not_add_up_writes_nothing(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="add up"):
        merging.write_split(df.where("id < 1"), df.where("id > 1"), f"{tmp_path}/s", ["id"], 3)
    assert not merging.exists(spark, f"{tmp_path}/s/accepted")


def test_pipelines_from_cycles_to_policies(spark, sf_dir, tmp_path):
    """PIPE4 to PIPE10 and PIPE12 on the smallest tables, each step written and read again."""
    from condmon.operators import models, snapshots
    from condmon.plans import adapters as A

    def kept(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    run = A.Run(spark, sf_dir, A.WINDOWS)
    seq, failures = kept(run.sequence(), "seq"), kept(run.failures(), "failures")
    cycle_rows = kept(run.cycle_rows(), "cycles")
    lineage = {"dataset_version": F.lit("events-v1")}
    label_rows = kept(pipelines.label_cycles(cycle_rows, failures, seq, A.HORIZON), "labels")
    snaps = kept(pipelines.feature_snapshots(cycle_rows, seq, "value", A.WINDOW, A.GAP, lineage), "snapshots")
    v1 = snaps.drop(*snapshots.CONTEXT).withColumn("snapshot_version", F.lit(snapshots.SNAPSHOT_V1))
    kept(v1, "v1")
    from condmon.operators import cycles

    again = pipelines.expand_snapshots(f"{tmp_path}/v1", cycles.context(cycle_rows), f"{tmp_path}/v2")
    assert snapshots.table_difference(snaps, again).isEmpty()
    with pytest.raises(ValueError, match="snapshot_version"):
        pipelines.expand_snapshots(f"{tmp_path}/snapshots", cycles.context(cycle_rows), f"{tmp_path}/v3")
    view = kept(pipelines.modelling_view(snaps, label_rows, {"failure_dataset_version": F.lit("errors-v1")}), "view")
    assert view.count() == cycle_rows.count() and view.where("row_status = 'trainable'").count() > 0
    with pytest.raises(ValueError, match="differ in keys"):
        pipelines.modelling_view(snaps, label_rows.limit(5), {})
    inputs = ["win_count", "win_mean"]
    few = [models.Candidate("count", ("win_count",)), models.Candidate("both", tuple(inputs))]
    assert pipelines.compare_candidates(view, few, A.VALIDATION_START, A.TEST_START).count() == 2
    scored = kept(pipelines.score(view, inputs, A.VALIDATION_START, A.TEST_START, "validation"), "scored")
    grid = {"shares": (0.5, 0.9), "persistence": (1,)}
    assert pipelines.evaluate_policies(scored, failures, A.HORIZON, **grid).count() == 2
    population, metrics = pipelines.held_out(scored, failures, A.HORIZON, **grid)
    assert population.first()["n_rows"] == scored.count() and metrics.count() == 2
    covered = kept(run.covered(), "covered")
    found = pipelines.profiles_of(cycle_rows, label_rows, covered, view, [("all", False, None)], [("one", A.VALIDATION_START, A.TEST_START)])
    assert len(found) == 10 and all(df.count() > 0 for df in found.values())
