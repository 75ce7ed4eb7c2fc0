"""Deduplication and incremental loads, against brute force on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators.dedup import deduplicate_files
from pairloom.functions.keys import clean_key
from pairloom.operators import incremental
from pairloom.operators.incremental import CommittedLoad, load_watermarks, pending_comparisons, watermarks_in_sequence

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "delivery_id long, landed_at timestamp_ntz, observed_at timestamp_ntz, run_id string, comparison_index long, entity_a_hash string, entity_b_hash string, _file string, payload string"


def rows_of(n, seed, hot=0.3):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        k = 0 if rng.random() < hot else rng.randrange(1, n // 2)
        run = rng.choice([f"run-{k % 5}", f" RUN-{k % 5} "]) if k else "Run-0"
        a = None if k % 17 == 3 else rng.choice([f"h{k}", f"H{k}"])
        out.append((d + 1, T0 + dt.timedelta(minutes=d // 7), T0 + dt.timedelta(minutes=rng.randrange(20)), run, k % 3, a, "b", "x", "long " * rng.randrange(50) if k % 5 else None))
    return out


def identifier(r):
    clean = lambda x: None if x is None else x.strip().lower()
    return clean(r[3]), r[4], clean(r[5]), clean(r[6])


def current(rows):
    best = {}
    for r in rows:
        key = (r[2], -r[0])
        if identifier(r) not in best or key > best[identifier(r)][0]:
            best[identifier(r)] = (key, r)
    return {r[0] for _, r in best.values()}


@pytest.fixture
def landed(spark, tmp_path):
    rows = rows_of(400, 1)
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return rows, path


def test_one_row_of_each_identifier_stays(spark, landed):
    rows, path = landed
    kept = {r["delivery_id"] for r in deduplicate_files(spark, path).collect()}
    gone = {r["delivery_id"] for r in deduplicate_files(spark, path, columns=["delivery_id"], deleted=True).collect()}
    assert kept == current(rows)
    assert gone == {r[0] for r in rows} - kept


def test_payload_and_clashing_names_survive(spark, landed):
    rows, path = landed
    one = {r[0]: r for r in rows}
    for r in deduplicate_files(spark, path, columns=["delivery_id", "payload", "run_id"]).collect():
        assert (r["payload"], r["run_id"]) == (one[r["delivery_id"]][8], one[r["delivery_id"]][3])


def test_rows_equal_in_everything_leave_one(spark, tmp_path):
    path = str(tmp_path / "same.parquet")
    spark.createDataFrame([rows_of(10, 3)[0]] * 9, SCHEMA).repartition(3).write.parquet(path)
    assert deduplicate_files(spark, path).count() == 1


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert deduplicate_files(spark, path).count() == 0
    load = CommittedLoad(spark, str(tmp_path / "store"))
    assert load.run(spark.read.parquet(path), "landed_at", lambda s, u, w: s) is None


def test_watermarks_count_only_successes(spark):
    log = [(1, "R", "succeeded", T0), (1, "R", "running", T0 + dt.timedelta(1)), (2, " r ", "failed", T0 + dt.timedelta(2)), (3, "r", "succeeded", T0 - dt.timedelta(1)), (4, "q", "failed", T0), (5, None, "succeeded", T0)]
    got = load_watermarks(spark.createDataFrame(log, "attempt_id int, run_id string, status string, read_to timestamp_ntz")).collect()
    assert {(r["key"], r["watermark"]) for r in got} == {("r", T0), (None, T0)}


def test_pending_rows(spark, landed):
    rows, path = landed
    marks = {"run-1": T0 + dt.timedelta(minutes=30), "run-2": T0 + dt.timedelta(minutes=60)}
    log = spark.createDataFrame([(k, "succeeded", v) for k, v in marks.items()] + [("run-3", "failed", T0)], "run_id string, status string, read_to timestamp_ntz")
    got = {r["delivery_id"] for r in pending_comparisons(spark.read.parquet(path), log, T0 + dt.timedelta(days=9)).collect()}
    assert got == {r[0] for r in rows if r[0] in current(rows) and (identifier(r)[0] not in marks or r[1] > marks[identifier(r)[0]])}


def test_loads_neither_skip_nor_repeat_through_failures(spark, tmp_path):
    source, store = str(tmp_path / "s"), CommittedLoad(spark, str(tmp_path / "store"))
    seq = lambda low, high: spark.range(low, high).select(F.col("id").alias("n"))
    take = lambda s, upper, since: s.filter(F.col("n") <= upper) if since is None else s.filter((F.col("n") <= upper) & (F.col("n") > since))
    seq(0, 50).write.parquet(source)
    assert store.run(spark.read.parquet(source), "n", take).rows == 50
    seq(50, 80).write.mode("append").parquet(source)

    def die():
        raise OSError("lost")

    for _ in range(2):
        with pytest.raises(OSError):
            store.run(spark.read.parquet(source), "n", take, before_commit=die)
    assert store.read().count() == 50
    # rows that land while a load runs wait for the next one
    snapshot = spark.read.parquet(source)
    store.run(snapshot, "n", take, before_commit=lambda: seq(80, 90).write.mode("append").parquet(source))
    assert sorted(r["n"] for r in store.read().collect()) == list(range(80))
    store.run(spark.read.parquet(source), "n", take)
    assert sorted(r["n"] for r in store.read().collect()) == list(range(90))


def test_two_loads_cannot_take_one_number(spark, tmp_path):
    store = CommittedLoad(spark, str(tmp_path / "store"))
    rows = spark.range(3).select(F.col("id").alias("n"))
    with pytest.raises(RuntimeError):
        store.run(rows, "n", lambda s, u, w: s, before_commit=lambda: CommittedLoad(spark, store.store).run(rows, "n", lambda s, u, w: s))




@pytest.mark.parametrize("few", [100_000, 0])
def test_changes_by_a_unique_sequence(spark, tmp_path, monkeypatch, few):
    """Batches that share a landed_at, late batches of it, corrections, stale repeats and failures."""
    monkeypatch.setattr(incremental, "BROADCAST_ROWS", few)
    path, store = str(tmp_path / "c.parquet"), CommittedLoad(spark, str(tmp_path / "store"))
    row = lambda d, minute, seen, run, k: (d, T0 + dt.timedelta(minutes=minute), T0 + dt.timedelta(minutes=seen), run, k, "a", "b", "x", f"p{d}")
    land = lambda rows: spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)
    taken = lambda c: {r["delivery_id"] for r in spark.read.parquet(f"{store.store}/{c.data}").collect()}
    land([row(1, 0, 0, "r", 1), row(2, 5, 5, " R", 1), row(3, 5, 5, "q", 1), row(4, 9, 9, None, 1)])
    log = spark.createDataFrame([("r", "succeeded", T0 + dt.timedelta(minutes=4)), ("q", "succeeded", T0 + dt.timedelta(minutes=5)), ("q", "failed", T0 + dt.timedelta(days=1))], "run_id string, status string, read_to timestamp_ntz")
    store.adopt(watermarks_in_sequence(spark.read.parquet(path), load_watermarks(log), clean_key("run_id")))
    assert taken(store.run_changes(path)) == {2, 4}
    assert store.run_changes(path) is None
    # a batch with the landed_at of the last bound, a correction, a stale repeat and a repeat with an equal observed_at
    land([row(5, 9, 9, "q", 2), row(6, 9, 20, "r", 1), row(7, 9, 1, "q", 1), row(8, 9, 9, None, 1)])
    with pytest.raises(OSError):
        store.run_changes(path, before_commit=lambda: (_ for _ in ()).throw(OSError("lost")))
    assert taken(store.run_changes(path)) == {5, 6}
    got = store.read()
    assert {(r["delivery_id"], r["payload"], r["_file"]) for r in got.collect()} == {(d, f"p{d}", "x") for d in (2, 4, 5, 6)}
    marks = {r["key"]: r["watermark"] for r in spark.read.parquet(f"{store.store}/{store.commits()[-1].marks}").collect()}
    assert marks == {"r": 6, "q": 7, None: 8}
    with pytest.raises(RuntimeError):
        land([row(9, 9, 30, "r", 1)])
        store.run_changes(path, before_commit=lambda: CommittedLoad(spark, store.store).run_changes(path))
    assert sorted(r["delivery_id"] for r in store.read().collect()) == [2, 4, 5, 6, 9]
