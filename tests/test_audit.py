"""Audits, token answers, resampling and the adaptive loop on small planted tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom import cli
from pairloom.operators import answers, audit, designs, judges, resample, synthetic
from pairloom.plans import adaptive
from pairloom.plans import solver as S
from pairloom.sources import files, records


def test_weighted_median_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), round(rng.random(), 2), rng.random()) for _ in range(300)]
    got = {r["g"]: r["median"] for r in audit.weighted_median(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], "v", "w").collect()}
    for g in "ab":
        own = sorted((v, round(w * audit.UNIT)) for k, v, w in rows if k == g)
        total, run = sum(w for _, w in own), 0
        for v, w in own:
            run += w
            if run * 2 >= total:
                break
        assert got[g] == v


def test_tokens_are_read(spark):
    rows = [(1, " a"), (2, "**B**"), (3, "A."), (4, "both"), (5, "?"), (6, None), (7, "a7")]
    df = spark.createDataFrame(rows, "n int, token string")
    assert {r["n"]: r["s"] for r in df.select("n", answers.side_of(F.col("token")).alias("s")).collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: None, 7: "A"}
    assert {r["n"]: r["s"] for r in df.select("n", answers.clean_token(F.col("token")).alias("s")).collect()} == {1: "A", 2: "B", 3: "A", 4: "BOTH", 5: None, 6: None, 7: "A7"}
    pairs = spark.createDataFrame([("1", "7", 17), (None, "7", 7), ("1", "9", 19), ("2", "9", 9), ("1", "", None), (None, "99", None)], "b string, t string, want int")
    assert all(r["got"] == r["want"] for r in pairs.select("want", answers.bucket_of(F.col("t"), F.col("b")).alias("got")).collect())
    rungs = spark.range(1, 26).select(F.col("id").cast("int").alias("n"))
    assert all(r["n"] == r["m"] for r in rungs.select("n", answers.rung_of(answers.letter_of(F.col("n"))).alias("m")).collect())


def test_evidence_keeps_what_is_not_seen(spark):
    rows = [("x", math.log(0.6), 2), ("x", math.log(0.1), 0), ("x", math.log(0.2), None), ("y", math.log(1.00005), 1), ("z", math.log(1.1), 1), ("w", None, 1)]
    got = {r["k"]: r for r in answers.evidence(spark.createDataFrame(rows, "k string, logprob double, a int"), ["k"], F.col("a")).collect()}
    x = got["x"]
    assert (x["shown"], x["off_alphabet"], x["abstain"]) == (pytest.approx(0.7), pytest.approx(0.2), pytest.approx(0.1))
    assert x["mean"] == pytest.approx(0.6 * math.log(1.17) / 0.7)
    assert got["y"]["abstain"] == 0 and got["z"]["shown"] is None and got["w"]["mean"] is None and got["w"]["abstain"] == 1


def test_bootstrap_covers_and_weights_are_poisson(spark):
    w = spark.range(20000).select(resample.poisson_weight(F.col("id")).alias("w"))
    got = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert got["m"] == pytest.approx(1, abs=0.03) and got["v"] == pytest.approx(1, abs=0.05)
    rows = spark.range(200).select(F.lit("g").alias("g"), "id", (F.col("id") % 10).cast("double").alias("s"), F.lit(1.0).alias("n"))
    b = resample.bootstrap_means(rows, ["g"], "id", "s", "n").first()
    assert b["low"] < 4.5 < b["high"] and b["high"] - b["low"] == pytest.approx(2 * 1.96 * math.sqrt(8.25 / 200), rel=0.25)
    assert resample.bootstrap_means(rows.limit(0), ["g"], "id", "s", "n").count() == 0


def test_pair_variances_across_components(spark):
    edges = spark.createDataFrame([("g", "a", "b", 1.0, 2.0), ("g", "b", "c", 1.0, 1.0), ("g", "x", "y", 0.0, 1.0)], "g string, i string, j string, mu double, lam double")
    pairs = spark.createDataFrame([("g", "a", "c"), ("g", "a", "a"), ("g", "a", "x"), ("g", "a", "?"), ("h", "a", "b")], "g string, i string, j string")
    got = {(r["g"], r["i"], r["j"]): r for r in S.pair_variances(edges, pairs, ["g"]).collect()}
    assert got["g", "a", "c"]["variance"] == pytest.approx(1.5, abs=1e-6) and got["g", "a", "a"]["variance"] == pytest.approx(0, abs=1e-9)
    assert not got["g", "a", "x"]["same_component"] and got["g", "a", "x"]["variance"] > 0
    assert got["g", "a", "?"]["variance"] is None and not got["h", "a", "b"]["same_component"]


def test_portfolio_of_planted_judges():
    import numpy as np

    load = np.array([0.9, 0.8, 0.7, 0.1])
    r = np.outer(load, load)
    np.fill_diagonal(r, 1)
    p = judges.portfolio(list("abcd"), r)
    assert np.allclose(p["loading"], load, atol=1e-6) and p["weight"].is_monotonic_decreasing and p["weight"].sum() == pytest.approx(1)
    # what a judge adds is what the others lack without them
    error = np.diag(1 - load**2) + judges.RIDGE * np.eye(4)
    for i in range(4):
        rest = [k for k in range(4) if k != i]
        lost = load @ np.linalg.solve(error, load) - load[rest] @ np.linalg.solve(error[np.ix_(rest, rest)], load[rest])
        assert p["marginal_information"][i] == pytest.approx(lost, rel=1e-6)


def test_synthetic_judge(spark):
    p = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("i"), F.lit("z").alias("j"), F.lit(0.5).alias("d"))
    plain = synthetic.readings(p, ["g"], 0.3).agg(F.avg("m").alias("m"), F.stddev("m").alias("s"), F.count_if("refused").alias("r")).first()
    assert plain["m"] == pytest.approx(0.5, abs=0.02) and plain["s"] == pytest.approx(0.3, abs=0.02) and plain["r"] == 0
    wild = synthetic.readings(p, ["g"], 0.0, outliers=0.25, refusals=0.1, ordinal=True).agg(F.count_if(F.col("m") < 0).alias("n"), F.count_if("refused").alias("r"), F.count_if(F.col("m").isin(-1.0, 0.0, 1.0)).alias("o")).first()
    assert wild["n"] == pytest.approx(500, abs=90) and wild["r"] == pytest.approx(400, abs=70) and wild["o"] == 4000


def test_pooled_scores_weigh_repeats_by_both_variances():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    truth = {"a": 0.0, "b": 1.0, "c": 2.5}
    rows = []
    for i, j in (("a", "b"), ("b", "c"), ("a", "c")):
        draws = truth[i] - truth[j] + 0.2 * rng.normal() + 0.1 * rng.normal(size=400)
        rows.append((i, j, len(draws), draws.mean(), ((draws - draws.mean()) ** 2).sum()))
    pairs = pd.DataFrame(rows, columns=["i", "j", "k", "mean", "ss"])
    found, got = S.dersimonian_laird(pairs), S.pooled_scores(pairs).set_index("entity_id")
    assert found["sigma_w2"] == pytest.approx(0.01, rel=0.15) and got["score"].sort_values().index.tolist() == ["a", "b", "c"]
    assert got["variance"].max() >= found["sigma_b2"] / 3
    once = pd.DataFrame([("a", "b", 1, -1.0, 0.0)], columns=["i", "j", "k", "mean", "ss"])
    assert S.pooled_scores(once).set_index("entity_id")["score"]["b"] == pytest.approx(1.0, abs=1e-6)


def test_streaks_start_anew(spark):
    rows = [("g", k, ok) for k, ok in enumerate([True, True, False, True, True, True])]
    got = audit.stop_streaks(spark.createDataFrame(rows, "g string, n int, ok boolean"), ["g"], "n", "ok", 3).orderBy("n").collect()
    assert [r["streak"] for r in got] == [1, 2, 0, 1, 2, 3] and [r["stop"] for r in got] == [False] * 5 + [True]


def test_adaptive_loop_finds_the_top_and_says_why_it_stopped(spark):
    entities = spark.createDataFrame([(g, f"e{k:02d}") for g in ("clear", "poor", "shy") for k in range(12)], "g string, entity_id string")

    def judge(pairs, turn):
        place = lambda c: F.substring(c, 2, 2).cast("double")
        d = pairs.withColumn("d", (place("j") - place("i")) * 0.25)
        return synthetic.readings(d, ["g"], 0.05, seed=turn).withColumn("refused", F.col("g") == "shy").withColumn("m", F.when(F.col("g") == "poor", 0.0).otherwise(F.col("m"))).withColumn("lam", F.lit(400.0))

    nodes, stops = adaptive.rank_adaptively(entities, judge, ["g"], 3, batch=12, budget=80, rounds=7)
    why = {r["g"]: r for r in stops.collect()}
    assert why["clear"]["reason"] == adaptive.CERTIFIED and why["shy"]["reason"] == adaptive.REFUSED
    assert why["poor"]["reason"] in (adaptive.BUDGET, adaptive.ROUNDS_OUT, adaptive.EXHAUSTED) and all(r["comparisons"] <= 80 for r in why.values())
    top = sorted(((r["s"], r["entity_id"]) for r in nodes.filter("g = 'clear'").collect()), reverse=True)[:3]
    assert {e for _, e in top} == {"e00", "e01", "e02"}
    assert adaptive.rank_adaptively(entities.limit(0), judge, ["g"], 3)[1].count() == 0


def test_records_say_what_is_wrong_with_them(spark, tmp_path):
    runs = ['{"run_ref": "a", "status": "finished", "finished_at": "x", "comparisons": 5, "refused": 1, "entities": ["e", "f"]}', '{"run_ref": "b", "status": "done", "comparisons": 1, "refused": 2}', '{"run_ref": "c", "status": "running"}', '{"run_ref": "c", "status": "finished", "entities": ["e", "e"]}', "{broken", '{"status": "failed", "cost_nanodollars": -1}']
    (tmp_path / "runs.json").write_text("\n".join(runs))
    got = sorted((r["run_ref"] or "", tuple(r["problems"])) for r in records.read_runs(spark, str(tmp_path / "runs.json")).collect())
    assert ("a", ()) in got and ("b", ("unknown status", "counts don't add up")) in got and ("c", ("run_ref used twice",)) in got
    assert ("c", ("run_ref used twice", "finished without an end", "entity listed twice")) in got and ("", ("no run_ref", "negative cost")) in got
    assert any("not JSON" in p for _, p in got)
    (tmp_path / "pool.json").write_text('{"pool_id": "p", "items": [{"id": "a", "text": "x", "truth": 1.5}, {"id": "a", "text": " "}, {"text": "y"}]}')
    pool = {r["place"]: r for r in records.read_pool(spark, str(tmp_path / "pool.json")).collect()}
    assert pool[0]["truth"] == 1.5 and pool[0]["problems"] == ["id used twice"] and pool[1]["problems"] == ["no text", "id used twice"] and pool[2]["problems"] == ["no id"]


def test_landing_and_the_command_line(spark, tmp_path):
    rows, store = str(tmp_path / "rows"), str(tmp_path / "store")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_id string, n int").write.parquet(rows)
    assert cli.main(["land", rows, store], spark) == 3 and cli.main(["land", rows, store], spark) == 0
    spark.createDataFrame([("c", 4)], "run_id string, n int").write.mode("append").parquet(rows)
    assert cli.main(["land", rows, store], spark) == 1
    assert sorted(r["n"] for r in spark.read.parquet(*[f"{store}/{c.data}" for c in records.CommittedLoad(spark, store).commits()]).collect()) == [1, 2, 3, 4]
    spark.createDataFrame([(f"k{k}", k // 2) for k in range(10)], "key_hash string, updated_at int").write.parquet(str(tmp_path / "cache"))
    assert cli.main(["cache-prune", str(tmp_path / "cache"), str(tmp_path / "small"), "--keep", "3"], spark) == 3
    assert {r["key_hash"] for r in spark.read.parquet(str(tmp_path / "small")).collect()} == {"k8", "k9", "k6"}
    assert cli.main(["cache-export", str(tmp_path / "small"), str(tmp_path / "out")], spark) == 3


def test_items_are_numbered_without_gaps(spark, tmp_path):
    folder = tmp_path / "items"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("".join(f"line {k} {n}\n\n" for n in range(4)))
    got = files.read_items(spark, str(folder)).collect()
    assert sorted(r["entity_id"] for r in got) == [f"item-{n:04d}" for n in range(12)]
    assert [r["text"] for r in sorted(got, key=lambda r: r["entity_id"])][:4] in [[f"line {k} {n}" for n in range(4)] for k in range(3)]


def test_designs(spark):
    got = {(r["n"], r["mask"]): r for r in designs.atlas(designs.stride_sets(spark, (8,))).collect()}
    ring, whole = got[8, 1], got[8, 15]
    assert (ring["edges"], ring["triangles"], ring["cycle_dim"], ring["harmonic_dim"]) == (8, 0, 1, 1)
    assert (whole["edges"], whole["triangles"], whole["harmonic_dim"]) == (28, 56, 0) and whole["fiedler"] == pytest.approx(8)
    assert got[8, 8]["components"] == 4
