"""Queries of judges, benchmark axes, chunking, evidence packs and streaming."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.operators import chunking as C
from pairloom.operators import evidence as E
from pairloom.operators import judges as J
from pairloom.operators import ranking as R
from pairloom.plans.evidence_queries import obs, r6
from pairloom.plans.ranking_queries import ENTITY_AXES, NODES, RANKED, RUN, entity_axes, nodes
from pairloom.plans.registry import CUR, OBS, query, table
from pairloom.session import materialise, scratch_dir
from pairloom.sources import files
from pairloom.streaming import fuse as S

#: Rank file that the chunks' tokens are counted by.
VOCABULARY = os.environ.get("PAIRLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Mean margin of each entity by axis and model.
LATENT = f"{OBS}, e as (select axis_key, model, i as entity_id, m / ln(2) as s from obs union all select axis_key, model, j, -m / ln(2) from obs), lat as (select axis_key, model, entity_id, avg(s) as s from e group by 1, 2, 3)"
_CORR = LATENT + ", jc as (select a.axis_key, a.model as judge_a, b.model as judge_b, count(*) as n, case when count(*) >= 3 and stddev_pop(a.s) > 1e-9 and stddev_pop(b.s) > 1e-9 then corr(a.s, b.s) end as r from lat a join lat b using (axis_key, entity_id) where a.model < b.model group by 1, 2, 3)"


def latents(spark, sf):
    return E.margins(obs(spark, sf), "axis_key", "model").withColumnRenamed("margin", "s")


@query("judge_corr", f"with {_CORR} select axis_key, judge_a, judge_b, n, round(r, 6) + 0.0 as r from jc")
def judge_corr(spark, sf):
    return J.judge_correlation(latents(spark, sf), ["axis_key"]).withColumn("r", r6("r"))


@query("judge_portfolio")
def judge_portfolio(spark, sf):
    """Loadings and weights of the models over all axes; the matrix is models x models."""
    pairs = J.judge_correlation(latents(spark, sf).withColumn("entity_id", F.concat_ws("|", "axis_key", "entity_id")), []).toPandas()
    names = sorted({*pairs["judge_a"], *pairs["judge_b"]})
    r = np.eye(len(names))
    for a, b, x in zip(pairs["judge_a"], pairs["judge_b"], pairs["r"]):
        i, j = names.index(a), names.index(b)
        r[i, j] = r[j, i] = 0.0 if x is None or np.isnan(x) else x
    return spark.createDataFrame(J.portfolio(names, r))


@query("canonize", f"with {_CORR} select axis_key, count(r) as judge_pairs, round(avg(r), 6) + 0.0 as transmissibility, round(max(abs(r)), 6) + 0.0 as redundancy from jc group by 1")
def canonize(spark, sf):
    x = J.canonize(J.judge_correlation(latents(spark, sf), ["axis_key"]), ["axis_key"])
    return x.select("axis_key", "judge_pairs", r6("transmissibility").alias("transmissibility"), r6("redundancy").alias("redundancy"))


@query("canonize_axes")
def canonize_axes(spark, sf):
    """Transmissibility by Spearman, signal, and redundancy against the axes accepted before."""
    x = J.canonicality(latents(spark, sf))
    return x.select("axis_key", "judge_pairs", *[r6(c).alias(c) for c in ("transmissibility", "signal", "redundancy")])


@query("explain_ranking")
def explain_ranking(spark, sf):
    """Non-negative weights of the axes that best give the runs' best scores back, by lens."""
    z = table(spark, sf, "scores").filter(F.col("z_score").isNotNull() & ~F.isnan("z_score")).groupBy("lens", "entity_id", "axis_key").agg(F.avg("z_score").alias("z"))
    total = z.groupBy("lens", "entity_id").agg(F.avg("z").alias("y"))
    x = z.join(total, ["lens", "entity_id"])
    # normal equations by aggregates; only axes x axes numbers leave the cluster
    a, b = x.select("lens", "entity_id", F.col("axis_key").alias("p"), F.col("z").alias("zp"), "y"), x.select("lens", "entity_id", F.col("axis_key").alias("q"), F.col("z").alias("zq"))
    gram = a.join(b, ["lens", "entity_id"]).groupBy("lens", "p", "q").agg(F.sum(F.col("zp") * F.col("zq")).alias("g"))
    rhs = a.groupBy("lens", "p").agg(F.sum(F.col("zp") * F.col("y")).alias("t"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        axes = sorted(pdf["p"].unique())
        g = pdf.pivot_table(index="p", columns="q", values="g", fill_value=0.0).reindex(index=axes, columns=axes, fill_value=0.0).to_numpy()
        t = pdf.drop_duplicates("p").set_index("p")["t"].reindex(axes).to_numpy()
        value, vector = np.linalg.eigh(g)
        root = np.sqrt(np.maximum(value, 1e-9))
        w = J.nonnegative_weights((vector * root).T, (vector / root).T @ t)
        return pd.DataFrame({"lens": pdf["lens"].iloc[0], "axis_key": axes, "weight": w})

    return gram.join(rhs, ["lens", "p"]).groupBy("lens").applyInPandas(fit, "lens string, axis_key string, weight double")


@query("differentiation_profile", f"with {ENTITY_AXES}, z as (select axis_key, entity_id, (s - avg(s) over w) / stddev_pop(s) over w as z from ea window w as (partition by axis_key)) select axis_key, entity_id, round(z, 4) + 0.0 as z from z")
def differentiation_profile(spark, sf):
    """Every entity's standing on each axis."""
    ea = entity_axes(spark, sf)
    stats = ea.groupBy("axis_key").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))
    return ea.join(F.broadcast(stats), "axis_key").select("axis_key", "entity_id", (F.round((F.col("s") - F.col("mean")) / F.col("sd"), 4) + F.lit(0.0)).alias("z"))


@query(
    "ahp_goal_scores",
    f"""with {RANKED}, imp as (select axis_key, power(2, coalesce(weight, 1)) / sum(power(2, coalesce(weight, 1))) over () as w from axes), z as (select entity_id, axis_key, avg(z_score) as z from scores where z_score is not null and not isnan(z_score) group by 1, 2)
    select entity_id, round(sum(w * (exp(z) - exp(-z)) / (exp(z) + exp(-z))), 6) + 0.0 as goal from z join imp using (axis_key) group by 1""",
)
def ahp_goal_scores(spark, sf):
    """Softmax importance of the axes times the squashed standing, summed for each entity."""
    imp = J.softmax2(table(spark, sf, "axes").select("axis_key", F.coalesce("weight", F.lit(1.0)).alias("i"), F.lit(0).alias("k")), ["k"], "i")
    z = table(spark, sf, "scores").filter(F.col("z_score").isNotNull() & ~F.isnan("z_score")).groupBy("entity_id", "axis_key").agg(F.avg("z_score").alias("z"))
    return z.join(imp.select("axis_key", "weight"), "axis_key").groupBy("entity_id").agg(r6(F.sum(F.col("weight") * F.tanh("z"))).alias("goal"))


@query("anp_limit")
def anp_limit(spark, sf):
    """Limit priorities of the axes, each fed by its correlation with the others."""
    ea = entity_axes(spark, sf)
    a, b = ea.select("entity_id", F.col("axis_key").alias("p"), F.col("s").alias("x")), ea.select("entity_id", F.col("axis_key").alias("q"), F.col("s").alias("y"))
    c = a.join(b, "entity_id").groupBy("p", "q").agg(F.corr("x", "y").alias("r")).toPandas()
    axes = sorted(c["p"].unique())
    m = np.exp(c.pivot(index="p", columns="q", values="r").reindex(index=axes, columns=axes).fillna(0.0).to_numpy())
    return spark.createDataFrame(pd.DataFrame({"axis_key": axes, "priority": J.network_limit(m)[:, 0]}))


@query("probit_fit")
def probit_fit(spark, sf):
    """Scores of each run from the readings' cells alone."""
    cuts = np.array([-2.0, -1.0, -0.3, 0.3, 1.0, 2.0])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf[["i", "j"]].to_numpy(dtype=object).astype(str))
        i, j = np.searchsorted(names, pdf["i"].to_numpy(str)), np.searchsorted(names, pdf["j"].to_numpy(str))
        s = J.probit_scores(len(names), i, j, np.searchsorted(cuts, pdf["m"].to_numpy(float)), cuts)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "axis_key": pdf["axis_key"].iloc[0], "entity_id": names, "score": s})

    return obs(spark, sf).select(*RUN, "i", "j", "m").groupBy(*RUN).applyInPandas(fit, "run string, axis_key string, entity_id string, score double")


_BENCH = f"""{OBS}, p as (select model, axis_key, i, j, avg(case when a < b then m end) as f, avg(case when a > b then m end) as r, avg(m) as mean, count(*) as k, var_pop(m) as v from obs group by 1, 2, 3, 4),
    b as (select model, avg(abs(mean)) as signal, avg(case when f is not null and r is not null and f <> 0 and r <> 0 then (sign(f) <> sign(r))::int end) as flip, avg(abs(f - r) / 2) as residual, avg((f - r) / 2) as position, avg(case when k >= 2 then sqrt(v) end) as noise from p group by 1)"""


@query(
    "bench_axes",
    f"""with {_BENCH}, s as (select model, 1 - exp(-signal) as signal, 1 - flip as flip, exp(-residual) as residual, exp(-abs(position)) as position, exp(-noise) as steadiness from b),
    t as (select *, (coalesce((flip + residual) / 2, 0) + coalesce(position, 0) + coalesce(steadiness, 0)) / nullif((flip is not null and residual is not null)::int + (position is not null)::int + (steadiness is not null)::int, 0) as coherence from s)
    select model, round(signal, 6) as signal, round(flip, 6) as flip, round(residual, 6) as residual, round(position, 6) as position, round(steadiness, 6) as steadiness, round(coherence, 6) as coherence, round(signal * coherence, 6) as judge from t""",
)
def bench_axes(spark, sf):
    """Sub-scores of each judge from its readings in both orders, and their composite."""
    order = F.col("a") < F.col("b")
    p = obs(spark, sf).groupBy("model", "axis_key", "i", "j").agg(F.avg(F.when(order, F.col("m"))).alias("f"), F.avg(F.when(~order, F.col("m"))).alias("r"), F.avg("m").alias("mean"), F.count(F.lit(1)).alias("k"), F.var_pop("m").alias("v"))
    both = (F.col("f") != 0) & (F.col("r") != 0)
    half = (F.col("f") - F.col("r")) / 2
    b = p.groupBy("model").agg(F.avg(F.abs("mean")).alias("signal"), F.avg(F.when(both, (F.signum("f") != F.signum("r")).cast("int"))).alias("flip"), F.avg(F.abs(half)).alias("residual"), F.avg(half).alias("position"), F.avg(F.when(F.col("k") >= 2, F.sqrt("v"))).alias("noise"))
    s = b.select("model", (1 - F.exp(-F.col("signal"))).alias("signal"), (1 - F.col("flip")).alias("flip"), F.exp(-F.col("residual")).alias("residual"), F.exp(-F.abs("position")).alias("position"), F.exp(-F.col("noise")).alias("steadiness"))
    parts = F.array_compact(F.array((F.col("flip") + F.col("residual")) / 2, "position", "steadiness"))
    s = s.withColumn("coherence", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)))
    return s.select("model", *[F.round(c, 6).alias(c) for c in ("signal", "flip", "residual", "position", "steadiness", "coherence")], F.round(F.col("signal") * F.col("coherence"), 6).alias("judge"))


@query("magnitude_slope", f"with {OBS}, {NODES}, t as (select axis_key, entity_id, avg(s) as s from nodes group by 1, 2) select obs.axis_key, round(sum(m * (a.s - b.s)) / sum((a.s - b.s) * (a.s - b.s)), 6) + 0.0 as slope from obs join t a on a.axis_key = obs.axis_key and a.entity_id = obs.i join t b on b.axis_key = obs.axis_key and b.entity_id = obs.j group by 1")
def magnitude_slope(spark, sf):
    """Slope through the origin of the readings over the landed scores' differences."""
    ea = entity_axes(spark, sf)
    side = lambda x: ea.select("axis_key", F.col("entity_id").alias(x), F.col("s").alias(f"s_{x}"))
    d = obs(spark, sf).join(side("i"), ["axis_key", "i"]).join(side("j"), ["axis_key", "j"]).withColumn("d", F.col("s_i") - F.col("s_j"))
    return d.groupBy("axis_key").agg(r6(F.sum(F.col("m") * F.col("d")) / F.sum(F.col("d") * F.col("d"))).alias("slope"))


@query("chunk_paragraphs", r"select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''))::int as paragraphs from documents where text is not null union all select doc_id, 0 from documents where text is null")
def chunk_paragraphs(spark, sf):
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(C.paragraphs(F.coalesce("text", F.lit("")))))
    return table(spark, sf, "documents").select("doc_id", count.alias("paragraphs"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    """Chunks of 60 tokens by a public vocabulary, or of 60 words where it isn't installed."""
    return C.chunk(table(spark, sf, "documents"), C.ChunkSize.of(60, overlap_ratio=0.2), vocabulary=VOCABULARY if os.path.exists(VOCABULARY) else None)


@query(
    "topk_jaccard_runs",
    f"""with {RANKED}, t as (select * from ranked where rank <= 10), p as (select a.axis_key, a.run as run_a, b.run as run_b, count(*) as shared from t a join t b on a.axis_key = b.axis_key and a.entity_id = b.entity_id and a.run < b.run group by 1, 2, 3),
    n as (select run, axis_key, count(*) as n from t group by 1, 2) select p.axis_key, run_a, run_b, round(shared / (x.n + y.n - shared)::double, 6) as jaccard from p join n x on x.run = run_a and x.axis_key = p.axis_key join n y on y.run = run_b and y.axis_key = p.axis_key""",
)
def topk_jaccard_runs(spark, sf):
    t = R.ranked(nodes(spark, sf), RUN).filter("rank <= 10").select(*RUN, "entity_id")
    n = t.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: t.select("axis_key", "entity_id", F.col("run").alias(f"run_{x}"))
    p = side("a").join(side("b"), ["axis_key", "entity_id"]).filter("run_a < run_b").groupBy("axis_key", "run_a", "run_b").agg(F.count(F.lit(1)).alias("both"))
    size = lambda x: n.select("axis_key", F.col("run").alias(f"run_{x}"), F.col("n").alias(f"n_{x}"))
    p = p.join(size("a"), ["axis_key", "run_a"]).join(size("b"), ["axis_key", "run_b"])
    return p.select("axis_key", "run_a", "run_b", F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("jaccard"))


@query(
    "budget_normalised",
    f"""with {CUR} select model, count_if(higher_ranked in ('A', 'B') and error = '') as decided, round(count_if(higher_ranked in ('A', 'B') and error = '') / count(*)::double, 6) as each_call,
        round(count_if(higher_ranked in ('A', 'B') and error = '') / nullif(sum(coalesce(cost_nanodollars, 0)) / 1e9, 0), 2) as each_dollar from cur group by 1""",
)
def budget_normalised(spark, sf):
    c = E.current(table(spark, sf, "comparisons"), "model", "higher_ranked", "error", "cost_nanodollars")
    ok = F.count_if(F.col("higher_ranked").isin("A", "B") & (F.col("error") == ""))
    return c.groupBy("model").agg(ok.alias("decided"), F.round(ok / F.count(F.lit(1)), 6).alias("each_call"), F.round(F.try_divide(ok, F.sum(F.coalesce("cost_nanodollars", F.lit(0))) / 1e9), 2).alias("each_dollar"))


@query("stream_fuse", f"with {OBS}, u as (select axis_key, i, j, case when (higher_ranked = 'A') = (a < b) then 1 else -1 end * ln(ratio) as m from obs) select axis_key, i, j, round(avg(m), 6) + 0.0 as mu, count(*)::double as lam from u group by 1, 2, 3")
def stream_fuse(spark, sf):
    """Traces dropped in two files and fused by a stream."""
    o = obs(spark, sf, "comparison_index")
    t = materialise(o.select(F.col("run").alias("run_id"), "axis_key", "comparison_index", F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"), "higher_ranked", "ratio"), "stream-source")
    traces, state, at = (scratch_dir(spark, x) for x in ("stream-in", "stream-state", "stream-checkpoint"))
    for half in (0, 1):
        files.append_traces(t.filter(F.pmod("comparison_index", F.lit(2)) == half), traces)
        S.start_fusing(spark, traces, state, at).awaitTermination()
    return S.fused_state(spark, state).select("axis_key", "i", "j", r6("mu").alias("mu"), "lam")
