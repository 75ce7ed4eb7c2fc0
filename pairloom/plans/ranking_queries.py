"""Queries of ranks, units, utilities and bands over the landed scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators import ranking as R
from pairloom.operators.ordered import medians
from pairloom.plans.registry import query, table
from pairloom.session import materialise

r6 = lambda c: F.round(c, 6) + F.lit(0.0)
RUN = ["run", "axis_key"]
K = 5

#: Latest usable score of each run, axis and entity.
NODES = """nodes as (
    select lower(trim(run_id)) as run, axis_key, entity_id, latent_mean as s, coalesce(latent_std, 0) * coalesce(latent_std, 0) as v from scores
    where latent_mean is not null and not isnan(latent_mean)
    qualify row_number() over (partition by lower(trim(run_id)), axis_key, entity_id order by scored_at desc, latent_mean desc, coalesce(latent_std, 0) desc) = 1)"""
RANKED = NODES + ", ranked as (select *, row_number() over (partition by run, axis_key order by s desc, entity_id) as rank from nodes)"
#: Mean over the runs of each entity on each axis.
ENTITY_AXES = NODES + ", ea as (select axis_key, entity_id, avg(s) as s, avg(v) as v from nodes group by 1, 2)"


def phi(x: str) -> str:
    """Phi(x) in DuckDB by the series of erf."""
    z = f"(({x}) / {math.sqrt(2.0)!r}::double)"
    term = f"exp((2 * n + 1) * ln(abs({z})) + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))"
    return f"(0.5 * (1 + case when {z} = 0 then 0 when abs({z}) >= 6 then sign({z}) else sign({z}) * 2 / sqrt(pi()) * exp(-{z} * {z}) * list_sum(list_transform(range(0, 121), lambda n: {term})) end))"


def flip(delta: str, variance: str) -> str:
    return f"(case when {delta} = 0 then 0.5 when {variance} <= 1e-18 then 0 else {phi(f'-abs({delta}) / sqrt({variance})')} end)"


def nodes(spark, sf):
    rows = table(spark, sf, "scores").filter(F.col("latent_mean").isNotNull() & ~F.isnan("latent_mean"))
    best = F.max(F.struct("scored_at", F.col("latent_mean").alias("s"), F.coalesce("latent_std", F.lit(0.0)).alias("sd")))
    x = rows.groupBy(clean_key("run_id").alias("run"), "axis_key", "entity_id").agg(best.alias("x"))
    return x.select(*RUN, "entity_id", F.col("x.s").alias("s"), (F.col("x.sd") * F.col("x.sd")).alias("v"))


def entity_axes(spark, sf):
    return nodes(spark, sf).groupBy("axis_key", "entity_id").agg(F.avg("s").alias("s"), F.avg("v").alias("v"))


@query("rank_order", f"with {RANKED} select run, axis_key, entity_id, rank, round(1 / rank::double, 6) as rank_weight from ranked")
def rank_order(spark, sf):
    return R.ranked(nodes(spark, sf), RUN).select(*RUN, "entity_id", F.col("rank").cast("long").alias("rank"), r6("rank_weight").alias("rank_weight"))


_PAIRS = f"""{RANKED}, pairs as (select a.run, a.axis_key, a.entity_id as hi, b.entity_id as lo, a.s as s_hi, b.s as s_lo, a.v + b.v as v, a.rank as r_hi, b.rank as r_lo
    from ranked a join ranked b on a.run = b.run and a.axis_key = b.axis_key and a.rank < b.rank and (b.rank - a.rank <= 5 or a.s - b.s <= 0.5))"""


@query("rank_pairs", f"with {_PAIRS} select run, axis_key, hi, lo from pairs")
def rank_pairs(spark, sf):
    return R.rank_pairs(nodes(spark, sf), RUN).select(*RUN, "hi", "lo")


@query(
    "rank_stability",
    f"""with {_PAIRS}, f as (select *, {flip('(s_hi - s_lo)', 'v')} as flip,
        (1.0::double / r_hi + 1.0::double / r_lo) / 2 * case when r_hi > {K} and r_lo > {K} then 0.25 else 1 end as w from pairs)
    select run, axis_key, count(*) as pairs, round(sum(flip), 6) + 0.0 as expected_reversals, round(max(flip), 6) + 0.0 as max_reversal, round(sum(flip * w), 6) + 0.0 as rank_risk from f group by 1, 2""",
)
def rank_stability(spark, sf):
    x = R.rank_stability(nodes(spark, sf), RUN, K)
    return x.select(*RUN, "pairs", *[r6(c).alias(c) for c in ("expected_reversals", "max_reversal", "rank_risk")])


_UNITS = f"""{NODES}, m as (select run, axis_key, median(s) as med from nodes group by 1, 2),
    d as (select run, axis_key, median(abs(s - med)) as mad, stddev_pop(s) as sd, min(s) as low from nodes join m using (run, axis_key) group by 1, 2),
    units as (select n.*, case when mad < 1e-6 then greatest(sd, 1e-6) / 1.4826 else mad end as scale, med, low,
        (row_number() over (partition by run, axis_key order by s, entity_id) - 0.5) / count(*) over (partition by run, axis_key) as percentile
        from nodes n join m using (run, axis_key) join d using (run, axis_key)),
    unit as (select run, axis_key, entity_id, s, v, scale, (s - med) / (scale * 1.4826) as z, s - low + 1 as min_norm, percentile from units)"""


@query("attribute_units", f"with {_UNITS} select run, axis_key, entity_id, round(scale, 6) + 0.0 as scale, round(z, 4) + 0.0 as z, round(min_norm, 6) as min_norm, round(percentile, 6) as percentile from unit")
def attribute_units(spark, sf):
    u = R.attribute_units(nodes(spark, sf), RUN)
    return u.select(*RUN, "entity_id", r6("scale").alias("scale"), (F.round("z", 4) + F.lit(0.0)).alias("z"), r6("min_norm").alias("min_norm"), r6("percentile").alias("percentile"))


_GATES = [("z", ">=", -0.5), ("percentile", "<=", 0.95), ("min_norm", ">=", 1.05)]


@query("gates_feasible", f"with {_UNITS} select run, axis_key, entity_id, (z >= -0.5 and percentile <= 0.95 and min_norm >= 1.05) as feasible from unit")
def gates_feasible(spark, sf):
    """Gates joined to the units, all of which an entity must pass."""
    gates = spark.createDataFrame(_GATES, "unit string, op string, threshold double")
    passes = R.attribute_units(nodes(spark, sf), RUN).crossJoin(F.broadcast(gates)).withColumn("ok", R.gate(F.col("unit"), F.col("op"), F.col("threshold")))
    return passes.groupBy(*RUN, "entity_id").agg(F.bool_and("ok").alias("feasible"))


_SCALES = f"""{ENTITY_AXES}, am as (select axis_key, median(s) as med from ea group by 1),
    ad as (select axis_key, median(abs(s - med)) as mad, stddev_pop(s) as sd from ea join am using (axis_key) group by 1),
    sc as (select axis_key, case when mad < 1e-6 then greatest(sd, 1e-6) / 1.4826 else mad end as scale, coalesce(weight, 1) as w from ad join axes using (axis_key))"""


def axis_scales(spark, sf, ea):
    """(axis_key, scale, w): MAD of each axis by distributed sorts."""
    med = medians(ea, ["axis_key"], "s")
    dev = ea.join(F.broadcast(med), "axis_key").withColumn("d", F.abs(F.col("s") - F.col("median")))
    mad = medians(dev, ["axis_key"], "d").withColumnRenamed("median", "mad")
    sd = ea.groupBy("axis_key").agg(F.stddev_pop("s").alias("sd"))
    x = mad.join(sd, "axis_key").join(table(spark, sf, "axes").select("axis_key", F.coalesce("weight", F.lit(1.0)).alias("w")), "axis_key")
    return x.select("axis_key", F.when(F.col("mad") < 1e-6, F.greatest("sd", F.lit(1e-6)) / 1.4826).otherwise(F.col("mad")).alias("scale"), "w")


@query(
    "utility",
    f"""with {_SCALES}, t as (select entity_id, w * s / scale as u, w * w * v / (scale * scale) as x from ea join sc using (axis_key)),
    l as (select entity_id, sum(u) as u, list_sort(list(x)) as x, count(*) as n from t group by 1),
    q as (select *, x[n // 4 + 1] as q1, x[least(n * 3 // 4, n - 1) + 1] as q3, case when n % 2 = 1 then x[n // 2 + 1] else (x[greatest(n // 2, 1)] + x[n // 2 + 1]) / 2 end as med from l),
    f as (select *, greatest(q3 + 3 * (q3 - q1), 10 * med, 1e-12) as fence from q)
    select entity_id, n as axes, round(u, 4) + 0.0 as utility,
           round(case when n <= 2 then list_sum(x) else list_sum(list_transform(x, lambda y: least(y, fence))) end, 4) + 0.0 as variance from f""",
)
def utility(spark, sf):
    """Weighted sum over axes in robust units, with the capped sum of variances."""
    ea = entity_axes(spark, sf)
    x = ea.join(F.broadcast(axis_scales(spark, sf, ea)), "axis_key")
    x = x.select("entity_id", (F.col("w") * F.col("s") / F.col("scale")).alias("u"), (F.col("w") * F.col("w") * F.col("v") / (F.col("scale") * F.col("scale"))).alias("x"))
    g = x.groupBy("entity_id").agg(F.count(F.lit(1)).alias("axes"), F.sum("u").alias("u"), F.collect_list("x").alias("x"))
    return g.select("entity_id", "axes", (F.round("u", 4) + F.lit(0.0)).alias("utility"), (F.round(R.robust_capped_sum(F.col("x")), 4) + F.lit(0.0)).alias("variance"))


_BAND = f"""{RANKED}, b as (select *, s - 1.96 * sqrt(v) as lcb, s + 1.96 * sqrt(v) as ucb, count(*) over g as n from ranked window g as (partition by run, axis_key)),
    o as (select *, row_number() over (partition by run, axis_key order by lcb desc, entity_id) as l, row_number() over (partition by run, axis_key order by ucb desc, entity_id) as u from b),
    t as (select *, max(lcb) filter (where l = {K}) over g as tl, max(ucb) filter (where u = {K + 1}) over g as tu, max(s) filter (where rank = {K}) over g as sk, max(v) filter (where rank = {K}) over g as vk
          from o window g as (partition by run, axis_key))"""


@query(
    "uncertainty_band",
    f"""with {_BAND} select run, axis_key, entity_id, coalesce(n > {K} and ucb >= tl and lcb <= tu, false) as in_band,
        round(case when n <= {K} then 0 else {flip('(s - sk)', '((sqrt(v) + sqrt(vk)) * (sqrt(v) + sqrt(vk)))')} end, 6) + 0.0 as p_flip from t""",
)
def uncertainty_band(spark, sf):
    return R.uncertainty_band(nodes(spark, sf), RUN, K).select(*RUN, "entity_id", "in_band", r6("p_flip").alias("p_flip"))


@query(
    "critical_pair",
    f"""with {_BAND} select run, axis_key, arg_min(entity_id, (lcb, entity_id)) filter (where rank <= {K}) as weakest, arg_max(entity_id, (ucb, entity_id)) filter (where rank > {K}) as challenger,
        round(min(lcb) filter (where rank <= {K}) - max(ucb) filter (where rank > {K}), 6) + 0.0 as separation from t group by 1, 2""",
)
def critical_pair(spark, sf):
    return R.critical_pair(nodes(spark, sf), RUN, K).withColumn("separation", r6("separation"))


@query(
    "topk_error",
    f"""with {RANKED} select a.run, a.axis_key, round(sum({flip('(a.s - b.s)', '(a.v + b.v)')}), 6) + 0.0 as topk_error
    from ranked a join ranked b on a.run = b.run and a.axis_key = b.axis_key and a.rank <= {K} and b.rank > {K} group by 1, 2""",
)
def topk_error(spark, sf):
    return R.topk_error(nodes(spark, sf), RUN, K).withColumn("topk_error", r6("topk_error"))


@query(
    "certified_stop",
    f"""with {_BAND} select run, axis_key, coalesce(min(lcb) filter (where rank <= {K}) > max(ucb) filter (where rank > {K}), false) as certified, count(*) > {K} as open from t group by 1, 2""",
)
def certified_stop(spark, sf):
    """Whether the bounds already separate the top k from the rest."""
    x = R.critical_pair(nodes(spark, sf), RUN, K)
    n = nodes(spark, sf).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    return x.join(n, RUN).select(*RUN, F.coalesce(F.col("separation") > 0, F.lit(False)).alias("certified"), (F.col("n") > K).alias("open"))


@query(
    "pareto_front",
    f"""with {NODES}, p as (select run, axis_key, entity_id, s, -v as sure from nodes)
    select run, axis_key, entity_id from p where not exists (select 1 from p q where q.run = p.run and q.axis_key = p.axis_key and q.s >= p.s and q.sure >= p.sure and (q.s > p.s or q.sure > p.sure))""",
)
def pareto_front(spark, sf):
    """Entities of a run that no other beats in score and certainty at once."""
    p = nodes(spark, sf).select(*RUN, "entity_id", "s", (-F.col("v")).alias("sure"))
    return R.pareto_front(p, RUN, ["s", "sure"]).select(*RUN, "entity_id")


@query(
    "axis_correlation",
    f"""with {ENTITY_AXES} select a.axis_key as axis_a, b.axis_key as axis_b, count(*) as n, round(case when count(*) >= 3 and stddev_pop(a.s) > 1e-12 and stddev_pop(b.s) > 1e-12 then corr(a.s, b.s) end, 6) + 0.0 as r
    from ea a join ea b on a.entity_id = b.entity_id and a.axis_key < b.axis_key group by 1, 2""",
)
def axis_correlation(spark, sf):
    """Pearson correlation of every two axes over the entities that both score."""
    ea = entity_axes(spark, sf)
    a, b = ea.select("entity_id", F.col("axis_key").alias("axis_a"), F.col("s").alias("x")), ea.select("entity_id", F.col("axis_key").alias("axis_b"), F.col("s").alias("y"))
    n = F.count(F.lit(1))
    ok = (n >= 3) & (F.stddev_pop("x") > 1e-12) & (F.stddev_pop("y") > 1e-12)
    return a.join(b, "entity_id").filter("axis_a < axis_b").groupBy("axis_a", "axis_b").agg(n.alias("n"), (F.round(F.when(ok, F.corr("x", "y")), 6) + F.lit(0.0)).alias("r"))


@query(
    "spearman_runs",
    f"""with {RANKED}, p as (select a.axis_key, a.run as run_a, b.run as run_b, a.entity_id, a.s as x, b.s as y from ranked a join ranked b on a.axis_key = b.axis_key and a.entity_id = b.entity_id and a.run < b.run),
    k as (select axis_key, run_a, run_b from p group by 1, 2, 3 having count(*) >= 3),
    o as (select p.*, row_number() over (partition by axis_key, run_a, run_b order by x) as rx, row_number() over (partition by axis_key, run_a, run_b order by y) as ry from p join k using (axis_key, run_a, run_b)),
    v as (select *, avg(rx) over (partition by axis_key, run_a, run_b, x) as ax, avg(ry) over (partition by axis_key, run_a, run_b, y) as ay from o)
    select axis_key, run_a, run_b, count(*) as n, round(case when stddev_pop(ax) > 1e-12 and stddev_pop(ay) > 1e-12 then corr(ax, ay) end, 6) + 0.0 as rho from v group by 1, 2, 3""",
)
def spearman_runs(spark, sf):
    """Agreement of two runs of an axis over the entities that both rank.

    The axis's entities have one order, by the runs that rank them.  Where two runs share three, the rarest of those
    is behind two others in either run.  So the pairs are found without each run's two commonest entities, such as
    an anchor that nearly all runs share; those are looked up for the pairs that were found.
    """
    from pyspark.sql import Window

    n = nodes(spark, sf)
    entity, keys = ["axis_key", "entity_id"], ["axis_key", "run_a", "run_b"]
    n = n.join(n.groupBy(*entity).agg(F.count(F.lit(1)).alias("runs")), entity)
    place = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("runs"), "entity_id"))
    n = materialise(n.select(*entity, "run", "s", (place <= 2).alias("common")), "shared-entities")
    a = lambda rows: rows.select(*entity, F.col("run").alias("run_a"), F.col("s").alias("x"))
    b = lambda rows: rows.select(*entity, F.col("run").alias("run_b"), F.col("s").alias("y"))
    common, rare = n.filter("common"), n.filter("not common")
    found = a(rare).join(b(rare), entity).filter("run_a < run_b")
    pairs = found.select(*keys).distinct()
    of_a = pairs.join(a(common), ["axis_key", "run_a"]).join(b(n), [*entity, "run_b"])
    of_b = pairs.join(b(common), ["axis_key", "run_b"]).join(a(rare), [*entity, "run_a"])
    p = found.unionByName(of_a).unionByName(of_b)
    p = p.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n >= 3").drop("_n")
    return R.spearman(p, keys, "x", "y").withColumn("rho", r6("rho"))


@query(
    "response_assembly",
    f"""with {_UNITS} select run, axis_key, entity_id, row_number() over (partition by run, axis_key order by (z >= -0.5) desc, s desc, entity_id) as place, (z >= -0.5) as feasible from unit""",
)
def response_assembly(spark, sf):
    """Feasible entities by score, then the infeasible ones."""
    from pyspark.sql import Window

    u = R.attribute_units(nodes(spark, sf), RUN).withColumn("feasible", F.col("z") >= -0.5)
    w = Window.partitionBy(*RUN).orderBy(F.desc("feasible"), F.desc("s"), "entity_id")
    return u.select(*RUN, "entity_id", F.row_number().over(w).cast("long").alias("place"), "feasible")
