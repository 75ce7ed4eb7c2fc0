"""Queries of answer distributions, probes and consistency."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pairloom.operators import pmf as P
from pairloom.operators import probes as B
from pairloom.plans.evidence_queries import obs, r6
from pairloom.plans.registry import OBS, query

_LOGS = "[" + ", ".join(f"{x!r}::double" for x in P.LOGS) + "]"
_LADDER = f"""{OBS}, l as (select *, {_LOGS} as logs, case when m < 0 then -1 else 1 end as side, abs(m) as size from obs),
    k as (select *, greatest(len(list_filter(logs, lambda x: x < size)) - 1, 0) as low from l),
    u as (select *, least(low + 1, 25) as up from k),
    w as (select *, case when size >= logs[26] then null when low = up then 1 else (size - logs[low + 1]) / (logs[up + 1] - logs[low + 1]) end as share from u),
    atoms as (select axis_key, model, i, j, (side * 25)::int as atom, 1.0::double as p from w where share is null
              union all select axis_key, model, i, j, (side * low)::int, 1 - share from w where 1 - share > 0
              union all select axis_key, model, i, j, (side * up)::int, share from w where share > 0)"""
_PMF = _LADDER + f""", merged as (select axis_key, model, atom, sum(p) as p from atoms group by 1, 2, 3),
    pmf as (select axis_key, model, atom, p / sum(p) over (partition by axis_key, model) as p from merged),
    valued as (select *, sign(atom) * {_LOGS}[abs(atom) + 1] as v from pmf)"""
AM = ["axis_key", "model"]


@query("ladder_interpolate", f"with {_LADDER} select axis_key, atom, count(*) as n, round(sum(p), 4) as mass from atoms group by 1, 2")
def ladder_interpolate(spark, sf):
    x = obs(spark, sf).select("axis_key", F.explode(P.on_ladder(F.col("m"))).alias("x"))
    return x.groupBy("axis_key", F.col("x.atom").alias("atom")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.p"), 4).alias("mass"))


@query("pmf_normalise", f"with {_PMF} select axis_key, model, atom, round(p, 6) as p from pmf")
def pmf_normalise(spark, sf):
    return P.from_readings(obs(spark, sf), AM).withColumn("p", F.round("p", 6))


@query(
    "pmf_moments",
    f"""with {_PMF} select axis_key, model, round(sum(p * v), 6) + 0.0 as mean, round(sum(p * v * v) - sum(p * v) * sum(p * v), 6) + 0.0 as variance, round(sum(case when atom > 0 then p else 0 end), 6) as p_first,
        round(sum(case when atom = 0 then p else 0 end), 6) as p_equal, round(sum(case when atom < 0 then p else 0 end), 6) as p_second,
        round(sum(case when p > 0 then -p * ln(p) else 0 end), 6) as entropy, arg_max(atom, (round(p, 9), -atom)) as top from valued group by 1, 2""",
)
def pmf_moments(spark, sf):
    s = P.summary(P.from_readings(obs(spark, sf), AM), AM)
    return s.select(*AM, r6("mean").alias("mean"), r6(F.col("second") - F.col("mean") * F.col("mean")).alias("variance"), *[r6(c).alias(c) for c in ("p_first", "p_equal", "p_second", "entropy")], "top")


@query(
    "pmf_jsd",
    f"""with {_PMF}, pool as (select axis_key, atom, sum(p) as p from atoms group by 1, 2), pp as (select axis_key, atom, p / sum(p) over (partition by axis_key) as q from pool),
    grid as (select distinct axis_key, model from pmf), j as (select g.axis_key, g.model, pp.q, coalesce(pmf.p, 0) as p from grid g join pp on pp.axis_key = g.axis_key left join pmf on pmf.axis_key = g.axis_key and pmf.model = g.model and pmf.atom = pp.atom)
    select axis_key, model, round(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2), 6) + 0.0 as jsd from j group by 1, 2""",
)
def pmf_jsd(spark, sf):
    """Divergence of each model's answers on an axis from all models'."""
    o = obs(spark, sf)
    own, pool = P.from_readings(o, AM), P.from_readings(o, ["axis_key"])
    each = own.select(*AM).distinct().join(pool, "axis_key").select(*AM, "atom", "p")
    return P.jensen_shannon(own, each, AM).withColumn("jsd", r6("jsd"))


@query(
    "pmf_convolve",
    f"""with {_PMF}, c as (select a.model, a.axis_key as axis_a, b.axis_key as axis_b, round(a.v + b.v, 9) + 0.0 as value, sum(a.p * b.p) as p from valued a join valued b on a.model = b.model and a.axis_key < b.axis_key group by all)
    select model, axis_a, axis_b, count(*) as points, round(sum(value * p), 6) + 0.0 as mean, round(sum(case when value > 0 then p else 0 end), 6) as p_positive, round(sum(case when abs(value) <= ln(2.0::double) then p else 0 end), 6) as p_near from c group by 1, 2, 3""",
)
def pmf_convolve(spark, sf):
    """Sum of the log-ratios of every two axes for each model: its mean, the chance that it's above 0 and within a factor of two."""
    x = pmf_convolve_axes(spark, sf)
    part = lambda good: F.round(F.sum(F.when(good, F.col("p")).otherwise(0.0)), 6)
    g = x.groupBy("model", "axis_a", "axis_b")
    return g.agg(F.count(F.lit(1)).alias("points"), r6(F.sum(F.col("value") * F.col("p"))).alias("mean"), part(F.col("value") > 0).alias("p_positive"), part(F.abs("value") <= math.log(2.0)).alias("p_near"))


@query(
    "pmf_reflect_compress",
    f"""with {_PMF}, r as (select axis_key, model, -v as value, sum(p) as p from valued group by 1, 2, 3),
    c as (select *, floor((row_number() over (partition by axis_key, model order by value) - 1) / ceil(count(*) over (partition by axis_key, model) / 128.0)) as c from r)
    select axis_key, model, round(sum(value * p) / sum(p), 6) + 0.0 as value, round(sum(p), 6) as p from c group by axis_key, model, c""",
)
def pmf_reflect_compress(spark, sf):
    return pmf_reflect_compress_axes(spark, sf)


def pmf_convolve_axes(spark, sf):
    """Distribution of the sum of the log-ratios of every two axes for each model."""
    p = P.from_readings(obs(spark, sf), AM)
    axes = p.select(*AM).distinct()
    pairs = axes.withColumnRenamed("axis_key", "axis_a").join(axes.withColumnRenamed("axis_key", "axis_b"), "model").filter("axis_a < axis_b")
    on = lambda x: pairs.join(p.withColumnRenamed("axis_key", x), [x, "model"])
    return P.convolved(on("axis_a"), on("axis_b"), ["axis_a", "axis_b", "model"])


def pmf_reflect_compress_axes(spark, sf):
    """Every axis and model, to at most 128 points."""
    p = P.reflected(P.from_readings(obs(spark, sf), AM))
    d = p.select(*AM, P.atom_value(F.col("atom")).alias("value"), "p")
    return P.compressed(d, AM, 128).select(*AM, r6("value").alias("value"), F.round("p", 6).alias("p"))


_DRAWS = f"{OBS}, draws as (select axis_key, model, case when m >= 0 then 'A' else 'B' end as direction, floor(least(ratio, 999.9))::bigint as whole, (floor(least(ratio, 999.9) * 10) - floor(least(ratio, 999.9)) * 10)::bigint as part from obs)"
_LEAVES = _DRAWS + ", n as (select axis_key, model, count(*) as n from draws group by 1, 2), leaves as (select axis_key, model, direction, whole, part, count(*) / any_value(n)::double as p, any_value(n) as n from draws join n using (axis_key, model) group by 1, 2, 3, 4, 5)"


def _leaves(spark, sf):
    """Leaves that were drawn, by their share of the draws; larger numbers than the digits can write count as the largest."""
    size = F.least("ratio", F.lit(999.9))
    draws = obs(spark, sf).select(*AM, F.when(F.col("m") >= 0, "A").otherwise("B").alias("direction"), F.floor(size).alias("whole"), (F.floor(size * 10) - F.floor(size) * 10).alias("part"))
    return P.leaf_shares(draws, AM)


@query("horvitz_thompson", f"with {_LEAVES} select axis_key, model, round(sum(p * ln(greatest(whole + part / 10.0::double, 1)) / (1 - power(1 - p, n))), 5) + 0.0 as estimate from leaves group by 1, 2")
def horvitz_thompson(spark, sf):
    return P.horvitz_thompson(_leaves(spark, sf), AM).withColumn("estimate", F.round("estimate", 5) + F.lit(0.0))


_CELLS = f"{OBS}, cells as (select axis_key, model, ((a < b)::int + 2 * (comparison_index % 2) + 4 * (delivery_id % 2))::int as g, avg(m) as m from obs group by 1, 2, 3), whole as (select axis_key, model from cells group by 1, 2 having count(*) = 8)"
_ORBIT = _CELLS + ", wht as (select axis_key, model, chi::int as chi, sum(m * case when bit_count((chi & g)::int) % 2 = 1 then -1 else 1 end) / 8 as c from cells join whole using (axis_key, model), (select unnest(range(0, 8))::int as chi) group by 1, 2, 3)"


def _orbit(spark, sf):
    o = obs(spark, sf, "comparison_index", "delivery_id")
    g = (F.col("a") < F.col("b")).cast("int") + 2 * (F.col("comparison_index") % 2) + 4 * (F.col("delivery_id") % 2)
    return B.orbit(o.groupBy(*AM, g.cast("int").alias("g")).agg(F.avg("m").alias("m")), AM)


@query("orbit_wht", f"with {_ORBIT} select axis_key, model, chi, round(c, 6) + 0.0 as coefficient from wht")
def orbit_wht(spark, sf):
    return _orbit(spark, sf).withColumn("coefficient", r6("coefficient"))


@query(
    "orbit_coherence",
    f"""with {_ORBIT}, p as (select axis_key, model, avg(m * m) as energy from cells join whole using (axis_key, model) group by 1, 2)
    select axis_key, model, round(sum(case when chi = 0 then c end), 6) + 0.0 as belief, round(any_value(energy), 6) as energy, round(sum(case when chi = 0 then c * c end) / any_value(energy), 6) + 0.0 as coherence,
        round(sum(case when chi in (3, 5, 6, 7) then c * c end) / any_value(energy), 6) + 0.0 as interaction from wht join p using (axis_key, model) group by 1, 2""",
)
def orbit_coherence(spark, sf):
    """By Parseval's identity the coefficients' energy is the cells' mean square, which is what the SQL takes."""
    return B.orbit_summary(_orbit(spark, sf), AM).select(*AM, *[r6(c).alias(c) for c in ("belief", "energy", "coherence", "interaction")])


@query(
    "wording_gap",
    f"""with {OBS}, w as (select axis_key, i, j, template_slug, avg(m) as mean from obs group by 1, 2, 3, 4)
    select axis_key, i, j, count(*) as wordings, round(max(mean) - min(mean), 6) + 0.0 as gap, min(sign(mean)) = max(sign(mean)) as consistent from w group by 1, 2, 3 having count(*) >= 2""",
)
def wording_gap(spark, sf):
    return B.wording_gap(obs(spark, sf, "template_slug"), ["axis_key", "i", "j"], "template_slug").withColumn("gap", r6("gap"))


@query(
    "spin_sweep",
    f"""with {OBS}, f as (select *, (comparison_index % 7 - 3)::double as field from obs)
    select axis_key, model, count(*) as n, round(case when var_pop(field) > 0 then covar_pop(m, field) / var_pop(field) end, 6) + 0.0 as slope,
        round(case when var_pop(field) > 0 and var_pop(m) > 0 then power(corr(m, field), 2) end, 6) + 0.0 as r2, round(avg(m), 6) + 0.0 as even from f group by 1, 2""",
)
def spin_sweep(spark, sf):
    """Slope of the readings over seven framings (here the place in the schedule)."""
    o = obs(spark, sf, "comparison_index").withColumn("field", (F.col("comparison_index") % 7 - 3).cast("double"))
    return B.spin_sweep(o, AM, "field").select(*AM, "n", *[r6(c).alias(c) for c in ("slope", "r2", "even")])


@query("nonce_draws", f"with {OBS} select axis_key, model, i, j, count(*) as draws, round(avg(m), 6) + 0.0 as mean, round(stddev_samp(m), 6) + 0.0 as sigma from obs group by 1, 2, 3, 4 having count(*) >= 2")
def nonce_draws(spark, sf):
    g = obs(spark, sf).groupBy(*AM, "i", "j").agg(F.count(F.lit(1)).alias("draws"), r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("sigma"))
    return g.filter("draws >= 2")


_RUN_SHARES = f"{OBS}, s as (select run, axis_key, i, j, avg(case when m > 0 then 1.0 when m = 0 then 0.5 else 0 end) as p, avg(m) as mu from obs group by 1, 2, 3, 4), t as (select e.run, e.axis_key, e.p as xy, f.p as yz, g.p as xz, e.mu as mxy, f.mu as myz, g.mu as mxz from s e join s f on f.run = e.run and f.axis_key = e.axis_key and f.i = e.j join s g on g.run = e.run and g.axis_key = e.axis_key and g.i = e.i and g.j = f.j)"
RUN = ["run", "axis_key"]


@query(
    "transitivity_triads",
    f"""with {_RUN_SHARES}, o as (select *, case when xy >= 0.5 and yz >= 0.5 then [xy, yz, xz] when xz >= 0.5 and 1 - yz >= 0.5 then [xz, 1 - yz, xy] when 1 - xy >= 0.5 and xz >= 0.5 then [1 - xy, xz, yz]
        when yz >= 0.5 and 1 - xz >= 0.5 then [yz, 1 - xz, 1 - xy] when 1 - xz >= 0.5 and xy >= 0.5 then [1 - xz, xy, 1 - yz] when 1 - yz >= 0.5 and 1 - xy >= 0.5 then [1 - yz, 1 - xy, 1 - xz] end as o from t)
    select run, axis_key, count(*) as triads, count_if(o[3] < 0.5) as weak, count_if(o[3] < least(o[1], o[2])) as moderate, count_if(o[3] < greatest(o[1], o[2])) as strong from o where o is not null group by 1, 2""",
)
def transitivity_triads(spark, sf):
    return B.transitivity(B.pair_shares(obs(spark, sf), RUN), RUN)


@query(
    "cyclic_triads",
    f"with {_RUN_SHARES} select run, axis_key, count(*) as triangles, count_if((mxy > 0 and myz > 0 and mxz < 0) or (mxy < 0 and myz < 0 and mxz > 0)) as cyclic from t where mxy <> 0 and myz <> 0 and mxz <> 0 group by 1, 2",
)
def cyclic_triads(spark, sf):
    return B.cyclic(obs(spark, sf).groupBy(*RUN, "i", "j").agg(F.avg("m").alias("mu")), RUN)


@query(
    "cross_judge_agreement",
    f"""with {OBS}, l as (select axis_key, i, j, model, arg_max(sign(m), delivery_id) as w from obs group by 1, 2, 3, 4)
    select a.axis_key, a.model as judge_a, b.model as judge_b, count(*) as pairs, round(avg((a.w = b.w)::int), 6) as agreement from l a join l b using (axis_key, i, j) where a.model < b.model group by 1, 2, 3""",
)
def cross_judge_agreement(spark, sf):
    return B.cross_judge(obs(spark, sf, "delivery_id"), ["axis_key"], order=F.col("delivery_id")).withColumn("agreement", F.round("agreement", 6))


_SHARE = "case when confidence > 1 then confidence / 100 else confidence end"


@query(
    "confidence_bins",
    f"with {OBS}, c as (select model, {_SHARE} as c from obs where confidence is not null) select model, greatest(least(floor(c * 10), 9), 0)::int as bin, count(*) as n from c group by 1, 2",
)
def confidence_bins(spark, sf):
    o = obs(spark, sf, "confidence").filter("confidence is not null")
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return B.histogram(o, ["model"], c, 10)


@query(
    "twin_agreement",
    f"""with {OBS}, t as (select model, axis_key, i, j, avg(case when a < b then m end) as f, avg(case when a > b then m end) as r from obs group by 1, 2, 3, 4)
    select model, count(*) as twins, round(avg((sign(f) = sign(r))::int), 6) as agreement, round(avg(abs(f - r)), 6) as mean_gap from t where f is not null and r is not null group by 1""",
)
def twin_agreement(spark, sf):
    """Pairs read in both orders: how often the winner stays and how far the readings lie apart."""
    order = F.col("a") < F.col("b")
    t = obs(spark, sf).groupBy("model", "axis_key", "i", "j").agg(F.avg(F.when(order, F.col("m"))).alias("f"), F.avg(F.when(~order, F.col("m"))).alias("r"))
    t = t.filter(F.col("f").isNotNull() & F.col("r").isNotNull())
    return t.groupBy("model").agg(F.count(F.lit(1)).alias("twins"), F.round(F.avg((F.signum("f") == F.signum("r")).cast("double")), 6).alias("agreement"), F.round(F.avg(F.abs(F.col("f") - F.col("r"))), 6).alias("mean_gap"))
