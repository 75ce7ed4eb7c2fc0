"""Queries of the planner and of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.math import correlation
from pairloom.operators import metrics as M
from pairloom.operators import planner as L
from pairloom.plans.evidence_queries import obs, r6
from pairloom.plans.ranking_queries import ENTITY_AXES, K, NODES, RANKED, RUN, _BAND, entity_axes, flip, nodes
from pairloom.plans.registry import OBS, query, table

#: A run's scores against the mean over all runs.
TRUTH = f"""{ENTITY_AXES}, rows as (select n.run, n.axis_key, n.entity_id, n.s, n.v, round(ea.s, 6) as t from nodes n join ea using (axis_key, entity_id)),
    p as (select *, row_number() over (g order by s desc, entity_id) as ps, row_number() over (g order by t desc, entity_id) as pt, rank() over (g order by t desc) as rt from rows window g as (partition by run, axis_key)),
    q as (select a.run, a.axis_key, sign(a.s - b.s) as ds, sign(a.t - b.t) as dt, least(a.ps, a.pt) as pa, least(b.ps, b.pt) as pb, (a.ps <= {K} or a.rt <= {K}) as ina, (b.ps <= {K} or b.rt <= {K}) as inb
          from p a join p b on a.run = b.run and a.axis_key = b.axis_key and a.entity_id < b.entity_id)"""


def truth(spark, sf):
    return nodes(spark, sf).join(entity_axes(spark, sf).select("axis_key", "entity_id", F.round("s", 6).alias("t")), ["axis_key", "entity_id"])


@query("kendall_tau_b", f"with {TRUTH} select run, axis_key, round(case when count_if(ds <> 0) > 0 and count_if(dt <> 0) > 0 then sum(ds * dt) / sqrt(count_if(ds <> 0)::double * count_if(dt <> 0)) else 0 end, 6) + 0.0 as tau_b from q group by 1, 2")
def kendall_tau_b(spark, sf):
    return M.kendall_tau_b(truth(spark, sf), RUN).withColumn("tau_b", r6("tau_b"))


@query(
    "topk_precision_recall",
    f"""with {TRUTH} select run, axis_key, round(count_if(ps <= {K} and rt <= {K}) / count_if(ps <= {K})::double, 6) as precision, round(count_if(ps <= {K} and rt <= {K}) / count_if(rt <= {K})::double, 6) as recall,
        round(count_if(ps <= {K} and rt <= {K}) / count_if(ps <= {K} or rt <= {K})::double, 6) as jaccard, round(greatest(sum(case when rt <= {K} then t else 0 end) - sum(case when ps <= {K} then t else 0 end), 0), 4) + 0.0 as regret from p group by 1, 2""",
)
def topk_precision_recall(spark, sf):
    x = M.topk(truth(spark, sf), RUN, K)
    return x.select(*RUN, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "jaccard")], (F.round("regret", 4) + F.lit(0.0)).alias("regret"))


@query("coverage95", f"with {TRUTH} select run, axis_key, round(avg((abs(t - s) <= 1.96 * sqrt(v))::int), 6) as coverage from rows group by 1, 2")
def coverage95(spark, sf):
    return M.coverage(truth(spark, sf), RUN).withColumn("coverage", F.round("coverage", 6))


@query(
    "ndcg",
    f"""with {TRUTH}, g as (select *, power(2, case when max(t) over w > min(t) over w then (t - min(t) over w) / (max(t) over w - min(t) over w) else 1 end) - 1 as g from p window w as (partition by run, axis_key)),
    d as (select run, axis_key, sum(case when ps <= {K} then g / log2(ps + 1) else 0 end) as got, sum(case when pt <= {K} then g / log2(pt + 1) else 0 end) as best from g group by 1, 2)
    select run, axis_key, round(case when best > 0 then got / best else 1 end, 6) as ndcg from d""",
)
def ndcg(spark, sf):
    return M.ndcg(truth(spark, sf), RUN, K).withColumn("ndcg", F.round("ndcg", 6))


_CREDIT = "case when ds = dt then 1.0 when ds = 0 or dt = 0 then 0.5 else 0 end"


@query("curl_harmonic", f"with {TRUTH} select run, axis_key, round(sum({_CREDIT} / (pa * pb)::double) / sum(1 / (pa * pb)::double), 6) as curl from q group by 1, 2")
def curl_harmonic(spark, sf):
    return M.curl(truth(spark, sf), RUN).withColumn("curl", F.round("curl", 6))


@query("curl_exponential", f"with {TRUTH} select run, axis_key, round(sum({_CREDIT} * exp(-0.1 * least(pa, pb))) / sum(exp(-0.1 * least(pa, pb))), 6) as curl from q group by 1, 2")
def curl_exponential(spark, sf):
    return M.curl(truth(spark, sf), RUN, 0.1).withColumn("curl", F.round("curl", 6))


@query("rank_reversals", f"with {TRUTH} select run, axis_key, round(sum(case when pt <= {K} then abs(ps - pt) / pt::double else 0 end), 6) as rank_reversals from p group by 1, 2")
def rank_reversals(spark, sf):
    return M.rank_reversals(truth(spark, sf), RUN, K).withColumn("rank_reversals", F.round("rank_reversals", 6))


@query("topk_discordance", f"with {TRUTH} select run, axis_key, count_if(ina and inb and ds * dt < 0) as discordant from q group by 1, 2")
def topk_discordance(spark, sf):
    return M.topk_discordance(truth(spark, sf), RUN, K)


@query(
    "auc",
    f"""with {TRUTH}, l as (select *, (pt <= count(*) over (partition by run, axis_key) / 2.0)::int as y from p), r as (select *, row_number() over (partition by run, axis_key order by s) as r from l),
    a as (select *, avg(r) over (partition by run, axis_key, s) as a from r), g as (select run, axis_key, sum(y) as np, count(*) - sum(y) as nq, sum(case when y = 1 then a end) as r from a group by 1, 2)
    select run, axis_key, round(case when np > 0 and nq > 0 then (r - np * (np + 1) / 2) / (np * nq) end, 6) as auc from g""",
)
def auc(spark, sf):
    """How well a run tells the better half from the other."""
    p = M.placed(truth(spark, sf), RUN).withColumn("y", (F.col("pt") <= F.col("n") / 2).cast("int"))
    return M.auc(p, RUN, "s", "y").withColumn("auc", F.round("auc", 6))


_CAL = """c as (select delivery_id, case when confidence > 1 then confidence / 100 else confidence end as p, (higher_ranked = 'A')::int as y from comparisons where confidence is not null and not isnan(confidence) and higher_ranked in ('A', 'B')),
    o as (select *, row_number() over (order by p, delivery_id) - 1 as k, count(*) over () as n from c), b as (select *, list_max(list_filter(range(0, 10), lambda r: floor(r * n / 10.0) <= k))::int as bin from o),
    bins as (select bin, count(*) as n, avg(p) as mean_p, avg(y) as mean_y from b group by 1)"""


def _calibration(spark, sf):
    c = table(spark, sf, "comparisons").filter(F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("higher_ranked").isin("A", "B"))
    p = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return c.select("delivery_id", p.alias("p"), (F.col("higher_ranked") == "A").cast("int").alias("y"))


@query("reliability_deciles", f"with {_CAL} select bin, n, round(mean_p, 6) as mean_p, round(mean_y, 6) as mean_y from bins")
def reliability_deciles(spark, sf):
    return M.reliability_bins(_calibration(spark, sf), "p", "y", "delivery_id").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(
    "reliability_line",
    f"""with {_CAL}, g as (select sum(n) as n, sum(n * mean_p) as sx, sum(n * mean_y) as sy, sum(n * mean_p * mean_p) as sxx, sum(n * mean_p * mean_y) as sxy from bins),
    s as (select *, (sxy - sx * sy / n) / (sxx - sx * sx / n) as slope from g) select round(slope, 5) as slope, round((sy - slope * sx) / n, 5) as intercept from s""",
)
def reliability_line(spark, sf):
    x = M.reliability_line(M.reliability_bins(_calibration(spark, sf), "p", "y", "delivery_id"))
    return x.select(F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("brier", f"with {_CAL} select round(avg((p - y) * (p - y)), 6) as brier, round(avg(y) * (1 - avg(y)), 6) as base_rate, count(*) as n from c")
def brier(spark, sf):
    d = F.col("p") - F.col("y")
    return _calibration(spark, sf).agg(F.round(F.avg(d * d), 6).alias("brier"), F.round(F.avg("y") * (1 - F.avg("y")), 6).alias("base_rate"), F.count(F.lit(1)).alias("n"))


_WILSON = "((k / n::double + 1.9208 / n) {0} 1.96 * sqrt(k / n::double * (1 - k / n::double) / n + 0.9604 / (n * n::double))) / (1 + 3.8416 / n)"


@query("wilson_intervals", f"with c as (select model, count(*) as n, count_if(refused = 1) as k from comparisons group by 1) select model, n, k, round(greatest({_WILSON.format('-')}, 0), 6) as low, round(least({_WILSON.format('+')}, 1), 6) as high from c")
def wilson_intervals(spark, sf):
    """Each model's share of refusals."""
    c = table(spark, sf, "comparisons").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("refused") == 1).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return c.select("model", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "method_comparison",
    f"""with {TRUTH}, z as (select axis_key, entity_id, avg(s) as m from nodes group by 1, 2), x as (select axis_key, run, corr(s, t) as r, corr(ps, pt) as q from p group by 1, 2 having count(*) >= 5)
    select count_if(r - q > 1e-12) as wins, count_if(r - q < -1e-12) as losses, count_if(abs(r - q) <= 1e-12) as ties, round(avg(r - q), 6) as mean_delta from x where r is not null and q is not null""",
)
def method_comparison(spark, sf):
    """Correlation on scores against correlation on places, run by run.

    Scores without spread have no correlation, for which DuckDB gives NaN: not null, and more than any number, so the SQL counts
    such a run as a win and its mean is NaN.
    """
    r = lambda x, y: F.coalesce(correlation(x, y), F.lit(float("nan")))
    p = M.placed(truth(spark, sf), RUN).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), r("s", "t").alias("r"), r("ps", "pt").alias("q")).filter("n >= 5")
    long = p.select(*RUN, F.explode(F.array(F.struct(F.lit("scores").alias("method"), F.col("r").alias("x")), F.struct(F.lit("places").alias("method"), F.col("q").alias("x")))).alias("y")).select(*RUN, "y.method", "y.x")
    return M.compare_methods(long, RUN, "method", "scores", "places", "x").withColumn("mean_delta", F.round("mean_delta", 6))


_GAIN = f"""{RANKED}, g as (select a.run, a.axis_key, least(a.entity_id, b.entity_id) as i, greatest(a.entity_id, b.entity_id) as j, a.s - b.s as d, a.v + b.v as r,
        (1.0::double / a.rank + 1.0::double / b.rank) / 2 * case when a.rank > {K} and b.rank > {K} then 0.25 else 1 end as w
    from ranked a join ranked b on a.run = b.run and a.axis_key = b.axis_key and a.rank < b.rank),
    h as (select *, ln(1 + r) / 2 as info, w * ({flip('d', 'r')} - {flip('d', '(r / (1 + r))')}) as risk from g)"""


@query("plan_edges", f"with {_GAIN}, o as (select *, row_number() over (partition by run, axis_key order by round(info + risk, 9) desc, i, j) as place from h) select run, axis_key, i, j, round(info, 5) as d_info, round(risk, 5) + 0.0 as d_risk, place from o where place <= 10")
def plan_edges(spark, sf):
    b = L.best_edges(nodes(spark, sf), RUN, K, 10)
    return b.select(*RUN, "i", "j", F.round("d_info", 5).alias("d_info"), (F.round("d_risk", 5) + F.lit(0.0)).alias("d_risk"), F.col("place").cast("long").alias("place"))


@query(
    "frontier_candidates",
    f"""with {_BAND}, b as (select * from t where n > {K} and ucb >= tl and lcb <= tu), i as (select run, axis_key, entity_id from b where rank <= {K} qualify row_number() over (partition by run, axis_key order by lcb, entity_id) <= 3),
    c as (select run, axis_key, entity_id from b where rank > {K} qualify row_number() over (partition by run, axis_key order by ucb desc, entity_id) <= 3)
    select i.run, i.axis_key, i.entity_id as incumbent, c.entity_id as challenger from i join c on i.run = c.run and i.axis_key = c.axis_key""".replace(", b as (select *, s - 1.96", ", b0 as (select *, s - 1.96").replace("from b),\n    t as", "from b0),\n    t as").replace("as u from b)", "as u from b0)"),
)
def frontier_candidates(spark, sf):
    return L.frontier(nodes(spark, sf), RUN, K, 3)


def _edges(spark, sf):
    return obs(spark, sf).select(*RUN, "i", "j").distinct()


@query(
    "explore_needy",
    f"""with {OBS}, {NODES}, e as (select distinct run, axis_key, i, j from obs), d as (select run, axis_key, x, count(*) as degree from (select run, axis_key, i as x from e union all select run, axis_key, j from e) group by 1, 2, 3),
    n as (select nodes.run, nodes.axis_key, entity_id, coalesce(degree, 0) as degree, row_number() over (partition by nodes.run, nodes.axis_key order by entity_id) - 1 as pos from nodes left join d on d.run = nodes.run and d.axis_key = nodes.axis_key and d.x = entity_id),
    a as (select run, axis_key, entity_id as anchor, pos // 5 as k, count(*) over (partition by run, axis_key) as m from n where pos % 5 = 0)
    select n.run, n.axis_key, n.entity_id, n.degree, a.anchor from n join a on a.run = n.run and a.axis_key = n.axis_key and n.pos % a.m = a.k where n.degree < 2 and a.anchor <> n.entity_id""",
)
def explore_needy(spark, sf):
    return L.explore_needy(nodes(spark, sf), _edges(spark, sf), RUN)


@query("batch_proposals")
def batch_proposals(spark, sf):
    """The next batch of each run: exploration, frontier and best gains."""
    p = L.proposals(nodes(spark, sf), _edges(spark, sf), RUN, K, 32)
    return p.select(*RUN, "i", "j", "kind", "place")


@query(
    "matching_schedule",
    """select r as round, s as slot, least(x, y) as a, greatest(x, y) as b from (select r, s, case when s = 0 then 41 else (r + s) % 41 end as x, (r - s + 41) % 41 as y from (select unnest(range(0, 41)) as r), (select unnest(range(0, 21))::int as s)) where x < 41 and y < 41""",
)
def matching_schedule(spark, sf):
    """41 entities, each against every other once."""
    return L.round_robin(spark, 41)


@query("circulant_pairs", "select distinct least(i, (i + s) % 60) as a, greatest(i, (i + s) % 60) as b from (select unnest(range(0, 60)) as i), (values (1), (2), (4), (8), (16)) as t(s)")
def circulant_pairs(spark, sf):
    return L.circulant(spark, 60, L.doubling_strides(60))


@query(
    "setwise_lowering",
    f"with {RANKED}, t as (select run, axis_key, entity_id, (rank - 1) // 4 as tier from ranked where rank <= 12) select a.run, a.axis_key, a.entity_id as winner, b.entity_id as loser from t a join t b on a.run = b.run and a.axis_key = b.axis_key and a.tier < b.tier",
)
def setwise_lowering(spark, sf):
    """The best twelve of each run in tiers of four, lowered to ordinal pairs."""
    from pairloom.operators.ranking import ranked

    t = ranked(nodes(spark, sf), RUN).filter("rank <= 12").select(*RUN, "entity_id", F.floor((F.col("rank") - 1) / 4).alias("tier"))
    return L.lower_tiers(t, RUN)
