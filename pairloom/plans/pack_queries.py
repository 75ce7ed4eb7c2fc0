"""Queries of the evidence packs: prices of reversals, split draws, residual groups, synthetic judge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions.math import normal_cdf
from pairloom.operators import evidence as E
from pairloom.operators import ranking as R
from pairloom.plans.evidence_queries import obs
from pairloom.plans.ranking_queries import RANKED, RUN, nodes, phi
from pairloom.plans.registry import OBS, query

#: Spread between and within pairs that the price of a reversal assumes.
SIGMA_B, SIGMA_W = 0.2, 0.4
PAIR = ["axis_key", "model", "i", "j"]

_SPLIT = f"""{OBS}, d as (select axis_key, model, i, j, m, row_number() over w as k, count(*) over (partition by axis_key, model, i, j) as n from obs window w as (partition by axis_key, model, i, j order by observed_at, delivery_id)),
    h as (select axis_key, model, i, j, avg(case when k <= n // 2 then m end) as price, avg(case when k > n // 2 then m end) as claim, any_value(n) as draws from d where n >= 4 group by 1, 2, 3, 4)"""


def split_draws(spark, sf):
    """Draws of each pair in order of time: the first half sets the price, the second makes the claim; at least four."""
    o = obs(spark, sf, "observed_at", "delivery_id")
    w = Window.partitionBy(*PAIR)
    d = o.withColumns({"k": F.row_number().over(w.orderBy("observed_at", "delivery_id")), "n": F.count(F.lit(1)).over(w)}).filter("n >= 4")
    first = F.col("k") <= F.floor(F.col("n") / 2)
    return d.groupBy(*PAIR).agg(F.avg(F.when(first, F.col("m"))).alias("price"), F.avg(F.when(~first, F.col("m"))).alias("claim"), F.max("n").alias("n"))


_VAR = f"({SIGMA_B}::double * {SIGMA_B}::double + {SIGMA_W}::double * {SIGMA_W}::double / (draws - draws // 2) + {SIGMA_W}::double * {SIGMA_W}::double / (draws // 2))"


@query(
    "reversal_price",
    f"""with {_SPLIT} select axis_key, model, count(*) as pairs, round(sum({phi(f'-abs(price) / sqrt({_VAR})')}), 6) as premium, count_if(price * claim < 0) as claims from h where price <> 0 group by 1, 2""",
)
def reversal_price(spark, sf):
    """Expected and actual reversals of the second half of the draws against the first."""
    h = split_draws(spark, sf).filter("price <> 0")
    half = F.floor(F.col("n") / 2)
    sd = F.sqrt(F.lit(SIGMA_B * SIGMA_B) + SIGMA_W * SIGMA_W / (F.col("n") - half) + SIGMA_W * SIGMA_W / half)
    p = h.withColumn("p", normal_cdf(-F.abs("price") / sd))
    return p.groupBy("axis_key", "model").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("p"), 6).alias("premium"), F.count_if(F.col("price") * F.col("claim") < 0).alias("claims"))


_MULTIPLIERS = (0.0, 0.5, 1.0, 2.0)
_WARRANTY_VAR = f"(mult * mult * {SIGMA_W}::double * {SIGMA_W}::double + {SIGMA_W}::double * {SIGMA_W}::double / (draws - draws // 2) + {SIGMA_W}::double * {SIGMA_W}::double / (draws // 2))"


@query(
    "warranty_sensitivity",
    f"""with {_SPLIT}, r as (select h.*, mult::double as mult from h, (values {', '.join(f'({m!r})' for m in _MULTIPLIERS)}) as t(mult) where price <> 0)
    select mult as multiplier, count(*) as pairs, round(sum({phi(f'-abs(price) / sqrt({_WARRANTY_VAR})')}), 4) as premium, count_if(price * claim < 0) as claims,
        round(count_if(price * claim < 0) / sum({phi(f'-abs(price) / sqrt({_WARRANTY_VAR})')}), 4) as loss_ratio from r group by 1""",
)
def warranty_sensitivity(spark, sf):
    """Premiums, claims and their ratio over all warranties, were the spread between pairs so many times that within them."""
    h = split_draws(spark, sf).filter("price <> 0").withColumn("mult", F.explode(F.array(*map(F.lit, _MULTIPLIERS))))
    half, w2 = F.floor(F.col("n") / 2), F.lit(SIGMA_W * SIGMA_W)
    p = normal_cdf(-F.abs("price") / F.sqrt(F.col("mult") * F.col("mult") * w2 + w2 / (F.col("n") - half) + w2 / half))
    claims = F.count_if(F.col("price") * F.col("claim") < 0)
    g = h.withColumn("p", p).groupBy(F.col("mult").alias("multiplier")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("p").alias("x"), claims.alias("claims"))
    return g.select("multiplier", "pairs", F.round("x", 4).alias("premium"), "claims", F.round(F.col("claims") / F.when(F.col("x") > 0, F.col("x")), 4).alias("loss_ratio"))


@query(
    "residual_groups",
    f"""with {OBS}, g as (select model, axis_key, i, j, count(*) as k, var_pop(m) * count(*) as ss from obs group by 1, 2, 3, 4)
    select model, count(*) as groups, count_if(k = 1) as singletons, sum(k - 1)::bigint as df, round(sum(case when k >= 2 then ss else 0 end), 4) + 0.0 as ss from g group by 1""",
)
def residual_groups(spark, sf):
    g = E.pair_moments(obs(spark, sf), "model", "axis_key")
    k = F.col("k")
    return g.groupBy("model").agg(F.count(F.lit(1)).alias("groups"), F.count_if(k == 1).alias("singletons"), F.sum(k - 1).alias("df"), (F.round(F.sum(F.when(k >= 2, F.col("ss")).otherwise(0.0)), 4) + F.lit(0.0)).alias("ss"))


_NOISE = "((a.rank * 7919 + b.rank * 104729) % 1000 / 1000.0::double - 0.5)"


@query(
    "synthetic_judge",
    f"""with {RANKED}, p as (select a.run, a.axis_key, a.entity_id as x, b.entity_id as y, b.rank - a.rank + 3 * {_NOISE} as d from ranked a join ranked b on a.run = b.run and a.axis_key = b.axis_key and b.rank > a.rank and b.rank - a.rank in (1, 2, 4))
    select run, axis_key, x, y, case when d >= 0 then 'A' else 'B' end as higher_ranked, round(least(exp(abs(d) / 4), 26), 6) as ratio from p""",
)
def synthetic_judge(spark, sf):
    """Readings of neighbours 1, 2 and 4 places apart by a judge with seeded noise: no random numbers, so runs repeat."""
    r = R.ranked(nodes(spark, sf), RUN)
    a = r.select(*RUN, F.col("entity_id").alias("x"), F.col("rank").alias("ra"))
    b = r.withColumn("ra", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda s: F.col("rank") - s))).select(*RUN, "ra", F.col("entity_id").alias("y"), F.col("rank").alias("rb"))
    p = a.join(b, [*RUN, "ra"])
    d = F.col("rb") - F.col("ra") + 3 * (((F.col("ra") * 7919 + F.col("rb") * 104729) % 1000) / 1000 - 0.5)
    return p.select(*RUN, "x", "y", F.when(d >= 0, "A").otherwise("B").alias("higher_ranked"), F.round(F.least(F.exp(F.abs(d) / 4), F.lit(26.0)), 6).alias("ratio"))


@query(
    "likert_baseline",
    f"""with {RANKED}, l as (select *, greatest(least(floor(5 * (1 - (rank - 0.5) / count(*) over (partition by run, axis_key))) + 1, 5), 1) as rating from ranked)
    select axis_key, entity_id, round(avg(rating), 6) as rating, count(*) as ratings from l group by 1, 2""",
)
def likert_baseline(spark, sf):
    """Five-point ratings of each run's places, averaged for each entity: what the pairwise scores are held against."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*RUN))
    r = R.ranked(nodes(spark, sf), RUN).withColumn("rating", F.greatest(F.least(F.floor(5 * (1 - (F.col("rank") - 0.5) / n)) + 1, F.lit(5)), F.lit(1)))
    return r.groupBy("axis_key", "entity_id").agg(F.round(F.avg("rating"), 6).alias("rating"), F.count(F.lit(1)).alias("ratings"))


@query(
    "cost_to_target",
    f"""with {OBS}, b as (select axis_key, model, count(*) as n, stddev_samp(m) / sqrt(count(*)) as se from obs group by 1, 2 having count(*) >= 2 and stddev_samp(m) > 0),
    o as (select *, lead(n) over (partition by axis_key order by se desc, model) as n2, lead(se) over (partition by axis_key order by se desc, model) as se2 from b)
    select axis_key, round(exp(ln(n) + (ln(n2) - ln(n)) * (ln(se) - ln(0.15)) / (ln(se) - ln(se2))), 4) as readings from o where se > 0.15 and se2 <= 0.15""",
)
def cost_to_target(spark, sf):
    """Readings for a standard error of 0.15, log-linear between the models' budgets that enclose it."""
    b = obs(spark, sf).groupBy("axis_key", "model").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se")).filter("n >= 2 and se > 0")
    w = Window.partitionBy("axis_key").orderBy(F.desc("se"), "model")
    o = b.withColumns({"n2": F.lead("n").over(w), "se2": F.lead("se").over(w)}).filter("se > 0.15 and se2 <= 0.15")
    share = (F.log("se") - F.log(F.lit(0.15))) / (F.log("se") - F.log("se2"))
    return o.select("axis_key", F.round(F.exp(F.log("n") + (F.log("n2") - F.log("n")) * share), 4).alias("readings"))


