"""Queries over the fused evidence, sections on fusion and ledger reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators import evidence as E
from pairloom.plans.registry import CUR, EDGES, OBS, query, table

r6 = lambda c: (F.round(c, 6) + F.lit(0.0))  # noqa: E731  no negative zero


def obs(spark, sf, *extra):
    return E.observations(table(spark, sf, "comparisons"), *extra)


@query("fuse_edges", f"with {EDGES} select axis_key, i, j, round(mu, 6) + 0.0 as mu, lam from edges")
def fuse_edges(spark, sf):
    return E.fuse(obs(spark, sf), "axis_key").select("axis_key", "i", "j", r6("mu").alias("mu"), "lam")


@query("fuse_contributors", f"with {OBS} select axis_key, i, j, model, count(*)::double as lam from obs group by all")
def fuse_contributors(spark, sf):
    edges = E.fuse_with_contributors(obs(spark, sf), "axis_key")
    return edges.select("axis_key", "i", "j", F.explode("contributors").alias("model", "lam"))


@query("fuse_incremental", f"with {EDGES} select axis_key, i, j, round(mu, 6) + 0.0 as mu, lam from edges")
def fuse_incremental(spark, sf):
    """Two halves of the evidence by time, fused one after the other: the same edges as in one go."""
    o = obs(spark, sf, "landed_at")
    late = F.month("landed_at") % 2 == 0
    edges = E.fuse_increment(E.fuse(o.filter(~late), "axis_key"), o.filter(late), "axis_key")
    return edges.select("axis_key", "i", "j", r6("mu").alias("mu"), "lam")


@query(
    "observation_moments",
    f"""with {OBS}, t as (select axis_key, i, j, model, avg(m) as mean, greatest(coalesce(var_pop(m), 0), 0.001::double) as v, count(*) as k from obs group by 1, 2, 3, 4)
    select axis_key, i, j, round(sum(mean / v * k) / sum(k / v), 6) + 0.0 as mu, round(sum(k / v), 4) as lam from t group by 1, 2, 3""",
)
def observation_moments(spark, sf):
    """Each model's draws on a pair as one observation given by its moments."""
    per = obs(spark, sf).groupBy("axis_key", "i", "j", "model").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("variance"), F.count(F.lit(1)).alias("reps"))
    m, precision = E.from_moments(F.col("mean"), F.col("variance"))
    edges = E.fuse(per.withColumn("m", m), "axis_key", lam=E.weight(precision=precision, reps=F.col("reps").cast("double")))
    return edges.select("axis_key", "i", "j", r6("mu").alias("mu"), F.round("lam", 4).alias("lam"))


@query(
    "repeat_sigma_w",
    f"""with {OBS}, p as (select axis_key, model, i, j, count(*) as k, var_pop(m) * count(*) as ss from obs group by 1, 2, 3, 4)
    select axis_key, model, count_if(k >= 2) as repeated_pairs, sum(case when k >= 2 then k - 1 else 0 end)::bigint as df,
           round(sum(case when k >= 2 then ss end) / sum(case when k >= 2 then k - 1 end), 6) as sigma_w2 from p group by 1, 2""",
)
def repeat_sigma_w(spark, sf):
    return E.within_variance(obs(spark, sf), "axis_key", "model").withColumn("sigma_w2", F.round("sigma_w2", 6))


_BOTH = """both_orders as (select axis_key, model, i, j,
        arg_min(x, (comparison_index, delivery_id)) filter (where a < b and ok) as f, arg_min(x, (comparison_index, delivery_id)) filter (where a > b and ok) as r
    from t group by 1, 2, 3, 4)"""


@query(
    "counterbalance_flips",
    f"""with {OBS}, t as (select *, sign(m)::int as x, ratio > 1 as ok from obs), {_BOTH}
    select axis_key, model, count(*) as pairs, count_if(f <> r) as flips from both_orders where f is not null and r is not null group by 1, 2""",
)
def counterbalance_flips(spark, sf):
    return E.counterbalance(obs(spark, sf, "comparison_index", "delivery_id"), "axis_key", "model")


@query(
    "order_residual",
    f"""with {OBS}, t as (select *, m_first as x, true as ok from obs), {_BOTH}
    select axis_key, model, count(*) as pairs, round(avg(abs(f + r)), 6) as order_residual from both_orders where f is not null and r is not null group by 1, 2""",
)
def order_residual(spark, sf):
    return E.order_residual(obs(spark, sf, "comparison_index", "delivery_id"), "axis_key", "model").withColumn("order_residual", F.round("order_residual", 6))


@query(
    "run_accounting",
    f"""with {CUR} select run, count(*) as attempted, count_if(refused = 0 and error = '') as used, count_if(refused = 1) as refused, count_if(error <> '') as failed,
        count_if(cached = 1) as cached, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens,
        coalesce(sum(cost_nanodollars), 0)::bigint as nanodollars,
        case when count(distinct model) > 1 then 'mixed: ' || array_to_string(list_sort(list(distinct model)), ', ') else max(model) end as models_used
    from cur group by run""",
)
def run_accounting(spark, sf):
    rows = E.current(table(spark, sf, "comparisons"), "refused", "error", "cached", "input_tokens", "output_tokens", "cost_nanodollars", "model")
    return E.run_accounting(rows, "run")


@query(
    "margin_scores",
    f"""with {OBS}, e as (select axis_key, i as entity_id, m / ln(2) as s from obs union all select axis_key, j, -m / ln(2) from obs)
    select axis_key, entity_id, round(avg(s), 6) + 0.0 as margin, count(*) as readings from e group by 1, 2""",
)
def margin_scores(spark, sf):
    return E.margins(obs(spark, sf), "axis_key").withColumn("margin", r6("margin"))


@query("landed_counts", "select axis_key, count_if(higher_ranked in ('A', 'B') and error = '') as decisive, count(*) as landed from comparisons group by 1")
def landed_counts(spark, sf):
    ok = F.col("higher_ranked").isin("A", "B") & (F.col("error") == "")
    return table(spark, sf, "comparisons").groupBy("axis_key").agg(F.count_if(ok).alias("decisive"), F.count(F.lit(1)).alias("landed"))


@query(
    "latest_scores",
    """select run, entity_id, axis_key, s as latent_mean from (
        select lower(trim(run_id)) as run, entity_id, axis_key, latent_mean as s, row_number() over (partition by lower(trim(run_id)), entity_id, axis_key
          order by scored_at desc, coalesce(latent_mean, '-infinity'::double) desc) as rn from scores) where rn = 1""",
)
def latest_scores(spark, sf):
    """Latest row wins, by a max-aggregate instead of a sort of each key."""
    rows = table(spark, sf, "scores").withColumn("v", F.coalesce("latent_mean", F.lit(float("-inf"))))
    best = rows.groupBy(clean_key("run_id").alias("run"), "entity_id", "axis_key").agg(F.max(F.struct("scored_at", "v", "latent_mean")).alias("x"))
    return best.select("run", "entity_id", "axis_key", F.col("x.latent_mean").alias("latent_mean"))


@query(
    "warm_start_repeats",
    f"""with {OBS}, c as (select axis_key, i, j, count(*) as repeats from obs group by 1, 2, 3)
    select axis_key, repeats, count(*) as pairs from c group by 1, 2""",
)
def warm_start_repeats(spark, sf):
    """Prior observations by axis: how often each pair was read before."""
    c = obs(spark, sf).groupBy("axis_key", "i", "j").agg(F.count(F.lit(1)).alias("repeats"))
    return c.groupBy("axis_key", "repeats").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "observation_sanitiser",
    f"""with {CUR} select case when refused = 1 then 'refused' when error <> '' then 'error' when higher_ranked not in ('A', 'B') then 'no winner'
        when entity_a_id = entity_b_id then 'same entity' when ratio is null then 'no ratio' when isnan(ratio) or isinf(ratio) then 'not finite'
        when ratio <= 0 then 'not positive' else 'used' end as outcome, count(*) as n from cur group by 1""",
)
def observation_sanitiser(spark, sf):
    rows = E.current(table(spark, sf, "comparisons"), "refused", "error", "higher_ranked", "entity_a_id", "entity_b_id", "ratio")
    ratio = F.col("ratio")
    outcome = (
        F.when(F.col("refused") == 1, "refused").when(F.col("error") != "", "error").when(~F.col("higher_ranked").isin("A", "B"), "no winner")
        .when(F.col("entity_a_id") == F.col("entity_b_id"), "same entity").when(ratio.isNull(), "no ratio")
        .when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), "not finite").when(ratio <= 0, "not positive").otherwise("used")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "evidence_counters",
    f"""with {OBS} select axis_key, count(*) as readings, count(distinct model) as raters, count(distinct (i, j)) as pairs, round(avg(abs(m)), 6) as mean_size,
        count_if(m > 0) as up, count_if(m < 0) as down, count_if(m = 0) as level from obs group by 1""",
)
def evidence_counters(spark, sf):
    m = F.col("m")
    return obs(spark, sf).groupBy("axis_key").agg(
        F.count(F.lit(1)).alias("readings"), F.count_distinct("model").alias("raters"), F.count_distinct("i", "j").alias("pairs"), F.round(F.avg(F.abs(m)), 6).alias("mean_size"),
        F.count_if(m > 0).alias("up"), F.count_if(m < 0).alias("down"), F.count_if(m == 0).alias("level"),
    )
