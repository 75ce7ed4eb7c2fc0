"""Queries of the solver, with closed forms and identities where SQL can check them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pairloom.operators import evidence as E
from pairloom.plans import solver as S
from pairloom.plans.registry import EDGES, OBS, query, table

r6 = lambda c: F.round(c, 6) + F.lit(0.0)
RUN = ["run", "axis_key"]


def run_edges(spark, sf):
    return E.fuse(E.observations(table(spark, sf, "comparisons")), *RUN)


RUN_EDGES = OBS + ", edges as (select run, axis_key, i, j, sum(m) / count(*) as mu, count(*)::double as lam from obs group by 1, 2, 3, 4)"


@query("solve_ranking")
def solve_ranking(spark, sf):
    """Every run's axis solved and ranked, with variances."""
    nodes = S.nodes_of(S.solve_edges(run_edges(spark, sf), RUN, kinds=("node",)), RUN)
    from pyspark.sql import Window

    w = Window.partitionBy(*RUN).orderBy(F.desc("score"), "entity_id")
    return nodes.select(*RUN, "entity_id", r6("score").alias("score"), r6("variance").alias("variance"), "component", F.row_number().over(w).alias("rank"))


@query(
    "solve_normal_equations",
    f"""with {RUN_EDGES}, e as (select run, axis_key, i as entity_id, lam * mu as pull from edges union all select run, axis_key, j, -lam * mu from edges)
    select run, axis_key, entity_id, round(sum(pull), 4) + 0.0 as pull from e group by 1, 2, 3""",
)
def solve_normal_equations(spark, sf):
    """What the least-squares scores say each entity was pulled by: at the solution, what its edges' measurements pulled."""
    edges = run_edges(spark, sf)
    s = S.nodes_of(S.solve_edges(edges, RUN, S.SolverConfig(huber_k=1e12), kinds=("node",)), RUN)
    side = lambda x: s.select(*RUN, F.col("entity_id").alias(x), F.col("score").alias(f"s_{x}"))
    f = edges.join(side("i"), [*RUN, "i"]).join(side("j"), [*RUN, "j"]).withColumn("pull", F.col("lam") * (F.col("s_i") - F.col("s_j")))
    both = f.select(*RUN, F.explode(F.array(F.struct(F.col("i").alias("entity_id"), F.col("pull").alias("p")), F.struct(F.col("j").alias("entity_id"), (-F.col("pull")).alias("p")))).alias("x"))
    return both.groupBy(*RUN, F.col("x.entity_id").alias("entity_id")).agg((F.round(F.sum("x.p"), 4) + F.lit(0.0)).alias("pull"))


@query("solve_diagnostics")
def solve_diagnostics(spark, sf):
    runs = S.runs_of(S.solve_edges(run_edges(spark, sf), RUN, kinds=("run",)), RUN)
    return runs.select(*RUN, "status", "entities", "edges", "components", "triangles", "cycle_dim", "harmonic_dim", *[r6(c).alias(c) for c in ("hcr", "curl", "harmonic", "pcr", "foster", "fiedler")], "bridges", "flagged", "degraded")


@query(
    "solve_foster_identity",
    f"""with recursive {RUN_EDGES},
    both_ways as (select run, axis_key, i as x, j as y from edges union all select run, axis_key, j, i from edges),
    reach(run, axis_key, x, c) as (
        select distinct run, axis_key, x, x from both_ways
        union select b.run, b.axis_key, b.y, r.c from reach r join both_ways b on b.run = r.run and b.axis_key = r.axis_key and b.x = r.x where r.c < b.y),
    label as (select run, axis_key, x, min(c) as c from reach group by 1, 2, 3),
    n as (select run, axis_key, count(*) as entities, count(distinct c) as components from label group by 1, 2),
    e as (select run, axis_key, count(*) as edges from edges group by 1, 2)
    select run, axis_key, entities::int as entities, edges::int as edges, components::int as components, (edges - entities + components)::int as cycle_dim, round((entities - components)::double, 4) as foster
    from n join e using (run, axis_key)""",
)
def solve_foster_identity(spark, sf):
    """The leverages of a group add up to entities minus components."""
    runs = S.runs_of(S.solve_edges(run_edges(spark, sf), RUN, S.SolverConfig(huber_k=1e12), kinds=("run",)), RUN)
    return runs.select(*RUN, "entities", "edges", "components", "cycle_dim", F.round("foster", 4).alias("foster"))


@query(
    "solve_triangles",
    f"""with {RUN_EDGES} select e.run, e.axis_key, count(*)::int as triangles from edges e
    join edges f on f.run = e.run and f.axis_key = e.axis_key and f.i = e.j join edges g on g.run = e.run and g.axis_key = e.axis_key and g.i = e.i and g.j = f.j group by 1, 2""",
)
def solve_triangles(spark, sf):
    """Triangles of each group by three-way equi-joins of the edges, in the JVM."""
    e = run_edges(spark, sf).select(*RUN, "i", "j")
    f = e.select(*RUN, F.col("i").alias("j"), F.col("j").alias("k"))
    g = e.select(*RUN, "i", F.col("j").alias("k"))
    found = e.join(f, [*RUN, "j"]).join(g, [*RUN, "i", "k"])
    return found.groupBy(*RUN).agg(F.count(F.lit(1)).cast("int").alias("triangles"))


@query(
    "solve_single_edges",
    f"""with {RUN_EDGES}, alone as (select run, axis_key from edges group by 1, 2 having count(*) = 1)
    select run, axis_key, i as entity_id, round(greatest(mu, 0), 6) + 0.0 as score from edges join alone using (run, axis_key)
    union all select run, axis_key, j, round(greatest(-mu, 0), 6) + 0.0 from edges join alone using (run, axis_key)""",
)
def solve_single_edges(spark, sf):
    """Two entities: the solution is the weighted mean."""
    edges = run_edges(spark, sf)
    alone = edges.groupBy(*RUN).count().filter("count = 1").drop("count")
    nodes = S.nodes_of(S.solve_edges(edges.join(alone, RUN), RUN, kinds=("node",)), RUN)
    return nodes.select(*RUN, "entity_id", r6("score").alias("score"))


_CHAIN = """c as (select r_name, n_name as entity, row_number() over (partition by r_name order by n_nationkey) as pos, sum(o_totalprice) as v
      from nation join region on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by r_name, n_name, n_nationkey)"""


@query(
    "solve_chain",
    f"""with {_CHAIN}, s as (select r_name, entity, pos, ln(v) as x from c)
    select r_name, entity as entity_id, round(x - min(x) over (partition by r_name), 5) + 0.0 as score from s""",
)
def solve_chain(spark, sf):
    """Neighbours in a chain of nations compared by revenue: a tree, so the scores are the running sums."""
    nation, region, customer, orders = (table(spark, sf, t) for t in ("nation", "region", "customer", "orders"))
    from pyspark.sql import Window

    v = nation.join(region, nation.n_regionkey == region.r_regionkey).join(customer, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"))
    v = v.groupBy("r_name", "n_name", "n_nationkey").agg(F.log(F.sum("o_totalprice")).alias("x"))
    w = Window.partitionBy("r_name").orderBy("n_nationkey")
    pairs = v.select("r_name", F.col("n_name").alias("a"), F.lead("n_name").over(w).alias("b"), (F.col("x") - F.lead("x").over(w)).alias("m")).filter("b is not null")
    up = F.col("a") < F.col("b")
    edges = pairs.select("r_name", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.when(up, F.col("m")).otherwise(-F.col("m")).alias("mu"), F.lit(1.0).alias("lam"))
    return S.nodes_of(S.solve_edges(edges, ["r_name"], kinds=("node",)), ["r_name"]).select("r_name", "entity_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query(
    "solve_complete_graph",
    f"""with {_CHAIN}, p as (select a.r_name, a.entity as x, b.entity as y, ln(a.v / b.v) + ((a.pos * 7919 + b.pos * 104729) % 1000) / 1000.0::double - ((b.pos * 7919 + a.pos * 104729) % 1000) / 1000.0::double as m
        from c a join c b on a.r_name = b.r_name and a.entity <> b.entity),
    t as (select r_name, x, sum(m) / (count(*) + 1) as s from p group by 1, 2)
    select r_name, x as entity_id, round(s - min(s) over (partition by r_name), 5) + 0.0 as score from t""",
)
def solve_complete_graph(spark, sf):
    """All pairs of a region's nations with noise, no Huber: the scores are the row means."""
    nation, region, customer, orders = (table(spark, sf, t) for t in ("nation", "region", "customer", "orders"))
    from pyspark.sql import Window

    v = nation.join(region, nation.n_regionkey == region.r_regionkey).join(customer, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"))
    v = v.groupBy("r_name", "n_name", "n_nationkey").agg(F.sum("o_totalprice").alias("v"))
    v = v.select("r_name", "n_name", "v", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")).alias("pos"))
    a, b = v.select("r_name", F.col("n_name").alias("i"), F.col("v").alias("va"), F.col("pos").alias("pa")), v.select("r_name", F.col("n_name").alias("j"), F.col("v").alias("vb"), F.col("pos").alias("pb"))
    noise = lambda x, y: ((F.col(x) * 7919 + F.col(y) * 104729) % 1000) / 1000.0
    edges = a.join(b, "r_name").filter("i < j").select("r_name", "i", "j", (F.log(F.col("va") / F.col("vb")) + noise("pa", "pb") - noise("pb", "pa")).alias("mu"), F.lit(1.0).alias("lam"))
    solved = S.solve_edges(edges, ["r_name"], S.SolverConfig(huber_k=1e12), kinds=("node",))
    return S.nodes_of(solved, ["r_name"]).select("r_name", "entity_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query(
    "solve_large_star",
    """with v as (select p_partkey, ln(p_retailprice) as x from part)
    select lpad(p_partkey::varchar, 12, '0') as entity_id, round(x - min(x) over (), 5) + 0.0 as score from v""",
)
def solve_large_star(spark, sf):
    """One group of any size: every part compared with the first by price; a tree, so scores are the log prices."""
    part = table(spark, sf, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("e"), F.log("p_retailprice").alias("x"), "p_partkey")
    hub = part.agg(F.min("p_partkey").alias("k"))
    first = part.join(F.broadcast(hub), F.col("p_partkey") == F.col("k")).select(F.col("e").alias("i"), F.col("x").alias("xi"))
    edges = part.join(F.broadcast(first), F.col("e") > F.col("i")).select(F.lit("parts").alias("g"), "i", F.col("e").alias("j"), (F.col("xi") - F.col("x")).alias("mu"), F.lit(1.0).alias("lam"))
    nodes = S.nodes_of(S.solve_edges(edges, ["g"], kinds=("node",)), ["g"])
    return nodes.select("entity_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query(
    "degree_test",
    f"""with {EDGES}, e as (select axis_key, i as x from edges union all select axis_key, j from edges), d as (select axis_key, x, count(*) as degree from e group by 1, 2)
    select axis_key, count(*) as entities, count_if(degree >= 2) as two_edges, max(degree) as most from d group by 1""",
)
def degree_test(spark, sf):
    edges = E.fuse(E.observations(table(spark, sf, "comparisons")), "axis_key")
    d = edges.select("axis_key", F.explode(F.array("i", "j")).alias("x")).groupBy("axis_key", "x").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy("axis_key").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("degree") >= 2).alias("two_edges"), F.max("degree").alias("most"))


@query("dl_pooling")
def dl_pooling(spark, sf):
    """DerSimonian-Laird pooling of each run's repeated pairs."""
    pairs = E.pair_moments(E.observations(table(spark, sf, "comparisons")), *RUN)

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        got = S.dersimonian_laird(pdf)
        return pd.DataFrame([] if got is None else [{"run": pdf["run"].iloc[0], "axis_key": pdf["axis_key"].iloc[0], **got}], columns=["run", "axis_key", "sigma_w2", "sigma_b2", "q", "df", "pairs"])

    return pairs.groupBy(*RUN).applyInPandas(pool, "run string, axis_key string, sigma_w2 double, sigma_b2 double, q double, df int, pairs int")


@query("dl_scores")
def dl_scores(spark, sf):
    """Every run solved again with the variance between pairs beside that within."""
    pairs = E.pair_moments(E.observations(table(spark, sf, "comparisons")), *RUN)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return S.pooled_scores(pdf).assign(run=key[0], axis_key=key[1])[["run", "axis_key", "entity_id", "score", "variance"]]

    return pairs.groupBy(*RUN).applyInPandas(solve, "run string, axis_key string, entity_id string, score double, variance double")


@query("gain_calibration")
def gain_calibration(spark, sf):
    """Gain of each template against the axis's most used one, over the runs' pairs of one lens."""
    o = E.observations(table(spark, sf, "comparisons"), "template_slug")
    t = o.groupBy("run", "axis_key", "i", "j", F.col("template_slug").alias("template")).agg(F.avg("m").alias("m"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        reference = pdf["template"].value_counts().sort_index(ascending=False).idxmax()
        gains = S.fit_gains(pdf, reference)
        return pd.DataFrame([{"run": pdf["run"].iloc[0], "axis_key": pdf["axis_key"].iloc[0], "template": k, "gain": g} for k, g in sorted(gains.items())])

    return t.groupBy(*RUN).applyInPandas(fit, "run string, axis_key string, template string, gain double")
