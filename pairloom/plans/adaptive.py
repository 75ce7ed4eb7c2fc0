"""The adaptive loop: compare, fuse, solve, test the stop, propose, for all groups at once.

Every group has a state (edges, rounds in a row that were certified, comparisons
made, why it stopped) in tables; a round is a handful of jobs over the groups
still at work, whatever their number.  Lineage is cut each round by tables in
the shared folder, and a round's tables go when the next one's are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators import audit as U
from pairloom.operators import planner as L
from pairloom.operators.ranking import beta_for, ranked
from pairloom.plans import solver
from pairloom.session import materialise

#: Why a group stopped.
CERTIFIED, BUDGET, EXHAUSTED, REFUSED, ROUNDS_OUT = "certified", "budget", "no proposals", "all refused", "rounds"


def _nodes(entities: DataFrame, edges: DataFrame, keys: list[str], config: solver.SolverConfig) -> DataFrame:
    """Score, variance, component of every entity; one without an edge is at 0 with variance 1 and no component."""
    solved = solver.nodes_of(solver.solve_edges(edges, keys, config, kinds=("node",)), keys)
    x = entities.join(solved, [*keys, "entity_id"], "left")
    return x.select(*keys, "entity_id", F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce("variance", F.lit(1.0)).alias("v"), "component")


def rank_adaptively(
    entities: DataFrame,
    judge: Callable[[DataFrame, int], DataFrame],
    keys: list[str],
    k: int,
    batch: int = 32,
    budget: int = 400,
    rounds: int = 20,
    tolerated_error: float = 0.05,
    inflate: float = 1.25,
    consecutive: int = 2,
    repeats: int = 4,
    config: solver.SolverConfig = solver.SolverConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, entity_id, s, v, component) and stops (keys, rounds, comparisons, reason).

    ``judge(pairs, round)`` gives ``m`` and ``refused`` to pairs (keys, i, j), and a
    precision ``lam`` if it has one (1 otherwise).  A pair
    that was refused isn't asked again, one is read ``repeats`` times at most, and a
    group never makes more than ``budget`` comparisons.
    """
    spark = entities.sparkSession
    entities = materialise(entities.select(*keys, "entity_id").distinct(), "adaptive-entities")
    types = ", ".join(f"`{c}` {entities.schema[c].dataType.simpleString()}" for c in keys)
    edges = spark.createDataFrame([], f"{types}, i string, j string, wm double, lam double, readings long, refused long")
    groups = materialise(entities.select(*keys).distinct().withColumns({"comparisons": F.lit(0).cast("long"), "streak": F.lit(0), "rounds": F.lit(0), "reason": F.lit(None).cast("string")}), "adaptive-groups")
    beta = beta_for(tolerated_error) * max(inflate, 1.0)
    for turn in range(1, rounds + 1):
        going = groups.filter("reason is null").select(*keys, F.col("comparisons").alias("made"))
        if going.limit(1).count() == 0:
            break
        fused = edges.filter("lam > 0").select(*keys, "i", "j", (F.col("wm") / F.col("lam")).alias("mu"), "lam")
        nodes = materialise(_nodes(entities.join(going.select(*keys), keys), fused.join(going.select(*keys), keys), keys, config), "adaptive-nodes")
        plain = nodes.select(*keys, "entity_id", "s", "v")
        worn = edges.filter((F.col("readings") >= repeats) | (F.col("refused") > 0)).select(*keys, "i", "j")
        # the first round has no scores to tell by: a ring through all entities
        if turn == 1:
            w = Window.partitionBy(*keys).orderBy("entity_id")
            ring = nodes.withColumns({"_next": F.lead("entity_id").over(w), "_first": F.first("entity_id").over(Window.partitionBy(*keys).orderBy("entity_id")), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
            other = F.coalesce("_next", F.when(F.col("_n") > 2, F.col("_first")))
            wanted = ring.filter(other.isNotNull()).select(*keys, F.least("entity_id", other).alias("i"), F.greatest("entity_id", other).alias("j"), F.lit(0).alias("place"))
        else:
            wanted = L.proposals(plain, fused, keys, k, batch).select(*keys, "i", "j", "place")
        wanted = wanted.join(worn, [*keys, "i", "j"], "left_anti").join(going, keys)
        order = Window.partitionBy(*keys).orderBy("place", "i", "j")
        wanted = wanted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") + F.col("made") <= budget)
        answered = judge(wanted.select(*keys, "i", "j"), turn)
        lam = F.col("lam") if "lam" in answered.columns else F.lit(1.0)
        read = materialise(answered.select(*keys, "i", "j", "m", "refused", lam.alias("lam")), "adaptive-readings")
        weight = F.when(F.col("refused") | F.col("m").isNull(), 0.0).otherwise(F.col("lam"))
        new = read.select(*keys, "i", "j", (weight * F.coalesce("m", F.lit(0.0))).alias("wm"), weight.alias("lam"), F.lit(1).cast("long").alias("readings"), F.col("refused").cast("long").alias("refused"))
        edges = materialise(edges.unionByName(new).groupBy(*keys, "i", "j").agg(F.sum("wm").alias("wm"), F.sum("lam").alias("lam"), F.sum("readings").alias("readings"), F.sum("refused").alias("refused")), "adaptive-edges")
        fused = edges.filter("lam > 0").select(*keys, "i", "j", (F.col("wm") / F.col("lam")).alias("mu"), "lam")
        nodes = materialise(_nodes(entities.join(going.select(*keys), keys), fused.join(going.select(*keys), keys), keys, config), "adaptive-nodes")
        sd = F.sqrt(F.greatest("v", F.lit(0.0)))
        band = ranked(nodes.select(*keys, "entity_id", "s", "v"), keys).select(*keys, "entity_id", "rank", "s", "v", (F.col("s") - beta * sd).alias("lcb"), (F.col("s") + beta * sd).alias("ucb"))
        degrees = fused.select(*keys, F.explode(F.array("i", "j")).alias("entity_id")).groupBy(*keys, "entity_id").agg(F.count(F.lit(1)).alias("degree"))
        stop = U.certified(band, degrees, nodes.select(*keys, "entity_id", "component"), keys, k, beta).select(*keys, "certified")
        asked = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"), F.count_if("refused").alias("no"))
        g = groups.join(stop, keys, "left").join(asked, keys, "left").fillna(0, ["asked", "no"]).fillna(False, ["certified"])
        streak = F.when(F.col("certified"), F.col("streak") + 1).otherwise(0)
        made = F.col("comparisons") + F.col("asked")
        reason = (
            F.when(streak >= max(consecutive, 1), CERTIFIED)
            .when(F.col("asked") == 0, F.when(F.col("comparisons") >= budget, BUDGET).otherwise(EXHAUSTED))
            .when(F.col("no") == F.col("asked"), REFUSED)
            .when(made >= budget, BUDGET)
            .when(F.lit(turn == rounds), ROUNDS_OUT)
        )
        at_work = F.col("reason").isNull()
        keep = lambda new, old: F.when(at_work, new).otherwise(F.col(old))
        groups = materialise(g.select(*keys, keep(made, "comparisons").alias("comparisons"), keep(streak, "streak").alias("streak"), keep(F.lit(turn), "rounds").alias("rounds"), F.coalesce("reason", reason).alias("reason")), "adaptive-groups")
    fused = edges.filter("lam > 0").select(*keys, "i", "j", (F.col("wm") / F.col("lam")).alias("mu"), "lam")
    return _nodes(entities, fused, keys, config), groups.select(*keys, "rounds", "comparisons", "reason")
