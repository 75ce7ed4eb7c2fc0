"""Quality of a ranking against known scores, per solved group.

``rows``: keys, entity_id, ``s`` predicted, ``t`` true.  Pair sums are equi-joins
within a group, which the solver bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """With 1-based places by prediction (ps) and truth (pt), and the truth's rank with ties (rt)."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({
        "ps": F.row_number().over(w.orderBy(F.desc("s"), "entity_id")),
        "pt": F.row_number().over(w.orderBy(F.desc("t"), "entity_id")),
        "rt": F.rank().over(w.orderBy(F.desc("t"))),
        "n": F.count(F.lit(1)).over(w),
    })


def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs with the signs of both differences (ds, dt)."""
    p = placed(rows, keys)
    side = lambda x: p.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in ("entity_id", "s", "t", "ps", "pt", "rt")])
    both = side("a").join(side("b"), keys).filter("entity_id_a < entity_id_b")
    return both.withColumns({"ds": F.signum(F.col("s_a") - F.col("s_b")), "dt": F.signum(F.col("t_a") - F.col("t_b"))})


def kendall_tau_b(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tau-b; 0 where one side is constant."""
    g = pairs(rows, keys).groupBy(*keys).agg(F.sum(F.col("ds") * F.col("dt")).alias("c"), F.count_if(F.col("ds") != 0).alias("us"), F.count_if(F.col("dt") != 0).alias("ut"))
    return g.select(*keys, F.when((F.col("us") > 0) & (F.col("ut") > 0), F.col("c") / F.sqrt(F.col("us").cast("double") * F.col("ut"))).otherwise(0.0).alias("tau_b"))


def topk(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Precision, recall and Jaccard of the predicted top k; ties at k belong to the true set; and the utility lost."""
    p = placed(rows, keys)
    pred, true = F.col("ps") <= k, F.col("rt") <= k
    both = F.count_if(pred & true)
    lost = F.greatest(F.sum(F.when(true, F.col("t")).otherwise(0.0)) - F.sum(F.when(pred, F.col("t")).otherwise(0.0)), F.lit(0.0))
    return p.groupBy(*keys).agg((both / F.count_if(pred)).alias("precision"), (both / F.count_if(true)).alias("recall"), (both / F.count_if(pred | true)).alias("jaccard"), lost.alias("regret"))


def coverage(rows: DataFrame, keys: list[str], z: float = 1.96) -> DataFrame:
    """Share of the truths within z standard errors of the prediction."""
    inside = F.abs(F.col("t") - F.col("s")) <= z * F.sqrt("v")
    return rows.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"))


def ndcg(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Discounted gain of the first k over the best possible; gain 2^rel - 1 of the truth scaled to 0..1."""
    p = placed(rows, keys)
    w = Window.partitionBy(*keys)
    low, high = F.min("t").over(w), F.max("t").over(w)
    gain = F.pow(F.lit(2.0), F.when(high > low, (F.col("t") - low) / (high - low)).otherwise(1.0)) - 1
    p = p.withColumn("g", gain)
    part = lambda place: F.sum(F.when(F.col(place) <= k, F.col("g") / F.log2(F.col(place) + 1)).otherwise(0.0))
    g = p.groupBy(*keys).agg(part("ps").alias("got"), part("pt").alias("best"))
    return g.select(*keys, F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(1.0).alias("ndcg"))


def curl(rows: DataFrame, keys: list[str], alpha: float | None = None) -> DataFrame:
    """Concordance weighed by the better places of both entities: 1/(a*b), or exp(-alpha * the better of the two)."""
    a, b = F.least("ps_a", "pt_a").cast("double"), F.least("ps_b", "pt_b").cast("double")
    weight: Column = 1 / (a * b) if alpha is None else F.exp(-alpha * F.least(a, b))
    credit = F.when(F.col("ds") == F.col("dt"), 1.0).when((F.col("ds") == 0) | (F.col("dt") == 0), 0.5).otherwise(0.0)
    g = pairs(rows, keys).withColumn("w", weight).groupBy(*keys).agg(F.sum(F.col("w") * credit).alias("c"), F.sum("w").alias("t"))
    return g.select(*keys, (F.col("c") / F.col("t")).alias("curl"))


def rank_reversals(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Displacement of the true top k, each over its true place."""
    moved = F.abs(F.col("ps") - F.col("pt")) / F.col("pt")
    return placed(rows, keys).groupBy(*keys).agg(F.sum(F.when(F.col("pt") <= k, moved).otherwise(0.0)).alias("rank_reversals"))


def topk_discordance(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pairs in opposite order among the union of both top ks."""
    inside = lambda x: (F.col(f"ps_{x}") <= k) | (F.col(f"rt_{x}") <= k)
    return pairs(rows, keys).groupBy(*keys).agg(F.count_if(inside("a") & inside("b") & (F.col("ds") * F.col("dt") < 0)).alias("discordant"))


def auc(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney area, ties one half, by average ranks; null without both labels."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(score))).withColumn("_a", F.avg("_r").over(Window.partitionBy(*keys, score)))
    up = F.count_if(F.col(label) == 1)
    g = r.groupBy(*keys).agg(up.alias("p"), (F.count(F.lit(1)) - up).alias("q"), F.sum(F.when(F.col(label) == 1, F.col("_a"))).alias("r"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def compare_methods(long: DataFrame, keys: list[str], method: str, a: str, b: str, value: str, epsilon: float = 1e-12) -> DataFrame:
    """Wins, losses and ties of method a over b."""
    side = lambda m, n: long.filter(F.col(method) == m).select(*keys, F.col(value).alias(n))
    d = side(a, "x").join(side(b, "y"), keys).withColumn("d", F.col("x") - F.col("y"))
    return d.agg(F.count_if(F.col("d") > epsilon).alias("wins"), F.count_if(F.col("d") < -epsilon).alias("losses"), F.count_if(F.abs("d") <= epsilon).alias("ties"), F.avg("d").alias("mean_delta"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; null for n = 0."""
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(centre - half, F.lit(0.0))), F.when(n > 0, F.least(centre + half, F.lit(1.0)))


def reliability_bins(rows: DataFrame, p: str, y: str, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y): bin r holds the rows from floor(r n / bins) on, by (p, key), by a distributed sort."""
    from pairloom.operators.ordered import positions

    counts = rows.groupBy(F.col(p).alias("_p"), F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("double").alias("_y"))
    r = positions(counts, [], ["_p", "_k"])
    # the last bin that begins at or before the place
    exact = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.floor(k * F.col("total") / bins) <= F.col("before"))
    r = r.withColumn("bin", F.array_max(exact))
    return r.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("_p") * F.col("n")) / F.sum("n")).alias("mean_p"), (F.sum("_y") / F.sum("n")).alias("mean_y"))


def reliability_line(binned: DataFrame) -> DataFrame:
    """Count-weighted least squares of mean_y on mean_p."""
    n, x, y = F.col("n"), F.col("mean_p"), F.col("mean_y")
    g = binned.agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * x * y).alias("sxy"))
    var = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when(var > 1e-15, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / var)
    return g.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))
