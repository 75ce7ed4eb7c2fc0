"""Consensus from several annotators' votes, by a community confusion model.

A vote is on one of two sides, so an annotator's confusion matrix is written
for the sides of the row: how often they vote A where A truly ranks higher, and
where B does.  An annotator who always votes A, one who votes at random and one
who votes the wrong way round differ there, whichever of the two entities is
shown as A.  What is voted is a side with a band of confidence, so the matrices
learn what each annotator's confidence is worth: nothing, if they are as often
wrong when they are sure.  Annotators belong to communities that share a
confusion matrix; it is the prior of its members, so an annotator with few votes
is taken for a typical member and one with many speaks for themself.

Variational updates, each over all votes: the items' truths from the matrices,
the annotators' matrices and communities from the expected counts.  Votes are
first counted by (item, annotator, orientation, side, band).  Items and
annotators stay tables, of any number; a round joins the annotators' weights to
the votes and the items' truths back to them, and only the communities'
matrices, of a fixed size, come to the driver.

Defined cases: votes of null items, sides other than A and B, refusals and
errors don't count; a model that votes twice on a pair counts twice; null and
impossible confidences are a band of their own, percent values are divided by
100; an item on which the evidence is even goes to the smaller hash; no vote
gives no row; annotators that haven't come to rest after ``ROUNDS`` rounds are
warned of.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.llm.topics import _digamma
from pairloom.operators.dedup import comparison_identifier, current_rows, delivery_order
from pairloom.operators.ordered import hot_join
from pairloom.session import collect_garbage, drop_path, materialise, scratch_dir

#: Communities, strength of a community over its members (in votes), rounds at most and the change of a vote's weight at which they end.
COMMUNITIES, STRENGTH, ROUNDS, TOLERANCE = 5, 20.0, 100, 1e-3
#: Members that the starting matrix of a community counts as.
COMMUNITY_PRIOR = 0.5
#: Confidences at which the second and third band begin; the band before them is that of unusable ones.
BANDS = (0.6, 0.8)
#: Kinds of vote: A or B, with a band.
BAND_COUNT = len(BANDS) + 2
LABELS = 2 * BAND_COUNT


def usable_votes(comparisons: DataFrame, lens: str | None = "panel") -> DataFrame:
    """(axis_key, lo, hi, model, a_is_lo, vote_a, confidence) of the current rows that hold a vote."""
    rows = comparisons if lens is None else comparisons.filter(clean_key("lens") == lens)
    slim = rows.withColumns({"_a": clean_key("entity_a_hash"), "_b": clean_key("entity_b_hash")})
    carry = ["axis_key", "_a", "_b", "model", "refused", "error", "higher_ranked", "confidence"]
    now = current_rows(slim, comparison_identifier(), delivery_order(), carry)
    good = (F.coalesce("refused", F.lit(0)) == 0) & (F.coalesce("error", F.lit("")) == "") & F.col("higher_ranked").isin("A", "B")
    good = good & F.col("axis_key").isNotNull() & F.col("model").isNotNull() & (F.col("_a") != F.col("_b"))
    return now.filter(good).select(
        "axis_key",
        F.least("_a", "_b").alias("lo"),
        F.greatest("_a", "_b").alias("hi"),
        "model",
        (F.col("_a") < F.col("_b")).alias("a_is_lo"),
        (F.col("higher_ranked") == "A").alias("vote_a"),
        "confidence",
    )


def vote_weight(confidence: Column) -> Column:
    """Confidence as a share: percent values are divided by 100, anything else outside 0..1 is null."""
    share = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    return F.when((share >= 0) & (share <= 1) & ~F.isnan(share), share)


@dataclass
class Consensus:
    items: DataFrame  # axis_key, lo, hi, log_odds (of lo over hi), votes, votes_lo
    annotators: DataFrame  # model, votes, accuracy, says_a_if_a, says_a_if_b, community, reliability
    rounds: int
    converged: bool


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: the recurrence up to 8, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift - np.log(x), shift)
        x = np.where(small, x + 1, x)
    inv = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - inv * (1 / 360 - inv / 1260)) / x


def _start_communities() -> np.ndarray:
    """Good, fair, for A, for B and the wrong way round: how often A is voted where A, or B, is true, in any band alike."""
    says_a = np.array([[0.9, 0.1], [0.7, 0.3], [0.9, 0.85], [0.15, 0.1], [0.3, 0.7]])[:COMMUNITIES]
    sides = np.stack([says_a, 1 - says_a], axis=2)
    return np.repeat(sides / BAND_COUNT, BAND_COUNT, axis=2)


def _update(counts: np.ndarray, communities: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Annotators' expected logs of their matrices, memberships and mean matrices.

    ``counts``: annotators x true side x label; ``communities``: community x true side x label.  A membership is by
    the likelihood of the counts with the annotator's own matrix integrated out.
    """
    shape = STRENGTH * communities
    both = counts[:, None] + shape[None]
    score = (_lgamma(both) - _lgamma(shape)[None]).sum(3) - _lgamma(both.sum(3)) + _lgamma(shape.sum(2))[None]
    score = score.sum(2) + np.log(sizes + 1.0)
    member = np.exp(score - score.max(1, keepdims=True))
    member /= member.sum(1, keepdims=True)
    post = counts + np.einsum("mc,cts->mts", member, shape)
    total = post.sum(2, keepdims=True)
    return _digamma(post) - _digamma(total), member, post / total


def _band() -> Column:
    share = vote_weight(F.col("confidence"))
    band = F.lit(1)
    for k, least in enumerate(BANDS):
        band = F.when(share >= least, F.lit(k + 2)).otherwise(band)
    return F.when(share.isNull(), F.lit(0)).otherwise(band)


def consensus(votes: DataFrame) -> Consensus:
    """Of votes (axis_key, lo, hi, model, a_is_lo, vote_a and, if there is one, confidence)."""
    spark = votes.sparkSession
    if "confidence" not in votes.columns:
        votes = votes.withColumn("confidence", F.lit(None).cast("double"))
    item = ["axis_key", "lo", "hi"]
    label = F.when(F.col("vote_a"), F.lit(0)).otherwise(F.lit(BAND_COUNT)) + _band()
    counted = votes.groupBy(*item, "model", "a_is_lo", label.alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = materialise(counted, "votes-counted")
    numbered = lambda keys, name: materialise(counted.select(*keys).distinct().select(*keys, F.monotonically_increasing_id().alias(name)), f"votes-{name}")
    items, models = numbered(item, "item"), numbered(["model"], "annotator")
    match = [counted[c] == items[c] for c in item]
    slim = hot_join(counted.join(items, match).select("item", "model", "a_is_lo", "label", "n"), models, ["model"]).select("item", "annotator", "a_is_lo", "label", "n")
    slim = materialise(slim, "votes-numbered")

    def truths(weights: DataFrame | None) -> DataFrame:
        """(item, odds): log-odds for lo; the first time by the votes' majority."""
        for_a = F.when(F.col("label") < BAND_COUNT, 0.7).otherwise(-0.7) if weights is None else F.col("w")[F.col("label")]
        rows = slim if weights is None else hot_join(slim, weights, ["annotator"])
        return rows.groupBy("item").agg(F.sum(F.col("n") * F.when(F.col("a_is_lo"), for_a).otherwise(-for_a)).alias("odds"))

    def expected_counts(odds: DataFrame) -> DataFrame:
        """(annotator, counts): for A true and B true, the expected votes of each label."""
        both = slim.join(odds, "item")
        a_true = 1 / (1 + F.exp(F.when(F.col("a_is_lo"), -F.col("odds")).otherwise(F.col("odds"))))
        cells = [F.sum(F.when(F.col("label") == k, F.col("n") * p).otherwise(0.0)) for p in (a_true, 1 - a_true) for k in range(LABELS)]
        return both.groupBy("annotator").agg(F.array(*cells).alias("counts"))

    communities, sizes = _start_communities(), np.ones(COMMUNITIES)
    schema = "annotator long, counts array<double>, w array<double>, member array<double>, mean array<double>"
    weights, state, at, rounds, converged = None, None, None, 0, False
    while rounds < ROUNDS and not converged:
        rounds += 1

        def update(parts: Iterator[pd.DataFrame], communities=communities, sizes=sizes) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    counts = np.stack(part["counts"].to_list()).reshape(-1, 2, LABELS)
                    logs, member, mean = _update(counts, communities, sizes)
                    weight = np.where(counts.sum(1) > 0, logs[:, 0] - logs[:, 1], 0.0)  # of the votes that there are
                    yield pd.DataFrame({"annotator": part["annotator"], "counts": part["counts"], "w": list(weight), "member": list(member), "mean": list(mean.reshape(len(part), -1))})

        path = scratch_dir(spark, "votes-annotators")
        expected_counts(truths(weights)).mapInPandas(update, schema).write.parquet(path)
        new = spark.read.schema(schema).parquet(path)
        sums = [F.sum(F.col("member")[c] * F.col("mean")[k]).alias(f"p{c}_{k}") for c in range(COMMUNITIES) for k in range(2 * LABELS)]
        got = new.agg(F.count(F.lit(1)).alias("all"), *[F.sum(F.col("member")[c]).alias(f"s{c}") for c in range(COMMUNITIES)], *sums).first()
        if not got["all"]:
            state, converged = new, True
            break
        if state is not None:
            was = state.select("annotator", F.col("w").alias("was"))
            change = new.join(was, "annotator").agg(F.max(F.array_max(F.zip_with("w", "was", lambda x, y: F.abs(x - y)))).alias("c")).first()["c"]
            converged = change is not None and change < TOLERANCE
            drop_path(spark, at)
        state, at = new, path
        weights = new.select("annotator", "w")
        sizes = np.array([got[f"s{c}"] for c in range(COMMUNITIES)])
        pooled = np.array([got[f"p{c}_{k}"] for c in range(COMMUNITIES) for k in range(2 * LABELS)]).reshape(COMMUNITIES, 2, LABELS) + COMMUNITY_PRIOR * _start_communities()
        communities = pooled / pooled.sum(2, keepdims=True)
        if rounds % 4 == 0:
            collect_garbage(spark)
    if not converged:
        warnings.warn(f"the annotators' weights still moved after {rounds} rounds", stacklevel=2)
    votes_lo = F.sum(F.when((F.col("label") < BAND_COUNT) == F.col("a_is_lo"), F.col("n")).otherwise(0.0)).cast("long")
    sizes_of = slim.groupBy("item").agg(F.sum("n").cast("long").alias("votes"), votes_lo.alias("votes_lo"))
    done = items.join(truths(weights), "item").join(sizes_of, "item").select(*item, F.col("odds").alias("log_odds"), "votes", "votes_lo")

    def conclude(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts = np.stack(part["counts"].to_list()).reshape(-1, 2, LABELS) if len(part) else np.zeros((0, 2, LABELS))
            mean = np.stack(part["mean"].to_list()).reshape(-1, 2, LABELS) if len(part) else counts
            sides = counts.reshape(-1, 2, 2, BAND_COUNT).sum(3)
            says_a = mean.reshape(-1, 2, 2, BAND_COUNT).sum(3)[:, :, 0]
            # reliability: information of a vote about the truth, in bits; a wrong-way voter has it too
            p = mean / 2
            bits = (p * np.log2(p / (p.sum(1, keepdims=True) / 2))).sum((1, 2))
            total = sides.sum((1, 2))
            yield pd.DataFrame({
                "annotator": part["annotator"], "votes": np.round(total).astype(int), "accuracy": (sides[:, 0, 0] + sides[:, 1, 1]) / total,
                "says_a_if_a": says_a[:, 0], "says_a_if_b": says_a[:, 1], "community": [int(np.argmax(m)) for m in part["member"]], "reliability": bits,
            })

    told = state.mapInPandas(conclude, "annotator long, votes long, accuracy double, says_a_if_a double, says_a_if_b double, community int, reliability double")
    return Consensus(done, told.join(models, "annotator").select("model", "votes", "accuracy", "says_a_if_a", "says_a_if_b", "community", "reliability"), rounds, converged)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    got = consensus(usable_votes(spark.read.parquet(f"{sf}/comparisons.parquet")))
    winner = F.when(F.col("log_odds") >= 0, F.col("lo")).otherwise(F.col("hi"))
    return got.items.select("axis_key", F.col("lo").alias("entity_lo_hash"), F.col("hi").alias("entity_hi_hash"), winner.alias("winner_hash"))


def p6_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """For each model: votes, accuracy against the consensus, confusion, community and information of a vote."""
    return consensus(usable_votes(spark.read.parquet(f"{sf}/comparisons.parquet"))).annotators


def p6_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """For each axis Krippendorff's alpha of the votes (nominal, pairs of votes on an item)."""
    votes = usable_votes(spark.read.parquet(f"{sf}/comparisons.parquet"))
    lo = (F.col("a_is_lo") == F.col("vote_a")).cast("int")
    items = votes.groupBy("axis_key", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(lo).alias("k")).filter("n >= 2")
    axes = items.groupBy("axis_key").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("n").alias("votes"),
        F.sum("k").alias("for_lo"),
        F.sum(2 * F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") - 1)).alias("disagreeing"),
    )
    observed = F.col("disagreeing") / F.col("votes")
    by_chance = 2 * F.col("for_lo") * (F.col("votes") - F.col("for_lo")) / (F.col("votes") * (F.col("votes") - 1))
    return axes.select("axis_key", "pairs", "votes", F.round(1 - observed, 6).alias("agreement"), F.round(F.when(by_chance > 0, 1 - observed / by_chance), 6).alias("alpha"))


QUERIES = {"p6_found": p6_found, "p6_reliability": p6_reliability, "p6_agreement": p6_agreement}
SQL = {
    "p6_agreement": """
        with cur as (
            select *, lower(trim(entity_a_hash)) as a, lower(trim(entity_b_hash)) as b from comparisons where lower(trim(lens)) = 'panel'
            qualify row_number() over (partition by lower(trim(run_id)), comparison_index, lower(trim(entity_a_hash)), lower(trim(entity_b_hash))
                                       order by observed_at desc, delivery_id) = 1),
        items as (select axis_key, least(a, b) as lo, greatest(a, b) as hi, count(*) as n, sum(((a < b) = (higher_ranked = 'A'))::int)::bigint as k
                  from cur where refused = 0 and error = '' and higher_ranked in ('A', 'B') and a <> b group by 1, 2, 3),
        axes as (select axis_key, count(*) as pairs, sum(n)::bigint as votes, sum(k)::double as f, sum(2 * k * (n - k) / (n - 1)::double) as d
                 from items where n >= 2 group by 1)
        select axis_key, pairs, votes, round(1 - d / votes, 6) as agreement,
               round(1 - d / votes / (2 * f * (votes - f) / (votes * (votes - 1)::double)), 6) as alpha from axes"""
}
