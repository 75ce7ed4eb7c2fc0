"""Answers read from the tokens of a reply: cleaned, merged and weighed by their log-probabilities.

Rows are (keys, place, token, logprob): the alternatives at one position, in
the order in which the provider lists them.

Defined cases: a token without a letter or digit names nothing; a null or
infinite log-probability has no mass; equal cleaned tokens count once, the one
listed first; masses are never scaled up to 1: what isn't seen stays unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.pmf import LADDER, atom_value

#: Provider's rounding: a visible mass up to this much above 1 counts as 1.
SLOP = 1e-4


def clean_token(token: Column) -> Column:
    """Without blanks and punctuation at both ends, in capitals; null if nothing is left."""
    bare = F.upper(F.regexp_replace(token, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.when(bare != "", bare)


def side_of(token: Column) -> Column:
    """'A' or 'B' if the token's ASCII letters are that alone."""
    letters = F.upper(F.regexp_replace(token, "[^A-Za-z]", ""))
    return F.when(letters.isin("A", "B"), letters)


def bucket_of(token: Column, before: Column) -> Column:
    """Number of the rung that the digits name; a lone digit after a lone '1' is read with it."""
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
    own, last = digits(token), digits(F.coalesce(before, F.lit("")))
    joined = F.when((last == "1") & (F.length(own) == 1), F.concat(last, own)).otherwise(own)
    n = F.when(joined != "", joined.cast("int"))
    return F.when((n >= 1) & (n <= len(LADDER)), n)


def letter_of(rung: Column) -> Column:
    """Letter of a rung: A for the first."""
    return F.chr(F.lit(ord("A") - 1) + rung)


def rung_of(letter: Column) -> Column:
    n = F.ascii(F.upper(letter)) - F.lit(ord("A") - 1)
    return F.when((F.length(letter) == 1) & (n >= 1) & (n <= len(LADDER)), n)


def merged(alternatives: DataFrame, keys: list[str], answer: Column) -> DataFrame:
    """(keys, answer, p): each answer's first listed alternative."""
    named = alternatives.withColumn("answer", answer).filter(F.col("answer").isNotNull())
    first = named.groupBy(*keys, "answer").agg(F.min_by("logprob", "place").alias("logprob"))
    return first.select(*keys, "answer", F.coalesce(F.exp("logprob"), F.lit(0.0)).alias("p"))


def strongest(alternatives: DataFrame, keys: list[str], answer: Column) -> DataFrame:
    """(keys, answer, p): each answer's likeliest alternative, and per key the mass that names none of them as answer null."""
    named = alternatives.withColumn("answer", answer)
    best = named.filter(F.col("answer").isNotNull()).groupBy(*keys, "answer").agg(F.max(F.exp("logprob")).alias("p"))
    rest = named.select(*keys).distinct().join(best.groupBy(*keys).agg(F.sum("p").alias("seen")), keys, "left")
    rest = rest.select(*keys, F.lit(None).cast("string").alias("answer"), F.greatest(1 - F.coalesce("seen", F.lit(0.0)), F.lit(0.0)).alias("p"))
    return best.unionByName(rest)


def evidence(alternatives: DataFrame, keys: list[str], atom: Column) -> DataFrame:
    """(keys, shown, off_alphabet, abstain, mean, second): masses of the answers' alphabet, beside it and unseen.

    ``atom``: signed rung that an alternative names, or null.  The moments are those
    of the answers shown, scaled to their mass; parity counts as 0.  A visible mass
    above 1 by more than the provider's rounding gives nulls.
    """
    p = F.coalesce(F.exp("logprob"), F.lit(0.0))
    x = alternatives.withColumns({"_p": p, "_atom": atom})
    value = atom_value(F.col("_atom"))
    g = x.groupBy(*keys).agg(
        F.sum(F.when(F.col("_atom").isNotNull(), F.col("_p")).otherwise(0.0)).alias("_shown"),
        F.sum("_p").alias("_visible"),
        F.sum(F.when(F.col("_atom").isNotNull(), F.col("_p") * value)).alias("_m1"),
        F.sum(F.when(F.col("_atom").isNotNull(), F.col("_p") * value * value)).alias("_m2"),
    )
    visible = F.when(F.col("_visible") <= 1, F.col("_visible")).when(F.col("_visible") <= 1 + SLOP, 1.0)
    shown = F.least(F.col("_shown"), visible)
    ok = F.col("_shown") > 0
    return g.select(*keys, F.when(visible.isNotNull(), shown).alias("shown"), (visible - shown).alias("off_alphabet"), (1 - visible).alias("abstain"), F.when(ok, F.col("_m1") / F.col("_shown")).alias("mean"), F.when(ok, F.col("_m2") / F.col("_shown")).alias("second"))


def posterior(sides: DataFrame, rungs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entropy, top, near, mean): the product of a side's and a rung's distribution.

    ``sides``: (keys, answer, p) with the chosen side in ``chosen_side``; ``rungs``: (keys, rung, p)
    with ``chosen_rung``.  Mass that names no answer stays whole: it is one outcome of the entropy.
    ``near``: the chosen side within one rung of the chosen one.
    """
    joint = sides.join(rungs.withColumnRenamed("p", "q"), keys).withColumn("j", F.col("p") * F.col("q"))
    same = F.col("answer") == F.col("chosen_side")
    sign = F.when(F.col("answer") == "A", 1.0).otherwise(-1.0)
    term = F.when(F.col("j") > 0, -F.col("j") * F.log("j")).otherwise(0.0)
    g = joint.groupBy(*keys).agg(
        F.sum("j").alias("_mass"),
        F.sum(term).alias("_entropy"),
        F.sum(F.when(same & (F.col("rung") == F.col("chosen_rung")), F.col("j")).otherwise(0.0)).alias("top"),
        F.sum(F.when(same & (F.abs(F.col("rung") - F.col("chosen_rung")) <= 1), F.col("j")).otherwise(0.0)).alias("near"),
        F.sum(F.col("j") * sign * atom_value(F.col("rung"))).alias("_mean"),
    )
    rest = F.greatest(1 - F.col("_mass"), F.lit(0.0))
    return g.select(*keys, (F.col("_entropy") + F.when(rest > 1e-12, -rest * F.log(rest)).otherwise(0.0)).alias("entropy"), "top", "near", F.when(F.col("_mass") > 0, F.col("_mean") / F.col("_mass")).alias("mean"))


def numbered_alternatives(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``place``: the provider's order of each position's alternatives."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
