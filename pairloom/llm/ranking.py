"""Global ranking from pairwise comparisons, by iterative Luce spectral ranking.

Comparisons are first reduced to one row for each pair of entities that met,
with what each side won, so repeats cost nothing later.  The pairs of an axis
form a graph, whose ends are written once in blocks of bounded size by the
entities' order.  One path serves every size.  In each round every block
rebuilds its transition rates from the current strengths and solves for the
stationary distribution, with the strengths outside it held; the blocks'
answers are then mixed over the whole axis (Anderson's acceleration: the
combination of the last rounds' answers whose changes cancel best), until no
strength changes.  A block that meets nothing outside is exact after its first
round.  Ends and strengths stay in the blocks' files, which the tasks read
themselves; between two rounds one row for each block goes through Spark, with
its changes' products.  An entity that meets more
others than a block may hold is a hub: its pairs lie with the other entities'
blocks, which send back sums for it, never its rows.

An axis that hasn't come to rest after ``ROUNDS`` rounds is returned with
``converged`` false and warned of.

How much a comparison says: the winner gets ratio / (1 + ratio) of it and the
loser the rest, which is what the model expects of two entities whose strengths
stand in that ratio; a win without a usable ratio counts with the mean share of
the usable ones.  ``use_ratio=False`` counts whole wins instead.

Only entities that are connected by comparisons can be told apart by them:
each connected component has strengths of geometric mean 1, and its number and
size are in the result.

Defined cases: null or equal entities, sides other than A and B, refusals and
errors don't count; a ratio is usable above 1 (one of 1 or less contradicts
the stated win, which then counts as a win without a ratio) and counts as
``MOST_RATIO`` at most, infinite ones too; equal strengths (to 9 digits) share
a rank; a null axis is dropped; with whole wins a pair that only ever one side
won gets ``tie`` added to both sides, since strengths would be infinite otherwise.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.luce import mixture, strengths
from pairloom.operators.ordered import positions
from pairloom.operators.dedup import comparison_identifier, current_rows, delivery_order
from pairloom.operators.ordered import hot_join
from pairloom.session import arrow_fs, collect_garbage, default_parallelism, drop_path, materialise, scratch_dir

#: Pair-ends in one block (about 150 bytes each while it's solved, all numbers), change of log-strength at which an axis is done, and rounds at most.
BLOCK_ENDS, TOLERANCE, ROUNDS = 250_000, 1e-7, 120
#: Earlier rounds that are mixed.
DEPTH = 10
#: What a larger ratio counts as: a share of 1 in all but name.
MOST_RATIO = 1e6


def decided(comparisons: DataFrame) -> DataFrame:
    """(axis_key, a, b, a_won, ratio) of the current rows that name a winner."""
    carry = ["axis_key", "entity_a_id", "entity_b_id", "higher_ranked", "ratio", "refused", "error"]
    now = current_rows(comparisons, comparison_identifier(), delivery_order(), carry)
    good = (F.coalesce("refused", F.lit(0)) == 0) & (F.coalesce("error", F.lit("")) == "") & F.col("higher_ranked").isin("A", "B")
    good = good & F.col("axis_key").isNotNull() & (F.col("entity_a_id") != F.col("entity_b_id"))
    return now.filter(good).select("axis_key", F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), (F.col("higher_ranked") == "A").alias("a_won"), "ratio")


def pair_weights(rows: DataFrame, use_ratio: bool = True, tie: float = 0.0) -> DataFrame:
    """(axis_key, lo, hi, lo_won, hi_won, met): one row for each pair that met."""
    lo_wins = (F.col("a") < F.col("b")) == F.col("a_won")
    ratio = F.when(~F.isnan("ratio") & (F.col("ratio") > 1), F.least("ratio", F.lit(MOST_RATIO)))
    share = ratio / (1 + ratio) if use_ratio else F.lit(1.0)
    sides = rows.select("axis_key", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), lo_wins.alias("lw"), share.alias("share"))
    known = F.col("share").isNotNull()
    pairs = sides.groupBy("axis_key", "lo", "hi").agg(
        F.coalesce(F.sum(F.when(F.col("lw"), F.col("share")).otherwise(1 - F.col("share"))), F.lit(0.0)).alias("lo_share"),
        F.coalesce(F.sum(F.when(known, 1)), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(known, F.col("share"))), F.lit(0.0)).alias("shares"),
        F.coalesce(F.sum(F.when(~known & F.col("lw"), 1)), F.lit(0)).alias("lo_plain"),
        F.coalesce(F.sum(F.when(~known & ~F.col("lw"), 1)), F.lit(0)).alias("hi_plain"),
    )
    pairs = materialise(pairs, "ranking-pairs")
    mean = pairs.agg((F.sum("shares") / F.sum("known")).alias("m")).first()["m"]
    m = F.lit(0.75 if mean is None else float(mean))
    lo_won = F.col("lo_share") + F.col("lo_plain") * m + F.col("hi_plain") * (1 - m)
    hi_won = F.col("known") - F.col("lo_share") + F.col("hi_plain") * m + F.col("lo_plain") * (1 - m)
    met = F.col("known") + F.col("lo_plain") + F.col("hi_plain")
    return pairs.select("axis_key", "lo", "hi", (lo_won + tie).alias("lo_won"), (hi_won + tie).alias("hi_won"), met.alias("met"))


def _blocks(pairs: DataFrame, block_ends: int) -> tuple[DataFrame, DataFrame]:
    """Entities (axis, axis_key, node, no, block, met, met_others), where a hub's block is null; and pair-ends
    (axis, block, no, other, won, lost, other_block), each in the block of its node; a hub's ends are only at the others.

    Entities are numbered along their axis, so that numbers alone go to the solver.
    """
    both = pairs.select("axis_key", F.explode(F.array("lo", "hi")).alias("node"), "met")
    nodes = both.groupBy("axis_key", "node").agg(F.count(F.lit(1)).alias("met_others"), F.sum("met").alias("met"))
    hub = F.col("met_others") > block_ends // 2
    nodes = nodes.withColumns({"hub": hub, "n": F.when(hub, F.lit(1)).otherwise(F.col("met_others"))})
    placed = positions(nodes, ["axis_key"], ["node"])
    block = F.when(~F.col("hub"), F.floor(F.col("before") / block_ends).cast("int"))
    entities = materialise(placed.select(F.xxhash64("axis_key").alias("axis"), "axis_key", "node", F.col("before").alias("no"), block.alias("block"), "met", "met_others"), "ranking-entities")
    # the names are looked up for the pairs, once for each side; both ends of a pair come from its numbers
    side = lambda c: entities.select("axis_key", F.col("node").alias(c), F.col("no").alias(f"{c}_no"), F.col("block").alias(f"{c}_block"))
    numbered = pairs.drop("met").join(side("lo"), ["axis_key", "lo"]).join(side("hi"), ["axis_key", "hi"]).withColumn("axis", F.xxhash64("axis_key"))
    end = lambda a, b: F.struct(F.col(f"{a}_no").alias("no"), F.col(f"{a}_block").alias("block"), F.col(f"{b}_no").alias("other"), F.col(f"{b}_block").alias("other_block"), F.col(f"{a}_won").alias("won"), F.col(f"{b}_won").alias("lost"))
    ends = numbered.select("axis", F.explode(F.array(end("lo", "hi"), end("hi", "lo"))).alias("e")).select("axis", "e.*")
    # two hubs' own pairs need no block's strengths: they are spread over blocks of their own, numbered below 0
    spread = -1 - F.pmod(F.xxhash64("no", "other"), F.lit(default_parallelism(pairs.sparkSession))).cast("int")
    kept = ends.filter(F.col("block").isNotNull() | F.col("other_block").isNull())
    return entities, kept.select("axis", F.coalesce("block", spread).alias("block"), "no", "other", "won", "lost", "other_block")


def _part() -> F.Column:
    """The folder of a block's ends and of its strengths."""
    return F.concat_ws("_", F.col("axis").cast("string"), F.col("block").cast("string"))


#: What a block's round leaves: one row, whose strengths are 8-byte numbers one after the other, in the order of ``nos``.
_STATE = "part string, axis long, block int, nos binary, labels binary, gs binary, fs binary, gram array<double>, change double, moved boolean, exact boolean, hub long, label long, up double, down double, weight double"
#: Strengths that a round starts from, or, of an axis that is done, ends with.
_MIXED = "part string, axis long, block int, nos binary, labels binary, xs binary, done boolean"
_NONE = np.empty(0)


def _solve_block(ends: dict[str, np.ndarray], block: int, held: tuple[np.ndarray, np.ndarray, np.ndarray], tolerance: float, first: bool = True) -> tuple[dict | None, pd.DataFrame | None]:
    """New strengths and components of a block's nodes, and the sums of the hubs they met.

    ``held``: current (no, x, component) of the block's nodes and of all that they meet, by number.
    """
    known, now, label = held
    at = lambda numbers: np.searchsorted(known, numbers)
    # the ends are in the order of their nodes
    new = np.concatenate([[True], ends["no"][1:] != ends["no"][:-1]])
    names, node = ends["no"][new], np.cumsum(new) - 1
    others, to, won, lost = ends["other"], ends["other_block"], ends["won"], ends["lost"]
    inside = to == block
    other = np.searchsorted(names, others[inside])
    out = at(others[~inside])
    was = now[at(names)]
    pi, settled = np.exp(was), True
    if block >= 0:
        # a block that meets strengths which still move need be no more exact than they are
        tolerance = TOLERANCE * 0.1 if inside.all() else tolerance
        # weight of src -> dst is what dst won over src
        pi, settled = strengths(node[inside], other, lost[inside], pi, node[~inside], np.exp(now[out]), lost[~inside], won[~inside], tolerance)
    # a component's label is its least number, spread over the pairs until it rests
    before = label[at(names)]
    least = np.minimum(before, names)
    np.minimum.at(least, node[~inside], label[out])
    while first or (least != before).any():
        new = least.copy()
        np.minimum.at(new, node[inside], least[other])
        if (new == least).all():
            break
        least = new
    nodes = None
    if block >= 0:
        weight = np.bincount(node, won + lost, len(names))
        nodes = {"no": names, "was": was, "x": np.log(pi), "component": least, "weight": weight, "moved": bool((least != before).any()), "exact": bool(settled and inside.all())}
    # for a hub: what it won here, weighed as its strength's numerator, and its denominator
    hubs = np.isnan(to)
    sums = None
    if hubs.any():
        p, total = pi[node[hubs]], pi[node[hubs]] + np.exp(now[at(others[hubs])])
        sums = pd.DataFrame({"no": others[hubs], "component": least[node[hubs]], "up": lost[hubs] * p / total, "down": won[hubs] / total, "weight": won[hubs] + lost[hubs]})
        sums = sums.groupby("no", as_index=False).agg({"component": "min", "up": "sum", "down": "sum", "weight": "sum"})
    return nodes, sums


def _files(at: str, part: str, columns: list[str]) -> pa.Table | None:
    """These columns of a part's files; None where the folder has no such part."""
    fs, root = arrow_fs(at)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    tables = [pq.read_table(f.path, columns=columns, filesystem=fs, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else None


def _row(at: str, part: str, columns: dict[str, type]) -> list[np.ndarray]:
    """The arrays of a part's one row."""
    table = _files(at, part, list(columns))
    return [_NONE.astype(kind) if table is None or table[c][0].as_py() is None else np.frombuffer(table[c][0].as_buffer(), kind) for c, kind in columns.items()]


def _held(mixed_at: str | None, axis: int, block: int, ends: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Current (no, x, component), by number, of a block's nodes and of all that they meet: one part's strengths are read after the other, and only those that are met are kept."""
    met = np.concatenate([ends["no"], ends["other"]])
    of = np.concatenate([np.full(len(ends["no"]), float(max(block, -1))), np.where(np.isnan(ends["other_block"]), -1.0, ends["other_block"])])  # hubs: -1
    if mixed_at is None:  # all equal at first, each its own component
        known = np.unique(met)
        return known, np.zeros(len(known)), known
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    kept = []
    for rows in np.split(order, cuts):
        home = int(of[rows[0]])
        nos, xs, labels = _row(mixed_at, f"{axis}_{'hubs' if home < 0 else home}", {"nos": np.int64, "xs": np.float64, "labels": np.int64})
        use = np.zeros(len(nos), bool)
        use[np.searchsorted(nos, met[rows])] = True
        kept.append((nos[use], xs[use], labels[use]))
    known, now, label = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(known, kind="stable")
    return known[order], now[order], label[order]


def _answer(state_at: str | None, part: str, nodes: dict) -> dict:
    """A part's row: its answers and changes of the last rounds, and the changes' products, which are summed over the axis."""
    g = nodes["x"]
    gs, fs = _row(state_at, part, {"gs": np.float64, "fs": np.float64}) if state_at is not None else (_NONE, _NONE)
    gs = np.vstack([gs.reshape(-1, len(g))[1 - DEPTH :], g])
    fs = np.vstack([fs.reshape(-1, len(g))[1 - DEPTH :], g - nodes["was"]])
    return {
        "part": part, "nos": nodes["no"].astype(np.int64).tobytes(), "labels": nodes["component"].astype(np.int64).tobytes(), "gs": gs.tobytes(), "fs": fs.tobytes(),
        "gram": ((fs * nodes["weight"]) @ fs.T).ravel(), "change": float(np.abs(fs[-1]).max()), "moved": nodes["moved"], "exact": nodes["exact"],
    }


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame([[row.get(c) for c in columns] for row in rows], columns=columns, dtype=object)


def _round_of(ends_at: str, mixed_at: str | None, state_at: str | None, tolerance: float):
    """The function of one round: each block's ends and strengths are read from their files, and it is solved to ``tolerance``."""
    read = ["no", "other", "won", "lost", "other_block"]

    def solve(parts):
        for given in parts:
            for axis, block in zip(given["axis"].tolist(), given["block"].tolist()):
                part = f"{axis}_{block}"
                table = _files(ends_at, part, read)
                ends = {c: table[c].to_numpy() for c in read}
                ends["other_block"] = ends["other_block"].astype(float)
                if (ends["no"][1:] < ends["no"][:-1]).any():  # in several files
                    order = np.argsort(ends["no"], kind="stable")
                    ends = {c: v[order] for c, v in ends.items()}
                nodes, sums = _solve_block(ends, block, _held(mixed_at, axis, block, ends), tolerance, mixed_at is None)
                # a block of hubs' own pairs has no strengths, but goes on to the next round too
                yield _frame([{**(_answer(state_at, part, nodes) if nodes is not None else {"part": part}), "axis": axis, "block": block}], _STATE)
                if sums is not None:
                    yield _frame(sums.rename(columns={"no": "hub", "component": "label"}).assign(part="sums", axis=axis, block=block).to_dict("records"), _STATE)

    return solve


def _hubs_of(mixed_at: str | None, state_at: str | None):
    """The function of an axis's hubs: their new answers from the blocks' sums, what a hub won, weighed by the others' strengths, over what it lost."""

    def answer(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        part, sums = f"{key[0]}_hubs", sums.sort_values("hub")
        nos = sums["hub"].to_numpy(np.int64)
        was, before = (np.zeros(len(nos)), nos) if mixed_at is None else _row(mixed_at, part, {"xs": np.float64, "labels": np.int64})
        label = np.minimum(np.minimum(before, nos), sums["label"].to_numpy(np.int64))
        nodes = {"no": nos, "was": was, "x": np.log(sums["up"].to_numpy(float) / sums["down"].to_numpy(float)), "component": label, "weight": sums["weight"].to_numpy(float), "moved": bool((label != before).any()), "exact": False}
        return _frame([{**_answer(state_at, part, nodes), "axis": int(key[0])}], _STATE)

    return answer


def _weigh(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """For each part of an axis, of which there are few, the weights of the last answers and whether the axis has come to rest; the axis itself is counted at its first part."""
    answers = parts[parts["gram"].notna()]
    gram = np.sum(answers["gram"].tolist(), axis=0)
    change = answers["change"].max()
    rests = bool(answers["exact"].all() or (change < TOLERANCE and not answers["moved"].any()))
    depth = int(np.sqrt(len(gram)))
    mix = mixture(gram.reshape(depth, depth))
    return pd.DataFrame({"part": parts["part"], "axis": key[0], "block": parts["block"], "mix": [mix] * len(parts), "change": change, "done": rests, "first": np.arange(len(parts)) == 0})


def _mixed_of(state_at: str, last: bool):
    """The function that gives each part the strengths that the next round starts from; an axis that is done keeps its newest answers."""

    def mixed(parts):
        for given in parts:
            for part, axis, block, mix, done in zip(given["part"], given["axis"].tolist(), given["block"], given["mix"], given["done"].tolist()):
                nos, labels, gs = _row(state_at, part, {"nos": np.int64, "labels": np.int64, "gs": np.float64})
                gs = gs.reshape(len(mix), -1)
                xs = gs[-1] if done or last else np.asarray(mix) @ gs
                yield _frame([{"part": part, "axis": axis, "block": None if pd.isna(block) else int(block), "nos": nos.tobytes(), "labels": labels.tobytes(), "xs": xs.tobytes(), "done": done}], _MIXED)

    return mixed


def _rows_of(parts):
    """(axis, no, component, log_strength, converged) of parts' strengths."""
    for given in parts:
        for axis, nos, labels, xs, done in zip(given["axis"], given["nos"], given["labels"], given["xs"], given["done"]):
            yield pd.DataFrame({"axis": axis, "no": np.frombuffer(nos, np.int64), "component": np.frombuffer(labels, np.int64), "log_strength": np.frombuffer(xs, np.float64), "converged": done})


def luce_strengths(pairs: DataFrame, block_ends: int = BLOCK_ENDS, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """(axis_key, node, log_strength, component, met, met_others, converged): maximum-likelihood strengths, not yet centred.

    ``report`` takes (round, axes at work, largest change) of each round.
    """
    spark = pairs.sparkSession
    entities, ends = _blocks(pairs, block_ends)
    ends_at = scratch_dir(spark, "ranking-ends")
    ends.withColumn("part", _part()).repartition("part").sortWithinPartitions("part", "no").write.partitionBy("part").parquet(ends_at)
    written = spark.read.schema(ends.schema.add("part", "string")).parquet(ends_at)
    number = lambda at, kind: F.split_part("part", F.lit("_"), F.lit(at)).cast(kind)
    blocks = materialise(written.select("part").distinct().select(number(1, "long").alias("axis"), number(2, "int").alias("block")), "ranking-blocks")
    with_hubs = entities.filter("block is null").limit(1).count() > 0
    going = blocks.count()
    finished: list[DataFrame] = []
    tolerance = 1e-3
    state_at = mixed_at = None
    for turn in range(rounds):
        # as many tasks as there are blocks, however few bytes they get: their work is in their files
        spread = min(going, default_parallelism(spark)) or 1
        path = scratch_dir(spark, "ranking-round")
        blocks.repartition(spread).mapInPandas(_round_of(ends_at, mixed_at, state_at, tolerance), _STATE).write.partitionBy("part").parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if with_hubs:
            sums = state.filter("part = 'sums'").groupBy("axis", "hub").agg(F.min("label").alias("label"), F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("weight").alias("weight"))
            sums.groupBy("axis").applyInPandas(_hubs_of(mixed_at, state_at), _STATE).write.partitionBy("part").mode("append").parquet(path)
            state = spark.read.schema(_STATE).parquet(path)
        last = turn == rounds - 1
        seen = Observation()
        weighed = state.filter("part <> 'sums'").select("part", "axis", "block", "gram", "change", "moved", "exact").groupBy("axis").applyInPandas(_weigh, "part string, axis long, block int, mix array<double>, change double, done boolean, first boolean")
        weighed = weighed.observe(seen, F.count_if("first").alias("axes"), F.count_if(F.col("first") & F.col("done")).alias("done"), F.count_if(~F.col("done")).alias("going"), F.max("change").alias("change"))
        mixed_then, mixed_at = mixed_at, scratch_dir(spark, "ranking-mixed")
        weighed.repartition(spread).mapInPandas(_mixed_of(path, last), _MIXED).write.partitionBy("part").parquet(mixed_at)
        mixed, seen = spark.read.schema(_MIXED).parquet(mixed_at), seen.get
        if report is not None:
            report.append((turn + 1, seen["axes"] - seen["done"], seen["change"]))
        tolerance = max(TOLERANCE * 0.1, 1e-3 * (seen["change"] or 0.0))
        if seen["done"] or last or not seen["axes"]:
            rested = mixed.filter(F.col("done") | F.lit(last)).mapInPandas(_rows_of, "axis long, no long, component long, log_strength double, converged boolean")
            finished.append(materialise(rested, "ranking-strengths"))
        for old in (state_at, mixed_then):
            if old is not None:
                drop_path(spark, old)
        state_at, going = path, seen["going"]
        if seen["done"] == seen["axes"]:
            break
        if last:
            warnings.warn(f"{seen['axes'] - seen['done']} axes haven't come to rest after {rounds} rounds; largest change {seen['change']:g}", stacklevel=2)
            break
        blocks = mixed.filter(~F.col("done") & F.col("block").isNotNull()).select("axis", "block")
        if turn % 12 == 11:
            collect_garbage(spark)  # the shuffles of rounds gone by
    for old in (state_at, mixed_at):
        if old is not None:
            drop_path(spark, old)
    drop_path(spark, ends_at)
    named = finished[0]
    for more in finished[1:]:
        named = named.unionByName(more)
    joined = named.join(entities.drop("block"), ["axis", "no"])
    return joined.select("axis_key", "node", "log_strength", "component", "met", "met_others", "converged")


def rank_entities(found: DataFrame) -> DataFrame:
    """Strengths centred in each component and ranked over the axis, without an axis in one task."""
    # a component is named after its first entity: the one whose number is its label
    sums = found.groupBy("axis_key", "component").agg(F.avg("log_strength").alias("centre"), F.count(F.lit(1)).alias("component_size"), F.min("node").alias("first"))
    sums = materialise(sums, "ranking-components")
    centred = hot_join(found, sums, ["axis_key", "component"]).withColumn("log_strength", F.round(F.col("log_strength") - F.col("centre"), 9))
    centred = materialise(centred.select("axis_key", F.col("node").alias("entity_id"), "log_strength", F.col("first").alias("component"), "component_size", "met", "met_others", "converged"), "ranking-centred")
    counts = centred.groupBy("axis_key", "log_strength").agg(F.count(F.lit(1)).alias("n"))
    placed = materialise(positions(counts, ["axis_key"], ["log_strength"]).select("axis_key", "log_strength", (F.col("total") - F.col("before") - F.col("n") + 1).alias("rank")), "ranking-places")
    ranked = hot_join(centred, placed, ["axis_key", "log_strength"])
    return ranked.select("axis_key", "entity_id", "rank", F.exp("log_strength").alias("strength"), "log_strength", F.col("met").alias("comparisons"), F.col("met_others").alias("opponents"), "component", "component_size", "converged")


def expected_wins(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(axis_key, entity_id, expected): what each entity should have won by the strengths; at the maximum of the likelihood, what it won."""
    strength = found.select("axis_key", F.col("node").alias("lo"), F.col("log_strength").alias("x"))
    both = pairs.join(strength, ["axis_key", "lo"]).join(strength.select("axis_key", F.col("lo").alias("hi"), F.col("x").alias("y")), ["axis_key", "hi"])
    lo = (F.col("lo_won") + F.col("hi_won")) / (1 + F.exp(F.col("y") - F.col("x")))
    sides = both.select("axis_key", F.explode(F.array(F.struct(F.col("lo").alias("entity_id"), lo.alias("e")), F.struct(F.col("hi").alias("entity_id"), (F.col("lo_won") + F.col("hi_won") - lo).alias("e")))).alias("s"))
    return sides.groupBy("axis_key", "s.entity_id").agg(F.sum("s.e").alias("expected"))


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    pairs = pair_weights(decided(spark.read.parquet(f"{sf}/comparisons.parquet")))
    return rank_entities(luce_strengths(pairs))


def p2_expected_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The wins that the strengths make each entity expect: at the maximum likelihood the wins that it had, which SQL can count."""
    pairs = pair_weights(decided(spark.read.parquet(f"{sf}/comparisons.parquet")))
    return expected_wins(pairs, luce_strengths(pairs)).select("axis_key", "entity_id", F.round("expected", 3).alias("wins"))


QUERIES = {"p2_ranking": p2_ranking, "p2_expected_wins": p2_expected_wins}
SQL = {
    "p2_expected_wins": """
        with cur as (
            select * from comparisons
            qualify row_number() over (partition by lower(trim(run_id)), comparison_index, lower(trim(entity_a_hash)), lower(trim(entity_b_hash))
                                       order by observed_at desc, delivery_id) = 1),
        dec as (select axis_key, entity_a_id as a, entity_b_id as b, higher_ranked = 'A' as a_won,
                       case when not isnan(ratio) and ratio > 1 then least(ratio, 1e6) / (1 + least(ratio, 1e6)) end as share
                from cur where coalesce(refused, 0) = 0 and coalesce(error, '') = '' and higher_ranked in ('A', 'B') and entity_a_id <> entity_b_id and axis_key is not null),
        m as (select coalesce(avg(share), 0.75) as m from dec),
        w as (select axis_key, a, b, case when a_won then coalesce(share, m) else 1 - coalesce(share, m) end as a_wins from dec, m)
        select axis_key, entity_id, round(sum(wins), 3) as wins
        from (select axis_key, a as entity_id, a_wins as wins from w union all select axis_key, b, 1 - a_wins from w) group by 1, 2"""
}
