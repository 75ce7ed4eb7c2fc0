"""Queries of token answers, ledgers, audits of judges, designs, stops and resampling, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.operators import answers as A
from pairloom.operators import audit as U
from pairloom.operators import designs as D
from pairloom.operators import evidence as E
from pairloom.operators import ledger as G
from pairloom.operators import pmf as P
from pairloom.operators import probes as B
from pairloom.operators import ranking as R
from pairloom.operators import resample as S
from pairloom.operators import synthetic as Y
from pairloom.plans import adaptive, solver
from pairloom.plans.evidence_queries import obs, r6
from pairloom.plans.probe_queries import _CELLS, _LADDER, _LOGS, _ORBIT, _orbit
from pairloom.plans.ranking_queries import ENTITY_AXES, NODES, RANKED, RUN, K, entity_axes, nodes
from pairloom.plans.registry import CUR, OBS, query, table
from pairloom.session import materialise

AM = ["axis_key", "model"]

# --- answers from tokens ---------------------------------------------------
# No reply's tokens are landed: each reading's are written out from its winner, confidence and ratio.

_CONF = "coalesce(case when confidence > 1 then confidence / 100 when confidence >= 0 then confidence end, 0.5)"
_TOKENS = f"""{OBS}, c as (select *, least(greatest({_CONF}, 0.0::double), 1.0::double) as c, case when higher_ranked = 'A' then 'B' else 'A' end as other from obs),
    t as (select axis_key, model, delivery_id, 1 as place, ' ' || higher_ranked as token, ln(0.5 + 0.3 * c) as logprob, higher_ranked as win from c
          union all select axis_key, model, delivery_id, 2, '**' || lower(higher_ranked) || '**', ln(0.05::double), higher_ranked from c
          union all select axis_key, model, delivery_id, 3, other || '.', ln(0.1 - 0.05 * c), higher_ranked from c
          union all select axis_key, model, delivery_id, 4, '?', ln(0.02::double), higher_ranked from c)"""


def _confidence():
    share = F.when(F.col("confidence") > 1, F.col("confidence") / 100).when(F.col("confidence") >= 0, F.col("confidence"))
    return F.least(F.greatest(F.coalesce(share, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def _tokens(spark, sf):
    o = obs(spark, sf, "confidence", "delivery_id").withColumn("c", _confidence())
    other = F.when(F.col("higher_ranked") == "A", "B").otherwise("A")
    shown = [(1, F.concat(F.lit(" "), "higher_ranked"), F.log(0.5 + 0.3 * F.col("c"))), (2, F.concat(F.lit("**"), F.lower("higher_ranked"), F.lit("**")), F.lit(math.log(0.05))), (3, F.concat(other, F.lit(".")), F.log(0.1 - 0.05 * F.col("c"))), (4, F.lit("?"), F.lit(math.log(0.02)))]
    rows = F.array(*[F.struct(F.lit(p).alias("place"), t.alias("token"), lp.alias("logprob")) for p, t, lp in shown])
    return o.select(*AM, "delivery_id", F.col("higher_ranked").alias("win"), F.explode(rows).alias("x")).select(*AM, "delivery_id", "win", "x.*")


@query(
    "token_sides",
    f"""with {_TOKENS} select axis_key, model, nullif(upper(regexp_replace(token, '[^A-Za-z]', '', 'g')), '') as side, count(*) as n from t group by 1, 2, 3""",
)
def token_sides(spark, sf):
    """What side each listed token names, by its letters alone."""
    return _tokens(spark, sf).groupBy(*AM, A.side_of(F.col("token")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_buckets",
    f"""with {OBS}, d as (select axis_key, case when ratio >= 10 then '1' end as before, case when ratio >= 10 then (floor(ratio)::bigint % 10)::varchar else floor(ratio)::bigint::varchar end as token from obs),
    b as (select axis_key, case when before = '1' and length(token) = 1 then before || token else token end::int as n from d)
    select axis_key, case when n between 1 and 25 then n end as bucket, count(*) as readings from b group by 1, 2""",
)
def token_buckets(spark, sf):
    """A rung written as one or two tokens of digits."""
    big, whole = F.col("ratio") >= 10, F.floor("ratio")
    o = obs(spark, sf).select("axis_key", F.when(big, F.lit("1")).alias("before"), F.when(big, whole % 10).otherwise(whole).cast("string").alias("token"))
    return o.groupBy("axis_key", A.bucket_of(F.concat(F.lit(" "), "token"), F.col("before")).alias("bucket")).agg(F.count(F.lit(1)).alias("readings"))


@query(
    "answer_merge",
    f"""with {_TOKENS}, n as (select *, nullif(upper(regexp_replace(token, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), '') as answer from t),
    f as (select axis_key, model, delivery_id, win, answer, arg_min(logprob, place) as lp from n where answer is not null group by 1, 2, 3, 4, 5)
    select axis_key, model, answer = win as winner, count(*) as n, round(sum(exp(lp)), 4) as mass from f group by 1, 2, 3""",
)
def answer_merge(spark, sf):
    """Alternatives cleaned and merged, the first listed one of each answer."""
    m = A.merged(_tokens(spark, sf), [*AM, "delivery_id", "win"], A.clean_token(F.col("token")))
    return m.groupBy(*AM, (F.col("answer") == F.col("win")).alias("winner")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 4).alias("mass"))


@query(
    "token_distribution",
    f"""with {_TOKENS}, n as (select *, nullif(upper(regexp_replace(token, '[^A-Za-z]', '', 'g')), '') as side from t),
    b as (select axis_key, model, delivery_id, win, side, max(exp(logprob)) as p from n where side is not null group by 1, 2, 3, 4, 5),
    r as (select axis_key, model, delivery_id, win, null as side, greatest(1 - sum(p), 0) as p from b group by 1, 2, 3, 4)
    select axis_key, model, case when side is null then 'unseen' when side = win then 'winner' else 'loser' end as kind, round(avg(p) + 1e-9, 5) as p from (select * from b union all select * from r) group by 1, 2, 3""",
)
def token_distribution(spark, sf):
    """The likeliest token of each side at the answer's position, and the mass that names none."""
    d = A.strongest(_tokens(spark, sf), [*AM, "delivery_id", "win"], A.side_of(F.col("token")))
    kind = F.when(F.col("answer").isNull(), "unseen").when(F.col("answer") == F.col("win"), "winner").otherwise("loser")
    return d.groupBy(*AM, kind.alias("kind")).agg(F.round(F.avg("p") + 1e-9, 5).alias("p"))


_LETTERS = f"""{_LADDER}, pmf0 as (select axis_key, model, atom, sum(p) as p from atoms group by 1, 2, 3), pmf1 as (select axis_key, model, atom, p / sum(p) over (partition by axis_key, model) as p from pmf0),
    alt as (select axis_key, model, case when atom > 0 then 'A' else 'B' end || chr(64 + abs(atom)) as token, ln(p * 0.9) as logprob, atom from pmf1 where atom <> 0
            union all select axis_key, model, '==', ln(p * 0.9), 0 from pmf1 where atom = 0
            union all select distinct axis_key, model, 'I', ln(0.04::double), null::int from pmf1)"""


def _letter_alternatives(spark, sf):
    pmf = P.from_readings(obs(spark, sf), AM)
    named = F.concat(F.when(F.col("atom") > 0, "A").otherwise("B"), A.letter_of(F.abs("atom")))
    rows = pmf.select(*AM, F.when(F.col("atom") == 0, "==").otherwise(named).alias("token"), F.log(F.col("p") * 0.9).alias("logprob"))
    return rows.unionByName(pmf.select(*AM).distinct().select(*AM, F.lit("I").alias("token"), F.lit(math.log(0.04)).alias("logprob")))


def _letter_atom():
    rung = A.rung_of(F.substring("token", 2, 1)).cast("int")
    return F.when(F.col("token") == "==", 0).when(F.length("token") == 2, F.when(F.substring("token", 1, 1) == "A", rung).when(F.substring("token", 1, 1) == "B", -rung))


@query(
    "logprob_evidence",
    f"""with {_LETTERS}, v as (select *, exp(logprob) as p, sign(atom) * {_LOGS}[abs(atom) + 1] as value from alt)
    select axis_key, model, round(sum(case when atom is not null then p else 0 end), 6) as shown, round(sum(case when atom is null then p else 0 end), 6) as off_alphabet, round(1 - sum(p), 6) as abstain,
        round(sum(p * value) / sum(case when atom is not null then p end), 6) + 0.0 as mean, round(sum(p * value * value) / sum(case when atom is not null then p end), 6) + 0.0 as second from v group by 1, 2""",
)
def logprob_evidence(spark, sf):
    """Letters of the ratio ladder with log-probabilities, a token beside the alphabet, and what isn't shown."""
    e = A.evidence(_letter_alternatives(spark, sf), AM, _letter_atom())
    return e.select(*AM, *[r6(c).alias(c) for c in ("shown", "off_alphabet", "abstain", "mean", "second")])


@query(
    "evidence_mixture",
    f"""with {_LADDER}, n as (select axis_key, count(*) as n from obs group by 1), p as (select axis_key, atom, sum(p) as p from atoms group by 1, 2)
    select axis_key, atom, round(p.p / n.n, 6) as p from p join n using (axis_key)""",
)
def evidence_mixture(spark, sf):
    """The models' distributions mixed by their numbers of readings: the distribution of all readings together."""
    o = obs(spark, sf)
    parts = P.from_readings(o, AM).join(o.groupBy(*AM).agg(F.count(F.lit(1)).alias("n")), AM)
    return P.mixture(parts, ["axis_key"], "n").select("axis_key", "atom", F.round("p", 6).alias("p"))


_POST = f"""{_LADDER}, px as (select axis_key, model, delivery_id, least(greatest({_CONF}, 0.0::double), 1.0::double) as c, {_LOGS} as logs, abs(m) as size from obs),
    pk as (select *, greatest(len(list_filter(logs, lambda x: x < size)) - 1, 0) as low from px), pu as (select *, case when size >= logs[26] then 25 else low end as lo2, least(low + 1, 25) as up from pk),
    pv as (select *, case when size >= logs[26] then 1.0 else 1 - (size - logs[lo2 + 1]) / (logs[up + 1] - logs[lo2 + 1]) end as q0 from pu),
    pj as (select axis_key, model, c, size, lo2, up, 0.5 + 0.45 * c as pw, 0.48 - 0.45 * c as pl, 0.95 * q0 as qa, case when size >= logs[26] then 0 else 0.95 * (1 - q0) end as qb, logs from pv)"""


@query(
    "logprob_posterior",
    f"""with {_POST}, e as (select axis_key, model, pw * qa as a, pw * qb as b, pl * qa as x, pl * qb as y, case when qa >= qb then pw * qa else pw * qb end as top, pw * (qa + qb) as near, 1 - (pw + pl) * (qa + qb) as rest from pj),
    f as (select *, case when a > 0 then -a * ln(a) else 0 end + case when b > 0 then -b * ln(b) else 0 end + case when x > 0 then -x * ln(x) else 0 end + case when y > 0 then -y * ln(y) else 0 end + case when rest > 1e-12 then -rest * ln(rest) else 0 end as h from e)
    select axis_key, model, round(avg(h) + 1e-9, 5) as entropy, round(avg(top) + 1e-9, 5) as top, round(avg(near) + 1e-9, 5) as near from f group by 1, 2""",
)
def logprob_posterior(spark, sf):
    """Product of a side's and a rung's distribution for every reading."""
    o = obs(spark, sf, "confidence", "delivery_id").withColumn("c", _confidence())
    key = [*AM, "delivery_id"]
    other = F.when(F.col("higher_ranked") == "A", "B").otherwise("A")
    two = F.array(F.struct(F.col("higher_ranked").alias("answer"), (0.5 + 0.45 * F.col("c")).alias("p")), F.struct(other.alias("answer"), (0.48 - 0.45 * F.col("c")).alias("p")))
    sides = o.select(*key, F.col("higher_ranked").alias("chosen_side"), F.explode(two).alias("x")).select(*key, "chosen_side", "x.*")
    rungs = o.withColumn("l", P.on_ladder(F.abs("m")))
    best = F.aggregate("l", F.col("l")[0], lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))
    rungs = rungs.select(*key, best["atom"].alias("chosen_rung"), F.explode("l").alias("x")).select(*key, "chosen_rung", F.col("x.atom").alias("rung"), (F.col("x.p") * 0.95).alias("p"))
    p = A.posterior(sides, rungs, key)
    return p.groupBy(*AM).agg(*[F.round(F.avg(c) + 1e-9, 5).alias(c) for c in ("entropy", "top", "near")])


# --- numbers written token by token ------------------------------------------

_DRAWS = f"""{OBS}, draws as (select axis_key, model, delivery_id, case when m >= 0 then 'A' else 'B' end as direction, floor(least(greatest(ratio, 0), 999.9))::bigint as whole, (floor(least(greatest(ratio, 0), 999.9) * 10) - floor(least(greatest(ratio, 0), 999.9)) * 10)::bigint as part,
        (60 + delivery_id % 31) / 100.0::double as p1, (40 + delivery_id % 47) / 100.0::double as p2, (30 + delivery_id % 53) / 100.0::double as p3 from obs)"""
_TREE = """, r1 as (select axis_key, model, direction, avg(p1) as raw from d group by 1, 2, 3), t1 as (select axis_key, model, sum(raw) as t from r1 group by 1, 2),
    m1 as (select r1.*, raw / greatest(t, 1) as m, greatest(1 - t, 0) as rest from r1 join t1 using (axis_key, model)),
    r2 as (select axis_key, model, direction, whole, avg(p2) as raw from d group by 1, 2, 3, 4), t2 as (select axis_key, model, direction, sum(raw) as t from r2 group by 1, 2, 3),
    m2 as (select r2.*, m1.m * r2.raw / greatest(t, 1) as m, m1.m * greatest(1 - t, 0) as rest from r2 join t2 using (axis_key, model, direction) join m1 using (axis_key, model, direction)),
    r3 as (select axis_key, model, direction, whole, part, avg(p3) as raw from d group by 1, 2, 3, 4, 5), t3 as (select axis_key, model, direction, whole, sum(raw) as t from r3 group by 1, 2, 3, 4),
    leaves as (select r3.*, m2.m * r3.raw / greatest(t, 1) as p, m2.m * greatest(1 - t, 0) as rest from r3 join t3 using (axis_key, model, direction, whole) join m2 using (axis_key, model, direction, whole)),
    val as (select *, case when direction = 'A' then 1 else -1 end as s, ln(greatest(whole + part / 10.0::double, 1)) as z from leaves)"""
_Z = repr(G.Z) + "::double"


def _number_draws(spark, sf):
    o = obs(spark, sf, "delivery_id")
    size = F.least(F.greatest("ratio", F.lit(0.0)), F.lit(G.LARGEST))
    share = lambda low, n: (low + F.col("delivery_id") % n) / F.lit(100.0)
    return o.select(*AM, "delivery_id", F.when(F.col("m") >= 0, "A").otherwise("B").alias("direction"), F.floor(size).alias("whole"), (F.floor(size * 10) - F.floor(size) * 10).alias("part"), share(60, 31).alias("p_direction"), share(40, 47).alias("p_whole"), share(30, 53).alias("p_part"))


@query("ledger_leaves", f"with {_DRAWS}, d as (select * from draws){_TREE} select axis_key, model, direction, whole, part, round(p, 9) as p from leaves")
def ledger_leaves(spark, sf):
    """Leaves' masses: the product of the nodes' mean token probabilities."""
    leaves, _ = G.tree(_number_draws(spark, sf), AM)
    return leaves.select(*AM, "direction", "whole", "part", F.round("p", 9).alias("p"))


@query(
    "ledger_bounds",
    f"""with {_DRAWS}, d as (select * from draws){_TREE}, head as (select axis_key, model, sum(p) as mass, sum(p * s * z) as e from val group by 1, 2),
    cells as (select distinct axis_key, model, rest as mass, -{_Z} as lo, {_Z} as hi from m1
        union all select axis_key, model, rest, case when direction = 'A' then 0 else -{_Z} end, case when direction = 'A' then {_Z} else 0 end from (select distinct axis_key, model, direction, rest from m2)
        union all select axis_key, model, rest, case when direction = 'A' then ln(greatest(whole, 1)) else -ln(greatest(whole + 0.9::double, 1)) end, case when direction = 'A' then ln(greatest(whole + 0.9::double, 1)) else -ln(greatest(whole, 1)) end from (select distinct axis_key, model, direction, whole, rest from leaves)),
    c as (select axis_key, model, sum(mass) as cell, sum(mass * lo) as lo, sum(mass * hi) as hi from cells group by 1, 2)
    select axis_key, model, round(mass, 6) as enumerated, round(cell, 6) as cell_mass, round(e + lo - abs(1 - mass - cell) * {_Z}, 5) + 0.0 as e_lo, round(e + (lo + hi) / 2, 5) + 0.0 as e_mid, round(e + hi + abs(1 - mass - cell) * {_Z}, 5) + 0.0 as e_hi from head join c using (axis_key, model)""",
)
def ledger_bounds(spark, sf):
    """Bounds of the mean log-ratio from the leaves and the cells of what no token was seen for."""
    b = G.bounds(*G.tree(_number_draws(spark, sf), AM), AM)
    return b.select(*AM, r6("enumerated").alias("enumerated"), r6("cell_mass").alias("cell_mass"), *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("e_lo", "e_mid", "e_hi")])


@query(
    "ledger_cross_fit",
    f"""with {_DRAWS}, n as (select *, row_number() over (partition by axis_key, model order by delivery_id) as k, count(*) over (partition by axis_key, model) as n from draws),
    d as (select * from n where k <= n // 2){_TREE}, head as (select axis_key, model, sum(p) as q, sum(p * s * z) as e from val group by 1, 2),
    o as (select axis_key, model, avg(case when direction = 'A' then 1 else -1 end * ln(greatest(whole + part / 10.0::double, 1))) as m from n where k > n // 2 and not exists (select 1 from leaves l where l.axis_key = n.axis_key and l.model = n.model and l.direction = n.direction and l.whole = n.whole and l.part = n.part) group by 1, 2)
    select axis_key, model, round(e + greatest(1 - q, 0) * coalesce(m, 0), 5) + 0.0 as estimate from head left join o using (axis_key, model)""",
)
def ledger_cross_fit(spark, sf):
    """The first half of the draws gives leaves and masses, the other half what lies outside them."""
    w = Window.partitionBy(*AM)
    d = _number_draws(spark, sf).withColumns({"k": F.row_number().over(w.orderBy("delivery_id")), "n": F.count(F.lit(1)).over(w)})
    return G.cross_fit(d, AM, F.col("k") <= F.floor(F.col("n") / 2)).select(*AM, (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"))


@query("ledger_draws", f"with {_DRAWS}, z as (select *, case when direction = 'A' then 1 else -1 end * ln(greatest(whole + part / 10.0::double, 1)) as z from draws) select axis_key, model, count(*) as draws, round(avg(z), 6) + 0.0 as mean, round(var_samp(z), 6) + 0.0 as variance from z group by 1, 2 having count(*) >= 2")
def ledger_draws(spark, sf):
    """The fallback of draws without probabilities: their mean and variance, two at least."""
    return G.draws_or_frequencies(_number_draws(spark, sf), AM).select(*AM, "draws", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query(
    "token_jitter",
    f"""with {_DRAWS}, g as (select axis_key, model, whole, count(*) as n, avg(p2) as mean, max(p2) - min(p2) as spread from draws group by 1, 2, 3),
    h as (select *, row_number() over (partition by axis_key, model order by spread) as k, count(*) over (partition by axis_key, model) as c from g where n > 1 and mean > 0.01)
    select axis_key, model, count(*) as tokens, round(max(case when k = c // 2 + 1 then spread end), 6) as jitter_median, round(max(spread), 6) as jitter_max from h group by 1, 2""",
)
def token_jitter(spark, sf):
    j = G.jitter(_number_draws(spark, sf), AM, "whole", "p_whole")
    return j.select(*AM, "tokens", F.round("jitter_median", 6).alias("jitter_median"), F.round("jitter_max", 6).alias("jitter_max"))


# --- judges ----------------------------------------------------------------------

_CALIBRATION = f"""{OBS}, {NODES}, t as (select axis_key, entity_id, avg(s) as s from nodes group by 1, 2), e as (select axis_key, i, j, avg(m) as mu, count(*)::double as lam from obs group by 1, 2, 3),
    r as (select e.*, mu - (a.s - b.s) as res from e join t a on a.axis_key = e.axis_key and a.entity_id = e.i join t b on b.axis_key = e.axis_key and b.entity_id = e.j),
    g as (select axis_key, sum(lam * res * res) / sum(lam) as all_v from r group by 1),
    c as (select axis_key, i, j, model, count(*)::double as lam_r from obs group by 1, 2, 3, 4), p as (select r.axis_key, c.model, r.res, c.lam_r as w from r join c using (axis_key, i, j))"""


@query(
    "rater_calibration",
    f"""with {_CALIBRATION}, o as (select axis_key, model, count(*) as edges, sum(w * res * res) / sum(w) as own from p group by 1, 2),
    v as (select axis_key, model, res, sum(w) as w from p group by 1, 2, 3), k as (select *, sum(w) over (partition by axis_key, model order by res) as c, sum(w) over (partition by axis_key, model) as t from v),
    b as (select axis_key, model, min(res) as bias from k where c * 2 >= t group by 1, 2)
    select axis_key, model, edges, round(all_v / own, 5) as efficacy, round(bias, 5) + 0.0 as bias, round(sqrt(own / all_v), 5) as scatter from o join b using (axis_key, model) join g using (axis_key)""",
)
def rater_calibration(spark, sf):
    """Each model's part in the fused edges' residuals against the landed scores."""
    o = obs(spark, sf)
    ea = entity_axes(spark, sf)
    side = lambda x: ea.select("axis_key", F.col("entity_id").alias(x), F.col("s").alias(f"s_{x}"))
    e = E.fuse(o, "axis_key").join(side("i"), ["axis_key", "i"]).join(side("j"), ["axis_key", "j"])
    e = e.select("axis_key", "i", "j", "lam", F.col("lam").alias("lam_eff"), (F.col("mu") - (F.col("s_i") - F.col("s_j"))).alias("residual"))
    own = o.groupBy("axis_key", "i", "j", "model").agg(F.count(F.lit(1)).cast("double").alias("lam_r"))
    c = U.rater_calibration(e, own, ["axis_key"], "model")
    return c.select("axis_key", "model", "edges", *[(F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("efficacy", "bias", "scatter")])


@query(
    "spin_probe",
    f"""with {OBS}, f as (select axis_key, model, comparison_index % 3 as framing, avg(m) as mean, avg(case when a < b then m end) as x, avg(case when a >= b then m end) as y from obs group by 1, 2, 3),
    g as (select axis_key, model, max(case when framing = 0 then mean end) as n, max(case when framing = 1 then mean end) as p, max(case when framing = 2 then mean end) as c, coalesce(count_if(sign(x) <> sign(y) and x <> 0), 0) as fl from f group by 1, 2)
    select axis_key, model, round((p - c) / 2, 6) + 0.0 as susceptibility, coalesce((case when n <> 0 then sign(n) = sign(p) and sign(n) = sign(c) end)::varchar, 'unknown') as survives, fl as flipped_by_order from g""",
)
def spin_probe(spark, sf):
    """Three framings (here the place in the schedule), each in both orders."""
    o = obs(spark, sf, "comparison_index")
    framing = F.element_at(F.array(F.lit("neutral"), F.lit("first"), F.lit("second")), (F.col("comparison_index") % 3 + 1).cast("int"))
    rows = o.select(*AM, framing.alias("framing"), F.when(F.col("a") < F.col("b"), 0).otherwise(1).alias("order"), "m")
    s = U.spin_probe(rows, AM).withColumn("susceptibility", r6("susceptibility"))
    return s.withColumn("survives", F.coalesce(F.col("survives").cast("string"), F.lit("unknown")))


@query(
    "consortium_verdict",
    f"""with {_ORBIT}, p as (select axis_key, model, sum(case when chi = 0 then c end) as belief, sqrt(sum(case when chi <> 0 then c * c else 0 end)) as bias from wht group by 1, 2)
    select axis_key, count(*) as judges, round(avg(belief), 6) + 0.0 as mean, round(stddev_pop(belief), 6) as spread, min(belief) >= 0 or max(belief) <= 0 as unanimous, round(avg(bias), 6) as bias_rms from p group by 1 having count(*) >= 2""",
)
def consortium_verdict(spark, sf):
    c = U.consortium(_orbit(spark, sf), ["axis_key"], "model")
    return c.select("axis_key", "judges", r6("mean").alias("mean"), F.round("spread", 6).alias("spread"), "unanimous", F.round("bias_rms", 6).alias("bias_rms"))


@query("consortium_top_bias", f"with {_ORBIT} select axis_key, model, arg_max(chi, (round(abs(c), 9), chi)) as chi, round(arg_max(c, (round(abs(c), 9), chi)), 6) + 0.0 as coefficient from wht where chi <> 0 group by 1, 2")
def consortium_top_bias(spark, sf):
    return U.top_bias(_orbit(spark, sf), AM).withColumn("coefficient", r6("coefficient"))


@query(
    "consortium_residuals",
    f"""with {_CELLS}, c as (select cells.* from cells join whole using (axis_key, model))
    select a.axis_key, a.model as judge_a, b.model as judge_b, round(case when var_pop(a.m) * 8 <= 1e-15 or var_pop(b.m) * 8 <= 1e-15 then 0 else corr(a.m, b.m) end, 6) + 0.0 as r from c a join c b on a.axis_key = b.axis_key and a.g = b.g and a.model < b.model group by 1, 2, 3""",
)
def consortium_residuals(spark, sf):
    """Correlation of the judges' eight cells: a mean taken off leaves it as it is."""
    o = obs(spark, sf, "comparison_index", "delivery_id")
    g = (F.col("a") < F.col("b")).cast("int") + 2 * (F.col("comparison_index") % 2) + 4 * (F.col("delivery_id") % 2)
    cells = o.groupBy(*AM, g.cast("int").alias("g")).agg(F.avg("m").alias("m"))
    return U.residual_correlation(cells, ["axis_key"], "model").withColumn("r", r6("r"))


@query(
    "nuisance_drift",
    f"""with {OBS}, t as (select axis_key, model, i, j, template_slug, avg(m) as m from obs group by 1, 2, 3, 4, 5), k as (select min(template_slug) as core from obs),
    b as (select axis_key, model, i, j, m as base from t, k where template_slug = core)
    select template_slug, count(*) as n, round(avg(abs(m - base)), 6) as mean, round(1.96 * stddev_samp(abs(m - base)) / sqrt(count(*)), 6) as half_width from t join b using (axis_key, model, i, j), k where template_slug <> core group by 1""",
)
def nuisance_drift(spark, sf):
    """Drift of the pairs' readings under other templates from those under the first."""
    o = obs(spark, sf, "template_slug")
    core = o.agg(F.min("template_slug").alias("c")).first()["c"]
    t = o.groupBy(*AM, "i", "j", "template_slug").agg(F.avg("m").alias("m"))
    d = U.nuisance_drift(t, [*AM, "i", "j"], "template_slug", core)
    return d.select("template_slug", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


@query(
    "null_bias",
    f"""with {OBS}, p as (select axis_key, i, j from obs group by 1, 2, 3 having abs(avg(m)) < 0.05 and count(*) >= 2)
    select model, count(*) as n, round(avg(abs(m)), 6) as mean, round(1.96 * stddev_samp(abs(m)) / sqrt(count(*)), 6) as half_width from obs join p using (axis_key, i, j) group by 1""",
)
def null_bias(spark, sf):
    """Size of the readings on pairs that all readings together call even."""
    o = obs(spark, sf)
    even = o.groupBy("axis_key", "i", "j").agg(F.avg("m").alias("mu"), F.count(F.lit(1)).alias("k")).filter((F.abs("mu") < 0.05) & (F.col("k") >= 2)).select("axis_key", "i", "j")
    g = o.join(even, ["axis_key", "i", "j"]).groupBy("model").agg(*U.mean_interval(F.abs("m")))
    return g.select("model", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


@query(
    "draw_stats",
    f"""with {OBS} select axis_key, model, i, j, count(*) as draws, round(avg(m), 6) + 0.0 as mean, round(stddev_samp(m), 6) + 0.0 as sd, round(max(m) - min(m), 6) as spread, round(least(count_if(m > 0), count_if(m < 0)) / count(*)::double, 6) as sign_minority,
        count(distinct round(m, 9)) as "distinct", round(1 - count(distinct round(m, 9)) / count(*)::double, 6) as duplicate_rate from obs group by 1, 2, 3, 4 having count(*) >= 2""",
)
def draw_stats(spark, sf):
    d = U.draw_stats(obs(spark, sf), [*AM, "i", "j"])
    return d.select(*AM, "i", "j", "draws", r6("mean").alias("mean"), r6("sd").alias("sd"), *[F.round(c, 6).alias(c) for c in ("spread", "sign_minority")], "distinct", F.round("duplicate_rate", 6).alias("duplicate_rate"))


_TRIADS = f"""{OBS}, s as (select run, axis_key, i, j, avg(case when m > 0 then 1.0 when m = 0 then 0.5 else 0 end) as p, count(*) as k from obs group by 1, 2, 3, 4),
    t as (select e.run, e.axis_key, e.p as xy, f.p as yz, g.p as xz, e.k as kxy, f.k as kyz, g.k as kxz from s e join s f on f.run = e.run and f.axis_key = e.axis_key and f.i = e.j join s g on g.run = e.run and g.axis_key = e.axis_key and g.i = e.i and g.j = f.j)"""


@query(
    "transitivity_depth",
    f"""with {_TRIADS}, o as (select *, case when xy >= 0.5 and yz >= 0.5 then [xy, yz, xz, kxz] when xz >= 0.5 and 1 - yz >= 0.5 then [xz, 1 - yz, xy, kxy] when 1 - xy >= 0.5 and xz >= 0.5 then [1 - xy, xz, yz, kyz]
        when yz >= 0.5 and 1 - xz >= 0.5 then [yz, 1 - xz, 1 - xy, kxy] when 1 - xz >= 0.5 and xy >= 0.5 then [1 - xz, xy, 1 - yz, kyz] when 1 - yz >= 0.5 and 1 - xy >= 0.5 then [1 - yz, 1 - xy, 1 - xz, kxz] end as o from t),
    d as (select *, case when o[3] < 0.5 then 0.5 when o[3] < least(o[1], o[2]) then least(o[1], o[2]) when o[3] < greatest(o[1], o[2]) then greatest(o[1], o[2]) end as bar from o where o is not null),
    e as (select *, (bar - o[3]) / sqrt(greatest(o[3] * (1 - o[3]), 0.25 / o[4]) / o[4]) as depth from d)
    select run, axis_key, count(*) as triads, count(bar) as broken, round(avg(depth), 5) as depth, coalesce(count_if(depth > 2), 0) as deep from e group by 1, 2""",
)
def transitivity_depth(spark, sf):
    """How far, in standard errors of the conclusion, each broken triad falls short of the strongest bar it breaks."""
    t = B.triads(B.pair_shares(obs(spark, sf), RUN).withColumn("v", F.struct("p", F.col("k").cast("double").alias("k"))), RUN, "v")
    up = lambda c: F.struct(F.col(c)["p"].alias("p"), F.col(c)["k"].alias("k"))
    down = lambda c: F.struct((1 - F.col(c)["p"]).alias("p"), F.col(c)["k"].alias("k"))
    orders = [(up("xy"), up("yz"), up("xz")), (up("xz"), down("yz"), up("xy")), (down("xy"), up("xz"), up("yz")), (up("yz"), down("xz"), down("xy")), (down("xz"), up("xy"), down("yz")), (down("yz"), down("xy"), down("xz"))]
    first = F.coalesce(*[F.when((a["p"] >= 0.5) & (b["p"] >= 0.5), F.struct(a["p"].alias("a"), b["p"].alias("b"), c["p"].alias("c"), c["k"].alias("k"))) for a, b, c in orders])
    x = t.withColumn("o", first).filter("o is not null").select(*RUN, "o.*")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    bar = F.when(F.col("c") < 0.5, 0.5).when(F.col("c") < low, low).when(F.col("c") < high, high)
    x = x.withColumn("bar", bar)
    depth = (F.col("bar") - F.col("c")) / F.sqrt(F.greatest(F.col("c") * (1 - F.col("c")), 0.25 / F.col("k")) / F.col("k"))
    return x.withColumn("depth", depth).groupBy(*RUN).agg(F.count(F.lit(1)).alias("triads"), F.count("bar").alias("broken"), F.round(F.avg("depth"), 5).alias("depth"), F.count_if(F.col("depth") > 2).alias("deep"))


@query(
    "paraphrase_rho",
    f"""with {OBS}, e as (select axis_key, template_slug, i as entity_id, m as s from obs union all select axis_key, template_slug, j, -m from obs), l as (select axis_key, template_slug, entity_id, avg(s) as s from e group by 1, 2, 3),
    p as (select a.axis_key, a.template_slug as ta, b.template_slug as tb, a.s as x, b.s as y from l a join l b using (axis_key, entity_id) where a.template_slug < b.template_slug),
    o as (select *, row_number() over (partition by axis_key, ta, tb order by x) as rx, row_number() over (partition by axis_key, ta, tb order by y) as ry from p),
    v as (select *, avg(rx) over (partition by axis_key, ta, tb, x) as ax, avg(ry) over (partition by axis_key, ta, tb, y) as ay from o)
    select axis_key, ta as template_a, tb as template_b, count(*) as n, round(case when count(*) >= 3 and stddev_pop(ax) > 1e-12 and stddev_pop(ay) > 1e-12 then corr(ax, ay) end, 6) + 0.0 as rho,
        round((1 + case when count(*) >= 3 and stddev_pop(ax) > 1e-12 and stddev_pop(ay) > 1e-12 then corr(ax, ay) end) / 2, 6) as score from v group by 1, 2, 3""",
)
def paraphrase_rho(spark, sf):
    """Agreement of the entities' mean readings under two wordings, as a correlation of ranks and as a score in 0..1."""
    l = E.margins(obs(spark, sf, "template_slug"), "axis_key", "template_slug").withColumnRenamed("margin", "s")  # noqa: E741
    a = l.select("axis_key", "entity_id", F.col("template_slug").alias("template_a"), F.col("s").alias("x"))
    b = l.select("axis_key", "entity_id", F.col("template_slug").alias("template_b"), F.col("s").alias("y"))
    keys = ["axis_key", "template_a", "template_b"]
    rho = R.spearman(a.join(b, ["axis_key", "entity_id"]).filter("template_a < template_b"), keys, "x", "y")
    return rho.select(*keys, "n", r6("rho").alias("rho"), F.round((1 + F.col("rho")) / 2, 6).alias("score"))


@query(
    "truth_slope",
    f"with {OBS}, {NODES}, t as (select axis_key, entity_id, avg(s) as s from nodes group by 1, 2), d as (select obs.axis_key, model, m, a.s - b.s as d from obs join t a on a.axis_key = obs.axis_key and a.entity_id = obs.i join t b on b.axis_key = obs.axis_key and b.entity_id = obs.j) select axis_key, model, count(*) as n, round(sum(m * d) / sum(d * d), 6) + 0.0 as slope, round(sum(m * d) * sum(m * d) / (sum(d * d) * sum(m * m)), 6) as r2 from d group by 1, 2 having sum(d * d) > 0 and sum(m * m) > 0",
)
def truth_slope(spark, sf):
    """Slope through the origin and explained part of the readings over the truth's differences (here the landed scores)."""
    ea = entity_axes(spark, sf)
    side = lambda x: ea.select("axis_key", F.col("entity_id").alias(x), F.col("s").alias(f"s_{x}"))
    d = obs(spark, sf).join(side("i"), ["axis_key", "i"]).join(side("j"), ["axis_key", "j"]).withColumn("d", F.col("s_i") - F.col("s_j"))
    md, dd, mm = F.sum(F.col("m") * F.col("d")), F.sum(F.col("d") * F.col("d")), F.sum(F.col("m") * F.col("m"))
    g = d.groupBy(*AM).agg(F.count(F.lit(1)).alias("n"), md.alias("md"), dd.alias("dd"), mm.alias("mm")).filter("dd > 0 and mm > 0")
    return g.select(*AM, "n", r6(F.col("md") / F.col("dd")).alias("slope"), F.round(F.col("md") * F.col("md") / (F.col("dd") * F.col("mm")), 6).alias("r2"))


@query(
    "elaboration_delta",
    f"""with {_LADDER}, a2 as (select axis_key, model, atom, sum(p) as p from atoms group by 1, 2, 3),
    h as (select axis_key, model, -sum(p / t * ln(p / t)) as h from (select *, sum(p) over (partition by axis_key, model) as t from a2) where p > 0 group by 1, 2),
    b as (select axis_key, avg(h) as h from h group by 1), pool as (select axis_key, atom, sum(p) as p from atoms group by 1, 2),
    e as (select axis_key, -sum(p / t * ln(p / t)) as h from (select *, sum(p) over (partition by axis_key) as t from pool) where p > 0 group by 1)
    select axis_key, round(b.h, 6) as entropy, round(e.h, 6) as pooled_entropy, round(e.h - b.h, 6) + 0.0 as delta from b join e using (axis_key)""",
)
def elaboration_delta(spark, sf):
    """Mean entropy of the bare answers (each model's) against that of the elaborated ones (all models' together)."""
    o = obs(spark, sf)
    bare = P.summary(P.from_readings(o, AM), AM).groupBy("axis_key").agg(F.avg("entropy").alias("entropy"))
    full = P.summary(P.from_readings(o, ["axis_key"]), ["axis_key"]).select("axis_key", F.col("entropy").alias("pooled"))
    return bare.join(full, "axis_key").select("axis_key", F.round("entropy", 6).alias("entropy"), F.round("pooled", 6).alias("pooled_entropy"), r6(F.col("pooled") - F.col("entropy")).alias("delta"))


# --- slates, covers, utilities, curves ---------------------------------------------------


@query(
    "slate_merge",
    f"with {CUR}, p as (select distinct lower(trim(axis_prompt)) as attribute, lens from cur where axis_prompt is not null and trim(axis_prompt) <> ''), g as (select attribute, array_to_string(list_sort(list(distinct lens) filter (where lens is not null)), ',') as backers, count(distinct lens) as breadth from p group by 1) select attribute, backers, breadth, row_number() over (order by breadth desc, attribute)::int as place from g",
)
def slate_merge(spark, sf):
    """The attributes that the lenses (as stakeholders) ask for, merged by wording."""
    rows = E.current(table(spark, sf, "comparisons"), "axis_prompt", "lens")
    s = U.merge_slates(rows, F.lower(F.trim("axis_prompt")), "lens")
    return s.select("attribute", "backers", "breadth", F.col("place").cast("int").alias("place"))


@query(
    "pair_cover",
    f"""with {NODES}, x as (select run, axis_key, entity_id, (row_number() over (partition by run, axis_key order by entity_id) - 1) // 4 as c, count(*) over (partition by run, axis_key) as n from nodes),
    y as (select run, axis_key, max(n) as entities, ceil(max(n) / 4.0)::bigint as chunks from x group by 1, 2)
    select run, axis_key, case when chunks = 1 then 1 else chunks * (chunks - 1) // 2 end::bigint as blocks, entities * (entities - 1) // 2 as pairs_met from y""",
)
def pair_cover(spark, sf):
    """Sets of eight in which every two entities of a run meet, and how many pairs really do."""
    b = U.pair_cover(nodes(spark, sf), RUN, "entity_id", 8)
    blocks = b.groupBy(*RUN).agg(F.count_distinct("block").alias("blocks"))
    x, y = b.select(*RUN, "block", F.col("entity_id").alias("x")), b.select(*RUN, "block", F.col("entity_id").alias("y"))
    met = x.join(y, [*RUN, "block"]).filter("x < y").select(*RUN, "x", "y").distinct().groupBy(*RUN).agg(F.count(F.lit(1)).alias("pairs_met"))
    return blocks.join(met, RUN, "left").fillna(0, ["pairs_met"])


@query(
    "weighted_utility",
    f"""with {ENTITY_AXES}, s as (select axis_key, min(s) as lo, max(s) as hi from ea group by 1), u as (select entity_id, sum(coalesce(a.weight, 1) * case when abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) then 0.5 else (ea.s - lo) / (hi - lo) end) as utility from ea join s using (axis_key) join axes a using (axis_key) group by 1)
    select entity_id, round(utility, 6) + 0.0 as utility from u""",
)
def weighted_utility(spark, sf):
    """Axes scaled to 0..1 and summed by weight."""
    w = table(spark, sf, "axes").select("axis_key", F.coalesce("weight", F.lit(1.0)).alias("w"))
    u = U.minmax_utility(entity_axes(spark, sf).join(F.broadcast(w), "axis_key"), "axis_key", "entity_id", "s", "w")
    return u.select("entity_id", r6("utility").alias("utility"))


_GAMMAS, _FLOORS = [0.25 * k for k in range(17)], [0.0625 * k for k in range(16)]
_GRID = f"(select unnest([{', '.join(map(repr, _GAMMAS))}]::double[]) as gamma) gs, (select unnest([{', '.join(map(repr, _FLOORS))}]::double[]) as floor) fs"


@query(
    "confidence_curve",
    f"""with {OBS}, p as (select axis_key, i, j, avg(m) as mu, count(*) as k from obs group by 1, 2, 3), r as (select model, least(greatest({_CONF}, 0.0::double), 1.0::double) as c, m - mu as r from obs join p using (axis_key, i, j) where k >= 2),
    cells as (select model, c, count(*) as n, sum(r * r) as ss from r group by 1, 2), g as (select *, greatest(floor + (1 - floor) * power(c, gamma), 1e-9) as g from cells, {_GRID}),
    s as (select model, gamma, floor, sum(n) as n, sum(g * ss) as q, sum(n * ln(g)) as l, sum(ss) as a from g group by 1, 2, 3 having sum(g * ss) > 0), t as (select *, n / 2 * ln(q / n) - l / 2 as nll, n / 2 * ln(a / n) as flat from s)
    select model, round(min(nll), 3) + 0.0 as nll, round(arg_min(flat, nll), 3) + 0.0 as flat_nll, round(2 * (arg_min(flat, nll) - min(nll)), 3) + 0.0 as gain from t group by 1""",
)
def confidence_curve(spark, sf):
    """The confidence's likeliest weight curve for each model, against none."""
    o = obs(spark, sf, "confidence").withColumn("c", _confidence())
    p = o.groupBy("axis_key", "i", "j").agg(F.avg("m").alias("mu"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
    r = o.join(p, ["axis_key", "i", "j"]).withColumn("r", F.col("m") - F.col("mu"))
    b = U.confidence_curve(r, ["model"], "c", "r", _GAMMAS, _FLOORS)
    r3 = lambda c: F.round(c, 3) + F.lit(0.0)
    return b.select("model", r3(F.col("nll")).alias("nll"), r3(F.col("flat_nll")).alias("flat_nll"), r3(2 * (F.col("flat_nll") - F.col("nll"))).alias("gain"))


@query(
    "slot_histogram",
    f"""with {CUR} select model, count_if(higher_ranked = 'A') as first_slot, count_if(higher_ranked = 'B') as second_slot, count_if(refused <> 0) as refused, round(case when sum(cost_nanodollars) > 0 then count_if(higher_ranked in ('A', 'B')) / (sum(cost_nanodollars)::double / 1e9) end, 2) as observations_per_dollar from cur group by 1""",
)
def slot_histogram(spark, sf):
    """Wins by slot, and readings for a dollar."""
    c = E.current(table(spark, sf, "comparisons"), "model", "higher_ranked", "refused", "cost_nanodollars")
    won = F.count_if(F.col("higher_ranked").isin("A", "B"))
    cost = F.sum("cost_nanodollars")
    return c.groupBy("model").agg(F.count_if(F.col("higher_ranked") == "A").alias("first_slot"), F.count_if(F.col("higher_ranked") == "B").alias("second_slot"), F.count_if(F.col("refused") != 0).alias("refused"), F.round(F.when(cost > 0, won / (cost.cast("double") / 1e9)), 2).alias("observations_per_dollar"))


_POISSON = " + ".join(f"(u >= {c!r}::double)::int" for c in S.CUMULATED)


@query(
    "bootstrap_intervals",
    f"""with {OBS}, g as (select axis_key, model, count(*)::double as n, sum(abs(m)) as s from obs group by 1, 2),
    r as (select *, ('0x' || substr(md5(axis_key || '|' || model || '|' || rep), 1, 8))::bigint / 4294967296.0::double as u from g, (select unnest(range(0, 200))::int as rep)),
    w as (select *, {_POISSON} as w from r), b as (select axis_key, rep, sum(w * s) / sum(w * n) as mean from w group by 1, 2 having sum(w) > 0)
    select axis_key, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.5), 6) as mid, round(quantile_cont(mean, 0.975), 6) as high from b group by 1""",
)
def bootstrap_intervals(spark, sf):
    """Interval of the mean reading size when whole models are drawn with replacement."""
    g = obs(spark, sf).groupBy(*AM).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.abs("m")).alias("s"))
    b = S.bootstrap_means(g, ["axis_key"], "model", "s", "n")
    return b.select("axis_key", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


# --- stops -------------------------------------------------------------------------

_CERTIFY = f"""with recursive {OBS}, {RANKED}, e as (select distinct run, axis_key, i, j from obs), both_ways as (select run, axis_key, i as x, j as y from e union all select run, axis_key, j, i from e),
    reach(run, axis_key, x, c) as (select distinct run, axis_key, x, x from both_ways union select b.run, b.axis_key, b.y, r.c from reach r join both_ways b on b.run = r.run and b.axis_key = r.axis_key and b.x = r.x where r.c < b.y),
    label as (select run, axis_key, x as entity_id, min(c) as component from reach group by 1, 2, 3), deg as (select run, axis_key, x as entity_id, count(*) as degree from both_ways group by 1, 2, 3),
    b as (select r.*, s - 2.94::double * sqrt(v) as lcb, s + 2.94::double * sqrt(v) as ucb, coalesce(degree, 0) as degree, component from ranked r left join label using (run, axis_key, entity_id) left join deg using (run, axis_key, entity_id)),
    i as (select * from b where rank <= {K} qualify row_number() over (partition by run, axis_key order by lcb, entity_id) = 1), j as (select * from b where rank > {K} qualify row_number() over (partition by run, axis_key order by ucb desc, entity_id desc) = 1),
    a as (select run, axis_key, component as anchor from b where rank = 1),
    v as (select a.run, a.axis_key, i.entity_id as weakest, j.entity_id as challenger, case when i.entity_id is null or j.entity_id is null then 'no critical pair' when least(i.degree, j.degree) < 2 then 'degree'
        when i.component <> anchor or j.component <> anchor or i.component is null or j.component is null or anchor is null then 'component' when i.lcb <= j.ucb then 'bounds overlap'
        when i.s - j.s - 2.94::double * sqrt(i.v + j.v) <= 0 then 'difference' else 'certified' end as reason
        from a left join i using (run, axis_key) left join j using (run, axis_key))"""


def _certified(spark, sf):
    """1.96 standard deviations, inflated by a half."""
    beta = 1.96 * 1.5
    n = R.ranked(nodes(spark, sf), RUN)
    sd = F.sqrt(F.greatest("v", F.lit(0.0)))
    band = n.select(*RUN, "entity_id", "rank", "s", "v", (F.col("s") - beta * sd).alias("lcb"), (F.col("s") + beta * sd).alias("ucb"))
    edges = E.fuse(obs(spark, sf), *RUN)
    degrees = edges.select(*RUN, F.explode(F.array("i", "j")).alias("entity_id")).groupBy(*RUN, "entity_id").agg(F.count(F.lit(1)).alias("degree"))
    labels = solver.nodes_of(solver.solve_edges(edges, RUN, solver.SolverConfig(irls_max_iters=0), kinds=("node",)), RUN).select(*RUN, "entity_id", "component")
    return U.certified(band, degrees, labels, RUN, K, beta)


@query("certified_reason", f"{_CERTIFY} select run, axis_key, weakest, challenger, reason = 'certified' as certified, reason from v")
def certified_reason(spark, sf):
    """The whole stop test of each run, and why it fails."""
    return _certified(spark, sf)


@query(
    "stop_streaks",
    f"""{_CERTIFY}, o as (select axis_key, run, reason = 'certified' as ok, sum(case when reason = 'certified' then 0 else 1 end) over (partition by axis_key order by run) as island from v)
    select axis_key, run, sum(ok::int) over (partition by axis_key, island order by run)::bigint as streak, sum(ok::int) over (partition by axis_key, island order by run) >= 2 as stop from o""",
)
def stop_streaks(spark, sf):
    """The runs of an axis as rounds: how many in a row were certified."""
    return U.stop_streaks(_certified(spark, sf), ["axis_key"], "run", "certified", 2).select("axis_key", "run", "streak", "stop")


@query("sort_boundary", f"with {RANKED}, n as (select *, count(*) over (partition by run, axis_key) as n from ranked) select run, axis_key, n, ceil(n / 2.0)::bigint as k, entity_id as boundary, round(s, 6) + 0.0 as s from n where rank = ceil(n / 2.0)")
def sort_boundary(spark, sf):
    """Whole-list sort: the boundary at half of the list."""
    return U.boundary(R.ranked(nodes(spark, sf), RUN), RUN).withColumn("s", r6("s"))


_CHAIN = """c as (select r_name, n_name as entity, row_number() over (partition by r_name order by n_nationkey) as pos, count(*) over (partition by r_name) as n
      from nation join region on r_regionkey = n_regionkey)"""


@query(
    "effective_resistance",
    f"""with {_CHAIN}, w as (select r_name, pos, 1 / (1 + pos % 3)::double as r from c), p as (select a.r_name, a.entity as x, b.entity as y, a.pos as p, b.pos as q from c a join c b on a.r_name = b.r_name and a.pos < b.pos)
    select p.r_name, least(x, y) as i, greatest(x, y) as j, round(sum(w.r), 5) as variance, true as same_component from p join w on w.r_name = p.r_name and w.pos >= p.p and w.pos < p.q group by p.r_name, x, y""",
)
def effective_resistance(spark, sf):
    """Variance of the difference of every two nations of a region, compared in a chain: the sum of the chain's pieces."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    w = Window.partitionBy("r_name").orderBy("n_nationkey")
    c = nation.join(region, nation.n_regionkey == region.r_regionkey).select("r_name", F.col("n_name").alias("a"), "n_nationkey").withColumns({"b": F.lead("a").over(w), "pos": F.row_number().over(w)})
    edges = c.filter("b is not null").select("r_name", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.lit(0.0).alias("mu"), (1.0 + F.col("pos") % 3).alias("lam"))
    x, y = c.select("r_name", F.col("a").alias("i")), c.select("r_name", F.col("a").alias("j"))
    pairs = x.join(y, "r_name").filter("i < j")
    return solver.pair_variances(edges, pairs, ["r_name"]).withColumn("variance", F.round("variance", 5))


# --- a synthetic judge, and the loop that asks it -----------------------------------------


def _u(kind: str) -> str:
    return f"(('0x' || substr(md5('{kind}|1|' || run || '|' || axis_key || '|' || i || '|' || j), 1, 8))::bigint / 4294967296.0::double)"


@query(
    "synthetic_readings",
    f"""with {RANKED}, p as (select a.run, a.axis_key, least(a.entity_id, b.entity_id) as i, greatest(a.entity_id, b.entity_id) as j, case when a.entity_id < b.entity_id then 1 else -1 end * (b.rank - a.rank) * 0.3 as d
        from ranked a join ranked b on a.run = b.run and a.axis_key = b.axis_key and b.rank - a.rank in (1, 2, 4)),
    q as (select *, case when {_u('o')} < 0.1 then (2 * {_u('w')} - 1) * 3.0 else d + 0.5 * sqrt(-2 * ln(greatest({_u('u')}, 1e-12))) * cos(2 * pi() * {_u('v')}) end as m, {_u('r')} < 0.05 as refused from p)
    select run, axis_key, i, j, round(greatest(least(m, ln(26.0::double)), -ln(26.0::double)), 6) + 0.0 as m, refused from q""",
)
def synthetic_readings(spark, sf):
    """Neighbours of each run's ranking read by a judge with noise, outliers and refusals."""
    r = R.ranked(nodes(spark, sf), RUN)
    a, b = (r.select(*RUN, F.col("entity_id").alias(x), F.col("rank").alias(f"r_{x}")) for x in "xy")
    p = a.join(b, RUN).filter((F.col("r_y") - F.col("r_x")).isin(1, 2, 4))
    d = F.when(F.col("x") < F.col("y"), 1).otherwise(-1) * (F.col("r_y") - F.col("r_x")) * 0.3
    rows = p.select(*RUN, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), d.alias("d"))
    return Y.readings(rows, RUN, 0.5, 0.1, 0.05).select(*RUN, "i", "j", r6("m").alias("m"), "refused")


@query("adaptive_stops")
def adaptive_stops(spark, sf):
    """The whole loop for every run, its landed places as the truth: how it stopped and how near it came."""
    truth = materialise(R.ranked(nodes(spark, sf), RUN).select(*RUN, "entity_id", (-F.col("rank") * 0.3).alias("t"), "rank"), "adaptive-truth")
    side = lambda x: truth.select(*RUN, F.col("entity_id").alias(x), F.col("t").alias(f"t_{x}"))

    def judge(pairs, turn):
        d = pairs.join(side("i"), [*RUN, "i"]).join(side("j"), [*RUN, "j"]).withColumn("d", F.col("t_i") - F.col("t_j"))
        return Y.readings(d, RUN, 0.4, seed=turn)

    found, stops = adaptive.rank_adaptively(truth, judge, RUN, K, batch=16, budget=120, rounds=6)
    top = R.ranked(found.select(*RUN, "entity_id", "s", "v"), RUN).select(*RUN, "entity_id", F.col("rank").alias("found"))
    right = truth.join(top, [*RUN, "entity_id"]).groupBy(*RUN).agg(F.count_if((F.col("rank") <= K) & (F.col("found") <= K)).alias("right"))
    return stops.join(right, RUN)


# --- designs -------------------------------------------------------------------------

_DESIGNS = """d as (select n::int as n, unnest(range(1, (power(2, n // 2))::bigint))::int as mask from (values (8), (10), (12)) as t(n)),
    s as (select n, mask, unnest(range(1, n // 2 + 1))::int as s from d), t as (select * from s where (mask >> (s - 1)) & 1 = 1),
    e as (select distinct n, mask, least(k, (k + s) % n) as i, greatest(k, (k + s) % n) as j from (select t.*, unnest(range(0, n))::int as k from t)),
    cnt as (select n, mask, count(*) as edges from e group by 1, 2), g as (select n, mask, list_reduce(list_prepend(n, list(s)), lambda a, b: gcd(a, b)) as own from t group by 1, 2),
    tri as (select a.n, a.mask, count(*) as triangles from e a join e b on a.n = b.n and a.mask = b.mask and b.i = a.j join e c on c.n = a.n and c.mask = a.mask and c.i = a.i and c.j = b.j group by 1, 2),
    ev as (select n, mask, k, sum(case when 2 * s = n then 1 - cos(2 * pi() * k * s / n) else 2 * (1 - cos(2 * pi() * k * s / n)) end) as v from (select t.*, unnest(range(1, n)) as k from t) group by 1, 2, 3),
    f as (select n, mask, min(v) as v from ev group by 1, 2)"""


@query(
    "design_atlas",
    f"""with {_DESIGNS} select cnt.n, cnt.mask, edges::int as edges, coalesce(triangles, 0)::int as triangles, own::int as components, (edges - cnt.n + own)::int as cycle_dim, round(greatest(v, 0), 5) + 0.0 as fiedler
    from cnt join g using (n, mask) join f using (n, mask) left join tri using (n, mask)""",
)
def design_atlas(spark, sf):
    """Every ring design of 8, 10 and 12 entities; the ring's eigenvalues have a closed form."""
    a = D.atlas(D.stride_sets(spark, (8, 10, 12)).repartition(8))
    return a.select("n", "mask", "edges", "triangles", "components", "cycle_dim", (F.round("fiedler", 5) + F.lit(0.0)).alias("fiedler"))
