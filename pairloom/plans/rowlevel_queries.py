"""Queries of the row-level operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import evidence as E
from pairloom.operators import rowlevel as L
from pairloom.plans.registry import CUR, EDGES, OBS, query, table
from pairloom.session import scratch_dir
from pairloom.sources import cache as C
from pairloom.sources import files, packets

_REPLIES = """replies as (select delivery_id, (array['canonical_v2', 'ordinal_v1', 'less_v1', 'fraction_v1'])[1 + delivery_id % 4] as template, higher_ranked as side, case when not isnan(ratio) then ratio end as ratio, confidence, refused, error from comparisons)"""


@query(
    "parse_judgement_json",
    f"""with {_REPLIES}, p as (select *, case template when 'ordinal_v1' then 2.1 when 'fraction_v1' then case when 1 / ratio > 0 and 1 / ratio <= 1 then least(1 / (1 / ratio), 26) end else ratio end as r from replies),
    e as (select *, case when error <> '' then 'no json' when refused = 1 then null when side not in ('A', 'B') then 'no side' when r is null then 'no ratio' when r < 1 or r > 26 then 'ratio out of range' end as err from p)
    select delivery_id, case when err is null and refused = 0 then case when template = 'less_v1' then case side when 'A' then 'B' else 'A' end else side end end as higher_ranked,
        round(case when err is null and refused = 0 then r end, 6) as ratio, (refused = 1 and error = '') or err is not null as refused, err as error from e""",
)
def parse_judgement_json(spark, sf):
    """Replies in prose around JSON, written from the landed rows in each template's format and read back."""
    # JSON has no word for a number that isn't one: such a ratio is written as null
    rows = table(spark, sf, "comparisons").withColumn("ratio", F.when(~F.isnan("ratio"), F.col("ratio")))
    template = F.element_at(F.array(*[F.lit(t) for t in ("canonical_v2", "ordinal_v1", "less_v1", "fraction_v1")]), (F.col("delivery_id") % 4 + 1).cast("int"))
    rows = rows.withColumn("template", template)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    amount = F.when(F.col("template") == "fraction_v1", F.concat(F.lit('"fraction": '), number(F.when(F.col("ratio") != 0, 1 / F.col("ratio"))))).otherwise(F.concat(F.lit('"ratio": '), number(F.col("ratio"))))
    reply = F.concat(F.lit('Here: {"higher_ranked": "'), "higher_ranked", F.lit('", '), amount, F.lit(', "confidence": '), number(F.col("confidence")), F.lit(', "refused": '), F.when(F.col("refused") == 1, "true").otherwise("false"), F.lit("} as asked."))
    rows = rows.withColumn("reply", F.when(F.col("error") != "", F.col("error")).otherwise(reply))
    p = rows.withColumn("p", L.parse_reply(F.col("reply"), F.col("template")))
    return p.select("delivery_id", "p.higher_ranked", F.round("p.ratio", 6).alias("ratio"), "p.refused", "p.error")


@query(
    "prompt_render",
    """select axis_key, '<criterion>' || replace(replace(replace(replace(replace(axis_prompt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</criterion>' as prompt, sha256(length(axis_key)::varchar || ':' || axis_key || length(axis_prompt)::varchar || ':' || axis_prompt) as digest from axes""",
)
def prompt_render(spark, sf):
    a = table(spark, sf, "axes")
    return a.select("axis_key", L.render("<criterion>{criterion}</criterion>", criterion=F.col("axis_prompt")).alias("prompt"), L.length_prefixed_digest(F.col("axis_key"), F.col("axis_prompt")).alias("digest"))


@query(
    "prompt_routing_key",
    """with b as (select axis_key, hex(encode(axis_prompt)) as h from axes),
    l as (select axis_key, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::int, 2))::hugeint) as bytes from b),
    f as (select axis_key, list_reduce(list_prepend(14695981039346656037::hugeint, bytes), lambda a, x: (xor(a, x) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as v from l)
    select axis_key, (case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint else v end)::bigint as routing_key from f""",
)
def prompt_routing_key(spark, sf):
    """FNV-1a of each rendered prompt (checked against a plain loop in the tests)."""
    return table(spark, sf, "axes").select("axis_key", L.fnv1a64(F.col("axis_prompt")).alias("routing_key"))


_KINDS = ["none", "whitespace", "markdown", "bullet", "container", "halo"]


@query(
    "text_perturbations",
    """select entity_id, kind, case kind when 'whitespace' then replace(entity_text, ' ', '  ') when 'markdown' then '**' || entity_text || '**' when 'bullet' then '- ' || entity_text
        when 'container' then '<entry>' || entity_text || '</entry>' when 'halo' then 'Award-winning: ' || entity_text else entity_text end as text
    from entities, (values ('none'), ('whitespace'), ('markdown'), ('bullet'), ('container'), ('halo')) as k(kind)""",
)
def text_perturbations(spark, sf):
    e = table(spark, sf, "entities").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in _KINDS])))
    return e.select("entity_id", "kind", L.perturbed(F.col("entity_text"), F.col("kind")).alias("text"))


@query("whitespace_jitter", "select entity_id, regexp_replace(entity_text, ' +', ' ', 'g') as words from entities")
def whitespace_jitter(spark, sf):
    """Jittered texts with their blanks closed up again: the words are untouched."""
    j = table(spark, sf, "entities").withColumn("t", L.jittered(F.col("entity_text"), F.col("entity_id")))
    return j.select("entity_id", F.regexp_replace("t", " +", " ").alias("words"))


@query(
    "criterion_spin",
    """select axis_key, n as intensity, case when n = 0 then axis_prompt else (array['Some say', 'Many hold', 'It is settled'])[abs(n)] || ' ' || case when n > 0 then 'that A has more of' else 'that B has more of' end || ': ' || left(axis_prompt, 48) || '. ' || axis_prompt end as prompt
    from axes, (select unnest(range(-3, 4))::int as n)""",
)
def criterion_spin(spark, sf):
    a = table(spark, sf, "axes").withColumn("intensity", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    return a.select("axis_key", "intensity", L.spun(F.col("axis_prompt"), F.col("intensity")).alias("prompt"))


@query(
    "experiment_matrix",
    """select axis_key, p::int as polarity, t as template_slug, v::int as variant, coalesce(weight, 1) * p as weight, case when p > 0 then axis_prompt else 'lack of ' || axis_prompt end as prompt
    from axes, (values (1), (-1)) as a(p), (values ('canonical_v2'), ('ordinal_v1')) as b(t), (values (1), (2), (3)) as c(v)""",
)
def experiment_matrix(spark, sf):
    return L.expand_experiments(table(spark, sf, "axes"), ["canonical_v2", "ordinal_v1"], 3).select("axis_key", "polarity", "template_slug", "variant", "weight", "prompt")


@query(
    "cost_by_model",
    """select c.model, count(*) as calls, coalesce(sum(input_nanodollars * input_tokens + output_nanodollars * output_tokens), 0)::bigint as list_cost,
        coalesce(sum(cost_nanodollars), 0)::bigint as landed_cost, count_if(cost_nanodollars is null) as unpriced from comparisons c join judges j on c.model = j.model group by 1""",
)
def cost_by_model(spark, sf):
    x = L.token_cost(table(spark, sf, "comparisons").select("model", "input_tokens", "output_tokens", "cost_nanodollars"), table(spark, sf, "judges"))
    return x.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("list_cost"), F.lit(0)).alias("list_cost"), F.coalesce(F.sum("cost_nanodollars"), F.lit(0)).alias("landed_cost"), F.count_if(F.col("cost_nanodollars").isNull()).alias("unpriced"))


@query(
    "cache_aware_cost",
    """select c.model, sum(((input_tokens // 2) // 128 * 128 * case when cached = 1 then 10 else 125 end + (input_tokens - (input_tokens // 2) // 128 * 128) * 100) * input_nanodollars // 100)::bigint as input_cost, count_if(input_tokens is null) as without_tokens
    from comparisons c join judges j on c.model = j.model group by 1""",
)
def cache_aware_cost(spark, sf):
    c, j = table(spark, sf, "comparisons"), table(spark, sf, "judges").select("model", "input_nanodollars")
    half = F.floor(F.col("input_tokens") / 2)
    x = c.join(j, "model").withColumn("x", L.cached_cost(half, F.col("input_tokens") - half, F.col("input_nanodollars"), F.col("cached") == 1))
    return x.groupBy("model").agg(F.sum("x").alias("input_cost"), F.count_if(F.col("input_tokens").isNull()).alias("without_tokens"))


@query(
    "worst_case_charge",
    """with t as (select lens, length(entity_text) as n, row_number() over (partition by lens order by length(entity_text) desc) as k, count(*) over (partition by lens) as entities from entities)
    select lens, 4 * any_value(entities) as budget, sum(n)::bigint as two_longest, ceil(4 * any_value(entities) * sum(n) * 900 * 120 / 100.0)::bigint as charge from t where k <= 2 group by 1""",
)
def worst_case_charge(spark, sf):
    """Budget x the two longest texts at the dearest input price, with markup; the two longest by a bounded aggregate."""
    from pyspark.sql import Window

    # two-level: the two longest of each slice first, so that no lens is sorted in one task
    e = table(spark, sf, "entities").select("lens", F.length("entity_text").alias("n"), F.pmod(F.xxhash64("entity_id"), F.lit(64)).alias("slice"))
    top = lambda d, *k: d.withColumn("_k", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("n")))).filter("_k <= 2").drop("_k")
    longest = top(top(e, "lens", "slice"), "lens").groupBy("lens").agg(F.sum("n").cast("long").alias("two_longest"))
    counts = e.groupBy("lens").agg(F.count(F.lit(1)).alias("entities"))
    x = counts.join(longest.withColumnRenamed("lens", "_l"), F.col("lens").eqNullSafe(F.col("_l"))).withColumn("budget", L.default_budget(F.col("entities"), F.lit(1)))
    return x.select("lens", "budget", "two_longest", L.with_markup(F.col("budget") * F.col("two_longest") * 900).alias("charge"))


@query(
    "model_policy",
    f"""with {EDGES} select case when abs(mu) <= 0.12 and 1 / sqrt(lam) <= 0.6 then 'strong' when lam < 10 then 'cheap' else 'middle' end as model, count(*) as pairs from edges group by 1""",
)
def model_policy(spark, sf):
    edges = E.fuse(E.observations(table(spark, sf, "comparisons")), "axis_key")
    pick = L.model_policy(F.col("lam"), F.lit(0.0), F.col("mu"), 1 / F.sqrt("lam"), ["cheap", "middle", "strong"])
    return edges.groupBy(pick.alias("model")).agg(F.count(F.lit(1)).alias("pairs"))


_KEY = "(model, template_slug, template_hash, axis_key, axis_prompt_hash, entity_a_hash, entity_b_hash, swapped, temperature)"


@query(
    "cache_upsert",
    f"""select count(*) as uses, min(observed_at) as created_at, max(observed_at) as updated_at from comparisons group by {_KEY}""",
)
def cache_upsert(spark, sf):
    """The cache after half of the rows, then after all: uses and times of each key."""
    rows = table(spark, sf, "comparisons")
    half = F.col("delivery_id") % 2 == 0
    c = C.upsert(C.upsert(None, rows.filter(half)), rows.filter(~half))
    return c.select((F.col("hit_count") + 1).alias("uses"), "created_at", "updated_at")


@query(
    "cache_hit_miss",
    f"""with seen as (select distinct {_KEY} as k from comparisons where month(landed_at) <= 2), req as (select lens, {_KEY} as k from comparisons where month(landed_at) > 2)
    select lens, count_if(k in (select k from seen)) as hits, count_if(k not in (select k from seen)) as misses from req group by 1""",
)
def cache_hit_miss(spark, sf):
    rows = table(spark, sf, "comparisons")
    early = F.month("landed_at") <= 2
    hits, misses = C.lookup(rows.filter(~early), C.upsert(None, rows.filter(early)))
    both = hits.select("lens", F.lit(1).alias("h"), F.lit(0).alias("m")).unionByName(misses.select("lens", F.lit(0).alias("h"), F.lit(1).alias("m")))
    return both.groupBy("lens").agg(F.sum("h").alias("hits"), F.sum("m").alias("misses"))


@query(
    "cache_prune",
    f"""with c as (select {_KEY} as k, max(observed_at) as updated_at from comparisons group by {_KEY})
    select updated_at from c where updated_at >= timestamp '2026-02-01' order by updated_at desc limit 500""",
)
def cache_prune(spark, sf):
    """The 500 newest entries since February."""
    return C.prune(C.upsert(None, table(spark, sf, "comparisons")), "2026-02-01", 500).select("updated_at")


@query(
    "resume_missing",
    "select axis_key from axes where axis_key not in (select axis_key from comparisons where higher_ranked in ('A', 'B') and error = '' group by 1 having count(*) >= 1500)",
)
def resume_missing(spark, sf):
    c = table(spark, sf, "comparisons").filter(F.col("higher_ranked").isin("A", "B") & (F.col("error") == ""))
    return files.resume_set(table(spark, sf, "axes").select("axis_key"), c, "axis_key", 1500)


@query("landing_idempotent", "select run_id, count(*) as n from comparisons group by 1")
def landing_idempotent(spark, sf):
    """Runs landed twice over: the second landing adds nothing."""
    path, rows = scratch_dir(spark, "landing"), table(spark, sf, "comparisons").select("run_id", "delivery_id")
    files.land(spark, rows, path)
    files.land(spark, rows, path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("trace_replay", f"with {EDGES} select axis_key, i, j, round(mu, 6) + 0.0 as mu, lam from edges")
def trace_replay(spark, sf):
    """Observations written as JSON traces, read back and fused."""
    o = E.observations(table(spark, sf, "comparisons"), "comparison_index")
    path = scratch_dir(spark, "traces")
    up = F.col("m") >= 0
    files.append_traces(o.select(F.col("run").alias("run_id"), "axis_key", "model", "comparison_index", F.col("i").alias("entity_a_id"), F.col("j").alias("entity_b_id"), F.when(up, "A").otherwise("B").alias("higher_ranked"), F.exp(F.abs("m")).alias("ratio")), path)
    t = files.read_traces(spark, path)
    back = t.select("axis_key", F.col("entity_a_id").alias("i"), F.col("entity_b_id").alias("j"), (F.when(F.col("higher_ranked") == "A", 1).otherwise(-1) * F.log("ratio")).alias("m"))
    return E.fuse(back, "axis_key").select("axis_key", "i", "j", (F.round("mu", 6) + F.lit(0.0)).alias("mu"), "lam")


@query("packet_union", f"with {EDGES} select axis_key, i, j, round(mu, 6) + 0.0 as mu, lam from edges")
def packet_union(spark, sf):
    """Packets delivered twice and merged: redelivery changes nothing."""
    o = E.observations(table(spark, sf, "comparisons"), "comparison_index", "delivery_id")
    p = packets.packets_of(o)
    return packets.merge(p.unionByName(p)).select("axis_key", "i", "j", (F.round("mu", 6) + F.lit(0.0)).alias("mu"), "lam")


@query(
    "packet_conflicts",
    "with e as (select entity_a_id as entity_id, lower(trim(entity_a_hash)) as h from comparisons union select entity_b_id, lower(trim(entity_b_hash)) from comparisons) select entity_id, count(distinct h) as contents from e group by 1 having count(distinct h) > 1",
)
def packet_conflicts(spark, sf):
    c = E.current(table(spark, sf, "comparisons"), "entity_a_id", "entity_b_id", "ah", "bh")
    both = c.select(F.explode(F.array(F.struct(F.col("entity_a_id").alias("entity_id"), F.col("ah").alias("entity_hash")), F.struct(F.col("entity_b_id").alias("entity_id"), F.col("bh").alias("entity_hash")))).alias("x")).select("x.*")
    return packets.conflicts(both)


@query(
    "run_report",
    f"""with {CUR}, r as (select run, count(*) as n, avg(refused) as rf, avg((error <> '')::int) as er, avg(cached) as ca from cur group by 1)
    select run, n as comparisons, array_to_string(list_filter([case when rf > 0.05 then 'many refusals' end, case when er > 0.05 then 'many errors' end, case when ca > 0.5 then 'mostly cached' end], lambda x: x is not null), ', ') as warnings from r""",
)
def run_report(spark, sf):
    c = E.current(table(spark, sf, "comparisons"), "refused", "error", "cached")
    r = c.groupBy("run").agg(F.count(F.lit(1)).alias("comparisons"), F.avg("refused").alias("rf"), F.avg((F.col("error") != "").cast("int")).alias("er"), F.avg("cached").alias("ca"))
    return r.select("run", "comparisons", F.array_join(L.warnings_of(F.col("rf"), F.col("er"), F.col("ca")), ", ").alias("warnings"))
