"""Row-level work on judgements and prompts: parsing, keys, costs, perturbations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Answers of the two-sided templates.
MIN_RATIO, MAX_RATIO, ORDINAL_RATIO = 1.0, 26.0, 2.1
TEMPLATES = ("canonical_v2", "canonical_bucket_v1", "ordinal_v1", "less_v1", "fraction_v1")
#: Markup of an estimate, in percent, and the default comparisons for each entity and axis.
MARKUP, BUDGET_EACH = 20, 4
_REPLY = "higher_ranked string, winner string, ratio double, fraction double, confidence double, refused boolean"


def first_json_object(text: Column) -> Column:
    """The first flat JSON object in ``text``; null if there's none.  For nested ones use ``balanced_object``."""
    found = F.regexp_extract(text, r"(\{[^{}]*\})", 1)
    return F.when(found != "", found)


def balanced_object(text: str | None) -> str | None:
    """The first brace-balanced object of ``text``, braces in strings aside."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : at + 1]
        start = text.find("{", start + 1)
    return None


def parse_reply(reply: Column, template: Column) -> Column:
    """struct(higher_ranked, ratio, confidence, refused, error) of a reply in its template's format.

    A reply that can't be read is an error, never a default answer.
    """
    j = F.from_json(first_json_object(reply), _REPLY)
    side = F.upper(F.trim(F.coalesce(j["higher_ranked"], j["winner"])))
    known = side.isin("A", "B")
    other = F.when(side == "A", "B").when(side == "B", "A")
    ratio = (
        F.when(template == "ordinal_v1", F.lit(ORDINAL_RATIO))
        .when(template == "fraction_v1", F.when((j["fraction"] > 0) & (j["fraction"] <= 1), F.least(1 / j["fraction"], F.lit(MAX_RATIO))))
        .otherwise(j["ratio"])
    )
    refused = F.coalesce(j["refused"], F.lit(False))
    error = (
        F.when(j.isNull(), "no json").when(refused, F.lit(None)).when(~F.coalesce(known, F.lit(False)), "no side")
        .when(ratio.isNull() | F.isnan(ratio), "no ratio").when((ratio < MIN_RATIO) | (ratio > MAX_RATIO), "ratio out of range")
    )
    ok = error.isNull() & ~refused
    return F.struct(
        F.when(ok, F.when(template == "less_v1", other).otherwise(side)).alias("higher_ranked"),
        F.when(ok, ratio).alias("ratio"),
        F.when(ok, F.greatest(F.least(F.coalesce(j["confidence"], F.lit(1.0)), F.lit(1.0)), F.lit(0.0))).alias("confidence"),
        (refused | error.isNotNull()).alias("refused"),
        error.alias("error"),
    )


def xml_escaped(text: Column) -> Column:
    """The five characters of markup replaced."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def render(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by the escaped value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), xml_escaped(value))
    return out


def length_prefixed_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length in front."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(q.cast("string"), F.lit("")) for q in parts)]), 256)


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, of the text's UTF-8 bytes, as a signed long.

    In decimals, since a product of 64-bit numbers doesn't fit a long.
    """
    data = F.hex(F.encode(text, "UTF-8"))
    size = (F.length(data) / 2).cast("int")
    wide = lambda x: F.lit(x).cast("decimal(38,0)")
    prime, base, modulus = wide(str(2**40 + 435)), wide("14695981039346656037"), wide(str(2**64))

    def step(acc: Column, k: Column) -> Column:
        byte = F.conv(F.substring(data, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        low = F.pmod(acc, wide("256")).cast("int")
        mixed = acc + (low.bitwiseXOR(byte) - low).cast("decimal(4,0)")
        return F.pmod(mixed.cast("decimal(20,0)") * prime.cast("decimal(14,0)"), modulus.cast("decimal(20,0)")).cast("decimal(38,0)")

    hashed = F.when(size == 0, base).otherwise(F.aggregate(F.sequence(F.lit(0), size - 1), base, step))
    return F.when(hashed >= wide(str(2**63)), hashed - modulus).otherwise(hashed).cast("long")


def perturbed(text: Column, kind: Column) -> Column:
    """A text changed in form only: blanks, markup, bullets, a container, or a halo of praise."""
    return (
        F.when(kind == "whitespace", F.regexp_replace(text, " ", "  ")).when(kind == "markdown", F.concat(F.lit("**"), text, F.lit("**")))
        .when(kind == "bullet", F.concat(F.lit("- "), text)).when(kind == "container", F.concat(F.lit("<entry>"), text, F.lit("</entry>")))
        .when(kind == "halo", F.concat(F.lit("Award-winning: "), text)).otherwise(text)
    )


def jittered(text: Column, key: Column) -> Column:
    """Each blank widened to one to three by a hash of the key and its place; the words stay."""
    parts = F.split(text, " ")
    gap = lambda k: F.repeat(F.lit(" "), (F.pmod(F.xxhash64(key, k), F.lit(3)) + 1).cast("int"))
    return F.array_join(F.transform(parts, lambda w, k: F.when(k == 0, w).otherwise(F.concat(gap(k), w))), "")


def spun(prompt: Column, intensity: Column) -> Column:
    """A criterion framed for (above 0) or against its first 48 characters, in three strengths."""
    topic = F.substring(prompt, 1, 48)
    word = F.element_at(F.array(F.lit("Some say"), F.lit("Many hold"), F.lit("It is settled")), F.abs(intensity).cast("int"))
    verdict = F.when(intensity > 0, "that A has more of").otherwise("that B has more of")
    return F.when(intensity == 0, prompt).otherwise(F.concat(word, F.lit(" "), verdict, F.lit(": "), topic, F.lit(". "), prompt))


def negated(prompt: Column) -> Column:
    return F.concat(F.lit("lack of "), prompt)


def expand_experiments(axes: DataFrame, templates: list[str], variants: int) -> DataFrame:
    """Axes x polarity x template x variant, weights turned for the negative polarity; small tables on both sides."""
    rows = axes.withColumn("polarity", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("template_slug", F.explode(F.array(*[F.lit(t) for t in templates])))
    rows = rows.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    return rows.withColumns({"weight": F.coalesce("weight", F.lit(1.0)) * F.col("polarity"), "prompt": F.when(F.col("polarity") > 0, F.col("axis_prompt")).otherwise(negated(F.col("axis_prompt")))})


def token_cost(rows: DataFrame, prices: DataFrame, default_input: int = 1000, default_output: int = 3000) -> DataFrame:
    """Nanodollars of each row at list prices, exact or (unknown model) estimated; prices are a small dimension."""
    p = prices.select(F.col("model").alias("_m"), "input_nanodollars", "output_nanodollars")
    x = rows.join(p, rows["model"] == F.col("_m"), "left")
    price = F.coalesce("input_nanodollars", F.lit(default_input)) * F.col("input_tokens") + F.coalesce("output_nanodollars", F.lit(default_output)) * F.col("output_tokens")
    return x.withColumns({"list_cost": price, "estimated": F.col("input_nanodollars").isNull()}).drop("_m", "input_nanodollars", "output_nanodollars")


def cached_cost(prefix_tokens: Column, other_tokens: Column, price: Column, hit: Column, page: int = 128, hit_percent: int = 10, write_percent: int = 125) -> Column:
    """Input cost with a prefix cache: whole pages of the prefix cost less on a hit and more when written."""
    paged = F.floor(prefix_tokens / page) * page
    rest = prefix_tokens - paged + other_tokens
    percent = F.when(hit, hit_percent).otherwise(write_percent)
    return F.floor((paged * percent + rest * 100) * price / 100).cast("long")


def with_markup(nanodollars: Column, percent: int = MARKUP) -> Column:
    return F.ceil(nanodollars * (100 + percent) / 100).cast("long")


def default_budget(entities: Column, axes: Column) -> Column:
    return BUDGET_EACH * entities * axes


def model_policy(used: Column, error: Column, delta: Column, pair_std: Column, ladder: list[str]) -> Column:
    """The cheapest model at first, the strongest for close and uncertain pairs, the middle one between."""
    close = (F.abs(delta) <= 0.12) & (pair_std <= 0.6)
    return F.when(close, F.lit(ladder[-1])).when((used < 10) | (error > 0.2), F.lit(ladder[0])).otherwise(F.lit(ladder[len(ladder) // 2]))


def validate_request(entities: DataFrame, axes: DataFrame, k: int) -> list[str]:
    """What is wrong with a request; an empty list if nothing is."""
    problems = []
    n, m = entities.count(), axes.count()
    if not 2 <= n <= 5000:
        problems.append(f"{n} entities; 2 to 5000 are possible")
    if not 1 <= m <= 256:
        problems.append(f"{m} axes; 1 to 256 are possible")
    if not 1 <= k <= max(n, 1):
        problems.append(f"k = {k} of {n} entities")
    for frame, what in ((entities, "entity_id"), (axes, "axis_key")):
        twice = frame.groupBy(what).count().filter("count > 1").orderBy(what).first()
        if twice is not None:
            problems.append(f"{what} {twice[0]} is there {twice[1]} times")
    return problems


def warnings_of(refused_share: Column, error_share: Column, cached_share: Column) -> Column:
    """Warnings of a run report, as an array."""
    return F.array_compact(F.array(
        F.when(refused_share > 0.05, "many refusals"), F.when(error_share > 0.05, "many errors"), F.when(cached_share > 0.5, "mostly cached"),
    ))


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEMPLATES], "template_slug string")
