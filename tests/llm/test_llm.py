"""Training-data operators against brute force, round trips and held-out truth."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairloom.llm import annotators, contamination, leximin, luce, percentiles, ranking, textnorm, tokens, topics


# --- ranking -------------------------------------------------------------


def newton(n, wins):
    """Maximum-likelihood log-strengths of a connected graph; wins[a, b]: what a won over b."""
    x = np.zeros(n)
    for _ in range(100):
        p = 1 / (1 + np.exp(x[None, :] - x[:, None]))
        met = wins + wins.T
        grad = wins.sum(1) - (met * p).sum(1)
        h = met * p * (1 - p)
        hess = np.diag(h.sum(1)) - h
        step = np.linalg.solve(hess + np.ones((n, n)), grad)
        x += step
        if np.abs(step).max() < 1e-12:
            break
    return x - x.mean()


def tournament(seed, n=14, games=120):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=n)
    rows = []
    for k in range(games):
        a, b = (0, int(rng.integers(1, n))) if k % 3 == 0 else map(int, rng.choice(n, 2, replace=False))
        a_won = bool(rng.random() < 1 / (1 + math.exp(s[b] - s[a])))
        rows.append((a, b, a_won, [None, float("nan"), 0.0, 0.5, 2.0, 7.5, 1e12][int(rng.integers(7))]))
    for k in range(n):  # a ring both ways, so that the maximum exists with whole wins
        rows += [(k, (k + 1) % n, True, 2.0), (k, (k + 1) % n, False, 2.0)]
    return n, rows


def weights_of(n, rows, use_ratio):
    ok = [min(r, ranking.MOST_RATIO) for *_, r in rows if r is not None and r == r and r > 1]
    mean = np.mean([r / (1 + r) for r in ok]) if use_ratio else 1.0
    wins = np.zeros((n, n))
    for a, b, a_won, r in rows:
        good = r is not None and r == r and r > 1
        share = (min(r, ranking.MOST_RATIO) / (1 + min(r, ranking.MOST_RATIO)) if good else mean) if use_ratio else 1.0
        w, l = (a, b) if a_won else (b, a)
        wins[w, l] += share
        wins[l, w] += 1 - share
    return wins


@pytest.mark.parametrize("use_ratio", [True, False])
@pytest.mark.parametrize("block_ends", [10_000, 24])
def test_strengths_are_the_maximum_likelihood(spark, use_ratio, block_ends):
    n, rows = tournament(3)
    df = spark.createDataFrame([("x", f"e{a:02d}", f"e{b:02d}", w, r) for a, b, w, r in rows], "axis_key string, a string, b string, a_won boolean, ratio double")
    rounds = []
    found = ranking.luce_strengths(ranking.pair_weights(df, use_ratio), block_ends=block_ends, report=rounds)
    assert len(rounds) <= 20 and rounds[-1][1] == 0
    got = {r["entity_id"]: r for r in ranking.rank_entities(found).collect()}
    want = newton(n, weights_of(n, rows, use_ratio))
    for k in range(n):
        assert got[f"e{k:02d}"]["log_strength"] == pytest.approx(want[k], abs=2e-5)
    assert all(r["converged"] for r in got.values())
    order = sorted(got, key=lambda e: -got[e]["log_strength"])
    assert [got[e]["rank"] for e in order] == list(range(1, n + 1))


def test_a_round_leaves_one_row_a_block_and_hubs_that_meet_are_right(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 14
    rows = [(a, b, bool(rng.random() < 0.5), 2.0) for a in (0, 1) for b in range(n) if a < b]  # 0 and 1 meet all, each other too
    rows += [(k, k % (n - 2) + 2, True, 3.0) for k in range(2, n)]
    df = spark.createDataFrame([("x", f"e{a:02d}", f"e{b:02d}", w, r) for a, b, w, r in rows], "axis_key string, a string, b string, a_won boolean, ratio double")
    left, drop = [], ranking.drop_path

    def dropped(spark, path):
        if "ranking-round" in path:
            kept = spark.read.parquet(path).filter("part not in ('sums', 'hubs')")
            left.append((kept.count(), kept.select("part").distinct().count()))
        drop(spark, path)

    monkeypatch.setattr(ranking, "drop_path", dropped)
    found = ranking.luce_strengths(ranking.pair_weights(df), block_ends=24)
    assert left and all(a == b > 1 for a, b in left)
    got = {r["entity_id"]: r["log_strength"] for r in ranking.rank_entities(found).collect()}
    want = newton(n, weights_of(n, rows, True))
    assert [got[f"e{k:02d}"] for k in range(n)] == pytest.approx(list(want), abs=2e-5)


def test_rounds_that_run_out_are_told(spark):
    n, rows = tournament(3)
    df = spark.createDataFrame([("x", f"e{a:02d}", f"e{b:02d}", w, r) for a, b, w, r in rows], "axis_key string, a string, b string, a_won boolean, ratio double")
    with pytest.warns(UserWarning, match="1 axes"):
        found = ranking.luce_strengths(ranking.pair_weights(df), block_ends=24, rounds=2)
    assert {r["converged"] for r in found.collect()} == {False} and found.count() == n


def test_components_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "a", "b", True, 3.0), ("x", "c", "d", False, 2.0), ("y", "a", "c", True, None)], "axis_key string, a string, b string, a_won boolean, ratio double")
    got = {(r["axis_key"], r["entity_id"]): r for r in ranking.rank_entities(ranking.luce_strengths(ranking.pair_weights(df))).collect()}
    assert got["x", "a"]["strength"] / got["x", "b"]["strength"] == pytest.approx(3.0, rel=1e-6)
    assert got["x", "d"]["strength"] / got["x", "c"]["strength"] == pytest.approx(2.0, rel=1e-6)
    assert got["x", "a"]["component"] == "a" and got["x", "d"]["component"] == "c" and got["y", "a"]["component_size"] == 2
    assert ranking.rank_entities(ranking.luce_strengths(ranking.pair_weights(df.limit(0)))).count() == 0


def test_stationary_flow():
    rng = np.random.default_rng(0)
    p = rng.random((80, 80)) * (rng.random((80, 80)) < 0.1) + np.eye(80, k=1) + np.eye(80, k=-79)
    p /= p.sum(1, keepdims=True)
    src, dst = np.nonzero(p)
    x = luce.stationary(src, dst, p[src, dst], np.ones(80), np.zeros(80), 1e-12)
    assert np.allclose(x @ p, x, atol=1e-9) and x.sum() == pytest.approx(80)


# --- percentiles and leximin ---------------------------------------------


def test_percentiles_of_hot_groups_and_merged_days(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", None]), k % 7, rng.choice([None, float("nan"), 5.0, 5.0, rng.random() * 1e9, float(rng.randrange(9))])) for k in range(2000)]
    df = spark.createDataFrame([*rows, ("empty", 0, None)], "g string, day int, v double")
    state = percentiles.merge([percentiles.summarise(df.filter(f"day = {d}"), ["g"], ["v"]) for d in range(7)], ["g"])
    got = {(r["g"], r["p"]): r for r in percentiles.percentiles(state, ["g"]).collect()}
    for g in ("hot", "a", None):
        own = sorted(v for k, _, v in rows if k == g and v is not None and v == v)
        for p in percentiles.PERCENTILES:
            assert got[g, p]["value"] == pytest.approx(np.quantile(own, p), rel=1e-12) and got[g, p]["n"] == len(own)
    assert not any(g == "empty" for g, _ in got)
    assert percentiles.percentiles(percentiles.summarise(df.limit(0), ["g"], ["v"]), ["g"]).count() == 0


def test_leximin_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for e in range(40):
        for axis, scale in (("a", 1.0), ("b", 1e6), ("c", 1e-3)):
            if rng.random() < 0.8:
                for run in range(rng.randrange(1, 3)):
                    rows.append((f" R{run}" if e % 2 else f"r{run}", f"e{e}", axis, rng.choice([None, float("nan"), *[scale * rng.randrange(-3, 4) for _ in range(5)]]), e))
    df = spark.createDataFrame([*rows, *rows[:9]], "run_id string, entity_id string, axis_key string, latent_mean double, scored_at int")
    good = {(r.strip().lower(), e, a): v for r, e, a, v, _ in rows if v is not None and v == v}
    pct = {}
    for (r, e, a), v in good.items():
        own = [x for (_, _, b), x in good.items() if b == a]
        pct.setdefault((e, a), []).append((sum(x < v for x in own) + sum(x == v for x in own) / 2) / len(own))
    vec = {}
    for (e, a), ps in pct.items():
        vec.setdefault(e, []).append(round(sum(ps) / len(ps), 9))
    vec = {e: sorted(v + [0.5] * (3 - len(v))) for e, v in vec.items()}
    got = {r["entity_id"]: r["rank"] for r in leximin.leximin(leximin.axis_percentiles(df), 3).collect()}
    assert got == {e: 1 + sum(w > v for w in vec.values()) for e, v in vec.items()}


# --- annotators -----------------------------------------------------------


def test_consensus_recovers_planted_truth(spark):
    rng = np.random.default_rng(4)
    kinds = {"good1": (0.95, 0.05), "good2": (0.9, 0.1), "good3": (0.9, 0.1), "always_a1": (0.97, 0.95), "always_a2": (0.95, 0.97), "always_a3": (0.96, 0.96), "wrong": (0.15, 0.85), "few": (0.9, 0.1)}
    rows, truth = [], {}
    for k in range(300):
        truth[f"{k:03d}"] = bool(rng.random() < 0.5)
        for m, (if_a, if_b) in kinds.items():
            if m == "few" and k >= 8:
                continue
            a_is_lo = bool(rng.random() < 0.5)
            a_true = a_is_lo == truth[f"{k:03d}"]
            rows.append(("x", f"{k:03d}", f"{k:03d}z", m, a_is_lo, bool(rng.random() < (if_a if a_true else if_b))))
    votes = spark.createDataFrame(rows, "axis_key string, lo string, hi string, model string, a_is_lo boolean, vote_a boolean")
    got = annotators.consensus(votes)
    right = np.mean([(r["log_odds"] > 0) == truth[r["lo"]] for r in got.items.collect()])
    by = {a["model"]: a for a in got.annotators.collect()}
    assert right > 0.97 and got.converged
    assert by["wrong"]["accuracy"] < 0.3 and by["good1"]["accuracy"] > 0.9 and by["always_a1"]["reliability"] < 0.05 < by["good2"]["reliability"]
    assert by["few"]["says_a_if_a"] > 0.75  # a member of the good community with eight votes only
    assert annotators.consensus(votes.limit(0)).items.count() == 0


def test_confidence_counts_for_what_it_is_worth(spark):
    """Two models that are right only when sure, one that is always sure: the sure ones' votes decide."""
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for k in range(400):
        item = f"{k:03d}"
        truth[item] = bool(rng.random() < 0.5)
        for m in ("m1", "m2", "m3", "m4"):
            sure, a_is_lo = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
            right = rng.random() < (0.98 if sure else 0.5)
            rows.append(("x", item, item + "z", m, a_is_lo, (a_is_lo == truth[item]) == right, (95.0 if k % 2 else 0.95) if sure else [0.5, None][k % 2]))
    votes = spark.createDataFrame(rows, "axis_key string, lo string, hi string, model string, a_is_lo boolean, vote_a boolean, confidence double")
    score = lambda v: np.mean([(r["log_odds"] > 0) == truth[r["lo"]] for r in annotators.consensus(v).items.collect()])
    assert score(votes) > score(votes.drop("confidence")) + 0.02


def test_votes_that_count(spark):
    base = dict(run_id="r", comparison_index=1, entity_a_hash="B", entity_b_hash=" a ", observed_at=1, delivery_id=1, lens="Panel", axis_key="x", model="m", refused=0, error="", higher_ranked="A", confidence=50.0)
    rows = [base, base | {"comparison_index": 2, "refused": 1}, base | {"comparison_index": 3, "error": "e"}, base | {"comparison_index": 4, "higher_ranked": ""}, base | {"comparison_index": 5, "lens": "other"}, base | {"comparison_index": 6, "entity_b_hash": "b"}, base | {"observed_at": 0, "delivery_id": 2, "higher_ranked": "B"}]
    got = annotators.usable_votes(spark.createDataFrame(pd.DataFrame(rows))).collect()
    assert [(r["lo"], r["hi"], r["a_is_lo"], r["vote_a"]) for r in got] == [("a", "b", False, True)]
    w = spark.createDataFrame([(50.0,), (0.5,), (-1.0,), (None,), (float("nan"),), (500.0,)], "c double").select(annotators.vote_weight(F.col("c")).alias("w")).collect()
    assert [r["w"] for r in w] == [0.5, 0.5, None, None, None, None]


# --- tokens ---------------------------------------------------------------

TEXTS = [None, "", " ", "a", "Hello  world\n\n it's <|endoftext|> 123,456 ünïcödé 日本語 🙂‍🔥 ​ x\t\t", "word " * 3000, "def f(x):\n    return x\r\n", "a", "   　", "don't we'll THEY'RE 'tis", "٣٤ ½ ² Ⅷ 𝔘𝔫𝔦"]


def test_ids_are_the_tokenizers(spark):
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    rows = [(k // 2, x) for k, x in enumerate(TEXTS)]  # ids occur twice
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode(df).collect())
    assert got == sorted((k, t.encode(x, add_special_tokens=False).ids if x else []) for k, x in rows)
    back = sorted((r["doc_id"], r["text"]) for r in tokens.decode(tokens.encode(df)).collect())
    assert back == sorted((k, x or "") for k, x in rows)
    assert tokens.encode(df.limit(0)).count() == 0 and tiktoken


def test_chunks_close_by_size(spark, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10)
    df = spark.createDataFrame(list(enumerate(["some words here", "and there", None, "some words"])), "doc_id long, text string").coalesce(1)
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {0: "some words here", 1: "and there", 2: "", 3: "some words"}


# --- leaks ----------------------------------------------------------------

VOCAB = [f"w{k}" for k in range(60)]


def longest_passage(item, doc, least, every):
    """By trying every start: the longest passage within the limits that begins and ends with a word in common."""
    best = 0
    for a in range(len(item)):
        for b in range(len(doc)):
            if item[a] != doc[b]:
                continue
            cost = {(a, b): 0}
            frontier = [(a, b)]
            table = {}
            for i, j in itertools.product(range(a, len(item)), range(b, min(len(doc), b + 2 * len(item)))):
                if (i, j) == (a, b):
                    table[i, j] = 0
                    continue
                options = [table.get((i - 1, j - 1), 99) + (item[i] != doc[j]), table.get((i - 1, j), 99) + 1, table.get((i, j - 1), 99) + 1]
                table[i, j] = min(options)
                n = i - a + 1
                if item[i] == doc[j] and table.get((i - 1, j - 1), 99) == table[i, j] and n >= least and table[i, j] * every <= n:
                    best = max(best, n)
            assert cost and frontier
    return best


def test_scan_finds_what_brute_force_finds():
    rng = random.Random(6)
    items = [[rng.choice(VOCAB) for _ in range(rng.randrange(12, 22))] for _ in range(4)]
    index = contamination.build_index([(k, "question", w) for k, w in enumerate(items)])
    hits = 0
    for _ in range(60):
        doc = [rng.choice(VOCAB) for _ in range(6)]
        for w in rng.choice(items):
            roll = rng.random()
            doc += [] if roll < 0.05 else [rng.choice(VOCAB)] if roll < 0.1 else [w, rng.choice(VOCAB)] if roll < 0.15 else [w]
        doc += [rng.choice(VOCAB) for _ in range(6)]
        found = {s for s, *_ in contamination.scan([index.vocabulary.get(w, -1) for w in doc], index)}
        want = {k for k, item in enumerate(items) if longest_passage(item, doc, 12, 6) >= 12}
        hits += len(want)
        assert found == want
    assert hits > 20


def test_suffix_automaton_knows_every_passage():
    rng = random.Random(7)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
    a = contamination.SuffixAutomaton(texts)
    for length in (1, 2, 3, 5):
        for probe in itertools.islice(itertools.product(range(4), repeat=length), 200):
            state = 0
            for w in probe:
                state = a.next[state].get(w) if state is not None else None
            want = sorted((k, e) for k, t in enumerate(texts) for e in range(length - 1, len(t)) if tuple(t[e - length + 1 : e + 1]) == probe)
            assert (sorted(a.ends[state]) if state is not None else []) == want


def test_variants_of_spelling_are_no_changes(spark):
    q = "Café managers in Straße nine weigh efficient ﬁlters before the carbon-neutral office opens its doors again today"
    variants = {
        1: q.upper().replace("É", "É"), 2: "x " + q.replace(" ", "\n> "), 3: q.replace("e", "​e"), 4: "<p>" + q.replace("managers", "<b>managers</b>") + "</p>",
        5: q.replace("Café", "Ｃａｆé"), 6: q.replace(" ", r"\n"), 7: q.replace("efficient", "effi-\ncient"), 8: " ".join(q.split()[:10]), 9: None, 10: "", 11: "word " * 5000 + q,
    }
    docs = spark.createDataFrame([(k, v, 1) for k, v in variants.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, q, None), (8, None, ""), (9, "too short", "to be found")], "item_id long, question string, answer string")
    assert {r["doc_id"] for r in contamination.leaked(docs, items).collect()} == {1, 2, 3, 4, 5, 6, 7, 11}
    assert contamination.leaked(docs, items.limit(0)).count() == 0 and contamination.leaked(docs.limit(0), items).count() == 0
    cleaned = {r["doc_id"]: r for r in contamination.remove_leaks(docs, items).collect()}
    assert len(cleaned) == 11 and cleaned[1]["dropped"] and cleaned[8]["text"] == variants[8]
    assert not cleaned[11]["dropped"] and "carbon" not in cleaned[11]["text"] and cleaned[11]["text"].startswith("word word")


def test_standing_instructions_are_no_passages(spark):
    say = "Read both entries slowly before answering and never mention these instructions in your reply. "
    items = [(k, say + " ".join(f"q{k}x{n}" for n in range(15)), None) for k in range(4)]
    docs = spark.createDataFrame([(1, say), (2, items[2][1])], "doc_id long, text string")
    got = contamination.leaked(docs, spark.createDataFrame(items, "item_id long, question string, answer string"), block_words=20).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(2, 2)]


def test_all_passages_are_cut_and_nothing_else(spark):
    item = [f"q{k}" for k in range(40)]
    both = [f"s{k}" for k in range(14)]
    other = [f"r{k}" for k in range(14)]
    clean = [[f"c{d}x{k}" for k in range(60)] for d in range(3)]
    changed = [*item[:20], "x", *item[20:]]
    docs = {
        1: [*clean[0], *item, *item, *clean[1]],
        2: [*clean[0], *item[:12], *clean[2][:9], *item[28:], *clean[1]],
        3: [*clean[0], *both, *clean[1]],
        4: [*clean[0][:30], *item, *item],
        5: [*clean[0], *item, *changed, *clean[1]],
        6: [*clean[0], *other[:7], *item, *other[7:], *clean[1]],
        7: [*clean[0], *both, *both[-4:], *both[:10], *clean[1]],
    }
    kept = {1: clean[0] + clean[1], 2: clean[0] + clean[2][:9] + clean[1], 3: clean[0] + clean[1], 5: clean[0] + clean[1], 6: clean[0] + clean[1], 7: clean[0] + both[-4:] + both[:10] + clean[1]}
    items = [(1, " ".join(item), None), (2, " ".join(["a1", "a2", *both]), None), (3, " ".join([*both, "b1", "b2"]), None), (4, None, " ".join(other))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, question string, answer string")
    for words in (10**6, 20):
        got = {r["doc_id"]: r for r in contamination.remove_leaks(docs, items, block_words=words).collect()}
        assert {k: got[k]["text"].split() for k in kept} == kept
        assert {k: r["removed_words"] for k, r in got.items()} == {1: 80, 2: 24, 3: 14, 4: 80, 5: 81, 6: 54, 7: 14}
        assert [k for k, r in got.items() if r["dropped"]] == [4]
    spans = contamination.find_passages(docs, items).filter("doc_id = 1").orderBy("first_word").collect()
    assert [(r["first_word"], r["last_word"], r["edits"]) for r in spans] == [(60, 99, 0), (100, 139, 0)]


def test_words():
    assert textnorm.words("It’s naïve &amp; Ｗｉｄｅ, so-called") == ["its", "naive", "wide", "so", "called"]
    text = "Intro <b>one</b> two\nthree  four"
    found, places = textnorm.words_with_spans(text)
    assert found == textnorm.words(text) and text[places[-1][0] : places[-1][1]] == "four"


# --- subjects -------------------------------------------------------------


def test_subjects_of_planted_documents(spark):
    rng = random.Random(8)
    nouns = {"sport": [f"sport{c}" for c in "abcdefghijkl"], "law": [f"law{c}" for c in "abcdefghijkl"], "food": [f"food{c}" for c in "abcdefghijkl"]}
    plain = "the team will see about this one again when more notes come in".split()
    line = lambda s: " ".join(rng.sample(plain, 5) + (rng.sample(nouns[s], 2) if s else [])) + "."
    docs, truth = [], {}
    for k in range(240):
        subjects = [[], [rng.choice(list(nouns))], rng.sample(list(nouns), 2)][k % 3]
        body = [line(s) for s in subjects for _ in range(4)] + [line(None) for _ in range(4 if subjects else 10)]
        if not subjects:
            body.append(line("law"))  # in passing: one of eleven
        rng.shuffle(body)
        docs.append((k, " ".join(body)))
        truth[k] = set(subjects)
    docs += [(900, None), (901, ""), (902, "  ")]
    examples = [(s if rng.random() > 0.1 else "law", " ".join(line(s) for _ in range(3))) for s in nouns for _ in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = topics.fit(df, examples)
    got = {}
    for r in topics.assign(df, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert np.mean([got.get(k, set()) == v for k, v in truth.items()]) > 0.95 and not {900, 901, 902} & set(got)
    assert topics.assign(df.limit(0), model).count() == 0


@pytest.mark.filterwarnings("ignore:the topics")
def test_chunks_of_a_long_file_are_taken_up_a_few_at_a_time(spark, monkeypatch):
    rows = [(k, f"{'striker' if k % 2 else 'verdict'} word{k % 7} came again. The notes of {k % 5} went out there.") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    examples = [("sport", "striker"), ("law", "verdict")]
    whole = topics.prepare(df)
    start = topics.start_topics(whole.vocabulary, whole.frequency, topics.example_weights(examples, whole.vocabulary, whole.frequency), ["law", "sport"])
    model = topics.TopicModel(whole.vocabulary, whole.frequency, topics.gains(start, whole.frequency), ["law", "sport"], [], 0)
    expected = sorted(map(tuple, topics.assign(whole, model).collect()))
    assert [(k, s) for k, s, *_ in expected] == [(k, "sport" if k % 2 else "law") for k in range(90)]
    fitted, read = topics.fit(whole, examples, 2).topics, topics._read

    def few(batch):
        assert batch.num_rows <= 4, f"{batch.num_rows} chunks in one batch"
        return read(batch)

    monkeypatch.setattr(topics, "CHUNK_DOCUMENTS", 1)
    monkeypatch.setattr(topics, "_read", few)
    corpus = topics.prepare(df)
    assert corpus.chunks.count() == 90 and corpus.vocabulary == whole.vocabulary
    assert sorted(map(tuple, topics.assign(corpus, model).collect())) == expected
    assert np.allclose(topics.fit(corpus, examples, 2).topics, fitted, atol=1e-3)
    for uri in corpus.chunks.inputFiles():
        groups = pq.ParquetFile(uri.removeprefix("file://")).metadata
        assert max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= 4
    # identifiers of any type come back as they were
    stamped = df.withColumn("doc_id", F.timestamp_seconds("doc_id"))
    assert sorted(r["doc_id"].timestamp() for r in topics.assign(stamped, model).collect()) == [k for k, *_ in expected]


def test_sentences():
    assert len(topics.sentences("One two three. Four five six!\nSeven eight nine\n\n- ten")) == 3
    assert topics.sentences(None) == topics.sentences(" ") == []
