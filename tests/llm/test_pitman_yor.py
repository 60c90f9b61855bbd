"""The language model against brute force: table draws, normalisation, and a sampler that moves one customer at a time."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tributary.llm import pitman_yor
from tributary.llm.pitman_yor import Bucket, PitmanYorParams, Root


def test_table_draws_follow_the_conditional():
    rng = np.random.default_rng(0)
    draws = pitman_yor.draw_tables(np.full(40_000, 5), np.full(40_000, -0.5), 0.4, PitmanYorParams(exact=12), rng)
    # brute force over seatings: customers sit one by one, a new table weighs exp(-0.5), an old one size - discount
    weight: Counter = Counter()

    def seat(sizes, w):
        if sum(sizes) == 5:
            weight[len(sizes)] += w
            return
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1 :]], w * (s - 0.4))
        seat([*sizes, 1], w * math.exp(-0.5))

    seat([1], math.exp(-0.5))
    total = sum(weight.values())
    for t in range(1, 6):
        assert np.mean(draws == t) == pytest.approx(weight[t] / total, abs=0.01)


@pytest.mark.parametrize(("discount", "opening"), [(0.75, 0.01), (0.75, 1.0), (0.75, 40.0), (0.3, 0.5), (0.3, 30.0), (0.05, 5.0), (0.95, 2.0)])
def test_draws_of_many_customers_follow_the_exact_ones(discount, opening):
    many = np.full(4000, 700)
    rng = np.random.default_rng(1)
    exact, quick = (pitman_yor.draw_tables(many, np.full(4000, math.log(opening)), discount, PitmanYorParams(exact=e), rng) for e in (800, 100))
    assert quick.min() >= 1 and quick.max() <= 700
    assert quick.mean() == pytest.approx(exact.mean(), rel=0.06, abs=0.15)
    assert quick.std() == pytest.approx(exact.std(), rel=0.2, abs=0.3)


def test_probabilities_sum_to_one():
    """Over the known words and all unknown ones together, after any context, seen or not."""
    rng = np.random.default_rng(9)
    params, words = PitmanYorParams(), 12  # the last is unknown
    word, context = (a.ravel() for a in np.meshgrid(np.arange(words), np.arange(5), indexing="ij"))
    count = np.where((word < words - 1) & (context < 4), rng.poisson(1.5, len(word)), 0)
    count[(word < words - 1) & (context == 0)] = 400  # beyond the exact draws
    count[(context == 3) & (word < words - 1)] += 1  # every other word is known
    pairs = Bucket(word, context, count, 5, np.empty(0, np.int64), np.empty(0), np.arange(words).astype(np.uint64), np.arange(5).astype(np.uint64))
    known = np.arange(words) < words - 1
    types = np.bincount(word, np.minimum(count, 1))
    root = Root(types.sum(), known.sum(), words - 1, count.sum(), 0.6, 0.3)
    tables = pairs.burnt_in(root.probability(types, np.minimum(types, 1), known, params), [np.empty(0)] * 2, root, params)
    customers = np.bincount(word, tables)
    own = pitman_yor.draw_tables(customers.astype(int), np.zeros(words), 0.3, params, rng)
    after = Root(customers.sum(), own.sum(), words - 1, count.sum(), 0.6, 0.3)
    parent = after.probability(customers, own, known, params)
    assert parent.sum() == pytest.approx(1)
    p = pairs.predictive(tables, parent, np.empty(0), after)
    assert np.bincount(context, p) == pytest.approx(np.ones(5))
    assert (p > 0).all()


def one_by_one(texts, params, discount, root_discount, sweeps, rng):
    """Log10 scores of texts: every customer leaves and sits down again by itself, tables with their sizes kept."""
    pairs = [("\n" if k == 0 else words[k - 1], w) for words in texts for k, w in enumerate(words)]
    known = {w for _, w in pairs}
    seats, root = {}, {w: [] for w in known}
    totals = Counter()

    def weight_root(w):
        all_customers, all_tables = sum(map(sum, root.values())), sum(map(len, root.values()))
        base = (1 - params.unknown) / len(known)
        return (sum(root[w]) - root_discount * len(root[w]) + (params.root_strength + root_discount * all_tables) * base) / (params.root_strength + all_customers)

    def sit(tables, d, opening):
        """Whether a new table was opened."""
        weights = np.array([*(n - d for n in tables), opening])
        at = rng.choice(len(weights), p=weights / weights.sum())
        if at == len(tables):
            tables.append(1)
            return True
        tables[at] += 1
        return False

    def leave(tables):
        at = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def come(u, w):
        of = seats.setdefault(u, {})
        tables = of.setdefault(w, [])
        if sit(tables, discount, (params.strength + discount * sum(map(len, of.values()))) * weight_root(w)):
            opening = (params.root_strength + root_discount * sum(map(len, root.values()))) * (1 - params.unknown) / len(known)
            sit(root[w], root_discount, opening)
        totals[u] += 1

    for u, w in pairs:
        come(u, w)
    p, averaged = Counter(), 0
    for sweep in range(sweeps):
        for u, w in pairs:
            totals[u] -= 1
            if leave(seats[u][w]):
                leave(root[w])
            come(u, w)
        if sweep >= sweeps // 4:
            averaged += 1
            for u, w in set(pairs):
                of = seats[u]
                p[(u, w)] += (sum(of[w]) - discount * len(of[w]) + (params.strength + discount * sum(map(len, of.values()))) * weight_root(w)) / (params.strength + totals[u])
    return [sum(math.log10(p[("\n" if k == 0 else words[k - 1], w)] / averaged) for k, w in enumerate(words)) for words in texts]


def test_scores_agree_with_moving_one_customer_at_a_time(spark):
    rng = np.random.default_rng(3)
    params = PitmanYorParams(fold=10**9, averaged=20, sample_strength=False)  # nothing is held out
    texts = [[str(w) for w in np.minimum(rng.geometric(0.3, 6), 7)] for _ in range(40)]
    found = pitman_yor.score_documents(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), params).collect()
    got = np.array([r.score for r in sorted(found, key=lambda r: r.doc_id)])
    pairs = Counter(p for t in texts for p in zip(["\n", *t], [*t, "\n"], strict=True))
    count = Counter(pairs.values())
    types = Counter(Counter(w for _, w in pairs).values())
    want = np.array(one_by_one([[*t, "\n"] for t in texts], params, pitman_yor.share(count[1], count[2]), pitman_yor.share(types[1], types[2]), 60, rng))
    assert got == pytest.approx(want, abs=0.12)
    assert got.mean() == pytest.approx(want.mean(), abs=0.03)
    assert np.corrcoef(got, want)[0, 1] > 0.99


def test_each_previous_word_has_its_restaurant(spark):
    # y follows x; contexts in few restaurants cannot tell
    rows = spark.createDataFrame([(k, f"x{k % 300} y{k % 300}") for k in range(6000)], "doc_id long, text string").repartition(3)
    by = {}
    for contexts in (0, 7):
        found = pitman_yor.score_documents(rows, PitmanYorParams(contexts=contexts, chunk_bytes=20_000)).where("held_out").collect()
        by[contexts] = sum(r.score for r in found) / len(found)
    assert by[0] > by[7] + 0.5  # log10 a text


def test_hot_contexts_are_dealt_over_buckets_without_other_scores(spark):
    """One word makes up a third of all; many small buckets give what one bucket gives."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join("the" if rng.random() < 0.4 else f"w{rng.integers(0, 200)}" for _ in range(30))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(pitman_yor.hot_contexts(docs.select("doc_id", "text"), 600, 20, PitmanYorParams())) >= 2
    one, many = ({r.doc_id: r for r in pitman_yor.score_documents(docs, PitmanYorParams(bucket_bytes=b, least_bucket=b, chunk_bytes=9000)).collect()} for b in (1 << 30, 4000))
    for k, a in one.items():
        b = many[k]
        assert (a.n_tokens, a.n_known, a.train_tokens, a.held_out) == (b.n_tokens, b.n_known, b.train_tokens, b.held_out)
        assert a.base_score == pytest.approx(b.base_score, abs=1e-5)
        assert a.score == pytest.approx(b.score, abs=1e-6)
        assert a.perplexity == pytest.approx(10 ** (-a.score / a.n_tokens))


def test_texts_that_occur_twice_stand_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))) for k in range(500)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)]
    found = pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()
    lone = [r.score - r.base_score for r in found if 50 <= r.doc_id < 1000]
    held = {k for k, _ in rows} - {r.doc_id for r in found}
    twice = [r.score - r.base_score for r in found if r.doc_id >= 1000 and r.doc_id - 1000 not in held]
    assert twice and min(twice) > max(lone)


def test_strength_follows_the_seating_probability():
    """Against the product over customers, and seats dealt at a known strength give it back."""
    customers, tables = np.array([0, 1, 4, 4, 9]), np.array([0, 1, 2, 2, 5])
    got = pitman_yor.strength_evidence(customers, tables, 0.6)
    want = [sum(sum(math.log(s + 0.6 * k) for k in range(1, t)) - sum(math.log(s + k) for k in range(1, c)) for c, t in zip(customers, tables, strict=True)) for s in pitman_yor.strengths(0.6)]
    assert got - got[0] == pytest.approx(np.array(want) - want[0], abs=1e-6)  # powers of the discount are left out
    rng = np.random.default_rng(4)
    for strength in (-0.3, 1.0, 10.0):
        n, t = np.full(4000, 30), np.ones(4000, np.int64)
        for c in range(1, 30):
            t += rng.random(4000) < (strength + 0.6 * t) / (strength + c)
        assert pitman_yor.drawn_strength(pitman_yor.strength_evidence(n, t, 0.6), 0.6, 1) == pytest.approx(strength, rel=0.8)


def test_draws_come_from_their_keys_alone():
    rng = np.random.default_rng(5)
    count, opening, keys = rng.integers(2, 3000, 500), rng.normal(0, 3, 500), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    whole = pitman_yor.draw_tables(count, opening, 0.7, PitmanYorParams(), keys)
    turned = rng.permutation(500)
    assert (pitman_yor.draw_tables(count[turned], opening[turned], 0.7, PitmanYorParams(), keys[turned]) == whole[turned]).all()
