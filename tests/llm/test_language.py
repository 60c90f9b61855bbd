"""Language evidence against a plain recomputation, many languages, hot hosts, wrong declarations."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import language
from tributary.llm.language import LanguageParams

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "quick brown fox jumps over lazy", "cc": "zwölf boxkämpfer jagen viktor quer"}


def corpus(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(rng.choice(WORDS[w].split(), 8)), w) for k, w in zip(range(n), itertools.cycle(WORDS), strict=False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def recomputed(rows, texts, params):
    """Rows (key, text, declared, suffix, host, domain) -> {key: (language, probability)}, by loops over all of it."""
    grams = lambda t: language._trigrams([(t or "").encode()], params.hash_bits)[0].tolist()
    langs = sorted({w for _, w in texts})
    count = {w: Counter() for w in langs}
    for t, w in texts:
        count[w].update(grams(t))
    buckets, n = 1 << params.hash_bits, len(langs) + 1
    like, post, letters = {}, {}, {}
    prior = np.array([(1 - params.unknown_prior) / (n - 1)] * (n - 1) + [params.unknown_prior])
    for key, t, *_ in rows:
        g = grams(t)
        x = np.array([sum(np.log((count[w][b] + 0.5) / (sum(count[w].values()) + buckets / 2)) for b in g) for w in langs] + [-len(g) * np.log(buckets)])
        like[key] = x * min(1, params.max_trigrams / max(len(g), 1))
        letters[key] = bool(g)
        post[key] = softmax(like[key] + np.log(prior)) * bool(g)
    shares = {}
    for at, what in ((2, "declared"), (3, "suffix")):
        seen = defaultdict(lambda: np.zeros(n))
        for row in rows:
            if row[at] is not None:
                seen[row[at] if row[at] in langs else ""] += post[row[0]]
        table = np.array([seen[v] for v in [*langs, ""]]).T + params.confusion_weight * (np.full((n, n), 0.2 / n) + 0.8 * np.eye(n))
        shares[what] = np.log(table / table.sum(1, keepdims=True))
    everywhere = sum(post.values()) + prior * params.domain_weight
    everywhere = everywhere / everywhere.sum()
    by_host, by_domain = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n))
    for key, _, _, _, host, domain in rows:
        by_host[host] += post[key]
        by_domain[domain] += post[key]
    out = {}
    for key, _, declared, suffix, host, domain in rows:
        own = lambda sums, name: np.maximum(sums[name] - post[key], 0) if name is not None else np.zeros(n)  # noqa: B023, E731
        p = (own(by_domain, domain) + params.domain_weight * everywhere) / (own(by_domain, domain).sum() + params.domain_weight)
        p = (own(by_host, host) + params.host_weight * p) / (own(by_host, host).sum() + params.host_weight)
        score, known = like[key] + np.log(p), letters[key]
        for what, value in (("declared", declared), ("suffix", suffix)):
            if value is not None:
                score = score + shares[what][:, langs.index(value) if value in langs else n - 1]
                known |= value in langs
        final = softmax(score)
        best = int(final.argmax()) if known else n - 1
        out[key] = ([*langs, "und"][best], final[best])
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_hosts": 0, "hot_rows": 8}, {"dense_entries": 0}])
def test_fusion_equals_a_plain_recomputation(spark, limits):
    """However hosts are joined and counts are held; one host has a third of all rows."""
    rng = np.random.default_rng(1)
    docs, rows = corpus(spark), []
    for k in range(60):
        w = str(rng.choice(list(WORDS)))
        text = " ".join(rng.choice(WORDS[w].split(), rng.integers(0, 3)))
        host = "big.x.org" if k % 3 == 0 else None if k % 7 == 0 else f"h{k % 5}.y.org"
        rows.append((k, [text, None, "!!"][0 if k % 11 else k % 3], [w, "aa", None, "zz"][k % 4], [None, w, "bb"][k % 3], host, host and ".".join(host.split(".")[-2:])))
    params = LanguageParams(**limits)
    df = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string")
    found = {r.key: (r.language, r.probability) for r in language.identify(df, language.train(docs, params)).collect()}
    want = recomputed(rows, [(r.text, r.lang) for r in docs.collect()], params)
    assert found.keys() == want.keys() and len({x for x, _ in want.values()}) == 4
    for k, (name, p) in want.items():
        assert found[k][0] == name, (k, found[k], want[k])
        assert found[k][1] == pytest.approx(p, abs=1e-4)


def test_any_number_of_languages(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} word{k} own{k}" * 3, f"l{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    model = language.train(docs)
    assert len(model.languages) == 301
    texts = [t.encode() for _, t, _ in rows[:40]]
    sparse = language.train(docs, LanguageParams(dense_entries=0))
    assert sparse.table is None and model.table is not None
    assert language.text_log_likelihood(texts, model)[0] == pytest.approx(language.text_log_likelihood(texts, sparse)[0], abs=1e-2)
    assert language.keep_identified(docs.limit(5)).columns == docs.columns


def test_own_share_of_a_rare_language_is_left_out(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(900, WORDS["aa"], "rare", "s")], "doc_id long, text string, lang string, source string"))
    model = language.train(docs)
    text, at = [WORDS["aa"].encode()], model.languages.index("rare")
    counted = language.text_log_likelihood(text, model, ["rare"])[0][0]
    alone = language.text_log_likelihood(text, language.train(corpus(spark)))[0][0]
    assert counted[at] < language.text_log_likelihood(text, model)[0][0][at] - 1
    assert counted[model.languages.index("aa")] == pytest.approx(alone[0], abs=1e-3)
    codes = language._trigrams(text, 16)[0]
    assert model.without(codes, at) == pytest.approx(len(codes) * np.log(0.5 / (1 << 15)))


def test_stage_rejects_wrong_declarations(spark):
    docs = corpus(spark, 300)
    other = dict(zip(WORDS, [*list(WORDS)[1:], "aa"], strict=True))
    planted = F.element_at(F.create_map(*[F.lit(x) for pair in other.items() for x in pair]), F.col("lang"))
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, planted).otherwise(F.col("lang")))
    left = {r.doc_id for r in language.keep_identified(wrong).collect()}
    assert left == {k for k in range(300) if k % 20}
    # a text that mixes its language with another one stays, whichever prevails
    mixed = spark.createDataFrame([(1000, f"{WORDS['aa']} {WORDS['bb']} quick brown", "aa", "s"), (1001, f"{WORDS['bb']} {WORDS['cc']}", "bb", "s")], docs.schema)
    assert {1000, 1001} <= {r.doc_id for r in language.keep_identified(docs.unionByName(mixed)).collect()}


def test_stages_of_nothing(spark):
    none = corpus(spark).limit(0)
    assert language.keep_identified(none).collect() == []
    pages = spark.createDataFrame([(1, "http://a.b/de/x", "<html lang=de>wort</html>")], "page_id long, url string, html string").withColumn("key", F.lit("x"))
    found = language.identify_pages(pages, none).collect()
    assert [(r.language, r.accepted) for r in found] == [("und", False)]
