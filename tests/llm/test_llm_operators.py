"""Each operator against brute force or an exact round trip, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import bpe, language, licenses, metric_search, multi_index, near_dedup, packing, pitman_yor, quality, toxicity
from tributary.llm.components import connected_components
from tributary.llm.tokens import ids_of, json_encoding, rank_encoding, rank_table

SF = "/root/testdata/sf0.001"
ODD = ["a<|endoftext|>b", "    x　y ½²", "🙂 zalgo̗̊ é", "\r\n\t  \n", "x" * 30000, " " * 3000, "日本語 テキスト", "٣٤ ४५", "\x1c a\x85b\x1f", None, "", "it's we'll  'S ", "same text here again", "same text here again", "one", "one two"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, repeated rows, and columns with names that operators use inside."""
    rows = [(None if k == 3 else k, t) for k, t in enumerate(ODD)] + [(0, ODD[0])]
    extra = {c: F.lit("x") for c in ("key", "node", "chunk", "bucket", "score", "task", "rank", "n", "c", "words", "host_counts", "toxicity_score", "language_found")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 2, "s"), "n_chars": F.length("text")})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def ids(rows):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)


# packing


def packed_rows(spark_rows, texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for key, text in texts:
        found = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(found) % 1024 or 1024
        cuts = [0, *range(first, len(found) + 1, 1024)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[(key, k, a, b - a, zlib.crc32(np.array(found[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in spark_rows) == want
    filled: dict[int, int] = {}
    for r in sorted(spark_rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
        assert filled[r.sequence_id] <= 1024
    return filled


def test_packing_of_odd_rows(odd):
    packed_rows(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_packing_is_short(documents):
    filled = packed_rows(packing.pack(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    assert len(filled) <= math.ceil(sum(filled.values()) / 1024) * 1.03 + 1


def test_packing_of_nothing(odd):
    assert packing.pack(odd.limit(0)).collect() == []


@pytest.mark.parametrize("histogram", [{1: 5000}, {513: 100}, {300: 7, 350: 5, 374: 9, 1024: 3}, {k: 3 for k in range(1, 1025)}, {1024: 10, 1: 1}])
def test_plan_covers_every_rank_once(histogram):
    rows = packing.plan(histogram, packing.PackingParams())
    seen, filled = Counter(), Counter()
    for length, rank, many, first, offset in rows.tolist():
        for k in range(many):
            seen[(length, rank + k)] += 1
            filled[first + k] += length
    assert seen == Counter((length, r) for length, n in histogram.items() for r in range(n))
    assert max(filled.values()) <= 1024


def test_configurations_meet_the_optimum():
    found = packing.configurations(np.array([256, 384]), np.array([400, 200]), 1024)
    assert sum(t for _, t in found) == (400 * 256 + 200 * 384) // 1024 + (400 * 256 + 200 * 384) % 1024 // 1024


def test_json_encoder_equals_its_library():
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD:
        assert ids_of(json_encoding(public_tokenizers.path("byte_bpe_50k.json")), text or "").tolist() == encoder.encode(text or "", add_special_tokens=False).ids


# language model


def test_language_model_counts_and_beats_its_base(spark, documents):
    rows = pitman_yor.score_documents(documents).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in documents.collect()}
    train = Counter(w for k, ws in texts.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total = sum(train.values())
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (len(train) + 1))) for w in words))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_on_odd_rows(odd):
    rows = pitman_yor.score_documents(odd).collect()
    assert ids(rows) == ids(odd.collect())
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (9, 10)} == {1}
    assert pitman_yor.score_documents(odd.limit(0)).collect() == []


# licenses


def test_license_scan_equals_search_for_exact_notices(documents):
    rows = licenses.scan_licenses(documents).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    got = {(r.doc_id, r.license) for r in rows if r.coverage == 1}
    want = {(k, n) for k, t in texts.items() for n, w in licenses.TEMPLATES.items() if w.encode() in t}
    assert got == want
    for r in rows:
        assert 0.7 <= r.coverage <= 1 and 0 <= r.span_start < r.span_end <= len(texts[r.doc_id])


def test_license_with_edits_and_twice(spark, odd):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("obtaining", "now getting hold of").replace("merge, ", "")
    rows = licenses.scan_licenses(spark.createDataFrame([(1, f"é start {edited} middle words here {mit} end"), (2, "the license of nothing")], "doc_id long, text string")).collect()
    assert [r.license for r in rows] == ["MIT", "MIT"]
    assert rows[0].coverage < 1 and rows[1].coverage == 1
    assert licenses.scan_licenses(odd).collect() == []


def test_license_with_any_single_word_edit_of_a_short_notice():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LicenseParams())
    for name in ("Apache-2.0-notice", "CC-BY-NC-4.0-notice", "GPL-3.0-notice", "MIT-notice"):
        words = licenses.tokens(licenses.TEMPLATES[name].encode())[0]
        for k in range(len(words)):
            for edited in ([*words[:k], b"zzz", *words[k + 1 :]], words[:k] + words[k + 1 :], [*words[:k], b"zzz", *words[k:]]):
                found = [m for m in scanner.scan(b"aa bb " + b" ".join(edited) + b" cc dd") if m[0] == name]
                if words[k] in licenses.DECIDING and len(edited) <= len(words):  # it is another licence, or none
                    assert not found, (name, edited)
                else:
                    assert len(found) == 1 and found[0][1] >= (len(words) - 1) / len(words), (name, edited)


def test_license_notices_on_consecutive_lines():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LicenseParams())
    for name in ("Apache-2.0-notice", "CC-BY-NC-4.0-notice", "GPL-3.0-notice", "MIT-notice"):
        notice = licenses.TEMPLATES[name]
        for times in (2, 3, 4, 9):
            found = [m for m in scanner.scan("\n".join([notice] * times).encode()) if m[0] == name]
            assert [m[3] for m in found] == [k * (len(notice) + 1) for k in range(times)], (name, times)
            assert all(m[1] == 1 and m[4] - m[3] in (len(notice), len(notice) - 1) for m in found)
    # the first copy does not reach into the second, and a failed place does not hide the next one
    found = [m for m in scanner.scan(b"Released under our MIT License.\nReleased under the MIT License.\nMIT released x y z\nReleased under the very MIT License.") if m[0] == "MIT-notice"]
    assert [(m[2], m[3], m[4]) for m in found] == [(4, 0, 30), (5, 32, 62), (5, 83, 118)]


def test_licences_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LicenseParams())
    names = lambda text: {m[0] for m in scanner.scan(text.encode())}
    for name, text in licenses.TEMPLATES.items():
        found = names(f"copyright 1999 the authors\n{text}\nand then other words follow here")
        assert name in found, name
        rest = {"Apache-2.0-notice"} if name == "Apache-2.0-header" else set()
        assert found - {name} <= rest, (name, found)
    assert names("Licensed under CC BY 4.0.") == {"CC-BY-4.0-notice"}
    assert names("Licensed under CC 4.0.") == names("Licensed under the License, Version 2.0.") == set()
    assert names("This program is under the GNU Lesser General Public License, version 3") == {"LGPL-3.0-notice"}
    both = licenses.TEMPLATES["MPL-2.0-header"] + " SPDX-License-Identifier: LGPL-3.0-only"
    assert names(both) == {"MPL-2.0-header", "LGPL-3.0-only-tag"}


def test_licence_texts_old_tags_and_negated_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LicenseParams())
    names = lambda text: {m[0] for m in scanner.scan(text.encode())}
    assert names("x = 1  # SPDX-License-Identifier: GPL-3.0\n") == {"GPL-3.0-tag"}
    assert names("Licensed under CC BY-SA 3.0.") == {"CC-BY-SA-3.0-notice"}
    assert names("Released under the BSD License.") == {"BSD-notice"}
    for text in ("Not released under the MIT License.", "This is no longer released under the MIT License", "It is not Licensed under the Apache License, Version 2.0.", "licensed, but not under CC BY 4.0"):
        assert names(text) == set(), text
    # a negated notice does not hide a true one, and words further off negate nothing
    assert [m[3] for m in scanner.scan(b"Not released under the MIT License. Released under the MIT License.")] == [36]
    assert names("Do not panic, friends. Released under the MIT License.") == {"MIT-notice"}
    opening = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n" + licenses.TEMPLATES["Apache-2.0-text"]
    assert "Apache-2.0-text" in names(opening)
    assert names(licenses.TEMPLATES["GPL-3.0-text"].replace("Inc.", "Inc. <https://fsf.org/>")) == {"GPL-3.0-text"}


def test_fingerprints_meet_every_match():
    """A match that lacks as many words as it may still holds a winnowed word, whichever it lacks."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LicenseParams())
    rng = np.random.default_rng(12)
    assert licenses.winnowed([5, 3, 4, 1, 9, 1, 7], 3) == [1, 3, 5]
    for t, words in enumerate(scanner.texts):
        places = {i for hits in scanner.index.values() for at, i in hits if at == t}
        assert len(words) - scanner.least[t] < len(places) <= len(words)
        for _ in range(20):
            assert places & set(rng.choice(len(words), scanner.least[t], replace=False).tolist())


def test_licenses_of_nothing(odd):
    assert licenses.scan_licenses(odd.limit(0)).collect() == []


def test_banded_alignment_equals_the_full_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = ([bytes([97 + x]) for x in rng.integers(0, 4, 12)] for _ in range(2))
        table = [[0] * 13 for _ in range(13)]
        for i, j in itertools.product(range(12), range(12)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert licenses.aligned(a, b, 0, 12)[0] == table[12][12]


# quality and toxicity


def test_quality_separates_held_out(documents, labels):
    rows = quality.quality_scores(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.predicted == r.quality for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_ignores_held_out_labels(documents, labels):
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(documents, x).collect()} for x in (labels, wrong))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_quality_log_odds_are_those_of_gaussians():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(0.5, 2, (600, 3))]
    m = np.array([np.c_[np.ones(len(p)), p].T @ np.c_[np.ones(len(p)), p] for p in x])
    model = quality.from_moments(m, quality.QualityParams(to_pooled=0, to_sphere=0))
    z = rng.normal(0, 1, (5, 3))
    want = []
    for p, n in zip(x, (400, 600), strict=True):
        c, d = np.cov(p.T, bias=True), z - p.mean(0)
        want.append(np.log(n / 1000) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert quality.log_odds(z, model) == pytest.approx(want[1] - want[0])


def test_scores_of_odd_rows_and_without_labels(odd, documents, labels):
    none = labels.limit(0)
    for rows in (quality.quality_scores(odd, none).collect(), toxicity.toxicity_scores(odd, toxicity.fit(odd, none)).collect()):
        assert ids(rows) == ids(odd.collect())
        assert all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(odd.limit(0), labels).collect() == []
    one = quality.quality_scores(documents, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    model = toxicity.fit(documents, labels)
    assert ids(toxicity.toxicity_scores(odd, model).collect()) == ids(odd.collect())
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for k in range(900):
        bad = k % 5 == 0
        words = [*rng.choice(plain, 40), *(["vile", "rotten"] if bad else [])]
        rows.append((k, " ".join(rng.permutation(words))))
        if k % 3 != 1:
            marks.append((k, 1, int(bad)))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labs)).collect()}
    assert np.mean([got[k] == int(k % 5 == 0) for k in got]) >= 0.98


def test_risk_and_gradient_equal_brute_force():
    rng = np.random.default_rng(4)
    p, u, prior = rng.random((40, 6)) < 0.5, rng.random((60, 6)) < 0.3, 0.3
    w, b = rng.normal(0, 1, 6), 0.2

    def risks(w, b):
        f = lambda x: sum(a * c for a, c in zip(x, w, strict=True)) + b
        loss = lambda x, y: math.log(1 + math.exp(-y * f(x)))
        mean = lambda rows, y: sum(loss(x, y) for x in rows) / len(rows)
        return prior * mean(p, 1), mean(u, -1) - prior * mean(p, -1)

    plus, clean, grad_plus, grad_clean = toxicity.nnpu_parts(p.astype(float), u.astype(float), w, b, prior)
    assert (plus, clean) == pytest.approx(risks(w, b))
    for k in range(7):
        d = np.eye(7)[k] * 1e-5
        up, down = risks(w + d[:6], b + d[6]), risks(w - d[:6], b - d[6])
        assert ((up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5) == pytest.approx((grad_plus[k], grad_clean[k]), abs=1e-6)


def test_non_negative_risk_keeps_clean_risk_up():
    """A plain fit drives the estimate of the clean risk below zero; this one turns back."""
    rng = np.random.default_rng(4)
    hidden = rng.random((60, 400)) < 0.5  # more features than rows: anything can be told apart
    p, u = hidden[:30], np.concatenate([hidden[:20], hidden[30:]])
    w, b = toxicity.nnpu_fit(p.astype(np.int8), u.astype(np.int8), 0.5, toxicity.ToxicityParams(epochs=400, l2=0))
    _, clean, _, _ = toxicity.nnpu_parts(p.astype(float), u.astype(float), w, b, 0.5)
    assert clean > -0.1
    free = np.zeros(401)
    for _ in range(400):
        _, _, one, two = toxicity.nnpu_parts(p.astype(float), u.astype(float), free[:-1], free[-1], 0.5)
        free -= 0.5 * (one + two)
    assert toxicity.nnpu_parts(p.astype(float), u.astype(float), free[:-1], free[-1], 0.5)[1] < clean


def test_toxicity_of_nothing(odd, documents, labels):
    none = documents.limit(0)
    model = toxicity.fit(none, labels.limit(0))
    assert model.weights == {} and toxicity.toxicity_scores(none, model).collect() == [] and toxicity.keep_clean(none, model).collect() == []
    assert ids(toxicity.keep_clean(odd, model).collect()) == ids(odd.collect())
    assert toxicity.fit(none, labels).weights == {}


# language


def test_language_of_pages(spark, documents):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language.identify_pages(pages, documents).collect()
    assert len(rows) == pages.count()
    assert np.mean([r.language == r.declared for r in rows if r.declared]) >= 0.95


def test_language_of_odd_pages(spark, documents):
    rows = [(1, None, None), (2, "http://a.example.de/x", ""), (3, "not a url", "<html lang=fr>"), (4, "http://h.example.com/es/1", "<p>the and of is that was for with</p>"), (4, "http://h.example.com/es/1", "<p>the and of is that was for with</p>"), (None, "", "<!-- x --><script>var a</script>")]
    found = language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), documents).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    assert by[1].language == "und" and by[None].language == "und" and not by[1].accepted
    assert by[2].language == "de" and by[3].language == "fr"
    assert language.identify_pages(spark.createDataFrame([], "page_id long, url string, html string"), documents).collect() == []


def test_language_stage_keeps_text_and_drops_what_has_none(odd, documents):
    kept = language.keep_identified(documents)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    left = language.keep_identified(odd.unionByName(documents, allowMissingColumns=True)).where("key = 'x'")
    assert {9, 10} & {r.doc_id for r in left.collect()} == set()


def test_language_stage_takes_undeclared_texts_of_a_source_as_evidence(spark):
    said = [(k, f"{w} shared" * 3, lang, "told") for k, (w, lang) in enumerate([("lorem ipsum dolor sit amet", "aa"), ("quick brown fox jumps over", "bb")] * 10)]
    silent = [(100 + k, "lorem ipsum dolor sit amet", None, "silent") for k in range(10)]
    docs = spark.createDataFrame([*said, *silent, (200, "shared", None, "silent"), (201, "!!", "aa", "told"), (None, "lorem ipsum dolor", None, None)], "doc_id long, text string, lang string, source string")
    kept = [r.doc_id for r in language.keep_identified(docs).collect()]
    assert len(kept) == len(set(kept)) == 32 and 200 in kept and None in kept and 201 not in kept


def test_language_stage_without_any_declared_language_keeps_texts_with_letters(documents, spark):
    docs = documents.withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, "!!"), (-2, None), (-3, "one"), (-3, "one")], "doc_id long, text string")
    kept = language.keep_identified(docs.unionByName(odd, allowMissingColumns=True))
    assert kept.count() == documents.count() + 2
    assert sorted(r.doc_id for r in kept.where("doc_id < 0").collect()) == [-3, -3]


def test_trigram_likelihood_is_a_sum_over_trigrams():
    codes, sizes = language._trigrams([b"ab", b"", None, b"!!", b"A b"], 16)
    assert sizes.tolist() == [2, 0, 0, 0, 3] and len(codes) == 5


# searches


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (700, 16))
    x[100:160] = x[99]  # copies tie
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1100, [float("inf")] * 16), (None, [0.0] * 16), (5, [float(v) for v in x[5]])]
    found = metric_search.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1)), metric_search.MTreeParams(page=16, tree_rows=200, roots=8, seed_rows=50)).collect()
    v = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 700, 100):
        s = v @ v[q]
        order = [k for k in np.lexsort((np.arange(700), -s)) if k != q][:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(k, s[k]) for k in order]
    assert len(found) == 70


def test_searches_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5]), (2, [-1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in metric_search.top_inner_products(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert [(r.vec_id, r.score) for r in multi_index.approximate_neighbours(few).orderBy("rank").collect()] == [(1, 0.5), (2, -1.0)]
    for f in (metric_search.top_inner_products, multi_index.approximate_neighbours):
        assert f(few.limit(0)).collect() == []


def test_tree_search_skips_pages_on_clustered_data():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (20, 8))
    points = np.c_[np.floor(np.repeat(centres, 200, 0) + rng.normal(0, 1, (4000, 8))), np.zeros(4000)]
    r2 = (points**2).sum(1).max()
    points[:, -1] = np.sqrt(r2 - (points[:, :-1] ** 2).sum(1))
    params = metric_search.MTreeParams(page=50)
    root = metric_search.build(np.arange(4000), points, points[0], params)
    best = metric_search.Best(np.array([-1]), 10, np.int64)
    query = np.append(points[7, :-1], 0)
    radius = metric_search._distances(points, points[0]).max()
    computed = metric_search.search(root, points[0], radius, query[None], np.array([(query**2).sum() + r2]), 1e-3, best)
    s = points[:, :-1].astype(np.int64) @ query[:-1].astype(np.int64)
    assert best.ids[0].tolist() == np.lexsort((np.arange(4000), -s))[:10].tolist()
    assert computed < 2500


def test_multi_index_recall(spark):
    """On vectors without any structure, with the production share of entries."""
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = multi_index.approximate_neighbours(vectors, multi_index.MultiIndexParams(query_divisor=100)).collect()
    recall = []
    for q in range(0, 5000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[r.vec_id] @ x[q]), abs=1e-12) for r in got)
        recall.append(len(set(np.argsort(-s)[:20]) & {r.vec_id for r in got}) / 20)
    assert np.mean(recall) >= 0.9


def test_multi_index_ties_and_zero_vectors(spark):
    rows = [(k, [1.0, 1.0, 0.0]) for k in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, float("nan"), 0.0])]
    found = multi_index.approximate_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in (0, 20, 40):
        assert sorted(r.vec_id for r in found if r.query_id == q) == [k for k in range(21) if k != q][:20]
    assert {r.query_id for r in found} == {0, 20, 40}


def test_cells_are_met_in_order_of_their_sum():
    rng = np.random.default_rng(7)
    a, b = rng.random(6), rng.random(5)
    sums = (a[:, None] + b).ravel()
    assert multi_index.cells_met(a, b, np.ones(30, int), 30) == np.argsort(sums).tolist()


# byte-level encoding


def test_encoding_round_trip(odd):
    encoder = rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    key = lambda k: -1 if k is None else k
    got = bpe.encode_documents(odd, bpe.BpeParams(chunk_bytes=20_000)).collect()
    assert sorted((key(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((key(k), encoder.encode_ordinary(t), t.encode()) for k, t in texts)
    digests = bpe.encode_documents(odd, output="digests").collect()
    want = [(key(k), len(i := encoder.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts]
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(want)
    assert bpe.encode_documents(odd.limit(0)).collect() == []


def test_decoding_goes_by_the_ids(spark):
    """A pattern that skips characters shows in what is decoded."""
    docs = spark.createDataFrame([(1, "it is 12 o'clock"), (2, ""), (3, None), (4, "987")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.encode_documents(docs, bpe.BpeParams(pattern="[a-z]+")).collect()}
    assert got == {1: b"itisoclock", 2: b"", 3: b"", 4: b""}
    digests = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.encode_documents(docs, bpe.BpeParams(pattern="[a-z]+"), "digests").collect()}
    assert digests[1][1] == hashlib.sha256(b"itisoclock").hexdigest() and digests[4] == (0, hashlib.sha256(b"").hexdigest())


def test_encoding_over_many_chunks_and_buckets(documents):
    """A hot word lies in every chunk; many small buckets and chunks give what the library gives."""
    docs = documents.limit(60).withColumn("text", F.concat(F.lit("the the the "), "text"))
    encoder = rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = bpe.encode_documents(docs.repartition(3), bpe.BpeParams(chunk_bytes=5000, bucket_bytes=3000)).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(want)
    assert all(list(r.ids) == encoder.encode_ordinary(want[r.doc_id]) and bytes(r.decoded) == want[r.doc_id].encode() for r in rows)


def test_fast_pattern_equals_the_given_one():
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in [*range(0x250), 0x2003, 0x4E00, 0x0664, 0x1F642]]
    for text in [*(t for t in ODD if t), *("".join(rng.choice(letters, 60)) for _ in range(300)), *("".join(rng.choice(list("ab1² '_\n\x1cé"), 40)) for _ in range(300))]:
        assert bpe.pre_tokens(text, public_tokenizers.PATTERN) == bpe.splitter(public_tokenizers.PATTERN).findall(text)


def test_rank_file_is_what_the_library_reads():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(path), special_tokens={})
    assert own.encode_ordinary("The quick brown fox") == rank_encoding(path).encode_ordinary("The quick brown fox")


# near duplicates


def brute_components(rows, params):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        n = min(params.words, len(words))
        sets.setdefault(key, []).append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    flat = [(k, s) for k, many in sets.items() for s in many if s]
    for (a, s), (b, t) in itertools.combinations(flat, 2):
        if 100 * len(s & t) >= params.percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("params", [near_dedup.DedupParams(), near_dedup.FIVE_WORDS])
def test_near_duplicates_equal_brute_force(spark, params):
    rng = np.random.default_rng(8)
    rows, key = [], 0
    for size in (4, 9, 30, 120):
        for _ in range(12):
            base = [f"w{i}" for i in rng.integers(0, 400, size)]
            for edits in rng.integers(0, 4, 6):
                copy = list(base)
                for at in rng.integers(0, size, edits):
                    copy[at] = f"w{rng.integers(0, 400)}"
                rows.append((key, " ".join(copy).upper() if key % 5 == 0 else "  ".join(copy)))
                key += 7
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    want = brute_components(rows, params)
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chain_of_copies_is_one_component(spark):
    """Each text is close to the next one only; stars alone would lose links."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 200])) for k in range(30)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, near_dedup.DedupParams())
    assert {r.component_id for r in found} == {0}


def test_near_duplicates_of_odd_rows(odd):
    found = near_dedup.near_duplicates(odd).collect()
    assert ids(found) == ids(odd.collect())
    by = {r.doc_id: r for r in found}
    assert by[13].component_id == 12 and not by[13].kept
    assert by[9].n_shingles == 0 and by[9].kept and by[10].component_id == 10
    assert by[None].kept and by[None].component_id is None
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert ids(kept.collect()) == [-1, *(k for k in range(16) if k not in (3, 13))]
    assert near_dedup.near_duplicates(odd.limit(0)).collect() == []


def test_sketches_of_equal_sets_are_equal_and_dense():
    params = near_dedup.DedupParams()
    memo = near_dedup.word_hashes()
    for text in (b"one", b"one two three four", b"a b c d e f g h"):
        s = near_dedup.shingle_set(text, 3, memo)
        assert (near_dedup.band_keys(s, params) == near_dedup.band_keys(s.copy(), params)).all()
        assert len(near_dedup.band_keys(s, params)) == params.bands


def test_components_of_paths_loops_and_hubs(spark):
    links = [(k, k + 1) for k in range(50)] + [(60, 60), (70, 71), (72, 71), (71, 70)] + [(90, k) for k in range(80, 100)] + [(99, 120)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(51)} | {70: 70, 71: 70, 72: 70} | {k: 80 for k in (*range(80, 100), 120)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
