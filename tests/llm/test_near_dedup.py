"""Near-duplicates: repeated ids, crowded shingles, hot classes, and which row stays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components

from tributary.llm import near_dedup


def found_by(spark, rows, params=near_dedup.DedupParams()):
    return near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params)


def test_one_id_with_two_texts_links_by_each(spark):
    rng = np.random.default_rng(1)
    a, b = (" ".join(f"{x}{i}" for i in rng.integers(0, 500, 60)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, "else where is this"), (9, None), (4, "")]
    got = found_by(spark, rows).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 8: 5, 9: 9, 4: 4} == brute_components(rows, near_dedup.DedupParams())
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.DedupParams()).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 9) == [(4, ""), (5, min(a, b))]
    assert [r.text for r in kept if r.doc_id == 9] == [None]  # nulls come first


@pytest.mark.parametrize("crowd", [2, 64])
def test_blocks_of_crowded_shingles_equal_brute_force(spark, crowd):
    """Texts of one template around the threshold, some of them linked in chains, of many sizes."""
    rng = np.random.default_rng(2)
    base, rows = [f"t{i}" for i in range(120)], []
    for k in range(150):
        size = int(rng.integers(60, 120))
        text = list(base[:size])
        for at in rng.integers(0, size, rng.integers(0, 4)):
            text[at] = f"w{rng.integers(0, 6)}"
        rows.append((k, " ".join(text)))
    params = near_dedup.DedupParams(crowd=crowd, block=7, percent=90, rows=10)
    assert {r.doc_id: r.component_id for r in found_by(spark, rows, params).collect()} == brute_components(rows, params)


def test_blocks_find_what_the_join_finds(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice([f"x{i}" for i in range(6)], int(rng.integers(5, 25))))) for k in range(200)]
    nodes = spark.createDataFrame([(k, k) for k, _ in rows], "node long, c long")
    import zstandard

    texts = spark.createDataFrame([(k, bytearray(zstandard.ZstdCompressor().compress(t.encode()))) for k, t in rows], "node long, z binary")
    pairs = [{(r.a, r.b) for r in near_dedup.prefix_pairs(nodes, texts, near_dedup.DedupParams(percent=50, words=2, crowd=c, block=5)).collect()} for c in (1, 10**6)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_hot_classes_and_rows_without_class(spark):
    rows = [(k, "the same text as all of these have") for k in range(200)] + [(k, None) for k in range(200, 300)] + [(400, "the same text as all of these have got"), (None, "the same text as all of these have")]
    for hot in (10, 10_000):
        got = found_by(spark, rows, near_dedup.DedupParams(hot_rows=hot, percent=80)).collect()
        assert len(got) == len(rows)
        assert {r.component_id for r in got if r.doc_id is not None and (r.doc_id < 200 or r.doc_id == 400)} == {0}
        assert all(r.kept and r.component_id == r.doc_id for r in got if r.doc_id is not None and 200 <= r.doc_id < 300)


def test_candidate_pairs_of_a_template_grow_in_proportion(spark):
    """Texts that share four fifths of their shingles without being near-duplicates."""

    def pairs(n):
        rng = np.random.default_rng(4)
        base = [f"t{i}" for i in range(200)]
        rows = [(k, " ".join([*base, *(f"r{rng.integers(0, 10**9)}" for _ in range(45))])) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        params = near_dedup.DedupParams()
        texts = near_dedup.moved_texts(docs, docs.select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("t")))
        return near_dedup.prefix_pairs(docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("c")), texts, params).count()

    assert pairs(600) <= 2.5 * pairs(300) + 10


def test_ids_with_two_texts_link_two_classes_once(spark):
    """Hundreds of ids have the same two texts, and hundreds the first alone."""
    one, two = "the one text that most of these rows have", "quite another text of which there are fewer"
    rows = [(k, t) for k in range(300) for t in (one, two)] + [(k, one) for k in range(300, 600)] + [(700, two), (800, "a third one which stands alone here")]
    real = near_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.DedupParams())
    assert near_dedup._named_twice(real).count() == 1
    got = {r.doc_id: r.component_id for r in found_by(spark, rows).collect()}
    assert got == {**dict.fromkeys([*range(600), 700], 0), 800: 800}


def test_filter_of_texts_loses_none_and_grows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    wanted = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("t"))
    for size in (1 << 25, 64):  # 512 bits for 1000 rows: all pass, and the join decides
        assert sorted(r.node for r in near_dedup.moved_texts(docs, wanted, size).select("node").collect()) == list(range(0, 3000, 3))


def test_keep_one_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, `odd name` string")
    assert near_dedup.keep_one(none).collect() == [] and near_dedup.keep_one(none).columns == none.columns
