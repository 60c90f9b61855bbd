"""DuckDB SQL of the queries that SQL can express."""

EXACT_SEARCH = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""


#: crc32 of a decimal text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def merkle_manifest(levels: int = 8) -> str:
    """All levels of both trees written out: enough for 16 to the power of ``levels`` leaves a source, and as many sources."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"  # noqa: E731
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"  # noqa: E731
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""rows AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf,
          CASE WHEN doc_id IS NOT NULL AND {_CRC32.format(x="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)""",
        """docs AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM rows)""",
        "s0 AS (SELECT tree, r, leaf AS h, n FROM docs)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            at = "CASE WHEN n > 1 THEN r // 16 ELSE r END"
            parts.append(f"{name}r{k} AS (SELECT tree, {at} AS p, string_agg(h, '' ORDER BY r) AS run FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}w{k} AS (SELECT a.tree, a.r, a.n > 1 AS more, substr(run, 1, 64 * (r % 16)) AS lft, substr(run, 64 * (r % 16) + 65) AS rgt FROM {name}{k} a JOIN {name}r{k} b ON a.tree = b.tree AND b.p = {at})")
            parts.append(f"{name}{k + 1} AS (SELECT a.tree, p AS r, CASE WHEN any_value(n) > 1 THEN sha256(any_value(run)) ELSE any_value(run) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k} a JOIN {name}r{k} b ON a.tree = b.tree AND b.p = {at} GROUP BY a.tree, p)")

    tree("s")
    parts.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, h, count(*) OVER () AS n FROM s{levels})")
    parts.append(f"names AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS q FROM s{levels})")
    tree("t")
    parts.append("f0 AS (SELECT d.doc_id, d.leaf, d.tree, d.r, x.q, coalesce(d.other, d.leaf) AS h, '' AS proof, row_number() OVER () AS i FROM docs d JOIN names x ON x.tree = d.tree)")
    for k in range(2 * levels):
        name, key = ("s", "a.tree = b.tree AND a.r = b.r") if k < levels else ("t", "a.q = b.r")
        up = "CASE WHEN more THEN {0} // 16 ELSE {0} END AS {0}"
        parts.append(
            f"f{k + 1} AS (SELECT doc_id, leaf, a.tree, {up.format('a.r') if name == 's' else 'a.r'}, {'q' if name == 's' else up.format('q')}, i, "
            f"CASE WHEN more THEN sha256(lft || h || rgt) ELSE h END AS h, proof || CASE WHEN more THEN lft || rgt ELSE '' END AS proof FROM f{k} a JOIN {name}w{k % levels} b ON {key})".replace("AS a.r", "AS r")
        )
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM f{2 * levels} f JOIN s{levels} s ON s.tree = f.tree CROSS JOIN t{levels} t"""


def filter_audit() -> str:
    """Every order walked step by step over the counts by the set of filters that fail."""
    return r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT t.doc_id, part, t.text, coalesce(t.doc_id > first, false) AS copy, regexp_extract_all(t.text, '[^ 	-]+') AS w FROM texts t JOIN least l ON l.text = t.text),
failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(copy AS INTEGER) AS fails
  FROM words LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, 1 << strpos('ABCDE', substr(filter_order, step, 1)) - 1 AS bit,
    CAST(list_sum(list_transform(range(1, step), lambda k: 1 << strpos('ABCDE', substr(filter_order, k, 1)) - 1)) AS INTEGER) AS before
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
walked AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & coalesce(before, 0) <> 0 AND fails & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails & coalesce(before, 0) = 0 AND fails & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM walked
"""
