"""Merkle manifest, filter audit and personal data against plain recomputations and the SQL, and on odd rows."""

from __future__ import annotations

import re
import zlib
from hashlib import sha256
from itertools import groupby, permutations
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from tributary.llm import filter_audit, merkle, pii, sql

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long, tree string, part string, rank long, n long, digest string, fails int, spans string, key string"
ODD_TEXTS = [None, "", " ", "A b", "A b", "É ABC", "word " * 40000, "Ünï|code", "x@y", "\x0b\x0c", "A b"]


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns that bear the operators' own names."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["z"] * 2, 7, 7, "z", 7, "z", "z") for r in rows], ROWS)


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def brute_manifest(rows, tampered):
    """Every row's (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), from the definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    leaf = lambda i, text, lang, source, n: h(map(field, (i, source, lang, n, text)))
    made = []
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        own = leaf(i, text, lang, source, n)
        made.append(((source is not None, (source or "").encode()), (i is not None, i or 0), own, leaf(i, text and text.translate(low), lang, source, n) if tampered(i) else None, i))
    made.sort(key=lambda m: (*m[:3], m[3] or ""))

    def tree(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[k : k + 16] for k in range(0, len(level), 16)]
            for k, p in enumerate(paths):
                run, place = runs[at[k] // 16], at[k] % 16
                p.append((run[:place], run[place + 1 :]))
            level, at = [h(r) for r in runs], [a // 16 for a in at]
        return (level or [""])[0], paths

    sources = [(k, list(g)) for k, g in groupby(made, key=lambda m: m[0])]
    built = [tree([m[2] for m in g]) for _, g in sources]
    root, tops = tree([b[0] for b in built])
    out = []
    for (_, group), (subroot, paths), top in zip(sources, built, tops, strict=True):
        for m, path in zip(group, paths, strict=True):
            folded = m[3] or m[2]
            for a, b in path + top:
                folded = h([*a, folded, *b])
            out.append((m[4], m[2], subroot, root, h([x for a, b in path + top for x in a + b]), folded, folded == root))
    return out


def fifth(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def check_manifest(spark, rows):
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows), merkle.tampered_fifth()).collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest(rows, fifth), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(k, t, "en" if k % 2 else None, [None, "", "a", "é", "B"][k % 5]) for k, t in enumerate(ODD_TEXTS)]
    check_manifest(spark, rows + rows[:3] + [(None, "A b", None, None), (None, "C", None, None), (3, "other text", "en", "é")])


def test_manifest_sizes(spark):
    """Sources at the borders of runs and blocks, and past the second level of blocks."""
    sizes = [1, 2, 16, 17, 255, 256, 257, 4096, 4113]
    check_manifest(spark, [(k, f"T{k}", "en", f"s{n}") for n in sizes for k in range(n)])


def test_one_source_of_one_block(spark):
    check_manifest(spark, [(k, f"T{k}", "en", None) for k in range(17)])


def test_manifest_of_many_sources(spark):
    check_manifest(spark, [(k, "T", "en", f"s{k * 7919 % 600}") for k in range(900)])


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(frame(spark, [(1, "a", None, None)]).limit(0), merkle.tampered_fifth()).collect() == []
    (row,) = merkle.manifest(frame(spark, [(1, "a", None, None)])).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha256().hexdigest() and row.verified


def test_appended_witnesses_fold_to_the_root():
    """A witness taken at append holds the earlier siblings; later ones extend it in place."""
    digests = [h([str(k)]).encode() for k in range(40)]
    tree = merkle.Appender(2)
    places = [tree.append(d) for d in digests[:20]]
    assert merkle.witness(*places[17]) == [(digests[16], digests[18] + digests[19])]
    places += [tree.append(d) for d in digests[20:]]
    root = tree.finish()
    for d, place in zip(digests, places, strict=True):
        path = merkle.witness(*place)
        assert merkle.fold(d, path) == root and merkle.unpacked(merkle.packed(path)) == path
        assert merkle.fold(b"0" * 64, path) != root


# Filter audit


def brute_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > first[text]]
        parts.setdefault(lang or "", []).append((dict(zip("ABCDE", fails, strict=True)), i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, docs in parts.items():
        removals = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removals[f] += len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                mine.append((part, "".join(order), k + 1, len(left), len(gone), sum(d[0][f] for d in docs) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], removals[r[-1]]) for r in mine]
    return out


def odd_documents():
    rng = Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD_TEXTS)]
    for k in range(20, 140):
        words = rng.choices(vocabulary[: rng.choice([60, 400])], k=rng.choice([90, 100, 130]))
        text = rng.choice(["\n", " ", "\t\r"]).join(w.upper() if rng.random() < rng.choice([0, 0.4]) else w for w in words) + rng.choice(["", "#", " | "])
        rows.append((k, rng.choice([text, text, "same " * 99 + "text"]), rng.choice(["en", "de", None, ""]), "s"))
    rows += [(7, rows[30][1], "fr", None), (None, rows[31][1], "fr", None), (None, "A b", "de", None), *rows[25:40], (30, "A b", "en", "s")]
    return rows


def test_audit_of_odd_rows(spark):
    rows = odd_documents()
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 140, 2)] + [(4, 1, 1), (4, 0, None), (4, 1, 1), (None, 1, 1), (6, None, None), (10**9, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("z") for c in ("key", "named", "part", "n", "good", "fails")})
    got = [tuple(r) for r in filter_audit.audit(frame(spark, rows), table).collect()]
    assert sorted(got) == sorted(brute_audit(rows, labels))
    assert filter_audit.audit(frame(spark, rows).limit(0), table).collect() == []
    empty = filter_audit.audit(frame(spark, rows[:3]), table.limit(0))
    assert [r.good_lost + r.toxic_lost for r in empty.collect()] == [0] * 600


def test_potential_equals_the_average_over_orders(spark):
    """Shapley values of arbitrary games: the recursion against all 120 orders."""
    rng = Random(5)
    values = [[0, *[rng.randrange(1000) for _ in range(31)]] for _ in range(5)]
    game = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, n array<long>")
    for row in filter_audit.with_shapley(game).collect():
        v, want = values[row.k], [0] * 5
        for order in permutations(range(5)):
            before = 0
            for i in order:
                want[i] += v[before | 1 << i] - v[before]
                before |= 1 << i
        assert list(row.shapley) == want


def test_copies_do_not_meet_in_one_task(spark):
    """A text that most rows share is summed before the shuffle: few rows of it reach its window."""
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"), F.lit("en").alias("lang")).repartition(8)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    cells = {(r.part, r.fails): (r.n, r.good, r.toxic) for r in filter_audit.coalitions(rows, labels).collect() if r.n}
    assert cells == {("en", 1): (1, 0, 0), ("en", 17): (19999, 1, 0)}


# Personal data


def brute_base(text):
    """The base spans from the patterns as they are stated."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(s))]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m.group())]
    return out


def noise(seed, n):
    rng = Random(seed)
    pieces = ["a@b.c", "@", ".", "+", "-", " ", "1", "12", "255", "256", "0300", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 010-9999", "x", "é", "🙂", "%", "_", "(", ")", "..", "a.b@c-d.e.f", "1.2.3.4", "+4", "\n", "DE89 3704 0044 0532 0130 00", "378282246310005"]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    for text in [*noise(1, 3000), "1.2.3.4.5.6.7.8.9", "a@b@c.d.e", "1.2.3.400.5.6.7.8", "+123 4567 (", "00255.1.1.1", None, ""]:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.spans(text) if s.kind in pii.BASE] == brute_base(text), text


def test_report(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate([*noise(2, 200), *ODD_TEXTS])] + [(None, "a@b.c", None, None), (1, "a@b.c", None, None)]
    want = []
    for i, text, *_ in rows:
        base = brute_base(text)
        every = [f"{s.kind}:{s.start}:{s.end}" for s in pii.spans(text)]
        want.append((i, *[sum(b.startswith(k + ":") for b in base) for k in pii.BASE], sha256(",".join(base).encode()).hexdigest(), ",".join(every)))
    got = [tuple(r) for r in pii.report(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pii.report(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Pay to IBAN DE89 3704 0044 0532 0130 00 today", ["iban"]),
        ("account GB82WEST12345698765432.", ["iban"]),
        ("plain DE89 3704 0044 0532 0130 00 ", ["iban"]),
        ("serial DE89 3704 0044 0532 0130 00", []),
        ("IBAN DE89 3704 0044 0532 0130 01", []),
        ("AB12 DE89370400440532013000", ["iban"]),
        ("ssn 219-09-9999", ["ssn"]),
        ("number 219-09-9999", []),
        ("ssn 000-09-9999", []),
        ("amex card 378282246310005", ["short_card"]),
        ("timestamp 378282246310005", []),
        ("amex card 378282246310006", []),
        ("call (212) 555-0182 now", ["local_phone"]),
        ("tel. 212-555-0182", ["local_phone"]),
        ("value 212-555-0182", []),
        ("automobile 212-555-0182", []),
        ("call +1 212-555-0182", ["phone"]),
    ],
)
def test_added_spans(text, kinds):
    assert [s.kind for s in pii.spans(text)] == kinds


def test_context_moves_scores():
    score = lambda text: pii.spans(text)[0].score
    assert score("version 1.2.3.4") < score("see 1.2.3.4") < score("server 1.2.3.4")
    assert score("server" + " " * 41 + "1.2.3.4") == score("see 1.2.3.4")


def test_long_texts_take_time_in_proportion():
    for unit in ("1", "1.", "a", "a.", "+1", "1 ", "A1", "AB12", "@", "a@", "1-", "(1"):
        assert pii.spans(unit * 200_000) is not None


def test_masked(spark):
    rows = [(1, "mail a@b.cd or +1 (555) 010-9999.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "nothing", "en", "s")]
    got = {r.doc_id: r.text for r in pii.masked(frame(spark, rows)).collect()}
    assert got == {1: "mail [email] or [phone].", 2: None, 3: "", 4: "nothing"}


# SQL


@pytest.mark.parametrize("which", ["manifest", "audit"])
def test_sql(spark, which):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    df = merkle.manifest(documents, merkle.tampered_fifth()) if which == "manifest" else filter_audit.audit(documents, labels)
    want = con.execute(sql.merkle_manifest(5) if which == "manifest" else sql.filter_audit())
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
