"""How five document filters interact, over all 120 orders in which they can be applied.

A set of filters is a coalition; it removes the documents that fail any of them.  The game has one
value a coalition and part of the table, 32 in all, and each order is a walk from the empty
coalition to the grand one: what a step removes is the difference of two values.  A filter's Shapley
value comes from the Hart-Mas-Colell potential, defined over coalitions by recursion: the
potential of the grand coalition less that of the one without the filter.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters in the order of their bits.
FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
_SPACE = " \t\n\x0b\x0c\r"
_COUNTS = ("n", "good", "toxic")


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, text_key (digest of the text), fails (bits of the filters A to D that the text fails).

    A: under 100 words; B: fewer than 80 % of the words distinct; C: over 10 % upper case A-Z; D: one of #$%&*|.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit(_SPACE)).alias("trimmed"))
    rows = rows.withColumn("words", F.when(F.col("trimmed") != "", F.split("trimmed", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")))
    upper = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [F.size("words") < 100, F.size(F.array_distinct("words")) * 100 < F.size("words") * 80, upper * 100 > F.length("text") * 10, F.col("text").rlike("[#$%&*|]")]
    bits = reduce(lambda a, b: a + b, [t.cast("int") * 2**k for k, t in enumerate(tests)])
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), bits.alias("fails"))


def _marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of rows, good rows and toxic rows by doc_id, part, text and failures.

    Rows without an id have no label: they are dealt by their text, not by the null.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("text_key")), "named": F.col("doc_id").isNotNull()})
    joined = keyed.join(known.select(F.col("doc_id").alias("key"), F.lit(True).alias("named"), "q", "t"), ["key", "named"], "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return joined.groupBy("key", "named", "doc_id", "part", "text_key", "fails").agg(F.count("*").alias("n"), one("q").alias("good"), one("t").alias("toxic"))


def coalitions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by the exact set of filters that they fail.

    E, a text equal to one of a smaller id anywhere in the table, needs no look at copies one by one: of a
    text's rows those with its least id pass and the others fail.  Copies are summed before they meet, by
    text and part, so a text that a third of the rows share stays a few rows a task.
    """
    marked = _marked(failures(documents), labels)
    named = F.col("doc_id").isNotNull()
    least = F.min(F.when(named, F.struct("doc_id", *_COUNTS))).alias("least")
    texts = marked.groupBy("text_key", "part", "fails").agg(*[F.sum(F.when(named, F.col(c))).alias(c) for c in _COUNTS], *[F.sum(F.when(~named, F.col(c))).alias(f"free_{c}") for c in _COUNTS], least)
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("text_key"))  # a row a part
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    texts = texts.withColumn("is_first", F.coalesce(first, F.lit(False)))
    kept = {c: zero(F.when(F.col("is_first"), F.col(f"least.{c}"))) for c in _COUNTS}
    passing = texts.select("part", "fails", *[(zero(F.col(f"free_{c}")) + kept[c]).alias(c) for c in _COUNTS], *[(zero(F.col(c)) - kept[c]).alias(f"copy_{c}") for c in _COUNTS])
    cells = passing.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in (*_COUNTS, *[f"copy_{c}" for c in _COUNTS])])
    both = F.array(F.struct("fails", *_COUNTS), F.struct((F.col("fails") + 16).alias("fails"), *[F.col(f"copy_{c}").alias(c) for c in _COUNTS]))
    return cells.select("part", F.explode(both).alias("x")).select("part", "x.*")


def games(cells: DataFrame) -> DataFrame:
    """(part, total, n, good, toxic): by part all documents and, as arrays over coalitions, what each removes."""
    value = lambda c, s: F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, F.col(c)).otherwise(0))
    return cells.groupBy("part").agg(F.sum("n").alias("total"), *[F.array(*[value(c, s) for s in range(ALL + 1)]).alias(c) for c in _COUNTS])


def with_shapley(game: DataFrame) -> DataFrame:
    """Add shapley, an array by filter: its removals summed over all 120 orders.

    |S| P(S) = v(S) + the sum of P(S without i).  With Q(S) = |S|! P(S) all is whole numbers:
    Q(S) = (|S| - 1)! v(S) + the sum of Q(S without i); 120 (P(all) - P(all without i)) = Q(all) - 5 Q(all without i).
    """
    value: dict[int, Column] = {0: F.lit(0).cast("long")}
    size = lambda s: s.bit_count()
    name = lambda s: f"potential_{s}"
    for k in range(1, len(FILTERS) + 1):
        new = {s: reduce(lambda a, b: a + b, [value[s & ~(1 << i)] for i in range(len(FILTERS)) if s >> i & 1], F.element_at("n", s + 1) * factorial(k - 1)) for s in range(ALL + 1) if size(s) == k}
        game = game.withColumns({name(s): c for s, c in new.items()})
        value |= {s: F.col(name(s)) for s in new}
    shapley = [value[ALL] - value[ALL & ~(1 << i)] * len(FILTERS) for i in range(len(FILTERS))]
    return game.withColumn("shapley", F.array(*shapley)).drop(*[name(s) for s in range(1, ALL + 1)])


def _walks() -> Column:
    """The steps of all orders, as one constant: order, step, filter, coalition before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "filter": FILTERS.index(f), "before": before})
            before |= 1 << FILTERS.index(f)
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    600 rows for each value of lang (null counts as the empty string); an empty table gives none.  Null texts are
    empty texts.  A row without an id is no copy of another and no other is a copy of it; rows that share the
    least id of a text all pass E.  A row is good (toxic) if any label row of its id says quality 1 (toxic 1);
    labels of repeated ids do not count twice.  Extra columns are ignored.
    """
    game = with_shapley(games(coalitions(documents, labels)))
    rows = game.select("*", F.explode(_walks()).alias("at")).select("*", "at.*")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("filter") + 1)
    after = F.col("before") + bit
    value = lambda c, s: F.element_at(c, s + 1)
    step = lambda c: value(c, after) - value(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - value("n", after)).alias("kept"), step("n").alias("removed"), (value("n", bit) - step("n")).alias("redundant"),
        (value("n", F.lit(ALL)) - value("n", F.lit(ALL) - bit)).alias("unique_fails"), step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), F.element_at("shapley", F.col("filter") + 1).alias("shapley"),
    )
