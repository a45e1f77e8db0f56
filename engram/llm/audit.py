"""Filter interaction audit: which of five filters take a document, alone or together, in every order of applying them.

A relational word pipeline: words are exploded and counted by (document, word), then by document, which gives totals and
distinct words; the flags of the other filters are outer-joined; one aggregation has a conditional count for each of the 32
sets of failed filters. Every figure of every order follows from these 32 counts of a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import hot_lookup
from engram.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS = 1 << len(FILTERS)
MEASURES = ("n", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def keyed(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, g, h, k): the text is never null; (g, h) tells documents apart, (h, k) their texts.

    g is the id, or a second hash of the text where there is no id, so rows without ids are dealt like others.
    """
    t = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("*", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k"))
    return t.select("*", F.coalesce("doc_id", "k").alias("g"))


def word_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_words, n_distinct) of rows (keys, text), documents being told by ``keys``, by (document, word), then by document.

    A blank before the text gives every row one empty word: documents without words have a row, and repeated rows are
    told by the number of their empty words.
    """
    blanks = F.lit(" \t\n\x0b\f\r")
    words = F.split(F.rtrim(F.concat(F.lit(" "), "text"), blanks), r"[\x20\x09-\x0D]+")
    counts = rows.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("c"))
    real = F.col("word") != ""
    sums = counts.groupBy(*keys).agg(F.sum(F.when(real, F.col("c")).otherwise(0)).alias("all"), F.sum(F.when(real, 1).otherwise(0)).alias("n_distinct"), F.sum(F.when(~real, F.col("c"))).alias("copies"))
    return sums.select(*keys, F.expr("all div copies").alias("n_words"), "n_distinct")


def filter_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, A, B, C, D, E, good, toxic): ``n`` documents of a part that fail these filters (booleans).

    A: under 200 words; B: under half of the words are distinct; C: over 2 % capital letters; D: holds any of ``#$%&*|``;
    E: the text of a smaller id. good and toxic: a label row of the id says so. A document without id is no copy and has no
    label; repeated rows count each; null texts are empty, null sources the part ''.
    """
    rows = keyed(docs)
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    own = rows.select("part", "doc_id", "g", "h", "k", (100 * capitals > 2 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"))
    own = materialize(own.groupBy(*own.columns).agg(F.count("*").alias("n")), "audit-rows")
    first = own.groupBy("h", "k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")).filter("rows > 1")
    own = hot_lookup(own, materialize(first, "audit-copies"), ["h", "k"], "rows", "left")
    # every word carries what tells its document: g alone, unless different texts share one
    shared = own.groupBy("g").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").limit(1).count()
    keys = ["g", "h"] if shared else ["g"]
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("g")).agg(one("quality").alias("q"), one("toxic").alias("t"))
    out = own.join(word_totals(rows.select(*keys, "text"), keys), keys, "left").join(marks, "g", "left")
    words = F.coalesce("n_words", F.lit(0))
    fails = {"A": words < 200, "B": 100 * F.coalesce("n_distinct", F.lit(0)) < 50 * words, "C": F.col("C"), "D": F.col("D"), "E": F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))}
    marked = lambda c: F.col("doc_id").isNotNull() & F.coalesce(F.col(c), F.lit(False))
    return out.select("part", "n", *(c.alias(f) for f, c in fails.items()), marked("q").alias("good"), marked("t").alias("toxic"))


def interaction_counts(flags: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 counts by the set of failed filters, A being 1 and E 16."""
    mask = sum((F.col(f).cast("int") * _bit(f) for f in FILTERS), F.lit(0))
    rows = flags.select("part", mask.alias("mask"), "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    sums = rows.groupBy("part").agg(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in MEASURES for m in range(SETS)))
    return sums.select("part", *(F.array(*(f"{c}{m}" for m in range(SETS))).alias(c) for c in MEASURES))


def interaction_report(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``interaction_counts``.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost count documents of the part; shapley is what the step's
    filter removes, summed over all orders: of a set of s failed filters each is the first in 120/s of the orders.
    """
    order, step = F.col("filter_order"), F.col("step")
    rows = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step"))
    place = {f: F.instr(order, f) for f in FILTERS}
    masks = lambda test: sum((F.when(test(place[f]), _bit(f)).otherwise(0) for f in FILTERS), F.lit(0))
    rows = rows.withColumns({"before": masks(lambda at: at < step), "bit": masks(lambda at: at == step)})
    before, bit = F.col("before"), F.col("bit")

    def over(measure: str, test, weight=lambda x, m: x) -> Column:
        picked = F.transform(measure, lambda x, m: F.when(test(m), weight(x, m)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, b: a + b)

    meets = lambda m, b: m.bitwiseAND(b) != 0
    removed = lambda m: meets(m, bit) & ~meets(m, before)
    parts = F.lit(len(ORDERS)).cast("bigint")
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: ~meets(m, before.bitwiseOR(bit))).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: meets(m, bit) & meets(m, before)).alias("redundant"),
        over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("n", lambda m: meets(m, bit), lambda x, m: x * (parts / F.bit_count(m)).cast("bigint")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interaction_report`` of the five filters over whole texts. An empty table has no parts and so no rows; very long texts
    are exploded like others and counted before the shuffle; other columns are left out, whatever their names."""
    return interaction_report(interaction_counts(filter_flags(docs, labels)))
