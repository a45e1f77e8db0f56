"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose ratio of two counts is beyond a cutoff. The cutoffs are chosen from labelled documents so
that, with probability 1 - DELTA over all strata and rules at once, a rule rejects at most its share of a stratum's good
documents. Rules' grids are fixed beforehand, from lax to strict. For a cutoff, an exact binomial test of "more than the
share is rejected" must fall below DELTA over rules and strata (Bonferroni); a stratum's cutoffs are tested in the grid's
order up to the first that fails (a fixed sequence, which needs no further correction). Of those that passed, all of which
hold at once, the one with most bad documents less good ones is taken; where none helps, the rule rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, hot_lookup, slices
from engram.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: The chance that any guarantee of any stratum fails.
DELTA = 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects if 1000 * ``number`` is over (or, for ``low``, under) cutoff * ``base``; ``share`` of good documents at most."""

    name: str
    number: str
    base: str
    share: float
    grid: tuple[int, ...]
    low: bool = False

    def rejects(self, cutoff: Column | int) -> Column:
        a, b = 1000 * F.col(self.number), cutoff * F.col(self.base)
        return a < b if self.low else a > b


#: Shares add up to a tenth of a stratum's good documents.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.04, (5000, 3000, 2000, 1500, 1000, 700, 500, 300, 200, 150, 100, 70, 50, 30)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.02, (900, 800, 700, 600, 500, 400, 300, 200, 150, 100)),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.02, (475, 450, 400, 350, 300, 250, 200, 150, 100, 50)),
    Rule("short_words", "word_chars", "n_words", 0.01, (1000, 1500, 2000, 2500, 3000, 3500, 4000), low=True),
    Rule("long_words", "word_chars", "n_words", 0.01, (30000, 20000, 15000, 12000, 10000, 9000, 8000, 7000)),
)


def _lists(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rows (their numbers) and the values of a list array without nulls."""
    at = array.offsets.to_numpy()
    return np.repeat(np.arange(len(array)), np.diff(at)), array.values.slice(at[0], at[-1] - at[0])


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs of small numbers by equal numbers below their count."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _features(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    text, n = pc.fill_null(batch.column("text"), ""), batch.num_rows
    total = lambda rows, by=None: np.bincount(rows, by, n).astype(np.int64)
    row, word = _lists(pc.split_pattern_regex(text, SPACE))
    real = pc.not_equal(word, "")
    row, word = row[real.to_numpy(zero_copy_only=False)], word.filter(real)
    out = {"n_words": total(row), "word_chars": total(row, pc.utf8_length(word).to_numpy())}
    out["n_symbols"] = pc.count_substring_regex(text, SYMBOLS).to_numpy().astype(np.int64)
    # words in windows of three of one text that it has twice: windows by number, then a mark on their three words
    ids = word.dictionary_encode().indices.to_numpy()
    hit = np.zeros(len(ids), bool)
    if len(ids) > 3:
        inside = row[2:] == row[:-2]
        window = _named(row[:-2], _named(_named(ids[:-2], ids[1:-1]), ids[2:]))
        twice = (np.bincount(window[inside], minlength=window.max() + 1) > 1)[window] & inside
        for i in range(3):
            hit[i : i + len(twice)] |= twice
    out["n_repeat_words"] = total(row[hit])
    row, line = _lists(pc.split_pattern(text, "\n"))
    real = pc.match_substring_regex(line, r"[^\x20\x09-\x0D]")
    row, line = row[real.to_numpy(zero_copy_only=False)], line.filter(real)
    out["n_lines"] = total(row)
    first = np.unique(row * (len(line) + 1) + line.dictionary_encode().indices.to_numpy(), return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - total(row[first])
    return out


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text and any other columns) with COUNTS in place of the text.

    n_words: runs without white space; word_chars: their code points; n_symbols: characters of SYMBOLS; n_lines: lines with a
    word; n_dup_lines: those that equal an earlier one; n_repeat_words: words in windows of three that the text has twice or
    more. A null text is empty. Texts are handled in slices of a few MB, a longer one by itself, with arrays of its words.
    """
    keep = [c for c in docs.columns if c != "text" and c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = _features(part)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(got[c]) for c in COUNTS)], [*keep, *COUNTS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep]
    return arrow_map(docs.select(*keep, "text"), run, ", ".join(kinds + [f"{c} bigint" for c in COUNTS]))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """The chance of at most k of n at p each: the sum of its terms from the greatest on, until they add nothing."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if k > n * p:  # the other tail has the smaller terms
        return 1.0 - binomial_cdf(n - k - 1, n, 1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    while k and term > total * 1e-17:
        term *= k / (n - k + 1) * (1 - p) / p
        k, total = k - 1, total + term
    return min(total, 1.0)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate, k of n seen, at confidence 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def choose(rule: Rule, good: list[int], bad: list[int], delta: float) -> tuple[int | None, int, int]:
    """(cutoff, good and bad rejected) from how many documents are first rejected at each place of the grid; the lists'
    last place counts those that no cutoff rejects."""
    n, best = sum(good), (None, 0, 0)
    k = caught = 0
    for i, cutoff in enumerate(rule.grid):
        k, caught = k + good[i], caught + bad[i]
        if not n or binomial_cdf(k, n, rule.share) > delta:
            break
        if caught - k > best[2] - best[1]:
            best = (cutoff, k, caught)
    return best


def cutoffs(counts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_bad, good_rejected, bad_rejected, bound) by labelled rows of ``counts``.

    ``counts``: doc_id, stratum, COUNTS and base_failed; rows that fail the base are not counted. ``labels``: doc_id, quality;
    a document with differing labels is bad, one with several rows counts by its least row, null ids and labels are left out.
    The driver learns how many strata there are, no more; a stratum's table has a row for each place of the grids.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    least = counts.filter("doc_id is not null and not base_failed").groupBy("doc_id").agg(F.min(F.struct("stratum", *COUNTS)).alias("x")).select("doc_id", "x.*")
    place = lambda r: sum((F.when(r.rejects(c), 0).otherwise(1) for c in r.grid), F.lit(0))
    hits = least.join(marked, "doc_id").select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), place(r).alias("at")) for i, r in enumerate(rules)))).alias("x"))
    hits = hits.groupBy("stratum", "x.rule", "x.at", "good").agg(F.count("*").alias("n"))
    hits = materialize(hits.groupBy("stratum", "rule").agg(F.collect_list(F.struct("at", "good", "n")).alias("hits"), F.sum(F.col("good") * F.col("n")).alias("n_good"), F.sum((1 - F.col("good")) * F.col("n")).alias("n_bad")), "risk-hits")
    strata = hits.filter("n_good > 0").agg(F.count_distinct("stratum")).first()[0]
    level = delta / (len(rules) * max(strata, 1))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                rule = rules[r["rule"]]
                seen = [[0] * (len(rule.grid) + 1) for _ in (0, 1)]
                for h in r["hits"]:
                    seen[h["good"]][h["at"]] += h["n"]
                cut, k, caught = choose(rule, seen[1], seen[0], level)
                out.append({"stratum": r["stratum"], "rule": rule.name, "cutoff": cut, "n_good": r["n_good"], "n_bad": r["n_bad"], "good_rejected": k, "bad_rejected": caught, "bound": upper_bound(k, r["n_good"], level) if r["n_good"] else 1.0})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    kinds = {"stratum": pa.string(), "rule": pa.string(), "cutoff": pa.int64(), "n_good": pa.int64(), "n_bad": pa.int64(), "good_rejected": pa.int64(), "bad_rejected": pa.int64(), "bound": pa.float64()}
    schema = pa.schema(list(kinds.items()))
    return arrow_map(hits, decide, "stratum string, rule string, cutoff bigint, n_good bigint, n_bad bigint, good_rejected bigint, bad_rejected bigint, bound double")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, delta: float = DELTA) -> DataFrame:
    """(doc_id, stratum, COUNTS, base_failed, kept, failed): ``failed`` names the rules that reject, parted by commas.

    Base: under 50 words, or over half of them in repeated windows. A null stratum is one of its own, beside ''; strata
    without enough labelled good documents have no cutoffs and lose nothing. Null texts and ids stay, repeated rows each; an
    empty table gives no rows, without labels only the base rejects. Ties with a cutoff are kept.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    counts = text_counts(docs.select("doc_id", named.alias("stratum"), "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = materialize(counts.withColumn("base_failed", base), "risk-counts")
    chosen = cutoffs(counts, labels, rules, delta).filter("cutoff is not null")
    wide = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules))
    wide = wide.join(counts.groupBy("stratum").agg(F.count("*").alias("rows")), "stratum")
    rows = hot_lookup(counts, materialize(wide, "risk-cutoffs"), "stratum", "rows", "left")
    failed = F.concat_ws(",", *(F.when(r.rejects(F.col(f"cut_{r.name}")), r.name) for r in rules))
    rows = rows.withColumn("failed", failed)
    return rows.select("doc_id", F.when(F.col("stratum") != "", F.substr("stratum", F.lit(2))).alias("stratum"), *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
