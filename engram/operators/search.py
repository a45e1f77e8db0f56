"""Retrieval: inverted index and BM25, field-weighted and OR search, keyword overlap, lexical evidence, fusion, metrics."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.session import materialize

K1, B = 1.5, 0.75
#: Mode weights of the search profiles, and the words that choose one, in order.
PROFILES = {
    "general": {"semantic": 0.5, "keyword": 0.3, "graph": 0.2},
    "code_search": {"semantic": 0.2, "keyword": 0.2, "graph": 0.1, "code": 0.5},
    "decision_recall": {"semantic": 0.4, "keyword": 0.2, "graph": 0.3, "causal": 0.1},
    "error_investigation": {"semantic": 0.3, "keyword": 0.2, "graph": 0.2, "causal": 0.3},
    "temporal": {"semantic": 0.4, "keyword": 0.4, "graph": 0.2},
}
PROFILE_WORDS = {
    "code_search": ["function", "class", "import", "variable", "module", "type", "interface"],
    "decision_recall": ["decided", "decision", "chose", "choice", "why"],
    "error_investigation": ["error", "exception", "crash", "fail", "broken", "issue"],
    "temporal": ["recent", "latest", "today", "yesterday"],
}


def words_of(query: str, least: int = 1) -> list[str]:
    """The tokeniser of ``functions.text.tokens`` for a literal."""
    cleaned = re.sub(r"[^\w\s]", " ", query.lower(), flags=re.ASCII)
    return [w for w in cleaned.split() if len(w) >= least]


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def postings(docs: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    """(term, id, tf)."""
    exploded = docs.select(id_col, F.explode(tx.tokens(F.col(text_col), least)).alias("term"))
    return exploded.groupBy("term", id_col).agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    return docs.select(id_col, F.size(tx.tokens(F.col(text_col), least)).cast("bigint").alias("doc_len"))


def corpus_stats(docs: DataFrame, text_col: str, least: int = 1) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.avg(F.size(tx.tokens(F.col(text_col), least))).alias("avg_len"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", least: int = 1, multiset: bool = False, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents that share a term with the query; corpus figures stay global under ``where``.

    One pass finds each document's length and its counts of the query's terms (a bounded list), so nothing is exploded
    and only matching documents go on; the corpus figures are one row. ``multiset``: repeated query terms count again.
    """
    terms = Counter(words_of(query, least))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    names = sorted(terms)
    words = tx.tokens(F.col(text_col), least)
    counted = docs.withColumn("_w", words).withColumn("_len", F.size("_w"))
    tf = [_count(F.col("_w"), t) for t in names]
    counted = counted.select(*docs.columns, "_len", *(c.alias(f"_tf{i}") for i, c in enumerate(tf)))
    figures = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(names))))
    hits = counted.filter(" or ".join(f"_tf{i} > 0" for i in range(len(names))))
    if where is not None:
        hits = hits.filter(where)
    norm = 1 - b + b * F.col("_len") / F.col("_avg")
    score = F.lit(0.0)
    for i, t in enumerate(names):
        f, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, (terms[t] if multiset else 1) * idf * f * (k1 + 1) / (f + k1 * norm)).otherwise(0.0)
    return hits.crossJoin(F.broadcast(figures)).select(id_col, score.alias("score"))  # one row


def top(scored: DataFrame, k: int, id_col: str = "doc_id", low: int = 1, high: int = 1000) -> DataFrame:
    return scored.orderBy(F.desc("score"), id_col).limit(max(low, min(k, high)))


def ranked(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A short list with its 1-based rank; callers pass the rows of a top-k."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def and_search(docs: DataFrame, query: str, fields: dict[str, float], id_col: str) -> DataFrame:
    """Field-weighted BM25 of documents that hold every term in some field, then the lexical post-filter.

    Fields are joined into one bag of words, each counted by its weight (k1 1.2); unstemmed.
    """
    terms = sorted(set(words_of(query)))
    bag = F.concat(*(tx.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields))
    has = None
    for t in terms:
        has = F.array_contains(bag, t) if has is None else has & F.array_contains(bag, t)
    score = F.lit(0.0)
    n, length = F.col("_n"), F.col("_len")
    rows = docs.withColumn("_len", F.size(bag))
    figures = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.array_contains(bag, t)).alias(f"_df{i}") for i, t in enumerate(terms)))
    hits = rows.filter(has).crossJoin(F.broadcast(figures))  # one row
    for i, t in enumerate(terms):
        tf = sum((_count(tx.tokens(F.coalesce(F.col(f), F.lit(""))), t) * w for f, w in fields.items()), F.lit(0.0))
        idf = F.log(1 + (n - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        score = score + idf * tf * 2.2 / (tf + 1.2 * (1 - B + B * length / F.col("_avg")))
    return hits.select(id_col, score.alias("score"))


def or_parts(raw: str) -> tuple[list[str], list[str]]:
    """(phrases, terms) of a query: quoted phrases, then words without operators."""
    phrases = [p for x in re.findall(r'"([^"]+)"', raw) if (p := re.sub(r"[*^(){}:]", " ", x).strip())]
    rest = re.sub(r'"[^"]+"', " ", raw)
    rest = re.sub(r"(?i)\b(AND|OR|NOT|NEAR)\b", " ", re.sub(r"[^a-zA-Z0-9_\s]", " ", rest))
    return phrases, rest.split()


def or_search(docs: DataFrame, raw: str, text_col: str, id_col: str = "doc_id", tags_col: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """BM25 of documents with any term or phrase, and, with ``tags``, all of those."""
    phrases, terms = or_parts(raw)
    bag = F.array_join(tx.tokens(F.col(text_col)), " ")
    phrase_hit = F.lit(False)
    for p in phrases:
        phrase_hit = phrase_hit | F.concat(F.lit(" "), bag, F.lit(" ")).contains(" " + " ".join(words_of(p)) + " ")
    where = None
    if tags:
        for t in tags:
            where = F.array_contains(tags_col, t) if where is None else where & F.array_contains(tags_col, t)
    joined = " ".join([*terms, *(w for p in phrases for w in words_of(p))])
    term_hit = F.lit(False)
    if terms:
        term_hit = F.arrays_overlap(tx.tokens(F.col(text_col)), F.array(*(F.lit(w) for w in words_of(" ".join(terms)))))
    found = phrase_hit | term_hit
    return bm25(docs, joined, id_col, text_col, where=found if where is None else found & where)


def overlap_score(haystack: Column, query: str) -> Column:
    """Share of the query's keywords that the text contains; of a query of stop words only, 0.5 if it is contained."""
    words = [w for w in dict.fromkeys(re.sub(r"[^a-z0-9\s]", " ", query.lower()).split()) if len(w) >= 2 and w not in tx.STOP_WORDS]
    low = F.lower(haystack)
    if not words:
        return F.when(low.contains(query.strip().lower()), 0.5).otherwise(0.0)
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return hits / float(len(words))


def recall_overlap(memories: DataFrame, query: str, text: Column, id_col: str, floor: float = 0.2, limit: int = 5) -> DataFrame:
    return top(memories.select(id_col, overlap_score(text, query).alias("score")).filter(F.col("score") >= floor), limit, id_col)


def misses(docs: DataFrame, passages: DataFrame, id_col: str, text_col: str = "text", width: int = 5) -> DataFrame:
    """(id) of the passages that no document holds whole.

    What stands between a passage's first and last space-parted word stands so in a document that holds it; so passages meet
    documents by a run of ``width`` words in their middle, and only documents that have it are compared. Passages of fewer
    words, a few rows, are compared with all. A null passage is in no document, an empty one in all that aren't null.
    """
    words = F.split(text_col, " ", -1)
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - width), lambda i: F.xxhash64(F.array_join(F.slice("_w", i + 1, width), " ")))
    mine = passages.select(id_col, F.col(text_col).alias("_passage"), words.alias("_w"))
    long = mine.filter(F.size("_w") >= width + 2)
    at = F.floor((F.size("_w") - width) / 2).cast("int")
    keyed = long.select(id_col, "_passage", F.xxhash64(F.array_join(F.slice("_w", at + 1, width), " ")).alias("_run"))
    theirs = docs.select(text_col, words.alias("_w")).filter(F.size("_w") >= width).select(text_col, F.explode(F.array_distinct(runs)).alias("_run"))
    found = theirs.join(keyed, "_run").filter(F.col(text_col).contains(F.col("_passage"))).select(id_col)
    short = mine.filter(F.size("_w") < width + 2).select(id_col, "_passage")
    found = found.unionByName(docs.select(text_col).join(F.broadcast(short), F.col(text_col).contains(F.col("_passage"))).select(id_col))
    return passages.select(id_col).join(found.distinct(), id_col, "left_anti")


def lexical_terms(query: str) -> list[str]:
    words = re.sub(r"[^A-Za-z0-9_]+", " ", query).lower().split()
    return [w for w in words if w not in ("and", "or", "not", "near")]


def lexical_evidence(path: Column, content: Column, query: str) -> Column:
    """Term overlap (none below a floor), a bonus for the raw query and for its early place; route literals must occur."""
    terms = lexical_terms(query)
    if not terms:
        return F.lit(1)
    hay = F.lower(F.concat(path, F.lit("\n"), content))
    overlap = sum((hay.contains(t).cast("int") for t in terms), F.lit(0))
    least = min(3 if len(terms) >= 4 else 2 if len(terms) >= 2 else 1, len(terms))
    score = F.when(overlap >= least, overlap).otherwise(0)
    raw = query.strip().lower()
    bare = re.sub("[\"'`]", "", raw)

    def early(text: str) -> Column:
        at = F.instr(hay, text) - 1
        return F.when(at <= 80, 2).when(at <= 200, 1).otherwise(0)

    bonus = F.when(hay.contains(raw), 5 + early(raw)).when(hay.contains(bare), 3 + early(bare)).otherwise(0) if bare else F.lit(0)
    routes = [r for r in re.findall(r"/[a-z0-9][a-z0-9/_-]*", raw) if len(r) >= 6]
    total = score + bonus
    if routes:
        total = F.when(F.arrays_overlap(F.array(*(F.when(hay.contains(r), r) for r in routes)), F.array(*map(F.lit, routes))), total).otherwise(0)
    return total


def detect_profile(query: str) -> str:
    low = query.lower()
    found = {re.sub(r"\W", "", t, flags=re.ASCII) for t in low.split()}
    for name, words in PROFILE_WORDS.items():
        if found & set(words) or (name == "temporal" and "last week" in low):
            return name
    return "general"


def profile_column(query: Column) -> Column:
    """``detect_profile`` for a column of queries."""
    found = F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.regexp_replace(t, r"[^\w]", ""))
    out = F.lit("general")
    for name, words in reversed(PROFILE_WORDS.items()):
        hit = F.arrays_overlap(found, F.array(*map(F.lit, words)))
        if name == "temporal":
            hit = hit | F.lower(query).contains("last week")
        out = F.when(hit, name).otherwise(out)
    return out


def causal_boost(weights: dict[str, float], query: str) -> dict[str, float]:
    """With a causal question, 1.5 times the causal weight, then a sum of 1."""
    low = query.lower()
    asked = re.search(r"\b(why|what caused|reason|because|due to)\b", low) or re.search(r"\b(what if|consequence|result|effect|impact|leads to)\b", low)
    if not asked or not weights.get("causal"):
        return dict(weights)
    boosted = {k: v * 1.5 if k == "causal" else v for k, v in weights.items()}
    total = sum(boosted.values())
    return {k: v / total for k, v in boosted.items()}


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, id_col: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists. With weights: sum w / (k + rank) over the modes hit, by their
    weights, times k, at most 1; without: the plain sum."""
    rows = None
    for mode, df in lists.items():
        part = df.select(id_col, F.lit(float(weights[mode]) if weights else 1.0).alias("w"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    total = F.sum(F.col("w") / (k + F.col("rank")))
    score = F.least(F.lit(1.0), total / F.sum("w") * k) if weights else total
    return rows.groupBy(id_col).agg(score.alias("score"))


def resolved_weights(query: str, weights: dict[str, float] | None = None, profile: str | None = None, direction: str | None = None) -> dict[str, float]:
    """A query's weights by mode: those of the profile, asked for or found in its words, ``weights`` in place of some; with a
    causal question, or a ``direction`` that is asked for, the causal one counts half more and the sum is 1."""
    base = PROFILES["general"] | (weights if weights is not None else PROFILES.get(profile or detect_profile(query), {}))
    return causal_boost(base, "why" if direction else query)


def _of(rows: DataFrame, hits: DataFrame, id_col: str) -> DataFrame:
    """The rows of a short list's ids."""
    return rows.join(F.broadcast(hits.select(id_col)), id_col, "left_semi")


def hybrid(query: str, lists: dict[str, DataFrame], *, weights: dict[str, float] | None = None, profile: str | None = None, direction: str | None = None, modes: list[str] | None = None, ages: DataFrame | None = None,
           texts: DataFrame | None = None, rerank=None, threshold: float = 0.0, limit: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(id, score, rank): the modes' hits fused. ``lists``: mode -> (id, score), of which the first 2 * ``limit`` count.

    Modes without a list or a weight say nothing. ``ages`` (id, days): newer hits are lifted, those without an age not.
    ``rerank`` (query, texts) -> scores, on the hits' ``texts`` (id, text), puts them in another order; where it gives none
    they keep theirs. Hits under ``threshold`` go before the limit; equal scores go by id.
    """
    from engram.operators import hooks as hk
    from engram.operators import scoring as sc

    shares = resolved_weights(query, weights, profile, direction)
    used = {m: ranked(top(df.select(id_col, "score"), 2 * limit, id_col), id_col) for m, df in lists.items() if shares.get(m) and (modes is None or m in modes)}
    if not used:
        raise ValueError("no list of a mode that has a weight")
    # a few rows, written once: they go to the ages and texts, which stay where they are, and nothing above runs again
    fused = materialize(rrf(used, shares, id_col), "fused")
    if ages is not None:
        fused = fused.join(_of(ages.select(id_col, "days"), fused, id_col), id_col, "left")
        fused = fused.select(id_col, F.when(F.col("days").isNull(), F.col("score")).otherwise(sc.temporal_boost(F.col("score"), F.col("days"))).alias("score"))
    fused = fused.select(id_col, F.round("score", 9).alias("score"))
    if rerank is not None and texts is not None:
        short = materialize(top(fused, 2 * limit, id_col), "short")
        short = short.join(_of(texts.select(id_col, "text"), short, id_col), id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))
        fused = hk.reranked(materialize(short, "texts"), query, rerank, "text", id_col, 2 * limit).select(id_col, "score")
    return ranked(top(fused.filter(F.col("score") >= threshold), limit, id_col), id_col)


def minmax(scored: DataFrame, id_col: str, name: str) -> DataFrame:
    """Scores of one list scaled to 0..1; a list without range has 1."""
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return scored.crossJoin(F.broadcast(ends)).select(id_col, scaled.alias(name))  # one row


def blend(bm: DataFrame, dense: DataFrame, id_col: str = "doc_id", bm_weight: float = 0.6, dense_weight: float = 0.4) -> DataFrame:
    both = minmax(bm, id_col, "x").join(minmax(dense, id_col, "y"), id_col, "full_outer")
    return both.select(id_col, (bm_weight * F.coalesce("x", F.lit(0.0)) + dense_weight * F.coalesce("y", F.lit(0.0))).alias("score"))


def judged(ranked_lists: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, mrr, ndcg) at k from (query, id, rank) and (query, id)."""
    hits = ranked_lists.filter(F.col("rank") <= k).join(relevant, ["query", "id"], "left_semi")
    gained = hits.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    size = relevant.groupBy("query").agg(F.count("*").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    g = size.join(gained, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("query", F.round(zero(F.col("hits") / F.col("relevant")), 6).alias("recall"), F.round(zero(F.col("hits") / float(k)), 6).alias("precision"), F.round(zero(1 / F.col("first")), 6).alias("mrr"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"))
