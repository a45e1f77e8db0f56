"""Queries over the retrieval operators: BM25, overlap, vectors, fusion, scoring, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import index as ix
from engram.operators import scoring as sc
from engram.operators import search as se
from engram.operators import segments as sg
from engram.operators import vector as ve
from engram.registry import query
from engram.session import new_path
from engram.sources.store import Store
from engram.sources.tables import events, millis, table

_TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= {n})"


def _bm25_sql(terms: dict[str, int], least: int = 1, where: str = "true") -> str:
    score = " + ".join(
        f"CASE WHEN f{i} > 0 THEN {m} * ln(1 + ((SELECT n FROM fig) - (SELECT df{i} FROM fig) + 0.5) / ((SELECT df{i} FROM fig) + 0.5)) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * len / (SELECT a FROM fig))) ELSE 0 END"
        for i, m in enumerate(terms.values())
    )
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (WHERE f{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH t AS (SELECT doc_id, lang, source, {_TOK.format(n=least)} AS w FROM documents), c AS (SELECT doc_id, lang, source, CAST(len(w) AS DOUBLE) AS len, {tf} FROM t),
  fig AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS a, {df} FROM c), bm AS (SELECT doc_id, {score} AS score FROM c WHERE ({hit}) AND {where}) """


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _index(spark, sf, fields=None, least=1, stemmed=False):
    """The documents' stored index; the first query of a session builds it."""
    return ix.of_table(spark, f"{sf}/documents.parquet", "doc_id", fields or {"text": 1.0}, least, stemmed)


@query("bm25_topk", _bm25_sql({"the": 1, "thing": 1, "idiot": 1}) + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    return se.top(ix.bm25(spark, _index(spark, sf), "the thing idiot"), 20).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_norm", _bm25_sql({"licensed": 1, "under": 1}) + "SELECT doc_id, round(score / (score + 1), 6) AS score FROM bm")
def bm25_norm(spark, sf):
    return ix.bm25(spark, _index(spark, sf), "licensed under").select("doc_id", F.round(F.col("score") / (F.col("score") + 1), 6).alias("score"))


@query("bm25_session_filtered", _bm25_sql({"the": 2, "and": 1}, 2, "source = 'src3'") + "SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_session_filtered(spark, sf):
    own = _docs(spark, sf).filter("source = 'src3'").select("doc_id")
    found = ix.bm25(spark, _index(spark, sf, least=2), "the and the a", multiset=True).join(own, "doc_id", "left_semi")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_restricted_ids", _bm25_sql({"thing": 1}) + "SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def bm25_restricted_ids(spark, sf):
    found = ix.bm25(spark, _index(spark, sf), "thing").join(table(spark, sf, "labels").filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("corpus_stats", f"SELECT count(*) AS documents, round(avg(len({_TOK.format(n=1)})), 6) AS avg_len FROM documents")
def corpus_stats(spark, sf):
    return se.corpus_stats(_docs(spark, sf), "text").select("documents", F.round("avg_len", 6).alias("avg_len"))


@query("term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format(n=1)}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return se.document_frequency(_docs(spark, sf), "doc_id", "text")


@query("postings", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(n=1)}) AS term FROM documents) GROUP BY term, doc_id")
def postings(spark, sf):
    return se.postings(_docs(spark, sf), "doc_id", "text")


@query("tokens_b", f"SELECT doc_id, CAST(len({_TOK.format(n=2)}) AS BIGINT) AS doc_len FROM documents")
def tokens_b(spark, sf):
    return se.doc_stats(_docs(spark, sf), "doc_id", "text", 2)


@query("keywords_c", r"""SELECT doc_id, CAST(len(list_filter(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2)),
  lambda x: NOT list_contains([""" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], x))) AS BIGINT) AS n FROM documents")
def keywords_c(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(tx.keywords(F.col("text"))).cast("bigint").alias("n"))


@query("fts_and_search", f"""WITH t AS (SELECT doc_id, {_TOK.format(n=1)} AS w, {_TOK.format(n=1).replace('text', 'source')} AS p FROM documents),
  c AS (SELECT doc_id, CAST(len(w) + len(p) AS DOUBLE) AS len, len(list_filter(w, lambda x: x = 'the')) + 2.0::DOUBLE * len(list_filter(p, lambda x: x = 'the')) AS f0,
  len(list_filter(w, lambda x: x = 'src4')) + 2.0::DOUBLE * len(list_filter(p, lambda x: x = 'src4')) AS f1 FROM t),
  g AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS a, CAST(count(*) FILTER (WHERE f0 > 0) AS DOUBLE) AS d0, CAST(count(*) FILTER (WHERE f1 > 0) AS DOUBLE) AS d1 FROM c)
  SELECT doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a)) + ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score
  FROM c, g WHERE f0 > 0 AND f1 > 0""")
def fts_and_search(spark, sf):
    found = ix.and_search(spark, _index(spark, sf, {"text": 1.0, "source": 2.0}), "the src4")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("knowledge_or_search_tags", _bm25_sql({"thing": 1, "licensed": 1, "under": 1}, 1, "lang = 'en'") + """SELECT bm.doc_id, round(score, 6) AS score FROM bm JOIN t USING (doc_id)
  WHERE list_contains(w, 'thing') OR contains(' ' || array_to_string(w, ' ') || ' ', ' licensed under ')""")
def knowledge_or_search_tags(spark, sf):
    d = _docs(spark, sf)
    tagged = d.filter(F.array_contains(F.array("lang", "source"), "en")).select("doc_id")
    found = ix.or_search(spark, _index(spark, sf), d, '"licensed under" thing', F.col("text"))
    return found.join(tagged, "doc_id", "left_semi").select("doc_id", F.round("score", 6).alias("score"))


@query("fts_stemmed")
def fts_stemmed(spark, sf):
    """Stemmed code search with the literal check behind it; SQL has no stemmer, tests hold it against a loop."""
    index = _index(spark, sf, {"text": 1.0, "source": 2.0}, stemmed=True)
    found = ix.and_search(spark, index, "things under").join(_docs(spark, sf), "doc_id")
    return found.filter(ix.evidence(F.col("source"), F.col("text"), "things under")).select("doc_id", F.round("score", 6).alias("score"))


_FIVE = _bm25_sql({"thing": 1, "en": 1}).replace("documents)", "(SELECT doc_id, lang, source, concat_ws(' ', text, lang, source, doc_id, n_chars) AS text FROM documents))")


@query("knowledge_five_columns", _FIVE + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def knowledge_five_columns(spark, sf):
    d = _docs(spark, sf).withColumns({"id_text": F.col("doc_id").cast("string"), "size_text": F.col("n_chars").cast("string")})
    index = ix.build(d, "doc_id", {"text": 1.0, "lang": 1.0, "source": 1.0, "id_text": 1.0, "size_text": 1.0})
    return se.top(ix.or_search(spark, index, d, "thing OR en", F.col("text")), 20).select("doc_id", F.round("score", 6).alias("score"))


@query("index_update", f"SELECT term, count(*) AS df, CAST(sum(tf) AS DOUBLE) AS tf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(n=1)}) AS term FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new words here' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)) GROUP BY 1, 2) GROUP BY term")
def index_update(spark, sf):
    """The index after some documents change and some go: one more segment, of the changes alone."""
    d = _docs(spark, sf).select("doc_id", "text")
    changed = d.filter("doc_id % 5 = 0 and doc_id % 7 <> 0").withColumn("text", F.lit("new words here"))
    index = sg.create(Store(spark, new_path(spark, "index")), d, "doc_id")
    return sg.frequencies(index.update(changed, d.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))))


@query("keyword_overlap_recall", "SELECT doc_id, score FROM (SELECT doc_id, (contains(lower(text), 'licensed')::INT + contains(lower(text), 'thing')::INT + contains(lower(text), 'idiot')::INT) / 3.0::DOUBLE AS score FROM documents) WHERE score >= 0.2 ORDER BY score DESC, doc_id LIMIT 50")
def keyword_overlap_recall(spark, sf):
    return se.recall_overlap(_docs(spark, sf), "the licensed thing and idiot", F.col("text"), "doc_id", limit=50)


@query("cross_session_recall", """WITH s AS (SELECT doc_id, source, text, n_chars FROM documents WHERE source <> 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  ORDER BY doc_id DESC LIMIT 500), k AS (SELECT source, n_chars, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(text[1:1]) ORDER BY doc_id DESC) AS r FROM s) WHERE r = 1)
  SELECT doc_id, (contains(lower(text), 'thing')::INT + contains(lower(text), 'des')::INT) / 2.0::DOUBLE AS score FROM k WHERE contains(lower(text), 'thing') OR contains(lower(text), 'des')""")
def cross_session_recall(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    d = _docs(spark, sf).filter("source <> 'src1'").join(gone, "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(500)
    first = d.groupBy("source", F.lower(F.substring("text", 1, 1)).alias("key")).agg(F.max(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text")
    return first.select("doc_id", se.overlap_score(F.col("text"), "thing des").alias("score")).filter("score >= 0.2")


@query("lexical_evidence", """WITH h AS (SELECT doc_id, lower(source || chr(10) || text) AS h FROM documents), o AS (SELECT doc_id, h, contains(h, 'thing')::INT + contains(h, 'of')::INT AS o FROM h)
  SELECT doc_id, CAST((CASE WHEN o >= 2 THEN o ELSE 0 END) + CASE WHEN contains(h, 'thing of') THEN 5 + CASE WHEN instr(h, 'thing of') - 1 <= 80 THEN 2 WHEN instr(h, 'thing of') - 1 <= 200 THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS score FROM o""")
def lexical_evidence(spark, sf):
    return _docs(spark, sf).select("doc_id", se.lexical_evidence(F.col("source"), F.col("text"), "thing of").cast("int").alias("score"))


@query("profile_detection", """SELECT conv_id, turn, CASE WHEN list_has_any(w, ['function', 'class', 'import', 'variable', 'module', 'type', 'interface']) THEN 'code_search'
  WHEN list_has_any(w, ['decided', 'decision', 'chose', 'choice', 'why']) THEN 'decision_recall' WHEN list_has_any(w, ['error', 'exception', 'crash', 'fail', 'broken', 'issue']) THEN 'error_investigation'
  WHEN list_has_any(w, ['recent', 'latest', 'today', 'yesterday']) OR contains(lower(text), 'last week') THEN 'temporal' ELSE 'general' END AS profile
  FROM (SELECT *, list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '[^\\w]', '', 'g')) AS w FROM conversations)""".replace("\\\\", "\\"))
def profile_detection(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", se.profile_column(F.col("text")).alias("profile"))


_Q = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(map(str, _Q)) + "]::DOUBLE[])"


@query("cosine_topk", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return ve.search(table(spark, sf, "embeddings"), _Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("cosine_threshold_category", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) AND {_COS} >= 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 40")
def cosine_threshold_category(spark, sf):
    return ve.search(table(spark, sf, "embeddings"), _Q, 40, 0.05, F.col("label").isin(1, 2, 3)).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_stats", "SELECT label, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dims FROM embeddings GROUP BY label")
def vector_stats(spark, sf):
    return ve.label_stats(ve.checked(table(spark, sf, "embeddings"), 64))


@query("hash_vectorizer_sparse", f"""WITH w AS (SELECT doc_id, {_TOK.format(n=1)} AS w FROM documents),
  g AS (SELECT doc_id, unnest(w) AS g FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) FROM w),
  h AS (SELECT doc_id, CAST('0x' || sha256(g)[1:8] AS BIGINT) AS h FROM g), s AS (SELECT doc_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM h),
  v AS (SELECT doc_id, abs(h) % 768 AS idx, sum(CASE WHEN h >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM s GROUP BY 1, 2)
  SELECT doc_id, idx, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS weight FROM v WHERE s <> 0""")
def hash_vectorizer_sparse(spark, sf):
    return ve.hashed(_docs(spark, sf), "doc_id", "text").select("doc_id", "idx", F.round("weight", 6).alias("weight"))


_KW = _bm25_sql({"thing": 1, "the": 1}) + ", kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 40))"
_VEC = f", dense AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 40))"


def _lists(spark, sf):
    kw = se.top(ix.bm25(spark, _index(spark, sf), "thing the"), 40)
    dense = ve.search(table(spark, sf, "embeddings"), _Q, 40).withColumnRenamed("vec_id", "doc_id")
    return kw, dense


@query("rrf_weighted", _KW + _VEC + """SELECT doc_id, round(least(1.0::DOUBLE, sum(w / (60 + rank)) / sum(w) * 60), 6) AS score
  FROM (SELECT doc_id, rank, 0.3::DOUBLE AS w FROM kw UNION ALL SELECT doc_id, rank, 0.5::DOUBLE FROM dense) GROUP BY doc_id""")
def rrf_weighted(spark, sf):
    kw, dense = _lists(spark, sf)
    w = se.PROFILES["general"]
    return se.rrf({"keyword": se.ranked(kw), "semantic": se.ranked(dense)}, w).select("doc_id", F.round("score", 6).alias("score"))


@query("rrf_plain", _KW + _VEC + "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank FROM kw UNION ALL SELECT doc_id, rank FROM dense) GROUP BY doc_id")
def rrf_plain(spark, sf):
    kw, dense = _lists(spark, sf)
    return se.rrf({"keyword": se.ranked(kw), "semantic": se.ranked(dense)}).select("doc_id", F.round("score", 6).alias("score"))


@query("minmax_blend", _KW + _VEC + """, x AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM kw), y AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS y FROM dense)
  SELECT doc_id, round(0.6 * coalesce(x, 0) + 0.4 * coalesce(y, 0), 6) AS score FROM x FULL JOIN y USING (doc_id)""")
def minmax_blend(spark, sf):
    kw, dense = _lists(spark, sf)
    return se.blend(kw, dense).select("doc_id", F.round("score", 6).alias("score"))


@query("temporal_boost", "SELECT event_id, round(value * (1 + 0.3 * exp(-((1706745600000 - epoch_us(ts) // 1000) / 86400000.0::DOUBLE) / 30)), 6) AS score FROM events")
def temporal_boost(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", F.round(sc.temporal_boost(F.col("value"), (1_706_745_600_000 - F.col("ms")) / 86_400_000), 6).alias("score"))


@query("hybrid_search", _KW + _VEC + """, f AS (SELECT doc_id, least(1.0::DOUBLE, sum(w / (60 + rank)) / sum(w) * 60) AS score FROM (SELECT doc_id, rank, 0.3::DOUBLE AS w FROM kw UNION ALL SELECT doc_id, rank, 0.5::DOUBLE FROM dense) GROUP BY doc_id),
  b AS (SELECT f.doc_id, score * (1 + 0.3 * exp(-(1706745600000 - epoch_us(ts) // 1000) / 86400000.0::DOUBLE / 30)) AS score FROM f JOIN events e ON e.event_id = f.doc_id)
  SELECT doc_id, round(score, 6) AS score FROM b WHERE score >= 0.3 ORDER BY round(score, 9) DESC, doc_id LIMIT 20""")
def hybrid_search(spark, sf):
    kw, dense = _lists(spark, sf)
    fused = se.rrf({"keyword": se.ranked(kw), "semantic": se.ranked(dense)}, se.PROFILES["general"])
    when = events(spark, sf).select(F.col("event_id").alias("doc_id"), ((1_706_745_600_000 - F.col("ms")) / 86_400_000).alias("age"))
    boosted = fused.join(when, "doc_id").select("doc_id", sc.temporal_boost(F.col("score"), F.col("age")).alias("score")).filter("score >= 0.3")
    return boosted.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


_CATS = list(sc.CATEGORY)
_CASE = lambda values, key, default: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in values.items()) + f" ELSE {float(default)}::DOUBLE END"
_MEM_SQL = f"""WITH m AS (SELECT user_id AS memory_id, count(*) FILTER (WHERE event_type = 'view') AS accesses, (1709251200000 - max(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'view')) / 86400000.0::DOUBLE AS days,
  ['high', 'normal', 'low'][user_id % 3 + 1] AS priority, [{", ".join(f"'{c}'" for c in _CATS)}][user_id % {len(_CATS)} + 1] AS category FROM events GROUP BY user_id),
  r AS (SELECT *, {_CASE(sc.PRIORITY, "priority", 1)} * {_CASE(sc.CATEGORY, "category", 1)} * CASE WHEN accesses > 0 THEN least(1 + log2(accesses::DOUBLE) * 0.1, 2.0) ELSE 1.0 END
  * pow(1 + (19.0::DOUBLE / 81) * coalesce(days, 0) / {_CASE(sc.STABILITY_DAYS, "category", 30)}, -0.5) * (1 + 0.3 * ln(1.0 + accesses) * exp(-coalesce(days, 0) * 24 / 168)) AS score FROM m) """


def _scored(spark, sf):
    e = events(spark, sf).withColumnRenamed("session_id", "memory_id")
    reads = sc.access_counts(e.filter("event_type = 'MEMORY_RECALLED'"), 1_709_251_200_000)
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("memory_id") % n + 1).cast("int"))
    m = e.select("memory_id").distinct().join(reads, "memory_id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))
    m = m.withColumns({"priority": pick(["high", "normal", "low"], 3), "category": pick(_CATS, len(_CATS))})
    return m.withColumn("score", sc.relevance(F.col("priority"), F.col("category"), F.col("accesses"), F.col("days")))


@query("relevance_score", _MEM_SQL + "SELECT memory_id, accesses, round(score, 6) AS score FROM r")
def relevance_score(spark, sf):
    return _scored(spark, sf).select("memory_id", "accesses", F.round("score", 6).alias("score"))


@query("relevance_decay_only", _MEM_SQL + f"SELECT memory_id, round(pow(1 + (19.0::DOUBLE / 81) * coalesce(days, 0) / {_CASE(sc.STABILITY_DAYS, 'category', 30)}, -0.5) * (1 + 0.3 * ln(1.0 + accesses) * exp(-coalesce(days, 0) * 24 / 168)), 6) AS score FROM r")
def relevance_decay_only(spark, sf):
    return _scored(spark, sf).select("memory_id", F.round(sc.retention(F.col("category"), F.col("accesses"), F.col("days")), 6).alias("score"))


@query("relevance_initial", _MEM_SQL + f"SELECT memory_id, round(least({_CASE(sc.PRIORITY, 'priority', 1)} * {_CASE(sc.CATEGORY, 'category', 1)}, 2.0), 6) AS score FROM r")
def relevance_initial(spark, sf):
    return _scored(spark, sf).select("memory_id", F.round(sc.initial(F.col("priority"), F.col("category")), 6).alias("score"))


@query("relevance_stats", _MEM_SQL + """SELECT count(*) AS total, round(avg(score), 6) AS average, count(*) FILTER (WHERE score < 0.3) AS stale, count(*) FILTER (WHERE score >= 0.3 AND score < 0.4) AS low,
  count(*) FILTER (WHERE score >= 0.4 AND score < 0.7) AS medium, count(*) FILTER (WHERE score >= 0.7) AS high FROM r""")
def relevance_stats(spark, sf):
    return sc.relevance_stats(_scored(spark, sf))


@query("stale_memories", _MEM_SQL + "SELECT memory_id, round(score, 6) AS score FROM r WHERE score < 0.6 AND (days IS NULL OR days >= 30) ORDER BY r.score, memory_id LIMIT 40")
def stale_memories(spark, sf):
    return sc.stale(_scored(spark, sf), 0.6, 30, 40).select("memory_id", F.round("score", 6).alias("score"))


@query("search_blend_relevance", _MEM_SQL + """, s AS (SELECT memory_id, contains(lower(text), 'thing')::INT::DOUBLE AS k FROM (SELECT doc_id AS memory_id, text FROM documents))
  SELECT s.memory_id, round(0.7 * k + 0.3 * coalesce(score, 1.0), 6) AS score FROM s LEFT JOIN r USING (memory_id) WHERE k > 0""")
def search_blend_relevance(spark, sf):
    hits = _docs(spark, sf).select(F.col("doc_id").alias("memory_id"), se.overlap_score(F.col("text"), "thing").alias("k")).filter("k > 0")
    rel = _scored(spark, sf).select("memory_id", F.col("score").alias("rel"))
    return hits.join(rel, "memory_id", "left").select("memory_id", F.round(sc.blended(F.col("k"), F.col("rel")), 6).alias("score"))


@query("auto_recall_miss", "SELECT b.item_id, count(d.doc_id) AS hits FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id HAVING count(d.doc_id) = 0")
def auto_recall_miss(spark, sf):
    """Benchmark passages that no document holds whole: recall misses."""
    return se.misses(_docs(spark, sf), table(spark, sf, "benchmark"), "item_id").withColumn("hits", F.lit(0).cast("bigint"))


@query("consolidate_digests", """WITH d AS (SELECT lang, source, doc_id, text, CAST(floor((row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) / 20) AS INTEGER) AS part FROM documents)
  , g AS (SELECT lang, source, part, count(*) AS n, string_agg(substring(doc_id || ': ' || text, 1, 200), chr(10) ORDER BY doc_id) AS t FROM d GROUP BY 1, 2, 3)
  SELECT lang, source, part, n, md5(CASE WHEN length(t) > 2000 THEN substring(t, 1, 1997) || '...' ELSE t END) AS digest FROM g""")
def consolidate_digests(spark, sf):
    m = _docs(spark, sf).select("lang", "source", "doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    return sc.digests(m, ["lang", "source"], "doc_id").withColumn("digest", F.md5("digest"))


@query("compress_heuristic", r"""WITH d AS (SELECT source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm, count(*) AS n FROM documents GROUP BY 1, 2)
  SELECT source, count(*) AS facts, CAST(sum(n) AS BIGINT) AS sources, round(count(*) / sum(n)::DOUBLE, 6) AS ratio FROM d GROUP BY source""")
def compress_heuristic(spark, sf):
    return sc.compress(_docs(spark, sf).select("source", F.col("doc_id").alias("memory_id"), F.col("text").alias("value")), "source")


@query("junk_filter", r"""WITH v AS (SELECT conv_id, turn, trim(text) AS t FROM conversations), w AS (SELECT *, regexp_split_to_array(lower(t), '\s+') AS w FROM v)
  SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty content' WHEN length(t) < 10 THEN 'too short (< 10 chars)' WHEN lower(t) IN ('hello world', 'lorem ipsum') THEN 'generic filler'
  WHEN regexp_matches(t, '^https?://\S+$', 'i') THEN 'bare URL without context' WHEN list_max(list_transform(list_distinct(string_split(t, '')), lambda c: len(list_filter(string_split(t, ''), lambda x: x = c)))) / length(t)::DOUBLE > 0.6
  OR (len(w) >= 3 AND list_max(list_transform(list_distinct(w), lambda c: len(list_filter(w, lambda x: x = c)))) / len(w)::DOUBLE > 0.6) THEN 'repetitive content' END AS reason FROM w""")
def junk_filter(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.junk_reason(F.col("text")).alias("reason"))


@query("redact_secrets", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9]{20,}', '[REDACTED]', 'g'),
  '\b[A-Za-z0-9]{32,}\b', '[REDACTED]', 'g'), 'password\s*=\s*\S+', '[REDACTED]', 'gi'), 'api[_-]?key\s*[=:]\s*\S+', '[REDACTED]', 'gi')) AS digest FROM documents""")
def redact_secrets(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.redact(F.col("text"))).alias("digest"))


@query("normalize_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest, replace(source || '\a', '\', '/') AS path FROM documents")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("digest"), tx.slashes(F.concat("source", F.lit("\\a"))).alias("path"))


@query("compact_projection", "SELECT doc_id, lang, substring(text, 1, 80) AS head FROM documents")
def compact_projection(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", tx.compact(F.col("text")).alias("head"))


@query("evidence_gate", """SELECT doc_id, coalesce(array_to_string(list_filter(CASE c WHEN 'decision' THEN ['rationale'] WHEN 'error' THEN ['source'] WHEN 'fact' THEN ['source'] ELSE [] END, lambda x: NOT list_contains(CASE WHEN doc_id % 2 = 0 THEN ['source'] ELSE [] END, x)), ','), '') AS missing
  FROM (SELECT doc_id, ['decision', 'error', 'fact', 'note'][doc_id % 4 + 1] AS c FROM documents)""")
def evidence_gate(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.element_at(F.array(*map(F.lit, ["decision", "error", "fact", "note"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("c"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("source"))).alias("p"))
    return d.select("doc_id", F.array_join(sc.missing_evidence(F.col("c"), F.col("p")), ",").alias("missing"))


@query("extraction_routing", "SELECT doc_id, n_chars > 500 OR lang = 'fact' AS wanted FROM documents")
def extraction_routing(spark, sf):
    return _docs(spark, sf).select("doc_id", sc.wants_extraction(F.col("lang"), F.col("n_chars"), F.lit(None).cast("boolean")).alias("wanted"))


@query("eval_recall_at_k", """WITH r AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  rel AS (SELECT DISTINCT source AS query, doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0),
  h AS (SELECT query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM r JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY query), s AS (SELECT query, count(*) AS n FROM rel GROUP BY query)
  SELECT query, round(coalesce(hits / n::DOUBLE, 0), 6) AS recall, round(coalesce(hits / 10.0::DOUBLE, 0), 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0))), 0), 6) AS ndcg FROM s LEFT JOIN h USING (query)""")
def eval_recall_at_k(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    lists = _docs(spark, sf).select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(w).alias("rank")).filter("rank <= 10")
    good = table(spark, sf, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    relevant = _docs(spark, sf).join(good, "doc_id", "left_semi").select(F.col("source").alias("query"), F.col("doc_id").alias("id")).distinct()
    return se.judged(lists, relevant, 10)


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events")
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return e.groupBy("event_type").agg(*p, F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("run_delta", """SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS delta FROM orders""")
def run_delta(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 6).alias("delta"))


@query("uuid7_ids", """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7' || lpad(lower(to_hex(event_id % 4096)), 3, '0') || '-8' || substr(s, 1, 3) || '-' || substr(s, 4, 12) AS id
  FROM (SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS h, sha256(CAST(event_id AS VARCHAR)) AS s FROM events)""")
def uuid7_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.uuid7(millis("ts"), F.col("event_id"), F.col("event_id")).alias("id"))
