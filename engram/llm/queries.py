"""The queries of the corpus operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import audit, bpe, fingerprint, langid, lexical, media, neardup, oracles, packing, quality, risk, sharding, toxicity, urlrep
from engram.llm.common import crc_mod


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as AVI and read back; null texts are empty, repeated rows keep their count."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op2_packing_drr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed by source; null texts have the end token alone, null sources are a queue."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every text, learned outside the held-out fold; null ids are in no fold; no letters: ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document by words of three; null, empty texts stand alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, width=3, percent=85)


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, learned outside the held-out fold; null and empty texts have the bias's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.size("matches").alias("n_matches"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by rules and host reputation; null urls have empty hosts and the prior of all."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = urlrep.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return urlrep.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 9).alias("bound"))


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text, learned outside the held-out fold; null texts are scored as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard for every document by its id; null ids share one slot, repeated ids theirs."""
    return sharding.place_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op9_parse_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text; null texts are empty, null ids come last."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; null texts are empty and have no ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.bpe_codec(docs, tokenizer_path("byte_bpe_50k.json")))


def op11_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base and verdict of every text, cutoffs by labelled documents of each language; null texts have no words,
    null ids and repeated rows stay rows of their own, null languages are a stratum, a ratio at its cutoff is kept, very
    long texts count whole; an empty table gives no rows, without labels only the base rejects."""
    judged = risk.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten documents of the highest score; null texts have no terms, null items find nothing, equal
    scores go by id and null ids come last, repeated rows are ranked each, very long texts whole; no documents, no rows."""
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders for every part; null texts are empty, null sources the part '', repeated rows count
    each, rows without id are no copies and have no labels, very long texts count whole; an empty table gives no rows."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_avi": op1_media_avi,
    "op2_packing_drr": op2_packing_drr,
    "op3_language_crf": op3_language_crf,
    "op4_chosen_path": op4_chosen_path,
    "op5_toxicity_grammar": op5_toxicity_grammar,
    "op6_url_reputation": op6_url_reputation,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op8_shard_lookup": op8_shard_lookup,
    "op9_parse_fingerprint": op9_parse_fingerprint,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_risk_rules": op11_risk_rules,
    "op12_wavelet_search": op12_wavelet_search,
    "op13_filter_audit": op13_filter_audit,
}


def _level_sql(key: str, rows: str, up: str) -> str:
    """SQL of a level's posterior: rows (key, n, good, mu), the strength by moments, alpha and beta."""
    z = f"SELECT greatest(sum(n * (good / n - mu) ** 2) - sum(mu * (1 - mu)), 0) AS b, sum(n * mu * (1 - mu)) AS t FROM c_{key}"
    return f"""c_{key} AS ({rows.replace("@up", up)}), s_{key} AS (SELECT coalesce(least(greatest(CASE WHEN b > 0 THEN t / b - 1 END, 1.0), 1000.0), 1000.0) AS s FROM ({z})),
  r_{key} AS (SELECT c_{key}.*, good + s * mu AS a, n - good + s * (1 - mu) AS b, (good + s * mu) / (n + s) AS m FROM c_{key}, s_{key})"""


_NAME = r"regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '')"
_REG = r"regexp_matches('.' || x, '\.(?:ac|co|com|edu|gov|net|or|org)\.[a-z]{2}$')"
_ADR = r"regexp_matches(x, '^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$')"
_LAST = "array_to_string(l[greatest(len(l) - {n} + 1, 1):], '.')"
_DOM = f"CASE WHEN {_ADR} THEN x WHEN {_REG} THEN {_LAST.format(n=3)} ELSE {_LAST.format(n=2)} END"
_SUF = f"CASE WHEN {_ADR} THEN x WHEN {_REG} THEN {_LAST.format(n=2)} ELSE {_LAST.format(n=1)} END"
_FIT = "((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}'))"
_RULES = sorted(urlrep.RULES, key=lambda r: (-len(r[1]), r[1]))
_CASE = {i: "CASE " + " ".join(f"WHEN {_FIT.format(d=t.partition('/')[0], p=t.partition('/')[2])} THEN '{(w, t)[i]}'" for w, t in _RULES) + " END" for i in (0, 1)}
_URL = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
  v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
  p0 AS (SELECT page_id, coalesce(translate(raw, '{urlrep.UPPER}', '{urlrep.LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM v),
  p1 AS (SELECT *, {_NAME} AS x, string_split({_NAME}, '.') AS l FROM p0), p AS (SELECT page_id, host, path, {_DOM} AS domain, {_SUF} AS suffix FROM p1),
  g AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
  o AS (SELECT host, domain, suffix, good FROM p JOIN g ON g.doc_id = TRY_CAST(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:\\D|$)', 1), '') AS BIGINT)),
  h AS (SELECT host, domain, suffix, count(*) AS n, sum(good)::DOUBLE AS good FROM o GROUP BY ALL), d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(good) AS good FROM h GROUP BY ALL), f AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
  t AS (SELECT coalesce(sum(good), 0) + 1.0::DOUBLE AS a, coalesce(sum(n), 0) - coalesce(sum(good), 0) + 1.0::DOUBLE AS b FROM f),
  {_level_sql("suffix", "SELECT f.*, @up AS mu FROM f, t", "a / (a + b)")},
  {_level_sql("domain", "SELECT d.*, @up AS mu FROM d JOIN r_suffix r USING (suffix)", "r.m")},
  {_level_sql("host", "SELECT h.*, @up AS mu FROM h JOIN r_domain r USING (domain)", "r.m")},
  k AS (SELECT p.*, coalesce(h.a, d.a, f.a, t.a) AS ka, coalesce(h.b, d.b, f.b, t.b) AS kb FROM p CROSS JOIN t LEFT JOIN r_host h USING (host) LEFT JOIN r_domain d ON d.domain = p.domain LEFT JOIN r_suffix f ON f.suffix = p.suffix),
  q AS (SELECT *, greatest(0, ka / (ka + kb) - 1.645 * sqrt(ka * kb / ((ka + kb) * (ka + kb) * (ka + kb + 1)))) AS bound FROM k)
  SELECT page_id, host, path, {_CASE[1]} AS rule, coalesce({_CASE[0]}, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(bound, 9) AS bound FROM q"""

#: The other operators parse media, run tokenizers, learn models, build trees or fill tables in turns; SQL has no form of them.
ORACLE_SQL: dict[str, str] = {"op6_url_reputation": _URL, "op11_risk_rules": oracles.risk_rules(), "op12_wavelet_search": oracles.RANKED_SEARCH, "op13_filter_audit": oracles.FILTER_AUDIT}
