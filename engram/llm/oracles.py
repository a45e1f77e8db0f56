"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from engram.llm import risk

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Five filters in all orders: a set of failed filters for each row, then the steps of each order counted one by one.
FILTER_AUDIT = rf"""WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY 1), w AS (SELECT *, {_WORDS} AS ws FROM d),
  f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN w.doc_id > m.first_id THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN m ON m.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
  k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
  o AS (SELECT k1.x || k2.x || k3.x || k4.x || k5.x AS filter_order FROM k k1, k k2, k k3, k k4, k k5 WHERE k1.b + k2.b + k3.b + k4.b + k5.b = 31 AND len(list_distinct([k1.x, k2.x, k3.x, k4.x, k5.x])) = 5),
  s AS (SELECT filter_order, i AS step, k.b AS bit, coalesce((SELECT sum(b) FROM k WHERE instr(filter_order, x) < i), 0)::INT AS before FROM o, range(1, 6) AS r(i), k WHERE k.x = filter_order[i:i]),
  e AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
  SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM e"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document's score for every item by its terms.
RANKED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents), c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
  u AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d), p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM u GROUP BY ALL), w AS (SELECT t, floor(1000 * ln((2 * c.n + 2.0::DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
  i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM benchmark), a AS (SELECT DISTINCT q, item_id, unnest(ts) AS t FROM i),
  s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * p.n * c.n) // c.l))))::BIGINT AS score FROM a JOIN w USING (t) JOIN p USING (t) CROSS JOIN c GROUP BY ALL)
  SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""


def risk_rules(rules: tuple[risk.Rule, ...] = risk.RULES, delta: float = risk.DELTA) -> str:
    """Counts of each text, labelled documents by the place of each rule's grid that rejects them first, the exact binomial
    test of each place, and the verdicts."""
    fails = lambda r, cut: f"1000 * {r.number} {'<' if r.low else '>'} {cut} * {r.base}"
    grid = ", ".join(f"('{r.name}', {i}, {c}, {r.share})" for r in rules for i, c in enumerate(r.grid))
    place = " UNION ALL ".join(f"SELECT s, good, '{r.name}' AS rule, {' + '.join(f'CASE WHEN {fails(r, c)} THEN 0 ELSE 1 END' for c in r.grid)} AS at FROM lab" for r in rules)
    term = "exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(share) + (n_good - i) * ln(1 - share))"
    named = ", ".join(f"CASE WHEN {fails(r, f'cut_{r.name}')} THEN '{r.name}' END" for r in rules)
    wide = ", ".join(f"max(CASE WHEN rule = '{r.name}' THEN cutoff END) AS cut_{r.name}" for r in rules)
    counts = "n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS s, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w), q AS (SELECT *, lead(a) OVER z AS b, lead(a, 2) OVER z AS c FROM p WINDOW z AS (PARTITION BY r ORDER BY i)),
  h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM q WHERE c IS NOT NULL), m AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM h, range(3) AS x(j) WHERE n > 1 GROUP BY 1),
  f AS (SELECT doc_id, s, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN m ON m.r = w.r),
  g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
  l AS (SELECT doc_id, min(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
  lab AS (SELECT DISTINCT ON (doc_id) g.*, good FROM g JOIN l USING (doc_id) WHERE NOT base_failed ORDER BY doc_id, s, {counts}),
  hit AS ({place}), grid AS (SELECT * FROM (VALUES {grid}) AS v(rule, j, cutoff, share)), strata AS (SELECT s, sum(good) AS n_good FROM lab GROUP BY 1 HAVING sum(good) > 0),
  seen AS (SELECT x.s, n_good, g.rule, g.j, g.cutoff, g.share, coalesce(sum(h.good) FILTER (h.at <= g.j), 0)::BIGINT AS k, coalesce(sum(1 - h.good) FILTER (h.at <= g.j), 0)::BIGINT AS caught
      FROM strata x CROSS JOIN grid g LEFT JOIN hit h ON h.s = x.s AND h.rule = g.rule GROUP BY ALL),
  tested AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: {term})) <= {delta} / ({len(rules)} * (SELECT count(*) FROM strata)) AS passed FROM seen),
  chained AS (SELECT *, bool_and(passed) OVER (PARTITION BY s, rule ORDER BY j) AS held FROM tested),
  best AS (SELECT s, rule, cutoff FROM chained WHERE held AND caught > k QUALIFY row_number() OVER (PARTITION BY s, rule ORDER BY caught - k DESC, j) = 1),
  cut AS (SELECT s, {wide} FROM best GROUP BY 1), v AS (SELECT g.*, concat_ws(',', {named}) AS failed FROM g LEFT JOIN cut ON cut.s = g.s)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v"""
