"""Entity and mention extraction by patterns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from engram.session import BROADCAST_BYTES, materialize, ship

#: Patterns of entities, by type; the first group is the name. A pair (lead, tail) finds words of two letters or
#: more, side by side, between a lead and the last tail: a pattern's group of any number of words would overflow the stack.
PATTERNS: dict[str, list[str | tuple[str, str]]] = {
    "PERSON": [
        r"\b(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)",
        r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)(?:\s+([A-Z][a-z]+))?\b(?=\s+(?:said|wrote|created|developed|implemented|designed|built|reported|mentioned|suggested|recommended|asked|answered|fixed|reviewed))",
        r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)++)'s\b",
        r"@([A-Za-z][A-Za-z0-9_-]+)",
    ],
    "ORGANIZATION": [
        r"(?i)\b([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,2})\s+(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co|GmbH|AG|SA|Pty|PLC)\b\.?",
        ("at|by|from|with|for", "team|company|organization|group|department"),
        r"\b(Google|Microsoft|Apple|Amazon|Meta|Facebook|Netflix|Anthropic|OpenAI|GitHub|GitLab|Vercel|Cloudflare|AWS|Azure|IBM|Oracle|Salesforce)\b",
        ("the", r"(?:team|group|company|organization)\b"),
    ],
    "CODE_FILE": [
        r"\b([a-zA-Z0-9_\-./]+\.(?:ts|tsx|js|jsx|py|rb|go|rs|java|kt|swift|c|cpp|h|hpp|cs|php|vue|svelte|astro|md|json|yaml|yml|toml|xml|html|css|scss|sass|less))\b",
        r"\b((?:src|lib|packages|apps|modules|components|utils|helpers|services|hooks|stores|types|interfaces|models|controllers|views|routes|api|tests?|__tests__|spec)\/[a-zA-Z0-9_\-./]+)\b",
        r"\b(\.\.?\/[a-zA-Z0-9_\-./]+(?:\.[a-zA-Z]+)?)\b",
        r"\b(index\.(?:ts|tsx|js|jsx))\b",
    ],
    "CODE_FUNCTION": [
        r"\b([a-z][a-zA-Z0-9_]*)\s*\([^)]*\)",
        r"\basync\s+function\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        r"\bfunction\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        r"\b(const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
        r"\.([a-z][a-zA-Z0-9_]*)\s*\(",
        r"\b(use[A-Z][a-zA-Z0-9]*)\b",
    ],
    "DECISION": [
        r"(?i)\b(?:decided|chosen|selected|opted)\s+(?:to\s+)?([^.!?\n]+)",
        r"(?i)\b(?:the\s+)?decision\s+(?:to|was|is)\s+([^.!?\n]+)",
        r"(?i)\b(?:we|they|i)\s+(?:will|should|must|shall)\s+([^.!?\n]+)",
        r"(?i)\bgoing\s+(?:with|for)\s+([^.!?\n]+)",
        r"(?i)\bchose\s+([^.!?\n]+?)\s+over\b",
    ],
    "TASK": [
        r"\b(?:TODO|FIXME|HACK|XXX|BUG|NOTE):\s*([^\n]+)",
        r"(?i)\bneed\s+to\s+([^.!?\n]+)",
        r"(?i)\b(?:implement|add|create|build|fix|update|refactor|remove|delete)\s+([^.!?\n]+)",
        r"(?im)^[-*]\s*\[[ x]?\]\s*(.+)$",
        r"(?i)\bshould\s+(?:be\s+)?([^.!?\n]+)",
    ],
    "ERROR": [
        r"\b(?:Error|error|ERROR):\s*([^\n]+)",
        r"\b([A-Z][a-zA-Z]*(?:Error|Exception|Fault))\b",
        r"(?i)\bfailed\s+to\s+([^.!?\n]+)",
        r"\bat\s+([a-zA-Z0-9_<>$.]+)\s*\(([^)]+):(\d+):(\d+)\)",
        r"(?i)\bthrew\s+(?:an?\s+)?([A-Z][a-zA-Z]*(?:Error|Exception)?)",
        r"(?i)\b(?:cannot|could\s+not|couldn't)\s+([^.!?\n]+)",
    ],
    "CONCEPT": [
        r"(?i)\bthe\s+concept\s+of\s+([^.!?\n]+)",
        ("", r"(?:pattern|principle|approach|methodology|architecture|paradigm)\b"),
    ],
    "CODE_CLASS": [
        r"\bclass\s+([A-Z][a-zA-Z0-9_]*)",
        r"\binterface\s+([A-Z][a-zA-Z0-9_]*)",
        r"\btype\s+([A-Z][a-zA-Z0-9_]*)\s*=",
        r"\b(?:extends|implements)\s+([A-Z][a-zA-Z0-9_]*)",
        r"\b([A-Z][a-zA-Z0-9]*(?:Type|Interface|Class|Props|State|Config|Options))\b",
    ],
}
#: What each match of a pattern holds, by type and place, as an expression that Arrow finds in time linear in the text
#: (RE2, with no borders of words, as Java's are other ones). A text without it isn't searched.
_NEEDS: dict[str, list[str]] = {
    "PERSON": [r"Dr|Mr|Ms|Miss|Prof", r"[\s\x0b](?:said|wrote|created|developed|implemented|designed|built|reported|mentioned|suggested|recommended|asked|answered|fixed|reviewed)", r"[a-z]'s", r"@[A-Za-z]"],
    "ORGANIZATION": [
        r"(?i)[\s\x0b](?:inc|llc|ltd|corp|company|co|gmbh|ag|sa|pty|plc)",
        r"(?i)[\s\x0b](?:team|company|organization|group|department)",
        r"Google|Microsoft|Apple|Amazon|Meta|Facebook|Netflix|Anthropic|OpenAI|GitHub|GitLab|Vercel|Cloudflare|AWS|Azure|IBM|Oracle|Salesforce",
        r"(?i)[\s\x0b](?:team|group|company|organization)",
    ],
    "CODE_FILE": [
        r"\.[a-z]",
        r"(?:src|lib|packages|apps|modules|components|utils|helpers|services|hooks|stores|types|interfaces|models|controllers|views|routes|api|tests?|__tests__|spec)/",
        r"\./",
        r"index\.",
    ],
    "CODE_FUNCTION": [r"[a-zA-Z0-9_][\s\x0b]*\(", r"function[\s\x0b]", r"function[\s\x0b]", r"\)[\s\x0b]*=>", r"\.[a-z][a-zA-Z0-9_]*[\s\x0b]*\(", r"use[A-Z]"],
    "DECISION": [r"(?i)(?:decided|chosen|selected|opted)[\s\x0b]", r"(?i)decision[\s\x0b]", r"(?i)(?:we|they|i)[\s\x0b]+(?:will|should|must|shall)[\s\x0b]", r"(?i)going[\s\x0b]+(?:with|for)[\s\x0b]", r"(?i)chose[\s\x0b]"],
    "TASK": [r"(?:TODO|FIXME|HACK|XXX|BUG|NOTE):", r"(?i)need[\s\x0b]+to[\s\x0b]", r"(?i)(?:implement|add|create|build|fix|update|refactor|remove|delete)[\s\x0b]", r"\[[ xX]?\]", r"(?i)should[\s\x0b]"],
    "ERROR": [r"(?:Error|error|ERROR):", r"Error|Exception|Fault", r"(?i)failed[\s\x0b]+to[\s\x0b]", r":[0-9]+:[0-9]+\)", r"(?i)threw[\s\x0b]", r"(?i)(?:cannot|could[\s\x0b]+not|couldn't)[\s\x0b]"],
    "CONCEPT": [r"(?i)concept[\s\x0b]+of[\s\x0b]", r"(?i)[\s\x0b](?:pattern|principle|approach|methodology|architecture|paradigm)"],
    "CODE_CLASS": [r"class[\s\x0b]+[A-Z]", r"interface[\s\x0b]+[A-Z]", r"type[\s\x0b]+[A-Z]", r"(?:extends|implements)[\s\x0b]+[A-Z]", r"Type|Interface|Class|Props|State|Config|Options"],
}
NEEDS = {p: need for t, ps in PATTERNS.items() for p, need in zip(ps, _NEEDS[t], strict=True)}
#: What is nowhere in a match before what it needs, by type and place, where this isn't a space: a text is searched
#: from the last one before the first place of what is needed. Null: it is searched from its begin.
_BREAKS: dict[str, dict[int, str | None]] = {
    "PERSON": {1: ".", 2: "."},
    "ORGANIZATION": {0: ".", 1: ".", 3: "."},
    "CODE_FUNCTION": {1: ".", 3: None},
    "DECISION": {1: "."},
    "TASK": {3: None},  # a line's begin is told from the sign before
    "ERROR": {3: None},
    "CONCEPT": {0: ".", 1: "."},
}
BREAKS = {PATTERNS[t][i]: sign for t, signs in _BREAKS.items() for i, sign in signs.items()}
#: Rows of texts that are looked through at once.
ROWS = 1_000
#: Words that are no names of any type, and names that are no functions, compared in lower case.
COMMON = """the a an is are was were be been being have has had do does did will would could should may might must shall can this that these
those it its of in on at to for with by from as or and but if then else when up out no not all any some such new get set add run put""".split()
COMMON_FUNCTIONS = """if for while switch case return throw catch try new typeof instanceof import export from as default log warn error info
debug map filter reduce forEach find some every push pop shift slice splice join split trim replace match test exec toString valueOf parse
stringify""".split()
#: Parts of a key, and of a category, that make a type likelier.
KEY_HINTS = {
    "PERSON": "author|user|name",
    "ORGANIZATION": "company|org|team",
    "CODE_FILE": "file|path|source",
    "CODE_FUNCTION": "function|method|api",
    "DECISION": "decision|choice|selected",
    "TASK": "task|todo|action",
    "ERROR": "error|exception|bug",
}
CATEGORY_HINTS = {t: "code|technical" for t in ("CODE_FILE", "CODE_FUNCTION", "CODE_CLASS")}
#: Technologies and design patterns that count as mentions.
TECHNOLOGIES = """TypeScript JavaScript Python Rust Go Java Ruby Swift Kotlin React Vue Angular Svelte Nuxt Remix Astro Deno Bun Hono Fastify NestJS
PostgreSQL MySQL SQLite MongoDB Redis Qdrant Neo4j Supabase Docker Kubernetes AWS GCP Azure Vercel Cloudflare GraphQL REST gRPC WebSocket SSE MCP
OAuth JWT CORS CSRF TLS mTLS""".split()
DESIGNS = [r"singleton|factory|observer|strategy|adapter|proxy|facade|decorator|builder", r"circuit.?breaker|retry|backoff|rate.?limit|throttl|cache|queue|pub.?sub", r"blue.?green|canary|rolling.?update|feature.?flag", r"event.?sourc|CQRS|saga|outbox|dead.?letter"]


#: Words of two letters or more, side by side, and a sign that would go on with the last one.
RUN = r"\b[A-Za-z]{2,}+(?:\s++[A-Za-z]{2,}+)*+[0-9_]?"


def _found(text: Column, pattern: str | tuple[str, str]) -> Column:
    """Array of (a: first group, b: whole match), in order."""
    if isinstance(pattern, str):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))  # of use for blank groups alone
        none = F.array().cast("array<string>")

        def both(groups: Column) -> Column:
            return F.zip_with(groups, F.when(F.exists(groups, lambda x: _bare(x) == ""), whole).otherwise(none), lambda x, y: F.struct(x.alias("a"), y.alias("b")))

        return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), both), 0)  # groups are found once
    lead, tail = pattern
    names = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda run: F.regexp_extract(run, rf"(?is)^(.+)\s+(?:{tail})", 1))
    if lead:
        names = F.transform(names, lambda head: F.regexp_extract(head, rf"(?is)^(?:.*?\s)?(?:{lead})\s+(\S.*)$", 1))
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(n.alias("a"), n.alias("b")))


def _searched(needs: Sequence[tuple[str | None, str | None]]):
    """Maps rows (..., __text) to (..., __n, __text) for each pattern n that the text may match, by what it needs and its break.

    The text begins right behind the last break before what is needed: no match goes across it, and breaks part words as a
    text's begin does, so the rest has the same matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            text = rows.column(rows.num_columns - 1)
            raw = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
            for n, (need, sign) in enumerate(needs):
                place = pc.fill_null(pc.find_substring_regex(text, need) if need else pc.if_else(pc.is_valid(text), 0, -1), -1).to_numpy()
                at = np.flatnonzero(place >= 0)
                if not len(at):
                    continue
                cut = raw.take(pa.array(at))
                if need and sign:
                    cut = pa.array([t[t.rfind(sign, 0, p) + 1 :] for t, p in zip(cut.to_pylist(), place[at].tolist(), strict=True)], raw.type)
                kept = rows.select(range(rows.num_columns - 1)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(at), n, np.int32)), cut.view(text.type)], [*kept.schema.names, "__n", "__text"])

    return run


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract(docs: DataFrame, id_col: str, text: str, patterns: Mapping[str, Sequence[str | tuple[str, str]]] = PATTERNS, common: Sequence[str] = COMMON, key: Column | None = None, category: Column | None = None, min_confidence: float = 0.5) -> DataFrame:
    """(id, type, name, confidence) once for each type and lower-case name of a row, as the first pattern wrote it.

    A name is a match's first group, or all of it if that is blank, without white space around and marks behind; names
    under two characters (persons and organizations: three) and common words are left out. A type's confidence falls with
    the number of its patterns; what ``key`` and ``category`` hint at counts for a fifth more. Null and empty texts have no
    entities. Rows of one id are one text's; null ids are one id.
    """
    own = [(t, i, max(0.3, min(1.0, 1 / len(ps) + 0.5)), p) for t, ps in patterns.items() for i, p in enumerate(ps)]
    ship(docs.sparkSession)
    extra = [(n, c) for n, c in (("__key", key), ("__category", category)) if c is not None]
    rows = docs.select(F.col(id_col), *(c.alias(n) for n, c in extra), F.col(text).alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("__n", IntegerType()), StructField("__text", StringType())])
    signs = [(NEEDS.get(p), s.encode() if (s := BREAKS.get(p, " ")) else None) for *_, p in own]
    rows = rows.mapInArrow(_searched(signs), schema)
    found = reduce(lambda case, x: case.when(F.col("__n") == x[0], _found(F.col("__text"), x[1][3])), enumerate(own), F)
    of = lambda k: F.get(F.array(*(F.lit(x[k]) for x in own)), F.col("__n"))
    kind = F.struct(of(0).alias("type"), of(1).alias("rank"), of(2).alias("confidence"), found.alias("names")).alias("x")
    rows = rows.select(id_col, kind, *(n for n, _ in extra))
    hints = F.lit(False)
    for n, c, table in (("__key", key, KEY_HINTS), ("__category", category, CATEGORY_HINTS)):
        for t, words in table.items() if c is not None else ():
            hints = hints | ((F.col("x.type") == t) & F.coalesce(F.lower(n).rlike(words), F.lit(False)))
    rows = rows.select(id_col, "x.type", "x.rank", boosted(F.col("x.confidence"), hints).alias("confidence"), F.posexplode("x.names").alias("at", "m"))
    own = _bare(F.col("m.a"))
    rows = rows.withColumn("name", F.when(own == "", _bare(F.col("m.b"))).otherwise(own)).withColumn("low", F.lower("name"))
    short = F.when(F.col("type").isin("PERSON", "ORGANIZATION"), 3).otherwise(2)
    rows = rows.filter((F.length("name") >= short) & ~F.col("low").isin(list(common)) & ~((F.col("type") == "CODE_FUNCTION") & F.col("low").isin(COMMON_FUNCTIONS)))
    name = F.when(F.col("type") == "CODE_FILE", F.col("name")).otherwise(F.regexp_replace("name", r"[.,;:!?]+$", ""))
    name = F.when(F.col("type") == "ORGANIZATION", F.regexp_replace(name, r"(?i)^(?:The|A|An)\s+", "")).otherwise(name)
    rows = rows.withColumn("name", name).filter(F.col("confidence") >= min_confidence)
    best = rows.groupBy(id_col, "type", F.lower("name").alias("low")).agg(F.min(F.struct("rank", "at", "name", "confidence")).alias("x"))
    return best.select(id_col, "type", "x.name", "x.confidence")


def overall_confidence(entities: Column, length: Column) -> Column:
    """Confidence in a text's entities by how many it has for every hundred characters; 0 without text or entities."""
    ratio = entities / F.greatest(F.lit(1.0), length / 100)
    some = F.when(ratio < 0.5, ratio * 0.8).when(ratio > 3, F.greatest(F.lit(0.5), 1 - (ratio - 3) * 0.1)).otherwise(F.least(F.lit(0.95), 0.6 + ratio * 0.15))
    return F.when((F.coalesce(length, F.lit(0)) == 0) | (F.coalesce(entities, F.lit(0)) == 0), 0.0).otherwise(some)


def boosted(confidence: Column, prioritized: Column) -> Column:
    return F.least(F.lit(1.0), F.when(prioritized, confidence * 1.2).otherwise(confidence))


def mentions(docs: DataFrame, id_col: str, text: str, kinds: Sequence[str] = ("technology", "pattern")) -> DataFrame:
    """(id, kind, name): technologies and design patterns (``kinds``) that a text mentions, in lower case, once each."""
    tech = r"(?i)\b(" + "|".join(TECHNOLOGIES) + r")\b"
    design = r"(?i)\b(" + "|".join(DESIGNS) + r")\b"
    both = [F.struct(F.lit(k).alias("kind"), F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), F.lower)).alias("names")) for k, p in (("technology", tech), ("pattern", design)) if k in kinds]
    return docs.select(id_col, F.explode(F.array(*both)).alias("x")).select(id_col, "x.kind", F.explode("x.names").alias("name"))


def dictionary_mentions(docs: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    """(id, name): the names (name) of a table of any size that a text holds between borders of words, whatever the case.

    A text's words, and its pairs of adjacent words, meet the names' first one or two words in a join; what is more than a
    word is then looked for in the text. Small tables of names are broadcast, so that all this is done in a text's row; with
    large ones words and pairs are shuffled, texts once for the rows that met. Null and wordless texts and names meet
    nothing; names are told apart in lower case.
    """
    known = names.select(F.lower("name").alias("name")).filter("name is not null").distinct()
    known = known.withColumn("_words", _words(F.col("name"))).filter("size(_words) > 0")
    key = F.array_join(F.slice("_words", 1, 2), " ")
    known = materialize(known.select("name", key.alias("_key"), (F.col("name") == F.get("_words", 0)).alias("_whole")), "names")
    wide = F.sum(F.octet_length("name") + F.octet_length("_key") + 32)
    size, pairs = known.agg(F.coalesce(wide, F.lit(0)), F.coalesce(F.bool_or(F.contains("_key", F.lit(" "))), F.lit(False))).first()
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")).alias("_id"), F.lower(text).alias("_t"))
    found = F.col("_whole") | F.regexp_like("_t", F.concat(F.lit("(?<![a-z0-9_])"), F.regexp_replace("name", r"([^a-z0-9_ ])", r"\\$1"), F.lit("(?![a-z0-9_])")))
    if size <= BROADCAST_BYTES:
        met = _keyed(rows, pairs, "_id", "_t").join(F.broadcast(known), "_key").filter(found)
    else:
        met = _keyed(rows, pairs, "_id").join(known, "_key").select("_id", "name", "_whole").distinct()
        longer = met.filter("not _whole").groupBy("_id").agg(F.collect_list("name").alias("_names"))  # a text's own, at most one a place
        longer = rows.join(longer, "_id").select("_id", "_t", F.explode("_names").alias("name"), F.lit(False).alias("_whole")).filter(found)
        met = met.filter("_whole").select("_id", "name").unionByName(longer.select("_id", "name"))
    return met.select(F.col("_id.id").alias(id_col), "name").distinct()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[a-z0-9_]+"), F.lit(0))


def _keyed(rows: DataFrame, pairs: bool, *keep: str) -> DataFrame:
    """A row for each word of ``_t`` (_key), and for each pair of adjacent ones with ``pairs``."""
    each = rows.withColumn("_w", _words(F.col("_t"))).select(*keep, "_w", F.posexplode("_w").alias("_i", "_a"))
    keys = [F.col("_a"), F.concat("_a", F.lit(" "), F.get("_w", F.col("_i") + 1))]
    return each.select(*keep, F.explode(F.array(*keys[: 1 + pairs])).alias("_key"))


def relations(mentioned: DataFrame, project: str) -> DataFrame:
    """(project, target, type, n) of rows (project, kind, name): a project uses technologies, implements patterns and is
    related to other projects; n counts the rows."""
    kind = F.when(F.col("kind") == "technology", "uses").when(F.col("kind") == "pattern", "implements").when((F.col("kind") == "project") & (F.col("name") != F.col(project)), "related_to")
    rows = mentioned.select(F.col(project).alias("project"), F.col("name").alias("target"), kind.alias("type")).filter("type is not null and project is not null")
    return rows.groupBy("project", "target", "type").agg(F.count("*").alias("n"))


def cross_project(entries: DataFrame, project: str, score: Column, limit: int = 5) -> DataFrame:
    """Best entries of other projects."""
    return entries.filter(F.col("project") != project).withColumn("score", score).filter("score >= 0.5").orderBy(F.desc("score"), "id").limit(limit)
