"""Column functions on text: tokenisers, redaction, normalisation, content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword recall leaves out.
STOP_WORDS = """the is are was were be been being have has had do does did will would could should may might shall
can need dare ought used to of in for on with at by from as into through during before after above below between out
off over under again further then once here there when where why how all each every both few more most other some such
no not only own same so than too very just because but and or if while that this these those it its an a""".split()
#: Fillers that make a memory junk, whole and in any case.
FILLERS = ["test", "testing", "asdf", "asdfjkl", "hello", "hello world", "foo", "bar", "baz", "lorem ipsum", "todo", "tbd", "n/a", "na", "xxx", "yyy", "zzz", "abc", "123", "qwerty"]
#: Secrets, in the order in which they are redacted.
SECRETS = [r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", r"sk-[A-Za-z0-9]{20,}", r"\b[A-Za-z0-9]{32,}\b", r"(?i)password\s*=\s*\S+", r"(?i)api[_-]?key\s*[=:]\s*\S+"]


def _split(cleaned: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(cleaned, r"\s+", " ")), " ")


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case ASCII words of ``least`` characters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))
    return F.filter(words, lambda x: F.length(x) >= least) if least > 1 else words


def keywords(text: Column) -> Column:
    """Distinct words of two characters or more that aren't stop words."""
    words = F.filter(_split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")), lambda x: F.length(x) >= 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def severity(level: Column) -> Column:
    level = F.lower(level)
    return F.when(level.isin("error", "warning", "note"), level).otherwise("info")


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def content_id(*parts: Column) -> Column:
    """SHA-256 of the parts, a line each; null parts count as empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def uuid7(ms: Column, seq: Column, tail: Column) -> Column:
    """Time-sortable id: 48 bits of milliseconds, version 7, 12 bits of a sequence within them, then of a hash."""
    h = F.sha2(tail.cast("string"), 256)
    time = F.lpad(F.lower(F.hex(ms)), 12, "0")
    number = F.lpad(F.lower(F.hex(seq % 4096)), 3, "0")
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), number), F.concat(F.lit("8"), F.substring(h, 1, 3)), F.substring(h, 4, 12))


def compact(text: Column, size: int = 80) -> Column:
    return F.substring(text, 1, size)
