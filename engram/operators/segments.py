"""An inverted index in segments: an update writes what it changes, queries see the live rows, merging keeps segments few.

Postings (id, len, term, tf, seg) and lengths (id, len, seg) are tables of a versioned store, a part for each update. An
update's segment number is one more than any before; of an id only the rows of its last segment live, and a length of null
means that it is gone. Figures (seg, documents, length) hold what each update added, so their sums are exact. A part's
postings are sorted by term, so a query reads its terms' row groups. Parts of about one size are merged as soon as there are
``FAN`` of them, which rewrites a row once for each power of FAN that the index has grown by.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engram.functions.stem import porter
from engram.operators import index as ix
from engram.operators.search import words_of
from engram.session import broadcast_if_small, materialize
from engram.sources.store import Snapshot, Store

FAN = 4
#: Parts below this many bytes count as one size.
LEAST_BYTES = 1 << 20


@dataclass(frozen=True)
class Segments:
    """A segmented index in ``store``; ``fields``: columns with their weights. Pinned to a version where ``snap`` is set."""

    store: Store
    id_col: str
    fields: dict = field(default_factory=lambda: {"text": 1.0})
    least: int = 1
    stemmed: bool = False
    snap: Snapshot | None = None

    # ---- what queries use, as of ``index.Index`` ----

    def now(self) -> Snapshot:
        return self.snap or self.store.at()

    def pinned(self) -> Segments:
        """The same index at its newest version, whatever is written from here on."""
        return Segments(self.store, self.id_col, self.fields, self.least, self.stemmed, self.store.at())

    def terms(self, query: str) -> Counter:
        words = words_of(query, self.least)
        return Counter(porter(w) if self.stemmed else w for w in words)

    def figures(self, spark: SparkSession) -> tuple[int, float]:
        """(documents, average length), from what each update has added."""
        snap = self.now()
        n, total = snap.table("figures").agg(F.sum("documents"), F.sum("length")).first() if snap.parts("figures") else (0, 0)
        return n or 0, (total / n if n else 0.0)

    def rows(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """(term, id, tf, len) of live documents with the terms."""
        snap = self.now()
        return _live(snap.table("postings").filter(F.col("term").isin(names)), snap).select("term", "id", "tf", "len")

    def postings(self, spark: SparkSession) -> DataFrame:
        """(id, len, term, tf) of all live documents."""
        snap = self.now()
        return _live(snap.table("postings"), snap).select("id", "len", "term", "tf")

    # ---- writing ----

    def update(self, changed: DataFrame | None = None, gone: DataFrame | None = None, batch: int | None = None) -> Segments:
        """One more segment: ``changed`` documents, by unique id, are added or take the place of those of the same id; the
        ids in ``gone`` (id) go, unless they are among the changed, and unknown ones say nothing. Null ids and fields: an id
        of null is no document, a field of null is empty.

        With ``batch``, the number of a stream's batch, a batch that is there already changes nothing. All tables commit at
        once; an update that another one overtakes raises Conflict.
        """
        base = self.store.at()
        known = base.parts("figures")
        if known and batch is not None and base.table("figures").filter(F.col("batch") == batch).count():
            return self
        seg = (base.table("figures").agg(F.max("seg")).first()[0] + 1) if known else 0
        spark = self.store.spark
        own = changed.filter(F.col(self.id_col).isNotNull()) if changed is not None else None
        ids = own.select(F.col(self.id_col).alias("id")) if own is not None else None
        if gone is not None:
            left = gone.select("id").filter("id is not null").distinct()
            left = left.join(ids, "id", "left_anti") if ids is not None else left
        if own is not None:
            words = ix._rows(own, self.id_col, self.fields, self.least)
            lengths = words.select("id", F.size("words").cast("bigint").alias("len"))
            posts = ix.posted(words, self.stemmed).select("id", "len", "term", "tf", F.lit(seg).alias("seg"))
        new = left.select("id", F.lit(None).cast("bigint").alias("len")) if gone is not None else None
        if own is not None:
            new = lengths.unionByName(new) if new is not None else lengths
        if new is None:
            return self
        new = materialize(new, "lengths")
        before = _latest(base.table("lengths").join(broadcast_if_small(new.select("id")), "id", "left_semi")) if known else None
        total = lambda df: df.agg(F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
        docs, length = total(new)
        was = total(before) if before is not None else (0, 0)
        figures = spark.createDataFrame([(seg, docs - was[0], length - was[1], batch)], "seg int, documents bigint, length bigint, batch bigint")
        append = {"lengths": new.withColumn("seg", F.lit(seg)), "figures": figures}
        if own is not None:
            append["postings"] = posts.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        self.store.commit(append, base=base, reads=["figures"])
        return self

    def merge(self, fan: int = FAN) -> Segments:
        """Merge parts of one size where there are ``fan`` or more, until there are nowhere so many."""
        while True:
            snap = self.store.at()
            merged = {}
            for name in ("postings", "lengths"):
                tiers: dict[int, list[str]] = {}
                for p in snap.parts(name):
                    tiers.setdefault(int(math.log(max(self.store.size(p), LEAST_BYTES) / LEAST_BYTES, fan)), []).append(p)
                ready = [parts for _, parts in sorted(tiers.items()) if len(parts) >= fan]
                if ready:
                    part = self.store.read(StructType.fromJson(snap.tables[name]["schema"]), ready[0])
                    if name == "postings":
                        part = _live(part, snap).select(*part.columns).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
                    else:
                        part = _latest(part).select(*part.columns)
                    merged[name] = (ready[0], part)
            if not merged:
                return self
            self.store.swap(merged)


def create(store: Store, docs: DataFrame, id_col: str, fields: dict[str, float] | None = None, least: int = 1, stemmed: bool = False) -> Segments:
    """The index of documents by unique id, its first segment."""
    return Segments(store, id_col, fields or {"text": 1.0}, least, stemmed).update(docs)


def apply_changes(index: Segments, changes: DataFrame, batch: int | None = None) -> Segments:
    """An update from a change feed (type, the id and field columns, and ``seq``, the order of an id's changes): of each id
    the last change counts, saves and updates bring its fields, deletes and supersedes take it out. As ``foreachBatch`` with
    the batch's number, a batch that is tried again is applied once; segments are merged behind it."""
    rest = [c for c in changes.columns if c not in (index.id_col, "seq")]
    last = changes.groupBy(index.id_col).agg(F.max(F.struct("seq", *rest)).alias("r")).select(index.id_col, "r.*")
    last = materialize(last, "changes")
    out = F.col("type").isin("MEMORY_DELETED", "MEMORY_SUPERSEDED")
    return index.update(last.filter(~out), last.filter(out).select(F.col(index.id_col).alias("id")), batch).merge()


def _latest(lengths: DataFrame) -> DataFrame:
    """Of each id the row of its last segment."""
    return lengths.groupBy("id").agg(F.max(F.struct("seg", "len")).alias("r")).select("id", "r.*")


def _live(posts: DataFrame, snap: Snapshot) -> DataFrame:
    """Rows of postings whose id has no later segment. Only ids of later segments than the first can take rows out, so the
    other side grows with what has changed since the index was made, not with the index."""
    lengths = snap.table("lengths")
    later = materialize(lengths.filter("seg > 0").groupBy("id").agg(F.max("seg").alias("last")), "later")
    return posts.join(broadcast_if_small(later), "id", "left").filter("last is null or seg = last")


def frequencies(index: Segments) -> DataFrame:
    """(term, df, tf) over live documents."""
    return index.postings(index.store.spark).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
