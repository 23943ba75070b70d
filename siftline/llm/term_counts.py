"""Problem 1: how often each term occurs, in how many records, and which terms are of no use.

Incremental signed deltas. The counts are a persistent table, partitioned by a hash of the term. A
change to the collection is given as the entries that the changed records had and those they have:
the former count -1, the latter +1, and the sums per term are the delta. Only the partitions that
the delta touches are read and written again, as a new version; a manifest, written last, says
which version of each partition holds, so an update that is cut off leaves the old counts in force.
The first load is the delta from nothing.

The number of partitions is a power of two that follows the rows: a partition that outgrows
PER_BUCKET rows has the whole store spread over more of them at the next change. A manifest is a
folder named by its version, and making that folder is what claims the version: of two writers, one
fails. Files that no manifest needs any more are removed after each change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import fold, fold_sql, stripped, stripped_sql
from siftline.storage import Folder, materialize, shared_dir, table

#: A term is too rare if at most so many records hold it, too common if more than this share does.
RARE, COMMON = 2, 0.25
#: Partitions of a new store, and rows of a partition beyond which there are more of them.
BUCKETS, PER_BUCKET = 16, 2_000_000


def folded_term(term: Column) -> Column:
    return stripped(fold(term))


def term_entries(postings: DataFrame, term: str = "term", record: str = "doc_id", times: str = "term_frequency", places: str = "positions") -> DataFrame:
    """(term, record, n): one entry for each folded term of a record.

    Repeated entries, and different written forms of one term, are one entry. n is the number of
    different places of the entry that has most of them; where none has any, the greatest stated
    frequency, at least 1. Null records have no entry. Null and blank terms of a record are one entry
    with a null term and n = 0, which counts for no term; a record without others counts by it.
    """
    p = postings.select(
        F.col(term).alias("form"), F.col(record).alias("record"),
        F.coalesce(F.size(F.array_distinct(F.col(places))), F.lit(0)).alias("places"), F.col(times).alias("times"),
    ).where("record is not null")
    per_form = p.groupBy("form", "record").agg(F.max("places").alias("places"), F.max("times").alias("times"))
    folded = per_form.withColumn("term", F.nullif(folded_term(F.col("form")), F.lit("")))
    merged = folded.groupBy("term", "record").agg(F.max("places").alias("places"), F.max("times").alias("times"))
    n = F.when(F.col("places") > 0, F.col("places")).otherwise(F.greatest(F.col("times"), F.lit(1)))
    return merged.select("term", "record", F.when(F.col("term").isNull(), 0).otherwise(n).cast("long").alias("n"))


def signed_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term, occurrences, records): what the change of some records from the entries ``before`` to
    the entries ``after`` adds to each term's counts. Terms that don't change have no row."""
    entries = lambda df, sign: df.where("term is not null").select("term", (F.col("n") * sign).alias("occurrences"), F.lit(sign).alias("records"))
    return (
        entries(before, -1).unionByName(entries(after, 1)).groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .where("occurrences <> 0 or records <> 0")
    )


_COUNTS = "term string, occurrences long, records long"
_MANIFEST = "buckets int, total long, bucket int, folder string, rows long"


class TermCounts:
    """A persistent store of counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, per_bucket: int = PER_BUCKET):
        self.spark, self.path, self.buckets, self.per_bucket = spark, path, buckets, per_bucket
        #: The folder and rows of each partition that holds rows, and the number of records; as many as partitions.
        self.manifest: dict[int, str] = {}
        self.rows: dict[int, int] = {}
        self.total = 0
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET, *, abandon: bool = False) -> TermCounts:
        """The newest whole version of the store at ``path``. ``abandon`` frees the version of a writer that has ended
        before it made its manifest."""
        folder = Folder(spark, f"{path}/manifests")
        versions = sorted((int(name) for name in folder.names() if name.isdigit() and folder.holds(f"{name}/_SUCCESS")), reverse=True)
        if not versions:
            raise ValueError(f"no counts at {path}")
        if abandon:
            folder.remove(f".claim-{versions[0] + 1}")
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{versions[0]}").collect()
        store = cls(spark, path, rows[0].buckets, per_bucket)
        store.version, store.total = versions[0], rows[0].total
        store.manifest = {r.bucket: r.folder for r in rows if r.bucket is not None}
        store.rows = {r.bucket: r.rows for r in rows if r.bucket is not None}
        return store

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """(bucket, term, occurrences, records) of the current version, or of some partitions of it."""
        folders = [f for b, f in sorted(self.manifest.items()) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], f"bucket int, {_COUNTS}")
        read = self.spark.read.schema(_COUNTS).parquet(*folders)
        return read.select(self._bucket(F.col("term")), "term", "occurrences", "records")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int").alias("bucket")

    def apply(self, before: DataFrame | None, after: DataFrame | None) -> None:
        """Merges a change: the entries that the added, changed or deleted records had and have. Records
        that don't change must be in neither. Fails if another writer has made this version."""
        nothing = self.spark.createDataFrame([], "term string, record long, n long")
        before, after = before if before is not None else nothing, after if after is not None else nothing
        version, own = self.version + 1, uuid.uuid4().hex[:8]
        # once per change and record: what the change adds to the number of records
        signs = before.select("record").distinct().select(F.lit(-1).alias("s")).unionByName(after.select("record").distinct().select(F.lit(1).alias("s")))
        total = self.total + signs.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
        delta = materialize(signed_delta(before, after), "term-delta")
        buckets, known = self.buckets, {*self.manifest}
        expected = sum(self.rows.values()) + delta.count()
        while expected > self.buckets * self.per_bucket:
            self.buckets *= 2
        if self.buckets == buckets:
            touched = {r.bucket for r in delta.select(self._bucket(F.col("term"))).distinct().collect()}
            old = self.counts(sorted(touched))
        else:  # every partition is split
            touched, old = known | {*range(self.buckets)}, self.counts()
        merged = (
            old.drop("bucket").unionByName(delta).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("records > 0")
        )
        ended = f"{self.path}/counts-{version}-{own}"
        # what the next version needs of it is counted as it is written
        merged.select(self._bucket(F.col("term")), "*").repartition(min(self.buckets, max(1, len(touched))), "bucket").write.partitionBy("bucket").parquet(ended)
        sizes = self.spark.read.schema(f"{_COUNTS}, bucket int").parquet(ended).groupBy("bucket").count().collect() if touched else []
        kept = {r.bucket: r["count"] for r in sizes}
        manifest = {b: f for b, f in self.manifest.items() if b not in touched} | {b: f"{ended}/bucket={b}" for b in kept}
        rows_of = {b: n for b, n in self.rows.items() if b not in touched} | kept
        rows = [(self.buckets, total, b, f, rows_of[b]) for b, f in sorted(manifest.items())] or [(self.buckets, total, None, None, None)]
        if not Folder(self.spark, f"{self.path}/manifests").claim(str(version)):
            self.buckets = buckets
            raise RuntimeError(f"version {version} of {self.path} has been made by another writer")
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")
        self.manifest, self.rows, self.total, self.version = manifest, rows_of, total, version
        self.tidy()

    def tidy(self) -> None:
        """Removes the counts of versions that the last two manifests don't name, and older manifests."""
        folder = Folder(self.spark, self.path)
        manifests = Folder(self.spark, f"{self.path}/manifests")
        old = [name for name in manifests.names() if name.isdigit() and int(name) < self.version - 1]
        needed = {f.rstrip("/") for f in self.manifest.values()}
        if manifests.holds(f"{self.version - 1}/_SUCCESS"):  # a reader may have it open
            last = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{self.version - 1}")
            needed |= {r.folder for r in last.where("folder is not null").collect()}
        versions = {f.rpartition("/")[0].rpartition("/")[2] for f in needed}
        for name in folder.names():
            if name.startswith("counts-") and name not in versions and int(name.split("-")[1]) <= self.version:
                folder.remove(name)
        for name in old:
            manifests.remove(name)


def marked(counts: DataFrame, n_records: int, *, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, mark): `rare` for at most ``rare`` records, `common` for more than the share ``common`` of
    ``n_records``. A term for which both hold has two rows, one for which neither holds has none."""
    marks = F.array(
        F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.col("records") > F.lit(n_records) * common, F.lit("common"))
    )
    return counts.select("term", F.explode(F.array_compact(marks)).alias("mark"))


def _loaded(spark: SparkSession, sf_dir: str) -> TermCounts:
    store = TermCounts(spark, f"{shared_dir(spark)}/term-counts-{uuid.uuid4().hex}")
    store.apply(None, materialize(term_entries(table(spark, sf_dir, "postings")), "term-entries"))
    return store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, mark) of the terms of postings that are too rare or too common to help a search."""
    store = _loaded(spark, sf_dir)
    return marked(store.counts(), store.total)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, occurrences, records): of every term of postings its occurrences and the pages that hold it."""
    return _loaded(spark, sf_dir).counts().select("term", "occurrences", "records")


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``p1_counts``, come to by changes. First, every entry of the pages with an odd doc_id counts, as
    often as it states, and so do entries of pages that don't exist. Then those pages are deleted, the
    pages with an even doc_id are added, and the entries whose places say otherwise are changed."""
    postings = table(spark, sf_dir, "postings")
    true = materialize(term_entries(postings), "term-entries")
    stated = materialize(term_entries(postings.withColumn("positions", F.lit(None).cast("array<int>"))), "term-entries")
    odd = F.pmod(F.col("record"), F.lit(2)) == 1
    gone = stated.where(odd).select("term", (-1 - F.col("record")).alias("record"), "n")
    store = TermCounts(spark, f"{shared_dir(spark)}/term-counts-{uuid.uuid4().hex}")
    store.apply(None, stated.where(odd).unionByName(gone))
    corrected = stated.where(odd).withColumnRenamed("n", "was").join(true, ["term", "record"]).where("was <> n")
    changed = corrected.select("record").distinct()
    before = stated.where(odd).join(changed, "record", "left_semi")
    after = true.join(changed, "record", "left_semi").unionByName(true.where(~odd))
    store.apply(before.unionByName(gone), after)
    return store.counts().select("term", "occurrences", "records")


_ENTRIES_SQL = f"""
WITH f AS (SELECT {stripped_sql(fold_sql("term"))} AS term, doc_id,
                  len(list_distinct(positions)) AS places, term_frequency AS times
           FROM (SELECT DISTINCT * FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL)),
e AS (SELECT term, doc_id, CASE WHEN max(coalesce(places, 0)) > 0 THEN max(places) ELSE greatest(max(times), 1) END AS n
      FROM f WHERE term <> '' GROUP BY term, doc_id),
c AS (SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM e GROUP BY term)
"""

SQL = {
    "p1_counts": _ENTRIES_SQL + "SELECT term, occurrences, records FROM c",
    "p1_incremental": _ENTRIES_SQL + "SELECT term, occurrences, records FROM c",
    "p1_found": _ENTRIES_SQL + f"""
SELECT term, 'rare' AS mark FROM c WHERE records <= {RARE}
UNION ALL
SELECT term, 'common' AS mark FROM c WHERE records > (SELECT count(DISTINCT doc_id) FROM postings) * {COMMON}""",
}
