"""Tables in, and intermediate tables out to the folder that all executors share.

Lineage is cut by writing a table to the shared folder and reading it back, never by
``localCheckpoint``: the written files survive the loss of any executor.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting that names the folder which driver and executors share.
SHARED_DIR_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    It is read from ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a
    temporary folder of this machine is chosen and noted in the session.
    """
    found = spark.conf.get(SHARED_DIR_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftline-shared-")
        spark.conf.set(SHARED_DIR_KEY, found)
    return found.rstrip("/")


class Folder:
    """A folder of any file system that the session knows: what it holds, and removing it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def files(self) -> list[tuple[str, int, int]]:
        """Path, size and time of the folder's files, or of the file that it is."""
        found = [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in self._fs.listStatus(self._at(""))]
        return sorted(f for f in found if not f[0].rpartition("/")[2].startswith(("_", ".")))

    def rename(self, old: str, new: str) -> bool:
        """False if there is such a name."""
        return not self.holds(new) and bool(self._fs.rename(self._at(old), self._at(new))) and self.holds(f"{new}/_SUCCESS")

    def holds(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def claim(self, name: str) -> bool:
        """Makes a marker of this name; false if there is one. Only one of several callers gets true."""
        if self.holds(f"{name}/_SUCCESS"):
            return False
        try:
            self._fs.create(self._at(f".claim-{name}"), False).close()
        except Exception as e:  # the file system's own exception, as Py4J gives it
            if "exist" in str(e).lower():
                return False
            raise
        return True

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


#: For each scope that is open, the tables made in it.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables made within are removed at the end. What is made of them must have been read by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for made in _SCOPES.pop():
            release(made)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table, without its lineage.

    The table stays until the ``scope`` in which it was made ends, or ``release`` is called with it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    if _SCOPES:
        _SCOPES[-1].append(written)
    return written


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written in as many buckets of ``key`` as shuffles have partitions: joins of such tables by their keys move
    nothing. ``release`` removes it."""
    spark = df.sparkSession
    label = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = os.path.join(shared_dir(spark), label)
    df.write.bucketBy(partitions(spark), key).sortBy(key).option("path", path).format("parquet").saveAsTable(label)
    written = spark.table(label)
    written.written_to, written.label = path, label
    if _SCOPES:
        _SCOPES[-1].append(written)
    return written


def as_files(written: DataFrame) -> DataFrame:
    """What ``bucketed`` gave, by its files alone: its name leaves the catalog."""
    spark = written.sparkSession
    read = spark.read.schema(written.schema).parquet(written.written_to)
    spark.sql(f"DROP TABLE IF EXISTS {written.label}")
    written.label, read.written_to = None, written.written_to
    return read


def release(written: DataFrame) -> None:
    """Removes a table that ``materialize`` gave, once nothing reads it any more."""
    if getattr(written, "label", None):
        written.sparkSession.sql(f"DROP TABLE IF EXISTS {written.label}")
    Folder(written.sparkSession, written.written_to).remove()


def partitions(spark: SparkSession) -> int:
    """The number of partitions that shuffles of this session make."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Repeated keys up to this number are broadcast; they take 16 bytes each, or the length of a string.
BROADCAST_KEYS = 100_000


def without_copies(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, which may be null.

    Rows delivered twice are rare, and rows are wide: so the keys alone are shuffled to find the
    repeated ones, and only their rows travel in full; all other rows stay where they are read. The
    repeated keys are counted first: few are broadcast, more than BROADCAST_KEYS are joined by a
    shuffle. The repeated rows are reduced on the map side, hence a key that holds a third of all rows
    still sends one row per task.
    """
    repeated = df.groupBy(F.col(key).alias("__k")).count().where("count > 1").select("__k")
    n = repeated.count()
    if not n:
        return df
    if n <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    same = df[key].eqNullSafe(repeated["__k"])
    return df.join(repeated, same, "left_anti").unionByName(
        df.join(repeated, same, "left_semi").dropDuplicates([key])
    )


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """A table that is made of the files of ``sources`` once and kept in the shared folder.

    Its name holds the names, sizes and times of the files, so a change of any of them makes it anew.
    Of two callers that make it at once each writes its own, and the one that ends first is kept.
    """
    facts = [str(x) for source in sources for x in Folder(spark, source).files()]
    place = f"{name}-{hashlib.md5(chr(10).join(facts).encode()).hexdigest()}"
    folder = Folder(spark, f"{shared_dir(spark)}/kept")
    if not folder.holds(f"{place}/_SUCCESS"):
        own = f"{place}-{uuid.uuid4().hex}"
        made = make()
        (write or (lambda df, path: df.write.parquet(path)))(made, f"{folder.path}/{own}")
        if not folder.rename(own, place):
            folder.remove(own)
    return spark.read.parquet(f"{folder.path}/{place}")
