"""What the operators of this subpackage share: table access, shared work folders, skew-proof lookups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy when it holds at least this share of all rows, so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1 / 512
FILE_ROWS = 250_000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is the session's spark.checkpoint.dir; where that is unset and
    the session is local, as in tests, a temporary folder of this machine is made and set. A cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        at = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cytoloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{work_dir(spark)}/cytoloom/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and return the written table: it cuts the lineage, and losing an executor
    later costs a re-read, not a re-run.

    rows is a bound on the number of rows of a narrow table: it is written by tasks of FILE_ROWS rows or so, in place of
    one small file for each shuffle partition. Large tables keep their partitions."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand memory that this Python worker no longer uses back to the system. Executors keep idle workers, several a core
    when tasks are short, and without this each would keep its largest task's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, releasing its memory at the end of a task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def bounded(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, after making sure that its session hands Python workers `rows` rows at a time at most. Texts are long: with the
    default of 10,000 rows a batch and its copies would hold hundreds of MB on either side. A setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(rows))
    return df


def map_arrow(df: DataFrame, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    return bounded(df).mapInArrow(tidy(work), schema)


def map_pandas(df: DataFrame, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    return bounded(df).mapInPandas(tidy(work), schema)


def clean(spark: SparkSession | None = None) -> None:
    """Delete the work tables that this process has made."""
    while _made:
        made_by, path = _made.pop()
        try:
            jvm = made_by._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(made_by.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; its folder goes with it
            pass


atexit.register(clean)


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left-join rows to dim, which has each key once and says in `weight` how many rows carry it.

    Keys that hold HEAVY_SHARE of all rows or more are at most 1 / HEAVY_SHARE by counting; their dim rows are
    broadcast, so their rows never meet in one task. All other keys go through an ordinary shuffle join."""
    total = dim.agg(F.sum(weight).alias("n")).first()["n"] or 0
    least = max(1000, int(total * HEAVY_SHARE))
    others = [c for c in dim.columns if c not in keys]
    heavy = dim.filter(F.col(weight) >= least)
    if total < 1000 or heavy.isEmpty():
        return rows.join(dim, keys, "left")
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    cols = [*rows.columns, *others]
    rest = marked.filter("_heavy IS NULL").select(*rows.columns).join(dim.filter(F.col(weight) < least), keys, "left")
    return marked.filter("_heavy").select(*cols).unionByName(rest.select(*cols))


#: Keys of rows to drop are broadcast up to this many (40 bytes each); more of them are joined by a shuffle.
MAX_DROPPED = 200_000


def text_digest(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of a text as it stands; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def keep_one(docs: DataFrame, found: DataFrame, group: str, total: int) -> DataFrame:
    """docs with exactly one row of each group, all columns as they were.

    found has a row for each of the `total` rows of docs: doc_id, digest (text_digest of its text), group, and candidate,
    whether the row may stay; rows equal in doc_id and digest agree in both. Every group has a candidate. Of several the
    one with the least digest stays, and of rows that repeat its doc_id and text any one. Rows are told by doc_id and
    digest, null ids included, so no row falls with another that merely shares its id."""
    found = materialize(found.select("doc_id", "digest", F.col(group).alias("group"), "candidate"), "verdicts", rows=total)
    may = found.filter("candidate")
    tied = may.groupBy("group").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.count("*").alias("n")).filter("least <> most")
    tied = materialize(tied.drop("most"), "tied", rows=total)
    may = lookup(may, tied, ["group"], "n").withColumn("stays", F.coalesce(F.col("digest") == F.col("least"), F.lit(True)))
    key = (F.col("doc_id").alias("__cytoloom_id"), F.col("digest").alias("__cytoloom_digest"))
    gone = materialize(found.filter("NOT candidate").unionByName(may.filter("NOT stays").select(*found.columns)).select(*key).distinct(), "dropped", rows=total)
    again = may.filter("stays").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    again = materialize(again.select(*key), "repeated", rows=total)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__cytoloom_id")) & (text_digest(F.col("text")) == F.col("__cytoloom_digest"))

    def met(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(keys) if keys.count() <= MAX_DROPPED else keys, same, how)

    if again.isEmpty():
        return met(gone, "left_anti")
    once = met(again, "inner").dropDuplicates(["__cytoloom_id", "__cytoloom_digest"]).select(*docs.columns)
    return met(gone.union(again), "left_anti").unionByName(once)
