"""What the corpus operators share: shared-folder tables, let-bindings and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (spark.checkpoint.dir); with a local master a local one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-sparquarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    written(df, path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparquarry_path = path
    return out


def written(df: DataFrame, path: str, **options: str) -> None:
    """Write df as Parquet; the shuffle files of that write go as soon as it has ended.

    Python workers get few rows at a time, as texts may be long.
    """
    conf, before = df.sparkSession.conf, {}
    for key, value in {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}.items():
        before[key] = conf.get(key, None)
        conf.set(key, value)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_sparquarry_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def sized(df: DataFrame, most_rows: int = 50_000, most_bytes: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint only if it has few rows and the files that it reads are small together.

    df must be cheap to count: a stored table or columns of one.
    """
    conf, total = df.sparkSession._jsc.hadoopConfiguration(), 0
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for file in df.inputFiles():
        p = path(file)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
        if total > most_bytes:
            return df
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
