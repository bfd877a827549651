"""What the operators share: reading tables, and tables kept in the shared folder."""

from __future__ import annotations

import getpass
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes in one Arrow batch between the JVM and Python, so that batches of long texts stay small on both sides.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches in rows and bytes, unless they are smaller, and returns df.

    A plan reads these settings when it runs, so they stay set in the session.
    """
    conf, size = df.sparkSession.conf, df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, wide = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if size(conf.get(wide)) > BATCH_BYTES:
        conf.set(wide, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in, but only if driver and
    executors are one process; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/tessaria-{getpass.getuser()}").rstrip("/")


#: A key's rows are dealt into so many parts where the key may hold any share of the table.
SALTS = 1024


def join_spread(df: DataFrame, other: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """df joined with ``other``, which has one row per key, where one key may hold any share of df's rows.

    df's rows are dealt by a hash of the columns ``by``; ``other`` is first joined to
    the distinct (key, part) pairs, at most SALTS per key, so that a hot key is spread over many tasks.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*by, F.lit(9)), F.lit(SALTS)))
    spots = dealt.select(*keys, "_part").distinct().join(other, keys)
    return dealt.join(spots, [*keys, "_part"], how).drop("_part")


def keep(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder, in subfolders by a column if named, which cuts its lineage; returns it reread, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that :func:`keep` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder unless the target is there, in one step of the file system; False if it is."""
    context, fs = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    never_over = context._gateway.new_array(kind, 1)
    never_over[0] = kind.NONE
    to = fs.Path(target)
    files = fs.FileContext.getFileContext(to.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(to).toUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(fs.Path(source), to, never_over)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True
