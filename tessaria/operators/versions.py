"""Versions of documents and snapshots of the corpus, as tables that are never changed in place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.operators.changes import change_set


def snapshot(docs: DataFrame, chunks: DataFrame, version: Column, status: str = "snapshot") -> DataFrame:
    """doc_id, version, content_hash, chunk_count, status, snapshot_data (title, domain, category, chunks in order).

    A document's chunks are one array, as a document is; the corpus has a row per document.
    """
    part = F.struct("ordinal", "chunk_type", "content", "heading_path", "token_count")
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("chunks"))
    joined = docs.join(held, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<ordinal:bigint,chunk_type:string,content:string,heading_path:string,token_count:bigint>>")))
    digest = F.sha2(F.array_join(F.transform("chunks", lambda c: F.sha2(c["content"], 256)), "|"), 256)
    return joined.select(
        "doc_id", version.cast("int").alias("version"), digest.alias("content_hash"), F.size("chunks").cast("long").alias("chunk_count"), F.lit(status).alias("status"),
        F.struct("title", "domain", "category", "chunks").alias("snapshot_data"),
    )


def history(versions: DataFrame, doc_id=None) -> DataFrame:
    v = versions if doc_id is None else versions.where(F.col("doc_id") == doc_id)
    return v.select("doc_id", "version", "content_hash", "chunk_count", "status").orderBy("doc_id", F.col("version").desc())


def latest(versions: DataFrame) -> DataFrame:
    """Each document's row of the greatest version; rows are compared within tasks before they are shuffled."""
    return versions.groupBy("doc_id").agg(F.max_by(F.struct(*versions.columns), "version").alias("r")).select("r.*")


def restored_chunks(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """The chunks of chosen versions (doc_id, version)."""
    return versions.join(targets, ["doc_id", "version"]).select("doc_id", F.explode("snapshot_data.chunks").alias("c")).select("doc_id", "c.*")


def rollback(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """All versions and, for each target, a new one with its content: one above the last, status ``rollback``.

    A chosen version's row becomes two, so that nothing is joined to itself.
    """
    chosen = targets.select("doc_id", "version").distinct().withColumn("_hit", F.lit(True))
    n = versions.withColumn("_last", F.max("version").over(Window.partitionBy("doc_id"))).join(chosen, ["doc_id", "version"], "left")
    own = F.struct("version", "status")
    new = F.struct((F.col("_last") + 1).cast(versions.schema["version"].dataType).alias("version"), F.lit("rollback").alias("status"))
    out = n.withColumn("_v", F.explode(F.when(F.col("_hit"), F.array(own, new)).otherwise(F.array(own))))
    return out.withColumns({"version": F.col("_v.version"), "status": F.col("_v.status")}).select(versions.columns)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, status (added, modified, removed, unchanged) and both content hashes of two snapshots, one row per document each."""
    return change_set(old, new, "doc_id", "content_hash")


def stamp(chunks: DataFrame, version: int, at: Column) -> DataFrame:
    return chunks.withColumns({"corpus_version": F.lit(version), "stamped_at": at})


class VersionedTable:
    """A table as folders ``v=<n>`` and a pointer. A version is written whole in a staging folder and renamed; readers follow the pointer."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.where)
        if not self.fs.exists(root):
            return []
        return sorted(int(n[2:]) for s in self.fs.listStatus(root) if (n := s.getPath().getName()).startswith("v="))

    def current(self) -> int | None:
        """The version that readers see: what the last pointer says, else the last."""
        root = self._path(f"{self.where}/pointers")
        if not self.fs.exists(root):
            return (self.versions() or [None])[-1]
        last = max(s.getPath().getName() for s in self.fs.listStatus(root))
        return int(last.split("-")[1])

    def write(self, df: DataFrame, activate: bool = True) -> int:
        n = (self.versions() or [0])[-1] + 1
        stage = f"{self.where}/staging-{uuid.uuid4().hex}"
        df.write.parquet(stage)
        if not self.fs.rename(self._path(stage), self._path(f"{self.where}/v={n}")):
            raise OSError(f"version {n} was written by another")
        if activate:
            self.activate(n)
        return n

    def activate(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        root = self._path(f"{self.where}/pointers")
        self.fs.mkdirs(root)
        turn = len(self.fs.listStatus(root)) + 1
        self.fs.create(self._path(f"{self.where}/pointers/{turn:08d}-{version}"), False).close()

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/v={self.current() if version is None else version}")


class Commits:
    """One pointer over several tables: a state names the version of each, and readers see the last state as a whole.

    A state is written first, and becomes the next turn by a file that can be
    created once: of two writers that follow one turn the second gets an error, and
    changes nothing. A turn without content, whose writer was lost in between, is none.
    """

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), False)  # fails where the file is there
        out.write(bytearray(text.encode()))
        out.close()

    def turns(self) -> list[int]:
        root = self._path(f"{self.where}/turns")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def current(self) -> tuple[int, dict[str, int]]:
        """The last turn, and the state that readers see."""
        turns = self.turns()
        for t in reversed(turns):
            if name := self._text(f"{self.where}/turns/{t:08d}"):
                return turns[-1], json.loads(self._text(f"{self.where}/states/{name}"))
        return (turns or [0])[-1], {}

    def advance(self, after: int, state: dict[str, int]) -> int:
        """Makes a state the one that follows turn ``after``."""
        name = f"{uuid.uuid4().hex}.json"
        self._put(f"{self.where}/states/{name}", json.dumps(state))
        try:
            self._put(f"{self.where}/turns/{after + 1:08d}", name)
        except Exception as e:
            raise OSError(f"another writer has followed turn {after}") from e
        return after + 1
