"""Token counts as rollups that are maintained by deltas.

Totals by source, language and tokenizer version are additive: inserts add a
document's counts, deletes subtract what the ledger holds of it, revised counts
do both, and so does the insert of a document that the ledger holds already. A
batch is committed by renaming one staged folder, which holds its signed sums and
its ledger rows, to the batch's own name; the renaming fails where that is
taken. A batch that is there already is skipped, so that a replay or a retry
after a failure adds nothing; readers see a batch whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm import tokens
from tessaria.llm.common import drop, rename_once, small_batches

VERSION = "byte_bpe_50k"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, version: str = VERSION, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, tokenizer, n_docs (1), n_tokens, n_chars. Null texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t.as_py() for t in b.column(3)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1), b.column(2), pa.array([version] * n), pa.array([1] * n, pa.int64()),
                        pa.array([len(tokens.ids(enc, t)) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()),
                    ],
                    [f.split()[0] for f in LEDGER.split(", ")],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, LEDGER)


class Rollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.where)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def batches(self) -> list[str]:
        root = self.path(f"{self.where}/batches")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.where}/batches/{b}/{part}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What each document adds to the totals at present: signed rows summed, zeros gone."""
        return self._read("ledger", LEDGER).groupBy("doc_id", *KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars; keys whose documents are all gone are left out."""
        return self._read("sums", TOTALS).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commits a batch once; False if it was there.

        inserts and revised have the columns of the ledger, deletes has doc_id and
        tokenizer. A revised document's present rows are taken back, whatever their
        source and language, and an inserted one's too, if other batches have brought it;
        one that is unknown is an insert; an unknown delete does nothing. Null sources
        and languages are values like any other, and so are null ids, but that an insert
        without an id is always new. Within a batch rows of one document add up. Empty
        tables add nothing. Batches that share documents are committed one after another.
        """
        final = self.path(f"{self.where}/batches/{batch}")
        if self.fs.exists(final):
            return False
        signed = [x for x in (inserts, revised) if x is not None]
        gone = [x.select("doc_id", "tokenizer") for x in (deletes, revised) if x is not None]
        if inserts is not None and self.batches():
            gone.append(inserts.where("doc_id is not null").select("doc_id", "tokenizer"))
        if gone:
            ids = reduce(DataFrame.unionByName, gone).distinct().withColumnsRenamed({"doc_id": "d", "tokenizer": "t"})
            held = self.ledger()
            held = held.join(ids, held.doc_id.eqNullSafe(ids.d) & held.tokenizer.eqNullSafe(ids.t), "left_semi")
            signed.append(held.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS]))
        if not signed:
            raise ValueError("an empty batch")
        names = ["doc_id", *KEYS, *SUMS]
        rows = signed[0].select(names)
        for x in signed[1:]:
            rows = rows.unionByName(x.select(names))
        stage = f"{self.where}/staged/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{stage}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{stage}/ledger")
        written.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).coalesce(1).write.parquet(f"{stage}/sums")
        self.fs.mkdirs(self.path(f"{self.where}/batches"))
        if not rename_once(self.spark, stage, final.toString()):
            drop(self.spark, stage)
            return False
        return True
