"""Ingestion: files to documents, chunks, versions and a job row, as one plan per table.

A knowledge base is a folder of versioned tables (documents, chunks, versions,
files, jobs). A run hashes the files and parses those alone whose bytes are not
known, compares what it read with what is stored, and makes chunks only for
what is new or changed. All tables' new versions become visible by one commit; a file that can't be read is reported in the job and
harms no other. The job's counters are taken while the run's log of files is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions.text import clean_text, normalise
from tessaria.functions.tokens import quality_score
from tessaria.operators import changes, chunking, monitoring, quality, versions
from tessaria.operators.components import kept
from tessaria.operators.index import Index, build_index
from tessaria.operators.observed import observed
from tessaria.sources import office

DOCUMENTS = "doc_id string, source_path string, title string, domain string, category string, status string, version int, content_hash string, source_hash string, chunk_count long, updated_at timestamp"
CHUNKS = "doc_id string, ordinal long, chunk_type string, content string, heading_path string, token_count long, chunk_id string, quality_score double, is_verified boolean, errors array<string>"
JOBS = "job_type string, finished_at timestamp, files long, succeeded long, failed long, created long, updated long, skipped long, chunks long, errors array<string>"


@dataclass
class Settings:
    """max, min and overlap are tokens; ``block_bad`` leaves chunks out that fail validation."""

    max_tokens: int = chunking.MAX_TOKENS
    min_tokens: int = chunking.MIN_TOKENS
    overlap: int = chunking.OVERLAP
    parent_scope: str = "sheet"
    dedup_questions: bool = False
    block_bad: bool = False
    domain: str = "general"
    category: str = "article"


class KnowledgeBase:
    """The tables of a folder, all read as the last commit has them, or empty."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark = spark
        self.tables = {n: versions.VersionedTable(spark, f"{where.rstrip('/')}/{n}") for n in ("documents", "chunks", "jobs", "versions", "files")}

        self.commits = versions.Commits(spark, f"{where.rstrip('/')}/commits")

    def version(self, name: str) -> int | None:
        """The version of a table in the last commit."""
        return self.commits.current()[1].get(name)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        at = self.version(name)
        return self.tables[name].read(at) if at is not None else self.spark.createDataFrame([], schema or {"documents": DOCUMENTS, "chunks": CHUNKS, "jobs": JOBS}[name])

    def wipe(self) -> None:
        """All tables are empty from the next commit on; their versions stay in the folder, and an earlier state can be committed again."""
        self.commits.advance(self.commits.current()[0], {})

    def rebuild(self, folder: str, as_of: Column, settings: Settings = Settings()) -> DataFrame:
        """All files anew: the tables are overwritten by new versions. Returns the job row."""
        return self._run("full", folder, as_of, settings)

    def update(self, folder: str, as_of: Column, settings: Settings = Settings()) -> DataFrame:
        """New and changed files only; documents whose files are gone stay until a rebuild."""
        return self._run("incremental", folder, as_of, settings)

    def _run(self, kind: str, folder: str, as_of: Column, s: Settings) -> DataFrame:
        turn, state = self.commits.current()
        state = dict(state)

        def put(name: str, df: DataFrame) -> DataFrame:
            state[name] = self.tables[name].write(df, activate=False)
            return self.tables[name].read(state[name])

        old_of = lambda name: self.tables[name].read(state[name]) if kind == "incremental" and name in state else None
        stored = self.read("documents") if kind == "incremental" else self.spark.createDataFrame([], DOCUMENTS)
        seen = kept(office.scan_files(self.spark, folder).select("path", F.sha2("content", 256).alias("source_hash")), "files")
        known = stored.select(F.col("source_path").alias("path"), "source_hash")
        todo_files = kept(seen.join(known, ["path", "source_hash"], "left_anti").select("path"), "todo")
        parsed = kept(office.parse_files(self._files(folder, todo_files)).join(seen, "path"), "parsed")  # read by four tables, and not parsed again where a worker is lost
        good = parsed.where("error is null").withColumn("content_hash", changes.content_hash(F.col("content")))
        change = changes.ingest_decision(changes.change_set(stored.select(F.col("source_path").alias("path"), "content_hash"), good, "path", "content_hash")).select("path", "action")
        todo = good.join(change.where("action in ('create', 'update')"), "path")
        doc_id = changes.stable_id(F.col("path")).alias("doc_id")
        fresh = make_chunks(todo.select(doc_id, "path", "content", "file_type", "sheets"), s)
        chunks = changes.replace_children(self.read("chunks") if kind == "incremental" else self.spark.createDataFrame([], CHUNKS), fresh, "doc_id")
        chunks = put("chunks", chunks)
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        old = stored.select("doc_id", F.col("version").alias("_v"))
        new = todo.select(doc_id, F.col("path").alias("source_path"), "title", F.lit(s.domain).alias("domain"), F.lit(s.category).alias("category"), F.lit("active").alias("status"), "content_hash", "source_hash").join(old, "doc_id", "left")
        new = new.select("doc_id", "source_path", "title", "domain", "category", "status", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "content_hash", "source_hash").join(counts, "doc_id", "left").fillna(0, ["chunk_count"]).withColumn("updated_at", as_of)
        # A file that was written anew with the same text isn't changed, but its bytes are known from now on.
        touched = good.select(F.col("path").alias("source_path"), F.col("source_hash").alias("_h"))
        rest = stored.join(new.select("doc_id"), "doc_id", "left_anti").join(touched, "source_path", "left").withColumn("source_hash", F.coalesce("_h", "source_hash")).drop("_h")
        documents = put("documents", rest.unionByName(new))
        rows = seen.select("path").join(parsed.select("path", "error", F.lit(True).alias("_read")), "path", "left").join(change, "path", "left").join(counts.withColumnRenamed("doc_id", "_d"), changes.stable_id(F.col("path")) == F.col("_d"), "left")
        action = F.when(F.col("_read").isNull(), "skip").otherwise(F.coalesce("action", F.lit("failed")))
        rows = rows.select("path", action.alias("action"), F.col("error").isNull().alias("ok"), F.when(action.isin("create", "update"), F.col("chunk_count")).alias("n_chunks"), "error", as_of.alias("run_at"))
        counters = monitoring.job_counters()
        seen_rows, taken = observed(rows, **counters)
        put("files", seen_rows if (log := old_of("files")) is None else log.unionByName(seen_rows))
        errors = parsed.where("error is not null").agg(F.array_sort(F.collect_list(F.concat_ws(": ", F.element_at(F.split("path", "/"), -1), "error"))).alias("errors"))  # files at fault alone
        job = errors.select(F.lit(kind).alias("job_type"), as_of.alias("finished_at"), *[F.lit(taken.get[c]).cast("long").alias(c) for c in counters], "errors")
        put("jobs", self.read("jobs").unionByName(job).coalesce(1))
        snap = versions.snapshot(documents.join(new.select("doc_id"), "doc_id", "left_semi"), chunks, F.col("version"))
        put("versions", snap if (held := old_of("versions")) is None else held.unionByName(snap))
        self.commits.advance(turn, state)
        return self.read("jobs").orderBy(F.col("finished_at").desc()).limit(1)

    def _files(self, folder: str, todo: DataFrame) -> DataFrame:
        """The contents of the files to be read: all of the folder's where none is known, else those named, whose paths the driver's file index holds in any case."""
        if self.version("documents") is None:
            return office.scan_files(self.spark, folder)
        paths = [r["path"] for r in todo.collect()]
        if not paths:
            return self.spark.createDataFrame([], "path string, content binary")
        return self.spark.read.format("binaryFile").load(paths).select("path", "content")

    def index(self, children: bool = False) -> Index:
        """The index of the chunks, or of those that are no parents, written once for each version of the chunks and read from then on."""
        table = self.tables["chunks"]
        rows = self.read("chunks")
        if children:
            rows = rows.where(~F.col("chunk_type").endswith("_parent"))  # a parent repeats its only child's text
        made = build_index(rows, "chunk_id", F.col("content"))
        if (at := self.version("chunks")) is None:
            return made
        where = f"{table.where}-index/v={at}-{'children' if children else 'all'}"
        if not table.fs.exists(table._path(f"{where}/norms/_SUCCESS")):  # the last table that is written
            made.write(where)
        return Index.read(self.spark, where)

    def vectors(self, embed: Callable[[Column], Column] = changes.hash_embed) -> DataFrame:
        """doc_id and vector of the chunks, written once for each version of the chunks."""
        table = self.tables["chunks"]
        made = self.read("chunks").select(F.col("chunk_id").alias("doc_id"), embed(F.col("content")).alias("vector"))
        if (at := self.version("chunks")) is None:
            return made
        where = f"{table.where}-vectors/v={at}"
        if not table.fs.exists(table._path(f"{where}/_SUCCESS")):
            made.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(made.schema).parquet(where)

    def status(self) -> DataFrame:
        """documents and chunks by status, category and kind: dimension, value, n."""
        return monitoring.counts_by(self.read("documents"), "status", "domain", "category").unionByName(monitoring.counts_by(self.read("chunks"), "chunk_type"))


def make_chunks(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Chunks of parsed files (doc_id, path, content, file_type, sheets): rows of known sheets, else the structure of the normalised text."""
    sheet = docs.select("doc_id", F.posexplode("sheets").alias("sheet_no", "sheet")).select("doc_id", "sheet_no", "sheet.name", chunking.detect_schema(F.col("sheet.headers")).alias("schema"), "sheet.headers", "sheet.rows")
    known = sheet.where("schema in ('crm_qa', 'reason_codes')")
    qa = chunking.sheet_rows(known.where("schema = 'crm_qa'"), "qa_pair", s.dedup_questions)
    kids = qa.unionByName(chunking.sheet_rows(known.where("schema = 'reason_codes'"), "reason_detail"))
    names = ["doc_id", "ordinal", "chunk_type", "content", "heading_path", "token_count"]
    last = kids.groupBy("doc_id").agg((F.max("ordinal") + 1).alias("_n"))
    over = chunking.parents(kids, s.parent_scope).join(last, "doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_key", "chunk_type"))  # a document's sheets are few
    over = over.withColumn("ordinal", (F.col("_n") + nth - 1).cast(kids.schema["ordinal"].dataType)).withColumn("heading_path", F.lit("")).select(names)
    rows = chunking.with_overlap(kids.select(names), "doc_id", s.overlap, *chunking.SEMANTIC_MARKS).unionByName(over)
    text = docs.join(known.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", normalise(clean_text(F.col("content"))).alias("text"))
    body = chunking.semantic(text, most=s.max_tokens, least=s.min_tokens, overlap=s.overlap).select(names)
    out = rows.unionByName(body)
    out = out.withColumns({"chunk_id": changes.stable_id(F.col("doc_id"), F.col("ordinal"), F.col("content")), "quality_score": quality_score(F.col("content")), "is_verified": F.lit(False), "errors": quality.chunk_errors(F.col("content"))})
    return out.where(F.size("errors") == 0) if s.block_bad else out
