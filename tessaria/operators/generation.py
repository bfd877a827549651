"""What needs a language model, behind one interface: a function of a column of prompts to a column of answers.

``pandas_generator`` wraps a client, made once per worker; ``mock`` answers
without one. Parsing, validation and fallbacks are native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions.tokens import repaired_json, words
from tessaria.operators import metrics, ranking
from tessaria.operators.index import Index

Generator = Callable[[Column], Column]
Scorer = Callable[..., Column]


def pandas_generator(make_client: Callable[[], Callable[[list[str]], list[str]]]) -> Generator:
    """A generator from a factory of clients; a client takes a list of prompts. A prompt that fails has a null answer."""

    def generate(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = make_client()
            for s in batches:
                try:
                    yield pd.Series(client(s.tolist()), dtype=object)
                except Exception:  # one by one, to lose the failing prompts only
                    out: list[str | None] = []
                    for p in s:
                        try:
                            out.extend(client([p]))
                        except Exception:
                            out.append(None)
                    yield pd.Series(out, dtype=object)

        return run(c)

    return generate


def mock(c: Column) -> Column:
    """The prompt's last line as the answer."""
    return F.element_at(F.split(c, "\n"), -1)


def prompted(template: str, **values: Column) -> Column:
    """A template whose ``{name}`` are filled in."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def hypothetical(queries: DataFrame, generate: Generator, template: str = "Answer:\n{query}") -> DataFrame:
    """query_id, text: the model's hypothetical answer as the query's text; where it has none the query has no row."""
    return queries.select("query_id", generate(prompted(template, query=F.col("text"))).alias("text")).where("text is not null and trim(text) <> ''")


def hyde_search(queries: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], generate: Generator, k: int) -> DataFrame:
    docs = hypothetical(queries, generate)
    return ranking.dense(docs.select("query_id", embed(F.col("text")).alias("vector")), vectors, k)


def reformulate(queries: DataFrame, generate: Generator, template: str = "Rewrite:\n{query}") -> DataFrame:
    """query_id, type, text from the JSON array of an answer; a query whose answer has none stands for itself as ``original``."""
    j = repaired_json(generate(prompted(template, query=F.col("text"))), "array<struct<query:string,type:string>>")
    made = queries.select("query_id", "text", F.filter(F.coalesce(j, F.array().cast("array<struct<query:string,type:string>>")), lambda x: x["query"].isNotNull()).alias("qs"))
    own = F.array(F.struct(F.col("text").alias("query"), F.lit("original").alias("type")))
    return made.select("query_id", F.explode(F.when(F.size("qs") > 0, F.col("qs")).otherwise(own)).alias("q")).select("query_id", F.coalesce("q.type", F.lit("unknown")).alias("type"), F.col("q.query").alias("text"))


def multi_query_search(queries: DataFrame, index: Index, k: int, generate: Generator) -> DataFrame:
    variants = reformulate(queries, generate).groupBy("query_id").agg(F.collect_list("text").alias("texts"))  # a model's handful
    both = queries.join(variants, "query_id")
    legs = both.select("query_id", F.posexplode("texts").alias("leg", "text")).withColumn("id", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("leg").cast("string")))
    ranked = ranking.bm25(legs.select(F.col("id").alias("query_id"), "text"), index, ranking.OVERFETCH * k)
    part = ranked.withColumnRenamed("query_id", "id").join(legs.select("id", "query_id"), "id").select("query_id", "doc_id", (1.0 / (ranking.RRF_K + F.col("rank"))).alias("part"))
    return ranking.top_k(part.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def questions_from_chunks(chunks: DataFrame, generate: Generator, template: str = "Questions about:\n{content}") -> DataFrame:
    """chunk_id, query, type: a model's questions about each chunk; answers that don't parse give none."""
    j = repaired_json(generate(prompted(template, content=F.col("content"))), "array<struct<query:string,type:string>>")
    return chunks.select("chunk_id", F.explode(j).alias("q")).select("chunk_id", "q.query", F.coalesce("q.type", F.lit("unknown")).alias("type")).where("trim(query) <> ''")


def valid_conversations(rows: DataFrame, least_turns: int = 3) -> DataFrame:
    """Conversations (id, turns: array of role and content) of enough turns whose roles are known and alternate from the user on."""
    t = F.col("turns")
    ok = F.forall(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return rows.where((F.size(t) >= least_turns) & ok & F.forall(t, lambda x: F.trim(x["content"]) != ""))


def accepted(answers: DataFrame, least: float = 0.7) -> DataFrame:
    """A judge's rows with overall (the mean of four scores) and passed; scores that don't parse count as 0."""
    s = repaired_json(F.col("answer"), "struct<relevance:double,accuracy:double,naturalness:double,diversity:double>")
    each = [F.coalesce(s[n], F.lit(0.0)) for n in ("relevance", "accuracy", "naturalness", "diversity")]
    return answers.withColumn("overall", F.round(sum(each[1:], each[0]) / 4, 6)).withColumn("passed", F.col("overall") >= least)


def _cover(a: Column, b: Column) -> Column:
    return metrics.answer_coverage(words(F.lower(a)), F.array(words(F.lower(b))))


#: Judges of an answer from (question, answer, contexts as one text, truth); lexical, to be replaced by a model's.
JUDGES: dict[str, Scorer] = {
    "faithfulness": lambda q, a, c, t: _cover(a, c), "answer_relevancy": lambda q, a, c, t: _cover(q, a), "context_precision": lambda q, a, c, t: _cover(t, c), "context_recall": lambda q, a, c, t: _cover(t, c),
}


def judge(rows: DataFrame, judges: dict[str, Scorer] | None = None) -> DataFrame:
    """rows (question, answer, contexts, truth) with a column per judge and their mean."""
    js = judges or JUDGES
    cols = [F.col(c) for c in ("question", "answer", "contexts", "truth")]
    out = rows.withColumns({n: fn(*cols) for n, fn in js.items()})
    return out.withColumn("mean", sum((F.col(n) for n in js), F.lit(0.0)) / len(js))


def dataset_from_pairs(chunks: DataFrame, negatives: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) from question chunks (chunk_id, question): the own chunk is relevant, others in hash order are negatives of rel 0.

    Every question has ``negatives`` of them, or all others where there are fewer.
    They are its successors on a ring in hash order, which is cut into 256 shelves, so
    that no query meets all chunks: behind a shelf's last question come the first ones
    of the shelves that follow, a table of bounded size.
    """
    q = chunks.where("question is not null and trim(question) <> ''").select(F.col("chunk_id").cast("string").alias("doc_id"), "question")
    ring = q.withColumn("h", F.sha2(F.concat(F.col("doc_id"), F.lit(f"#{seed}")), 256)).withColumn("shelf", F.substring("h", 1, 2))
    w = Window.partitionBy("shelf").orderBy("h")
    placed = ring.withColumn("at", F.row_number().over(w)).withColumn("next", F.array_compact(F.array(*[F.lead("doc_id", k + 1).over(w) for k in range(negatives)])))
    heads = placed.where(F.col("at") <= negatives + 1).agg(F.array_sort(F.collect_list(F.struct("shelf", "at", "doc_id"))).alias("heads"))
    after = F.concat(F.filter("heads", lambda x: x["shelf"] > F.col("shelf")), F.filter("heads", lambda x: x["shelf"] <= F.col("shelf")))
    more = F.transform(F.slice(after, 1, 2 * negatives + 1), lambda x: x["doc_id"])
    full = F.when(F.size("next") < negatives, F.array_remove(F.array_distinct(F.concat("next", more)), F.col("doc_id"))).otherwise(F.col("next"))
    ring = placed.crossJoin(F.broadcast(heads)).withColumn("after", F.slice(full, 1, negatives))
    own, others = F.struct(F.col("doc_id").alias("d"), F.lit(1).alias("r")), F.transform("after", lambda d: F.struct(d.alias("d"), F.lit(0).alias("r")))
    rel = ring.select(F.col("doc_id").alias("query_id"), F.explode(F.concat(F.array(own), others)).alias("x"))
    return q.select(F.col("doc_id").alias("query_id"), F.col("question").alias("text")), rel.select("query_id", F.col("x.d").alias("doc_id"), F.col("x.r").alias("rel"))
