"""Questions to answers and files to chunks as one call each, with their options.

A pipeline is a table of chunks (id, text, metadata) and options; questions are a table, so a batch is the usual case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, guardrails, prompts, text
from ..sources import files, providers
from ..sources.tables import collection_stats, saved
from ..streaming import cache
from . import retrieval
from .chunking import chunk_id, chunked


@dataclass(frozen=True)
class Retrieval:
    strategy: str = "bm25"
    top_k: int = 5
    alpha: float = 0.7
    rrf_k: int = 60
    threshold: float = 0.0
    legal: bool = False


@dataclass(frozen=True)
class Chunking:
    method: str = "sentences"
    max_size: int = 1000
    min_size: int = 100


@dataclass(frozen=True)
class Generation:
    provider: str = "extractive"
    temperature: float = 0.2
    max_tokens: int = 800


@dataclass(frozen=True)
class Guardrails:
    check_input: bool = True
    check_output: bool = True
    correct: bool = False
    least: int = 3
    most: int = 2000
    least_quality: float = 0.6


@dataclass(frozen=True)
class Options:
    """Options of a pipeline; with_(retrieval={"top_k": 3}) gives changed ones. 0 is a value like others."""

    retrieval: Retrieval = field(default_factory=Retrieval)
    chunking: Chunking = field(default_factory=Chunking)
    generation: Generation = field(default_factory=Generation)
    guardrails: Guardrails = field(default_factory=Guardrails)
    cache_size: int = 1000

    def with_(self, cache_size: int | None = None, **parts: dict) -> Options:
        changed = {k: replace(getattr(self, k), **v) for k, v in parts.items()}
        return replace(self, **changed, **({} if cache_size is None else {"cache_size": cache_size}))

    def to_dict(self) -> dict:
        return asdict(self)


def auto_corrected(x: Column, least: int = 3, most: int = 2000) -> Column:
    """struct of is_valid, errors, warnings, sanitized: a question with personal data is checked again with their kinds in their place, and says so."""
    found = guardrails.has_pii(x)
    clean = F.when(found, guardrails.redactor("type")(x)).otherwise(x)
    v = guardrails.validate_input(clean, least, most)
    warnings = F.when(F.coalesce(found, F.lit(False)), F.array_append(v["warnings"], F.lit("redacted"))).otherwise(v["warnings"])
    return F.struct(v["is_valid"].alias("is_valid"), v["errors"].alias("errors"), warnings.alias("warnings"), v["sanitized"].alias("sanitized"))


def cache_slots(asked: DataFrame, size: int, query: str = "query", order: str = "n", ttl: int | None = None, at: str | None = None, shards: int = 1) -> DataFrame:
    """asked with hit: was the question's answer in a cache of the last `size` different questions, put in as they were first asked (first in, first out)?

    See streaming/cache.py; shards split the cache, so that they run side by side.
    """
    return cache.slots(asked, size, ttl, shards, query, order, at)


class Pipeline:
    """Answers questions from a table of chunks: id, text, and metadata (map) where filters are used."""

    def __init__(self, chunks: DataFrame, options: Options | None = None, answerer: Callable[[], providers.Answerer] | None = None, dense: Callable[[DataFrame, int, DataFrame | None], DataFrame] | None = None):
        """dense: a ranking (query_id, id, score, rank) of questions (query_id, text) down to k among some chunks (null: all), for the strategies dense and hybrid."""
        self.chunks, self.options, self.dense = chunks, options or Options(), dense
        self.answerer = answerer or providers.create(providers.ANSWERERS, self.options.generation.provider)
        self._index: retrieval.BM25Index | None = None
        self._cache: dict[str, tuple] = {}

    def index(self) -> retrieval.BM25Index:
        if self._index is None:
            self._index = retrieval.BM25Index.build(self.chunks, "id", "text", self.options.retrieval.legal)
        return self._index

    def retrieve(self, questions: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
        """Ranking of the questions (query_id, text) by the strategy, over the chunks whose metadata match."""
        o = self.options.retrieval
        index, among = self.index(), retrieval.matching(self.chunks, filters, document="text") if filters else None
        if o.strategy == "bm25":
            return index.search(questions, o.top_k, o.legal, among)
        if self.dense is None:
            raise ValueError(f"the strategy {o.strategy!r} needs a dense ranking")
        if o.strategy == "dense":
            return retrieval.above(self.dense(questions, o.top_k, among), o.threshold)
        k = retrieval.fetch_k(o.top_k)
        return retrieval.hybrid(self.dense(questions, k, among), index.search(questions, k, o.legal, among), o.top_k, alpha=o.alpha)

    def query(self, questions: DataFrame, filters: dict[str, str] | None = None, evaluate: bool = False) -> DataFrame:
        """questions: query_id, text. query_id, query, answer, error, stage, n_chunks, and with evaluate the lexical scores.

        A question that fails its check, or finds no chunk, has the reason as error and the stage that gave it, and is not
        answered; equal questions are answered once.
        """
        g = self.options.guardrails
        checked = auto_corrected(F.col("text"), g.least, g.most) if g.correct else guardrails.validate_input(F.col("text"), g.least, g.most)
        asked = saved(questions.select("query_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("v", checked))
        good = F.col("v.is_valid") if g.check_input else F.lit(True)
        said = F.coalesce(F.col("v.sanitized"), F.col("text")) if g.correct else F.col("text")
        once = saved(asked.where(good).select("query_id", said.alias("text")).groupBy("text").agg(F.min("query_id").alias("query_id")))
        found = self.retrieve(once, filters).join(self.chunks.select("id", F.col("text").alias("chunk")), "id")
        found = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
        rows = once.join(found, "query_id").withColumn("prompt", prompts.with_context(F.col("text"), F.col("chunks")))
        rows = providers.answer(rows, self.answerer).select("text", "chunks", "answer", F.col("error").alias("failed"))
        if g.check_output:
            v = guardrails.validate_output(F.col("answer"), F.col("text"), F.array_join("chunks", " "), g.least_quality)
            rows = rows.withColumn("output_errors", F.when(F.col("answer").isNotNull(), v["errors"]))
        out = asked.withColumn("said", F.when(good, said)).join(rows.withColumnRenamed("text", "said"), "said", "left")
        none = F.col("chunks").isNull()
        error = F.when(~good, F.array_join("v.errors", ", ")).when(none, "no_chunks_found").otherwise(F.col("failed"))
        stage = F.when(~good, "input_validation").when(none, "retrieval").when(F.col("failed").isNotNull(), "generation")
        columns = [F.col("query_id"), F.col("text").alias("query"), F.col("answer"), error.alias("error"), stage.alias("stage"), F.coalesce(F.size("chunks"), F.lit(0)).alias("n_chunks")]
        if g.check_output:
            columns.append(F.col("output_errors"))
        if evaluate:
            a, q, c = F.col("answer"), F.col("text"), F.col("chunks")
            context = F.array_join(c, " ")
            scores = {"faithfulness": answers.faithfulness(a, context), "relevance": answers.answer_relevance(a, q), "context": answers.context_relevance(c, q), "hallucination": answers.hallucination(a, context)}
            one = F.lit(1.0)
            scores["overall"] = answers.overall(one, one, scores["faithfulness"], scores["relevance"], scores["context"], scores["hallucination"])
            columns += [F.when(a.isNotNull(), s).alias(k) for k, s in scores.items()]
        return out.select(*columns)

    def ask(self, question: str, **how) -> dict:
        """One question; answers are kept for equal questions, first in first out."""
        hit = question in self._cache
        if not hit:
            spark = self.chunks.sparkSession
            row = self.query(spark.createDataFrame([(0, question)], "query_id long, text string"), **how).first()
            if self.options.cache_size > 0:
                if len(self._cache) >= self.options.cache_size:
                    del self._cache[next(iter(self._cache))]
                self._cache[question] = row.asDict()
            return row.asDict() | {"cache_hit": False}
        return self._cache[question] | {"cache_hit": True}

    def clear_cache(self) -> None:
        self._cache.clear()

    def stats(self) -> dict:
        """Collection, lexical index, cache and options."""
        index = self.index()
        n, avgdl = index.corpus.first()
        model = self.answerer()
        out = {"documents": n, "avg_tokens": avgdl, "terms": index.terms.count(), "cache_size": len(self._cache), "options": self.options.to_dict()}
        if "metadata" in self.chunks.columns:
            out["collection"] = collection_stats(self.chunks, document="text").first().asDict(recursive=True)
        return out | {"model": model.model_name, "provider": model.provider_name}


def create(chunks: DataFrame, **options) -> Pipeline:
    """A pipeline with options given by part: create(chunks, retrieval={"top_k": 3})."""
    return Pipeline(chunks, Options().with_(**options))


def ingest(spark: SparkSession, path: str, out: str, options: Options | None = None, metadata: dict[str, str] | None = None, reset: bool = False, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files of a folder to a table of chunks at out; returns path, chunks, error for each file.

    extract: rows of files.scan to path, text (null where a file can't be read); plain text by default. reset replaces the
    table, otherwise files that it has by path and content are left out and the others are appended.
    """
    o = (options or Options()).chunking
    found = files.scan(spark, path)
    if not reset:
        try:
            found = found.join(spark.read.parquet(out).select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")
        except Exception as e:  # noqa: BLE001 - no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    read = (extract or (lambda f: files.as_text(f)))(found)
    rows = saved(read.select("path", "sha256", F.when(F.length(text.strip(F.col("text"))) > 0, text.clean(F.col("text"))).alias("text")))
    chunks = chunked(rows.where("text is not null").withColumnRenamed("path", "doc_id"), method=o.method, max_size=o.max_size, min_size=o.min_size)
    extra = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)) if metadata else F.create_map().cast("map<string,string>")
    chunks = chunks.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), F.col("doc_id").alias("path"), "sha256", F.col("content").alias("text"), F.map_concat(F.create_map(F.lit("source_file"), F.col("doc_id"), F.lit("section_title"), F.coalesce("section", F.lit(""))), extra).alias("metadata"))
    chunks = saved(chunks)
    chunks.write.mode("overwrite" if reset else "append").parquet(out)
    n = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
    return rows.join(n, "path", "left").select("path", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("text").isNull(), F.lit("no text")).alias("error"))
