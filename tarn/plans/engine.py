"""One object with a method for each thing the engine can do with a collection of jobs."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import lexicon as L
from tarn.functions import scalar as S
from tarn.operators import chunking, ingest, retrieval, state, stats
from tarn.operators.filters import Filters, any_has, matches, no_text
from tarn.operators.index import Index
from tarn.operators.vectors import VectorIndex
from tarn.plans import answer
from tarn.session import keep

JOBS = "job_id string, fingerprint string, source string, source_job_id string, title string, normalized_title string, company string, location string, job_type string, currency string, interval string, job_url_direct string, min_amount double, max_amount double, is_remote boolean, description string, job_url string, date_posted date, content_hash string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"
SNAPSHOTS = "job_id string, content_hash string, description string, created_at timestamp"
CACHE = "cache_key string, kind string, corpus_version string, payload string, created_at timestamp, expires_at timestamp"
LOG = "created_at timestamp, query string, status string, intent string, error_type string, total_ms double, retrieval_ms double, llm_ms double, cache_hit boolean, retrieval_cache_hit boolean, refused boolean, no_result boolean, source_count int, prompt_tokens long, completion_tokens long, pipeline_version string"
#: Minutes that cached jobs and a cached answer hold, and the version of the answering pipeline.
CACHE_MINUTES, PIPELINE = {"ranked": 15, "answer": 60}, "v1"
CHUNKS = "job_id string, chunk_index int, section_type string, content string, content_hash string, token_count int, embedding array<float>, embedding_model string, embedding_provider string, embedding_attempts int, embedding_failed_at timestamp, embedding_error string, created_at timestamp"


TABLES = ("jobs", "snapshots", "chunks", "cache", "log")


class Engine:
    """Tables of jobs, snapshots and chunks, and the keyword index; each step writes their next version to the shared folder.

    The index gets a segment with the jobs that a step changes and is read with the words of a question as filters. Ranked jobs and answers are cached by question, filters, models and
    corpus version, and each question leaves a row in the request log, with its hash instead of its text.

    save() and load() keep a version under a path of one's own.
    """

    def __init__(self, spark: SparkSession, embed: Callable[[list[str]], list[list[float]]] | None = None, model: str = "hash-64", provider: str = "local"):
        self.spark, self.model, self.provider = spark, model, provider
        hash_embedding = retrieval.hash_embedding
        self.embed = embed or (lambda texts: [hash_embedding(t) for t in texts])
        self.jobs, self.snapshots, self.chunks = (spark.createDataFrame([], s) for s in (JOBS, SNAPSHOTS, CHUNKS))
        self.cache, self.keyword = spark.createDataFrame([], CACHE), Index(spark)
        self.vectors: VectorIndex | None = None
        self.log = state.private(spark.createDataFrame([], LOG))

    def save(self, path: str) -> None:
        """Writes the tables to a new folder; readers switch to it when it is complete."""
        for name in TABLES:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")
        self.keyword.save(f"{path}/keyword")

    def load(self, path: str) -> Engine:
        for name in TABLES:
            setattr(self, name, self.spark.read.parquet(f"{path}/{name}"))
        self.keyword = Index.load(self.spark, f"{path}/keyword")
        return self

    def ingest(self, raw: DataFrame, now: str) -> DataFrame:
        """Upserts raw records, cuts the texts of changed jobs anew; returns the counters."""
        at = F.lit(now).cast("timestamp")
        batch = keep(ingest.canonical(raw))
        jobs, snapshots, changes = ingest.upsert(self.jobs, self.snapshots, batch, at)
        changes = keep(changes)
        self.jobs, self.snapshots = keep(jobs), keep(snapshots)
        self.rechunk(keep(ingest.to_sync(changes)), at)
        return ingest.counters(changes)

    def rechunk(self, touched: DataFrame, at) -> None:
        new = chunking.chunks(self.jobs.join(touched, "job_id", "left_semi")).withColumns({"embedding_attempts": F.lit(0), "created_at": at})
        full = new.select(*[F.col(c.name).cast(c.dataType) if c.name in new.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in self.chunks.schema])
        self.chunks = keep(chunking.resync(self.chunks, keep(full), touched))
        self.reindex(touched)

    def _fields(self, jobs: DataFrame) -> DataFrame:
        """Chunks of jobs with the fields of the keyword index."""
        return self.chunks.join(jobs.select("job_id", "title", "company", "location"), "job_id").withColumn("chunk_id", F.concat_ws(":", "job_id", "content_hash"))

    def reindex(self, touched: DataFrame | None = None) -> None:
        """The keyword index with a segment of the touched jobs; a new one of all jobs without a list."""
        if touched is None:
            self.keyword = Index(self.spark)
        jobs = self.jobs if touched is None else self.jobs.join(touched, "job_id", "left_semi")
        self.keyword.repair(self._fields(jobs), jobs.select("job_id") if touched is None else touched)

    def expire(self, as_of: str, days: int = 60) -> None:
        jobs, chunks = ingest.expire(self.jobs, self.chunks, F.lit(as_of).cast("date"), days)
        self.jobs, self.chunks = keep(jobs), keep(chunks)
        self.reindex(self.jobs.where("not is_active").select("job_id"))

    def index(self, now: str, limit: int | None = None, manual: bool = False) -> DataFrame:
        """Embeds pending chunks in order, at most limit; manual takes failed ones again. Returns the index state with its alert."""
        at = F.lit(now).cast("timestamp")
        self.chunks = keep(state.embed_pending(self.chunks, self.embed, self.model, self.provider, at, manual=manual, limit=limit))
        # a chunk is named by its content, so a vector of the index stays right until a model replaces it
        done = self.chunks.where(~stats.pending(self.model, self.provider))
        self.vectors = VectorIndex.build(done.select(F.concat_ws(":", "job_id", "content_hash").alias("chunk_id"), "embedding"))
        return stats.backlog_alert(stats.index_state(self.chunks, self.model, self.provider, at))

    def backfill(self, fetch: Callable[[str], str | None], now: str, source: str = "linkedin", limit: int = 100, tries: int = 3) -> DataFrame:
        """Descriptions of at most limit jobs of a board that lack one, by its number of the job, then an upsert; the counters.

        fetch(number) runs on the driver, which is the only one with a connection to the board; it is tried
        tries times, and a job whose text it does not give stays as it is.
        """
        rows = self.jobs.where((F.col("source") == source) & F.col("is_active") & no_text("description"))
        rows = rows.withColumn("number", S.numeric_id(F.col("source_job_id"), F.col("job_url"))).where("number is not null").orderBy("job_id").limit(limit)
        got = []
        for r in rows.select("job_id", "number").collect():
            for _ in range(tries):
                try:
                    text = fetch(r["number"])
                    if text and text.strip():
                        got.append((r["job_id"], text))
                    break
                except Exception:  # a failing board is asked again
                    continue
        texts = self.spark.createDataFrame(got, "job_id string, fetched string")
        full = self.jobs.join(texts, "job_id").withColumn("description", F.col("fetched"))
        return self.ingest(full.select(F.col("source").alias("site"), F.col("source_job_id").alias("id"), *[c for c in full.columns if c in ingest.CONTENT or c in ("job_url", "job_url_direct")]), now)

    def stats(self) -> DataFrame:
        return stats.knowledge(self.jobs, self.chunks, self.model, self.provider)

    def search_jobs(self, text: str = "", source: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
        rows = self.jobs.where(any_has(text, "title", "company", "location")) if text else self.jobs
        rows = rows.where(F.col("source") == source) if source else rows
        return rows.orderBy(F.desc_nulls_last("date_posted"), F.desc("last_seen_at"), "job_id").offset(offset).limit(limit)

    def retrieve(self, query: str, filters: Filters = Filters(), mode: str = "hybrid", top: int = retrieval.TOP, candidates: int = retrieval.CANDIDATES, per_job: int = retrieval.PER_JOB, rrf_k: int = retrieval.RRF_K) -> DataFrame:
        """The best chunks: chunk_id, job fields, scores, ranks, rrf, place."""
        if mode not in ("hybrid", "vector", "keyword"):
            raise ValueError(f"unknown mode {mode!r}")
        if min(top, candidates, per_job, rrf_k) < 1:
            raise ValueError("top, candidates, per_job and rrf_k must be positive")
        info = self.jobs.where(matches(filters)).select("job_id", "title", "company", "location", "source", "date_posted", "job_url")
        rows = self.chunks.join(info, "job_id").withColumn("chunk_id", F.concat_ws(":", "job_id", "content_hash"))
        named = rows.select("chunk_id")
        none = self.spark.createDataFrame([], "query_id int, chunk_id string, score double, rank int")
        vector = keyword = none
        if mode != "keyword":
            vectors = rows.where(~stats.pending(self.model, self.provider))
            queries = self.spark.createDataFrame([(1, self.embed([query])[0])], "query_id int, vector array<float>")
            vector = self.vectors.search(queries, candidates, vectors) if self.vectors else retrieval.nearest(vectors, queries, k=candidates)
        if mode != "vector":
            terms = retrieval.query_terms(query)
            overlap = rows.select(F.lit(1).alias("query_id"), "chunk_id", retrieval.S.overlap(F.concat_ws("\n", "title", "company", "content"), terms).alias("score"))
            best = self.keyword.search(terms).join(named, "chunk_id", "left_semi")
            keyword = retrieval.supplement(best, overlap, k=candidates)
        fused = retrieval.fuse(vector, keyword, rrf_k=rrf_k).join(rows.drop("embedding"), "chunk_id")
        return retrieval.capped(fused, per_job=per_job, top=top)

    def ranked(self, query: str, filters: Filters = Filters(), top: int = retrieval.TOP, candidates: int = retrieval.CANDIDATES, mode: str = "hybrid", context: int = 3) -> list[dict]:
        """The best jobs, at most 12, with their best chunks."""
        scope = retrieval.scope_query(query, filters.title)
        pool = max(4 * candidates, 100)
        hits = self.retrieve(scope, filters, mode, pool, pool, 4).withColumn("score", F.col("rrf")).persist()
        try:
            best = [r.asDict() for r in retrieval.ranked_jobs(hits, "phd" in scope.casefold(), candidates, min(top, 12)).orderBy("place").collect()]
            ids = [j["job_id"] for j in best]
            of: dict[str, list[str]] = {}
            for r in hits.where(F.col("job_id").isin(ids)).orderBy(F.desc("score"), "chunk_id").select("job_id", "content").collect() if ids else []:
                of.setdefault(r["job_id"], []).append(r["content"])
            return [j | {"chunks": of[j["job_id"]][:context]} for j in best]
        finally:
            hits.unpersist()

    def cached(self, kind: str, parts: list, now: str, make: Callable[[], list]) -> tuple[list, bool]:
        """(what make() returned for these parts and this version of the corpus, whether the cache had it)."""
        at = F.lit(now).cast("timestamp")
        version = self.version().first()["digest"]
        key = hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()
        found = state.cache_get(self.cache, key, kind, version, at).first()
        if found:
            return json.loads(found["payload"]), True
        value = json.loads(json.dumps(make(), default=str))
        new = self.spark.createDataFrame([(key, kind, version, json.dumps(value))], "cache_key string, kind string, corpus_version string, payload string")
        new = new.withColumns({"created_at": at, "expires_at": F.timestamp_add("MINUTE", F.lit(CACHE_MINUTES[kind]), at)})
        self.cache = keep(state.last_write(state.evict(self.cache, at), new, "cache_key", "kind"))
        return value, False

    def ask(self, question: str, filters: Filters = Filters(), generate=None, now: str | None = None) -> answer.Answer:
        """Routes a question, ranks jobs, counts skills where it asks for numbers, and answers with citations.

        With now, the time of the question, answers and ranked jobs are cached and the question is logged; refusals of
        questions outside the collection are not cached. The answer's telemetry has the times in milliseconds, which caches were
        hit, the number of sources and the tokens, as its row in the log has.
        """
        began, error = time.perf_counter(), None
        told = {"cache_hit": False, "retrieval_cache_hit": False, "retrieval_ms": 0.0, "llm_ms": 0.0}
        out = answer.Answer("", answer.intent(question))
        try:
            if now is None or out.intent == "refusal":
                out = self._answer(question, filters, generate, now, told)
            else:
                parts = [question, vars(filters), self.model, getattr(generate, "__qualname__", None), PIPELINE]
                kept, told["cache_hit"] = self.cached("answer", parts, now, lambda: vars(self._answer(question, filters, generate, now, told)))
                out = answer.Answer(**kept)
        except Exception as e:
            error = type(e).__name__
            raise
        finally:
            refused, n = out.intent == "refusal", len(out.sources)
            made = generate is not None and told["llm_ms"] > 0
            told |= {"total_ms": 1000 * (time.perf_counter() - began), "source_count": n, "prompt_tokens": len(question) // 4 if made else 0, "completion_tokens": len(out.text) // 4 if made else 0}
            out.telemetry = told
            if now is not None:
                row = {"query": question, "status": "error" if error else "ok", "intent": out.intent, "error_type": error, "refused": refused, "no_result": not refused and n == 0, "pipeline_version": PIPELINE} | told
                new = self.spark.createDataFrame([row], LOG.split(", ", 1)[1]).withColumn("created_at", F.lit(now).cast("timestamp"))
                self.log = keep(self.log.unionByName(state.private(new)))
        return out

    def _answer(self, question: str, filters: Filters, generate, now: str | None, told: dict) -> answer.Answer:
        kind = answer.intent(question)
        if kind == "refusal":
            return answer.Answer(answer.OUT_OF_SCOPE, kind)
        began = time.perf_counter()
        rank = lambda: self.ranked(question, filters)
        jobs, told["retrieval_cache_hit"] = (rank(), False) if now is None else self.cached("ranked", [question, vars(filters), self.model], now, rank)
        statistics = None
        if kind == "global_aggregate":
            texts = self.jobs.where(matches(filters)).select("job_id", F.concat_ws("\n", "title", "description").alias("text"))
            statistics = [r.asDict() for r in stats.skill_counts(texts).collect()]
        elif kind == "aggregate" and jobs:
            ids = self.spark.createDataFrame([(j["job_id"],) for j in jobs], "job_id string")
            statistics = [r.asDict() for r in stats.skill_counts(stats.job_texts(self.chunks, ids), with_ids=True).collect()]
        told["retrieval_ms"] = 1000 * (time.perf_counter() - began)
        began = time.perf_counter()
        out = answer.compose(question, jobs, statistics, generate)
        told["llm_ms"] = 1000 * (time.perf_counter() - began) if generate else 0.0
        return out

    def operations(self, now: str, days: int = 30) -> DataFrame:
        """One row over the request log of the last days."""
        return stats.requests(state.prune(self.log, F.lit(now).cast("timestamp"), days))

    def skills(self, filters: Filters = Filters(), lexicon: tuple = L.SKILLS) -> DataFrame:
        texts = self.jobs.where(matches(filters)).select("job_id", F.concat_ws("\n", "title", "description").alias("text"))
        return stats.skill_counts(texts, lexicon=lexicon)

    def version(self) -> DataFrame:
        return stats.corpus_version(self.chunks, "job_id", "content_hash", "embedding_model")

    def export(self, path: str) -> None:
        """The jobs as CSV with a header and their pay as text; UTF-8."""
        rows = self.jobs.withColumn("salary", S.salary_display(F.col("min_amount"), F.col("max_amount"), F.col("currency"), F.col("interval")))
        rows.write.csv(path, header=True, encoding="UTF-8", escape='"')
