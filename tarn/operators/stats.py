"""Statistics over jobs, chunks, texts and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import lexicon as L
from tarn.operators.filters import no_text, pending
from tarn.operators.quantiles import quantiles


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(F.bround(F.try_divide(part * 100, whole), digits), F.lit(0.0))


def knowledge(jobs: DataFrame, chunks: DataFrame, model: str, provider: str) -> DataFrame:
    """One row: jobs, active, expired, with text, searchable jobs and coverage."""
    searchable = chunks.where(~pending(model, provider)).join(jobs.where("is_active"), "job_id", "left_semi").agg(F.count_distinct("job_id").alias("searchable"))
    counts = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("expired"), F.count_if(~no_text("description")).alias("with_text"))
    return counts.join(searchable).withColumn("coverage", percent(F.col("searchable"), F.col("active")))


def by_source(jobs: DataFrame, column: str = "source") -> DataFrame:
    return jobs.groupBy(column).agg(F.count(F.lit(1)).alias("jobs"))


def index_state(chunks: DataFrame, model: str, provider: str, now: Column, most: int = 3) -> DataFrame:
    """One row: total, indexed, pending, failed, exhausted, and the oldest pending chunk's age in hours."""
    open_ = pending(model, provider)
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(open_, F.col("created_at"))))) / 3600)
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(~open_).alias("indexed"), F.count_if(open_).alias("pending"), F.count_if(open_ & (F.col("embedding_attempts") > 0)).alias("failed"), F.count_if(open_ & (F.col("embedding_attempts") >= most)).alias("exhausted"), age.alias("oldest_hours"))


def backlog_alert(state: DataFrame) -> DataFrame:
    return state.withColumn("alert", F.coalesce((F.col("failed") > 0) | ((F.col("pending") > 100) & (F.col("oldest_hours") >= 24)) | (F.col("oldest_hours") >= 72), F.lit(False)))


def corpus_version(rows: DataFrame, *columns: str) -> DataFrame:
    """n, digest: a fingerprint of a table that does not depend on the order of its rows.

    XOR and sum of row hashes are taken within tasks first; nothing is collected.
    """
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 30))), F.lit(0)).alias("s")).select("n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("digest"))


def skill_counts(texts: DataFrame, text: str = "text", key: str = "job_id", lexicon: tuple = L.SKILLS, limit: int = 20, with_ids: bool = False) -> DataFrame:
    """skill, jobs, percentage: how many texts show each skill; each counts once.

    The lexicon becomes one count for each skill in a single pass, so no pairs of text and skill are shuffled.
    with_ids adds the sorted keys, for small sets such as the jobs behind an answer.
    """
    hit = {name: F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)) for name, p in lexicon}
    aggs = [F.struct(F.lit(n).alias("skill"), F.count_if(h).alias("jobs"), *([F.array_sort(F.collect_list(F.when(h, F.col(key)))).alias("job_ids")] if with_ids else [])) for n, h in hit.items()]
    rows = texts.agg(F.count(F.lit(1)).alias("total"), F.array(*aggs).alias("a")).select("total", F.inline("a")).where("jobs > 0")
    rows = rows.withColumn("percentage", percent(F.col("jobs"), F.col("total")))
    return rows.orderBy(F.desc("jobs"), "skill").limit(limit)


def skill_flags(text: Column, lexicon: tuple = L.SKILLS) -> Column:
    """array<boolean>: which skills of the lexicon a text shows, in its order."""
    return F.array(*[F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)) for _, p in lexicon])


def skill_counts_by(rows: DataFrame, keys: list[str], lexicon: tuple = L.SKILLS, flags: str = "flags") -> DataFrame:
    """keys, skill, jobs, total, percentage: how many rows of each group show each skill that any of them shows.

    One row for each group and task is shuffled, with a count for each skill.
    """
    counts = [F.struct(F.lit(n).alias("skill"), F.count_if(F.get(flags, F.lit(i))).alias("jobs")) for i, (n, _) in enumerate(lexicon)]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.array(*counts).alias("a")).select(*keys, "total", F.inline("a")).where("jobs > 0")
    return found.withColumn("percentage", percent(F.col("jobs"), F.col("total")))


def job_texts(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, text: the chunks of the chosen jobs in order, joined."""
    rows = chunks.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return rows.groupBy("job_id").agg(F.array_join(ordered, "\n").alias("text"))


def requests(log: DataFrame, digits: int = 2, ok: str = "ok") -> DataFrame:
    """One row over a request log (status, total_ms, cache_hit, refused, prompt_tokens, completion_tokens, pipeline_version).

    Columns that a log may have besides: no_result, retrieval_ms, llm_ms, estimated_cost_usd. A request with tokens or time
    of the model is a call; the model's average is over calls, that of retrieval over all requests; the
    cost is null where no request has a price. Percentiles are exact and distributed.
    """
    rate = lambda c: percent(F.count_if(c), F.count(F.lit(1)), 2)
    has = lambda c, kind: F.col(c).cast(kind) if c in log.columns else F.lit(None).cast(kind)
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    llm = F.coalesce(has("llm_ms", "double"), F.lit(0.0))
    called = (tokens > 0) | (llm > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = lambda c: F.coalesce(F.bround(F.avg(c), digits), F.lit(0.0))
    price = has("estimated_cost_usd", "double")
    row = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == ok).alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        rate(F.col("status") == "error").alias("error_rate"),
        F.count_if("cache_hit").alias("cache_hits"),
        rate(F.col("cache_hit")).alias("cache_hit_rate"),
        F.count_if("refused").alias("refusals"),
        rate(F.col("refused")).alias("refusal_rate"),
        F.count_if(has("no_result", "boolean")).alias("no_results"),
        mean(F.coalesce(has("retrieval_ms", "double"), F.lit(0.0))).alias("retrieval_average"),
        F.count_if(called).alias("calls"),
        mean(F.when(called, llm)).alias("llm_average"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total(tokens).alias("total_tokens"),
        F.round(F.sum(price), 8).alias("cost_usd"),
        (F.count(price) > 0).alias("cost_configured"),
        F.array_sort(F.collect_set("pipeline_version")).alias("pipelines"),
    )
    return row.join(quantiles(log, [], "total_ms", {"p50": 0.5, "p95": 0.95})).withColumns({p: F.coalesce(F.bround(p, digits), F.lit(0.0)) for p in ("p50", "p95")})


def cost(prompt: Column, completion: Column, prompt_price: float | None, completion_price: float | None) -> Column:
    """Price of a request by million tokens; null without both prices."""
    if prompt_price is None or completion_price is None:
        return F.lit(None).cast("double")
    return F.round((prompt * prompt_price + completion * completion_price) / 1e6, 8)
