"""Retrieval metrics and their evaluation, over rankings (query_id, item, place) and grades (query_id, item, grade)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import keep, small_batches

#: Terms whose occurrences one pass over the texts counts; they go to every task.
TERM_BLOCK = 50_000
# Fixed value: questions that a tuning run needs at least.
LEAST_QUESTIONS = 5


def first_places(ranking: DataFrame, item: str = "item") -> DataFrame:
    """A ranking without repeats: an item keeps its first place, places are counted anew."""
    once = ranking.groupBy("query_id", item).agg(F.min("place").alias("place"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place", item)))


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def _ideal(grades: DataFrame, k: int, gain) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item"))
    best = grades.where("grade > 0").withColumn("p", place).where(F.col("p") <= k)
    return best.groupBy("query_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("p") + 1)).alias("ideal"))


def metrics(ranking: DataFrame, grades: DataFrame, k: int = 8, runs: DataFrame | None = None) -> DataFrame:
    """query_id, recall, rr, ndcg (binary), graded_ndcg, condensed_ndcg at k, for each query that has grades.

    With runs, a short table of one column, the ranking has that column too and each run gets a row for each query; the grades
    are read and summed up once for all runs.

    Condensed nDCG ranks only items known to be positive, so that unjudged ones do not count as bad.
    A query without positives has 0 everywhere.
    """
    grades = grades.groupBy("query_id", "item").agg(F.max("grade").alias("grade"))
    positive = grades.where("grade > 0")
    asked = [*(runs.columns if runs is not None else []), "query_id"]
    hits = ranking.join(grades, ["query_id", "item"])
    top = hits.where((F.col("place") <= k) & (F.col("grade") > 0))
    found = top.groupBy(*asked).agg(
        F.count(F.lit(1)).alias("found"),
        F.min("place").alias("first"),
        F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"),
        F.sum(_gain(F.col("grade")) / F.log2(F.col("place") + 1)).alias("graded"),
    )
    known = ranking.join(positive, ["query_id", "item"]).withColumn("p", F.row_number().over(Window.partitionBy(*asked).orderBy("place", "item"))).where(F.col("p") <= k)
    condensed = known.groupBy(*asked).agg(F.sum(_gain(F.col("grade")) / F.log2(F.col("p") + 1)).alias("condensed"))
    totals = positive.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    rows = grades.select("query_id").distinct()
    for part in (totals, _ideal(grades, k, lambda g: F.lit(1.0)).withColumnRenamed("ideal", "ideal1"), _ideal(grades, k, _gain)):
        rows = rows.join(part, "query_id", "left")
    rows = rows.crossJoin(F.broadcast(runs)) if runs is not None else rows
    for part in (found, condensed):
        rows = rows.join(part, asked, "left")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(*asked, share(F.col("found"), F.col("relevant")).alias("recall"), share(F.lit(1.0), F.col("first")).alias("rr"), share(F.col("dcg"), F.col("ideal1")).alias("ndcg"), share(F.col("graded"), F.col("ideal")).alias("graded_ndcg"), share(F.col("condensed"), F.col("ideal")).alias("condensed_ndcg"))


def silver(texts: DataFrame, questions: DataFrame, key: str = "item", limit: int = 10) -> DataFrame:
    """query_id, item, score, place: the texts with most occurrences of a question's terms (query_id, term).

    All terms are found in one pass over a text by an automaton; occurrences of one term do not overlap. Beyond TERM_BLOCK
    different terms there is one pass for each block of about as many.
    """
    low = texts.select(F.col(key), F.lower("text").alias("t")).where("t is not null")
    terms = questions.select("query_id", F.lower("term").alias("term")).where("term <> ''")
    names = terms.select("term").distinct()
    blocks = max(1, -(-names.count() // TERM_BLOCK))
    kind = low.schema[key].dataType.simpleString()
    found = None
    for i in range(blocks):
        some = [r["term"] for r in names.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            terms, machine = shared.value, ahocorasick.Automaton()
            for n, t in enumerate(terms):
                machine.add_word(t, n)
            if not terms:
                return
            machine.make_automaton()
            for batch in batches:
                origin, term, counts = [], [], []
                for row, value in enumerate(batch.column(1)):
                    text = value.as_py()  # one text at a time
                    free: dict[int, int] = {}
                    hits: dict[int, int] = {}
                    for end, n in machine.iter(text):
                        if end - len(terms[n]) + 1 >= free.get(n, 0):
                            free[n] = end + 1
                            hits[n] = hits.get(n, 0) + 1
                    origin += [row] * len(hits)
                    term += map(terms.__getitem__, hits)
                    counts += hits.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin, pa.int64())), pa.array(term, pa.string()), pa.array(counts, pa.int64())], [key, "term", "n"])

        part = small_batches(low).mapInArrow(run, f"{key} {kind}, term string, n long")
        found = part if found is None else found.unionByName(part)
    scored = found.join(terms, "term").groupBy("query_id", key).agg(F.sum("n").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def configs() -> list[dict]:
    """The tuning grid (fixed values): 8 points of one mode, 32 hybrid ones."""
    single = [dict(mode=m, candidate_k=c, per_job=p, rrf_k=60, vw=1.0, kw=1.0) for m in ("keyword", "vector") for c in (50, 100) for p in (1, 2)]
    weights = ((1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (1.0, 1.5))
    return single + [dict(mode="hybrid", candidate_k=c, per_job=p, rrf_k=r, vw=v, kw=k) for c in (50, 100) for p in (1, 2) for r in (20, 60) for v, k in weights]


def config_name(g: dict) -> str:
    return f"{g['mode']}-c{g['candidate_k']}-m{g['per_job']}-r{g['rrf_k']}-vw{g['vw']:g}-kw{g['kw']:g}"


def tune(vector: DataFrame, keyword: DataFrame, grades: DataFrame, grid: list[dict] | None = None, k: int = 8) -> DataFrame:
    """config, recall, rr, graded_ndcg of every grid point, best first.

    Both lists (query_id, chunk_id, job_id, score, rank) are scored once; the grid, a table of a few rows, is
    joined to them, and the fusion, the cap and the metrics run for all points in one plan. Of a list only the ranks that the
    grid asks for go on, and grades are not repeated for its points.
    """
    grid = configs() if grid is None else grid
    deepest = max((g["candidate_k"] for g in grid), default=0)
    spark = vector.sparkSession
    points = F.broadcast(spark.createDataFrame([(config_name(g), *g.values()) for g in grid], "config string, mode string, candidate_k int, per_job int, rrf_k int, vw double, kw double"))

    def side(df: DataFrame, mode: str, weight: str) -> DataFrame:
        rows = df.where(F.col("rank") <= deepest).join(points, (F.col("rank") <= F.col("candidate_k")) & F.col("mode").isin(mode, "hybrid"))
        return rows.select("config", "per_job", "query_id", "chunk_id", "job_id", (F.col(weight) / (F.col("rrf_k") + F.col("rank"))).alias("part"), F.lit(mode).alias("side"), "rank")

    both = side(vector, "vector", "vw").unionByName(side(keyword, "keyword", "kw"))
    fused = both.groupBy("config", "per_job", "query_id", "job_id", "chunk_id").agg(F.sum("part").alias("rrf"), F.min(F.when(F.col("side") == "vector", F.col("rank"))).alias("vr"), F.min(F.when(F.col("side") == "keyword", F.col("rank"))).alias("kr"))
    order = [F.desc("rrf"), F.asc_nulls_last("vr"), F.asc_nulls_last("kr"), "chunk_id"]
    kept = fused.withColumn("o", F.row_number().over(Window.partitionBy("config", "query_id", "job_id").orderBy(*order))).where("o <= per_job")
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("config", "query_id").orderBy(*order)))
    once = placed.groupBy("config", "query_id", F.col("job_id").alias("item")).agg(F.min("place").alias("place"))
    ranking = once.withColumn("place", F.row_number().over(Window.partitionBy("config", "query_id").orderBy("place", "item")))
    rows = metrics(ranking, grades, k, points.select("config"))
    # ten digits first, so that the order of a sum decides no half
    mean = lambda c: F.bround(F.round(F.avg(c), 10), 4).alias(c)
    return rows.groupBy("config").agg(mean("recall"), mean("rr"), mean("graded_ndcg")).orderBy(F.desc("graded_ndcg"), F.desc("recall"), F.desc("rr"), "config")


def tune_split(vector: DataFrame, keyword: DataFrame, grades: DataFrame, splits: DataFrame, split: str = "development", least: int = LEAST_QUESTIONS, k: int = 8) -> DataFrame:
    """tune() over the questions (split, query_id) of one split that have a positive grade; no row if they are fewer than least.

    Grades of other splits have no part in it, so the holdout stays unseen.
    """
    asked = splits.where(F.col("split") == split).select("query_id").distinct().join(grades.where("grade > 0"), "query_id", "left_semi")
    best = tune(vector, keyword, grades.join(asked, "query_id", "left_semi"), k=k)
    return best if asked.count() >= least else best.limit(0)


def macro_f1(rows: DataFrame, by: str, labels: tuple = (0, 1, 2)) -> DataFrame:
    """by, samples, accuracy, macro_f1, disagreements of (actual, predicted) rows in one pass."""
    def f1(v):
        tp = F.count_if((F.col("actual") == v) & (F.col("predicted") == v))
        wrong = F.count_if((F.col("actual") == v) != (F.col("predicted") == v))
        return F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0))

    total = sum((f1(v) for v in labels[1:]), f1(labels[0])) / len(labels)
    same = F.count_if(F.col("actual") == F.col("predicted"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.bround(same / F.count(F.lit(1)), 4).alias("accuracy"), F.bround(total, 4).alias("macro_f1"), (F.count(F.lit(1)) - same).alias("disagreements"))


def calibrate(samples: DataFrame, points: int = 13) -> DataFrame:
    """low, high, macro_f1: the pair of thresholds on (score, actual) with the best macro-F1.

    Candidates are `points` order statistics of the distinct scores; every pair is one group of a single plan.
    The scores are sorted by ranges; the sizes of the ranges, one number for each, tell in which of them and at
    which place a rank stands.
    """
    place = F.monotonically_increasing_id()
    scores = keep(samples.where("score is not null").select("score").distinct().orderBy("score").select("score", place.alias("id")))
    part = F.shiftright("id", 33)
    sizes = scores.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    n = sum(r["n"] for r in sizes)
    if n < 2:
        return samples.sparkSession.createDataFrame([], "low double, high double, macro_f1 double")
    at, before, ids = sorted({min(n - 1, int(i * (n - 1) / (points - 1))) for i in range(points)}), 0, []
    for r in sizes:
        ids += [(r["part"] << 33) + a - before for a in at if before <= a < before + r["n"]]
        before += r["n"]
    picked = sorted(r[0] for r in scores.where(F.col("id").isin(ids)).select("score").collect())
    pairs = F.broadcast(samples.sparkSession.createDataFrame([(float(a), float(b)) for a in picked for b in picked if a < b], "low double, high double"))
    grade = F.when(F.col("score") < F.col("low"), 0).when(F.col("score") < F.col("high"), 1).otherwise(2)
    rows = samples.join(pairs).select(F.struct("low", "high").alias("t"), "actual", grade.alias("predicted"))
    return macro_f1(rows, "t").select("t.low", "t.high", "macro_f1").orderBy(F.desc("macro_f1"), "low", "high").limit(1)


def gates(values: DataFrame, expected: dict[str, float]) -> DataFrame:
    """gate, actual, expected, passed for a one-row table of values."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("actual"), F.lit(float(e)).alias("expected")) for g, e in expected.items()])
    return values.select(F.inline(rows)).withColumn("passed", F.coalesce(F.col("actual") >= F.col("expected"), F.lit(False)))


def integrity(grades: DataFrame, items: DataFrame, questions: DataFrame) -> DataFrame:
    """issue, query_id, item: grades of unknown items or questions, and positives that are not active."""
    missing = grades.join(items, "item", "left_anti").select(F.lit("unknown item").alias("issue"), "query_id", "item")
    orphan = grades.join(questions, "query_id", "left_anti").select(F.lit("unknown question").alias("issue"), "query_id", "item")
    gone = grades.where("grade > 0").join(items.where("not is_active"), "item", "left_semi").select(F.lit("inactive positive").alias("issue"), "query_id", "item")
    return missing.unionByName(orphan).unionByName(gone)


