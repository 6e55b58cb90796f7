"""Toxicity by class-conditional Kneser-Ney models.

A word is a run of letters in lower case, with a start and an end sign; its likelihood is that
of its characters, each given the ORDER - 1 before it. At the highest order the toxic and the
ordinary class have counts of their own; what Kneser-Ney discounts of them goes to lower orders
whose continuation counts (distinct left neighbours) are pooled over both classes. So a rare
expression gets the same backoff from either model and speaks for neither; nor does a word that stands
in fewer than LEAST_TEXTS toxic texts, as labels are not free of error.

Most words of a toxic text are ordinary ones. So the toxic class draws a word from its own
model with probability SHARE and from the ordinary one otherwise, and a text's likelihood under
either class is the product over all its words. The two log-likelihoods, each divided by the number
of words, are compared: a logistic function of their difference is the score. It is fitted, with
equal weights of both classes, on texts that were outside the counts: the sample falls into FOLDS
parts, each scored by a model of the others; the final model has the counts of all.

The model is fitted on a bounded sample of labelled rows: at most about PER_CLASS rows of each
class, chosen by a hash of their id, and of these, in the order of that hash, as many as make up
SAMPLE_BYTES bytes of text. A text of more than LONG_TEXT bytes is not learned from, so that it takes the place of no
other. Null texts and texts without letters count as ordinary throughout;
without labels of both classes every score is 0. Rows are independent, so repeated rows and null ids
get a row each. Rows of labels with a null id or mark do not count; of several marks the largest does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import bounded_sample, held_out, keep, map_rows

ORDER = 6
#: The toxic class's share of words from its own model.
SHARE = 0.01
PER_CLASS, SAMPLE_BYTES, FOLDS = 2500, 12 << 20, 4
LONG_TEXT = SAMPLE_BYTES // 32
#: Toxic texts in which a word must stand to count for the toxic model.
LEAST_TEXTS = 2
THRESHOLD = 0.7
WORD = r"[^\W\d_]+"
#: Words scored together, which bounds a worker's memory.
BLOCK = 200_000


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each n-gram, key of its first n - 1 signs, index of its word), ends included.

    Keys are 64-bit hashes, so grams of any script share one form.
    """
    text = "".join("\x02" * (n - 1) + w + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # the k-th gram of all ends at place k of its word, after n - 1 signs for each word so far
    of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    at = np.arange(len(of), dtype=np.int64) + of.astype(np.int64) * (n - 1)
    key = np.zeros(len(at), np.uint64)
    for j in range(n - 1):
        key = (key + codes[at + j] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    full = (key + codes[at + n - 1] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    full ^= full >> np.uint64(32)
    return full, key, of


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, values, len(kinds))


def _find(kinds: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(kinds):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(kinds, keys), len(kinds) - 1)
    return np.where(kinds[at] == keys, values[at], default)


def _discount(counts: np.ndarray) -> float:
    """Ney's estimate from the numbers of grams seen once and twice."""
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _level(full: np.ndarray, context: np.ndarray, counts: np.ndarray, d: float) -> dict:
    """Interpolated Kneser-Ney at one order from gram types, their contexts and counts, less d each."""
    contexts, at = np.unique(context, return_inverse=True)
    cut = np.minimum(counts, d)
    totals = np.bincount(at, counts, len(contexts))
    order = np.argsort(full)
    return {"grams": full[order], "share": ((counts - cut) / totals[at])[order], "contexts": contexts, "rest": np.bincount(at, cut, len(contexts)) / totals}


def train(words: list[str], counts: np.ndarray) -> dict:
    """Log-likelihood ratios of the highest order's grams and contexts.

    words are distinct; counts has a line for each, of its numbers in toxic and in ordinary texts. Only
    what differs between the classes is kept: for a gram that either class has seen, its ratio; for
    other grams, the ratio of the weights that both contexts leave to the pooled lower orders,
    whose probability cancels.
    """
    full, context, of = _grams(words, ORDER)
    # pooled lower orders: the count of an n-gram is the number of its distinct left neighbours
    kinds, first = np.unique(full, return_index=True)
    lower = np.full(len(kinds), 1.0 / (1 + len(set("".join(words)))))
    suffix, ctx, _ = _grams(words, 1)
    for n in range(1, ORDER):
        longer = _grams(words, n + 1) if n + 1 < ORDER else (full, context, of)
        _, one = np.unique(longer[0], return_index=True)
        types, at, left = np.unique(suffix[one], return_index=True, return_counts=True)
        model = _level(types, ctx[one][at], left.astype(float), _discount(left))
        lower = _find(model["grams"], model["share"], suffix[first], 0.0) + _find(model["contexts"], model["rest"], ctx[first], 1.0) * lower
        suffix, ctx, _ = longer
    logs, weights = [], []
    contexts = np.unique(context)
    for c in (0, 1):
        own = counts[of, c] > 0
        types, sums = _table(full[own], counts[of[own], c].astype(float))
        _, at = np.unique(full[own], return_index=True)
        model = _level(types, context[own][at], sums, _discount(sums))
        rest = _find(model["contexts"], model["rest"], context[first], 1.0)
        logs.append(np.log(_find(model["grams"], model["share"], kinds, 0.0) + rest * lower))
        weights.append(np.log(_find(model["contexts"], model["rest"], contexts, 1.0)))
    return {"grams": kinds, "gram_ratio": logs[0] - logs[1], "contexts": contexts, "rest_ratio": weights[0] - weights[1], "slope": (0.0, 0.0)}


def word_ratios(model: dict, words: list[str]) -> np.ndarray:
    """log P(word | toxic model) - log P(word | ordinary model) of each word."""
    out = [np.zeros(0)]
    for i in range(0, len(words), BLOCK):
        part = words[i : i + BLOCK]
        full, context, of = _grams(part, ORDER)
        rest = _find(model["contexts"], model["rest_ratio"], context, 0.0)
        known = _find(model["grams"], model["gram_ratio"], full, np.nan)
        out.append(np.bincount(of, np.where(np.isnan(known), rest, known), len(part)))
    return np.concatenate(out)


def differences(model: dict, texts: list[list[str]]) -> np.ndarray:
    """For each text, as its words, the difference of the classes' log-likelihoods for each word; texts without words count as one ordinary word."""
    ids: dict[str, int] = {}
    at = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in texts]
    gain = np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + word_ratios(model, list(ids)))
    return np.array([gain[x].mean() if len(x) else np.log1p(-SHARE) for x in at])


def _fit_slope(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable, with equal weights of both classes, by Newton steps with a small ridge."""
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    scale = max(float(x.std()), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ ((toxic - p) * weight) - 1e-2 * w
        w = w + np.linalg.solve((z * (p * (1 - p) * weight)[:, None]).T @ z + 1e-2 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, fold, text: the labelled rows to learn from, written to the shared folder."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = bounded_sample(marks, "toxic", PER_CLASS, 2 * PER_CLASS + PER_CLASS // 2)
    # at most 6,250 short rows, so they may go to every task
    own = docs.select(F.col("doc_id").cast("long"), "text").where(F.octet_length("text") <= LONG_TEXT).join(F.broadcast(marks), "doc_id")
    draw = F.xxhash64("doc_id", "text", F.lit("order"))
    before = Window.partitionBy("toxic").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = keep(own.select("toxic", "text", F.octet_length("text").alias("size"), draw.alias("draw")))
    fits = own.select("toxic", "draw", F.sum("size").over(before).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES // 2).select("toxic", "draw").distinct()
    return own.join(F.broadcast(fits), ["toxic", "draw"]).select("toxic", F.pmod("draw", F.lit(FOLDS)).cast("int").alias("fold"), "text")


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0 or 1); None without both classes."""
    rows = keep(_sample(docs, labels))

    def make():
        import re

        find = re.compile(WORD).findall
        return lambda toxic, fold, text: (toxic, fold, sorted(set(find(text.lower()))))

    words = map_rows(rows, make, "toxic int, fold int, w array<string>").select("toxic", "fold", F.explode("w").alias("word"))
    # as many pairs as the sample's bytes allow
    got = words.groupBy("word", "toxic", "fold").agg(F.count(F.lit(1)).alias("n")).orderBy("word", "toxic", "fold").toArrow()
    names = got["word"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(names.dictionary), 2, FOLDS), np.int32)
    counts[names.indices.to_numpy(), 1 - got["toxic"].to_numpy(), got["fold"].to_numpy()] = got["n"].to_numpy()
    names = names.dictionary.to_pylist()
    if not counts[:, 0].any() or not counts[:, 1].any():
        return None

    def trained(of: np.ndarray) -> dict:
        of = np.stack((np.where(of[:, 0] < LEAST_TEXTS, 0, of[:, 0]), of[:, 1]), 1)
        some = of.any(1)
        return train([w for w, x in zip(names, some) if x], of[some])

    total = counts.sum(2)
    seen: list[tuple[float, int]] = []
    for fold in range(FOLDS):
        rest = total - counts[:, :, fold]
        if rest[:, 0].any() and rest[:, 1].any():
            part = _differences(rows.where(F.col("fold") == fold).select("toxic", "text"), trained(rest), "toxic", "int").toArrow()
            seen += zip(part["x"].to_pylist(), part["toxic"].to_pylist())
    model = trained(total)
    if seen:
        x, toxic = np.array(sorted(seen)).T
        model["slope"] = _fit_slope(x, toxic)
    return model


def _differences(rows: DataFrame, model: dict, key: str, kind: str) -> DataFrame:
    """key and x, the difference of each text, for rows (key, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(key, {"int": pa.int32(), "long": pa.int64()}[kind]), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(WORD).findall
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = [find(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array(differences(shared.value, texts), pa.float64())], schema=schema)

    return rows.mapInArrow(run, f"{key} {kind}, x double")


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        out = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        a, b = model["slope"]
        z = F.lit(b) + F.lit(a) * F.col("x")
        out = _differences(rows, model, "doc_id", "long").select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def report(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """predict() over all rows, learned from labels of those that are not held out."""
    out = held_out(modulus, remainder)
    model = fit(docs.where(~out), labels.where(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
