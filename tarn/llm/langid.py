"""Language identification by nearest centroid.

A text is the vector of its byte n-grams (1 to 3 bytes, letters in lower case, other ASCII as
blanks) hashed into DIMS bins, weighted by TF-IDF and normalised. Each language has several
centroids, found by spherical k-means over a bounded sample of labelled rows. A text gets the
language of the centroid with the largest cosine; it is rejected where that cosine is far
below what the language's own sample shows for texts of about its length.

Null texts and texts without a letter get `und`, score 0, and are rejected. A language that is
null is not learned. Without labelled rows every text is `und`. Rows are independent, so
repeated rows and null ids get a row each. Long texts are read in pieces of PIECE bytes, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_sample, held_out, map_rows, small_batches

DIMS = 1 << 12
PIECE = 1 << 20
#: The sample that the model is fitted on: rows for each language, and rows in all.
PER_LANGUAGE, SAMPLE = 400, 4000
CENTROIDS = 4
#: A text is rejected if its cosine is below this part of what the sample's weakest hundredth of like length has.
REJECT = 0.45
_TABLE = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    total = np.zeros(DIMS, np.int64)
    for start in range(0, len(data), PIECE):
        piece = np.frombuffer(data[start : start + PIECE + 2], np.uint8).astype(np.uint32)
        own = min(PIECE, len(data) - start)
        code = piece[:own] * np.uint32(0x9E3779B1)
        total += np.bincount((code >> np.uint32(20)).astype(np.int64), minlength=DIMS)
        for n in (1, 2):
            code = code[: max(0, min(own, len(piece) - n))] * np.uint32(0x85EBCA6B) + (piece[n : n + own] + np.uint32(n)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            total += np.bincount(((code * np.uint32(0x2C1B3C6D)) >> np.uint32(20)).astype(np.int64), minlength=DIMS)
    return total


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means; the first is the mean's nearest row, later ones the farthest."""
    mean = rows.mean(0)
    chosen = [rows[np.argmax(rows @ mean)]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[np.argmin((rows @ np.array(chosen).T).max(1))])
    centres = np.array(chosen)
    for _ in range(12):
        own = (rows @ centres.T).argmax(1)
        sums = np.array([rows[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, lang: str = "lang") -> dict:
    """A model from (doc_id, text, lang) rows: languages, centroids, idf, and the cosines to expect by length.

    The sample's n-gram counts, not its texts, come to the driver: SAMPLE rows of at most DIMS bins.
    """
    rows = bounded_sample(docs.select(F.col("doc_id").cast("long"), "text", F.col(lang).alias("lang")), "lang", PER_LANGUAGE, SAMPLE, also="text")

    def make():
        def one(doc_id, text, lang):
            if not has_letter(text):
                return None, None, None, None
            counts = gram_counts(text)
            bins = np.flatnonzero(counts)
            return doc_id, lang, bins.tolist(), counts[bins].tolist()

        return one

    got = map_rows(rows, make, "doc_id long, lang string, bins array<int>, counts array<int>").where("lang is not null").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["bins"]))
    langs = sorted({r["lang"] for r in got})
    if not got:
        return {"langs": []}
    counts = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        counts[i, r["bins"]] = r["counts"]
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    rows = np.sqrt(counts) * idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    own = np.array([langs.index(r["lang"]) for r in got])
    centres, of = [], []
    for j in range(len(langs)):
        c = _clusters(rows[own == j], CENTROIDS)
        centres.append(c)
        of += [j] * len(c)
    centres, of = np.concatenate(centres).astype(np.float32), np.array(of)
    best = (rows @ centres.T).max(1)
    # short texts lie farther from every centroid: the expected cosine is kept by the length's power of two
    level = np.log2(1 + counts.sum(1)).astype(int)
    floor, low = np.zeros(64, np.float32), 0.0
    for n in range(64):
        if (level == n).sum() >= 5:
            low = max(low, float(np.quantile(best[level == n], 0.01)))
        floor[n] = low
    return {"langs": langs, "centres": centres, "of": of, "idf": idf, "floor": floor * REJECT}


def classify(model: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, cosine, rejected) of one text."""
    if not model["langs"] or not has_letter(text):
        return "und", 0.0, True
    counts = gram_counts(text)
    cosines = model["centres"] @ _vector(counts, model["idf"]).astype(np.float32)
    at = int(cosines.argmax())
    score = float(min(1.0, max(0.0, cosines[at])))
    return model["langs"][model["of"][at]], score, bool(score < model["floor"][int(np.log2(1 + counts.sum()))])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text)."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), lambda: lambda i, t: (i, *classify(model, t)), "doc_id long, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """predict() over all rows, learned from those that are not held out."""
    out = held_out(modulus, remainder)
    return predict(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected; all rows if no language was learned."""
    if not model["langs"]:
        return docs

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not classify(model, t)[2] for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
