"""Exact vector search that skips cells: each vector lies in the cell of its nearest centroid, and a cell has a radius.

No vector of a cell is nearer to a query than the angle between query and centroid less the cell's radius. So the cells
that look best give each query a k-th score first, and then only cells whose bound reaches that score are read. Centroids
decide how much is skipped, never the result: they come from a bounded sample, every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.retrieval import CANDIDATES, Best, hit_schema, query_blocks, rank, units
from tarn.session import keep, shared_dir

#: Rows that centroids are fitted on, at most; the most cells, and how many vectors a cell should have at least.
SAMPLE, CELLS, FEWEST = 20_000, 4096, 32
#: Rounds of k-means; a cell is spread over a file for each so many of its vectors, by its share of the sample.
ROUNDS, SPREAD = 6, 8192
#: Scores are rounded to six digits; bounds give way by so much.
SLACK = 2e-6


def _centroids(rows: np.ndarray, n: int) -> np.ndarray:
    """n unit centroids of unit vectors by spherical k-means; an empty one takes the vector that lies worst."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        cosine = rows @ centres.T
        of = cosine.argmax(1)
        worst = iter(np.argsort(cosine.max(1)))
        for c in range(n):
            own = rows[of == c]
            centres[c] = own.sum(0) if len(own) else rows[next(worst)]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class VectorIndex:
    """Vectors (key, embedding, cell) in a folder for each cell; centroids, radii and sizes of the cells on the driver.

    Cells are CELLS at most. Cell -1 has the vectors of norm 0, which score 0 with any query. measured counts the pairs
    of query and vector of the last search, of `queries * size` in all.
    """

    vectors: DataFrame
    key: str
    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    measured: int = field(default=0)

    @property
    def size(self) -> int:
        return int(self.sizes.sum())

    @staticmethod
    def build(vectors: DataFrame, key: str = "chunk_id") -> VectorIndex:
        """An index of rows (key, embedding); rows without a vector are left out, an empty table gives an empty index."""
        rows = keep(vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"))
        total = rows.count()
        draw = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003
        some = rows.where(draw < min(1.0, 0.9 * SAMPLE / max(1, total))).orderBy(key).limit(SAMPLE).select("embedding").toArrow()
        sample = units(some["embedding"]) if some.num_rows else np.zeros((0, 1))
        drawn, sample = len(sample), sample[np.abs(sample).sum(1) > 0]
        n = max(1, min(CELLS, int(np.sqrt(total)), len(sample) // FEWEST))
        centres = _centroids(sample, n) if len(sample) else np.zeros((1, sample.shape[1]))
        # the last is for cell -1
        share = np.append(np.bincount((sample @ centres.T).argmax(1), minlength=n), drawn - len(sample)) / max(1, drawn)
        shared = rows.sparkSession.sparkContext.broadcast((centres, (1 + share * total // SPREAD).astype(np.int32)))
        schema = f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>, angle double, files int, cell int"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, files = shared.value
            for batch in batches:
                if batch.num_rows:
                    own = units(batch.column(1))
                    cosine = own @ centres.T
                    cell = np.where(np.abs(own).sum(1) > 0, cosine.argmax(1), -1).astype(np.int32)
                    angle = np.arccos(np.clip(cosine.max(1), -1, 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(files[cell]), pa.array(cell)], [key, "embedding", "angle", "files", "cell"])

        path = shared_dir(rows.sparkSession)
        placed = rows.mapInArrow(place, schema)
        placed = placed.repartition("cell", F.pmod(F.xxhash64(key), "files")).drop("files")
        placed.write.partitionBy("cell").parquet(path)
        stored = rows.sparkSession.read.schema(placed.schema).parquet(path)
        seen = stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
        cells = np.array([r["cell"] for r in seen], int)
        zero = np.zeros(centres.shape[1])
        own = np.array([centres[c] if c >= 0 else zero for c in cells]).reshape(len(cells), centres.shape[1])
        return VectorIndex(stored.drop("angle"), key, cells, own, np.array([r["radius"] for r in seen]), np.array([r["n"] for r in seen], int))

    def _bounds(self, block: np.ndarray) -> np.ndarray:
        """The most that a vector of each cell can score for each query."""
        angle = np.arccos(np.clip(block @ self.centres.T, -1, 1))
        return np.where(self.cells < 0, 0.0, np.cos(np.maximum(0.0, angle - self.radius)))

    def _scan(self, rows: DataFrame, ids: pa.Array, block: np.ndarray, wanted: np.ndarray, k: int, schema: str, least: np.ndarray | None = None) -> DataFrame:
        """Of each task the k best of the cells that each query wants (query by cell), not below least; cells that none wants are not read."""
        asked = {int(self.cells[c]): c for c in np.flatnonzero(wanted.any(0))}
        self.measured += int((wanted * self.sizes).sum())
        key, shared = self.key, rows.sparkSession.sparkContext.broadcast((ids, block, asked, wanted, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, block, asked, wanted, least = shared.value
            top = Best(ids, block, k, least)
            for batch in batches:
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells):
                    part = batch.filter(pa.array(cells == cell))
                    top.add(part.column(0), units(part.column(1)), np.flatnonzero(wanted[:, asked[int(cell)]]))
            yield from top.hits(key)

        return rows.where(F.col("cell").isin(list(asked))).select(key, "embedding", "cell").mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, key, score, rank as `retrieval.nearest` gives them; allowed (key) names the vectors that count."""
        rows = self.vectors if allowed is None else self.vectors.join(allowed.select(self.key).distinct(), self.key, "left_semi")
        schema, found = hit_schema(rows, queries, self.key), None
        self.measured = 0
        for part in query_blocks(queries):
            ids, block = part["query_id"].combine_chunks(), units(part["vector"])
            if not len(ids) or not len(self.cells):
                continue
            bound = self._bounds(block)
            # the best-looking cells of each query, as many as hold k vectors
            order = np.argsort(-bound, 1, "stable")
            before = np.cumsum(self.sizes[order], 1) - self.sizes[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, before < k, 1)
            hits = keep(self._scan(rows, ids, block, first, k, schema))
            kth = rank(hits, self.key, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
            of = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist()))
            least = np.array([of.get(q, -2.0) for q in ids.to_pylist()])
            more = (bound >= least[:, None] - SLACK) & ~first
            both = hits.unionByName(self._scan(rows, ids, block, more, k, schema, least)) if more.any() else hits
            found = both if found is None else found.unionByName(both)
        if found is None:
            found = queries.sparkSession.createDataFrame([], schema)
        return rank(found, self.key, k)
