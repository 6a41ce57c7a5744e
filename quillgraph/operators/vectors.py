"""An index of vectors in cells, and exact nearest ones for many questions at once.

Vectors lie in the cell of the nearest of some centroids, each with the radius of what it holds. No vector of a cell
scores more against a question than the centroid's score and the question's length times the radius, so a question
first looks into the cells with the highest bounds, until these hold k vectors, and then only into those whose bound
reaches its k-th best score. Cells are joined in parts of bounded size with blocks of questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import table

#: Cells, and vectors that centroids are fitted on, in how many steps; vectors and questions that a task compares at once.
CELLS, SAMPLE, STEPS = 256, 20_000, 6
PART_ROWS, BLOCK = 4_096, 1_024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """At most `cells` centroids by Lloyd's steps, from rows spread over the sample; those that lose all rows are dropped."""
    if not len(sample):
        return sample
    at = np.unique(sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)], axis=0)
    for _ in range(steps):
        own = _nearest(sample, at)[0]
        at = np.array([sample[own == c].mean(axis=0) for c in np.unique(own)])
    return at


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of each row."""
    cell = np.argmin(((centroids**2).sum(axis=1) - 2 * rows @ centroids.T), axis=1)
    return cell, np.sqrt(((rows - centroids[cell]) ** 2).sum(axis=1))


def scores(questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dot products, each summed in the order of the elements, in doubles."""
    out = np.zeros((len(questions), len(rows)))
    for d in range(rows.shape[1]):
        out += questions[:, d, None] * rows[None, :, d]
    return out


class VectorIndex:
    """Vectors in tables below a path: `vectors` by cell, and `cells` with their centroids, radii and sizes."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.spark = path, spark
        self.cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # one row a cell
        self.share_read: float | None = None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
        """Centroids are fitted on at most `sample` rows, those with the smallest hashes; every vector is indexed. Rows without id or vector aren't."""
        rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
        n = rows.count()
        draw = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 40))
        drawn = rows.withColumn("draw", draw).filter(F.col("draw") <= int((1 << 40) * min(1.0, 1.3 * sample / max(1, n)))).groupBy("draw").agg(F.first("vector").alias("vector")).orderBy("draw").limit(sample)
        centroids = fit_centroids(_matrix(pa.array([r["vector"] for r in drawn.collect()])) if n else np.zeros((0, 0)), cells)
        kind = rows.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, away = _nearest(_matrix(batch.column(1)), centroids)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "vector", "cell", "away"])

        placed = table(rows.mapInArrow(assign, f"id {kind}, vector array<double>, cell int, away double"), "placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        at = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        told = sizes.join(F.broadcast(at), "cell").withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        told.write.mode("overwrite").parquet(f"{path}/cells")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        placed.join(F.broadcast(told.select("cell", "parts")), "cell").select("id", "vector", part.alias("part"), "cell").repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        return cls(rows.sparkSession, path)

    def nearest(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(question, rank, id, score): of each of questions(question, vector) the k vectors with the largest dot products, ties by id.

        Rows that repeat a question are one; a null question or vector has no rows. share_read tells which share of all
        pairs of a question and a cell was looked into.
        """
        asked = table(questions.filter("question is not null and vector is not null").groupBy("question").agg(F.first(F.col("vector").cast("array<double>")).alias("vector")), "questions")
        kind, id_kind = asked.schema["question"].dataType.simpleString(), self.spark.read.parquet(f"{self.path}/vectors").schema["id"].dataType.simpleString() if self.cells else "long"
        hits = f"question {kind}, id {id_kind}, score double"
        n = asked.count()
        if not n or not self.cells:
            return self.spark.createDataFrame([], f"question {kind}, rank int, id {id_kind}, score double")
        cell = np.array([r["cell"] for r in self.cells], np.int32)
        centroids, radius, size = np.array([r["centroid"] for r in self.cells]), np.array([r["radius"] for r in self.cells]), np.array([r["n"] for r in self.cells])

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1))
                # what rounding may add is far below a millionth
                most = scores(q, centroids) + np.sqrt((q**2).sum(axis=1))[:, None] * radius + 1e-6
                order = np.argsort(-most, axis=1, kind="stable")
                first = np.cumsum(size[order], axis=1) - size[order] < k
                rank = np.argsort(order, axis=1)
                own = np.arange(len(q)).repeat(len(cell))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array(np.tile(cell, len(q))), pa.array(most.ravel()), pa.array(np.take_along_axis(first, rank, axis=1).ravel())], names=["question", "cell", "most", "first"]
                )

        pairs = table(asked.mapInArrow(bounds, f"question {kind}, cell int, most double, first boolean"), "bounds")
        blocks = max(1, -(-n // BLOCK))
        some = table(self._scored(pairs.filter("first"), asked, blocks, k, hits), "first-hits")
        kth = self._best(some, k).groupBy("question").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        later = pairs.filter("not first").join(kth, "question").filter((F.col("n") < k) | (F.col("most") >= F.col("least")))
        seen = Observation()
        later = table(later.select("question", "cell"), "later", seen, F.count(F.lit(1)).alias("n"))
        self.share_read = (seen.get["n"] + pairs.filter("first").count()) / (n * len(self.cells))
        return self._best(some.unionByName(self._scored(later, asked, blocks, k, hits)), k).select("question", "rank", "id", "score")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("question").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _scored(self, pairs: DataFrame, asked: DataFrame, blocks: int, k: int, hits: str) -> DataFrame:
        """The k best of each pair of a question and a part of its cell."""
        parts = self.spark.createDataFrame([(r["cell"], r["parts"]) for r in self.cells], "cell int, parts int")
        block = F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int")
        asks = pairs.select("question", "cell").join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(asked, "question").withColumn("block", block)
        wanted = asks.select(*(F.col(c).alias(c) for c in ("cell", "part", "block"))).distinct()
        rows = self.spark.read.parquet(f"{self.path}/vectors").join(wanted, ["cell", "part"])
        names = [c.split()[0] for c in hits.split(", ")]

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([left.column("question").slice(0, 0), right.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
            right = right.sort_by("id")
            found = scores(_matrix(left.column("vector")), _matrix(right.column("vector")))
            order = np.argsort(-found, axis=1, kind="stable")[:, :k]
            return pa.table([left.column("question").take(pa.array(np.arange(len(found)).repeat(order.shape[1]))), right.column("id").take(pa.array(order.ravel())), pa.array(np.take_along_axis(found, order, axis=1).ravel())], names=names)

        return asks.select("cell", "part", "block", "question", "vector").groupBy("cell", "part", "block").cogroup(rows.select("cell", "part", "block", "id", "vector").groupBy("cell", "part", "block")).applyInArrow(best, hits)
