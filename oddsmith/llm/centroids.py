"""Integer k-means with an n-simplex filter (operator 11).

Vectors become integers once: ``floor(scale * x)``.  A few pivots are taken from the starting
centroids; the exact squared distances of every vector to them are stored with the vector.
From those distances alone, the vector and the pivots form a simplex whose apex has as many
coordinates as there are pivots: the foot in the pivots' space and, last, the height over it.
Two apexes' Euclidean distance is a lower bound of the true distance, and with one height
negated an upper bound.  Centroids whose lower bound lies above the least upper bound are
out; the rest are compared by exact integer distances.

A pass is one scan without a shuffle of vectors: each task returns at most one row of exact
sums per centroid.  The driver holds the centroids only (``k`` rows).

Cases: a null vector, one of another length or with a null, NaN or infinite component is left out;
null ids count as the empty decimal; repeated rows are vectors of their own, and of equal ids the
vector smaller in array order comes first; ties between centroids go to the smaller number;
fewer than ``k`` vectors give that many centroids; no vectors give no rows; further columns are
not read.  An integer component beyond ``REACH`` would overflow a distance and ends the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import store

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, PIVOTS = 64, 64, 16, 3, 8
REACH = 1 << 27
#: Share of a squared length that rounding may add to, or take from, a squared bound (heights are roots of small differences).
SLACK = 1e-4


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: the vectors that are kept, as integers."""
    v = F.col(vector_col)
    whole = F.size(v) == dimensions
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.coalesce(whole & finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("w"))
    far = F.exists("w", lambda x: F.abs(x) > REACH)
    checked = F.when(far, F.raise_error(F.lit(f"a component beyond {REACH} has no exact distance"))).otherwise(F.col("w").cast("array<int>"))
    return kept.select("id", checked.alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<id>``."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.orderBy(mark, "v").limit(k).collect()]


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by points."""
    return np.stack([((rows - p) ** 2).sum(1) for p in points], 1)


class Simplex:
    """Base simplex of some of ``points``: farthest from the span of those chosen first, nearly dependent ones left out."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        chosen, foot = [0], np.zeros((len(points), 0))
        to = squares(points, points).astype(float)
        height = to[0].copy()
        rows: list[np.ndarray] = []
        while len(chosen) < most and height.max() > 1e-3 * max(to[0].max(), 1.0):
            new = int(height.argmax())
            inner = (to[0] + to[0, new] - to[new]) / 2  # of each point and the new pivot, seen from the first
            column = (inner - foot @ foot[new]) / np.sqrt(height[new])
            rows.append(np.append(foot[new], column[new]))
            foot = np.column_stack([foot, column])
            height = np.maximum(to[0] - (foot**2).sum(1), 0.0)
            chosen.append(new)
        self.pivots = points[chosen]
        self.base = [to[0, c] for c in chosen[1:]]
        self.rows = rows

    def apex(self, to: np.ndarray) -> np.ndarray:
        """Apexes from squared distances to the pivots (one row each): foot coordinates, then the height."""
        foot = np.zeros((len(to), len(self.rows)))
        first = to[:, 0].astype(float)
        for i, row in enumerate(self.rows):
            inner = (first + self.base[i] - to[:, i + 1]) / 2
            foot[:, i] = (inner - foot[:, :i] @ row[:i]) / row[i]
        return np.column_stack([foot, np.sqrt(np.maximum(first - (foot**2).sum(1), 0.0))])


def nearest(rows: np.ndarray, to: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid (ties: the smaller number)."""
    to_centroids = squares(centroids, simplex.pivots)
    a, c = simplex.apex(to), simplex.apex(to_centroids)
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(2)
    slack = SLACK * (to[:, :1] + to_centroids[None, :, 0]) + 1.0
    low = flat + (a[:, -1:] - c[None, :, -1]) ** 2 - slack
    high = flat + (a[:, -1:] + c[None, :, -1]) ** 2 + slack
    row, no = np.nonzero(low <= high.min(1, keepdims=True))
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), 1 << 14):
        some = slice(at, at + (1 << 14))
        exact[row[some], no[some]] = ((rows[row[some]] - centroids[no[some]]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(rows)), best]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def measured(kept: DataFrame, simplex: Simplex) -> DataFrame:
    """``id, v, to``: the squared distances to the pivots, once for all passes."""
    dimensions = simplex.pivots.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = squares(matrix(batch.column("v"), dimensions), simplex.pivots)
            at = pa.array(np.arange(0, to.size + 1, to.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(at, pa.array(to.ravel()))], ["id", "v", "to"])

    return kept.mapInArrow(measure, "id long, v array<int>, to array<long>")


def assigned(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """``id, cluster, distance`` of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, distance = nearest(matrix(batch.column("v"), centroids.shape[1]), matrix(batch.column("to"), len(simplex.pivots)), simplex, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(no, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "id long, cluster int, distance long")


def moved(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean; empty ones stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
        for batch in batches:
            rows = matrix(batch.column("v"), centroids.shape[1])
            no, _ = nearest(rows, matrix(batch.column("to"), len(simplex.pivots)), simplex, centroids)
            order = np.argsort(no, kind="stable")
            found, first = np.unique(no[order], return_index=True)
            sums[found, 0] += np.diff(first, append=len(no))
            sums[found, 1:] += np.add.reduceat(rows[order], first)
        own = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = vectors.mapInArrow(add, "cluster int, sums array<long>")
    totals = parts.select("cluster", F.posexplode("sums").alias("at", "n")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = centroids.copy()
    found = {(r["cluster"], r["at"]): int(r["n"]) for r in totals.collect()}  # at most k * (dimensions + 1) rows
    for no in {c for c, _ in found}:
        out[no] = [found[no, i + 1] // found[no, 0] for i in range(centroids.shape[1])]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    kept = integers(vectors, dimensions, scale, id_col, vector_col)
    centroids = np.array(first_centroids(kept, k), np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return kept.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    simplex = Simplex(centroids, pivots)
    cached = store(measured(kept, simplex), "vectors")
    for _ in range(rounds):
        centroids = moved(cached, simplex, centroids)
    done = store(assigned(cached, simplex, centroids), "clusters")
    inertia = {r["cluster"]: r["n"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most k rows
    total = sum(inertia.values())
    marks = [(no, n, total, hashlib.sha256(",".join(map(str, centroids[no].tolist())).encode()).hexdigest()) for no, n in inertia.items()]
    about = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same rounds in SQL: exact dot products of integers, one pair of common table expressions a round."""
    steps = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "numbered AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS no FROM kept)",
        f"c0 AS (SELECT CAST(no AS INTEGER) AS no, v AS c FROM numbered WHERE no < {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        last = i == ROUNDS
        steps.append(f"""a{i} AS (SELECT vec_id, v, min({{'d': d, 'no': no}}) AS best FROM (
            SELECT vec_id, v, no, copy, CAST(list_dot_product(CAST(diff AS DOUBLE[]), CAST(diff AS DOUBLE[])) AS BIGINT) AS d FROM (
                SELECT vec_id, v, no, copy, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS diff FROM (SELECT *, row_number() OVER () AS copy FROM kept) k CROSS JOIN c{i} c)) x
            GROUP BY vec_id, v, copy)""")
        if not last:
            steps.append(f"""c{i + 1} AS (SELECT c.no, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
                SELECT no, list(floor_mean ORDER BY pos) AS c FROM (
                    SELECT no, pos, CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) AS floor_mean FROM (
                        SELECT best.no AS no, pos, sum(v[pos]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {DIMENSIONS + 1}) r(pos) GROUP BY 1, 2) t) u
                GROUP BY no) m USING (no))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, best.no AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.no) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.no = best.no"""


CLUSTERS_SQL = _sql()
