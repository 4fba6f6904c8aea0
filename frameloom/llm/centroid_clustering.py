"""Centroid clustering: a vantage-point tree over the centroids, rebuilt and broadcast each round.

Vectors become exact integers, floor(scale * component). Each round assigns every vector to its nearest centroid (squared
Euclidean distance, ties to the smaller number) and replaces every non-empty centroid by its vectors' exact componentwise floor
of the mean; after the last round vectors are assigned once more. A vector's search is best first: of the tree's nodes that it has
reached it opens the one with the least lower bound, and ends when no bound is within the distance of the best centroid so far. That radius is
inclusive, so a centroid at the same distance with a smaller number is still found; distances are exact integers, only the bounds are doubles, and they
are lowered by more than they can be wrong. All vectors of a batch search side by side, each with its own queue and best.

What is broadcast is ``k`` centroids; what reaches the driver is ``k`` rows at first and k * (dims + 1) sums a round, added up in
tasks before the exchange. Sums are integers, so the order of tasks changes nothing. No round depends on what an executor keeps:
each reads the vectors again.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite one are left out; a null
identifier counts as the text ``null`` where the first centroids are drawn, repeated rows are vectors of their own (ties of the
draw go by components); fewer than ``k`` vectors give as many centroids; an empty table gives an empty result; other columns of
the input are ignored, so their names cannot clash. Components beyond 2**27 in magnitude after scaling raise, since
a squared distance would no longer fit a long; sums of distances that do not fit one are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
#: Centroids of a leaf of the tree.
LEAF = 4
#: Largest magnitude of a component: 64 squares of differences of such stay within a long.
MOST = 1 << 27
#: Numbers (bounds and differences) that the searches of one slice of a batch hold at once.
SLICE_NUMBERS = 1 << 21


class VantageTree:
    """Centroids by their distance from vantage points; node 0 is the root.

    A node is a leaf (a few centroids) or a vantage centroid with two children: those within the median distance
    (``within`` is the largest of them) and those beyond (``beyond`` is the smallest).
    """

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids = centroids
        self.leaves: list[list[int] | None] = []
        self.vantage: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.within: list[float] = []
        self.beyond: list[float] = []
        waiting = [(self._node(), list(range(len(centroids))))]
        while waiting:
            node, own = waiting.pop()
            if len(own) <= leaf:
                self.leaves[node] = own
                continue
            point, rest = own[0], own[1:]
            away = squares(centroids[rest], centroids[point])
            median = np.sort(away)[(len(rest) - 1) // 2]
            near, far = away <= median, away > median
            self.vantage[node] = point
            inner, outer = self._node(), self._node()
            self.children[node] = (inner, outer)
            self.within[node] = float(np.sqrt(float(away[near].max())))
            self.beyond[node] = float(np.sqrt(float(away[far].min()))) if far.any() else np.inf
            waiting += [(inner, [c for c, x in zip(rest, near, strict=True) if x]), (outer, [c for c, x in zip(rest, far, strict=True) if x])]

    def _node(self) -> int:
        self.leaves.append(None)
        self.vantage.append(-1)
        self.children.append((-1, -1))
        self.within.append(0.0)
        self.beyond.append(0.0)
        return len(self.leaves) - 1

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's centroid and squared distance, and how many distances were computed."""
        n, nodes = len(vectors), len(self.leaves)
        who, best = np.full(n, len(self.centroids), np.int64), np.full(n, np.iinfo(np.int64).max)
        step = max(1, SLICE_NUMBERS // (nodes + vectors.shape[1]))
        done = sum(self._search(vectors[at : at + step], who[at : at + step], best[at : at + step]) for at in range(0, n, step))
        return who, best, done

    def _search(self, vectors: np.ndarray, who: np.ndarray, best: np.ndarray) -> int:
        queue = np.full((len(vectors), len(self.leaves)), np.inf)  # lower bounds of the nodes reached, not yet opened
        queue[:, 0] = 0.0
        rows, done = np.arange(len(vectors)), 0
        while len(rows):
            nodes = queue[rows].argmin(1)
            low = queue[rows, nodes]
            open_ = low <= np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-12)
            open_ &= low < np.inf
            rows, nodes, low = rows[open_], nodes[open_], low[open_]
            queue[rows, nodes] = np.inf
            for node in np.unique(nodes).tolist():
                at = nodes == node
                own, bound = rows[at], low[at]
                leaf = self.leaves[node]
                for c in [self.vantage[node]] if leaf is None else leaf:
                    away = squares(vectors[own], self.centroids[c])
                    done += len(own)
                    better = (away < best[own]) | ((away == best[own]) & (c < who[own]))
                    who[own[better]], best[own[better]] = c, away[better]
                if leaf is None:
                    span = np.sqrt(away.astype(np.float64))
                    inner, outer = self.children[node]
                    for child, edge, bounds in ((inner, self.within[node], span - self.within[node]), (outer, self.beyond[node], self.beyond[node] - span)):
                        if self.leaves[child] != []:  # nothing lies beyond where all are at one distance
                            queue[own, child] = np.maximum(bound, bounds - 1e-12 * (span + edge))
        return done


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that count, and their components as exact integers, a row each."""
    full = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    values = column.filter(full).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(1)
    whole = np.floor(scale * values[finite])
    if whole.size and np.abs(whole).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} in magnitude after scaling by {scale}: its squared distance may not fit a long")
    return np.flatnonzero(full.to_numpy(zero_copy_only=False))[finite], whole.astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``salt`` and their identifier, in that order."""
    usable = vectors.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    drawn = usable.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), "vector").limit(k).collect()  # k rows
    return integers(pa.array([r["vector"] for r in drawn], pa.list_(pa.float64())), dims, scale)[1] if drawn else np.zeros((0, dims), np.int64)


def cluster_vectors(docs: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of every vector that counts, and the final centroids."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    vectors = docs.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.size("vector") == dims)
    centroids = first_centroids(vectors, k, dims, scale, salt)
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))

        def add_up(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(tree.value.centroids), dims + 1), np.int64)
            for batch in batches:
                own = integers(batch.column(0), dims, scale)[1]
                who = tree.value.nearest(own)[0]
                for c in np.unique(who).tolist():
                    sums[c] += np.append(own[who == c].sum(0), np.count_nonzero(who == c))
            full = np.flatnonzero(sums[:, dims])
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(full, dims + 1), pa.int32()), "part": pa.array(np.tile(np.arange(dims + 1), len(full)), pa.int32()), "total": sums[full].ravel()})

        found = vectors.select("vector").mapInArrow(add_up, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        totals: dict[int, dict[int, int]] = {}
        for r in found.collect():  # k * (dims + 1) rows
            totals.setdefault(r["cluster"], {})[r["part"]] = int(r["total"])
        centroids = np.array([[totals[c][j] // totals[c][dims] for j in range(dims)] if c in totals else row.tolist() for c, row in enumerate(centroids)], np.int64)

    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = integers(batch.column(1), dims, scale)
            who, away, _ = tree.value.nearest(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(who, pa.int32()), pa.array(away)], names=[id_col, "cluster", "distance"])

    fields = [T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return vectors.mapInArrow(assign, T.StructType(fields)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances by cluster and over all, and the digest of each centroid's components."""
    spark = assigned.sparkSession
    assigned = written(assigned)  # the last search is not run twice
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    rows = [(c, int(sums[c]), int(sum(sums.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist()) if c in sums]
    told = spark.createDataFrame([(c, str(a), str(b), d) for c, a, b, d in rows], "cluster int, own string, whole string, centroid_sha256 string")
    told = told.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("whole").try_cast("long").alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(told), "cluster").select(*assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")  # as many rows as centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {K})",
    ]
    for r in range(ROUNDS + 1):
        steps += [
            f"d{r} AS (SELECT k.row, k.vec_id, k.v, c.c, CAST({square} AS BIGINT) AS distance FROM kept k, c{r} c)",
            f"a{r} AS (SELECT row, vec_id, v, c, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1)",
        ]
        if r < ROUNDS:
            steps += [
                f"s{r} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS j) GROUP BY c, j)",
                f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{r} GROUP BY c)",
                f"c{r + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))",
            ]
    return (
        f"WITH {', '.join(f'{s.split(" AS ", 1)[0]} AS MATERIALIZED {s.split(" AS ", 1)[1]}' for s in steps)} SELECT a.vec_id, CAST(a.c AS INT) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (c)"
    )


#: The same in DuckDB: rounds unrolled, all distances.
OP12_SQL = _op12_sql()
