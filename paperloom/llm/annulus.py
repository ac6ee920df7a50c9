"""Centroid clustering by annulus search, exact in integers.

Centroids are sorted by their norms. A vector's first bound is its distance to the centroids next to it in that order;
by the triangle inequality a nearer or equally near centroid has a norm within that bound of the vector's own, so a
binary search gives the annulus, and only its centroids are compared. The bound is widened beyond what floating point
can err by, so ties on the boundary are compared too; the comparison itself is in 64-bit integers, and of equal
distances the smaller number wins. Vectors are stored once as integers. Each round sends the centroids (k x d numbers)
to the tasks, which add up their vectors by cluster before anything is shuffled; sums over tasks are decimals, and the
means are floored exactly. No vector meets another in a group, so a frequent vector or a huge cluster is no hot key.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out; rows
without id have no starting hash and start no cluster before all others do; repeated rows count each; ties between
equal ids go by their components; fewer vectors than k give as many centroids; an empty table gives an empty result;
a component that is over 2^27 in size once it is an integer raises an error, as its squares would not fit; further
columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LARGEST = 1 << 27
#: Pairs of vector and centroid that are compared at once.
PAIRS = 1 << 16
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def as_integers(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Rows whose vector has so many finite components, with these as integers floor(scale x) in __x."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = [c for c in vectors.columns if c not in (vector, *RESULTS)]
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    large = F.exists("__x", lambda x: F.abs(x) > LARGEST)
    rows = vectors.where(F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))).select(*kept, whole.alias("__x"))
    return rows.withColumn("__x", F.when(large, F.raise_error(F.lit(f"a component is over {LARGEST} in size"))).otherwise(F.col("__x").cast("array<int>")))


class Annulus:
    """Nearest centroids by norm."""

    def __init__(self, centroids: np.ndarray) -> None:
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norm, kind="stable")
        self.norm, self.centroids = norm[self.number], centroids[self.number]

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first centroid, and one past the last, in the order of norms that each vector is compared with."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        above = np.minimum(np.searchsorted(self.norm, norm), len(self.norm) - 1)
        bound = np.minimum(*(squared(x, self.centroids[p]) for p in (above, np.maximum(above - 1, 0))))
        reach = np.sqrt(bound.astype(np.float64))
        reach += 1e-9 * (reach + norm + self.norm[-1]) + 1e-6
        return np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector."""
        low, high = self.annulus(x)
        cluster, distance = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for step in range(int((high - low).max(initial=0))):
            rows = np.flatnonzero(low + step < high)
            for at in range(0, len(rows), PAIRS):
                some = rows[at : at + PAIRS]
                place = low[some] + step
                d, number = squared(x[some], self.centroids[place]), self.number[place]
                better = (d < distance[some]) | ((d == distance[some]) & (number < cluster[some]))
                cluster[some[better]], distance[some[better]] = number[better], d[better]
        return cluster, distance


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray):
    k, d = centroids.shape

    def run(batches):
        search, n, total = Annulus(centroids), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            cluster, _ = search.nearest(x)
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), d + 1)), pa.array(np.tile(np.arange(-1, d), k)), pa.array(np.column_stack([n, total]).ravel())], ["cluster", "component", "total"])

    return run


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of each centroid's vectors; one without vectors stays."""
    parts = table.select("__x").mapInArrow(_sums(centroids), "cluster long, component long, total long")
    sums = {(r.cluster, r.component): int(r.total) for r in parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = centroids.copy()
    for c in range(len(out)):
        if n := sums.get((c, -1), 0):
            out[c] = [sums[c, i] // n for i in range(out.shape[1])]
    return out


def first_centroids(table: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = table.select(start.alias("h"), "__x").orderBy(F.asc_nulls_last("h"), "__x").limit(k).collect()
    return np.array([r["__x"] for r in rows], np.int64)


def _assigned(centroids: np.ndarray, names: list[str]):
    def run(batches):
        search = Annulus(centroids)
        for batch in batches:
            cluster, distance = search.nearest(matrix(batch.column(batch.num_columns - 1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cluster.astype(np.int32)), pa.array(distance)], names)

    return run


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The kept vectors' other columns with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    table = cut_lineage(as_integers(vectors, vector, dimensions, scale))
    kept = [f for f in table.schema.fields if f.name != "__x"]
    schema = T.StructType([*kept, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centroids = first_centroids(table, key, k, seed)
    if not len(centroids):
        return table.select(*(f.name for f in kept), *(F.lit(None).cast(t).alias(c) for c, t in zip(RESULTS, ("int", "long", "long", "long", "string"), strict=True)))
    for _ in range(rounds):
        centroids = moved(table, centroids)
    assigned = cut_lineage(table.mapInArrow(_assigned(centroids, schema.names), schema))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = [(c, inertia[c], sum(inertia.values()), digest[c]) for c in sorted(inertia)]
    return assigned.join(F.broadcast(spark.createDataFrame(totals, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*schema.names, *RESULTS[2:])


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql() -> str:
    """The rounds one after the other."""
    steps = [f"""a{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d FROM (SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, m{r}) GROUP BY vec_id, x)""" + (f""",
m{r + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM m{r} LEFT JOIN (SELECT c, list(v ORDER BY i) AS n FROM (SELECT c, i, ((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) USING (c))""" if r < ROUNDS else "") for r in range(ROUNDS + 1)]
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS}
), m0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x AS m FROM (SELECT x, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CLUSTERS})),
{", ".join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN m{ROUNDS} USING (c)"""


OP12_SQL = _sql()
