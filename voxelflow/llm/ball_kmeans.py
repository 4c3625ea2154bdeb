"""Ball k-means: exact integer k-means in which clusters are balls.

A cluster is a ball around its centroid, with the distance of its farthest member as radius.
Another centroid can win members only if it stands nearer than twice the radius: these are the
ball's neighbours. A member nearer than half way to the nearest neighbour is in the stable core and
stays; the others lie in annuli, by how many neighbours stand within twice their own distance, and
are compared with these neighbours alone. A ball that did not move keeps its stored distances and
compares only with neighbours that moved.

Vectors are integer vectors in blocks, written once into buckets of their block number. A round
writes one small row for each block (cluster and distance of each vector, sums of each cluster),
which lies in the same buckets, so that no round shuffles or rewrites vectors. Radius and annuli
are those of a ball's members in a block, which are never wider than the whole ball's and therefore
as exact. Only one row of sums for each centroid reaches the driver, and only the centroids go back.

Defined cases: vectors of another length, null vectors and those with null or non-finite
components are left out; repeated rows are separate vectors; a null vec_id counts as an
id after all others when the first centroids are chosen, and ties between equal ids go by the
vectors; fewer vectors than centroids make fewer clusters; integers beyond 2^27 in size are held at
2^27, so that distances are exact 64-bit numbers; an empty table gives an empty result; columns
beside vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
BLOCK = 8192
#: Blocks in a bucket, and the most buckets.
BUCKET_BLOCKS, BUCKETS = 64, 8192
LIMIT = 1 << 27
STATE = "block long, clusters binary, distances binary, sums array<struct<cluster int, n long, inertia long, total array<long>>>"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def usable(dimensions: int | None = None):
    """Whether ``embedding`` holds finite components, and as many as asked."""
    size = f"size(embedding) = {dimensions}" if dimensions is not None else "size(embedding) > 0"
    return F.expr(f"coalesce({size} and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity')), false)")


def _blocks(dimensions: int, scale: int, size: int):
    def of(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                x = whole(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)
                kind = "<i2" if np.abs(x).max() < 1 << 15 else "<i4"
                yield pa.RecordBatch.from_arrays(
                    [some.column(2).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0).cast(pa.int64())), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())],
                    names=["block", "ids", "kind", "vectors"],
                )

    return of


def reassign(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> int:
    """Moves vectors to their nearest centroids (ties: the smaller number), in place, and returns
    how many distances were computed. ``distance`` holds squared distances where the own centroid
    did not move."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    members = [np.flatnonzero(cluster == j) for j in range(len(centroids))]
    computed = 0
    for j, rows in enumerate(members):
        if not len(rows):
            continue
        if moved[j]:
            distance[rows] = ((x[rows] - centroids[j]) ** 2).sum(1)
            computed += len(rows)
        own = distance[rows].copy()
        radius = own.max()
        # |c_i - c_j| <= 2 r: squared, with r in whole numbers
        near = [i for i in np.argsort(between[j], kind="stable").tolist() if i != j and between[j, i] <= 4 * radius and (moved[j] or moved[i])]
        for i in near:
            annulus = np.flatnonzero(4 * own >= between[j, i])  # the core is what is in no annulus
            if not len(annulus):
                break  # neighbours come by distance
            at = rows[annulus]
            there = ((x[at] - centroids[i]) ** 2).sum(1)
            computed += len(at)
            wins = (there < distance[at]) | ((there == distance[at]) & (i < cluster[at]))
            distance[at[wins]], cluster[at[wins]] = there[wins], i
    return computed


def _round(centroids: np.ndarray, moved: np.ndarray, first: bool):
    d = centroids.shape[1]

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, d).astype(np.int64)
                cluster = np.zeros(len(x), np.int64) if first else np.frombuffer(row["clusters"], "<i4").astype(np.int64)
                distance = np.zeros(len(x), np.int64) if first else np.frombuffer(row["distances"], "<i8").copy()
                reassign(x, cluster, distance, centroids, moved)
                sums = [{"cluster": j, "n": int(m.sum()), "inertia": int(distance[m].sum()), "total": x[m].sum(0)} for j in range(len(centroids)) if (m := cluster == j).any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([cluster.astype("<i4").tobytes()], pa.binary()), pa.array([distance.astype("<i8").tobytes()], pa.binary()),
                     pa.array([sums], pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("total", pa.list_(pa.int64()))])))],
                    names=["block", "clusters", "distances", "sums"],
                )

    return of


def first_centroids(vectors: DataFrame, count: int, scale: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``3:<vec_id>``."""
    keyed = vectors.select(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256).alias("h"), F.col("embedding").cast("array<double>").alias("v"))
    rows = keyed.orderBy(F.col("h").asc_nulls_last(), "v").limit(count).collect()
    return whole(np.array([r["v"] for r in rows], np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def ball_kmeans(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) of each vector."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(dimensions)).select("vec_id", "embedding")
    centroids = first_centroids(kept, clusters, scale)
    numbered = kept.withColumn("block", F.monotonically_increasing_id())
    data = numbered.mapInArrow(_blocks(dimensions, scale, block), "block long, ids array<long>, kind string, vectors binary")
    plain = materialize(data, "vectors")
    buckets = max(1, min(BUCKETS, max(spark.sparkContext.defaultParallelism, -(-plain.count() // BUCKET_BLOCKS))))
    data = materialize(plain.repartition(buckets, "block"), "balls", "block", buckets)
    discard(plain)

    state, moved = None, np.ones(len(centroids), bool)
    for k in range(rounds + 1):
        rows = data.select("block", "kind", "vectors")
        if state is not None:
            rows = rows.join(state.select("block", "clusters", "distances").hint("shuffle_hash"), "block")
        last, state = state, materialize(rows.mapInArrow(_round(centroids, moved, state is None), STATE), "assigned", "block", buckets)
        if last is not None:
            discard(last)
        s = state.select(F.explode("sums").alias("s")).select("s.*")
        sums = s.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dimensions)]).collect()
        if k == rounds:
            break
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(dimensions)]
        moved = (new != centroids).any(axis=1)
        if not moved.any():
            break  # later rounds would change nothing
        centroids = new
    inertia = {r["cluster"]: int(r["inertia"]) for r in sums}
    total, final = sum(inertia.values()), centroids.tolist()

    def rows_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cluster = np.frombuffer(row["clusters"], "<i4")
                columns = [pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(np.frombuffer(row["distances"], "<i8")), pa.array([inertia[c] for c in cluster.tolist()], pa.int64()), pa.array([total] * len(cluster), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia"])

    found = data.select("block", "ids").join(state.select("block", "clusters", "distances").hint("shuffle_hash"), "block")
    found = found.mapInArrow(rows_of, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long")
    return found.withColumn("centroid", F.get(F.lit(final), "cluster") if final else F.lit(None).cast("array<long>"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


def _kmeans_sql() -> str:
    """Each round as common table expressions over rows (vector, component)."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS v, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: isfinite(e))) = {DIMENSIONS})",
        f"x AS MATERIALIZED (SELECT v, unnest(range({DIMENSIONS})) AS i, unnest(list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT))) AS x FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c FROM kept QUALIFY c < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS m FROM first JOIN x USING (v))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT v, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM x JOIN c{k} USING (i) GROUP BY v, c)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT v, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN x USING (v) GROUP BY c, i)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{k} LEFT JOIN s{k} USING (c, i))")
    steps.append(f"sha AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)")
    last = f"a{ROUNDS}"
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM {last} JOIN sha USING (c) JOIN kept USING (v)"


SQL = _kmeans_sql()


def centroid_digest(components) -> str:
    """The digest of a centroid's components, as in the query."""
    return hashlib.sha256(",".join(str(int(x)) for x in components).encode()).hexdigest()
