"""Centroid clustering of whole-number vectors, exact: distances by |x|² - 2x·c + |c|² in float64 where their size allows it."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamline.llm.common import checkpoint, read_table

#: Components of a vector, centroids, rounds, and the scale that components are made whole numbers in.
DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Vectors of a block.
BLOCK = 4096


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, exact: in the smallest integers that hold them, or Python's beyond 64 bits."""
    top = np.abs(x).max(initial=0.0)
    if top * scale < 2.0**62:
        scaled = np.floor(x * scale).astype(np.int64)  # scale is a power of two, so the product is exact
        least, most = scaled.min(initial=0), scaled.max(initial=0)
        return scaled.astype(next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max))
    exact = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of x to each row of c, exact; c holds Python integers.

    With m the largest magnitudes, no term and no partial sum of |x|² - 2x·c + |c|² is over d (m_x + m_c)². Below 2^53
    doubles hold all of them exactly, whatever the order of summation, and BLAS multiplies; below 2^63 64-bit
    integers do; beyond, Python's.
    """
    top = lambda v: max((abs(int(v.min(initial=0))), abs(int(v.max(initial=0))))) if v.dtype != object else max(map(abs, v.ravel().tolist()), default=0)
    bound = x.shape[1] * (top(x) + top(c)) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    x, c = x.astype(kind), c.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64) if kind is np.float64 else found


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, of equally near ones the smallest, and the squared distance."""
    found = squared_distances(x, c)
    at = found.argmin(axis=1)
    return at, found[np.arange(len(x)), at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (ids, matrix of whole numbers), packed."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((part.column("vec_id").to_pylist(), whole(x)))], pa.binary())], names=["block"])


def _sum(c: np.ndarray):
    """What a block adds to (sums, counts, inertias) of the clusters, as Python integers."""

    def add(total: tuple, row) -> tuple:
        x = pickle.loads(row["block"])[1]
        at, distance = nearest(x, c)
        wide = x.astype(np.int64 if x.dtype != object and np.abs(x.astype(float)).max(initial=0) < 2.0**48 else object)
        sums, counts, inertias = (v.copy() for v in total)
        for k in np.unique(at).tolist():
            own = at == k
            sums[k] = sums[k] + wide[own].sum(axis=0).astype(object)
            counts[k] += int(own.sum())
            inertias[k] += sum(distance[own].tolist())
        return sums, counts, inertias

    return add


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _long(values) -> pa.Array:
    """64-bit integers; null for what they can't hold."""
    return pa.array([v if v is not None and v < 1 << 63 else None for v in map(int, values)], pa.int64())


def digest(c: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]


def _assigned(c: np.ndarray, inertias: list[int], id_type: pa.DataType):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = np.array(digest(c))
        of_cluster, of_all = np.array(inertias, object), sum(inertias)
        for batch in batches:
            for block in batch.column("block").to_pylist():
                ids, x = pickle.loads(block)
                at, distance = nearest(x, c)
                kept = [pa.array(ids, id_type), pa.array(at, pa.int32()), _long(distance), _long(of_cluster[at]), _long([of_all] * len(at)), pa.array(sha[at].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(kept, names=names)

    return run


def cluster(vectors: DataFrame, dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    Kept are vectors (vec_id, embedding) of exactly ``dimensions`` components, none null or not finite; a component x counts
    as floor(256 x). The first centroids are the ``k`` kept vectors of smallest sha256 of ``2:<vec_id>`` (equal ones by
    their components, null ids last). Each round gives every vector to its nearest centroid, ties to the smaller number, and moves
    each centroid that has vectors to the floor of their mean; then vectors are given once more. All of it is exact in whole numbers.

    Vectors are packed into checkpointed blocks; a round is one pass over them, whose sums of ``k`` rows a task come
    together in a tree. No vector is shuffled, so a vector of very many copies is no hot spot; only the ``k`` centroids
    are sent out. With fewer than ``k`` vectors each is a centroid; without any there are no rows. Repeated rows are vectors of
    their own. A distance or inertia over 64 bits is null; where it matters sums use integers of any size.
    Ids may have any type; other columns are ignored.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where((F.size("v") == dimensions) & good)
    blocks = checkpoint(kept.mapInArrow(_blocks, "block binary"))
    sha = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(sha.alias("sha"), "v").orderBy(F.col("sha").asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return _typed(vectors, blocks, np.zeros((0, dimensions), object), [])
    c = np.stack([whole(np.array(r["v"])).astype(object) for r in first])
    empty = (np.zeros(c.shape, object), np.zeros(len(c), object), np.zeros(len(c), object))
    for _ in range(rounds):
        sums, counts, _ = blocks.rdd.treeAggregate(empty, _sum(c), _plus, depth=2)
        c = np.stack([s // n if n else old for s, n, old in zip(sums, counts, c, strict=True)])
    inertias = blocks.rdd.treeAggregate(empty, _sum(c), _plus, depth=2)[2].tolist()
    return _typed(vectors, blocks, c, inertias)


def _typed(vectors: DataFrame, blocks: DataFrame, c: np.ndarray, inertias: list[int]) -> DataFrame:
    kind = vectors.schema["vec_id"].dataType
    run = _assigned(c, inertias, to_arrow_type(kind))
    return blocks.mapInArrow(run, f"vec_id {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows of ``cluster`` over whole ``embeddings``."""
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rows for DuckDB; each round is a step of its own."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), x) - 1 AS k, x FROM v QUALIFY k < {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := CAST(d AS BIGINT), k := k)) AS best FROM (SELECT v.r, c.k, {near} AS d FROM v, c{i} c) GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT best.k AS k, list(floor_mean ORDER BY j) AS x FROM (
  SELECT best, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS floor_mean FROM (
    SELECT struct_pack(k := best.k) AS best, j, sum(e) AS s, count(*) AS n FROM (SELECT best, unnest(x) AS e, unnest(range({DIMENSIONS})) AS j FROM v JOIN a{i} USING (r)) GROUP BY best.k, j)) GROUP BY best.k)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} c ON c.k = best.k"""


OP12_SQL = _sql()
