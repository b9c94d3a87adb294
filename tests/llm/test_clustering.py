"""op12: exact clusters against a plain computation in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loamline.llm import clustering as cl

VEC = "vec_id {0}, embedding array<{1}>, cluster string, distance int"


def vectors(spark, rows, kind="long", of="double"):
    return spark.createDataFrame([(i, x, "c", 1) for i, x in rows], VEC.format(kind, of))


def brute(rows, dimensions, k, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(r[0]), r[1]))[:k]]
    give = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = give()
        for j in range(len(c)):
            if own := [v for (_, v), (_, to) in zip(kept, at, strict=True) if to == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = give()
    inertia = {j: sum(d for d, to in at if to == j) for j in range(len(c))}
    fit = lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, to, fit(d), fit(inertia[to]), fit(sum(inertia.values())), digest[to]) for (i, _), (d, to) in zip(kept, at, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9, 1e30])
def test_equals_python_integers_at_every_magnitude(spark, scale):
    rng = random.Random(int(scale) % 97)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(4)]) for i in range(120)]
    rows += [(200, [0.5 * scale] * 4)] * 30 + [(300, None), (301, [1.0] * 3), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [0.0] * 4)]
    assert found(cl.cluster(vectors(spark, rows).repartition(3), 4, 7, 3)) == brute(rows, 4, 7, 3)


def test_few_vectors_empty_clusters_and_ids_of_another_type(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])]  # equal first centroids: the second never gets a vector
    assert found(cl.cluster(vectors(spark, rows, of="float"), 2, 5, 2)) == brute(rows, 2, 5, 2)
    named = [(f"v{i}", [float(i), 1.0]) for i in range(9)]
    assert found(cl.cluster(vectors(spark, named, "string"), 2, 3, 2)) == brute(named, 2, 3, 2)
    empty = cl.cluster(vectors(spark, rows).limit(0), 2, 5, 2)
    assert empty.isEmpty() and len(empty.columns) == 6


def test_distances_are_exact_on_either_side_of_the_bounds():
    rng = np.random.default_rng(0)
    for top in (2**20, 2**25, 2**26, 2**29, 2**40):
        x, c = (rng.integers(-top, top, (9, 8)).astype(object) for _ in range(2))
        wanted = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c.tolist()] for v in x.tolist()]
        assert cl.squared_distances(x.astype(np.int64), c).tolist() == wanted
    assert cl.whole(np.array([[-0.001, 0.0039], [1e300, -1e300]])).tolist() == [[-1, 0], [256 * int(1e300), -256 * int(1e300)]]
