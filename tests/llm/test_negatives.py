"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.llm import queries
from sprocket.llm.negatives import Best, Tree, descend, mine, products


def brute(rows, anchor=lambda i: i % 100 == 0):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731,B905
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1]))
    out = []
    for i, v, label in kept:
        if i is None or not anchor(i):
            continue
        found = [(dot(v, w), j, other == label) for j, w, other in kept if j != i]
        for ps, p, _ in order(f for f in found if f[2])[:5]:
            fits = order(f for f in found if not f[2] and 30 * ps <= 100 * f[0] <= 90 * ps)
            out += [(i, p, k, j, ps, s) for k, (s, j, _) in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


def vectors(seed: int, n: int, dim: int = 6) -> list[tuple]:
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, dim))
    rows = []
    for i in range(n):
        v = middle[i % 4] + r.normal(size=dim) * 0.7
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(0, 4))))
    return rows


def odd(rows: list[tuple]) -> list[tuple]:
    v = rows[0][1]
    more = [(1000, None, 1), (1001, [], 2), (1002, v[:2], 1), (1003, [*v[:2], None], 1), (1004, [float("nan")] * 6, 1), (1005, [float("inf"), *v[1:]], 2), (1006, v, None), (1007, [0.0] * 6, 0), (1100, [0.0] * 6, 0), (None, v, 1), (1009, [3e38] * 6, 1)]
    return rows + more + [(2000 + k, v, k % 3) for k in range(80)] + [rows[5], rows[5]]


@pytest.mark.parametrize("seed", range(3))
def test_descent_finds_what_a_scan_finds(seed):
    r = np.random.default_rng(seed)
    ids, labels = np.arange(400), r.integers(0, 3, 400)
    points = np.concatenate([r.integers(-300, 300, (250, 8)), r.integers(-2, 3, (100, 8)), np.tile(r.integers(-99, 99, 8), (50, 1))])
    tree = Tree.build(ids, labels, points)
    place = {int(i): k for k, i in enumerate(tree.ids)}
    assert sorted(place) == list(range(400)) and (tree.vectors[[place[i] for i in range(400)]] == points).all()
    for n in range(len(tree.centre)):  # every node covers its rows, and the centres of a level are apart
        rows = slice(tree.lo[n], tree.hi[n])
        ip = products(tree.vectors[rows], points[:20])
        for k in range(20):
            least, most = tree.bounds(slice(n, n + 1), points[k].astype(float), float(points[k] @ points[k]))
            assert least[0] <= ip[:, k].min() and ip[:, k].max() <= most[0]
    for a in range(0, 400, 23):
        score = points @ points[a]
        for same_label in (True, False):
            fits = [i for i in range(400) if i != a and (labels[i] == labels[a]) == same_label]
            for low, high in ((None, None), (-500, 800), (0, 0), (100, 60_000)):
                want = sorted((-int(score[i]), i) for i in fits if (low is None or low <= score[i] <= high))[:7]
                best = Best(7, low, high)
                descend(tree, points[a], a, int(labels[a]), same_label, [best], leaves=3)
                assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want


def test_bounds_spare_most_rows_of_clustered_vectors():
    r = np.random.default_rng(7)
    middle = r.normal(size=(40, 16)) * 400
    points = (np.repeat(middle, 50, 0) + r.normal(size=(2000, 16)) * 20).astype(np.int64)
    tree = Tree.build(np.arange(2000), np.zeros(2000, np.int64), points)
    done = descend(tree, points[0], 0, 0, True, [Best(5)])
    assert done < 500


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_query_is_brute_force(spark, seed):
    rows = odd(vectors(seed, 300))
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, rank string").repartition(3)
    # 3e38 scaled has a squared length beyond a long, so it takes no part
    want = brute([r for r in rows if r[0] != 1009], lambda i: i % 20 == 0)
    got = mine(df, anchors=F.col("id") % 20 == 0, shard=64, chunk_bytes=4000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_query_is_its_sql(spark):
    same(queries.op12(spark, SF), queries.oracle_sql()["op12_negatives"])


def test_empty_and_all_null_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, None, 1), (100, [1.0], None)], [(1, [1.0], 1)], [(0, [1.0], 1)]):
        assert mine(spark.createDataFrame(rows, schema)).collect() == []
