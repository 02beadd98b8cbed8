"""Links of the Jaccard join where common hashes decide which part of a set is counted."""

import random

import numpy as np
import pytest

from sprocket.llm import jaccard
from sprocket.llm.jaccard import join, shingles


def brute(rows, k, percent):
    sets = [frozenset(shingles(t, k).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by: dict = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for h in s for j in by[h] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(spark, rows, k, percent):
    return sorted(tuple(r) for r in join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, percent=percent).collect())


@pytest.mark.parametrize("percent", [85, 80])
def test_hashes_that_are_common_beyond_the_kept_part_only(spark, percent):
    """Six hashes of two similar texts are common at once; three more lie, in other texts, behind ten common ones."""
    words = sorted((f"w{i}" for i in range(2000)), key=lambda w: int(shingles(w, 1)[0]))
    early, c1, c2, own, shared, rest = words[:14], words[14:20], words[20:23], words[23:25], words[25:35], words[35:]
    rows = [(1, " ".join([*c1, *c2, own[0], *shared])), (2, " ".join([*c1, *c2, own[1], *shared]))]
    free = iter(rest)
    rows += [(100 + i, " ".join([*early, *c2, *(next(free) for _ in range(9))])) for i in range(60)]
    rows += [(200 + i, " ".join([*c1, *(next(free) for _ in range(9))])) for i in range(60)]
    want = brute(rows, 1, percent)
    assert want[:2] == [(1, 20, 1), (2, 20, 1)]
    assert got(spark, rows, 1, percent) == want


@pytest.mark.parametrize(("k", "percent", "seed"), [(1, 85, 1), (4, 85, 2), (5, 80, 3), (1, 80, 4)])
def test_low_bounds_lose_no_link(spark, monkeypatch, k, percent, seed):
    for name, value in (("OFTEN", 3), ("COMMON", 12), ("SHORT", 4), ("TILE", 5)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(seed)
    often = [f"c{i}" for i in range(15)]
    rows = []
    for i in range(140):
        if rows and r.random() < 0.6:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"x{r.randrange(300)}"
            w = w[: len(w) - r.randint(0, 1)] or ["a"]
        else:
            w = [r.choice(often) if r.random() < 0.5 else f"x{r.randrange(300)}" for _ in range(r.randint(1, 60))]
        rows.append((i, " ".join(w)))
    want = brute(rows, k, percent)
    assert len({c for _, _, c in want}) < len(rows)
    assert got(spark, rows, k, percent) == want


def test_prefixes_share_a_hash_in_any_order():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 60, 40).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) < 0.95], r.integers(0, 60, 1).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            common = np.unique(r.integers(0, 60, 25).astype(np.uint64))
            assert len(np.intersect1d(jaccard.ordered_prefix(a, common, 80), jaccard.ordered_prefix(b, common, 80)))


def test_what_is_beyond_the_count_is_told():
    s = np.arange(100, dtype=np.uint64)
    size = int(jaccard.prefix_length(100, 85))
    near = size + size // 2 + 4
    some = lambda n: np.arange(n, dtype=np.uint64)
    assert not jaccard.beyond_count(s, some(0), some(near - size), 85)
    assert jaccard.beyond_count(s, some(0), some(near - size + 1), 85)
    assert jaccard.beyond_count(s, some(near - size), some(near - size + 1), 85)
    # counted as a whole by the second count
    assert not jaccard.beyond_count(s, some(near - size + 1), some(near), 85)
    assert not jaccard.beyond_count(s[:near], some(0), some(near), 85) or int(jaccard.prefix_length(near, 85)) < size
