"""Importance resampling against SQL and against a plain count of every n-gram."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from oracle import SF, same
from sprocket.llm import queries, resampling
from sprocket.llm.resampling import Features, counts, portions, resample


def grams(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, least=20, percent=5):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(zlib.crc32(g) % buckets for g in grams(x))
    for x in target:
        t.update(zlib.crc32(g) % buckets for g in grams(x))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, x in rows:
        g = grams(x)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in g)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        words = sum(b" " not in f for f in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(seed: int, n: int) -> list:
    r = random.Random(seed)
    words = ["Ab", "aB", "ÄB", "x1", "été", "Z", "日本", "a_b", "q@r", "\x7f", "--", "mm mm", "\x00k"]
    texts = [None, "", "  ", "one", "One two", "a.b.c"]
    while len(texts) < n:
        texts.append(r.choice([" ", ", ", "\n", "--"]).join(r.choice(words) for _ in range(r.randint(1, 90))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result_is_brute_force(spark, seed):
    texts = corpus(seed, 120)
    rows = [(None if i == 9 else i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (30, texts[30]), (30, texts[30])]
    target = corpus(seed + 50, 12)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, score string, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    # pieces so small that texts are cut between words
    got = sorted((tuple(r) for r in resample(docs, bench, piece=40, percent=20).collect()), key=repr)
    assert got == brute(rows, target, percent=20)


def test_pieces_count_every_feature_once():
    texts = pa.array([None, "", "a b c d e f g h", "aa", "x " * 50, "one-long-word" * 20, "q" * 100], pa.string())
    whole = Features(texts, np.zeros(len(texts), np.int64)).counts(997)
    assert whole.sum() == sum(len(grams(t)) for t in texts.to_pylist())
    for piece in (1, 3, 7, 20, 1000):
        assert sum(Features(t, c).counts(997) for _, t, c in portions(texts, piece)).tolist() == whole.tolist()


def test_query_is_its_sql(spark):
    same(queries.op11(spark, SF), queries.oracle_sql()["op11_importance"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample(none, none).collect() == []
    assert counts(none).collect() == []
    assert [tuple(r)[:3] for r in resample(some, none).collect()] == [(1, 3, sum(resampling.gains(counts(some), counts(none))[zlib.crc32(g) % 10_000] for g in grams("a b")))]
