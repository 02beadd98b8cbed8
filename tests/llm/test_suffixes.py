"""Removal of repeated byte strings, held against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sprocket.llm import suffixes
from sprocket.llm.suffixes import BLOCK, Shard, dedup, digests, merge, repeated, strings_of, symbols, without_repeats


def brute(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def corpus(seed: int, n: int = 60) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    texts: list = [None, "", "a", "x" * 300, "xy" * 200, "xyz" * 80 + "q"]
    while len(texts) < n:
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        t = " ".join(parts)
        if r.random() < 0.3 and texts[-1]:
            t = texts[-1] if r.random() < 0.5 else texts[-1][: len(texts[-1]) // 2] + "!" + texts[-1][len(texts[-1]) // 2 :]
        texts.append(t)
    return texts


def expected(rows: list[tuple], length: int) -> list[tuple]:
    raw = [(t or "").encode() for _, t in rows]
    return sorted(((i, len(b), int(g.sum()), sum(1 for _ in suffixes.runs(g)), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()) for (i, _), b, g in zip(rows, raw, brute(raw, length), strict=True)), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_are_those_of_all_pairs(seed):
    texts = [t.encode() for t in corpus(seed, 25) if t]
    for n in (1, 2, 3):
        length = n * BLOCK
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [x.tolist() for x in repeated(texts, length, shard=700)] == want


def test_the_interleave_keeps_the_order_of_every_shard_and_sorts_the_whole():
    texts = [t.encode() for t in corpus(9, 30) if t and len(t) > 50]
    joined = np.frombuffer(b"|".join(texts) + bytes(BLOCK + 1), np.uint8)  # a byte between two texts, so that no end is a start
    code = symbols(joined, BLOCK)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = ends - np.array([len(t) for t in texts])
    half = len(texts) // 2
    shards = [Shard(code, starts[:half], ends[:half], BLOCK), Shard(code, starts[half:], ends[half:], BLOCK)]
    at = np.concatenate([s.suffixes for s in shards])
    end = {int(p): int(e) for s, e in zip(starts, ends, strict=True) for p in range(s, e + 1)}
    key = lambda p: [int(code[q]) for q in range(p, end[p] - BLOCK + 1, BLOCK)]
    for s in shards:
        keys = [key(int(p)) for p in s.suffixes]
        assert keys == sorted(keys)
    for n, (order, interval) in enumerate(merge(shards, 3), 1):
        keys = [key(int(p))[:n] for p in at[order]]
        assert keys == sorted(keys)
        assert [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(interval.tolist(), interval.tolist()[1:])]
        for k in set(interval.tolist()):
            inside = order[interval == k]
            for first, last in ((0, len(shards[0].bwt)), (len(shards[0].bwt), len(at))):
                own = inside[(inside >= first) & (inside < last)]
                assert (np.diff(own) > 0).all()


def test_windows_belong_to_one_string_each(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 128)
    text = ("".join(random.Random(3).choice("ab") for _ in range(900)) + "z" * 600).encode()
    covered = sorted(p for _, s, w, _ in strings_of(text, 80, 16, 50) for p in range(s, s + w))
    assert covered == list(range(len(text) - 79))


@pytest.mark.parametrize(("seed", "bucket"), [(1, 2_000_000), (2, 3000), (3, 200)])
def test_whole_query_is_brute_force(spark, seed, bucket):
    rows = [(None if i == 7 else i % 50, t) for i, t in enumerate(corpus(seed))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, m int")
    got = sorted((tuple(r) for r in dedup(df, length=80, gram=16, bucket=bucket).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == expected(rows, 80)
    assert any(0 < r[2] < r[1] for r in got)


def test_the_length_of_the_query_and_an_empty_table(spark):
    r = random.Random(5)
    word = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = word(80)
    rows = [(1, word(30) + passage + word(70)), (2, word(100) + passage[:400]), (3, passage[1:400] + "Z" + word(5)), (4, word(200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in dedup(df).collect()), key=repr) == expected(rows, 400)
    assert dedup(df.limit(0)).collect() == []


def test_the_operator_returns_the_bytes_that_are_left_and_the_runs_that_are_not(spark):
    rows = list(enumerate([*corpus(6, 40), "é" * 150, "a" + "é" * 150]))  # runs that begin within a character, too
    done = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=80, gram=16, bucket=3000)
    got = {r.doc_id: r for r in done.collect()}
    raw = [(t or "").encode() for _, t in rows]
    assert len(got) == len(rows)
    for (i, _), b, gone in zip(rows, raw, brute(raw, 80), strict=True):
        assert [tuple(s) for s in got[i].spans] == list(suffixes.runs(gone))
        assert bytes(got[i].kept) == bytes(np.frombuffer(b, np.uint8)[~gone])
    texts = {r.doc_id: r.spans for r in digests(done).collect()}
    assert all(texts[i] == ",".join(f"{lo}:{hi}" for lo, hi in got[i].spans) for i in got)
    assert any(len(r.spans) > 1 and r.kept for r in got.values())
