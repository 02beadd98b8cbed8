"""Packing token sequences by non-negative least squares (operator 1).

A document's tokens (and a closing id 0) are cut at multiples of the window; whole
windows are sequences of their own. What is left, the tails, is described by a
histogram of at most window - 1 lengths. All combinations of up to three lengths that
fill a window exactly are enumerated, repeat counts are solved against the histogram by
non-negative least squares (coordinate steps on disjoint combinations, heavier weight on
long tails), rounded, and carried out. The rest is packed greedily, longest first, on
the histogram; what no combination fills to within SLACK tokens is laid end to end
and cut at the window's border, so that only the very last sequence is padded.

Only the histogram reaches the driver. Tails find their place by their rank among tails
of equal length, which is counted in two levels (buckets, then within a bucket), so a
length that a third of all documents share is dealt out over many tasks.

Defined cases: a null text is empty and so one id, the closing 0; repeated rows and
repeated ids are documents of their own; an empty table gives an empty result; other
columns are not carried, so none can clash.
"""

from __future__ import annotations

import base64
import importlib
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WINDOW = 1024
#: A greedy combination may leave so many tokens of a window empty.
SLACK = 2
#: Tails of one length and bucket that a task ranks, about.
PER_BUCKET = 200_000
LOOK_AHEAD = r"|\s+(?!\S)"
DOUBLE = re.compile(r"\s\s")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public tokenizer's file, on the machine that calls it."""
    return importlib.import_module("public_tokenizers").path(name)


class Tokens:
    """Ids as little-endian unsigned 32-bit bytes. Strings that the vocabulary adds (its special tokens) are ids of their own wherever they stand in a text. The vocabulary's pattern needs its look-ahead only where white space follows white space; other texts are split by the plain pattern, which gives the same pieces faster."""

    def __init__(self, name: str) -> None:
        import tiktoken

        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary(name.replace(".tiktoken", ".json")), encoding="utf-8") as f:
            self._added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self._split = re.compile("|".join(re.escape(x) for x in sorted(self._added, key=len, reverse=True))) if self._added else None
        pattern = importlib.import_module("public_tokenizers").PATTERN
        self._plain, self._full = (tiktoken.Encoding(k, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for k, p in (("plain", pattern.replace(LOOK_AHEAD, "")), ("full", pattern)))

    def _ids(self, text: str) -> list[int]:
        return (self._full if DOUBLE.search(text) else self._plain)(text)

    def __call__(self, text: str) -> bytes:
        if self._split and self._split.search(text):
            ids, at = array("I"), 0
            for m in self._split.finditer(text):
                ids.extend([*self._ids(text[at : m.start()]), self._added[m[0]]])
                at = m.end()
            ids.extend(self._ids(text[at:]))
        else:
            ids = array("I", self._ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def tokenize(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """keep, doc_tokens, crcs (of the whole windows), tail (the ids left over, 32-bit) and tail_crc."""
    fields = [df.schema[c] for c in keep]
    out = T.StructType([*fields, T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType()), T.StructField("tail_crc", T.LongType())])
    held: list[Tokens] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Tokens(name))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, crcs, tails, tail_crcs = [], [], [], []
                for t in part.column(len(keep)).to_pylist():
                    ids = held[0](t or "") + b"\0\0\0\0"
                    full = len(ids) // (4 * window) * 4 * window
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[k : k + 4 * window]) for k in range(0, full, 4 * window)])
                    tails.append(ids[full:])
                    tail_crcs.append(zlib.crc32(ids[full:]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(tail_crcs, pa.int64())], names=out.names)

    return df.select(*keep, text).mapInArrow(run, out)


# ------------------------------------------------------------------- the plan


@dataclass
class Plan:
    """For each length, runs of ranks: from `first` on, `each` tails of it go into every sequence from `sequence` on, at `offset` and steps of the length. Ranks from loose[length] on are laid end to end from position `start[length]` of the sequences after `stream`."""

    window: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    loose: dict[int, int] = field(default_factory=dict)
    start: dict[int, int] = field(default_factory=dict)
    stream: int = 0
    sequences: int = 0


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c, all in lengths (c or b may be 0) and a + b + c = window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    out = []
    for a in sorted((int(x) for x in lengths), reverse=True):
        b = np.arange(-(-(window - a) // 2), min(a, window - a) + 1)
        c = window - a - b
        ok = have[b] & have[c] & ((b > 0) | (c == 0))
        if ok.any():
            out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve(combos: np.ndarray, counts: np.ndarray, window: int, rounds: int = 80, at_once: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that nearly minimise the weighted squares of counts - demand: exact coordinate steps, each round on combinations that share no length."""
    weight = (np.arange(window + 1) / window + 0.05) ** 2
    weight[0] = 0.0
    a, b, c = combos.T
    # squared norm of each column, by how often it uses a length
    norm = weight[a] * (1 + 2 * (a == b)) + weight[b] * (1 + 2 * (b == c)) + weight[c]
    norm = np.where((a == b) & (b == c), 9 * weight[a], norm)
    x, left = np.zeros(len(combos)), counts.astype(np.float64).copy()
    for _ in range(rounds):
        pull = weight[a] * left[a] + weight[b] * left[b] + weight[c] * left[c]
        step = np.maximum(pull / norm, -x)
        gain = step * (2 * pull - step * norm)
        top = np.argpartition(-gain, min(at_once, len(gain) - 1))[:at_once]
        top = top[np.argsort(-gain[top], kind="stable")]
        if gain[top[0]] < 1e-6:
            break
        used: set[int] = set()
        for k in top:
            parts = {int(v) for v in combos[k] if v}
            if gain[k] > 0 and used.isdisjoint(parts):
                used |= parts
                x[k] += step[k]
                for v in combos[k]:
                    left[v] -= step[k]
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> Plan:
    """Where the tails of each length go."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        if 0 < length < window:
            counts[length] = n
    left, out = counts.copy(), Plan(window)

    def put(parts: list[int], times: int) -> None:
        at = 0
        for length in dict.fromkeys(parts):
            each = parts.count(length)
            out.runs.setdefault(length, []).append((int(counts[length] - left[length]), each, out.sequences, at))
            left[length] -= each * times
            at += each * length
        out.sequences += times

    def fits(parts: list[int]) -> int:
        return min(int(left[length]) // parts.count(length) for length in set(parts))

    combos = combinations(np.flatnonzero(counts), window)
    if len(combos):
        x = np.rint(solve(combos, counts, window)).astype(np.int64)
        for k in sorted(np.flatnonzero(x), key=lambda k: (-x[k], k)):
            parts = [int(v) for v in combos[k] if v]
            if (times := min(int(x[k]), fits(parts))) > 0:
                put(parts, times)
    for length in range(window - 1, 0, -1):
        while left[length] > 0:
            parts, room = [length], window - length
            while room > 0:
                free = left[: room + 1].copy()
                for v in parts:
                    if v <= room:
                        free[v] -= 1
                fit = np.flatnonzero(free > 0)
                if not len(fit):
                    break
                parts.append(int(fit[-1]))
                room -= parts[-1]
            if room > slack:
                break  # what is left of this length is laid end to end
            put(parts, fits(parts))
    at = 0
    out.stream = out.sequences
    for length in range(window - 1, 0, -1):
        if left[length]:
            out.loose[length], out.start[length] = int(counts[length] - left[length]), at
            at += int(left[length]) * length
    out.sequences += -(-at // window)
    return out


class Placer:
    """Pieces (from, length, sequence, offset) of the tail of a given length and rank."""

    def __init__(self, p: Plan) -> None:
        self.p = p
        self.firsts = {k: np.array([r[0] for r in v]) for k, v in p.runs.items()}

    def __call__(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        p = self.p
        loose = p.loose.get(length)
        if loose is not None and rank >= loose:
            at, end, out = p.start[length] + (rank - loose) * length, 0, []
            while end < length:
                n = min(p.window - at % p.window, length - end)
                out.append((end, n, p.stream + at // p.window, at % p.window))
                at, end = at + n, end + n
            return out
        first, each, sequence, offset = p.runs[length][int(np.searchsorted(self.firsts[length], rank, "right")) - 1]
        k = rank - first
        return [(0, length, sequence + k // each, offset + k % each * length)]


def pack(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # a written table: the row's own number is made once and then stays
    t = tokenize(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ("doc_id",), window, name)
    t = written(t.withColumn("row", F.monotonically_increasing_id()), "tokens")
    tails = t.select("row", "doc_id", "doc_tokens", "tail_crc", (F.col("doc_tokens") % window).cast("int").alias("tail_len"), F.floor(F.col("doc_tokens") / window).cast("long").alias("full"))
    rows = tails.groupBy("tail_len").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # at most `window` rows
    hist = {r["tail_len"]: r["n"] for r in rows}
    p = plan(hist, window)

    # ranks among tails of equal length, and a number for each whole window, in two levels
    buckets = max(8, sum(hist.values()) // PER_BUCKET)
    tails = tails.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("long"))
    inner = W.partitionBy("tail_len", "bucket").orderBy("doc_id", "row")
    ranked = tails.select("*", (F.row_number().over(inner) - 1).cast("long").alias("k"), (F.sum("full").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("full")).alias("fk"))
    outer = W.partitionBy("tail_len").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = tails.groupBy("tail_len", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    offsets = offsets.select("tail_len", "bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"), F.coalesce(F.sum("f").over(outer), F.lit(0)).alias("fbefore"))
    base, at = {}, p.sequences
    for r in sorted(rows, key=lambda r: r["tail_len"]):
        base[r["tail_len"]] = at
        at += r["full"]
    ranked = ranked.join(offsets, ["tail_len", "bucket"]).select("row", "doc_id", "doc_tokens", "tail_crc", "tail_len", "full", (F.col("k") + F.col("before")).alias("rank"), (F.col("fk") + F.col("fbefore")).alias("first"))
    placed = written(_placed(ranked, p), "placed")

    whole = t.join(placed.filter("full > 0").select("row", "first", "tail_len"), "row").select("doc_id", "doc_tokens", "tail_len", "first", F.posexplode("crcs").alias("i", "crc"))
    first = F.element_at(F.create_map(*[F.lit(v) for kv in base.items() for v in kv]), F.col("tail_len")) if base else F.lit(0)
    whole = _piece(whole, F.col("i") * window, F.lit(window), F.col("crc"), first + F.col("first") + F.col("i"), F.lit(0))
    uncut = placed.filter(F.size("pieces") == 1).select("*", F.col("pieces")[0].alias("x"))
    uncut = _piece(uncut, F.col("full") * window, F.col("tail_len"), F.col("tail_crc"), F.col("x.sequence"), F.col("x.offset"))
    cut = placed.filter(F.size("pieces") > 1).join(t.select("row", "tail"), "row").select("*", F.explode("pieces").alias("x"))
    ids = F.substring(F.col("tail"), 4 * F.col("x.from") + 1, 4 * F.col("x.length"))
    cut = _piece(cut, F.col("full") * window + F.col("x.from"), F.col("x.length"), F.crc32(ids), F.col("x.sequence"), F.col("x.offset"))
    return whole.unionByName(uncut).unionByName(cut)


def _piece(df: DataFrame, start: Column, length: Column, crc: Column, sequence: Column, offset: Column) -> DataFrame:
    return df.select("doc_id", start.cast("long").alias("start"), length.cast("long").alias("length"), crc.cast("long").alias("ids_crc32"), "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _placed(ranked: DataFrame, p: Plan) -> DataFrame:
    """ranked with the pieces of each tail."""
    piece = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("from", "length", "sequence", "offset")]))
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("from", "length", "sequence", "offset")]))
    names = ranked.columns
    sent = ranked.sparkSession.sparkContext.broadcast(p)  # bounded by the number of combinations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Placer(sent.value)
        for b in batches:
            lengths, ranks = b.column(names.index("tail_len")).to_pylist(), b.column(names.index("rank")).to_pylist()
            pieces = [[dict(zip(("from", "length", "sequence", "offset"), x, strict=True)) for x in place(n, k)] if n else [] for n, k in zip(lengths, ranks, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, kind)], names=[*names, "pieces"])

    return ranked.mapInArrow(run, T.StructType([*ranked.schema.fields, T.StructField("pieces", piece)]))
