"""Removal of byte strings that occur twice: Burrows-Wheeler transforms of shards, merged by interleave refinement.

Every window of `length` bytes belongs to the least hash of its grams, which depends on its bytes only, so equal windows meet wherever they stand. Consecutive windows with the same least hash are one string; strings whose hash no other has cannot hold a repeat and go no further, and equal strings are kept once with their number. The rest is dealt out by hash into buckets of bounded size. In a bucket the strings are cut into shards; each shard's suffixes are sorted once and give its transform, over an alphabet of blocks of BLOCK bytes (the symbol of a suffix is the block before it). The transforms are then merged as Holt and McMillan do: a round reads the symbols in the order so far and places each suffix behind those with the same symbol, which orders all suffixes by one more block; a place where two neighbours part in round j says that their common prefix has j blocks. After length / BLOCK rounds the intervals that are still whole are the repeated windows. No two suffixes of different shards are ever compared.

Cases: a null text is empty; texts shorter than a window keep everything; equal texts, rows and ids are separate occurrences, so each copy loses what the other has; a null id is an id like any other; an empty table gives an empty result; other columns of the table are not looked at. A text of any length is read in pieces of PIECE windows; its list of strings lies in one row, as the text does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of a gram whose hash deals windows out, and of a symbol of the transforms.
GRAM, BLOCK = 32, 40
#: Windows of a piece of a text, and at most in a string.
PIECE, RUN = 1 << 18, 512
#: Bytes of the strings of a bucket and of a shard; a hash whose strings have more than a bucket's is decided window by window.
BUCKET, SHARD = 2_000_000, 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every gram, least hash of every window); gram is a power of two below length."""
    h, step, n = b.astype(np.uint64) + np.uint64(1), _ODD, 1
    while n < gram:
        h = h[:-n] * step + h[n:]
        step, n = step * step, 2 * n
    h = _mixed(h)
    m, wide, n = h, length - gram + 1, 1
    while 2 * n <= wide:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return h, np.minimum(m[: len(m) - (wide - n)], m[wide - n :]) if wide > n else m


def strings_of(text: bytes, length: int, gram: int = GRAM, run: int = RUN) -> Iterator[tuple[int, int, int, bool]]:
    """(least hash, start, windows, whether the hash stands twice in it) of the strings of a text."""
    whole = np.frombuffer(text, np.uint8)
    with np.errstate(over="ignore"):
        for at in range(0, len(whole) - length + 1, PIECE):
            h, m = least(whole[at : at + PIECE + length - 1], length, gram)
            m = m[:PIECE]
            cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(m)], strict=True):
                # consecutive grams that match count, too: the string then overlaps itself
                twice = int(np.count_nonzero(h[i : j + length - gram] == m[i])) > 1
                for k in range(i, j, run):
                    yield int(m[i].view(np.int64)), at + k, min(run, j - k), twice


def _scan(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "m", "digest", "start", "windows", "twice"]
        types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for cell in batch.column(0):
                text = cell.as_py()
                if len(text) < length:
                    continue
                key = hashlib.sha256(text).digest()
                for m, start, windows, twice in strings_of(text, length, gram):
                    for column, value in zip(out, (key, m, xxhash.xxh3_128_digest(text[start : start + windows + length - 1]), start, windows, twice), strict=True):
                        column.append(value)
                    if len(out[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                        out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return scan


def symbols(text: np.ndarray, block: int) -> np.ndarray:
    """A number for the block that starts at each byte, equal exactly where the blocks are; block is a multiple of 8."""
    w, n = text.astype(np.uint64), 1
    while n < 8:
        w, n = (w[:-n] << np.uint64(8 * n)) | w[n:], 2 * n
    words = [w[k : len(text) - block + 1 + k] for k in range(0, block, 8)]
    step = _ODD
    while True:
        with np.errstate(over="ignore"):
            h = words[0]
            for x in words[1:]:
                h = _mixed(h * step + x)
        order = np.argsort(h)
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if all(np.array_equal(*(x[order][k] for k in (np.flatnonzero(~new), np.flatnonzero(~new) - 1))) for x in words):
            code = np.empty(len(h), np.int64)
            code[order] = np.cumsum(new) - 1
            return code
        step += np.uint64(2)  # two blocks had one hash


def stable_order(key: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of keys from 0 to limit: sorted together with their places where both fit a number."""
    bits = max(1, len(key)).bit_length()
    if limit.bit_length() + bits <= 63:
        return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


class Shard:
    """The sorted suffixes of some strings and their transform. A suffix is where it starts; a string of n bytes has n + 1, the last `block` of them end it without a whole block."""

    def __init__(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int):
        self.block = block
        sizes = ends - starts + 1
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        left, right = np.repeat(starts, sizes), np.repeat(ends, sizes)
        whole = at + block <= right
        rank = np.zeros(len(at), np.int64)
        rank[whole] = code[at[whole]] + 1
        blocks, most = 1, int(sizes.max()) // block + 1
        order = stable_order(rank, int(rank.max())) if most == 1 else rank
        while blocks < most:  # ranks by twice as many blocks, up to the end of the string, which comes first
            n = blocks * block
            next_rank = np.zeros(len(at), np.int64)
            inside = np.flatnonzero(at + n <= right)
            next_rank[inside] = rank[inside + n] + 1
            width = int(next_rank.max()) + 1
            key = rank * width + next_rank
            order = stable_order(key, (int(rank.max()) + 1) * width)
            key = key[order]
            places = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank[order] = places
            if places[-1] == len(at) - 1:
                break  # all differ
            blocks *= 2
        self.suffixes = at[order]
        back = np.empty(len(at), np.int64)
        back[order] = np.arange(len(at))
        #: how far each suffix begins from the head of its string
        self.offsets = self.suffixes - left[order]
        before = self.offsets >= block
        #: the symbol before each suffix in sorted order, -1 at the head of a string, and where the suffix that starts there is
        self.bwt = np.full(len(at), -1, np.int64)
        self.bwt[before] = code[self.suffixes[before] - block]
        self.steps = np.zeros(len(at), np.int64)
        self.steps[before] = back[order[before] - block]


def merge(shards: list[Shard], rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each round the suffixes, numbered through the shards, in merged order by so many blocks, and the number of the interval each is in. Left out are suffixes from which the last round is not reached: those too near to the head of their string, and intervals of one suffix, as what precedes them stays alone, too."""
    first = np.cumsum([0, *(len(s.bwt) for s in shards)])
    bwt = np.concatenate([s.bwt for s in shards])
    steps = np.concatenate([s.steps + n for s, n in zip(shards, first[:-1], strict=True)])
    # the interleave before the first round: shard after shard, one interval
    order = np.flatnonzero(np.concatenate([s.offsets for s in shards]) >= rounds * shards[0].block)
    interval = np.zeros(len(order), np.int64)
    for _ in range(rounds):
        sym = bwt[order]
        place = stable_order(sym, int(sym.max(initial=0)))
        order, sym, interval = steps[order[place]], sym[place], interval[place]
        parts = np.ones(len(order), bool)
        parts[1:] = (sym[1:] != sym[:-1]) | (interval[1:] != interval[:-1])
        # a suffix is alone if an interval begins with it and with the next
        alone = parts.copy()
        alone[:-1] &= parts[1:]
        interval = np.cumsum(parts)
        order, interval = order[~alone], interval[~alone]
        yield order, interval


def repeated(texts: list[bytes], length: int, block: int = BLOCK, shard: int = SHARD) -> list[np.ndarray]:
    """For each text and each window of it, whether its bytes start anywhere else in the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    joined = np.frombuffer(b"".join(texts) + bytes(block), np.uint8)
    code = symbols(joined, block)
    group = starts // shard
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
    shards = [Shard(code, starts[i:j], ends[i:j], block) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    suffixes = np.concatenate([s.suffixes for s in shards])
    *_, (order, _) = merge(shards, length // block)
    out = np.zeros(len(joined), bool)
    out[suffixes[order]] = True
    return [out[s : max(s, e - length + 1)] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def runs(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal runs of True, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


_HITS = "m long, digest binary, spans array<struct<lo:int,hi:int>>"


def _bucket(length: int):
    def bucket(group: pa.Table) -> pa.Table:
        texts, many = group.column("bytes").to_pylist(), group.column("n").to_pylist()
        spans = []
        for hit, n in zip(repeated(texts, length), many, strict=True):
            spans.append([{"lo": lo, "hi": hi + length - 1} for lo, hi in runs(hit | (n > 1))])
        out = pa.table({"m": group.column("m"), "digest": group.column("digest"), "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))})
        return out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return bucket


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(0, batch.num_rows, 64):
        yield from batch.slice(k, 64).to_pylist()


def _cut(length: int, windows: bool):
    """Strings from their texts; with windows, a digest of every window instead."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("m", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), *([("at", pa.int32()), ("window", pa.binary())] if windows else [("bytes", pa.binary())])])
        for batch in batches:
            rows, size = [], 0
            for row in _rows(batch):
                for s in row["strings"]:
                    piece = row["text"][s["start"] : s["start"] + s["windows"] + length - 1]
                    if windows:
                        rows += [{"m": s["m"], "digest": s["digest"], "n": s["n"], "at": k, "window": xxhash.xxh3_128_digest(piece[k : k + length])} for k in range(s["windows"])]
                    else:
                        rows.append({"m": s["m"], "digest": s["digest"], "n": s["n"], "bytes": piece})
                    size += len(piece)
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return cut


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of bytes that a text's spans cover, in order, and the bytes that are left."""
    run = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    for batch in batches:
        schema = pa.schema([batch.schema.field("doc_id"), ("spans", pa.list_(run)), ("kept", pa.binary())])
        rows, size = [], 0
        for row in _rows(batch):
            covered: list[dict] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in row["spans"] or ()):
                if covered and lo <= covered[-1]["hi"]:
                    covered[-1]["hi"] = max(covered[-1]["hi"], hi)
                else:
                    covered.append({"lo": lo, "hi": hi})
            heads, tails = [0, *(r["hi"] for r in covered)], [*(r["lo"] for r in covered), len(row["text"])]
            kept = b"".join(row["text"][lo:hi] for lo, hi in zip(heads, tails, strict=True)) if covered else row["text"]
            rows.append({"doc_id": row["doc_id"], "spans": covered, "kept": kept})
            size += len(kept)
            if size > 1_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def hits_of(strings: DataFrame, texts: DataFrame, length: int, bucket: int = BUCKET) -> DataFrame:
    """(m, digest, spans): of each string the byte ranges that repeated windows cover. strings: m, digest, n and where one of them stands (key, start, windows); texts: key, text, strings."""
    weight = strings.groupBy("m").agg(F.sum(F.col("windows") + length - 1).alias("size"))
    heavy = written(weight.filter(F.col("size") > bucket).select("m"), "suffixes-heavy")
    some = not heavy.isEmpty()
    total = weight.agg(F.sum("size")).first()[0] or 0
    within = texts
    if some:
        # these hashes' windows are counted by digests, dealt out evenly; so they need no bucket
        marked = texts.select("key", F.explode("strings").alias("s")).select("key", "s.*")
        split = lambda how: marked.join(heavy, "m", how).groupBy("key").agg(F.collect_list(F.struct("m", "digest", "n", "start", "windows")).alias("strings"))
        within = texts.drop("strings").join(split("left_anti"), "key")
    cut = within.select("text", "strings").mapInArrow(_cut(length, False), "m long, digest binary, n long, bytes binary")
    buckets = int(total // bucket) + 1
    hits = cut.withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket(length), _HITS)
    if some:
        each = written(texts.drop("strings").join(split("left_semi"), "key").select("text", "strings").mapInArrow(_cut(length, True), "m long, digest binary, n long, at int, window binary"), "suffixes-windows")
        often = each.groupBy("window").agg(F.sum("n").alias("k")).filter("k > 1").select("window")
        spans = each.join(often, "window").groupBy("m", "digest").agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))).alias("spans"))
        hits = hits.unionByName(spans)
    return hits


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, spans (the maximal runs of removed bytes, lo and hi, in order) and kept (the bytes that are left), after every byte is removed that a string of length bytes covers which also starts elsewhere. length is a multiple of BLOCK. What repeats depends on a text alone, so equal texts are read once, under their digest."""
    if length % BLOCK or gram >= length:
        raise ValueError(f"length must be a multiple of {BLOCK} above the gram's")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key = F.unhex(F.sha2(body, 256))
    strings = written(docs.select(body.alias("text")).mapInArrow(_scan(length, gram), "key binary, m long, digest binary, start long, windows int, twice boolean"), "suffixes-strings")
    met = strings.groupBy("m").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).filter("k > 1 or twice").select("m")
    found = written(strings.drop("twice").join(met, "m"), "suffixes-found")
    one = written(found.groupBy("m", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows")).alias("at")).select("m", "digest", "n", "at.*"), "suffixes-distinct")
    to_cut = one.groupBy("key").agg(F.collect_list(F.struct("m", "digest", "n", "start", "windows")).alias("strings"))
    texts = written(docs.select(key.alias("key"), body.alias("text")).filter(F.length("text") >= length).dropDuplicates(["key"]).join(to_cut, "key"), "suffixes-texts")
    hits = written(hits_of(one, texts, length, bucket), "suffixes-hits")
    spans = (
        found.join(hits, ["m", "digest"])
        .select("key", "start", F.explode("spans").alias("s"))
        .select("key", F.struct((F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi")).alias("span"))
        .groupBy("key")
        .agg(F.collect_set("span").alias("spans"))
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(written(spans, "suffixes-spans"), "key", "left").select("doc_id", "text", "spans").mapInArrow(_left, f"doc_id {kind}, spans array<struct<lo:long,hi:long>>, kept binary")


def digests(left: DataFrame) -> DataFrame:
    """Of the rows of without_repeats: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans as text, lo:hi joined by commas."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.hi - s.lo)
    return left.select(
        "doc_id",
        (F.length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.lo, s.hi)), ",").alias("spans"),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """The numbers and digests of without_repeats."""
    return digests(without_repeats(docs, doc_id, text, length, gram, bucket)).drop("spans")
