"""Exact n-gram Jaccard join by size-banded tiles with hashed bitmap signatures (operator 5).

A text's set is its distinct word shingles, as 64-bit hashes. Texts with equal sets are
one node. In any one order of all hashes, two sets that reach the similarity share one
of their n - ceil(t n) + 1 first ones, so only nodes that meet in such a list are
compared; no list is dropped or cut. The order here is by hash, but for the hashes of
very many texts (`counted`), which come last: what a great number of texts share
says little, and would make long lists. Any choice of them gives the same result, as long
as the prefixes that are counted follow the same choice as those that are compared.

1. Every node meets in each of its FIRST first shared lists the list's leader (one pair a
   row). The links among these join most copies into components.
2. In lists where two components meet, pairs of different components remain. Of long
   lists each node's most promising pair is decided first, which joins most copies that
   are left; then all remaining pairs are. Short lists
   give pairs whose sizes and places in the order still allow the similarity. Long lists
   are dealt into tiles of about TILE nodes by a hash within a band of sizes, and pairs of
   tiles of the same or neighbouring bands are compared as numpy blocks: the bits that
   one signature has and the other lacks bound the overlap from above.
3. Pairs that the signatures allow are decided by intersecting the sorted arrays. The
   sets of those nodes alone are made again from their texts.

Links within a component that step 1 found are not looked for again: the components, and
with them every result, stay the same.

Defined cases: null text and text without words have the empty set, link with nothing
and are components of their own; fewer words than the shingle's are one shingle;
repeated rows and repeated ids are linked when their sets are not empty; a null id is
never the smallest if there is another; an empty table gives an empty result; other
columns are not carried, so none can clash.
Sets, and nodes, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

WORDS = 4
#: The similarity in hundredths.
PERCENT = 85
FIRST = 2
#: A hash in more texts than this may count as common; so many at most do, the most frequent.
OFTEN, COMMON = 48, 1_000_000
#: Nodes in a list up to which its pairs are made by a join, and about so many in a tile.
SHORT, TILE = 64, 1024
#: Needed nodes up to which their numbers (8 bytes each) are sent to all tasks; beyond, a join.
SENT = 2_000_000
#: Bytes of text hashed at once.
PART = 1 << 18

_R = np.random.default_rng(20_240_117)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(PART + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _long_word(word: bytes) -> np.ndarray:
    """The same hash for a word longer than a part."""
    total, up = 0, 1
    for at in range(0, len(word), PART):
        a = np.frombuffer(word, np.uint8, min(PART, len(word) - at), at)
        total += up * int((_BYTE[a] * _UP[: len(a)]).sum(dtype=np.uint64))
        up = up * pow(_BASE, PART, 2**64) % 2**64
    return _mixed(np.array([(total + len(word)) % 2**64], np.uint64))


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of lower-cased bytes: a polynomial in the words' bytes, which long texts get part by part."""
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        if end < len(raw):
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # a word longer than a part
                ends = [e for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := raw.find(c, end)) >= 0]
                stop = min(ends, default=len(raw))
                out.append(_long_word(raw[at:stop]))
                at = stop
                continue
            end = cut + 1
        a = np.frombuffer(raw, np.uint8, end - at, at)
        letter = ~_SPACE[a]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _UP[: len(a)], dtype=np.uint64)))
            out.append(_mixed((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    w = _word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(w):
        return w
    if len(w) < k:
        # so short a text is one shingle, and never equals one of k words
        return _mixed(np.array([(w * _MIX[32 : 32 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    h = w[: len(w) - k + 1] * _MIX[0]
    for i in range(1, k):
        h = h + w[i : len(w) - k + 1 + i] * _MIX[i]
    return np.unique(_mixed(h))


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """Hashes among which a similar set must have one, too."""
    return n + (-percent * n) // 100 + 1


def signature(s: np.ndarray) -> bytes:
    """A bitmap of four to eight bits for each element of the set, 512 at least; sizes of one band have one length or two, and longer ones fold onto shorter."""
    bits = max(512, 1 << int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits // 8, np.uint8)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap matrix folded to so many 64-bit words."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] | x[:, half:]
    return x


def enough(na: np.ndarray, nb: np.ndarray, both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether an overlap reaches the similarity."""
    return 100 * both >= percent * (na + nb - both)


def ordered_prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The set's first hashes in the order in which common ones come last."""
    size = int(prefix_length(len(s), percent))
    if not len(common):
        return s[:size]
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate((s[~last][:size], s[last]))[:size]


def _hashes(df: DataFrame, text: str, k: int, percent: int, common: np.ndarray | None) -> DataFrame:
    """(h) for counting. First, without common hashes: half as many again as each set's prefix. Then: all hashes of the sets whose prefixes those do not fill any more."""
    sent = df.sparkSession.sparkContext.broadcast(common)

    def chosen(t: str | None) -> np.ndarray:
        s = shingles(t, k)
        size = int(prefix_length(len(s), percent))
        near = s[: size + size // 2 + 4]
        if sent.value is None:
            return near
        c = sent.value
        if len(near) == len(s) or not len(c):
            return s[:0]
        known = int((c[np.minimum(np.searchsorted(c, near), len(c) - 1)] == near).sum())
        return s if len(near) - known < size else s[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                parts = [chosen(t) for t in b.column(0).slice(at, 500).to_pylist()]
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return df.select(text).mapInArrow(run, "h long, n long")


def counted(df: DataFrame, text: str, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The hashes of which the first count says that they are common; all that come last, at most 2 COMMON, with those that only the second count finds, sorted; and (h), every hash that may lie in the prefixes of two texts, some twice. A hash of the second count may be another text's in the first, where one was not kept."""
    first = written(_hashes(df, text, k, percent, None).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "counts")
    early = _often(first)
    second = written(_hashes(df, text, k, percent, early).groupBy("h").agg(F.sum("n").alias("n")), "counts")
    return early, np.union1d(early, _often(second)), first.select("h").union(second.select("h"))


def _often(counts: DataFrame) -> np.ndarray:
    top = counts.filter(F.col("n") > OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).select("h")
    return np.unique(top.toArrow().column(0).to_numpy().view(np.uint64))


def beyond_count(s: np.ndarray, early: np.ndarray, common: np.ndarray, percent: int) -> bool:
    """Whether a set's prefix leaves the part of it that has been counted: the second count left the set out, as enough of the part was rare, and of that too much is common now."""
    size = int(prefix_length(len(s), percent))
    near = s[: size + size // 2 + 4]
    if len(near) == len(s):
        return False
    rare = lambda c: len(near) - int((c[np.minimum(np.searchsorted(c, near), len(c) - 1)] == near).sum()) if len(c) else len(near)
    return rare(early) >= size > rare(common)


def signed(df: DataFrame, text: str, doc_id: str, k: int, percent: int, common: np.ndarray, early: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, node, prefix, bits, beyond): prefix as 64-bit numbers; beyond: whether it holds hashes that have not been counted. A node that a task has met before has them no second time: prefix is empty then, and bits null."""
    out = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("beyond", T.BooleanType())])
    sent = df.sparkSession.sparkContext.broadcast(common)
    # nothing is beyond the count if the second one has found nothing new
    before = df.sparkSession.sparkContext.broadcast(early if early is not None and len(early) < len(common) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, node, prefix, bits, beyond = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, k)
                    name = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                    new = name is not None and name not in met
                    if new and len(met) < 1_000_000:
                        met.add(name)
                    n.append(len(s))
                    node.append(name)
                    prefix.append(ordered_prefix(s, sent.value, percent).view(np.int64) if new else np.zeros(0, np.int64))
                    bits.append(signature(s) if new else None)
                    beyond.append(new and before.value is not None and beyond_count(s, before.value, sent.value, percent))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists, pa.array(bits, pa.binary()), pa.array(beyond, pa.bool_())], names=out.names)

    return df.select(doc_id, text).mapInArrow(run, out)


def sets_of(df: DataFrame, wanted: DataFrame, text: str, k: int) -> DataFrame:
    """(node, hashes): the sets of the wanted nodes (node, doc_id), made again from their texts."""
    wanted = written(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value if sent is not None else None
        done: set[int] = set()
        for b in batches:
            nodes, hashes = [], []
            col = b.column(0)
            if ids is not None:
                x = col.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
                rows = np.flatnonzero(ids[at] == x) if len(ids) else []
            else:
                rows = range(b.num_rows)
            texts = b.column(1)
            for r in rows:
                s = shingles(texts[int(r)].as_py(), k)
                raw = s.tobytes()
                node = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if len(s) else None
                if node is not None and node not in done:
                    if len(done) < 1_000_000:
                        done.add(node)
                    nodes.append(node)
                    hashes.append(raw)
                if len(nodes) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], names=["node", "hashes"])
                    nodes, hashes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    # by a hash, which a null id has, too
    keyed = df.select(F.xxhash64("doc_id").alias("_id"), text)
    if wanted.count() <= SENT:
        keys = wanted.select(F.xxhash64("doc_id").alias("k")).toArrow().column(0).to_numpy()
        sent = df.sparkSession.sparkContext.broadcast(np.unique(keys))
        src = keyed
    else:
        sent = None
        src = keyed.join(wanted.select(F.xxhash64("doc_id").alias("_id")).distinct(), "_id", "left_semi").select("_id", text)
    made = src.mapInArrow(run, "node long, hashes binary")
    # the same id may stand for other texts, and a node for several rows
    return written(made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    """Bitmaps of any lengths, folded to so many 64-bit words."""
    by: dict[int, list[int]] = {}
    values = column.to_pylist()
    for i, v in enumerate(values):
        by.setdefault(len(v), []).append(i)
    out = np.zeros((len(values), words), np.uint64)
    for size, rows in by.items():
        x = np.frombuffer(b"".join(values[i] for i in rows), np.uint64).reshape(len(rows), size // 8)
        x = folded(x, words)
        out[rows, : x.shape[1]] = x
    return out


def allowed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures allow the similarity."""
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    near = two.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "na", "nb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            words = np.array([min(len(p), len(q)) // 8 for p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            for w in np.unique(words):
                at = np.flatnonzero(words == w)
                x, y = (_matrix(b.column(c).take(pa.array(at)), int(w)) for c in (4, 5))
                most = np.minimum(na[at] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), nb[at] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                keep[at] = enough(na[at], nb[at], most, percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], names=["a", "b"])

    return near.mapInArrow(run, "a long, b long")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose sorted arrays reach the similarity."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return x.mapInArrow(run, "a long, b long")


def band(n: Column, percent: int = PERCENT) -> Column:
    """Bands of sizes by powers of 100 / percent (a little more, so that rounding never puts similar sizes two bands apart): similar sizes are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / math.log(max(100 / percent, 1.01) * (1 + 1e-9))).cast("int")


def long_lists(rows: DataFrame, nodes: DataFrame, counts: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that meet in a long list and whose signatures allow the similarity; best: of each node's pairs in a cell only the one with the greatest bound."""
    r = rows.join(counts.filter(F.col("c") > SHORT), "h").withColumn("band", band(F.col("n"), percent))
    tiles = r.groupBy("h", "band").agg(F.ceil(F.count("*") / TILE).alias("t"))
    here = tiles.select("h", "band", "t")
    above = tiles.select("h", (F.col("band") - 1).alias("band"), F.col("t").alias("up"))
    below = tiles.select("h", (F.col("band") + 1).alias("band"), F.col("t").alias("down"))
    r = r.join(here.join(above, ["h", "band"], "left").join(below, ["h", "band"], "left"), ["h", "band"])
    mine = F.pmod(F.xxhash64("node"), F.col("t"))
    # a cell is a pair of tiles: of the band itself (i <= j), or one of this band (first) and one of the next (second)
    same = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.col("band").alias("cb"), F.lit(0).alias("kind"), F.least(j, F.col("mine")).alias("i"), F.greatest(j, F.col("mine")).alias("j"), F.lit(0).alias("side")))
    up = F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda j: F.struct(F.col("band").alias("cb"), F.lit(1).alias("kind"), F.col("mine").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    down = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: F.struct((F.col("band") - 1).alias("cb"), F.lit(1).alias("kind"), j.alias("i"), F.col("mine").alias("j"), F.lit(2).alias("side")))
    r = r.withColumns({"mine": mine, "up": F.col("up").cast("long"), "down": F.col("down").cast("long")})
    none = F.slice(same, 1, 0)
    r = r.withColumn("x", F.explode(F.concat(same, F.when(F.col("up").isNotNull(), up).otherwise(none), F.when(F.col("down").isNotNull(), down).otherwise(none))))
    r = r.join(nodes.select("node", "bits"), "node").select("h", "x.cb", "x.kind", "x.i", "x.j", "x.side", "node", "n", "comp", "bits")
    cell = ["h", "cb", "kind", "i", "j"]

    def compare(node: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, second = (np.arange(len(node)), np.arange(len(node))) if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        if not len(first) or not len(second) or comp.min() == comp.max():
            return
        words = min(len(v) for v in bits.to_pylist()) // 8
        m = _matrix(bits, words)
        for p in first:
            q = second[(comp[second] != comp[p]) & ((second > p) if side[0] == 0 else True)]
            q = q[(100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p]))]
            if len(q):
                most = np.minimum(n[p] - np.bitwise_count(m[p] & ~m[q]).sum(1, dtype=np.int64), n[q] - np.bitwise_count(m[q] & ~m[p]).sum(1, dtype=np.int64))
                can = enough(n[p], n[q], most, percent)
                q, most = q[can], most[can]
                if best and len(q):
                    q = q[[int(np.argmax(most / (n[p] + n[q] - most)))]]
                if len(q):
                    yield np.full(len(q), node[p]), node[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            node, n, comp, side = (t.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            for a, b in compare(node, n, comp, side, t.column("bits").combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in cell], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if at is not None and at != tuple(keys[lo]):
                    yield from done()
                    held.clear()
                at = tuple(keys[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()

    return r.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long").distinct()


def open_lists(lists: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (h, node, n, i, comp, c) of lists in which two components meet, and the lists' lengths c."""
    r = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = r.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h", "c")
    r = written(r.join(open_, "h").select("h", "node", "n", "i", "comp", "c"), "open")
    return r, r.groupBy("h").agg(F.first("c").alias("c"))


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of df."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    early, common, repeated = counted(src, "text", k, percent)
    t = written(signed(src, "text", "doc_id", k, percent, common, early), "signatures")
    # what a prefix holds beyond the count may lie in others' prefixes, too
    repeated = repeated.union(t.filter("beyond").select(F.explode("prefix").alias("h")))
    some = t.filter("node is not null")
    nodes = some.groupBy("node").agg(F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("doc_id"))

    # lists in which two nodes meet; the smallest and the largest node tell, so that no list is gathered
    rows = some.select("node", "n", F.posexplode("prefix").alias("i", "h"))
    met = written(rows.join(repeated, "h").groupBy("h", "node").agg(F.first("n").alias("n"), F.first("i").alias("i")), "met")
    shared = met.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("h")
    lists = written(met.join(shared, "h"), "lists")
    nodes = written(nodes.join(lists.select("node").distinct(), "node", "left_semi"), "nodes")

    # 1. leaders
    leader = lists.groupBy("h").agg(F.min_by("node", F.xxhash64("node", "h")).alias("a"))
    ahead = lists.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "h"))), 1, FIRST).alias("x")).select("node", F.explode("x.h").alias("h"))
    stars = ahead.join(leader, "h").filter("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = decided(src, stars, nodes, k, percent)
    comp = components(links)

    # 2. what is left between components; where many copies meet, the most promising pairs join most of them first
    r, counts = open_lists(lists, comp)
    links = links.unionByName(decided(src, long_lists(r.drop("c"), nodes, counts, percent, best=True), nodes, k, percent, signatures=False))
    comp = components(links)
    r, counts = open_lists(lists, comp)
    short = r.filter(F.col("c") <= SHORT)
    p, q = short.select("h", *(F.col(c).alias(f"{c}_p") for c in ("node", "n", "i", "comp"))), short.select("h", *(F.col(c).alias(f"{c}_q") for c in ("node", "n", "i", "comp")))
    # if h is the first that two sets share, no more than what follows it can be shared besides
    most = 1 + F.least(F.col("n_p") - 1 - F.col("i_p"), F.col("n_q") - 1 - F.col("i_q"))
    can = (100 * F.least("n_p", "n_q") >= percent * F.greatest("n_p", "n_q")) & (100 * most >= percent * (F.col("n_p") + F.col("n_q") - most))
    pairs = p.join(q, "h").filter((F.col("node_p") < F.col("node_q")) & (F.col("comp_p") != F.col("comp_q")) & can).select(F.col("node_p").alias("a"), F.col("node_q").alias("b")).distinct()
    more = allowed(pairs, nodes, percent).unionByName(long_lists(r.drop("c"), nodes, counts, percent)).distinct()
    links = links.unionByName(decided(src, more, nodes, k, percent, signatures=False))
    comp = components(links)

    # 3. from nodes to rows
    own = some.groupBy("node").agg(F.min("doc_id").alias("first"))
    label = own.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = label.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = label.join(least, "comp").select("node", "component_id")
    out = t.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def decided(src: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int, signatures: bool = True) -> DataFrame:
    """The links among pairs, as a written table."""
    pairs = written(allowed(pairs, nodes, percent) if signatures else pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc_id"), "node")
    return written(exact(pairs, sets_of(src, wanted, "text", k), percent), "near")
