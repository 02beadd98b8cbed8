"""Hard negatives by cover trees over norm-augmented vectors.

A vector x of a tree whose longest vector has length M gets a further component sqrt(M^2 - |x|^2), a query q gets 0. Then |q - x|^2 = M^2 + |q|^2 - 2 q.x, so a distance says what the inner product is, and a ball of radius r around a centre at distance d bounds every inner product below it: (M^2 + |q|^2 - (d -+ r)^2) / 2.

The uppermost level is spread over the cluster: PIVOTS vectors of a bounded sample, far from each other, take the rows nearest to them, and a pivot's rows are dealt out by number into shards of about SHARD rows, so a vector that a third of the rows share fills many shards. In a shard a tree is built level by level: the centres of a level are more than its radius apart and cover what is below them; every node keeps the distance that its descendants really reach. The trees are written as a table.

Queries go through the trees in chunks of bounded size, sent to the tasks. A task descends each of its trees best bound first, with what it has found for the query so far as the threshold; nodes whose bounds lie outside every window, below the threshold or in labels of the wrong kind are skipped, what is left is multiplied out exactly in integers. Tasks send the few best of each query on, which a window puts together.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; neither do vectors whose squared length after scaling is 2^61 or more, so that every product fits a long. Vectors of different lengths are filled up with zeros; an empty one is all zeros. A null vec_id is no anchor and comes last in ties. Rows that share a vec_id are rows of their own, but none is the other of an anchor with its id; each anchor row has its own results. Ties, zero vectors and equal vectors follow the order. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard and, for long vectors, its bytes; centres of the spread level; rows of the sample they are chosen from.
SHARD, SHARD_BYTES, PIVOTS, SAMPLE = 2048, 8_000_000, 32, 2048
#: Bytes of the queries that are sent to the tasks at a time, rows of a node that is not split further, and leaves that are multiplied out at a time.
CHUNK_BYTES, LEAF, LEAVES = 8_000_000, 8, 32
_NO_ID = np.iinfo(np.int64).max


def prepared(df: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vector array<long>): the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(embedding, lambda x: x.cast("double") * scale).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x) < 2.0**61
    return rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & finite & fits).select("id", "label", F.transform("x", lambda x: F.floor(x).cast("long")).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out = np.zeros((len(column), width), np.int64)
    if len(column) and sizes.max() > width:
        raise ValueError("a vector is longer than the widest")
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: in doubles where no sum can leave their integers, else in longs."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    fa, fb = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt((fa * fa).sum(1).max() * (fb * fb).sum(1).max()) < 2.0**52 and a.shape[1] * float(np.abs(fa).max()) * float(np.abs(fb).max()) < 2.0**53:
        return (fa @ fb.T).astype(np.int64)
    return a @ b.T


class Tree:
    """A cover tree. Nodes are numbered from the root; node n holds the rows lo[n]..hi[n] of the order and its children are the nodes kids[n]..kids[n + 1]."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centre: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray, kids: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.centre, self.radius, self.lo, self.hi, self.kids = centre, radius, lo, hi, kids
        f = vectors.astype(np.float64)
        self.longest = float((f * f).sum(1).max())  # M^2
        self.points = f[centre]
        self.least = np.array([labels[a:b].min() for a, b in zip(lo, hi, strict=True)])
        self.most = np.array([labels[a:b].max() for a, b in zip(lo, hi, strict=True)])

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        f = vectors.astype(np.float64)
        square = (f * f).sum(1)
        extra = np.sqrt(square.max() - square)
        # equal vectors are at distance 0 exactly
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * (f @ f.T), 0) + (extra[:, None] - extra) ** 2)
        order = np.arange(len(ids))
        centre, radius, lo, hi, kids = [0], [float(apart[0].max())], [0], [len(ids)], []
        node = 0
        while node < len(centre):
            kids.append(len(centre))
            if hi[node] - lo[node] > leaf and radius[node] > 0:
                at, rows, next_centre = lo[node], order[lo[node] : hi[node]], centre[node]
                # a net at half the radius: each new centre is a row that none so far covers; the first is the node's own
                while len(rows):
                    d = apart[next_centre, rows]
                    inside = d <= radius[node] / 2
                    mine, rows, beyond = rows[inside], rows[~inside], d[~inside]
                    centre.append(next_centre)
                    radius.append(float(d[inside].max()))
                    lo.append(at)
                    hi.append(at + len(mine))
                    order[at : at + len(mine)] = mine
                    at += len(mine)
                    if len(rows):
                        next_centre = int(rows[beyond.argmax()])
            node += 1
        kids.append(len(centre))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Tree(ids[order], labels[order], vectors[order], back[np.array(centre)], np.array(radius), np.array(lo), np.array(hi), np.array(kids))

    def bounds(self, nodes: slice, q: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product that a row below each node can have with q, with room for rounding."""
        whole = self.longest + square
        d = np.sqrt(np.maximum(whole - 2 * (self.points[nodes] @ q), 0))
        # sums of whole numbers below 2^53 are exact, so only the roots round
        room = 1 + whole * (1e-9 if whole < 2.0**52 else 1e-6)
        near = np.maximum(d - self.radius[nodes], 0)
        return (whole - (d + self.radius[nodes]) ** 2) / 2 - room, (whole - near * near) / 2 + room


class Best:
    """The k best (score, id) for one query and window, higher scores first, ties by smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        """What a row must reach to matter."""
        least = -np.inf if self.low is None else self.low
        return max(least, self.scores[-1]) if len(self.scores) == self.k else least

    def wants(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which nodes with these bounds may hold rows of the window that are good enough."""
        fits = most >= self.floor()
        return fits if self.high is None else fits & (least <= self.high)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.floor()
        if self.high is not None:
            fits &= scores <= self.high
        if fits.any():
            s, i = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[order], i[order]


def descend(tree: Tree, q: np.ndarray, own: int, label: int, same: bool, wanted: list[Best], leaves: int = LEAVES) -> int:
    """Put the rows of the tree, of the query's label or of other labels, into what is wanted; the nodes with the highest bound first. Returns how many rows were multiplied out."""
    f = q.astype(np.float64)
    square = float(f @ f)
    done = 0

    def wants(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        live = np.zeros(len(most), bool)
        for w in wanted:
            live |= w.wants(least, most)
        return live

    # inner nodes stand alone in the heap, the leaves of a node together, best first
    heap: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def push(nodes: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        live = wants(least, most)
        nodes, least, most = nodes[live], least[live], most[live]
        if len(nodes):
            heapq.heappush(heap, (-float(most[0]), int(nodes[0]), nodes, least, most))

    def open_nodes(first: int, end: int) -> None:
        nodes = np.arange(first, end)
        right = ((tree.least[first:end] <= label) & (tree.most[first:end] >= label)) if same else ((tree.least[first:end] != label) | (tree.most[first:end] != label))
        least, most = tree.bounds(slice(first, end), f, square)
        inner = tree.kids[first + 1 : end + 1] > tree.kids[first:end]
        for n in np.flatnonzero(right & inner & wants(least, most)).tolist():
            push(nodes[n : n + 1], least[n : n + 1], most[n : n + 1])
        out = np.flatnonzero(right & ~inner)
        out = out[np.argsort(-most[out], kind="stable")]
        push(nodes[out], least[out], most[out])

    open_nodes(0, 1)
    while heap:
        bound, first, nodes, least, most = heapq.heappop(heap)
        if all(-bound < w.floor() for w in wanted):
            break
        if tree.kids[first + 1] > tree.kids[first]:
            open_nodes(int(tree.kids[first]), int(tree.kids[first + 1]))
            continue
        live = np.flatnonzero(wants(least, most))
        take = nodes[live[:leaves]]
        if len(take):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.lo[take].tolist(), tree.hi[take].tolist(), strict=True)])
            rows = rows[((tree.labels[rows] == label) == same) & (tree.ids[rows] != own)]
            score = products(tree.vectors[rows], q[None, :])[:, 0]
            done += len(rows)
            for w in wanted:
                w.add(score, tree.ids[rows])
            rest = live[leaves:]
            push(nodes[rest], least[rest], most[rest])
    return done


_TREE = "ids array<long>, labels array<long>, vectors array<long>, centre array<long>, radius array<double>, lo array<long>, hi array<long>, kids array<long>"
_PARTS = ("ids", "labels", "vectors", "centre", "radius", "lo", "hi", "kids")


def _build(width: int, leaf: int) -> Callable[[pa.Table], pa.Table]:
    def build(group: pa.Table) -> pa.Table:
        ids = np.array([_NO_ID if i is None else i for i in group.column("id").to_pylist()], np.int64)
        tree = Tree.build(ids, np.asarray(group.column("label")), matrix(group.column("vector"), width), leaf)
        return pa.table({p: pa.array([getattr(tree, p).ravel()]) for p in _PARTS})

    return build


def pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of the sample far from each other, the first one first."""
    f = sample.astype(np.float64)
    chosen, d = [0], ((f - f[0]) ** 2).sum(1)
    while len(chosen) < many and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((f - f[chosen[-1]]) ** 2).sum(1))
    return f[chosen]


def trees(rows: DataFrame, width: int, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """A table with a row for each shard's tree. rows: (n, id, label, vector), n a number of the row."""
    shard = max(64, min(shard, SHARD_BYTES // (8 * max(width, 1))))
    sample = rows.select("vector").limit(SAMPLE).toArrow()  # any rows will do: which they are changes where rows lie, not what is found
    centres = pivots(matrix(sample.column(0), width), PIVOTS)
    half = (centres * centres).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v @ centres.T - half).argmax(1).astype(np.int32))], ["n", "id", "label", "vector", "pivot"])

    near = written(rows.mapInArrow(nearest, "n long, id long, label long, vector array<long>, pivot int"), "negatives-rows")
    sizes = near.groupBy("pivot").agg(F.count("*").alias("size"))  # at most PIVOTS rows
    dealt = near.join(F.broadcast(sizes), "pivot").withColumn("piece", F.pmod(F.xxhash64("n"), F.ceil(F.col("size") / shard)))
    return written(dealt.select("pivot", "piece", "id", "label", "vector").groupBy("pivot", "piece").applyInArrow(_build(width, leaf), _TREE), "negatives-trees")


def _search(queries: pa.Table, width: int, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query (query, id, label, vector and, unless same, windows of (low, high)) the k best rows of a task's trees."""
    names = [n for n in queries.column_names if n != "vector"]
    plain = queries.select(names).to_pylist()
    vectors = matrix(queries.column("vector"), width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [[Best(k)] if same else [Best(k, w["low"], w["high"]) for w in p["windows"]] for p in plain]
        for batch in batches:
            for n in range(batch.num_rows):
                part = {p: np.asarray(batch.column(p)[n].values) for p in _PARTS}
                part["vectors"] = part["vectors"].reshape(len(part["ids"]), width)
                tree = Tree(**part)
                for p, q, best in zip(plain, vectors, wanted, strict=True):
                    descend(tree, q, p["id"], p["label"], same, [b for b in best if b.low is None or b.low <= b.high])
        found = [(p["query"], w, s, i) for p, best in zip(plain, wanted, strict=True) for w, b in enumerate(best) for s, i in zip(b.scores.tolist(), b.ids.tolist(), strict=True)]
        for at in range(0, len(found), 50_000):
            columns = list(zip(*found[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "w", "score", "id"])

    return search


def _best(table: DataFrame, queries: pa.Table, width: int, same: bool, k: int) -> DataFrame:
    found = table.mapInArrow(_search(queries, width, same, k), "query long, w long, score long, id long")
    order = Window.partitionBy("query", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    df: DataFrame,
    label: Column | None = None,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
    shard: int = SHARD,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels whose score is from low to high hundredths of the positive's. anchors is a condition on `id`."""
    clean = prepared(df, F.col("label") if label is None else label, vec_id, embedding, scale)
    rows = written(clean.withColumn("n", F.monotonically_increasing_id()).select("n", "id", "label", "vector"), "negatives-clean")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return df.sparkSession.createDataFrame([], schema)
    width = max(width, 1)
    asked = rows.filter(F.col("id") % 100 == 0 if anchors is None else anchors)
    # chunks of bounded size: numbers of the anchors, dealt out by hash
    per = max(1, chunk_bytes // (8 * (width + 8 * positives)))
    many = asked.count()
    if not many:
        return df.sparkSession.createDataFrame([], schema)
    table = trees(rows, width, shard)
    chunks = -(-many // per)
    parts = []
    for c in range(chunks):
        queries = asked.filter(F.pmod(F.xxhash64("n"), F.lit(chunks)) == c).select(F.col("n").alias("query"), "id", "label", "vector").toArrow()
        found = _best(table, queries, width, True, positives).toArrow().to_pylist()
        by_query: dict[int, list[dict]] = {}
        for r in sorted(found, key=lambda r: r["place"]):
            # rows as (low <= 100 s <= high) of the positive's score, in whole numbers
            by_query.setdefault(r["query"], []).append({"positive": r["id"], "score": r["score"], "low": -(-low * r["score"] // 100), "high": high * r["score"] // 100})
        windows = [by_query.get(q, []) for q in queries.column("query").to_pylist()]
        window_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("positive", "score", "low", "high")]))
        queries = queries.append_column("windows", pa.array(windows, window_type))
        best = _best(table, queries, width, False, negatives)
        anchor = df.sparkSession.createDataFrame(pa.table({"query": queries.column("query"), "anchor": queries.column("id"), "windows": queries.column("windows")}))
        anchor = anchor.select("query", "anchor", F.posexplode("windows").alias("w", "p")).select("query", "anchor", F.col("w").cast("long").alias("w"), "p.positive", F.col("p.score").alias("positive_score"))
        parts.append(
            written(
                best.join(anchor, ["query", "w"]).select(
                    F.col("anchor").alias("anchor_id"),
                    F.nullif("positive", F.lit(_NO_ID)).alias("positive_id"),
                    F.col("place").cast("int").alias("rank"),
                    F.nullif("id", F.lit(_NO_ID)).alias("negative_id"),
                    "positive_score",
                    F.col("score").alias("negative_score"),
                ),
                "negatives-found",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
