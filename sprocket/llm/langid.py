"""Language identification by prediction by partial matching (operator 6).

For every language, counts of byte sequences of up to four bytes form a context tree of
order 3. A byte's probability is its count in the longest context, over that context's
total plus its number of distinct followers (escape method C); a byte that is no node
there costs the context's escape and is looked for one order down, at the end in a
uniform order over all 256 bytes. Statistics are frozen after fitting, and a text's score
in a language is its exact code length in bits. The shortest code wins; the score is the
winner's share under the code lengths per SCORED bytes.

Bytes are first normalised (lower case, digits as one, white space as one); otherwise
every byte is a symbol of its own, so scripts of several bytes a letter keep theirs.

Counting covers every training row: each task counts the sequences of its rows, and one
shuffle adds the counts up. Of each order every language keeps its own most frequent
sequences as nodes, NODES at most (all of one count or none), whatever other languages
there are; what it does not keep goes into the escape, whose mass is counted from all
sequences. So each context's probabilities, escape included, sum to one at any size, and
a model has a few MB a language.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows with
null language are never learned from; without any training row all is ``und``; ties go to
the first language by code point; repeated rows each count; kept columns named lang_pred
or score give way to the results; an empty table gives an empty result. Texts of any
length are read in pieces of CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bytes in the longest sequence: three of context and the byte that is coded.
LONGEST = 4
#: Sequences of one order that a language keeps as nodes, at most. A bound of the model, not of what is counted.
NODES = 1 << 16
#: The share is taken of code lengths for so many bytes, as neighbouring bytes are not independent.
SCORED = 64
#: Bytes handled at once, and distinct sequences that a counting task holds.
CHUNK, HELD = 1 << 20, 1 << 21


def _normal() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[48:58] = 48
    t[[9, 10, 11, 12, 13]] = 32
    return t


NORMAL = _normal()


def sequences(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first, codes): the four-byte sequence that ends at each byte, from `first` on those of each row; three blanks come before a text. Long texts come in several pieces."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = NORMAL[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        code = (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]
        inside = np.ones(len(code) + 3, bool)
        for k in range(3):
            inside[starts + k] = False
        return np.array(rows), starts - 3 * np.arange(len(starts)), code[inside[3:]]

    for i, t in enumerate(texts):
        raw = b"   " + (t or "").encode("utf-8", "replace")
        for at in range(3, len(raw), CHUNK):
            parts.append(raw[at - 3 : at + CHUNK])
            rows.append(i)
            size += len(parts[-1])
            if size >= CHUNK:
                yield done()
                rows, parts, size = [], [], 0
    if parts:
        yield done()


@dataclass
class Tree:
    """A language's nodes: for each number of bytes (1 to LONGEST) the sequences and the costs of their last byte, and the contexts and the costs of leaving them."""

    lang: str
    nodes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    leave: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def bits(self, codes: np.ndarray, k: int = LONGEST) -> np.ndarray:
        """The cost of each sequence's last byte after the k - 1 bytes before it."""
        if not k:
            return np.full(len(codes), 8.0)
        codes = codes & np.uint32((1 << 8 * k) - 1)
        out, known = _looked_up(self.nodes.get(k), codes)
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = _looked_up(self.leave.get(k), codes[new] >> np.uint32(8))[0] + self.bits(codes[new], k - 1)
        return out


def _looked_up(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys' values (0 where there is none), and whether there is one."""
    if table is None or not len(table[0]):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    known = table[0][at] == keys
    return np.where(known, table[1][at], 0.0), known


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            u, inv = np.unique(keys, return_inverse=True)
            held[lang] = [(u, np.bincount(inv, counts, len(u)).astype(np.int64))]
            return held[lang][0]

        def let_go() -> Iterator[pa.RecordBatch]:
            for y in held:
                u, n = folded(y)
                for at in range(0, len(u), 50_000):
                    k = len(u[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([y] * k, pa.string()), pa.array(u[at : at + k].astype(np.int64)), pa.array(n[at : at + k])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            texts: dict[str, list] = {}
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(y, []).append(x)
            for y, own in texts.items():
                for _, _, codes in sequences(own):
                    held.setdefault(y, []).append(np.unique(codes, return_counts=True))
                    if len(held[y]) > 12:
                        folded(y)
            if sum(len(u) for x in held.values() for u, _ in x) > HELD:
                yield from let_go()
        yield from let_go()

    return df.select(text, lang).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grown(grams: DataFrame, k: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """Of sequences of k bytes the nodes (lang, gram, bits), and the contexts (lang, gram, bits) with what leaving them costs; contexts without a node cost nothing to leave."""
    counts = grams.groupBy("lang", (F.col("gram") % 256**k).alias("gram")).agg(F.sum("n").alias("n"))
    # how many sequences of a language occur n times or more: a row for each count, not for each sequence
    steps = counts.groupBy("lang", "n").agg(F.count("*").alias("m"))
    upto = steps.withColumn("upto", F.sum("m").over(W.partitionBy("lang").orderBy(F.desc("n"))))
    least = upto.filter(F.col("upto") <= nodes).groupBy("lang").agg(F.min("n").alias("least"))
    marked = counts.join(F.broadcast(least), "lang", "left").select("lang", "gram", "n", F.shiftright("gram", 8).alias("ctx"), F.coalesce(F.col("n") >= F.col("least"), F.lit(False)).alias("node"))
    of = marked.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("seen"), F.sum(F.when(F.col("node"), F.col("n")).otherwise(0)).alias("inside"))
    of = of.filter("inside > 0").select("lang", "ctx", (F.col("total") + F.col("seen")).alias("all"), "inside")
    kept = marked.filter("node").join(of, ["lang", "ctx"]).select("lang", "gram", F.log2(F.col("all") / F.col("n")).alias("bits"))
    return kept, of.select("lang", F.col("ctx").alias("gram"), F.log2(F.col("all") / (F.col("all") - F.col("inside"))).alias("bits"))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", nodes: int = NODES) -> list[Tree]:
    """A tree for each language, in order of code point."""
    rows = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    grams = written(gram_counts(rows, text, lang), "ppm")
    trees: dict[str, Tree] = {r["lang"]: Tree(r["lang"]) for r in grams.select("lang").distinct().collect()}
    for k in range(1, LONGEST + 1):
        for what, rows in zip(("nodes", "leave"), grown(grams, k, nodes), strict=True):
            x = rows.toArrow()  # at most `nodes` rows a language
            names, gram, bits = np.array(x.column("lang").to_pylist(), object), x.column("gram").to_numpy(), x.column("bits").to_numpy()
            for y, tree in trees.items():
                own = np.flatnonzero(names == y)
                own = own[np.argsort(gram[own])]
                getattr(tree, what)[k] = gram[own].astype(np.uint32), bits[own].astype(np.float32)
    return [trees[y] for y in sorted(trees)]


def code_lengths(trees: list[Tree], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths (text, language), and the numbers of bytes."""
    out, sizes = np.zeros((len(texts), len(trees))), np.zeros(len(texts), np.int64)
    for rows, first, codes in sequences(texts):
        distinct, of = np.unique(codes, return_inverse=True)
        for j, tree in enumerate(trees):
            np.add.at(out[:, j], rows, np.add.reduceat(tree.bits(distinct)[of], first))
        np.add.at(sizes, rows, np.diff(np.append(first, len(codes))))
    return out, sizes


def predict(df: DataFrame, trees: list[Tree], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred and score."""
    own = [c for c in keep if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(trees)  # bounded: NODES sequences of each order a language
    langs = np.array([t.lang for t in trees], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(len(own)).to_pylist()
                letters = np.array([t is not None and any(ch.isalpha() for ch in t) for t in texts], bool)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if len(langs):
                    bits, n = code_lengths(sent.value, texts)
                    p = np.exp2(-(bits - bits.min(1, keepdims=True)) * (np.minimum(n, SCORED) / np.maximum(n, 1))[:, None])
                    best = bits.argmin(1)
                    pred = np.where(letters, langs[best], "und")
                    score = np.where(letters, p[np.arange(len(texts)), best] / p.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(list(pred), pa.string()), pa.array(score, pa.float64())], names=[*own, "lang_pred", "score"])

    fields = [df.schema[c] for c in own]
    return df.select(*own, text).mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
