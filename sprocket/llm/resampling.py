"""Importance resampling: documents drawn by how much likelier their n-grams are in a target text than in the corpus.

Features are runs of one to three words, hashed to buckets. Arrow's kernels do the text work in a task: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode turn a batch into word numbers; a shifted copy of the numbers beside them makes pairs, and pairs beside the numbers shifted once more make triples, each encoded again, so that a CRC is taken of distinct n-grams only. Taking the distinct ones' buckets gives every feature's, and differences of running sums the total of each document.

The corpus is read twice: for the counts of the buckets (each task sends at most BUCKETS rows; the whole table of gains has BUCKETS rows, whatever the corpus) and for the weights. Ranks come from a range partitioning by score, with the numbers of rows in the partitions before.

Cases: a null or empty text has no words, weight 0; a null id counts as the text `null` in its hash and comes last in ties; rows that repeat are drawn one by one; an empty table or target gives gains all the same; fewer than `least` words: a score, but no rank. A text beyond PIECE bytes is read in pieces cut between words, the last two words carried on. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Number of buckets; bytes of text whose numbers are in memory at once.
BUCKETS, PIECE = 10_000, 2_000_000
#: Fixed value: what stands between words, once A-Z are in lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Features:
    """The n-grams of some texts. carried: how many words at the head of each text only lead on to the others and have been counted."""

    def __init__(self, texts: pa.Array, carried: np.ndarray):
        parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS)
        words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
        real = pc.greater(pc.binary_length(words), 0)
        coded = pc.dictionary_encode(words.filter(real))
        own = np.asarray(owner.filter(real))
        self.one = np.asarray(coded.indices).astype(np.int64)
        spelled = [w.as_buffer().to_pybytes() for w in coded.dictionary]
        spaced = [b" " + w for w in spelled]
        many = len(spelled)
        n = len(self.one)
        self.ends = np.searchsorted(own, np.arange(len(texts)), "right")
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)[: len(texts)]
        place = np.arange(n) - self.starts[own]
        self.fresh = place >= carried[own]
        self.words = self.ends - self.starts - carried
        crc1 = [zlib.crc32(w) for w in spelled]
        # a pair ends at its second word, a triple at its third
        self.at2 = np.flatnonzero(place >= 1)
        two = pc.dictionary_encode(pa.array(self.one[self.at2 - 1] * many + self.one[self.at2]))
        self.two, pairs = np.asarray(two.indices).astype(np.int64), np.asarray(two.dictionary)
        crc2 = [zlib.crc32(spaced[b], crc1[a]) for a, b in zip((pairs // max(many, 1)).tolist(), (pairs % max(many, 1)).tolist(), strict=True)]
        pair_at = np.full(n, -1, np.int64)
        pair_at[self.at2] = self.two
        self.at3 = np.flatnonzero(place >= 2)
        three = pc.dictionary_encode(pa.array(pair_at[self.at3 - 1] * many + self.one[self.at3]))
        self.three, triples = np.asarray(three.indices).astype(np.int64), np.asarray(three.dictionary)
        crc3 = [zlib.crc32(spaced[b], crc2[a]) for a, b in zip((triples // max(many, 1)).tolist(), (triples % max(many, 1)).tolist(), strict=True)]
        self.crcs = [np.array(c, np.int64) for c in (crc1, crc2, crc3)]

    def _each(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word at which it ends, number among the distinct, CRC of the distinct) for each n."""
        every = np.arange(len(self.one))
        for at, index, crc in ((every, self.one, self.crcs[0]), (self.at2, self.two, self.crcs[1]), (self.at3, self.three, self.crcs[2])):
            fresh = self.fresh[at]
            yield at[fresh], index[fresh], crc

    def counts(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(buckets, np.int64)
        for _, index, crc in self._each():
            np.add.at(out, crc % buckets, np.bincount(index, minlength=len(crc)))
        return out

    def totals(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, sum of their gains) of each text."""
        number, total = np.zeros(len(self.one), np.int64), np.zeros(len(self.one), np.int64)
        for at, index, crc in self._each():
            number[at] += 1
            total[at] += gains[crc % len(gains)][index]
        out = []
        for x in (number, total):
            running = np.concatenate(([0], np.cumsum(x)))
            out.append(running[self.ends] - running[self.starts])
        return out[0], out[1]


def portions(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, texts, carried words) in portions of about piece bytes; several in a row with one text are pieces of that row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and size + sizes[end] <= piece:
            size += int(sizes[end])
            end += 1
        if end > row:
            yield row, texts.slice(row, end - row), np.zeros(end - row, np.int64)
            row = end
            continue
        whole, at, last = texts[row].as_buffer().to_pybytes(), 0, []
        while at < len(whole):
            cut = _CUT.search(whole, at + piece)
            part = whole[at : cut.start()] if cut else whole[at:]
            yield row, pa.array([b" ".join([*last, part])], pa.string()), np.array([len(last)], np.int64)
            last = [*last, *_WORD.findall(part)][-2:]
            at += len(part)
        row += 1


def counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """(bucket, n): features of all rows in each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts, carried in portions(batch.column(0), piece):
                out += Features(texts, carried).counts(buckets)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(out[some])], ["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, rounded down. Both tables have at most a row for each bucket."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for df, out in ((corpus, s), (target, t)):
        rows = df.toPandas()
        out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, rounded down; the same in every run."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = 42, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    names = ["n_words", "n_features", "weight", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for row, texts, carried in portions(batch.column(1), piece):
                f = Features(texts, carried)
                out[:3, row : row + len(texts)] += np.stack([f.words, *f.totals(gain)])
            out[3] = out[2] + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least: int = 20, seed: int = 42, buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank: of the rows with at least `least` words, `percent` in a hundred are drawn, highest scores first, ties to smaller ids; the others' rank is null."""
    gain = gains(counts(docs, text, buckets, piece), counts(target, target_text, buckets, piece), buckets)
    scored = written(scores(docs, gain, doc_id, text, seed, piece), "resampling-scores")
    fit = scored.filter(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    # rows that are equal in all are told apart by a number, so that no range has to hold them all
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(), F.col("row").asc()]
    ranged = written(fit.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    # a row for each partition
    before = ranged.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranged.join(before, "part").withColumn("rank", place)
    columns = ["doc_id", "n_features", "weight", "score"]
    unfit = scored.filter(F.col("n_words") < least)
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")).unionByName(unfit.select(*columns, F.lit(None).cast("long").alias("rank")))
