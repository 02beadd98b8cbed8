"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 7).

Targets: sources by code point, null last, weigh WEIGHTS in turn and share `share` of
all words; none gets more than `repeats` times its size, and what it cannot take is
shared anew among the rest. Each source's words, its documents laid end to end in an
order given by a seeded hash, are cut into blocks of BLOCK words. The total of the
targets, in blocks, is dealt to the sources as integer quotas by highest quotients
target / (2 seats + 1); the divisor is found by bisection, so no seat is dealt one by
one. A source whose quota is p times its blocks and r more takes every block p times and
r blocks once more. A source's block j lies in shard j modulo SHARDS, turned by the
source's place. The r seats go to the shards in turn, r / SHARDS to each and the rest to
shards that a seeded permutation picks among those with a block to spare; that gives
integer quotas a shard, and a shard's seats go to its blocks by a seeded permutation of
its own.

Only a row for each source reaches the driver. Places in a source are found in two
levels (hash buckets, then within a bucket), so that a source with a third of all words
is dealt out over many tasks.

Defined cases: null text has size 0 and is never taken; null source is a source;
repeated rows are documents of their own; a source without words has target 0; an empty
table gives an empty result; columns with a result's name (RESULTS) give way to it, and
names that start with ``_mix_`` are reserved.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
REPEATS = 2
BLOCK = 16
SHARDS = 64
SEED = 41
#: Rows in a bucket of a source, about.
PER_BUCKET = 100_000
RESULTS = ("size", "source_size", "target", "_mix_at", "passes", "chosen", "taken")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS) -> list[Fraction]:
    """The targets of sources in order, exactly."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[Fraction | None] = [None] * len(sizes)
    rest = min(share, Fraction(repeats)) * sum(sizes)
    while open_ := [i for i, x in enumerate(out) if x is None]:
        unit = Fraction(rest) / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * unit > repeats * sizes[i]]
        for i in over or open_:
            out[i] = Fraction(repeats * sizes[i]) if over else w[i] * unit
        if not over:
            break
        rest -= sum(repeats * sizes[i] for i in over)
    return out


def apportion(shares: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: seats by highest share / (2 k + 1), ties to the earlier, none beyond its most."""
    seats = min(seats, sum(most))
    if seats <= 0:
        return [0] * len(shares)

    def at(quotient: Fraction) -> list[int]:
        # the k-th seat (from 0) has quotient share / (2 k + 1), and it is in if that exceeds `quotient`
        return [min(m, max(0, math.ceil((s / quotient - 1) / 2))) if s else 0 for s, m in zip(shares, most, strict=True)]

    if sum(m for s, m in zip(shares, most, strict=True) if s) < seats:
        seats = sum(m for s, m in zip(shares, most, strict=True) if s)
    lo, hi = Fraction(0), max(shares)
    low = min((s for s in shares if s), default=Fraction(1)) / (2 * max(most) + 2)
    lo = low
    for _ in range(200):
        mid = Fraction(float((lo + hi) / 2))
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if sum(at(mid)) >= seats else (lo, mid)
    got = at(hi)
    while sum(got) < seats:  # seats between the two last quotients: ties, or nearly
        best = max((i for i in range(len(shares)) if got[i] < most[i] and shares[i]), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@dataclass(frozen=True)
class Quota:
    """What a source takes: all blocks `passes` times, `extra` of its `blocks` once more. Block j lies in shard (j + `shard`) modulo the shards; (`step`, `shift`) permute the blocks of a shard with one block more than `short`, (`short_step`, `shift`) those of the others, and (`turn`, `shift`) the `spare` shards that may get a seat more."""

    source: str | None
    size: int
    target: float
    blocks: int
    passes: int
    extra: int
    step: int
    short_step: int
    turn: int
    short: int
    spare: int
    shift: int
    shard: int


def coprime(x: int, n: int) -> int:
    """A step near x that meets all of n places."""
    x = x % n if n else 0
    while n and math.gcd(x, n) != 1:
        x += 1
    return x % n if n else 0


def quotas(sizes: dict[str | None, int], block: int = BLOCK, seed: int = SEED, shards: int = SHARDS, share: Fraction = SHARE) -> list[Quota]:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    want = targets([sizes[s] for s in names], share=share)
    blocks = [-(-sizes[s] // block) for s in names]
    seats = apportion(want, round(sum(want, Fraction(0)) / block), [REPEATS * b for b in blocks])
    out = []
    for i, s in enumerate(names):
        n = blocks[i]
        passes, extra = divmod(seats[i], n) if n else (0, 0)
        short = n // shards
        # where each shard's seats fill the shards of fewer blocks, only those with a block more can take the rest
        spare = shards if extra // shards < short else n % shards
        x = 2654435761 * (seed + i + 1)
        out.append(Quota(s, sizes[s], float(want[i]), n, passes, extra, coprime(x, short + 1), coprime(x, short), coprime(x, spare), short, spare, seed * 7919 + i * 104729, (seed + i) % shards))
    return out


def permuted(x: Column, step: Column, shift: Column, n: Column) -> Column:
    """(step * x + shift) modulo n for x and step below n, in two halves of x: step * x may exceed 2 ** 63."""
    return F.pmod(F.pmod(F.pmod(step * F.floor(x / 65536), n) * 65536, n) + step * (x % 65536) + shift, n)


def is_extra(j: Column, shards: int) -> Column:
    """Whether a source's block j is one of its shard's seats."""
    blocks, extra, short, spare, shift = (F.col(f"_mix_{c}") for c in ("blocks", "extra", "short", "spare", "shift"))
    at = j % shards
    longer = at < blocks % shards
    more = (at < spare) & (permuted(at, F.col("_mix_turn"), shift, F.greatest(spare, F.lit(1))) < extra % shards)
    place = permuted(F.floor(j / shards), F.when(longer, F.col("_mix_step")).otherwise(F.col("_mix_short_step")), shift + at * 7919, F.when(longer, short + 1).otherwise(F.greatest(short, F.lit(1))))
    return place < F.floor(extra / shards) + more.cast("long")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", block: int = BLOCK, seed: int = SEED, share: Fraction = SHARE, shards: int = SHARDS) -> DataFrame:
    """df with size, source_size, target, _mix_at (the document's place in its source), passes, chosen (numbers of the extra blocks that it meets) and taken."""
    spark = df.sparkSession
    own_columns = [c for c in df.columns if c not in RESULTS]
    df = df.select(*own_columns)
    sized = df.withColumns({"size": n_words(F.col(text)), "_mix_key": F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"))})
    # one row a source
    totals = {r[0]: (int(r[1]), r[2]) for r in sized.groupBy(source).agg(F.sum("size"), F.count("*")).collect()}
    q = quotas({s: n for s, (n, _) in totals.items()}, block, seed, shards, share)
    buckets = max(16, max((n for _, n in totals.values()), default=0) // PER_BUCKET)
    plan = spark.createDataFrame([(x.source, x.size, x.target, x.blocks, x.passes, x.extra, x.step, x.short_step, x.turn, x.short, x.spare, x.shift) for x in q] or [], "_mix_source string, source_size long, target double, _mix_blocks long, passes long, _mix_extra long, _mix_step long, _mix_short_step long, _mix_turn long, _mix_short long, _mix_spare long, _mix_shift long")
    sized = sized.withColumn("_mix_bucket", F.pmod(F.col("_mix_key"), F.lit(buckets)))
    light = sized.groupBy(source, "_mix_bucket").agg(F.sum("size").alias("_mix_n"))
    before = F.coalesce(F.sum("_mix_n").over(W.partitionBy(source).orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = light.select(F.col(source).alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), before.alias("_mix_before"))
    # a digest settles ties, so that texts are not dealt out where the caller does not ask for them
    own = W.partitionBy(source, "_mix_bucket").orderBy("_mix_key", doc_id, "size", F.md5(F.col(text).cast("binary"))).rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("_mix_in", F.sum("size").over(own) - F.col("size"))
    x = placed.join(offsets, placed[source].eqNullSafe(offsets["_mix_s"]) & (placed["_mix_bucket"] == offsets["_mix_b"]), "left")
    x = x.join(plan, x[source].eqNullSafe(plan["_mix_source"]), "left").withColumn("_mix_at", F.col("_mix_in") + F.col("_mix_before"))
    first, last = F.floor(F.col("_mix_at") / block), F.floor((F.col("_mix_at") + F.col("size") - 1) / block)
    chosen = F.when((F.col("size") > 0) & (F.col("_mix_extra") > 0), F.filter(F.sequence(first, last), lambda j: is_extra(j, shards))).otherwise(F.array().cast("array<long>"))
    x = x.withColumn("chosen", chosen)
    part = F.aggregate(F.col("chosen"), F.lit(0).cast("long"), lambda a, j: a + F.least((j + 1) * block, F.col("_mix_at") + F.col("size")) - F.greatest(j * block, F.col("_mix_at")))
    x = x.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    return x.select(*own_columns, *RESULTS)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(text: str, at: int, passes: int, chosen: list[int], block: int) -> list[str]:
    """The texts that a mix takes of a document: the whole of it `passes` times, and each run of neighbouring chosen blocks."""
    out = [text] * passes
    if chosen:
        words = [m.span() for m in WORD.finditer(text)]
        runs: list[list[int]] = []
        for j in chosen:
            a, b = max(0, j * block - at), min(len(words), (j + 1) * block - at)
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        out += [text if (a, b) == (0, len(words)) else text[words[a][0] : words[b - 1][1]] for a, b in runs]
    return out


def mixed_rows(mixed: DataFrame, columns: list[str], text: str = "text", n_chars: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """The rows of a mix with the given columns: one for each text of `pieces`."""
    src = mixed.filter("taken > 0").select(*columns, "_mix_at", "passes", "chosen")
    at = columns.index(text)
    count = columns.index(n_chars) if n_chars in columns else -1
    schema = src.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pieces(t, a, p, c, block) for t, a, p, c in zip(*(b.column(k).to_pylist() for k in (at, *range(len(columns), len(columns) + 3))), strict=True)]
            for lo in range(0, len(got), 500):
                part = got[lo : lo + 500]
                rows = pa.array([lo + i for i, x in enumerate(part) for _ in x], pa.int64())
                texts = [t for x in part for t in x]
                cols = [c.take(rows) for c in b.columns[: len(columns)]]
                cols[at] = pa.array(texts, pa.string())
                if count >= 0:
                    cols[count] = pa.array([len(t) for t in texts], pa.int64()).cast(cols[count].type)
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return src.mapInArrow(run, schema)


def shard_quotas(sizes: dict[str | None, int], block: int = BLOCK, seed: int = SEED, shards: int = SHARDS, share: Fraction = SHARE) -> list[tuple[str | None, int, int]]:
    """(source, shard, seats): of every block `passes` seats, and what the shard has of the extra ones."""
    out = []
    for x in quotas(sizes, block, seed, shards, share):
        for k in range(shards):
            at = (k - x.shard) % shards
            more = at < x.spare and (x.turn * at + x.shift) % x.spare < x.extra % shards
            out.append((x.source, k, x.passes * (x.short + (at < x.blocks % shards)) + x.extra // shards + more))
    return out
