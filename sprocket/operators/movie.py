"""What a movie is made of: targets, copies, proxies, chapter times and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The short side of a proxy, the fields that must agree for a copy, and the default picture.
SHORT_SIDE = 540
COPY_FIELDS = "video_codec profile width height sar pix_fmt time_base audio_codec sample_rate channels channel_layout".split()
WIDTH, HEIGHT = 1920, 1080


def sar(s: Column) -> Column:
    """A sample aspect ratio; unset ones are square."""
    return F.when(s.isNull() | s.isin("", "0:1", "N/A"), "1:1").otherwise(s)


def targets(clips: DataFrame, looks: DataFrame) -> DataFrame:
    """(event, width, height, fps): an event's picture. looks: event, size (array of two), fps; a size that is not two positive numbers gives the default, a missing rate the highest of the clips."""
    x = clips.groupBy("event").agg(F.max("fps").alias("_most")).join(looks, "event", "left")
    good = (F.size("size") == 2) & F.forall("size", lambda v: v > 0)
    pick = lambda i, default: F.when(good, F.get("size", F.lit(i))).otherwise(default).cast("long")
    return x.select("event", pick(0, WIDTH).alias("width"), pick(1, HEIGHT).alias("height"), F.coalesce("fps", "_most").alias("fps"))


def copy_eligible(segments: DataFrame, facts: DataFrame, target: dict[str, object]) -> DataFrame:
    """segments with copy: whether a segment can be copied as it is. segments: clip (null: drawn), whole, rotate, overlays (a number); facts: clip, width, height, sar, pix_fmt, video_codec, fps, audio_codec, sample_rate, channels, rotation, hdr."""
    x = segments.join(facts, "clip", "left")
    plain = F.col("clip").isNotNull() & F.col("whole") & (F.col("overlays") == 0) & (F.coalesce("rotate", F.lit(0)) % 360 == 0) & ~F.coalesce("hdr", F.lit(False)) & (F.coalesce("rotation", F.lit(0)) % 360 == 0)
    same = F.lit(True)
    for name in ("width", "height", "pix_fmt", "video_codec", "audio_codec", "sample_rate", "channels"):
        same = same & (F.col(name) == target[name])
    same = same & (sar(F.col("sar")) == target["sar"]) & (F.abs(F.col("fps") - target["fps"]) <= 1e-3)
    return x.select(*segments.columns, F.coalesce(plain & same, F.lit(False)).alias("copy"))


def copy_uniform(df: DataFrame, key: str) -> DataFrame:
    """(key, uniform): whether all rows agree in the fields that a copy needs, null being equal to null."""
    fields = F.struct(*(sar(F.col(c)).alias(c) if c == "sar" else F.col(c) for c in COPY_FIELDS))
    return df.groupBy(key).agg((F.count_distinct(fields) <= 1).alias("uniform"))


def proxy_size(width: Column, height: Column, ratio: Column, rotation: Column) -> Column:
    """struct(width, height): upright, in square pixels, short side at most SHORT_SIDE, each side the nearest even number; null if a side or the ratio is unusable. In whole numbers, so that no float moves a border."""
    num, den = (F.when(ratio.rlike(r"^\d+:\d+$"), F.get(F.split(ratio, ":"), F.lit(k)).try_cast("long")).otherwise(F.when(ratio.isNull() | (ratio == ""), F.lit(1))) for k in (0, 1))
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 90
    # sides as fractions over den: width * num and height * den
    w, h = width.cast("decimal(19,0)") * num, height.cast("decimal(19,0)") * den
    a, b = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    short = F.least(a, b)

    def even(side: Column) -> Column:
        # side * SHORT_SIDE / short if the short side is too long, else side / den; halves go up
        top, bottom = F.when(short > SHORT_SIDE * den, side * SHORT_SIDE).otherwise(side), F.when(short > SHORT_SIDE * den, short).otherwise(den.cast("decimal(38,0)"))
        return F.greatest(F.lit(2), 2 * F.floor((top + bottom) / (2 * bottom)).cast("long")).cast("long")

    return F.when((width > 0) & (height > 0) & (num > 0) & (den > 0), F.struct(even(a).alias("width"), even(b).alias("height")))


def proxy_work(clips: DataFrame) -> DataFrame:
    """(event, key, clip, clips, weight): clips that share a proxy, with the first as their representative and its bytes, one at least. clips: event, pos, clip, key, size."""
    first = F.min_by(F.struct("clip", "size"), "pos")
    x = clips.groupBy("event", "key").agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("pos", "clip"))).alias("all"))
    return x.select("event", "key", "f.clip", F.array_join(F.transform("all", lambda c: c["clip"]), ",").alias("clips"), F.greatest(F.coalesce("f.size", F.lit(1)), F.lit(1)).alias("weight"))


def proxy_states(clips: DataFrame, entries: DataFrame, failures: DataFrame, version: int) -> DataFrame:
    """clips with state: ready, stale (of another version), failed (no usable proxy, and a failure noted), absent. entries: key, proxy_version; failures: key, cause."""
    x = clips.join(entries, "key", "left").join(failures, "key", "left")
    state = F.when(F.col("proxy_version") == version, "ready").when(F.col("cause").isNotNull(), "failed").when(F.col("proxy_version").isNotNull(), "stale").otherwise("absent")
    return x.select(*clips.columns, state.alias("state"))


def chapter_times(segments: DataFrame) -> DataFrame:
    """(event, chapter, start_ms, end_ms, card_start_ms, card_end_ms, problem): chapters in the order of their first segment. segments: event, pos, chapter, kind, seconds.

    A chapter's length is rounded to ms, half to even, before it is added. A card's span is its chapter's start plus the seconds before the card and with it, each rounded once. More than one card is a problem.
    """
    within = W.partitionBy("event", "chapter").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    # exact sums: seconds as decimals
    s = segments.withColumn("_s", F.col("seconds").cast("decimal(20,9)")).withColumn("_upto", F.sum("_s").over(within))
    ms = lambda c: F.bround(c * 1000).cast("long")
    card = F.col("kind") == "card"
    g = s.groupBy("event", "chapter").agg(F.min("pos").alias("_pos"), ms(F.sum("_s")).alias("_ms"), F.count_if(card).alias("_cards"), F.min(F.when(card, ms(F.col("_upto") - F.col("_s")))).alias("_a"), F.min(F.when(card, ms(F.col("_upto")))).alias("_b"))
    end = F.sum("_ms").over(W.partitionBy("event").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col("_ms"))
    one = F.col("_cards") == 1
    return g.select("event", "chapter", "start_ms", "end_ms", F.when(one, F.col("start_ms") + F.col("_a")).alias("card_start_ms"), F.when(one, F.col("start_ms") + F.col("_b")).alias("card_end_ms"), F.when(F.col("_cards") > 1, "two cards").alias("problem"))


def usable_chapters(chapters: DataFrame) -> DataFrame:
    """(event, usable): whether starts rise strictly from 0 or more and every chapter has a name; one bad row spoils all. chapters: event, pos, name, start."""
    x = chapters.withColumn("_before", F.lag("start").over(W.partitionBy("event").orderBy("pos")))
    good = (F.col("start") >= 0) & ~F.isnan("start") & (F.col("start") < F.lit(float("inf"))) & F.col("name").isNotNull()
    rises = (F.col("_before").isNull() & (F.row_number().over(W.partitionBy("event").orderBy("pos")) == 1)) | (F.col("start") > F.col("_before"))
    return x.withColumn("_ok", F.coalesce(good & rises, F.lit(False))).groupBy("event").agg(F.bool_and("_ok").alias("usable"))


def cut_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(clip, added, removed, trimmed): cuts (clip, key, start, end) by key, for clips with a change."""
    b, a = before.select("clip", "key", F.struct("start", "end").alias("_b")), after.select("clip", "key", F.struct("start", "end").alias("_a"))
    x = b.join(a, ["clip", "key"], "full_outer").groupBy("clip").agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("removed"), F.count_if(F.col("_a") != F.col("_b")).alias("trimmed"))
    return x.filter("added + removed + trimmed > 0")


def chapter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event, added, renamed, deleted, reordered): chapters by key. before and after: event, key, pos, name. Kept ones are reordered if their places, counted among themselves, differ."""
    x = before.select("event", "key", F.col("pos").alias("_bp"), F.col("name").alias("_bn"), F.lit(True).alias("_b")).join(after.select("event", "key", F.col("pos").alias("_ap"), F.col("name").alias("_an"), F.lit(True).alias("_a")), ["event", "key"], "full_outer")
    kept = F.col("_a") & F.col("_b")
    place = lambda c: F.row_number().over(W.partitionBy("event", F.coalesce(kept, F.lit(False))).orderBy(c))
    x = x.withColumn("_moved", kept & (place("_bp") != place("_ap")))
    return x.groupBy("event").agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(kept & ~F.col("_an").eqNullSafe(F.col("_bn"))).alias("renamed"), F.count_if(F.col("_a").isNull()).alias("deleted"), F.coalesce(F.bool_or("_moved"), F.lit(False)).alias("reordered"))


def ignored_now(read: DataFrame, edits: DataFrame) -> DataFrame:
    """(event, clip): ignored as read, but for those included since, and those ignored since. edits: event, clip, edit (ignore or include)."""
    out = edits.filter("edit = 'include'").select("event", "clip")
    return read.select("event", "clip").join(out, ["event", "clip"], "left_anti").unionByName(edits.filter("edit = 'ignore'").select("event", "clip")).distinct()


def skips(positions: DataFrame, merged: DataFrame, keys: list[str], step: int) -> DataFrame:
    """positions with to: where playing goes on if the next frame, `step` later, lies in a cut; null if it does not. merged: keys, start, end, disjoint."""
    from .joins import asof_join

    cols = positions.columns
    x = asof_join(positions.withColumn("_t", F.col("at") + step), merged.select(*keys, F.col("start").alias("_t"), F.col("end").alias("_e")), keys, "_t", "_e")
    return x.select(*cols, F.when(F.col("_e") > F.col("_t"), F.col("_e")).alias("to"))


def gap_offsets(cards: DataFrame, keys: list[str]) -> DataFrame:
    """cards (keys, at, length) with before: the lengths of the cards ahead of it, so that a movie time is a layout time and what lies before it."""
    by = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return cards.withColumn("before", F.coalesce(F.sum("length").over(by), F.lit(0)))


def visible(clips: DataFrame, low: Column, high: Column, keys: list[str]) -> DataFrame:
    """(keys, first, last): the first and the last clip (index, start, end) that touch a stretch of the time line; empty clips do not."""
    return clips.filter((F.col("start") < F.col("end")) & (F.col("start") <= high) & (F.col("end") >= low)).groupBy(*keys).agg(F.min("index").alias("first"), F.max("index").alias("last"))


def ticks(views: DataFrame, step: str = "step") -> DataFrame:
    """(views' columns, tick): multiples of the step from low to high. views: low, high, step, whole numbers."""
    n, low, high = F.col(step), F.col("low"), F.col("high")
    first = F.ceil(low / n) * n
    return views.filter((n > 0) & (first <= high)).withColumn("tick", F.explode(F.sequence(first.cast("long"), high.cast("long"), n.cast("long"))))


def long_enough(spans: DataFrame, least: float) -> DataFrame:
    """Spans of at least so many seconds."""
    return spans.filter(F.col("end") - F.col("start") >= least)
