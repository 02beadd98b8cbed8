"""Layout and editing checks of a timeline: kept extents, trim limits, snapping, checks of typed cuts, splits. Times are whole milliseconds; spans have start before end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import merge_spans
from .joins import asof_join

#: Pixels within which an edge snaps.
SNAP_PX = 8
#: Frames a cut keeps at least.
MIN_FRAMES = 3
#: A cut that ends less than this before the clip's end is a trailing one.
END_SLACK = 100


def frame_ms(index: Column, fps: Column) -> Column:
    """The time of a frame, halves up."""
    return F.floor(index * 1000 / fps + F.lit(0.5))


def nearest_frame(ms: Column, fps: Column) -> Column:
    return frame_ms(F.floor(ms * fps / 1000 + F.lit(0.5)), fps)


def frame_at_or_below(ms: Column, fps: Column) -> Column:
    """The latest frame time not after ms. Rounding moves a frame by less than one place, up to 1000 frames a second."""
    n = F.floor(ms * fps / 1000)
    return F.when(frame_ms(n + 1, fps) <= ms, frame_ms(n + 1, fps)).when(frame_ms(n, fps) > ms, frame_ms(n - 1, fps)).otherwise(frame_ms(n, fps))


def frame_at_or_above(ms: Column, fps: Column) -> Column:
    n = F.ceil(ms * fps / 1000)
    return F.when(frame_ms(n - 1, fps) >= ms, frame_ms(n - 1, fps)).when(frame_ms(n, fps) < ms, frame_ms(n + 1, fps)).otherwise(frame_ms(n, fps))


def _clamped(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str) -> DataFrame:
    x = cuts.select(*keys, "start", "end").join(clips.select(*keys, F.col(length).alias("len")), keys)
    return x.select(*keys, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "len").alias("end"))


def edge_places(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length", slack: int = END_SLACK) -> DataFrame:
    """clips with lead and trail: where the leading cut ends and the trailing one (one that ends less than slack before the end) begins, 0 and the length without such cuts; also where they leave nothing."""
    m = merge_spans(_clamped(cuts, clips, keys, length), keys).join(clips.select(*keys, F.col(length).alias("len")), keys)
    ends = m.groupBy(*keys).agg(F.max(F.when(F.col("start") <= 0, F.col("end"))).alias("lead"), F.min(F.when(F.col("len") - F.col("end") < slack, F.col("start"))).alias("trail"))
    return clips.join(ends, keys, "left").withColumns({"lead": F.coalesce("lead", F.lit(0)), "trail": F.coalesce("trail", length)})


def kept_extents(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length", slack: int = END_SLACK) -> DataFrame:
    """clips with in_at and out_at: what a leading cut and a trailing one leave; 0 and 0 if that is nothing."""
    x = edge_places(cuts, clips, keys, length, slack)
    some = F.col("trail") > F.col("lead")
    return x.select(*clips.columns, F.when(some, F.col("lead")).otherwise(0).cast("long").alias("in_at"), F.when(some, F.col("trail")).otherwise(0).cast("long").alias("out_at"))


def interior_spans(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length", slack: int = END_SLACK) -> DataFrame:
    """(keys, start, end): merged cuts that neither lead nor trail."""
    m = merge_spans(_clamped(cuts, clips, keys, length), keys)
    x = m.join(kept_extents(cuts, clips, keys, length, slack).select(*keys, "in_at", "out_at"), keys)
    return x.filter((F.col("start") > 0) & (F.col("start") >= F.col("in_at")) & (F.col("end") <= F.col("out_at"))).select(*keys, "start", "end")


def layout(clips: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """clips (in_at, out_at) with starts_at: kept extents end to end."""
    size = F.greatest(F.col("out_at") - F.col("in_at"), F.lit(0))
    before = F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return clips.withColumn("starts_at", F.coalesce(before, F.lit(0)).cast("long"))


def clip_at(points: DataFrame, laid: DataFrame, keys: list[str], at: str, clip: str) -> DataFrame:
    """points with the clip that holds layout time `at` and the time in it, clip_ms. A boundary is the later clip's; before the first is the first's, past the last the last's; clips without length hold nothing."""
    right = laid.filter("out_at > in_at").select(*keys, F.col("starts_at").alias("_at"), F.struct(F.col(clip).alias("clip"), "starts_at", "in_at").alias("_held"))
    x = asof_join(points.withColumn("_at", F.greatest(F.col(at), F.lit(0))), right, keys, "_at", "_held", first_if_none=True)
    return x.select(*points.columns, F.col("_held.clip").alias(clip), (F.col(at) - F.col("_held.starts_at") + F.col("_held.in_at")).alias("clip_ms"))


def trim_limits(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length", fps: str = "fps") -> DataFrame:
    """cuts with in_low, in_high, out_low and out_high: how far each edge may go. The nearest ends before a cut and starts after it bound it, MIN_FRAMES frames remain, and a range always holds the edge's present place. Neighbours are found by as-of windows, not by comparing all cuts of a clip."""
    cols = cuts.columns
    x = asof_join(cuts.withColumn("_at", F.col("start")), cuts.select(*keys, F.col("end").alias("_at"), F.col("end").alias("_prev")), keys, "_at", "_prev").drop("_at")
    x = asof_join(x.withColumn("_at", -F.col("end")), cuts.select(*keys, (-F.col("start")).alias("_at"), F.col("start").alias("_next")), keys, "_at", "_next").drop("_at")
    x = x.join(clips.select(*keys, F.col(length).alias("_len"), F.col(fps).alias("_fps")), keys)
    short = frame_ms(F.lit(MIN_FRAMES), F.col("_fps"))
    limits = {
        "in_low": F.least(F.greatest(F.coalesce("_prev", F.lit(0)), F.lit(0)), F.col("start")),
        "in_high": F.greatest(frame_at_or_below(F.least("end", "_len") - short, F.col("_fps")), F.col("start")),
        "out_low": F.least(frame_at_or_above(F.greatest(F.col("start"), F.lit(0)) + short, F.col("_fps")), F.col("end")),
        "out_high": F.greatest(F.least(F.coalesce("_next", "_len"), F.col("_len")), F.col("end")),
    }
    return x.select(*cols, *(c.cast("long").alias(n) for n, c in limits.items()))


def snap_candidates(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """(keys, candidate): a clip's ends and the edges of cuts inside it, each once."""
    size = clips.select(*keys, F.col(length).alias("len"))
    edges = cuts.select(*keys, F.explode(F.array("start", "end")).alias("candidate")).join(size, keys).filter(F.col("candidate").between(F.lit(0), F.col("len"))).drop("len")
    ends = size.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("len"))).alias("candidate"))
    return edges.unionByName(ends).distinct()


def snap(points: DataFrame, candidates: DataFrame, keys: list[str], at: str, pps: float, within: int = SNAP_PX) -> DataFrame:
    """points with target: the nearest candidate within so many pixels at pps pixels a second, the earlier of two equally near, else null. The nearest on each side is an as-of lookup."""
    c = candidates.select(*keys, "candidate")
    x = asof_join(points.withColumn("_at", F.col(at)), c.select(*keys, F.col("candidate").alias("_at"), F.col("candidate").alias("_low")), keys, "_at", "_low").drop("_at")
    x = asof_join(x.withColumn("_at", -F.col(at)), c.select(*keys, (-F.col("candidate")).alias("_at"), F.col("candidate").alias("_high")), keys, "_at", "_high").drop("_at")
    near = lambda v: F.when(F.abs(F.col(v) - F.col(at)) * pps / 1000 <= within, F.col(v))
    low, high = near("_low"), near("_high")
    later = low.isNull() | (high - F.col(at) < F.col(at) - low)
    return x.select(*points.columns, F.when(high.isNotNull() & later, high).otherwise(low).alias("target"))


def check_cuts(typed: DataFrame, listed: DataFrame, clips: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """typed with refusal: 'order', 'range' or 'overlap' with a listed cut (touching is none), else null. Listed cuts are merged first, so only the last one that starts before a typed cut's end can overlap it."""
    m = merge_spans(listed, keys).select(*keys, F.col("start").alias("_at"), F.col("end").alias("_prev"))
    x = asof_join(typed.withColumn("_at", F.col("end") - 1), m, keys, "_at", "_prev").join(clips.select(*keys, F.col(length).alias("_len")), keys)
    refusal = F.when(F.col("start") >= F.col("end"), "order").when((F.col("start") < 0) | (F.col("end") > F.col("_len")), "range").when(F.col("_prev") > F.col("start"), "overlap")
    return x.select(*typed.columns, refusal.alias("refusal"))


def cut_rectangles(cuts: DataFrame, extents: DataFrame, keys: list[str], pps: float, length: str = "length") -> DataFrame:
    """cuts with left_px and width_px, from the kept extent's start; those within a leading or trailing cut, outside the clip or empty have no row."""
    x = cuts.join(extents.select(*keys, F.col(length).alias("_len"), "in_at", "out_at"), keys)
    x = x.withColumns({"_from": F.greatest(F.col("start"), F.lit(0)), "_to": F.least("end", "_len")})
    x = x.filter((F.col("_to") > F.col("_from")) & (F.col("_to") > F.col("in_at")) & (F.col("_from") < F.col("out_at")))
    return x.select(*cuts.columns, ((F.col("_from") - F.col("in_at")) * pps / 1000).alias("left_px"), ((F.col("_to") - F.col("_from")) * pps / 1000).alias("width_px"))


def split_segments(segments: DataFrame, window: str, fps: str, least_tail: float = 1.0) -> DataFrame:
    """segments (start, end in seconds) with part: 'head' and 'tail', cut at the first frame not before the window's end, or 'whole' where there is no window or less than least_tail would remain."""
    length = F.col("end") - F.col("start")
    frames = F.ceil(F.least(F.col(window), length) * F.col(fps) - F.lit(1e-6))
    head = frames / F.col(fps)
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.cast("double").alias("start"), b.cast("double").alias("end"))
    cut = F.col("start") + head
    split = (F.col(fps) > 0) & (frames > 0) & (length - head >= least_tail)
    parts = F.when(split, F.array(part("head", F.col("start"), cut), part("tail", cut, F.col("end")))).otherwise(F.array(part("whole", F.col("start"), F.col("end"))))
    others = [c for c in segments.columns if c not in ("start", "end")]
    return segments.withColumn("_p", F.explode(parts)).select(*others, "_p.part", "_p.start", "_p.end")
