"""Post-conditions of finished files: rules in order, the first broken one as the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a proxy's length may be off, in seconds, and the spellings of square pixels.
TOLERANCE, SLACK = 0.05, 1e-9
SQUARE = ["N/A", "0:1", "1:1"]


@dataclass
class Rule:
    """A check: what was found and what was expected, and whether that will do (by default: whether they are equal, null being equal to null). skip: where the rule does not hold at all."""

    name: str
    found: Column
    expected: Column
    fits: Column | None = None
    skip: Column | None = None


def first_broken(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with broken: struct(rule, found, expected) of the first rule that does not hold, null if all do. What cannot be told counts as broken."""
    said = []
    for r in rules:
        fits = r.found.eqNullSafe(r.expected) if r.fits is None else F.coalesce(r.fits, F.lit(False))
        fits = fits if r.skip is None else fits | F.coalesce(r.skip, F.lit(False))
        said.append(F.when(~fits, F.struct(F.lit(r.name).alias("rule"), r.found.cast("string").alias("found"), r.expected.cast("string").alias("expected"))))
    return df.withColumn("broken", F.coalesce(*said))


def _size(width: Column, height: Column) -> Column:
    return F.concat(F.coalesce(width.cast("string"), F.lit("none")), F.lit("x"), F.coalesce(height.cast("string"), F.lit("none")))


def proxies(df: DataFrame) -> DataFrame:
    """df with broken. Of the file: n_video, video_codec, pix_fmt, width, height, sar, n_audio, audio_codec, channels, seconds (of the video stream), packets; of the plan: want_width, want_height, want_seconds, want_audio, want_frames (null: unknown, not checked)."""
    c = F.col
    silent = ~c("want_audio")
    return first_broken(
        df,
        [
            Rule("video streams", c("n_video"), F.lit(1)),
            Rule("video codec", c("video_codec"), F.lit("h264")),
            Rule("pixel format", c("pix_fmt"), F.lit("yuv420p")),
            Rule("dimensions", _size(c("width"), c("height")), _size(c("want_width"), c("want_height"))),
            Rule("pixel aspect ratio", c("sar"), F.lit("1:1"), c("sar").isNull() | c("sar").isin(SQUARE)),
            Rule("audio streams", c("n_audio"), F.when(c("want_audio"), 1).otherwise(0)),
            Rule("audio codec", c("audio_codec"), F.lit("aac"), skip=silent),
            Rule("audio channels", c("channels"), F.lit(2), skip=silent),
            Rule("video duration", c("seconds"), c("want_seconds"), F.abs(c("seconds") - c("want_seconds")) <= TOLERANCE + SLACK),
            Rule("packet count", c("packets"), F.lit("a count"), c("packets").isNotNull()),
            Rule("video frames", c("packets"), c("want_frames"), skip=c("want_frames").isNull()),
        ],
    )


def movies(df: DataFrame) -> DataFrame:
    """df with broken. Of the file: n_video (without covers), covers (array of codecs), width, height, video_codec, pix_fmt, sar; of the target: want_width, want_height, want_codec, want_pix_fmt, want_sar, want_cover. Of several values that differ from the target the first is told."""
    c = F.col
    square = lambda s: F.when(s.isNull() | s.isin("", *SQUARE), "1:1").otherwise(s)
    covers = F.array_join("covers", ",")
    return first_broken(
        df,
        [
            Rule("video streams", c("n_video"), F.lit(1)),
            Rule("cover", covers, F.lit("mjpeg"), skip=~c("want_cover")),
            Rule("resolution", _size(c("width"), c("height")), _size(c("want_width"), c("want_height"))),
            Rule("codec", c("video_codec"), c("want_codec")),
            Rule("pixel format", c("pix_fmt"), c("want_pix_fmt")),
            Rule("pixel aspect ratio", square(c("sar")), c("want_sar")),
        ],
    )
