"""What a probe says of media files, in one pass: facts of the good ones, causes of the others, and how many there are of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import rational
from ..session import shared_folder
from .sidecars import _kind, recorded_at

#: Transfer functions of wide range, the greatest plausible rate, and what stands for no ratio.
WIDE, MAX_RATE = ["smpte2084", "arib-std-b67"], 1000
NO_RATIO = ["", "0:1", "N/A"]
FACTS = "seconds fps video_codec profile width height sar dar pix_fmt video_bitrate rotation color_transfer is_hdr audio created".split()


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path)) == "STRING", _get(v, path, "string"))


def whole(v: Column, path: str) -> Column:
    """A whole number, as a number (what is behind its point goes) or as text of digits."""
    k, t = _kind(_get(v, path)), _get(v, path, "string")
    return F.when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), _get(v, path, "double").cast("long")).when((k == "STRING") & t.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(t).try_cast("long"))


def real(v: Column, path: str) -> Column:
    """A number, or text that is one."""
    return F.when(_kind(_get(v, path)).isin("BIGINT", "DECIMAL", "DOUBLE", "STRING"), F.trim(_get(v, path, "string")).try_cast("double"))


def _ratio(v: Column, path: str) -> Column:
    t = _text(v, path)
    return F.when(~t.isin(NO_RATIO), t)


def _rotation(video: Column) -> Column:
    """Degrees below 360, counter-clockwise: the clockwise tag turned round, else the first matrix that has a number."""
    tag = real(video, "tags.rotate")
    sides = F.filter(_get(video, "side_data_list", "array<variant>"), lambda s: (_text(s, "side_data_type") == "Display Matrix") & real(s, "rotation").isNotNull())
    matrix = real(F.get(sides, F.lit(0)), "rotation")
    return F.coalesce(F.pmod(-F.bround(tag).cast("long"), F.lit(360)), F.pmod(F.bround(matrix).cast("long"), F.lit(360)))


def probed(df: DataFrame, json: str = "json", size: str | None = None) -> DataFrame:
    """df with the facts of each document and problem, null where it is good. size: a column with the file's size, null for a file that is not there.

    problem: absent, empty (no bytes), unreadable (no JSON object), no video, no size (of the picture), no rate. The first video stream and the first audio stream hold. A rate is the average one, else the base one, above 0 and at most 1000.
    """
    x = df.withColumn("_v", F.try_parse_json(json))
    v = F.col("_v")
    streams = F.coalesce(_get(v, "streams", "array<variant>"), F.array().cast("array<variant>"))
    first = lambda kind: F.get(F.filter(streams, lambda s: _text(s, "codec_type") == kind), F.lit(0))
    x = x.withColumns({"_video": first("video"), "_audio": first("audio")})
    video, audio = F.col("_video"), F.col("_audio")
    good_rate = lambda r: F.when((r > 0) & (r <= MAX_RATE), r)
    transfer = _text(video, "color_transfer")
    sound = F.struct(
        F.coalesce(_text(audio, "codec_name"), F.lit("unknown")).alias("codec"),
        whole(audio, "sample_rate").alias("sample_rate"),
        whole(audio, "channels").alias("channels"),
        _text(audio, "channel_layout").alias("channel_layout"),
    )
    facts = {
        "seconds": F.coalesce(real(v, "format.duration"), real(video, "duration"), F.lit(0.0)),
        "fps": F.coalesce(good_rate(rational(_text(video, "avg_frame_rate"))), good_rate(rational(_text(video, "r_frame_rate")))),
        "video_codec": F.coalesce(_text(video, "codec_name"), F.lit("unknown")),
        "profile": _text(video, "profile"),
        "width": whole(video, "width"),
        "height": whole(video, "height"),
        "sar": _ratio(video, "sample_aspect_ratio"),
        "dar": _ratio(video, "display_aspect_ratio"),
        "pix_fmt": _text(video, "pix_fmt"),
        # a rate of 0 is none
        "video_bitrate": F.coalesce(F.nullif(whole(video, "bit_rate"), F.lit(0)), whole(v, "format.bit_rate")),
        "rotation": _rotation(video),
        "color_transfer": transfer,
        "is_hdr": F.coalesce(transfer.isin(WIDE), F.lit(False)),
        "audio": F.when(audio.isNotNull(), sound),
        "created": F.coalesce(recorded_at(_text(v, "format.tags.creation_time")), recorded_at(_text(video, "tags.creation_time"))),
    }
    x = x.withColumns(facts)
    causes = []
    if size is not None:
        causes += [("absent", F.col(size).isNull()), ("empty", F.col(size) == 0)]
    causes += [
        ("unreadable", v.isNull() | (_kind(v) != "OBJECT")),
        ("no video", video.isNull()),
        ("no size", F.col("width").isNull() | F.col("height").isNull()),
        ("no rate", F.col("fps").isNull()),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in causes))
    x = x.withColumn("problem", problem)
    return x.select(*df.columns, *(F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in FACTS), "problem")


def split(df: DataFrame, name: str = "probes") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good, bad, {good, bad}) of probed rows: one pass writes both sides below the shared folder and counts them on the way. bad has the columns that the probe was given, and problem."""
    seen = Observation(f"{name}-{shared_folder(df.sparkSession, name).rsplit('-', 1)[-1]}")
    folder = shared_folder(df.sparkSession, name)
    marked = df.withColumn("_bad", F.col("problem").isNotNull())
    marked = marked.observe(seen, F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad"))
    marked.write.partitionBy("_bad").parquet(folder)
    both = df.sparkSession.read.schema(marked.schema).parquet(folder)
    good, bad = both.filter("not _bad").drop("_bad", "problem"), both.filter("_bad").drop("_bad", *FACTS)
    return good, bad, {k: int(n) for k, n in seen.get.items()}
