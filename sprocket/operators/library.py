"""A library's folders and documents: listings, clip order, resolution, sidecars, claims and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import latest_per_key

#: Suffixes of videos, and the folder of unconverted originals.
VIDEOS = ".mp4 .mov .m4v .avi .mkv .mts .m2ts .mpg .mpeg .wmv .3gp .flv .webm".split()
ORIGINALS = "original"


def list_events(folders: DataFrame, years: list[str] | None = None) -> DataFrame:
    """Folders that are events. folders: root, path, year, real, linked (a link was crossed), marked (to be ignored), pos (in walk order).

    Marked ones go first. Of folders with one real path the first that no link leads to is kept, else the first. Years are chosen only then, so that an alias in a chosen year of an event in another is still seen as one.
    """
    live = folders.filter(~F.coalesce("marked", F.lit(False)))
    one = latest_per_key(live, ["root", "real"], [F.coalesce("linked", F.lit(False)), F.col("pos")])
    return one if years is None else one.filter(F.col("year").isin(*years))


def list_videos(files: DataFrame, marked: DataFrame) -> DataFrame:
    """(event, chapter, clip): videos in an event's folder and one level below; the folder below is the chapter. files: event, path (within the event); marked: event, chapter, folders to be ignored. Originals are left out."""
    parts = F.split("path", "/")
    x = files.filter((F.size(parts) <= 2) & F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))).isin(*VIDEOS))
    x = x.select("event", F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise("").alias("chapter"), F.col("path").alias("clip"))
    return x.filter(F.lower("chapter") != ORIGINALS).join(marked, ["event", "chapter"], "left_anti")


def order_clips(clips: DataFrame, orders: DataFrame, custom: DataFrame) -> DataFrame:
    """clips with pos, from 1 in each (event, chapter). clips: event, chapter, clip, mtime; orders: event, method (datetime, filename or custom), reverse; custom: event, name, place.

    Equal times, and clips without a place, go by natural name, then by the whole path; reverse turns ties round, too.
    """
    name = F.substring_index("clip", "/", -1)
    x = clips.join(orders, "event", "left").withColumn("_name", name)
    x = x.join(custom.select("event", F.col("name").alias("_name"), F.col("place").alias("_place")), ["event", "_name"], "left")
    time = F.when(F.col("method") == "datetime", F.col("mtime"))
    place = F.when(F.col("method") == "custom", F.col("_place"))
    by = W.partitionBy("event", "chapter")
    x = x.withColumn("_n", F.row_number().over(by.orderBy(time, place.isNull(), place, S.natural_key(F.col("_name")), "clip")))
    pos = F.when(F.coalesce("reverse", F.lit(False)), F.count("*").over(by) + 1 - F.col("_n")).otherwise(F.col("_n"))
    return x.select(*clips.columns, pos.cast("long").alias("pos"))


def seed_documents(ordered: DataFrame) -> DataFrame:
    """(event, chapter, clips): chapters of a new document, their clips in order. Of a chapter's rows only the clips are gathered."""
    clips = F.transform(F.array_sort(F.collect_list(F.struct("pos", "clip"))), lambda x: x["clip"])
    return ordered.groupBy("event", "chapter").agg(clips.alias("clips"))


SIDECAR = "struct<version:int,signal:struct<size:bigint,mtime_ns:bigint>,segments:array<struct<start:double,end:double,kind:string>>,failure:string>"


def sidecar_kinds(listing: DataFrame, sidecars: DataFrame, version: int = 1) -> DataFrame:
    """listing with kind, segments and failure of each clip's sidecar. listing: event, clip, size, mtime_ns; sidecars: event, clip, json.

    absent: there is none; result or failure: it is of this version and of the clip as it is; other: anything else, damaged text among it. segments is null but for a result.
    """
    x = listing.join(sidecars.select("event", "clip", "json"), ["event", "clip"], "left").withColumn("_s", F.from_json("json", SIDECAR))
    mine = (F.col("_s.version") == version) & (F.col("_s.signal.size") == F.col("size")) & (F.col("_s.signal.mtime_ns") == F.col("mtime_ns"))
    whole = F.col("_s.segments").isNotNull() & F.forall("_s.segments", lambda s: F.coalesce((s["end"] > s["start"]) & s["kind"].isNotNull(), F.lit(False)))
    kind = F.when(F.col("json").isNull(), "absent").when(~F.coalesce(mine, F.lit(False)), "other").when(whole, "result").when(F.col("_s.segments").isNull() & F.col("_s.failure").isNotNull(), "failure").otherwise("other")
    x = x.withColumn("kind", kind)
    return x.select(*listing.columns, "kind", F.when(F.col("kind") == "result", F.col("_s.segments")).alias("segments"), F.when(F.col("kind") == "failure", F.col("_s.failure")).alias("failure"))


def pending_clips(kinds: DataFrame) -> DataFrame:
    """Clips that an analysis would read: those without a result or a failure of the clip as it is."""
    return kinds.filter(F.col("kind").isin("absent", "other"))


def resolve_clips(refs: DataFrame, props: DataFrame, facts: DataFrame) -> DataFrame:
    """(event, chapter, pos, clip, rotate, is_title, problem): the clips that play. refs: event, chapter, pos, clip; props: event, clip, title (three states), exclude, rotate; facts: event, clip, duration.

    Excluded clips go. A chapter's title clip is the first with title true, else the first whose title is not false. problem is 'no facts' for a clip that was never probed.
    """
    x = refs.join(props, ["event", "clip"], "left").filter(~F.coalesce("exclude", F.lit(False)))
    x = x.join(facts.select("event", "clip", F.lit(True).alias("_known")), ["event", "clip"], "left")
    # a smaller struct wins: explicit titles first, then clips without an override, in order
    rank = F.when(F.coalesce("title", F.lit(True)), F.struct(F.when(F.col("title"), 0).otherwise(1).alias("r"), "pos"))
    first = F.min(rank).over(W.partitionBy("event", "chapter"))
    return x.select("event", "chapter", "pos", "clip", "rotate", F.coalesce(rank == first, F.lit(False)).alias("is_title"), F.when(F.col("_known").isNull(), "no facts").alias("problem"))


def flatten_segments(clips: DataFrame, kept: DataFrame) -> DataFrame:
    """(event, chapter, pos, part, clip, start, end): a row for each kept span of each playing clip, in order. kept: event, clip, start, end."""
    part = F.row_number().over(W.partitionBy("event", "chapter", "pos", "clip").orderBy("start"))
    return clips.join(kept, ["event", "clip"]).select("event", "chapter", "pos", part.alias("part"), "clip", "start", "end")


def unplayed_posters(posters: DataFrame, played: DataFrame, ignored: DataFrame, props: DataFrame) -> DataFrame:
    """(event, clip, reason): posters whose clip is not in the movie: ignored, excluded or missing."""
    x = posters.join(played.select("event", "clip"), ["event", "clip"], "left_anti")
    x = x.join(ignored.select("event", "clip", F.lit(True).alias("_i")).distinct(), ["event", "clip"], "left").join(props.select("event", "clip", F.col("exclude").alias("_x")), ["event", "clip"], "left")
    return x.select("event", "clip", F.when(F.col("_i"), "ignored").when(F.col("_x"), "excluded").otherwise("missing").alias("reason"))


def document_problems(refs: DataFrame, props: DataFrame, ignored: DataFrame) -> DataFrame:
    """(event, clip, problem): clips referred to twice, properties of clips without a reference, and ignored clips with one."""
    used = refs.select("event", "clip").distinct()
    twice = refs.groupBy("event", "clip").count().filter("count > 1").select("event", "clip", F.lit("duplicate").alias("problem"))
    dangling = props.select("event", "clip").distinct().join(used, ["event", "clip"], "left_anti").withColumn("problem", F.lit("dangling"))
    return twice.unionByName(dangling).unionByName(ignored.select("event", "clip").distinct().join(used, ["event", "clip"], "left_semi").withColumn("problem", F.lit("ignored and used")))


def fold_twins(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, folded, names): names that differ in case only."""
    return names.groupBy(key, S.fold(F.col(name)).alias("folded")).agg(F.sort_array(F.collect_list(name)).alias("names")).filter(F.size("names") > 1).select(key, "folded", F.array_join("names", ",").alias("names"))


def claimed_movies(targets: DataFrame, manifests: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(event, path, by): files on disk that an event is about to write, with the other events whose manifests record them. targets: event, path; manifests: event, path. A path that the event's own manifest records is its own."""
    x = targets.join(on_disk.select("path").distinct(), "path", "left_semi").join(manifests.select("event", "path"), ["event", "path"], "left_anti")
    other = manifests.select(F.col("event").alias("_by"), "path")
    return x.join(other, "path").groupBy("event", "path").agg(F.array_join(F.array_sort(F.collect_set(F.col("_by").cast("string"))), ",").alias("by"))


def place_clips(new: DataFrame, chapters: DataFrame) -> DataFrame:
    """new (event, folder, clip) with chapter: the one named like its folder, else one that differs in case only, else the first without a name (''). chapters: event, chapter, pos."""
    exact = chapters.select("event", F.col("chapter").alias("folder"), F.col("chapter").alias("_exact")).distinct()
    loose = chapters.groupBy("event", S.fold("chapter").alias("_f")).agg(F.min_by("chapter", "pos").alias("_loose"))
    x = new.withColumn("_f", S.fold("folder")).join(exact, ["event", "folder"], "left").join(loose, ["event", "_f"], "left")
    return x.select(*new.columns, F.coalesce("_exact", "_loose", F.lit("")).alias("chapter"))


def processable(meta: DataFrame, today: Column) -> DataFrame:
    """meta (date, title) with reason: why an event cannot be rendered; null if it can."""
    title = F.nullif(F.trim("title"), F.lit(""))
    return meta.withColumn("reason", F.when(F.col("date").isNull(), "no date").when(title.isNull(), "no title").when(F.col("date") > today, "in the future"))


def tally(df: DataFrame, key: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """(key, n_<outcome>): how often each outcome occurs."""
    return df.groupBy(key).agg(*(F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes))
