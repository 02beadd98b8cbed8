"""An event as its page shows it: chapters with the clips on disk, adoption, played time, title cards, and the sweep that queues analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from . import catalog, intervals, library, timeline

#: Kinds of running jobs during which no analysis is queued, and states of clips that a render plays.
BUSY = ("render", "proxy")
PLAYED = ("active", "new")


# ------------------------------------------------------------------ documents and disk


def placed_clips(chapters: DataFrame, refs: DataFrame, listing: DataFrame) -> DataFrame:
    """(event, chapter, pos, clip): clips of the listing that the document does not name, at the ends of the chapters that they enter.

    chapters: event, chapter, pos; refs: event, chapter, pos, clip; listing: event, folder, clip, place (its order among the event's clips). The chapter is that of the folder's name, exactly or else but for case, or the one without a name; in an event without chapters each folder is one.
    """
    new = listing.join(refs.select("event", "clip"), ["event", "clip"], "left_anti")
    known = chapters.groupBy("event").agg(F.lit(True).alias("_known"))
    x = library.place_clips(new, chapters).join(known, "event", "left").withColumn("chapter", F.when(F.col("_known"), F.col("chapter")).otherwise(F.col("folder")))
    ends = refs.groupBy("event", "chapter").agg(F.max("pos").alias("_end"))
    n = F.row_number().over(W.partitionBy("event", "chapter").orderBy("place", "clip"))
    return x.withColumn("_n", n).join(ends, ["event", "chapter"], "left").select("event", "chapter", (F.coalesce("_end", F.lit(0)) + F.col("_n")).cast("long").alias("pos"), "clip")


def event_detail(chapters: DataFrame, refs: DataFrame, listing: DataFrame, facts: DataFrame) -> DataFrame:
    """(event, chapter_pos, chapter, pos, clip, status, excluded, duration, proxy): every clip of the document or the disk, chapters from 1.

    facts: event, clip, status, excluded, duration, proxy; a clip without a row there is missing if the document names it, else new. Chapters that the document lacks come last, by name.
    """
    rows = refs.select("event", "chapter", F.col("pos").cast("long").alias("pos"), "clip", F.lit("missing").alias("_or"))
    rows = rows.unionByName(placed_clips(chapters, refs, listing).withColumn("_or", F.lit("new")))
    x = rows.join(chapters.select("event", "chapter", F.col("pos").alias("_at")), ["event", "chapter"], "left").join(facts, ["event", "clip"], "left")
    nth = F.dense_rank().over(W.partitionBy("event").orderBy(F.col("_at").isNull(), "_at", "chapter"))
    return x.select("event", nth.cast("long").alias("chapter_pos"), "chapter", "pos", "clip", F.coalesce("status", "_or").alias("status"), F.coalesce("excluded", F.lit(False)).alias("excluded"), "duration", "proxy")


def adopted(chapters: DataFrame, refs: DataFrame, listing: DataFrame, ignored: DataFrame) -> DataFrame:
    """(event, chapter, pos, clip, entered): a document's clips and those on disk that enter it. Ignored ones stay out, missing ones stay in."""
    new = listing.join(ignored.select("event", "clip"), ["event", "clip"], "left_anti")
    kept = refs.select("event", "chapter", F.col("pos").cast("long").alias("pos"), "clip", F.lit(False).alias("entered"))
    return kept.unionByName(placed_clips(chapters, refs, new).withColumn("entered", F.lit(True)))


def ignored_after(ignored: DataFrame, refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(event, clip, problem): ignored clips (event, clip) and those wanted to be, once each; one that a chapter holds is refused."""
    used = refs.select("event", "clip", F.lit("in a chapter").alias("problem")).distinct()
    asked = wanted.select("event", "clip").join(ignored.select("event", "clip"), ["event", "clip"], "left_anti").distinct().join(used, ["event", "clip"], "left")
    return ignored.select("event", "clip", F.lit(None).cast("string").alias("problem")).distinct().unionByName(asked)


def shown_clips(detail: DataFrame) -> DataFrame:
    """Clips that an event's page plays: not ignored, excluded or missing."""
    return detail.filter((F.col("status") != "ignored") & ~F.col("excluded") & (F.col("status") != "missing"))


def omitted_counts(detail: DataFrame) -> DataFrame:
    """(event, missing, excluded): clips left out, ignored ones not counted; a missing clip that is excluded counts as excluded."""
    live = F.col("status") != "ignored"
    return detail.groupBy("event").agg(F.count_if(live & ~F.col("excluded") & (F.col("status") == "missing")).alias("missing"), F.count_if(live & F.col("excluded")).alias("excluded"))


def played_clips(detail: DataFrame) -> DataFrame:
    """Clips that a render plays: active or new, and not excluded."""
    return detail.filter(F.col("status").isin(*PLAYED) & ~F.col("excluded"))


def disk_folders(detail: DataFrame) -> DataFrame:
    """(event, folder): folders with a clip on disk, '' for the event's own."""
    folder = F.when(F.col("clip").contains("/"), F.regexp_extract("clip", "^(.*)/[^/]*$", 1)).otherwise("")
    return detail.filter("status <> 'missing'").select("event", folder.alias("folder")).distinct()


def kept_order(original: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clip, pos): the original order (keys, clip, pos) of what the present one (keys, clip) still holds, from 1. Of equal places the smaller clip comes first."""
    x = original.join(order.select(*keys, "clip"), [*keys, "clip"], "left_semi")
    return x.select(*keys, "clip", F.row_number().over(W.partitionBy(*keys).orderBy("pos", "clip")).cast("long").alias("pos"))


# ------------------------------------------------------------------ time and cards


def played_time(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """clips with played: the length less what the cuts cover, once."""
    kept = intervals.kept_spans(cuts, clips, keys, length).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_kept"))
    return clips.join(kept, keys, "left").select(*clips.columns, F.coalesce("_kept", F.lit(0)).alias("played"))


def movie_length(played: DataFrame, event: str) -> DataFrame:
    return played.groupBy(event).agg(F.sum("played").alias("length"))


def first_kept(cuts: DataFrame, clips: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """(keys, start, kept): the first stretch of footage of each clip that has any."""
    inner = timeline.interior_spans(cuts, clips, keys, length).groupBy(*keys).agg(F.min("start").alias("_next"))
    x = timeline.kept_extents(cuts, clips, keys, length).filter("out_at > in_at").join(inner, keys, "left")
    return x.select(*keys, F.col("in_at").alias("start"), (F.coalesce("_next", "out_at") - F.col("in_at")).alias("kept"))


def card_placements(cards: DataFrame, first: DataFrame) -> DataFrame:
    """(event, chapter, kind, index, at, width, clamped): where chapters' cards lie, in ms.

    cards: event, chapter, seconds, background, error (null: resolved), decorators (on, off or invalid); first: event, chapter, index, start, kept, for shown clips with footage. A card is unresolved, unreadable (a length below 1 ms, or a background that is neither black nor video), without footage, or lies at its chapter's first clip with footage; a video card is held to that stretch. Invalid decorators place nothing.
    """
    anchor = first.groupBy("event", "chapter").agg(F.min_by(F.struct("index", "start", "kept"), "index").alias("_a"))
    ms = F.when((F.col("seconds") > 0) & (F.col("seconds") < float("inf")), F.floor(F.col("seconds") * 1000 + 0.5))
    readable = F.coalesce((ms >= 1) & F.col("background").isin("black", "video"), F.lit(False))
    kind = F.when(F.col("error").isNotNull(), "unresolved").when(~readable, "unreadable").when(F.col("_a").isNull(), "no-footage").when(F.col("decorators") == "invalid", None).when(F.col("decorators") == "on", "anchored").otherwise("off")
    x = cards.join(anchor, ["event", "chapter"], "left").withColumn("kind", kind).filter("kind is not null")
    lies = F.col("kind").isin("anchored", "off")
    width = F.when(F.col("background") == "black", ms).otherwise(F.least(ms, F.col("_a.kept")))
    return x.select("event", "chapter", "kind", *(F.when(lies, c).alias(n) for n, c in (("index", F.col("_a.index")), ("at", F.col("_a.start")), ("width", width), ("clamped", (F.col("background") == "video") & (width < ms)))))


def card_text(name: Column, card_title: Column, card_subtitle: Column, title: Column, date: Column, location: Column) -> Column:
    """struct(heading, subtitle, problem) of a chapter's card: the card's own texts, else the chapter's name, or for the chapter without one ('') the event's title, day and place. A subtitle that is there but empty is none. A card without a heading is a problem."""
    heading = F.when(card_title != "", card_title).when(name != "", name).otherwise(F.coalesce(title, F.lit("")))
    subtitle = F.coalesce(card_subtitle, F.when(name == "", K.subtitle(date, location)).otherwise(""))
    return F.struct(heading.alias("heading"), subtitle.alias("subtitle"), F.when(F.trim(heading) == "", "no heading").alias("problem"))


def title_cards(event: Column, project: Column, default: tuple[str, ...] = ("title",)) -> Column:
    """struct(enabled, source): whether cards are drawn, and whose list of decorators decides: the event's, else the project's, else the default."""
    source = F.when(event.isNotNull(), "event").when(project.isNotNull(), "project").otherwise("default")
    chosen = F.coalesce(event, project, F.array(*map(F.lit, default)))
    return F.struct(F.array_contains(chosen, "title").alias("enabled"), source.alias("source"))


# ------------------------------------------------------------------ jobs


def job_outputs(jobs: DataFrame, projects: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, output): the path that a job writes; null if its project's settings cannot be read or its event claims none. jobs: id, project, event; projects: project, output_dir (relative to the project; null: a folder beside it, '<project>-output'), readable; claims: project, event, relpath."""
    x = jobs.join(projects, "project", "left").join(claims, ["project", "event"], "left")
    given = F.nullif("output_dir", F.lit(""))
    folder = F.when(given.isNull(), F.concat("project", F.lit("-output"))).when(given.startswith("/"), given).otherwise(F.concat_ws("/", "project", given))
    return x.select("id", F.when(F.coalesce("readable", F.lit(False)) & F.col("relpath").isNotNull(), F.concat_ws("/", folder, "relpath")).alias("output"))


def analysing(jobs: DataFrame, key: str) -> DataFrame:
    """(key, events): how many events have an analysis that waits or runs, each once."""
    active = (F.col("kind") == "analysis") & F.col("status").isin("queued", "running")
    return jobs.groupBy(key).agg(F.count_distinct(F.when(active, F.col("event"))).alias("events"))


def sweep_step(jobs: DataFrame, clips: DataFrame, k: int) -> DataFrame:
    """(project, event): the newest k events of each project whose analysis is due. A project is busy, and gives none, while a job of any kind waits or a render or proxy runs.

    jobs: id, project, event, kind, status, created_at, started_at, finished_at; clips: project, event (with its project's path, so that no two projects share one), pending, touched, newest (order of the events).
    """
    busy = jobs.filter((F.col("status") == "queued") | ((F.col("status") == "running") & F.col("kind").isin(*BUSY))).select("project").distinct()
    mine = jobs.filter("kind = 'analysis'")
    active = mine.filter("status = 'running'").select("event")
    due = catalog.due(clips, mine).join(active, "event", "left_anti")
    x = clips.groupBy("project", "event").agg(F.max("newest").alias("newest")).join(busy, "project", "left_anti").join(due, "event", "left_semi")
    n = F.row_number().over(W.partitionBy("project").orderBy(F.desc("newest"), "event"))
    return x.withColumn("_n", n).filter(F.col("_n") <= k).select("project", "event")


# ------------------------------------------------------------------ layouts

Layout = Callable[[DataFrame, list[str] | None], DataFrame]
_layouts: dict[str, Layout] = {"year-event": library.list_events, "flat": lambda folders, years: library.list_events(folders)}


def register_layout(name: str, layout: Layout) -> None:
    """The last layout of a name holds."""
    _layouts[name] = layout


def list_layout(name: str, folders: DataFrame, years: list[str] | None = None) -> DataFrame:
    if name not in _layouts:
        raise ValueError(f"no layout {name!r}; there are {', '.join(sorted(_layouts))}")
    return _layouts[name](folders, years)


def listed_event(name: str, folders: DataFrame, path: str) -> DataFrame:
    """The event of a path if the layout lists it, else none. Only its first folder's events are listed."""
    return list_layout(name, folders, [path.split("/")[0]]).filter(F.col("path") == path)
