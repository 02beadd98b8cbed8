"""Who owns which file among the finished movies, and which of the old ones may go. Movies and posters are recorded by bare names, which lie in the year folder of their date or at the top; paths compare in NFC and without case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import recorded_output
from ..functions.scalars import fold


def poster_of(path: Column) -> Column:
    """The poster beside a movie: its name without the last suffix, and `-poster.jpg`."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("-poster.jpg"))


def absolute(path: Column, base: Column) -> Column:
    """A path below base, or an absolute one, without '.', '..' and empty parts; by its letters alone, whatever is linked."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.array_append(acc, p)).otherwise(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def recorded(manifests: DataFrame) -> DataFrame:
    """(event, kind, key): the files that manifests (event, output, poster) record, by their folded places. A name that is no bare one records nothing."""
    both = F.array(F.struct(F.lit("movie").alias("kind"), F.col("output").alias("name")), F.struct(F.lit("poster").alias("kind"), F.col("poster").alias("name")))
    x = manifests.select("event", F.explode(both).alias("f")).select("event", "f.kind", recorded_output(F.col("f.name")).alias("_place")).filter("_place is not null")
    return x.select("event", "kind", fold("_place").alias("key"))


def claimed(targets: DataFrame, manifests: DataFrame, on_disk: DataFrame, posters: bool = True) -> DataFrame:
    """(event, path, by): targets (event, path) of renders that would replace a file that other events' manifests record, with those events (array, sorted). The movie and its poster are a claim each; only regular files (on_disk: path, regular) can be replaced, and what the event's own manifest records is its own."""
    kinds = [F.struct(F.lit("movie").alias("kind"), F.col("path").alias("file"))] + ([F.struct(F.lit("poster").alias("kind"), poster_of(F.col("path")).alias("file"))] if posters else [])
    x = targets.select("event", "path", F.explode(F.array(*kinds)).alias("f")).select("event", "path", "f.kind", "f.file")
    x = x.join(on_disk.filter("regular").select(F.col("path").alias("file")).distinct(), "file", "left_semi").withColumn("key", fold("file"))
    r = recorded(manifests)
    x = x.join(r, ["event", "kind", "key"], "left_anti")
    other = r.select(F.col("event").alias("_by"), "kind", "key")
    return x.join(other, ["kind", "key"]).groupBy("event", "path").agg(F.array_sort(F.collect_set("_by")).alias("by"))


def prunable(manifests: DataFrame, on_disk: DataFrame, expected: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(event, path, current, poster): superseded movies that may be deleted, with the poster that goes with each (null: none).

    manifests: event, output, superseded (array), poster; on_disk: path, regular (the file itself, no link), inside (its folder lies in the output's), file (the same for names of one file, null if unknown); expected: event, path, where events will write; chosen: event, those asked about, all by default.

    The current movie must be there: else the old one is still the event's movie. An old movie stays if it is the current one under another spelling or name, no regular file inside, recorded as another event's movie, or expected by another event. Its poster stays if any event records it. Of two spellings of one path the least event's is told.
    """
    files = on_disk.filter("regular").select("path", "inside", "file")
    m = manifests if chosen is None else manifests.join(chosen.select("event"), "event", "left_semi")
    m = m.select("event", recorded_output(F.col("output")).alias("current"), "superseded").filter("current is not null")
    m = m.join(files.select(F.col("path").alias("current"), F.col("file").alias("_same")), "current").withColumn("_now", fold("current"))
    x = m.select("event", "current", "_now", "_same", F.explode("superseded").alias("_name")).select("*", recorded_output(F.col("_name")).alias("path")).filter("path is not null")
    x = x.join(files.filter("inside").select("path", "file"), "path").filter(~F.coalesce(F.col("file") == F.col("_same"), F.lit(False))).withColumn("key", fold("path")).filter("key <> _now")
    r = recorded(manifests)
    theirs = r.filter("kind = 'movie'").select(F.col("event").alias("_by"), "key").unionByName(expected.select(F.col("event").alias("_by"), fold("path").alias("key")))
    a, b = x.alias("a"), theirs.alias("b")
    x = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.event") != F.col("b._by")), "left_anti")
    x = x.groupBy("key").agg(F.min_by(F.struct("event", "path", "current"), F.struct("event", "path")).alias("f")).select("f.*")
    side = files.filter("inside").select(F.col("path").alias("_poster"), fold("path").alias("key")).join(r.filter("kind = 'poster'").select("key").distinct(), "key", "left_anti").select("_poster")
    x = x.withColumn("_poster", poster_of(F.col("path"))).join(side.withColumn("_there", F.lit(True)), "_poster", "left")
    return x.select("event", "path", "current", F.when(F.col("_there"), F.col("_poster")).alias("poster"))
