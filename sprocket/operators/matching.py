"""Matching edited documents with what they were: spans, chapters, posters and cards."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import fold


def match_spans(have: DataFrame, want: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """(keys, want, have, rule): the old span each wanted span takes over, each old one at most once; have and rule are null where none is left.

    The rules hold in turn, each among what the earlier ones left: the same span, the same start, the same end, the order. Within a rule the n-th wanted span of a value takes the n-th old one of that value. Both sides are one table, dealt out by key and sorted once; of a key, a clip, its spans are held, and all rules are decided there. `index` orders the spans of a key and must be unique there. Null matches null.
    """
    side = lambda df, new: df.select(*keys, F.lit(new).alias("_new"), F.col(index).alias("_i"), "start", "end")
    same = lambda v: "NaN" if v != v else v
    rules: list[tuple[str, Callable[[tuple], tuple]]] = [("same", lambda s: s[1:]), ("start", lambda s: s[1:2]), ("end", lambda s: s[2:]), ("order", lambda s: ())]

    def step(state: tuple[list, list], row: list) -> tuple[list, list]:
        new, i, start, end = row
        state[new].append((i, same(start), same(end)))
        return state

    def finish(state: tuple[list, list]) -> tuple[list]:
        old, wanted = state
        out = []
        for rule, value in rules:
            free: dict[tuple, deque] = {}
            for s in old:
                free.setdefault(value(s), deque()).append(s)
            rest = []
            for s in wanted:
                first = free.get(value(s))
                if first:
                    out.append((s[0], first.popleft()[0], rule))
                else:
                    rest.append(s)
            if len(rest) < len(wanted):
                left = {s[0] for spans in free.values() for s in spans}
                old, wanted = [s for s in old if s[0] in left], rest
        return ([*out, *((s[0], None, None) for s in wanted)],)

    both = side(have, False).unionByName(side(want, True))
    match = T.StructType([T.StructField("want", want.schema[index].dataType), T.StructField("have", have.schema[index].dataType), T.StructField("rule", T.StringType())])
    x = fold(both, keys, lambda: ([], []), step, finish, [T.StructField("_m", T.ArrayType(match))])
    return x.select(*keys, F.inline("_m"))


def pair_chapters(wanted: DataFrame, existing: DataFrame, event: str = "event", chapter: str = "chapter", clips: str = "clips", order: str | None = None) -> DataFrame:
    """(event, wanted, existing, shared): chapters paired one to one by the clips they share: equal lists first, then more shared clips, then the order of both (the column `order`, or the chapter itself). Chapters without a shared clip pair with nothing.

    Shared clips are counted by a join on (event, clip); the greedy choice sees an event's candidate pairs only.
    """
    lists = lambda df, name: df.select(F.col(event).alias("event"), F.col(chapter).alias(name), F.col(order or chapter).alias(f"_{name}"), F.col(clips).alias(f"_all_{name}"))
    w, e = lists(wanted, "wanted"), lists(existing, "existing")
    # a chapter that stands there twice has its clips once
    one = lambda df, name: df.select("event", name, F.explode(F.array_distinct(f"_all_{name}")).alias("clip")).distinct()
    shared = one(w, "wanted").join(one(e, "existing"), ["event", "clip"]).groupBy("event", "wanted", "existing").agg(F.count("*").alias("shared"))
    x = shared.join(w, ["event", "wanted"]).join(e, ["event", "existing"])
    x = x.select("event", "wanted", "existing", "shared", "_wanted", "_existing", (F.col("_all_wanted") != F.col("_all_existing")).alias("_differs"))
    extra = ["_wanted", "_existing", "_differs"]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_differs", "shared", "_wanted", "_existing"], ascending=[True, False, True, True])
        seen: tuple[set, set] = (set(), set())
        keep = []
        for a, b in zip(rows["wanted"], rows["existing"], strict=True):
            free = a not in seen[0] and b not in seen[1]
            keep.append(free)
            if free:
                seen[0].add(a)
                seen[1].add(b)
        return rows[keep].drop(columns=extra)

    return x.groupBy("event").applyInPandas(choose, x.drop(*extra).schema)


def resolve_posters(played: DataFrame, posters: DataFrame, order: list[str], event: str = "event", position: float = 0.5) -> DataFrame:
    """(event, clip, at, source, problem): the frame of each event's poster.

    played: event, clip, duration and the columns of order, a row for each played clip; posters: event, clip, at, at most a row for each event. A poster of a played clip holds ('explicit'; problem 'past end' if at is not before the clip's end). Otherwise the first played clip at `position` of its duration ('default'; problem 'not played' if a poster was asked for). Events without played clips have no row.
    """
    p = posters.select(F.col(event).alias("event"), F.col("clip").alias("_clip"), F.col("at").alias("_at"))
    x = played.select(F.col(event).alias("event"), "clip", "duration", F.struct(*order).alias("_o")).join(p, "event", "left")
    g = x.groupBy("event").agg(
        F.min_by(F.struct("clip", "duration"), "_o").alias("first"),
        F.min_by("duration", F.when(F.col("clip") == F.col("_clip"), F.col("_o"))).alias("_len"),
        F.max(F.col("clip") == F.col("_clip")).alias("_hit"),
        F.first("_clip").alias("_clip"),
        F.first("_at").alias("_at"),
    )
    hit = F.coalesce("_hit", F.lit(False))
    problem = F.when(hit & (F.col("_at") >= F.col("_len")), "past end").when(~hit & F.col("_clip").isNotNull(), "not played")
    at = F.when(hit, F.col("_at").cast("double")).otherwise(F.col("first.duration") * F.lit(position))
    return g.select("event", F.when(hit, F.col("_clip")).otherwise(F.col("first.clip")).alias("clip"), at.alias("at"), F.when(hit, "explicit").otherwise("default").alias("source"), problem.alias("problem"))


def overlaid(fields: dict[str, object], *layers: str) -> list[Column]:
    """A column for each field: the first layer (alias of a joined side) that has a value, else the default. Later layers are weaker."""
    return [F.coalesce(*(F.col(f"{side}.{name}") for side in layers), F.lit(default)).alias(name) for name, default in fields.items()]


def resolve_cards(chapters: DataFrame, styles: DataFrame, cards: DataFrame, fields: dict[str, object], event: str = "event", chapter: str = "chapter") -> DataFrame:
    """(event, chapter, fields): a card's settings: its own, else its event's style, else the default."""
    c, s, k = chapters.alias("c"), styles.alias("s"), cards.alias("k")
    x = c.join(s, F.col(f"c.{event}") == F.col(f"s.{event}"), "left")
    x = x.join(k, (F.col(f"c.{event}") == F.col(f"k.{event}")) & (F.col(f"c.{chapter}") == F.col(f"k.{chapter}")), "left")
    return x.select(F.col(f"c.{event}").alias(event), F.col(f"c.{chapter}").alias(chapter), *overlaid(fields, "k", "s"))


def card_anchors(segments: DataFrame, titles: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, anchor): where a chapter's card goes: the first segment of its title clip, else the first source segment. segments: keys, pos, clip, kind; titles: keys, title."""
    x = segments.join(titles, keys, "left")
    own, first = F.min(F.when(F.col("clip") == F.col("title"), F.col(pos))), F.min(F.when(F.col("kind") == "source", F.col(pos)))
    return x.groupBy(*keys).agg(F.coalesce(own, first).alias("anchor")).filter("anchor is not null")
