"""Temporal list join: captures against the list entries that were active at fetch time (operator 3).

List events (pattern, list, action, at), action 'add' or 'remove', become validity
intervals [from, to): an entry is active from an addition to the next removal of the
same (list, pattern). A pattern is a host, which covers its subdomains, or a host with a
path prefix. A capture's candidate patterns (its host and parent domains, each also with
the path's prefixes, as deep as the deepest pattern) are bounded by the url's labels and segments; they are matched by
equality, after the intervals of a pattern have been gathered into one sorted array, and
the as-of test runs inside that array. So the join adds no row whatever a host's history
is, and a hot host's captures can be split.

Defined cases: a null or empty url, or a null fetch time, matches nothing; hosts of urls
and patterns are compared in lower case and without a leading ``www.``, a dot last, user
and port, patterns without scheme, query and fragment, paths as they stand; a pattern
without a host is none; repeated events change nothing; a removal at the same instant as an addition wins;
captures repeated stay repeated; empty lists or captures give empty matches; columns
named lists, patterns or blocked give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Host in lower case without port, user and a leading www."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(raw, r"^www\.|\.$", "")


def candidates(url: Column, segments: int) -> Column:
    """Patterns of at most so many path segments that would cover a url."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    parts = F.array_remove(F.split(path, "/"), "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(segments))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, 1, k)))))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(url.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def plain_pattern(pattern: Column) -> Column:
    """A pattern as captures are compared with it: its host as `host_of` gives it, its path without query, fragment and slashes last; null if no host is left."""
    rest = F.regexp_replace(F.trim(pattern), r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)), "^[^@]*@", ""), r":[0-9]*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), "/+", "/")
    return F.concat(F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit("")), F.regexp_replace(path, "/$", ""))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, list, valid_from, valid_to); valid_to is null while the entry is active."""
    e = events.select(plain_pattern(F.col("pattern")).alias("pattern"), "list", "action", "at").filter("pattern is not null and at is not null").distinct()
    # at one instant a removal wins
    one = e.groupBy("pattern", "list", "at").agg((F.sum(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("on"))
    by = W.partitionBy("pattern", "list").orderBy("at")
    # an addition while active changes nothing: only changes of state open and close intervals
    changes = one.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).filter("on <> was")
    return changes.withColumn("valid_to", F.lead("at").over(by)).filter("on").select("pattern", "list", F.col("at").alias("valid_from"), "valid_to")


def match(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with lists (sorted names of the lists that cover the capture at its fetch time), patterns (those that matched) and blocked."""
    history = intervals(events).groupBy("pattern").agg(F.sort_array(F.collect_set(F.struct("valid_from", "valid_to", "list"))).alias("_hist"))
    # one number: no pattern has more path segments, so longer prefixes match nothing
    segments = history.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    own = [c for c in captures.columns if c not in ("lists", "patterns", "blocked")]
    # a capture's match depends on its url and time alone, so equal pairs are matched once
    pairs = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).filter("_url is not null and _at is not null").distinct()
    keyed = pairs.withColumn("pattern", F.explode(candidates(F.col("_url"), segments)))
    hit = keyed.join(history, "pattern").withColumn("_now", F.filter("_hist", lambda x: (x["valid_from"] <= F.col("_at")) & (x["valid_to"].isNull() | (F.col("_at") < x["valid_to"]))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("_now", lambda x: x["list"])))))
    hit = hit.filter(F.size("_now") > 0).groupBy("_url", "_at").agg(names.alias("_lists"), F.array_sort(F.collect_set("pattern")).alias("_patterns"))
    none = F.array().cast("array<string>")
    x = captures.join(hit, (captures[url] == hit["_url"]) & (captures[fetched] == hit["_at"]), "left")
    return x.select(*(captures[c] for c in own), F.coalesce("_lists", none).alias("lists"), F.coalesce("_patterns", none).alias("patterns"), F.col("_lists").isNotNull().alias("blocked"))
