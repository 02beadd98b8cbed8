"""Claims on files and old movies that may go."""

import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.functions import scalars as S
from sprocket.operators import claims
from sprocket.plans import ownership  # noqa: F401
from sprocket.plans import queries as Q


@pytest.mark.parametrize("name", ["prunable_movies", "claimed_files", "superseded_prune", "name_parse"])
def test_against_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])


def manifests(spark, *rows):
    return spark.createDataFrame(list(rows), "event string, output string, superseded array<string>, poster string")


def disk(spark, *paths):
    return spark.createDataFrame([(p, True, True, None) if isinstance(p, str) else p for p in paths], "path string, regular boolean, inside boolean, file string")


def none(spark):
    return spark.createDataFrame([], "event string, path string")


def pruned(spark, m, d, e=None, **more):
    return sorted((r["event"], r["path"], r["poster"]) for r in claims.prunable(m, d, none(spark) if e is None else e, **more).collect())


def test_an_old_movie_goes_with_its_poster(spark):
    m = manifests(spark, ("a", "2024-05-01 - New.mp4", ["2023-05-01 - Old.mp4", "x/y.mp4", "..", "Gone.mp4"], "2024-05-01 - New-poster.jpg"))
    d = disk(spark, "2024/2024-05-01 - New.mp4", "2023/2023-05-01 - Old.mp4", "2023/2023-05-01 - Old-poster.jpg")
    assert pruned(spark, m, d) == [("a", "2023/2023-05-01 - Old.mp4", "2023/2023-05-01 - Old-poster.jpg")]
    # not rendered under its new name
    assert pruned(spark, m, disk(spark, "2023/2023-05-01 - Old.mp4")) == []
    # a poster that some event records stays, even its own
    own = manifests(spark, ("a", "N.mp4", ["Old.mp4"], "OLD-poster.jpg"))
    assert pruned(spark, own, disk(spark, "N.mp4", "Old.mp4", "Old-poster.jpg")) == [("a", "Old.mp4", None)]


@pytest.mark.parametrize(
    ("old", "files", "others", "expected"),
    [
        ("m.mp4", ["M.mp4", "m.mp4"], [], []),  # the current one in another case
        ("Mär.mp4", ["M.mp4", "Mär.mp4"], [("b", "MÄR.mp4", [], None)], []),  # another event's movie, decomposed and in another case
        ("o.mp4", ["M.mp4", "o.mp4"], [], [("b", "O.mp4")]),  # another event will write it
        ("o.mp4", ["M.mp4", ("o.mp4", False, True, None)], [], []),  # a link
        ("o.mp4", ["M.mp4", ("o.mp4", True, False, None)], [], []),  # outside
        ("o.mp4", [("M.mp4", True, True, "7"), ("o.mp4", True, True, "7")], [], []),  # two names of one file
    ],
)
def test_what_stays(spark, old, files, others, expected):
    m = manifests(spark, ("a", "M.mp4", [old], None), *others)
    e = spark.createDataFrame(expected, "event string, path string") if expected else none(spark)
    assert pruned(spark, m, disk(spark, *files), e) == []


def test_own_expectations_and_chosen_events(spark):
    m = manifests(spark, ("a", "M.mp4", ["o.mp4"], None), ("b", "N.mp4", ["o.mp4", "p.mp4"], None), ("c", "x/N.mp4", ["q.mp4"], None))
    d = disk(spark, "M.mp4", "N.mp4", "o.mp4", "p.mp4", "q.mp4")
    assert pruned(spark, m, d, spark.createDataFrame([("b", "p.mp4")], "event string, path string")) == [("a", "o.mp4", None), ("b", "p.mp4", None)]
    assert pruned(spark, m, d, chosen=spark.createDataFrame([("b",)], "event string")) == [("b", "o.mp4", None), ("b", "p.mp4", None)]


def test_movie_and_poster_are_claims(spark):
    m = manifests(spark, ("b", "Lake.mp4", [], "Lake-poster.jpg"), ("c", "Sea.mp4", [], "lake-poster.jpg"), ("d", None, [], None))
    t = spark.createDataFrame([("a", "LAKE.mp4"), ("b", "Lake.mp4"), ("e", "Hill.mp4")], "event string, path string")
    by = lambda d, **k: {(r["event"], r["path"]): r["by"] for r in claims.claimed(t, m, disk(spark, *d), **k).collect()}
    assert by(["LAKE.mp4"]) == {("a", "LAKE.mp4"): ["b"]}
    assert by(["LAKE.mp4", "LAKE-poster.jpg"]) == {("a", "LAKE.mp4"): ["b", "c"]}
    assert by(["LAKE-poster.jpg"], posters=False) == {} and by([("LAKE.mp4", False, True, None)]) == {}
    # its own files are its own, though another records them, too
    assert by(["Lake.mp4", "Lake-poster.jpg"]) == {}


def test_paths_by_their_letters(spark):
    rows = [("a/./b//c", "/m"), ("/x/../y", "/m"), ("../../z", "/m/n"), ("", "/m"), ("..", "/")]
    got = spark.createDataFrame(rows, "p string, b string").select(claims.absolute(F.col("p"), F.col("b")).alias("a")).collect()
    assert [r["a"] for r in got] == ["/m/a/b/c", "/y", "/z", "/m", "/"]


def test_folding_of_any_script(spark):
    texts = ["Straße", "STRASSE", "ΣΑΣ", "σας", "Ä", "ä", "plain", "PLAIN", "", None, "İ", "ﬁ"]
    import unicodedata

    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.fold("t").alias("f")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t).casefold() for t in texts]
