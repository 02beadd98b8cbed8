"""Spellings of patterns."""

import pytest
from pyspark.sql import functions as F

from sprocket.llm import urllists

URL = "https://Sub.Evil.org:8443/a/b?q=1#f"


@pytest.mark.parametrize("pattern", ["evil.org", "http://evil.org", "HTTPS://EVIL.ORG/a", "evil.org:8080", "evil.org.", "www.evil.org/a/b/", "//evil.org/a", "user@evil.org", "sub.evil.org//a?x#y", " evil.org "])
def test_spellings_that_cover(spark, pattern):
    captures = spark.createDataFrame([(1, URL, 5)], "id int, url string, fetched_at long")
    events = spark.createDataFrame([(pattern, "l", "add", 1)], "pattern string, list string, action string, at long")
    assert urllists.match(captures, events).first()["lists"] == ["l"]


@pytest.mark.parametrize("pattern", ["", "/", "http://", "/a/b", "vil.org", "evil.org/a/bb", "evil.org/b", None])
def test_patterns_that_do_not(spark, pattern):
    captures = spark.createDataFrame([(1, URL, 5)], "id int, url string, fetched_at long")
    events = spark.createDataFrame([(pattern, "l", "add", 1)], "pattern string, list string, action string, at long")
    assert urllists.match(captures, events).first()["lists"] == []


def test_plain_patterns(spark):
    rows = spark.createDataFrame([("www.example.com/x/",), ("A.b:1/C",)], "p string").select(urllists.plain_pattern(F.col("p")).alias("p")).collect()
    assert [r["p"] for r in rows] == ["example.com/x", "a.b/C"]
