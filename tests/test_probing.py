"""Probes, canonical text, post-conditions, chains and the events list."""

import datetime as dt
import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.functions import canonical
from sprocket.operators import chains, checks, listing
from sprocket.plans import probing  # noqa: F401
from sprocket.plans import queries as Q
from sprocket.sources import probes

NAMES = ["probed_clips", "probe_faults", "canonical_hashes", "event_fingerprints", "derivative_keys", "broken_proxies", "transferred_chains", "event_list"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])


def test_numbers_are_spelled_as_python_spells_them(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, 0.1, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 1.5e300, 5e-324, 2.2250738585072014e-308, 1e23, 2e23, 9007199254740993.0, 100.0, 0.5, math.inf, -math.inf, math.nan, 1 / 3, 2 / 3, 1234.5]
    xs += [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(3000)] + [round(r.uniform(-1e4, 1e4), r.randint(0, 6)) for _ in range(2000)] + [r.randint(-(10**18), 10**18) / 10 ** r.randint(0, 20) for _ in range(2000)]
    xs = [x for x in xs if not 1e20 < abs(x) < math.inf]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", canonical.number(F.col("x")).alias("t")).collect()
    wrong = [(xs[g["i"]], g["t"]) for g in got if g["t"] != json.dumps(xs[g["i"]])]
    assert wrong == []


def test_texts_are_escaped_as_python_escapes_them(spark):
    r = random.Random(2)
    texts = ["", "plain", 'a"b\\c', "\n\r\t\b\f\x00\x1f\x7f", "é日\U0001f600\U0010ffff￿", " /"] + ["".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 30))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", canonical.quoted(F.col("s")).alias("t")).collect()
    assert all(g["t"] == json.dumps(texts[g["i"]]) for g in got)


def test_nested_values(spark):
    kind = "struct<z:int,a:array<struct<in:double,out:double,reason:string>>,m:map<string,boolean>,d:date,gone:string,n:struct<b:string>>"
    value = (1, [(0.0, 2.5, None), (3.0, 1e20, "é")], {"b": True, "B": False, "é": None}, dt.date(2024, 1, 5), None, None)
    want = {"z": 1, "a": [{"in": 0.0, "out": 2.5, "reason": None}, {"in": 3.0, "out": 1e20, "reason": "é"}], "m": {"b": True, "B": False, "é": None}, "d": "2024-01-05", "n": None}
    x = spark.createDataFrame([(value,), (None,)], f"v {kind}").select(canonical.text(F.col("v"), kind, unset=("gone",)).alias("t"), canonical.digest(F.col("v"), kind, unset=("gone",)).alias("h")).collect()
    assert x[0]["t"] == json.dumps(want, sort_keys=True) and x[0]["h"] == hashlib.sha256(x[0]["t"].encode()).hexdigest() and x[1]["t"] == "null"
    with pytest.raises(TypeError):
        canonical.text(F.col("v"), "binary")


@pytest.mark.parametrize(
    ("doc", "problem"),
    [
        ("", "unreadable"), ("[]", "unreadable"), ("null", "unreadable"), ("{}", "no video"), ('{"streams": []}', "no video"),
        ('{"streams": [{"codec_type": "video", "width": 4}]}', "no size"), ('{"streams": [{"codec_type": "video", "width": "x", "height": 2}]}', "no size"),
        ('{"streams": [{"codec_type": "video", "width": 4, "height": 2}]}', "no rate"), ('{"streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "-25/1", "r_frame_rate": "1001/1"}]}', "no rate"),
        ('{"streams": [{"codec_type": "video", "width": "4", "height": 2.0, "avg_frame_rate": "25/1"}]}', None),
    ],
)
def test_causes(spark, doc, problem):
    r = probes.probed(spark.createDataFrame([(doc,)], "json string")).first()
    assert r["problem"] == problem and (problem is None) == (r["fps"] is not None)


def test_facts(spark):
    stream = {"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "25/1", "sample_aspect_ratio": "N/A", "display_aspect_ratio": "16:9", "bit_rate": "0", "tags": {"rotate": "-90.0"}, "side_data_list": [{"side_data_type": "Display Matrix", "rotation": 90}]}
    docs = [
        {"streams": [{"codec_type": "audio"}, stream, stream | {"width": 1}], "format": {"duration": "", "bit_rate": 7, "tags": {"creation_time": "no"}}},
        {"streams": [stream | {"tags": {"creation_time": "2024-02-03T04:05:06+02:00"}, "duration": "9.5", "bit_rate": "12"}], "format": {}},
    ]
    a, b = probes.probed(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")).collect()
    assert (a["width"], a["seconds"], a["rotation"], a["video_bitrate"], a["sar"], a["dar"], a["video_codec"], a["created"]) == (1920, 0.0, 90, 7, None, "16:9", "unknown", None)
    assert a["audio"].asDict() == {"codec": "unknown", "sample_rate": None, "channels": None, "channel_layout": None}
    assert (b["seconds"], b["rotation"], b["video_bitrate"], b["audio"], b["created"]["offset"]) == (9.5, 90, 12, None, 7200)


def test_an_empty_split(spark):
    good, bad, seen = probes.split(probes.probed(spark.createDataFrame([], "json string")))
    assert good.count() == bad.count() == 0 and seen == {"good": 0, "bad": 0}


PROXY = {"n_video": 1, "video_codec": "h264", "pix_fmt": "yuv420p", "width": 960, "height": 540, "sar": None, "n_audio": 1, "audio_codec": "aac", "channels": 2, "seconds": 10.0, "packets": 250, "want_width": 960, "want_height": 540, "want_seconds": 10.0, "want_audio": True, "want_frames": 250}
KIND = "n_video int, video_codec string, pix_fmt string, width int, height int, sar string, n_audio int, audio_codec string, channels int, seconds double, packets int, want_width int, want_height int, want_seconds double, want_audio boolean, want_frames int"


@pytest.mark.parametrize(
    ("changed", "rule", "found"),
    [
        ({}, None, None), ({"sar": "N/A"}, None, None), ({"sar": "4:3"}, "pixel aspect ratio", "4:3"), ({"n_video": 2, "video_codec": "x"}, "video streams", "2"), ({"video_codec": None}, "video codec", None),
        ({"width": 961}, "dimensions", "961x540"), ({"want_audio": False}, "audio streams", "1"), ({"want_audio": False, "n_audio": 0, "audio_codec": None, "channels": None}, None, None), ({"channels": 1}, "audio channels", "1"),
        ({"seconds": 10.05}, None, None), ({"seconds": 10.0501}, "video duration", "10.0501"), ({"seconds": None}, "video duration", None), ({"packets": None, "want_frames": None}, "packet count", None), ({"packets": 249}, "video frames", "249"), ({"packets": 249, "want_frames": None}, None, None),
    ],
)
def test_first_broken_rule_of_a_proxy(spark, changed, rule, found):
    r = checks.proxies(spark.createDataFrame([tuple((PROXY | changed).values())], KIND)).first()["broken"]
    assert (r and r["rule"], r and r["found"]) == (rule, found)


def test_first_broken_rule_of_a_movie(spark):
    rows = [(1, ["mjpeg"], 1920, 1080, "hevc", "yuv420p", None), (1, [], 1920, 1080, "hevc", "yuv420p", "1:1"), (1, ["mjpeg"], 1920, 1088, "h264", "x", "1:1"), (0, None, None, None, None, None, None), (1, ["mjpeg"], 1920, 1080, "hevc", "yuv420p", "4:3")]
    want = ("want_width", 1920), ("want_height", 1080), ("want_codec", "hevc"), ("want_pix_fmt", "yuv420p"), ("want_sar", "1:1"), ("want_cover", True)
    df = spark.createDataFrame(rows, "n_video int, covers array<string>, width int, height int, video_codec string, pix_fmt string, sar string")
    got = checks.movies(df.select("*", *(F.lit(v).alias(k) for k, v in want))).collect()
    assert [r["broken"] and (r["broken"]["rule"], r["broken"]["found"]) for r in got] == [None, ("cover", ""), ("resolution", "1920x1088"), ("video streams", "0"), ("pixel aspect ratio", "4:3")]


def test_transfers_of_many_chains(spark):
    rows = [("a", 1, "x", "system", "vaapi"), ("a", 2, "y", "system", "system"), ("a", 3, "z", "vaapi", "vaapi"), ("b", 1, "x", "vaapi", "vaapi"), ("b", 2, "y", "cuda", "cuda"), ("c", 1, "x", "system", "system"), ("d", 5, "p", "vaapi", "vaapi"), ("d", 9, "q", "vaapi", "system")]
    got = chains.with_transfers(spark.createDataFrame(rows, "chain string, pos int, op string, frames_in string, frames_out string")).orderBy("chain", "place").collect()
    assert [(r["chain"], r["op"]) for r in got] == [("a", "x"), ("a", "hwdownload"), ("a", "y"), ("a", "hwupload"), ("a", "z"), ("b", "x"), ("b", "hwdownload"), ("b", "y"), ("c", "x"), ("d", "p"), ("d", "q")]
    assert [(r["frames_in"], r["frames_out"]) for r in got if r["inserted"]] == [("vaapi", "system"), ("system", "vaapi"), ("vaapi", "cuda")]


def test_one_bad_event_does_not_cost_the_list(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    events = t([("a", None, None), ("b", "EACCES", None), ("c", None, "no date"), ("d", None, None), ("e", None, None)], "event string, fault string, metadata_problem string")
    docs = t([("a", None, "A", None, None), ("b", "malformed", "B", None, None), ("d", "malformed", "D", None, None)], "event string, problem string, title string, date date, location string")
    clip = "event string, clip string"
    rows = listing.event_rows(events, t([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")], clip), docs, t([("a", "1"), ("a", "4"), ("a", "5")], clip), t([("a", "2"), ("a", "9")], clip), t([("a", "5")], clip), t([("a", 1, "done", 5), ("a", 2, "failed", 5)], "event string, id int, status string, created_at int"), t([("a", True, ["x"]), ("b", True, [])], "event string, stale boolean, reasons array<string>"))
    got = {r["event"]: r for r in rows.collect()}
    assert [got[e]["failure"] for e in "abcde"] == [None, "unreadable disk", "unusable metadata", "unparseable document", None]
    a = got["a"]
    assert (a["title"], a["n_clips"], a["n_ignored"], a["n_new"], a["n_missing"], a["n_blocking"], a["job_id"], a["stale"]) == ("A", 4, 1, 1, 2, 1, 2, True)
    assert got["b"]["n_clips"] is None and got["b"]["stale"] is None and got["b"]["detail"] == "EACCES" and got["e"]["n_clips"] == 0
