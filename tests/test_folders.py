"""The folder source over written trees."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sprocket.operators import library
from sprocket.plans import queries as Q
from sprocket.plans import walks
from sprocket.sources import folders


def put(root, *paths):
    for p in paths:
        full = root / p
        if p.endswith("/"):
            full.mkdir(parents=True, exist_ok=True)
        else:
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_text("abc")


def load(spark, root, **options):
    folders.register(spark)
    return spark.read.format(folders.NAME).options(**options).load(str(root))


def test_years_events_chapters_and_clips(spark, tmp_path):
    put(tmp_path, "2019/2019-05-01 - Lake/b.mp4", "2019/2019-05-01 - Lake/a.MOV", "2019/2019-05-01 - Lake/Dinner/c.mkv", "2019/2019-05-01 - Lake/ORIGINAL/d.mp4", "2019/2019-05-01 - Lake/Dinner/deep/e.mp4", "2019/2019-05-01 - Lake/.mp4", "2019/2019-05-01 - Lake/x.txt", "2019/empty/", "2019/loose.mp4", "2020/Hill/f.webm", "stray.mp4")
    rows = load(spark, tmp_path)
    assert sorted((r["event"], r["chapter"], r["clip"], r["size"]) for r in folders.clips(rows).collect()) == [("2019/2019-05-01 - Lake", "", "a.MOV", 3), ("2019/2019-05-01 - Lake", "", "b.mp4", 3), ("2019/2019-05-01 - Lake", "Dinner", "Dinner/c.mkv", 3), ("2020/Hill", "", "f.webm", 3)]
    assert [r["path"] for r in library.list_events(folders.events(rows)).orderBy("pos").collect()] == ["2019/2019-05-01 - Lake", "2019/empty", "2020/Hill"]


def test_a_filter_on_the_year_leaves_other_years_unread(spark, tmp_path):
    put(tmp_path, "2019/A/a.mp4", "2020/B/b.mp4", "2021/C/c.mp4")
    rows = load(spark, tmp_path)
    assert rows.rdd.getNumPartitions() == 3
    one = rows.filter("year = '2020'")
    assert one.rdd.getNumPartitions() == 1 and {r["event"] for r in one.collect()} == {"2020/B"}
    two = rows.filter(F.col("year").isin("2019", "2021", "1900") & (F.col("kind") == "clip"))
    assert two.rdd.getNumPartitions() == 2 and two.count() == 2


def test_aliases_and_markers(spark, tmp_path):
    put(tmp_path, "2019/Lake/a.mp4", "2019/Off/a.mp4", "2019/Off/.reelignore", "2019/Part/x.mp4", "2019/Part/No/y.mp4", "2019/Part/No/.reelignore", "2019/Part/Yes/z.mp4", "2019/Part/Yes/.reelignore/")
    put(tmp_path / "elsewhere", "Hill/h.mp4")
    (tmp_path / "2018").mkdir()
    (tmp_path / "2018" / "Alias").symlink_to("../2019/Lake")
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020" / "One").symlink_to(tmp_path / "elsewhere" / "Hill")
    (tmp_path / "2020" / "Two").symlink_to(tmp_path / "elsewhere" / "Hill")
    rows = load(spark, tmp_path).filter("year <> 'elsewhere'")
    assert {r["path"] for r in library.list_events(folders.events(rows)).collect()} == {"2019/Lake", "2019/Part", "2020/One"}
    # an alias in a chosen year of an event in another is still seen as one
    assert {r["path"] for r in library.list_events(folders.events(rows), ["2018", "2020"]).collect()} == {"2020/One"}
    assert {r["clip"] for r in folders.clips(rows).filter("event = '2019/Part'").collect()} == {"x.mp4", "Yes/z.mp4"}


def test_absence_is_a_row_and_a_circle_is_absence(spark, tmp_path):
    put(tmp_path, "2019/Lake/a.mp4")
    lake = tmp_path / "2019" / "Lake"
    (lake / "gone.mp4").symlink_to("nowhere")
    (lake / "round.mp4").symlink_to("round.mp4")
    (lake / "folder.mp4").mkdir()
    rows = {r["clip"]: r for r in load(spark, tmp_path).filter("kind = 'clip'").collect()}
    assert {c: r["status"] for c, r in rows.items()} == {"a.mp4": "present", "gone.mp4": "absent", "round.mp4": "absent"}
    assert rows["gone.mp4"]["size"] is None
    seen = folders.stats(spark.createDataFrame([(str(lake / p),) for p in ("a.mp4", "a.mp4/x", "round.mp4", "no", "x" * 300)] + [(None,)], "path string"))
    assert [(r["status"], r["reason"], r["is_file"]) for r in seen.collect()] == [("present", None, True), ("absent", None, None), ("absent", None, None), ("absent", None, None), ("fault", "ENAMETOOLONG", None), ("absent", None, None)]


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    put(tmp_path, "2019/Lake/a.mp4", "2020/Hill/b.mp4")
    (tmp_path / "2019" / "Lake").chmod(0)
    rows = folders.faults(load(spark, tmp_path)).collect()
    assert [(r["kind"], r["reason"]) for r in rows] == [("event", "EACCES")]


def test_faults_keep_the_walk_going(spark, tmp_path, monkeypatch):
    put(tmp_path, "2019/Lake/a.mp4", "2019/Lake/Bad/b.mp4", "2020/Hill/c.mp4")
    real = os.listdir

    def listdir(path):
        if str(path).endswith(("Bad", "2020")):
            raise PermissionError(13, "no")
        return real(path)

    monkeypatch.setattr(os, "listdir", listdir)
    reader = folders.Reader(str(tmp_path), "year", [".mp4"])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    names = [c.split()[0] for c in folders.SCHEMA.split(", ")]
    faults = [dict(zip(names, r, strict=True)) for r in rows if r[-2] == "fault"]
    assert [(f["kind"], f["year"], f["chapter"], f["reason"]) for f in faults] == [("chapter", "2019", "Bad", "EACCES"), ("year", "2020", None, "EACCES")]


def test_a_flat_library_of_ten_thousand_folders(spark, tmp_path):
    files = spark.range(10_000).select(F.concat(F.lit("event "), F.format_string("%05d", "id"), F.lit("/c.mp4")).alias("path"), F.lit("x").alias("content"))
    assert folders.write_tree(files, str(tmp_path)).agg(F.sum("n")).first()[0] == 10_000
    rows = load(spark, tmp_path, layout="flat")
    assert rows.rdd.getNumPartitions() == 20
    assert folders.clips(rows).count() == 10_000 and rows.filter("kind = 'event'").select("pos").distinct().count() == 10_000
    assert rows.filter("year = '2020'").count() == 0


def test_equal_files_of_a_tree_are_one(spark, tmp_path):
    kind = "path string, content string, shared boolean"
    rows = [(f"{y}/e{k}/{n}", c, s) for y in (2019, 2020) for k in range(20) for n, c, s in (("a.mp4", "x", True), ("b.mp4", "", True), ("c.mp4", "yy", True), ("own.mp4", "x", False))]
    files = spark.createDataFrame(rows, kind).coalesce(1)
    for _ in range(2):  # a task may run again
        assert folders.write_tree(files, str(tmp_path)).agg(F.sum("n")).first()[0] == 160
        assert all((tmp_path / path).read_text() == content for path, content, _ in rows)
        assert [len({(tmp_path / p).stat().st_ino for p, *_ in rows if p.endswith(n)}) for n in ("/a.mp4", "/b.mp4", "/c.mp4", "own.mp4")] == [1, 1, 1, 40]
    (tmp_path / "more").write_text("z")
    assert not folders._named(str(tmp_path / "more"), str(tmp_path / "2019/e0/a.mp4")) and not folders._named(str(tmp_path / "none"), str(tmp_path / "other"))


def test_a_library_takes_few_inodes(spark):
    root = walks._tree(spark, SF).removeprefix("file://")
    seen = [os.lstat(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names]
    plain = [s for s in seen if stat.S_ISREG(s.st_mode)]
    # 12 contents at most in each of 4 tasks
    assert len({s.st_ino for s in plain}) <= 48 < len(plain)


def test_a_year_is_walked_in_parts(spark, tmp_path, monkeypatch):
    put(tmp_path, *(f"{y}/event {k}/a.mp4" for y in (2019, 2020) for k in range(20)), "2020/event 3/Part/b.mp4", "2020/loose.mp4", "2021/")
    one, four = load(spark, tmp_path), load(spark, tmp_path, parts=4)
    assert (one.rdd.getNumPartitions(), four.rdd.getNumPartitions()) == (3, 12)
    assert sorted(four.collect(), key=repr) == sorted(one.collect(), key=repr)
    last = four.filter("year = '2020'")
    assert last.rdd.getNumPartitions() == 4 and all(n > 0 for n in last.rdd.glom().map(len).collect())
    # a year that cannot be listed is one row, however many parts it has
    real = os.listdir

    def listdir(path):
        if str(path).endswith("2020"):
            raise PermissionError(13, "no")
        return real(path)

    monkeypatch.setattr(os, "listdir", listdir)
    reader = folders.Reader(str(tmp_path), "year", [".mp4"], 4)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:2] for r in rows if r[-2] == "fault"] == [("year", "2020")]


def test_bad_options(spark, tmp_path):
    with pytest.raises(Exception, match="0 parts are too few"):
        load(spark, tmp_path, parts=0).collect()
    with pytest.raises(Exception, match="neither year nor flat"):
        load(spark, tmp_path, layout="round").collect()


@pytest.mark.parametrize("name", ["walked_clips", "walked_events", "strict_stats"])
def test_against_sql(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name])
