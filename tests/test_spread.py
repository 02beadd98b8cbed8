"""What is made of a small file's rows does not stay in the one task that reads it."""

import pytest
from pyspark.sql import functions as F

from oracle import SF
from sprocket.operators import joins
from sprocket.plans import documents, library, probing, queries, walks
from sprocket.session import spread, table
from sprocket.sources import folders, probes


def tasks(df):
    return df.rdd.getNumPartitions()


def test_odd_cases_are_dealt_out(spark):
    assert tasks(table(spark, SF, "supplier")) == 1
    assert tasks(documents.DOCUMENTS.df(spark, SF)) == tasks(library.FOLDERS.df(spark, SF)) == 4


def test_rows_are_the_same(spark):
    x = table(spark, SF, "customer")
    assert sorted(spread(x, "c_custkey").collect()) == sorted(x.collect())


@pytest.mark.parametrize("name", ["loaded_documents", "document_references"])
def test_documents_are_read_once(spark, name):
    plan = getattr(documents, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan


@pytest.mark.parametrize("name", ["walked_events", "walked_clips"])
def test_trees_are_written_by_all_tasks(spark, monkeypatch, name):
    seen = []
    write = folders.write_tree
    monkeypatch.setattr(folders, "write_tree", lambda rows, root: seen.append(tasks(rows)) or write(rows, root))
    getattr(walks, name)(spark, SF)
    assert seen == [4]


def test_two_years_are_walked_once_by_more_than_two_tasks(spark, monkeypatch):
    seen = []
    keep = walks.stored
    monkeypatch.setattr(walks, "stored", lambda rows, name: seen.append(tasks(rows)) or keep(rows, name))
    clips = walks.walked_clips(spark, SF)
    assert seen == [2 * walks.PARTS] and "BatchScan library_folders" not in clips._jdf.queryExecution().executedPlan().toString()


def test_single_paths_are_looked_at_by_all_tasks(spark, monkeypatch):
    seen = []
    look = folders.stats
    monkeypatch.setattr(folders, "stats", lambda df: seen.append(tasks(df)) or look(df))
    walks.strict_stats(spark, SF)
    assert seen == [4]


@pytest.mark.parametrize("name", ["kept_spans", "merged_spans", "span_labels", "subtract_spans", "priority_overlap", "suggestion_states"])
def test_spans_are_sorted_by_all_tasks(spark, name):
    # a shuffle of so few rows is merged to one task, unless they are dealt out; strong spans are no part of the sorts
    assert tasks(queries.QUERIES[name](spark, SF)) >= 4


@pytest.mark.parametrize("name", ["probed_clips", "probe_faults"])
def test_probes_are_read_by_all_tasks(spark, monkeypatch, name):
    seen = []
    probed = probes.probed
    monkeypatch.setattr(probes, "probed", lambda df, *more: seen.append(tasks(df)) or probed(df, *more))
    getattr(probing, name)(spark, SF)
    assert seen == [4]


def test_groups_of_claims_are_dealt_out(spark):
    assert tasks(queries.output_collisions(spark, SF)) == 4


def test_a_large_group_of_claims_is_dealt_out(spark):
    n = 2 * joins.PIECE + 1
    rows = [(k, "one") for k in range(n)] + [(n + k, "two") for k in range(joins.PIECE)] + [(3 * n, "alone")]
    got = joins.collisions(spark.createDataFrame(rows, "claim long, path string"), "claim", F.col("path"))
    assert {r["claim"]: r["others"] for r in got.collect()} == {k: ",".join(str(o) for o, f in rows if f == path and o != k) for k, path in rows[:-1]}
    assert len([p for p in got.filter("folded = 'one'").rdd.glom().map(len).collect() if p]) > 1
