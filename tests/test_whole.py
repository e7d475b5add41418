"""Queries over whole tables against plain definitions."""

import os

import pytest
from pyspark.sql import DataFrameWriter

from grainmill.operators import graph
from grainmill.plans import case_queries, queries  # noqa: F401  the first registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Order lines of every quantity and discount: two components, one of them joined by lines that a filter would leave out."""
    folder = tmp_path_factory.mktemp("lines")
    lines = [(1, 1, 10, 1, 50.0, 0.1), (1, 2, 10, 2, 7.0, 0.0), (2, 1, 11, 2, 50.0, 0.1), (3, 1, 12, 3, 1.0, 0.05), (3, 2, 12, 4, 50.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return sorted((min(g), "{" + ", ".join(sorted(g)) + "}") for g in groups.values())


def test_alias_groups_takes_every_line(spark, tables):
    for folder in [tables, *([SF] if os.path.isdir(SF) else [])]:
        lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
        want = brute_groups([(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in lines])
        assert sorted(map(tuple, queries.QUERIES["alias_groups"](spark, folder).collect())) == want
    assert brute_groups([("p10", "s1"), ("p10", "s2"), ("p11", "s2")]) == [("p10", "{p10, p11, s1, s2}")]


def test_callsite_clone_takes_every_line(spark, tables):
    spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 0), (5, 4)], "n_nationkey long, n_regionkey long").write.parquet(f"{tables}/nation.parquet")
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").collect()
    want = sorted(tuple(f"llvm::f{r.l_suppkey}::node{x}::rust::{r.l_orderkey}::bb{r.l_linenumber}" for x in edge) for r in lines for edge in ((1, 2), (2, 1), (5, 4)))
    assert sorted(map(tuple, queries.QUERIES["callsite_clone"](spark, tables).collect())) == want


def test_taint_markers_takes_even_days(spark, tables):
    events = [(1, "2024-01-01 05:00:00", "purchase"), (2, "2024-01-02 05:00:00", "purchase"), (3, "2024-01-04 05:00:00", "error"), (4, "2024-01-02 05:00:00", "view")]
    spark.createDataFrame(events, "user_id long, ts string, event_type string").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type").write.parquet(f"{tables}/events.parquet")
    made = queries.QUERIES["taint_markers"](spark, tables).select("user_id", "var", "marker")
    assert sorted(map(tuple, made.collect())) == [(1, "purchase", "assign"), (2, "purchase", "assign"), (3, "error", "free")]


def test_callsite_clone_deals_sites_and_no_copies(spark, tables):
    """What is shuffled is sites and functions; their copies, ten times as many, are made after the last exchange."""
    spark.createDataFrame([(1, 2), (2, 1), (4, 1)], "n_nationkey long, n_regionkey long").write.mode("overwrite").parquet(f"{tables}/nation.parquet")
    made = queries.QUERIES["callsite_clone"](spark, tables)
    above, copied, _ = made._jdf.queryExecution().executedPlan().toString().partition("Generate explode")
    assert copied and "Exchange" not in above


def test_copies_take_each_function_apart(spark):
    """Node 3 is in the second function only and node 9 in none, so their edges are copied there or nowhere."""
    bodies = spark.createDataFrame([("p", "f", 1), ("p", "f", 2), ("p", "g", 2), ("p", "g", 3), ("q", "f", 1)], "program_id string, called string, number long")
    c_edges = spark.createDataFrame([("p", 1, 2), ("p", 1, 2), ("p", 2, 3), ("p", 1, 3), ("p", 2, 9), ("q", 1, 2)], "program_id string, source long, destination long")
    sites = spark.createDataFrame([("p", "f", "s1"), ("p", "g", "s1"), ("p", "f", "s2"), ("q", "f", "s1"), ("p", "h", "s3")], "program_id string, called string, site string")
    made = graph.c_edges_of_sites(c_edges, bodies, sites).select("program_id", "source", "destination", "label").collect()
    want = [("p", f"llvm::{f}::node{a}::{s}", f"llvm::{f}::node{b}::{s}", "LLVM") for f, a, b, s in (("f", 1, 2, "s1"), ("f", 1, 2, "s2"), ("g", 2, 3, "s1"))]
    assert sorted(map(tuple, made)) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_detect_exact_broadcasts_nothing_by_an_estimate(spark, monkeypatch):
    """The estimate for nine million nodes was 1.76 MB, so what a join left of them went through the driver; the session's limits are as before afterwards."""
    seen, put = [], DataFrameWriter.parquet
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    limits = lambda: [spark.conf.get(f"spark.sql.{c}autoBroadcastJoinThreshold", None) for c in ("", "adaptive.")]
    before = limits()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(planned(self._df)), put(self, *a, **b))[1])
    assert queries.QUERIES["detect_exact"](spark, SF).count() > 0
    assert len(seen) > 5 and not any(seen)
    assert limits() == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["case_findings", "case_report"])
def test_no_plan_repeats_the_analysis(spark, monkeypatch, name):
    """The driver holds a plan with all its stages, so each part is planned once: with repeats the largest plan had 168 exchanges, and 492 with the report."""
    seen, put = [], DataFrameWriter.parquet
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(exchanges(self._df)), put(self, *a, **b))[1])
    seen.append(exchanges(queries.QUERIES[name](spark, SF)))
    assert len(seen) > 5 and max(seen) <= 40
