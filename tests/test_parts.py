import random

from pyspark.sql import functions as F

from grainmill.functions import lattice, names
from grainmill.operators.components import connected_components
from grainmill.operators.fixpoint import block_taint
from grainmill.operators.graph import call_registry, call_sites
from grainmill.sources import search, sinks
from tests import programs as P


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(500, 500), (7, 7), (3, 4), (4, 3)]
    table = spark.createDataFrame([*edges, (None, 3), (None, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(table, "a", "b").collect()}
    assert got == plain_components(edges)
    assert connected_components(table.limit(0), "a", "b").count() == 0


def test_lattice_tables(spark):
    masks = lattice.MASKS
    order = {("BOTTOM", x) for x in masks} | {(x, "TOP") for x in masks} | {("ALLOC", x) for x in ("MB", "IMMB", "MV")} | {(x, x) for x in masks}
    pairs = [(a, b) for a in masks for b in masks]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *(lattice.encode(F.col(c)).alias(f"m{c}") for c in "ab"))
    x, y = F.col("ma"), F.col("mb")
    for r in rows.select("a", "b", lattice.leq(x, y).alias("leq"), lattice.decode(lattice.join(x, y)).alias("join"), lattice.compare(x, y).alias("cmp"), lattice.is_default(x).alias("zero")).collect():
        up = [z for z in masks if (r.a, z) in order and (r.b, z) in order]
        least = next(z for z in up if all((z, w) in order for w in up))
        assert r.leq == ((r.a, r.b) in order) and r.join == least and r.zero == (r.a == "BOTTOM")
        assert r.cmp == ("=" if r.a == r.b else "<" if (r.a, r.b) in order else ">" if (r.b, r.a) in order else None)
    grouped = rows.groupBy("a").agg(lattice.lub(F.col("mb")).alias("m")).select(lattice.decode(F.col("m")).alias("v")).distinct().collect()
    assert [r.v for r in grouped] == ["TOP"]


def test_paged_search(spark):
    pages = {1: search.Page(200, tuple(f"r{i}" for i in range(100))), 2: search.Page(403, retry_after=7.0), 3: search.Page(200, ("late",))}
    asked, slept = [], []

    def fetch(query, page, size):
        asked.append(page)
        if page == 2 and asked.count(2) == 2:
            return search.Page(200, tuple(f"r{i}" for i in range(50, 150)))
        return pages[page]

    assert [*search.paged(fetch, "q", sleep=slept.append)] == [*(f"r{i}" for i in range(150)), "late"]
    assert asked == [1, 2, 2, 3] and slept == [2.0, 7.0, 2.0]
    assert [*search.paged(lambda *_: search.Page(500), "q", sleep=slept.append)] == []
    search.register_search(spark, "fake_search", lambda query, page, size: search.Page(200, (query + "1", query + "1", query + "2")), pause=0)
    rows = spark.read.format("fake_search").option("query", "a\nb").load().collect()
    assert sorted((r.query, r.arrival, r.item) for r in rows) == [("a", 0, "a1"), ("a", 1, "a2"), ("b", 0, "b1"), ("b", 1, "b2")]


def test_small_projections(spark):
    row = spark.createDataFrame([("Local(_1) [mutable] -> field",), ("Local(_2)",)], "p string").select(names.place_parts(F.col("p")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in row] == [("Local(_1)", True, "field"), ("Local(_2)", False, None)]
    lines = spark.createDataFrame([("a leak",), ("fine",)], "line string")
    assert sinks.matching_lines(lines, "leak|free").count() == 1
    result = spark.createDataFrame([("p", "taint", "rust::main::bb1", "x", "free"), ("p", "taint", "rust::main::bb2", "y", "free")], "program_id string, kind string, node_id string, var string, marker string")
    assert [tuple(r) for r in block_taint(result, "bb1").collect()] == [("p", "x", "free")]
    blocks = P.blocks_table(spark, {"c": P.c_free_call()})
    calls = call_sites(blocks, spark.createDataFrame([("c", "give")], "program_id string, function string"), None)
    assert [list(r.sites) for r in call_registry(calls).collect()] == [["rust::main::bb2", "rust::main::bb3"]]
    kinds = spark.createDataFrame([("IntraCF",), ("x",)], "k string").select(names.edge_kind(F.col("k")), names.node_kind(F.lit("ValNode")), names.statement_type(F.array(F.lit("AssignStmt"), F.lit("LoadStmt")))).collect()
    assert tuple(kinds[0]) == ("intra", "ValNode", "LoadStmt") and kinds[1][0] == "unknown"


def test_written_tables_and_their_removal(spark):
    from grainmill.plans.lineage import clean, written

    kept = written(spark.range(5), "numbers")
    assert sorted(r.id for r in kept.collect()) == [*range(5)]
    assert clean(spark) >= 1 and clean(spark) == 0


def test_clean_takes_the_own_job_only(spark, monkeypatch):
    from pathlib import Path

    from grainmill.plans import lineage

    own = lineage._job(spark)
    monkeypatch.setattr(lineage, "_job", lambda _: "another_job")
    other = lineage.written(spark.range(3), "numbers")
    lineage.bucketed(spark.range(3), 2, ["id"], "numbers")
    monkeypatch.setattr(lineage, "_job", lambda _: own)
    mine = lineage.bucketed(spark.range(4), 2, ["id"], "numbers")
    assert mine.count() == 4 and lineage.clean(spark) == 1
    left = [t.name for t in spark.catalog.listTables(pattern="grainmill_*")]
    assert len(left) == 1 and "another_job" in left[0] and other.count() == 3
    assert not Path(lineage.job_folder(spark).removeprefix("file://")).exists()
    monkeypatch.setattr(lineage, "_job", lambda _: "another_job")
    assert lineage.clean(spark) == 2 and not spark.catalog.listTables(pattern="grainmill_*")


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from grainmill.plans import lineage

    class Session:
        def __init__(self, master):
            self.master, self.applicationId, self.kept = master, "a-1", {}

        sparkContext = conf = property(lambda self: self)
        getConf = lambda self: self
        get = lambda self, key, default=None: self.kept.get(key, default)
        set = lambda self, key, value: self.kept.update({key: value})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            lineage.shared_folder(Session(master))
    assert lineage.shared_folder(Session("local[4]")).startswith("file://")


def test_without_the_optional_parts(tmp_path):
    """The rest imports and answers when the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'use_after_free' in q and not [k for k in q if k.startswith('op')], q; assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}).returncode == 0
