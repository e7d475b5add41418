import json
import random
import time

import pytest
from pyspark.sql import functions as F

from grainmill.functions import lattice
from grainmill.operators.detect import fold_events
from grainmill.operators.fixpoint import fixpoint, taint_markers
from grainmill.operators.graph import build_graph, reachable
from grainmill.operators.memory import Memory
from grainmill.plans.analysis import analyze, analyze_program_tables
from grainmill.sources import readers, sinks
from tests import programs as P

FFI = "program_id string, function string"


@pytest.fixture(scope="module")
def analysed(spark):
    made = {"leak": P.leak(), "no_ghost": P.leak("continue"), "double": P.double_free(), "uaf": P.use_after_free(), "clean": P.clean(), "internal": P.internal_call(), "closure": P.closure_call()}
    return analyze_program_tables(P.blocks_table(spark, made), spark.createDataFrame([], FFI))


def findings(analysis, kind):
    return {(r.program_id, r.alloc_key) for r in analysis.findings.where(kind).collect()}


def test_leak_is_found_and_its_control_is_not(analysed):
    assert ("leak", "{Local(_9)}") in findings(analysed, "never_free") or ("leak", '{"Local(_9)"}') in findings(analysed, "never_free")
    assert not [k for p, k in findings(analysed, "never_free") if p == "no_ghost"]


def test_double_free_and_use_after_free(analysed):
    assert {p for p, _ in findings(analysed, "double_free")} == {"double"}
    assert {p for p, _ in findings(analysed, "use_after_free")} == {"uaf"}
    assert not [r for kind in ("never_free", "double_free", "use_after_free") for r in findings(analysed, kind) if r[0] == "clean"]


def test_visits_and_states_of_the_leak(analysed):
    rows = analysed.state.where("program_id = 'leak'").collect()
    assert [r.node_id.rpartition("::")[2] for r in sorted((r for r in rows if r.kind == "visit"), key=lambda r: r.n)] == ["bb0", "bb1", "bb2", "bb3", "bb4", "bb5", "terminate"]
    cells = {(r.node_id.rpartition("::")[2], tuple(r.alloc)): r["mask"] for r in rows if r.kind == "state"}
    masks = lattice.MASKS
    assert cells["bb0", ("Local(_1)",)] == masks["ALLOC"] and cells["bb2", ("Local(_9)",)] == masks["MV"] and cells["bb4", ("Local(_1)",)] == masks["FREED"]


def test_markers_follow_from_the_state(analysed):
    given = analysed.state.where("kind = 'taint' AND program_id = 'leak' AND node_id <> 'rust::main::bb0'").select("node_id", "var", "marker")
    state = analysed.state.where("kind = 'state' AND program_id = 'leak' AND node_id <> 'rust::main::bb0'").select("node_id", "alloc", "mask")
    assert {tuple(r) for r in given.collect()} == {tuple(r) for r in taint_markers(state).collect()}


def test_internal_call_returns(analysed):
    visits = [r.node_id for r in analysed.state.where("kind = 'visit' AND program_id = 'internal'").orderBy("n").collect()]
    assert "rust::helper::bb1" in visits and visits[-1] != "rust::main::bb0" and "rust::main::bb1" in visits


def test_recursion_hits_the_bound(spark):
    nodes, edges = build_graph(P.blocks_table(spark, {"r": P.recursion()}), spark.createDataFrame([], FFI))
    with pytest.raises(Exception, match="no fixpoint within 50 visits"):
        fixpoint(nodes, edges, most_visits=50).collect()


def test_closure_edges(analysed):
    labels = [r.label for r in analysed.edges.where("program_id = 'closure'").orderBy("pos").collect()]
    assert labels[:5] == ["Closure Call (dummy inserted)", "dummyCall->ClosureEntry", "Call return (fallback)", "ClosureExit->dummyRet", "dummyRet->Closure Return"]


def test_report_and_drawing(analysed):
    lines = {}
    for r in analysed.report.orderBy("program_id", "line_no").collect():
        lines.setdefault(r.program_id, []).append(r.line)
    assert lines["clean"] == [sinks.RULE, sinks.NOTHING, sinks.RULE]
    assert lines["leak"][2].startswith(sinks.NEVER_HEADING + ' {"{Local(_9)}": 1}')
    assert any("Free detected at source line: src/main.rs:1" in x for x in lines["double"])
    dot = [r.line for r in sinks.dot_lines(analysed.nodes, analysed.edges).where("program_id = 'leak'").orderBy("line_no").collect()]
    assert dot[0] == "digraph GlobalICFGNodesEdges {" and dot[-1] == "}"
    assert sum('fillcolor="yellow"' in x for x in dot) == 1 and sum('fillcolor="green"' in x for x in dot) == 1 and sum('fillcolor="red"' in x for x in dot) == 1


@pytest.fixture(scope="module")
def c_case(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("c") / "c"
    folder.mkdir()
    (folder / "give_A_FINAL_ICFG.json").write_text(json.dumps(P.c_graph(), indent=2))
    (folder / "other.json").write_text("{}")
    (folder / "ffi.json").write_text(json.dumps({"ffi_functions": ["give", "give", "puts"]}))
    nodes, edges = readers.read_c_graphs(spark, str(folder))
    ffi = readers.read_ffi_names(spark, str(folder / "ffi.json"))
    return P.blocks_table(spark, {"c": P.c_free_call()}), ffi, nodes, edges


def test_c_readers(c_case):
    _, ffi, nodes, edges = c_case
    assert sorted(r.function for r in ffi.collect()) == ["give", "puts"]
    assert [int(r.node.node_id) for r in nodes.orderBy("pos").collect()] == [1, 2, 3, 4]
    assert edges.count() == 3


def test_c_free_warns_and_copies_are_per_site(c_case):
    found = analyze_program_tables(*c_case)
    ids = [r.node_id for r in found.nodes.orderBy("seq").collect()]
    assert ids[3:9] == ["dummyCall::rust::main::bb2::rust::main::bb2", *(f"llvm::give::node{i}::rust::main::bb2" for i in (1, 2, 3, 4)), "dummyRet::rust::main::bb3::rust::main::bb2"]
    assert found.edges.where("label = 'LLVM'").count() == 6
    assert [r["var"] for r in found.warnings.collect()][:1] == ["10@rust::main::bb2"]


def test_documents_round_trip(spark, analysed, tmp_path):
    for row in sinks.graph_documents(analysed.nodes, analysed.edges).where("program_id IN ('leak', 'closure')").collect():
        (tmp_path / row.program_id).mkdir()
        (tmp_path / row.program_id / "graph.json").write_text(row.value)
        json.loads(row.value)
    nodes, edges = readers.read_graph(spark, f"{tmp_path}/*/graph.json")
    again = analyze(nodes, edges)
    both = lambda a: {tuple(r) for r in a.findings.where("program_id IN ('leak', 'closure')").collect()}
    assert both(again) == both(analysed)


def test_ffi_document_without_the_field_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="ffi_functions is missing"):
        readers.read_ffi_names(spark, str(tmp_path / "x.json")).collect()


def test_edge_rules_without_c_information(spark):
    blocks = P.blocks_table(spark, {"c": P.c_free_call()})
    ffi = spark.createDataFrame([("c", "give")], FFI)
    _, edges = build_graph(blocks, ffi)
    assert edges.where("label = 'FFI Call (no LLVM info)'").count() == 2


def test_other_terminators(spark):
    made = {"t": {"main": [
        P.block(0, {"kind": "SwitchInt", "details": "switch", "discr": "_1", "targets": ["(0, bb1)", "(1, bb2)"], "otherwise": "bb3"}),
        P.block(1, {"kind": "Assert", "details": "assert", "return_target": "bb2", "unwind_target": "cleanup(bb4)"}),
        P.block(2, P.goto("bb3")), P.block(3, P.drop("_1", "bb4", "cleanup(bb5)")), P.block(4, P.RETURN), P.block(5, P.RESUME),
    ]}}
    _, edges = build_graph(P.blocks_table(spark, made), spark.createDataFrame([], FFI))
    got = [(r.source[-3:], r.destination[-3:], r.label) for r in edges.orderBy("pos").collect()]
    assert got == [("bb0", "bb1", "SwitchInt target"), ("bb0", "bb2", "SwitchInt target"), ("bb0", "bb3", "SwitchInt otherwise"), ("bb1", "bb2", "Assert success"), ("bb1", "bb4", "Assert unwind"),
                   ("bb2", "bb3", "Goto"), ("bb3", "bb4", "Drop return"), ("bb3", "bb5", "Drop unwind")]


def test_memory_moves_and_merges():
    masks = lattice.MASKS
    m = Memory()
    m.assign("a", masks["ALLOC"])
    m.assign("b.f", masks["ALLOC"])  # joins the set of that value, with its prefix
    assert m.cells == {("a", "b", "b.f"): masks["ALLOC"]}
    m.assign("b", masks["BOTTOM"])
    assert m.cells == {("a", "b.f"): masks["BOTTOM"]}
    m.assign("c", masks["MV"])
    m.propagate("c", "a")
    assert m.cells == {("a", "b.f", "c"): masks["MV"]}
    m.propagate("nothing", "a")
    assert m.cells == {("b.f", "c"): masks["MV"]}
    other = Memory({("c",): masks["FREED"]})
    assert m.union(other).cells == {("b.f", "c"): masks["TOP"]}


def test_union_table_matches_the_object(spark):
    import random

    from grainmill.operators.memory import compare_memories, union_memories

    rng = random.Random(5)
    values = [m for n, m in lattice.MASKS.items() if n != "BOTTOM"]

    def memory():
        return Memory({tuple(sorted(rng.sample("abcdef", rng.randint(1, 3)))): rng.choice(values) for _ in range(rng.randint(0, 3))})

    pairs = [(memory(), memory()) for _ in range(40)]
    table = lambda i: spark.createDataFrame([(k, list(a), m) for k, p in enumerate(pairs) for a, m in p[i].cells.items()], "k int, alloc array<string>, mask int")
    got = {}
    for r in union_memories(table(0), table(1), ["k"]).collect():
        got.setdefault(r.k, {})[tuple(r.alloc)] = r["mask"]
    assert all(got.get(k, {}) == a.union(b).cells for k, (a, b) in enumerate(pairs))
    orders = {r.k: r.order for r in compare_memories(table(0), table(1), ["k"]).collect()}
    names = lambda m: {v: m.value(v) for v in "abcdef"}
    for k, (a, b) in enumerate(pairs):
        below = all(x == y or y == 31 or x | y == y for x, y in zip(names(a).values(), names(b).values()))
        assert orders.get(k, "Equal") == ("Equal" if names(a) == names(b) else "Less" if below else None)


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source int, destination int")
    assert sorted(r.node for r in reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_long_chains_and_forks_are_reached(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(5000)] + [(7000 + i, 7000 + (i + 1) % 9) for i in range(9)]
    pairs += [(rng.randint(6000, 6060), rng.randint(6000, 6060)) for _ in range(70)] + [(5000, 6000), (None, 1), (1, None), (3, 3)]
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    seen, front = set(), [0, 7003]
    while front:
        node = front.pop()
        if node is not None and node not in seen:
            seen.add(node)
            front += ways.get(node, ())
    edges = spark.createDataFrame(pairs, "source int, destination int")
    found = reachable(edges, spark.createDataFrame([(0,), (7003,), (None,)], "node int"))
    assert sorted(r.node for r in found.collect()) == sorted(seen)
    assert reachable(edges, spark.createDataFrame([], "node int")).count() == 0


def test_many_c_assignments_fold_in_seconds():
    events = [("p", -1, 0, "seed", f"Local(_{i})", None, None, None) for i in range(2000)]
    events += [("p", i, 0, "enter_c", f"Local(_{i})", f"{i}@s", None, None) for i in range(2000)]
    events += [("p", 2000 + i, 0, "c_assign", str(10_000 + i), str(i % 2000 if i < 2000 else 10_000 + i - 2000), str(i), None) for i in range(20_000)]
    began = time.process_time()
    rows = fold_events(events)
    assert time.process_time() - began < 5 and sum(r[1] == "var" for r in rows) == 2000


def test_an_index_of_alias_sets_follows_them():
    rng = random.Random(9)
    masks = [*lattice.MASKS.values()]
    for _ in range(60):
        memory = Memory()
        for _ in range(40):
            a, b = (f"v{rng.randint(0, 8)}" + rng.choice(["", ".f"]) for _ in range(2))
            step = rng.randint(0, 4)
            if step == 0:
                memory.assign(a, rng.choice(masks))
            elif step == 1:
                memory.propagate(a, b)
            elif step == 2:
                memory.forget(a)
            elif step == 3:
                memory.put((a, b), rng.choice(masks[1:]))
            else:
                memory.set_all(masks[5])
            assert all(memory.holder(v) == min((n for n in memory.cells if v in n), default=None) for v in (a, b, "v0", "v1.f"))


def test_file_listing_and_targets(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.c").write_text("int x;")
    (tmp_path / "y.h").write_text("")
    assert [r.path.rpartition("/")[2] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["x.c"]
    targets = spark.createDataFrame([("a", ["bin"]), ("b", ["cdylib"]), ("c", ["test"])], "name string, kind array<string>")
    assert {r["name"]: r.crate_type for r in readers.classify_targets(targets).collect()} == {"a": "bin", "b": "lib"}
    libraries = spark.createDataFrame([("libserde-1a2b.rlib",), ("x.so",)], "name string")
    assert [r.crate for r in readers.extern_flags(libraries).collect()] == ["serde"]
    hits = spark.createDataFrame([("r1", 3), ("r2", 1), ("r1", 2)], "repo string, at int")
    assert [r.repo for r in readers.first_seen(hits, "repo", "at").collect()] == ["r2", "r1"]


def test_names(spark):
    from grainmill.functions import names

    row = lambda f, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]
    assert row(names.full_local, "Local(_1) [mutable]", "_2", "Local(_3)") == ["Local(_1)", "Local(_2)", "Local(_3)"]
    assert row(names.return_local, "Local _0", "_5") == ["Local(_0)", "Local(5)"]
    assert row(names.trimmed, ' "a [mutable]" ') == ["a [mutable]"]
    assert row(names.moved, "f(move _7)) -> x", "a move _1 move _2", "none", "move  _4") == ["_7", "_1", "", "_4"]
    assert row(names.copied, "copy _4 as *const i8") == ["_4"]
    assert row(names.argument_name, "Local(_2) [mutable]", "_3") == ["_2", "_3"]
    assert row(names.span_line, "/a/b.rs:39:26: 39:45 (#0)", "x:1", None) == [39, None, None]
    assert row(names.clean_target, "cleanup(bb4)", "continue") == ["bb4", "continue"]
    assert row(names.argument_value, '{"arg": "Local(_1)", "x": 1}', "none") == ["Local(_1)", None]


def test_call_classes(spark):
    from grainmill.functions import classify

    cases = {
        "std::boxed::Box::<Point>::new": "alloc", "std::boxed::Box::<std::vec::Vec<char>>::new": "alloc", "std::boxed::Box::<Wrap<T>>::new": "other",
        "Box::<Node<u8>>::into_raw": "moved", "std::mem::forget::<std::ffi::CString>": "moved", "std::ffi::CStr::from_raw": "reowned",
        "std::mem::drop::<T>": "drop", "std::ffi::CStr::from_ptr::<'_>": "rename", "f": "other",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "called string")
    got = {r.called: r.c for r in rows.select("called", classify.call_class(F.col("called"), F.col("called")).alias("c")).collect()}
    assert got == cases
    scoped = rows.where("called = 'f'").select(*(classify.call_class(F.lit("in explicit_drop/main.rs: f()"), F.col("called"), s).alias(s) for s in ("details", "callee"))).first()
    assert tuple(scoped) == ("drop", "other")


def test_writers(spark, analysed, tmp_path):
    chosen = lambda t: t.where("program_id IN ('leak', 'closure')")
    sinks.write_graphs(chosen(analysed.nodes), chosen(analysed.edges), str(tmp_path / "graphs"))
    found = spark.read.option("wholetext", True).text(str(tmp_path / "graphs"))
    assert {r.program_id for r in found.select("program_id").distinct().collect()} == {"leak", "closure"}
    sinks.write_lines(chosen(analysed.report), str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / "program_id=leak")).collect())
    assert text.startswith(sinks.RULE) and sinks.NEVER_HEADING in text
    sinks.write_ffi_names(spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a")], FFI), str(tmp_path / "ffi"))
    assert [r.function for r in readers.read_ffi_names(spark, str(tmp_path / "ffi"), "p").orderBy("function").collect()] == ["a", "b"]
