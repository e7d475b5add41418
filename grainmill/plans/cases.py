"""Small programs whose states and findings are known, one for each customer of the test tables.

A case is a program written out as blocks.  ``T`` in it stands for a boxed type,
so that the same case runs for all literal types.  What comes of each case, worked
out from the semantics, stands in the SQL of ``case_queries``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import graph
from grainmill.plans.lineage import written
from grainmill.sources import schemas

# The boxed types of the literal programs.
TYPES = ("bool", "char", "f32", "f64", "i128", "i16", "i32", "i64", "i8", "isize", "u128", "u16", "u32", "u64", "u8", "usize")


def _assign(place: str, rvalue: str, line: int = 1) -> dict:
    span = f"src/main.rs:{line}:5: {line}:9 (#0)"
    return {"source_info": {"span": span, "scope": "scope[0]"}, "kind": "Assign", "details": f"Assign(({place}, {rvalue}))", "place": f"Local({place})", "is_mutable": False, "rvalue": rvalue}


def _call(called: str, place: str, target: str, *arguments: str, unwind: str = "continue", line: int = 1) -> dict:
    operands = ", ".join(f"move {a}" for a in arguments)
    return {
        "kind": "Call", "details": f"{place} = {called}({operands}) -> [return: {target}, unwind {unwind}]", "source_info": f"src/main.rs:{line}:5: {line}:9 (#0)", "function_called": called,
        "arguments": [{"arg": f"Local({a})", "is_mutable": False} for a in arguments], "return_place": place, "return_target": target, "unwind_target": unwind,
    }


def _drop(variable: str, target: str, unwind: str = "continue", line: int = 1) -> dict:
    return {"kind": "Drop", "details": f"drop({variable}) -> [return: {target}, unwind {unwind}]", "source_info": f"src/main.rs:{line}:1: {line}:2 (#0)", "dropped_value": variable, "return_target": target, "unwind_target": unwind}


def _goto(target: str) -> dict:
    return {"kind": "Goto", "details": f"goto -> {target}", "target": target}


_RETURN = {"kind": "Return", "details": "return"}
_NEW, _INTO, _FROM = "std::boxed::Box::<T>::new", "std::boxed::Box::<T>::into_raw", "std::boxed::Box::<T>::from_raw"


def _main(*blocks: dict | tuple) -> dict[str, list]:
    return {"main": [*blocks]}


#: Blocks of each function: a terminator, or a terminator and the statements before it.
CASES: dict[str, dict[str, list]] = {
    # A box given up for a raw pointer that nothing takes back; the clean-up ends in a node that does not exist.
    "leak": _main(_call(_NEW, "_1", "bb1"), _call("std::io::_print", "_2", "bb2", unwind="cleanup(bb4)"), (_call(_INTO, "_9", "bb3", "_10"), _assign("_10", "move _1")), _RETURN, _drop("_1", "bb5", "terminate"), {"kind": "UnwindResume"}),
    # The same, but the last visited node does not know the pointer.
    "leak_seen": _main(_call(_NEW, "_1", "bb1"), _call("std::io::_print", "_2", "bb2", unwind="cleanup(bb4)"), (_call(_INTO, "_9", "bb3", "_10"), _assign("_10", "move _1")), _RETURN, _drop("_1", "bb5"), {"kind": "UnwindResume"}),
    "double": _main(_call(_NEW, "_1", "bb1"), _call(_INTO, "_2", "bb2", "_1"), _call(_FROM, "_3", "bb3", "_2"), _call(_FROM, "_4", "bb4", "_2"), _drop("_4", "bb5", line=11), _drop("_3", "bb6", "terminate", line=12), _RETURN),
    "used": _main(_call(_NEW, "_1", "bb1"), _call(_INTO, "_2", "bb2", "_1"), _call(_FROM, "_3", "bb3", "_2"), _drop("_3", "bb4", "terminate", line=10), (_RETURN, _assign("_5", "copy (*_2)", 12))),
    "clean": _main(_call(_NEW, "_1", "bb1"), _call(_INTO, "_2", "bb2", "_1"), _call(_FROM, "_3", "bb3", "_2"), _drop("_3", "bb4", "terminate", line=10), _RETURN),
    # A function of the program is called and returns.
    "internal": {"main": [_call(_NEW, "_1", "bb1"), _call("helper", "_2", "bb2", "_1"), _RETURN], "helper": [_goto("bb1"), _RETURN]},
    "closure": {"main": [_call("main::{closure#0} as FnOnce", "_2", "bb1", "_1"), _RETURN], "main::{closure#0}": [_goto("bb1"), _goto("bb2"), _RETURN]},
    # A C function frees what two call sites give it.
    "c_free": _main(_call(_NEW, "_1", "bb1"), _call(_INTO, "_2", "bb2", "_1"), _call("give", "_3", "bb3", "_2"), _call("give", "_4", "bb4", "_2"), _RETURN),
    # Each kind of assignment: link, pointer copy, move, mutable and immutable borrow by text, value, and those without effect.
    "assign": _main(
        _call(_NEW, "_1", "bb1"),
        (_goto("bb2"), _assign("_2", "&_1"), _assign("_3", "copy _2 as *const i8 (PtrToPtr)"), {"kind": "StorageLive", "details": "StorageLive(_9)"}),
        (_goto("bb3"), _assign("_4", "move _3"), _assign("_5", "Box::new(x)"), _assign("_6", "copy (&(*_1))"), _assign("_7", "const 1"), {"kind": "Nop", "details": "& mut"} | {"place": "Local(_8)"}),
        _RETURN,
    ),
    # forget gives up, mem::drop frees all.
    "forget": _main(_call(_NEW, "_1", "bb1"), _call("std::mem::forget::<std::boxed::Box<T>>", "_2", "bb2", "_1"), _call(_NEW, "_3", "bb3"), _call("std::mem::drop::<std::boxed::Box<T>>", "_4", "bb4", "_3", line=9), _RETURN),
    "rename": _main(_call("std::ffi::CString::new::<T>", "_1", "bb1"), _call("std::ffi::CString::into_raw", "_2", "bb2", "_1"), _call("std::ffi::CStr::from_ptr::<'_>", "_3", "bb3", "_2"), _call("std::ffi::CString::from_raw", "_4", "bb4", "_3"), _drop("_4", "bb5", "terminate", line=7), _RETURN),
    # A borrow makes two names one group.
    "borrow": _main(_call(_NEW, "_1", "bb1"), (_call(_INTO, "_3", "bb2", "_1"), _assign("_4", "(&_3)")), (_drop("_4", "bb3", "terminate", line=5), _assign("_6", "copy _3 as usize", 3)), (_RETURN, _assign("_7", "&(*_4)", 8))),
    # Two branches meet: freed in one, kept in the other.
    "branches": _main(_call(_NEW, "_1", "bb1"), {"kind": "SwitchInt", "details": "switch", "targets": ["(0, bb2)"], "otherwise": "bb3"}, _drop("_1", "bb4", line=4), _goto("bb4"), _goto("bb5"), (_call(_INTO, "_3", "bb6", "_1", line=5), _assign("_2", "&_1")), _RETURN),
}


def _c_graph() -> tuple[list[dict], list[dict]]:
    """Entry, a load of the argument (10) into temporary %2, the free of %2, exit."""
    load = {"stmt_id": 2, "stmt_type": "LoadStmt", "stmt_info": "LoadStmt %2 = load ptr", "lhs_var_id": 12, "rhs_var_id": 10}
    kinds = (("FunEntryBlock", "entry", [load | {"stmt_id": 1, "stmt_info": "%2 = arg"}]), ("IntraBlock", "load", [load]), ("FunCallBlock", "CallICFGNode: call void @free(ptr noundef %2) ", []), ("FunExitBlock", "exit", []))
    nodes = [
        {"node_id": i, "node_type": True, "info": info, "node_kind_string": kind, "node_kind": 1, "node_source_loc": "", "function_name": "give", "basic_block": 1, "basic_block_info": "entry", "svf_statements": statements,
         "incoming_edges": [], "outgoing_edges": [{"source": i, "destination": i + 1, "edge_type": "intra"}] if i < 4 else []}
        for i, (kind, info, statements) in enumerate(kinds, 1)
    ]
    return nodes, [{"source": i, "destination": i + 1, "edge_type": "intra"} for i in (1, 2, 3)]


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few constant rows; the text is one literal, so nothing is shipped but the plan."""
    item = F.from_json(F.lit(json.dumps(rows)), f"ARRAY<STRUCT<{schema}>>")
    return spark.range(1).select(F.explode(item).alias("r")).select("r.*")


def case_programs(customers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, declared names, C nodes, C edges): the case of customer k is the k-th, in turn, of type k."""
    spark = customers.sparkSession
    names = [*CASES]
    rows = [
        {"k": names.index(case), "function": function, "block_id": i, "statements": [*statements], "terminator": terminator}
        for case, functions in CASES.items()
        for function, blocks in functions.items()
        for i, (terminator, *statements) in enumerate(b if isinstance(b, tuple) else (b,) for b in blocks)
    ]
    shape = f"k INT, function STRING, block_id INT, statements ARRAY<{schemas.STATEMENT}>, terminator {schemas.TERMINATOR}"
    of_type = F.get(F.array(*map(F.lit, TYPES)), (F.floor(F.col("c_custkey") / len(names)) % len(TYPES)).cast("int"))
    programs = customers.select(F.col("c_custkey").cast("string").alias("program_id"), (F.col("c_custkey") % len(names)).cast("int").alias("k"), of_type.alias("type"))
    blocks = programs.join(F.broadcast(_literal(spark, rows, shape)), "k")
    typed = lambda c: F.replace(F.replace(c, F.lit("<T>"), F.concat(F.lit("<"), F.col("type"), F.lit(">"))), F.lit("Box<T>"), F.concat(F.lit("Box<"), F.col("type"), F.lit(">")))
    terminator = F.col("terminator")
    for field in ("details", "function_called"):
        terminator = terminator.withField(field, typed(F.col(f"terminator.{field}")))
    blocks = written(blocks.withColumn("terminator", terminator).select("program_id", "function", "block_id", "statements", "terminator"), "blocks")
    with_c = programs.where(F.col("k") == names.index("c_free")).select("program_id")
    nodes, edges = _c_graph()
    c_nodes = with_c.crossJoin(F.broadcast(_literal(spark, [{"function": "give", "pos": n["node_id"], "node": n} for n in nodes], f"function STRING, pos BIGINT, node {schemas.C_NODE}")))  # four rows a program
    c_edges = with_c.crossJoin(F.broadcast(_literal(spark, edges, "source DECIMAL(20,0), destination DECIMAL(20,0), edge_type STRING")))
    return blocks, with_c.withColumn("function", F.lit("give")), c_nodes, c_edges


def case_graph(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the programs of ``case_programs``."""
    return graph.build_graph(*case_programs(customers))
