"""Hand-written programs.  The derivation of each is in its docstring; block numbers are assumed."""

from __future__ import annotations

import json


def statement(place, rvalue, line=1, details=None):
    return {"source_info": {"span": f"src/main.rs:{line}:5: {line}:9 (#0)", "scope": "scope[0]"}, "kind": "Assign",
            "details": details or f"Assign(({place}, {rvalue}))", "place": f"Local({place})", "is_mutable": False, "rvalue": rvalue}


def call(called, ret, target, args=(), unwind="continue", line=1):
    operands = ", ".join(f"move {a}" for a in args)
    text = f"Terminator {{ kind: {ret} = {called}({operands}) -> [return: {target}, unwind {unwind}] }}"
    return {"kind": "Call", "details": text, "source_info": f"src/main.rs:{line}:5: {line}:9 (#0)", "function_called": called,
            "arguments": [{"arg": f"Local({a})", "is_mutable": False} for a in args], "return_place": ret, "return_target": target, "unwind_target": unwind}


def drop(var, target, unwind="continue", line=1):
    return {"kind": "Drop", "details": f"drop({var}) -> [return: {target}, unwind {unwind}]", "source_info": f"src/main.rs:{line}:1: {line}:2 (#0)",
            "dropped_value": var, "is_mutable": False, "return_target": target, "unwind_target": unwind}


def goto(target):
    return {"kind": "Goto", "details": f"goto -> {target}", "source_info": "src/main.rs:1:1: 1:1 (#0)", "target": target}


RETURN = {"kind": "Return", "details": "return"}
RESUME = {"kind": "UnwindResume", "details": "resume"}


def block(number, terminator, *statements):
    return {"block_id": number, "statements": list(statements), "terminator": terminator}


def leak(unwind="terminate"):
    """A box turned into a raw pointer that nothing takes back; the cleanup block drops the box."""
    return {"main": [
        block(0, call("std::boxed::Box::<i32>::new", "_1", "bb1")),
        block(1, call("std::io::_print", "_2", "bb2", unwind="cleanup(bb4)")),
        block(2, call("std::boxed::Box::<i32>::into_raw", "_9", "bb3", ["_10"]), statement("_10", "move _1")),
        block(3, RETURN),
        block(4, drop("_1", "bb5", unwind)),
        block(5, RESUME),
    ]}


def double_free():
    """One raw pointer taken back twice, each owner dropped."""
    return {"main": [
        block(0, call("std::boxed::Box::<i32>::new", "_1", "bb1")),
        block(1, call("std::boxed::Box::<i32>::into_raw", "_2", "bb2", ["_1"])),
        block(2, call("std::boxed::Box::<i32>::from_raw", "_3", "bb3", ["_2"])),
        block(3, call("std::boxed::Box::<i32>::from_raw", "_4", "bb4", ["_2"])),
        block(4, drop("_4", "bb5", line=11)),
        block(5, drop("_3", "bb6", "terminate", line=12)),
        block(6, RETURN),
    ]}


def use_after_free():
    """A raw pointer read on line 12 after its owner was dropped on line 10."""
    return {"main": [
        block(0, call("std::boxed::Box::<i32>::new", "_1", "bb1")),
        block(1, call("std::boxed::Box::<i32>::into_raw", "_2", "bb2", ["_1"])),
        block(2, call("std::boxed::Box::<i32>::from_raw", "_3", "bb3", ["_2"])),
        block(3, drop("_3", "bb4", "terminate", line=10)),
        block(4, RETURN, statement("_5", "copy (*_2)", line=12)),
    ]}


def clean():
    """A raw pointer taken back once and dropped once."""
    return {"main": [
        block(0, call("std::boxed::Box::<i32>::new", "_1", "bb1")),
        block(1, call("std::boxed::Box::<i32>::into_raw", "_2", "bb2", ["_1"])),
        block(2, call("std::boxed::Box::<i32>::from_raw", "_3", "bb3", ["_2"])),
        block(3, drop("_3", "bb4", "terminate", line=10)),
        block(4, RETURN),
    ]}


def internal_call():
    """main calls a function of its own, which returns."""
    return {
        "main": [block(0, call("helper", "_1", "bb1")), block(1, RETURN)],
        "helper": [block(0, goto("bb1")), block(1, RETURN)],
    }


def recursion():
    """A function that calls itself from its first block never settles."""
    return {"main": [block(0, call("main", "_1", "bb1")), block(1, RETURN)]}


def closure_call():
    """main calls its closure, whose return is in block 2."""
    return {
        "main": [block(0, call("main::{closure#0} as FnOnce", "_2", "bb1", ["_1"])), block(1, RETURN)],
        "main::{closure#0}": [block(0, goto("bb1")), block(1, goto("bb2")), block(2, RETURN)],
    }


def c_free_call():
    """Memory given up to a C function that frees it; called at two sites."""
    return {"main": [
        block(0, call("std::boxed::Box::<i32>::new", "_1", "bb1")),
        block(1, call("std::boxed::Box::<i32>::into_raw", "_2", "bb2", ["_1"])),
        block(2, call("give", "_3", "bb3", ["_2"])),
        block(3, call("give", "_4", "bb4", ["_2"])),
        block(4, RETURN),
    ]}


def c_node(number, kind, info, statements=(), outgoing=(), function="give"):
    return {"node_id": number, "node_type": True, "info": info, "node_kind_string": kind, "node_kind": 1, "node_source_loc": "", "function_name": function,
            "basic_block": 1, "basicBlockName": "entry", "basic_block_info": "entry", "svf_statements": list(statements),
            "incoming_edges": [], "outgoing_edges": [{"source": number, "destination": d, "edge_type": "intra"} for d in outgoing]}


def c_graph():
    """Entry, a store of the argument (10) to temporary %2, the free of %2, exit."""
    nodes = [
        c_node(1, "FunEntryBlock", "entry", [{"stmt_id": 1, "stmt_type": "AddrStmt", "stmt_info": "%2 = arg", "lhs_var_id": 12, "rhs_var_id": 10}], [2]),
        c_node(2, "IntraBlock", "load", [{"stmt_id": 2, "stmt_type": "LoadStmt", "stmt_info": "LoadStmt %2 = load ptr", "lhs_var_id": 12, "rhs_var_id": 10}], [3]),
        c_node(3, "FunCallBlock", "CallICFGNode: call void @free(ptr noundef %2) ", [], [4]),
        c_node(4, "FunExitBlock", "exit"),
        c_node(9, "IntraBlock", "nowhere", function=None),
    ]
    edges = [{"source": a, "destination": b, "edge_type": "intra"} for a, b in ((1, 2), (2, 3), (3, 4), (2, 3))]
    return {"nodes": nodes, "edges": edges}


def blocks_json(programs):
    """Rows of the block table as JSON lines."""
    return [json.dumps({"program_id": p, "function": f, **b}) for p, functions in programs.items() for f, blocks in functions.items() for b in blocks]


def blocks_table(spark, programs):
    from grainmill.sources import schemas

    return spark.read.schema(schemas.BLOCKS).json(spark.sparkContext.parallelize(blocks_json(programs), 2))
