"""Dataflow fixpoint: programs are compiled to instructions by DataFrame expressions and run by a small fold.

What a statement or call does to memory is decided by native expressions; a
grouped fold then runs the instructions of each program in the order
that the semantics depends on.  Programs are independent and run in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import classify, names
from grainmill.functions.lattice import MASKS, join_masks
from grainmill.operators.folds import fold_groups
from grainmill.operators.memory import Memory

ENTRY = "rust::main::bb0"
TAPE = "program_id string, kind string, node string, n long, op string, a string, b string, c string"
RESULT = "program_id string, kind string, node_id string, n long, alloc array<string>, mask int, var string, marker string"


def _row(kind: str, node: Column, n: Column, op: Column, a: Column, b: Column, c: Column) -> list[Column]:
    null = F.lit(None).cast("string")
    cast = lambda x: null if x is None else x.cast("string")
    return [F.col("program_id"), F.lit(kind).alias("kind"), node.alias("node"), n.cast("long").alias("n"), cast(op).alias("op"), cast(a).alias("a"), cast(b).alias("b"), cast(c).alias("c")]


def statements(nodes: DataFrame) -> DataFrame:
    """(program_id, node_id, seq, i, s): the statements of the Mir nodes."""
    return nodes.where("node_type = 'Mir'").select("program_id", "node_id", "seq", F.posexplode("mir.statements").alias("i", "s"))


def instructions(nodes: DataFrame, match_scope: str = "details") -> DataFrame:
    """The memory instructions of all nodes, in the columns of TAPE."""
    place = names.full_local(F.col("s.place"))
    rvalue = F.col("s.rvalue")
    source = (
        F.when(F.col("op") == "link", names.full_local(F.trim(F.regexp_replace(rvalue, "^&+", ""))))
        .when(F.col("op") == "move", names.full_local(names.moved(rvalue)))
        .when(F.col("op") == "alias", names.full_local(names.copied(rvalue)))
        .otherwise(F.col("s.details"))
    )
    of_statements = statements(nodes).withColumn("op", classify.statement_class(F.col("s.kind"), rvalue, F.col("s.place"))).where("op IS NOT NULL")
    of_statements = of_statements.where((F.col("op") != "move") | (names.moved(rvalue) != "")).select(*_row("op", F.col("node_id"), F.col("i"), F.col("op"), source, place, None))
    t = F.col("mir.terminator")
    last = F.lit(1 << 30)
    calls = nodes.where("node_type = 'Mir' AND mir.terminator.kind = 'Call'").withColumn("class", classify.call_class(t["details"], t["function_called"], match_scope))
    operand = F.when(F.col("class") == "rename", names.full_local(names.argument_name(F.get(t["arguments"], 0)["arg"]))).otherwise(names.full_local(names.moved(t["details"])))
    mark = classify.call_mark(t["function_called"])
    of_calls = calls.where("class <> 'rename' OR size(mir.terminator.arguments) > 0").select(
        *_row("op", F.col("node_id"), last, F.col("class"), operand, names.full_local(t["return_place"]), F.when((mark == "take") & (names.moved(t["details"]) == ""), "assign").otherwise(mark))
    )
    drops = nodes.where("node_type = 'Mir' AND mir.terminator.kind = 'Drop'").select(*_row("op", F.col("node_id"), last, F.lit("free"), names.full_local(t["dropped_value"]), None, None))
    both = nodes.where("dummy.mir_var IS NOT NULL AND dummy.llvm_var IS NOT NULL")
    enters = both.where("node_type = 'DummyCall'").select(*_row("op", F.col("node_id"), last, F.lit("link"), names.full_local(F.col("dummy.mir_var")), F.col("dummy.llvm_var"), None))
    leaves = both.where("node_type = 'DummyRet' AND dummy.is_internal").select(*_row("op", F.col("node_id"), last, F.lit("merge"), names.return_local(F.col("dummy.mir_var")), names.return_local(F.col("dummy.llvm_var")), None))
    return of_statements.union(of_calls).union(drops).union(enters).union(leaves)


def tape(nodes: DataFrame, edges: DataFrame, match_scope: str = "details") -> DataFrame:
    """Everything that the fold over a program reads, in one table."""
    t = F.col("mir.terminator")
    control = nodes.select(
        *_row("node", F.col("node_id"), F.col("seq"), F.coalesce(F.when(F.col("node_type") == "Mir", t["kind"]), F.when(F.coalesce("dummy.is_internal", F.lit(False)), "internal"), F.lit("")),
              t["function_called"], F.col("dummy.outgoing_edge"), None)
    )
    links = edges.select(*_row("edge", F.col("source"), F.col("pos"), None, F.col("destination"), None, None))
    return instructions(nodes, match_scope).union(control).union(links)


class _Step:
    """Applies the instructions of a node to a memory and, where asked, to the marker sets."""

    def __init__(self, program: list[tuple]):
        # A repeated node id has the same instructions each time: they count once.
        self.ops: dict[str, list[tuple]] = defaultdict(list)
        for _, _, node, _, *instruction in dict.fromkeys(r for r in program if r[1] == "op"):
            self.ops[node].append(tuple(instruction))

    def __call__(self, node: str, memory: Memory, marks: dict[str, set[str]] | None = None) -> Memory:
        memory = memory.copy()
        for op, a, b, c in self.ops.get(node, ()):
            getattr(self, op)(memory, a, b)
            if marks is not None:
                self.mark(marks, op, a, b, c)
        return memory

    @staticmethod
    def link(m: Memory, a: str, b: str) -> None:
        m.propagate(a, b)
        m.propagate(b, a)

    @staticmethod
    def alias(m: Memory, a: str, b: str) -> None:
        m.propagate(a, b)

    @staticmethod
    def move(m: Memory, a: str, b: str) -> None:
        m.propagate(a, b)
        value = m.value(b)
        m.assign(a, MASKS["BOTTOM"])
        m.assign(b, value)

    @staticmethod
    def set(m: Memory, text: str, b: str) -> None:
        start = text.strip()
        value = MASKS["IMMB"] if start.startswith("& imm") else MASKS["MB"] if start.startswith("& mut") else m.value(text)
        m.assign(b, value)

    @staticmethod
    def rename(m: Memory, a: str, b: str) -> None:
        value, old = m.value(a), m.holder(a)
        if old is None:
            m.assign(b, value)
        else:
            m.replace(old, {*old} - {a} | {b}, value)
        m.assign(a, MASKS["BOTTOM"])
        m.forget(a)

    @staticmethod
    def _own(m: Memory, place: str, value: int) -> None:
        m.forget(place)
        m.put((place,), value)
        m.assign(place, value)

    def alloc(self, m: Memory, _: str, place: str) -> None:
        self._own(m, place, MASKS["ALLOC"])

    def moved(self, m: Memory, operand: str, place: str) -> None:
        m.forget(operand)
        m.assign(operand, MASKS["BOTTOM"])
        self._own(m, place, MASKS["MV"])

    @staticmethod
    def reowned(m: Memory, operand: str, place: str) -> None:
        old = m.holder(operand)
        if old is None:
            m.put((place,), MASKS["MV"])
        else:
            m.replace(old, {*old, place}, MASKS["MV"])
        m.assign(place, MASKS["MV"])

    @staticmethod
    def drop(m: Memory, _: str, place: str) -> None:
        m.set_all(MASKS["FREED"])
        m.assign(place, MASKS["FREED"])

    @staticmethod
    def other(m: Memory, _: str, place: str) -> None:
        m.assign(place, m.value(place))

    @staticmethod
    def free(m: Memory, a: str, _: str | None) -> None:
        m.assign(a, MASKS["FREED"])

    @staticmethod
    def merge(m: Memory, a: str, b: str) -> None:
        m.assign(a, join_masks(m.value(a), m.value(b)))

    @staticmethod
    def mark(marks: dict[str, set[str]], op: str, a: str, b: str, c: str) -> None:
        if op == "link":
            marks[a], marks[b] = (both := marks.get(a, set()) | marks.get(b, set())), {*both}
        elif op == "alias":
            marks.setdefault(b, set()).update(marks.get(a, ()))
        elif op == "move":
            marks[b] = marks.pop(a, set())
        elif op == "rename":
            marks.setdefault(b, set()).update(marks.pop(a, ()))
        elif op == "merge":
            marks[a] = marks.pop(a, set()) | marks.pop(b, set())
        elif op == "free":
            marks.setdefault(a, set()).add("free")
            marks[a].discard("assign")
        elif c:
            marks.setdefault(b, set()).add(c if c == "NOT_HANDLED" else "assign")
            if c == "take":
                marks.pop(a, None)


def derived_marks(memory: Memory) -> dict[str, set[str]]:
    """MV reads as assign and FREED as free."""
    tags = {MASKS["MV"]: "assign", MASKS["FREED"]: "free"}
    out: dict[str, set[str]] = {}
    for alloc, mask in memory.cells.items():
        if mask in tags:
            for var in alloc:
                out.setdefault(var, set()).add(tags[mask])
    return out


def run_program(program: list[tuple], entry: str, most_visits: int | None = None) -> list[tuple]:
    """The worklist over one program, rows of TAPE in order of (kind, node, n): the smallest node id in text order is next.

    A successor's state is its old one joined with the transfer of the current
    state; it is visited again if its memory or markers change.  An internal call
    remembers the caller and goes on in the callee; a return block takes the last
    caller up again.  Without ``most_visits`` the bound grows with the program,
    far beyond what one that settles needs: only endless recursion meets it.
    """
    step, control, following = _Step(program), {}, defaultdict(set)
    for _, kind, node, _, op, a, b, _ in program:
        if kind == "node":
            control.setdefault(node, (op, a, b))
        elif kind == "edge":
            following[node].add(a)
    following = {k: sorted(v) for k, v in following.items()}
    most_visits = most_visits or 100_000 + 100 * len(control)
    marks: dict[str, dict[str, set[str]]] = {entry: {}}
    memories = {entry: step(entry, Memory(), marks[entry])}
    queue, waiting, visits, callers = [entry], {entry}, [], []

    def visit_later(node: str) -> None:
        if node not in waiting:
            waiting.add(node)
            heapq.heappush(queue, node)

    while queue:
        node = heapq.heappop(queue)
        waiting.discard(node)
        visits.append(node)
        if len(visits) > most_visits:
            raise RuntimeError(f"{program[0][0]}: no fixpoint within {most_visits} visits")
        memory = memories.get(node, Memory())
        for after in following.get(node, ()):
            old = memories.get(after, Memory())
            joined = old.union(step(after, memory))
            tags = derived_marks(joined)
            if after not in memories or joined.cells != old.cells or tags != marks.get(after, {}):
                memories[after], marks[after] = joined, tags
                visit_later(after)
        kind, called, _ = control.get(node, ("", None, None))
        if kind == "Call" and "closure#" not in (called or ""):
            dummy = next((d for d in following.get(node, ()) if d.startswith("dummyCall")), None)
            if dummy and control.get(dummy, ("",))[0] == "internal":
                callers.append((control[dummy][2], memory, marks.get(node, {})))
                visit_later(dummy)
                visit_later(f"rust::{called}::bb0")
        elif kind == "Return" and callers:
            back, before, tags = callers.pop()
            memories[back] = before.union(memories.get(node, Memory()))
            marks[back] = {v: {*tags.get(v, ()), *marks.get(node, {}).get(v, ())} for v in {*tags, *marks.get(node, {})}}
            visit_later(back)

    rows = [("state", n, None, list(a), m, None, None) for n, memory in memories.items() for a, m in memory.cells.items()]
    rows += [("visit", n, i, None, None, None, None) for i, n in enumerate(visits)]
    rows += [("marked", n, None, None, None, None, None) for n in marks]
    rows += [("taint", n, None, None, None, v, t) for n, tags in marks.items() for v, ts in tags.items() for t in (sorted(ts) or [None])]
    return [(program[0][0], *r) for r in rows]


def fixpoint(nodes: DataFrame, edges: DataFrame, entry: str = ENTRY, match_scope: str = "details", most_visits: int | None = None) -> DataFrame:
    """The fixpoint of every program, as rows of RESULT by kind.

    state: (node_id, alloc, mask); visit: (node_id, n); marked: nodes with
    markers, even none; taint: (node_id, var, marker), marker null for a variable
    with an empty set.  A program is one task's work, so its size is bounded by a
    compiler's output for one crate; all programs run in parallel.
    """
    program = tape(nodes, edges, match_scope)
    return fold_groups(program, "program_id", ["kind", "node", "n"], lambda rows: run_program(rows, entry, most_visits), RESULT)


def taint_markers(state: DataFrame) -> DataFrame:
    """Markers that follow from a table of memories: MV is assign, FREED is free."""
    marker = F.when(F.col("mask") == MASKS["MV"], "assign").when(F.col("mask") == MASKS["FREED"], "free")
    return state.select(*[c for c in state.columns if c not in ("alloc", "mask")], F.explode("alloc").alias("var"), marker.alias("marker")).where("marker IS NOT NULL").distinct()


def block_taint(result: DataFrame, block: str, function: str = "main") -> DataFrame:
    """(program_id, var, marker) at one block of a function."""
    return result.where((F.col("kind") == "taint") & (F.col("node_id") == f"rust::{function}::{block}")).select("program_id", "var", "marker")


def last_visited(result: DataFrame) -> DataFrame:
    """(program_id, node_id): the last visited node that is no dummy."""
    visits = result.where("kind = 'visit' AND NOT startswith(node_id, 'dummy')")
    return visits.groupBy("program_id").agg(F.max_by("node_id", "n").alias("node_id"))
