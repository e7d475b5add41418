"""Memory-error detection: events in scan order, a fold over each program, then grouping and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill.functions import classify, names
from grainmill.operators.folds import fold_groups
from grainmill.operators.fixpoint import ENTRY, last_visited, statements
from grainmill.operators.memory import first_allocation
from grainmill.plans.lineage import measured_joins, written

EVENTS = "program_id string, seq long, i long, event string, a string, b string, span string, members array<string>"
FOLDED = "program_id string, kind string, name string, root string, llvm_free long, drop_free long, used boolean, use_span string, free_span string, free_kind string, n long"


def _event(seq: Column | str, i: Column, event: str | Column, a: Column | None = None, b: Column | None = None, span: Column | None = None, members: Column | None = None) -> list[Column]:
    text = lambda x, n: (F.lit(None).cast("string") if x is None else x.cast("string")).alias(n)
    seq = F.col(seq) if isinstance(seq, str) else seq
    return [F.col("program_id"), seq.cast("long").alias("seq"), i.cast("long").alias("i"), (F.lit(event) if isinstance(event, str) else event).alias("event"),
            text(a, "a"), text(b, "b"), text(span, "span"), (F.lit(None).cast("array<string>") if members is None else members).alias("members")]


def scan_order(nodes: DataFrame, first: str = ENTRY) -> DataFrame:
    """Nodes in the order of the scan: list order with the chosen one ahead; of repeated ids the first counts."""
    front = Window.partitionBy("program_id").orderBy(F.col("node_id") != first, "seq")
    each = Window.partitionBy("program_id", "node_id").orderBy("seq")
    kept = nodes.withColumn("__rank", F.row_number().over(each)).where("__rank = 1").drop("__rank")
    return kept.withColumn("scan", F.row_number().over(front).cast("long"))


def events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Uses, drops, ownership changes, calls into and out of C, and frees, in EVENTS order (seq, i)."""
    ordered = written(scan_order(nodes).drop("seq").withColumnRenamed("scan", "seq"), "scanned")  # nine kinds of events read it
    details, place, end = F.col("s.details"), names.trimmed(F.col("s.place")), F.lit(1 << 30)
    each = statements(ordered).withColumn("use", classify.use_pattern(details))
    any_use = details.contains("&(*") | details.contains("copy (*") | (details.contains("copy ") & details.contains(" as"))
    used = each.where("use IS NOT NULL").select(*_event("seq", F.col("i"), F.col("use.pattern"), names.trimmed(F.col("use.variable")), None, F.col("s.source_info.span")))
    referred = F.regexp_extract(details, r"&(_[^)]*)\)", 1)
    borrows = each.where(~any_use & details.startswith("Assign(") & details.contains("(&") & details.rlike(r"&_[^)]*\)") & F.col("s.place").isNotNull())
    borrows = borrows.select(*_event("seq", F.col("i"), "borrow", place, names.trimmed(F.concat(F.lit("Local(_"), referred, F.lit(")")))))
    t = F.col("mir.terminator")
    unwound = edges.where(F.col("label").contains("unwind")).select("program_id", F.col("destination").alias("node_id")).distinct()
    drops = ordered.where("mir.terminator.kind = 'Drop'").withColumn("var", classify.dropped_variable(t["details"])).where("var IS NOT NULL")
    drops = drops.join(unwound, ["program_id", "node_id"], "left_anti").select(*_event("seq", end, "drop", names.trimmed(F.col("var")), None, t["source_info"]))
    calls = ordered.where("mir.terminator.kind = 'Call' AND size(mir.terminator.arguments) > 0")
    argument = F.get(t["arguments"], 0)["arg"]
    owned = calls.where(classify.any_of(t["function_called"], classify.RE_OWNED_EVENT)).select(*_event("seq", end, "reown", names.trimmed(argument), names.trimmed(t["return_place"])))
    given = calls.where(t["function_called"].contains("std::mem::drop::")).select(*_event("seq", end + 1, "drop_call", names.trimmed(F.split_part(F.trim(argument), F.lit(" "), F.lit(1))), None, t["source_info"]))
    both = ordered.where("dummy.mir_var IS NOT NULL AND dummy.llvm_var IS NOT NULL")
    mir_var, c_var = (names.trimmed(F.col(f"dummy.{c}")) for c in ("mir_var", "llvm_var"))
    crossings = both.select(*_event("seq", F.lit(0), F.when(F.col("node_type") == "DummyRet", "leave_c").when(F.coalesce("dummy.is_internal", F.lit(False)), "enter_internal").otherwise("enter_c"), mir_var, c_var))
    c_nodes = ordered.where("node_type = 'Llvm'")
    c_each = c_nodes.select("program_id", "seq", F.posexplode("llvm.svf_statements").alias("i", "s"))
    temp = F.nullif(F.regexp_extract(F.col("s.stmt_info"), r"(?s)^[^=]*%([0-9]+)[^%=]*=", 1), F.lit(""))
    moves = c_each.select(*_event("seq", F.col("i"), "c_assign", F.col("s.lhs_var_id"), F.col("s.rhs_var_id"), temp))
    argument_temp = F.nullif(F.regexp_extract(F.col("llvm.info"), r"(?s)^[^%]*%([0-9]+)[^0-9]", 1), F.lit(""))
    frees = c_nodes.where(classify.is_c_free(F.col("llvm.info"), F.col("llvm.node_kind_string"))).where(argument_temp.isNotNull()).select(*_event("seq", end, "c_free", argument_temp, None, F.col("llvm.info")))
    out = used
    for more in (borrows, drops, owned, given, crossings, moves, frees):
        out = out.union(more)
    return out


class _Info:
    __slots__ = ("llvm_free", "drop_free", "used", "use_span", "free_span", "free_kind")

    def __init__(self):
        self.llvm_free = self.drop_free = 0
        self.used, self.use_span, self.free_span, self.free_kind = False, None, None, None

    def copy(self) -> "_Info":
        out = _Info()
        for k in self.__slots__:
            setattr(out, k, getattr(self, k))
        return out

    def use(self, span: str) -> None:
        self.used, self.use_span = True, self.use_span if self.use_span is not None else span

    def drop(self, span: str) -> None:
        if not self.drop_free:
            self.free_span, self.free_kind = span, "Drop"
        self.drop_free += 1


class _Scan:
    """The state of the fold: tracked variables, a union-find without compression, and the C name maps."""

    def __init__(self):
        self.info: dict[str, _Info] = {}
        self.parent: dict[str, str] = {}
        self.flowing: set[str] = set()
        self.freed: set[str] = set()
        self.c_names: dict[str, str] = {}
        self.temp_names: dict[str, str] = {}
        self.warnings: list[tuple[str, str]] = []

    def find(self, name: str) -> str:
        while (up := self.parent.get(name)) is not None and up != name:
            name = up
        return name

    def unite(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[y] = x

    def track(self, *names_: str) -> None:
        for n in names_:
            self.info.setdefault(n, _Info())
            self.parent.setdefault(n, n)

    def first_known(self, *candidates: str) -> _Info | None:
        return next((self.info[c] for c in candidates if c in self.info), None)

    def rename(self, old: str, new: str) -> bool:
        if old not in self.info:
            return False
        self.info[new] = self.info.pop(old)
        return True

    def on(self, event: str, a: str, b: str, span: str) -> None:
        getattr(self, event)(a, b, span)

    def deref(self, var: str, _: str, span: str) -> None:
        if info := self.first_known(var, f"Local({var})"):
            info.use(span)

    def copy_deref(self, var: str, _: str, span: str) -> None:
        local = f"Local({var})"
        if info := self.first_known(var, local, self.find(local)):
            info.use(span)

    def cast(self, var: str, _: str, span: str) -> None:
        local = f"Local({var})"
        if info := self.first_known(var, local, self.find(var), self.find(local)):
            info.use(span)

    def borrow(self, target: str, source: str, _: str) -> None:
        self.track(target, source)
        self.unite(target, source)

    def drop(self, var: str, _: str, span: str) -> None:
        if info := self.first_known(var, f"Local({var})"):
            info.drop(span)

    def drop_call(self, var: str, _: str, span: str) -> None:
        self.info.setdefault(var, _Info()).drop(span)

    def reown(self, source: str, target: str, _: str) -> None:
        self.track(source)
        self.parent.setdefault(target, target)
        self.info[target] = self.info[source].copy()
        self.unite(source, target)
        local = f"Local({target})"
        self.track(local)
        self.unite(target, local)

    def _enter(self, mir: str, c: str) -> bool:
        number, at, _ = c.partition("@")
        if at and number.isdigit():
            self.c_names[str(int(number))] = c
        return self.rename(mir, c)

    def enter_internal(self, mir: str, c: str, _: str) -> None:
        self._enter(mir, c)

    def enter_c(self, mir: str, c: str, _: str) -> None:
        if self._enter(mir, c):
            self.flowing |= {mir, c}
            self.parent |= {c: c, mir: c}

    def leave_c(self, mir: str, c: str, _: str) -> None:
        if self.rename(c, mir) and c in self.flowing:
            self.flowing.remove(c)
            self.flowing.add(mir)
            self.unite(c, mir)

    def c_assign(self, left: str | None, right: str | None, temp: str | None) -> None:
        if left is not None and right in self.c_names:
            self.c_names[left] = self.c_names[right]
        if temp is not None and left in self.c_names:
            self.temp_names[str(int(temp))] = self.c_names[left]
        if right in self.info and left is not None:
            self.rename(right, left)
            if any(name in names_ for name in (left, right) for names_ in (self.flowing, self.parent)):
                self.flowing.add(left)
                self.unite(right, left)

    def c_free(self, temp: str, _: str, text: str) -> None:
        var = self.temp_names.get(str(int(temp))) or min((v for v in self.flowing if v in self.info), default=None)
        if var is None or (root := self.find(var)) in self.freed:
            return
        self.freed.add(root)
        if info := self.info.get(var):
            info.llvm_free += 1
            info.free_span, info.free_kind = text, "LLVM"
            if not info.drop_free:
                self.warnings.append((var, text))


def fold_events(program: list[tuple]) -> list[tuple]:
    """One program's events, rows of EVENTS in order; rows of tracked variables, union-find members and warnings."""
    scan = _Scan()
    allocs = {}
    for _, _, _, event, a, b, span, members in program:
        if event == "seed":
            scan.info.setdefault(a, _Info())
        elif event == "alloc":
            allocs[a] = members
        else:
            scan.on(event, a, b, span)
    tracked = {*scan.info, *scan.parent}
    clean = lambda s: s.strip('" \t\n\r')
    for var in sorted(tracked):
        for member in sorted(allocs.get(var, ())):
            if clean(member) in tracked:
                scan.parent.setdefault(var, var)
                scan.unite(var, clean(member))
    rows = [("var", n, None, i.llvm_free, i.drop_free, i.used, i.use_span, i.free_span, i.free_kind, None) for n, i in sorted(scan.info.items())]
    rows += [("member", n, scan.find(n), None, None, None, None, None, None, None) for n in sorted(scan.parent)]
    rows += [("warning", v, None, None, None, None, None, text, None, k) for k, (v, text) in enumerate(scan.warnings)]
    return [(program[0][0], *r) for r in rows]


def effective_frees(llvm: Column, drop: Column) -> Column:
    """Both kinds of free together count as the larger number of them."""
    return F.when((llvm > 0) & (drop > 0), F.greatest(llvm, drop)).otherwise(llvm + drop)


def alias_groups(members: DataFrame) -> DataFrame:
    """(program_id, root, group_key): the sorted members of each root in braces."""
    listed = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    return members.groupBy("program_id", "root").agg(F.concat(F.lit("{"), listed, F.lit("}")).alias("group_key"))


def group_members(groups: DataFrame) -> DataFrame:
    """(program_id, member, group_key): names as they come out of the key text, the first group of each."""
    parts = F.split(F.regexp_replace("group_key", r"^[{}]+|[{}]+$", ""), ",")
    each = groups.select("program_id", "root", "group_key", F.explode(parts).alias("member")).withColumn("member", F.trim("member"))
    return each.groupBy("program_id", "member").agg(F.min_by("group_key", "root").alias("group_key"))


def last_node(nodes: DataFrame, edges: DataFrame, result: DataFrame) -> DataFrame:
    """(program_id, node_id): the last node in list order without an outgoing edge whose id begins with the last visited one."""
    last = last_visited(result).withColumnRenamed("node_id", "last")
    sources = edges.select("program_id", F.col("source").alias("node_id")).distinct()
    found = nodes.select("program_id", "seq", "node_id").join(last, "program_id").where(F.col("node_id").startswith(F.col("last")))
    return found.join(sources, ["program_id", "node_id"], "left_anti").groupBy("program_id").agg(F.max_by("node_id", "seq").alias("node_id"))


def live_at_end(variables: DataFrame, groups: DataFrame, nodes: DataFrame, edges: DataFrame, result: DataFrame) -> DataFrame:
    """Variables that the last node still knows, by name or group, or that were freed; all of a program without such a node."""
    end = written(last_node(nodes, edges, result).join(result.where("kind = 'marked'").select("program_id", "node_id"), ["program_id", "node_id"], "left_semi"), "ends")
    known = written(result.where("kind = 'taint'").join(end, ["program_id", "node_id"], "left_semi").select("program_id", F.col("var").alias("name")).distinct(), "known")
    by_group = written(group_members(groups), "members")
    known_groups = by_group.withColumnRenamed("member", "name").join(known, ["program_id", "name"], "left_semi").select("program_id", "group_key").distinct().withColumn("group_known", F.lit(True))
    rows = variables.join(end.select("program_id", F.lit(True).alias("filtered")), "program_id", "left").join(known.withColumn("known", F.lit(True)), ["program_id", "name"], "left")
    rows = rows.join(by_group.withColumnRenamed("member", "name"), ["program_id", "name"], "left").join(known_groups, ["program_id", "group_key"], "left")
    keep = F.col("filtered").isNull() | F.col("known").isNotNull() | F.col("group_known").isNotNull() | (effective_frees(F.col("llvm_free"), F.col("drop_free")) > 0)
    return rows.where(keep).drop("filtered", "known", "group_known")


def group_report(variables: DataFrame, allocations: DataFrame) -> DataFrame:
    """(program_id, alloc_key, frees, used, use_span, free_span, free_kind) per group, else alias set, else name.

    Frees add up; spans are the first that are not null in the order of names.
    """
    sets = allocations.withColumnRenamed("var", "name").withColumn("set_key", F.concat(F.lit('{"'), F.array_join("alloc", '", "'), F.lit('"}'))).select("program_id", "name", "set_key")
    keyed = variables.join(sets, ["program_id", "name"], "left").withColumn("alloc_key", F.coalesce("group_key", "set_key", "name"))
    spans = lambda c: F.expr(f"min_by({c}, name) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    freed = F.expr("min_by(free_kind, name) FILTER (WHERE free_span IS NOT NULL)").alias("free_kind")
    return keyed.groupBy("program_id", "alloc_key").agg(F.sum(effective_frees(F.col("llvm_free"), F.col("drop_free"))).alias("frees"), F.bool_or("used").alias("used"), spans("use_span"), spans("free_span"), freed)


def classify_groups(report: DataFrame) -> DataFrame:
    """The report with double_free, never_free and use_after_free."""
    later = names.span_line(F.col("use_span")) > names.span_line(F.col("free_span"))
    after = F.col("used") & (F.col("frees") > 0) & ((F.col("free_kind") == "LLVM") | ((F.col("free_kind") == "Drop") & later))
    return report.withColumns({"double_free": F.col("frees") >= 2, "never_free": F.col("frees") == 0, "use_after_free": F.coalesce(after, F.lit(False))})


def detect(nodes: DataFrame, edges: DataFrame, result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, warnings) of every program from its graph and fixpoint, both read from written tables.

    ``findings`` is classify_groups; ``warnings`` lists frees on the C side of
    memory that Rust had not dropped, in order of the scan.
    """
    with measured_joins(nodes.sparkSession):
        return _detect(nodes, edges, result)


def _detect(nodes: DataFrame, edges: DataFrame, result: DataFrame) -> tuple[DataFrame, DataFrame]:
    seeds = result.where("kind = 'taint' AND marker = 'assign'").select("program_id", names.trimmed(F.col("var")).alias("var")).distinct()
    state = result.where("kind = 'state'").join(nodes.groupBy("program_id", "node_id").agg(F.min("seq").alias("seq")), ["program_id", "node_id"], "left")
    allocations = written(first_allocation(state.withColumn("seq", F.coalesce("seq", F.lit(2**31 - 1))), "seq"), "allocations")
    before = F.lit(-1)
    tape = events(nodes, edges).union(seeds.select(*_event(before, F.lit(0), "seed", F.col("var")))).union(allocations.select(*_event(before, F.lit(0), "alloc", F.col("var"), members=F.col("alloc"))))
    folded = written(fold_groups(tape, "program_id", ["seq", "i"], fold_events, FOLDED), "folded")
    groups = alias_groups(folded.where("kind = 'member'"))
    live = live_at_end(folded.where("kind = 'var'").drop("kind", "root", "n"), groups, nodes, edges, result)
    warnings = folded.where("kind = 'warning'").select("program_id", "n", F.col("name").alias("var"), F.col("free_span").alias("info"))
    return written(classify_groups(group_report(live, allocations)), "findings"), warnings
