"""Writers: graph documents, name sets, the text report and the drawing of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill.functions import classify
from grainmill.plans.lineage import written

RULE = "⬦" * 38
# The headings of the report.
FOUND = "🤖💬 Potential memory issues detected 🚀:"
NOTHING = "🤖💬 NO Issues detected: ✅"
USE_HEADING = "☢ Use-After-Free Issues / Undefined behaviour ☢:"
DOUBLE_HEADING = "☢ Double Free Issues ☢:"
NEVER_HEADING = "☢ Never Free Issues ☢:"

LEGEND = (("yellow", "MIR allocation"), ("red", "Ownership forgotten"), ("green", "Drop/free"), ("gray89", "MIR node"), ("turquoise", "LLVM node"), ("white", "Dummy node"))


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, value): one global graph document a program, as ``read_graph`` reads it."""
    payload = F.when(F.col("node_type") == "Mir", F.to_json("mir")).when(F.col("node_type") == "Llvm", F.to_json("llvm")).otherwise(F.to_json("dummy"))
    quoted = lambda c: F.to_json(F.array(c))
    entry = F.concat(F.lit("["), F.substring_index(F.substr(quoted(F.col("node_id")), F.lit(2)), "]", 1), F.lit(', {"node_type": "'), F.col("node_type"), F.lit('", "node_data": '), payload, F.lit("}]"))
    listed = lambda rows, order, text, name: rows.groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))).alias(name))
    edge = F.to_json(F.struct("source", "destination", "label", "source_label", "destination_label"))
    both = listed(nodes, "seq", entry, "n").join(listed(edges, "pos", edge, "e"), "program_id", "left")
    lines = lambda c: F.array_join(F.col(f"{c}.t"), ",\n    ")
    text = F.concat(F.lit('{\n  "ordered_nodes": [\n    '), lines("n"), F.lit('\n  ],\n  "icfg_edges": [\n    '), F.coalesce(lines("e"), F.lit("")), F.lit("\n  ]\n}"))
    return both.select("program_id", text.alias("value"))


def write_graphs(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One folder a program with its document as text."""
    graph_documents(nodes, edges).repartition("program_id").write.partitionBy("program_id").mode("overwrite").text(folder)


def write_ffi_names(functions: DataFrame, folder: str) -> None:
    """``{"ffi_functions": [...]}`` for each program."""
    listed = functions.groupBy("program_id").agg(F.sort_array(F.collect_set("function")).alias("ffi_functions"))
    listed.write.partitionBy("program_id").mode("overwrite").json(folder)


def report_case(use: Column, double: Column, never: Column) -> Column:
    """Which of the three kinds of finding a program has: use, double and never joined by +, or clean."""
    kinds = F.concat_ws("+", F.when(use, "use"), F.when(double, "double"), F.when(never, "never"))
    return F.when(kinds == "", "clean").otherwise(kinds)


def report_lines(findings: DataFrame, warnings: DataFrame, programs: DataFrame) -> DataFrame:
    """(program_id, line_no, line): the text report of every program, groups by key.

    Sections follow the case.  The use section prints the use spans of all
    groups, and the groups concerned unless use after free is the only finding.
    """
    flags = {"u": "use_after_free", "d": "double_free", "n": "never_free"}
    counted = findings.groupBy("program_id").agg(*(F.bool_or(c).alias(k) for k, c in flags.items()))
    cases = programs.select("program_id").distinct().join(counted, "program_id", "left").fillna(False, list(flags))
    multiset = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.concat(F.lit('"'), F.col("alloc_key"), F.lit('": 1'))))), ", "), F.lit("}"))
    sets = findings.groupBy("program_id").agg(multiset("use_after_free").alias("uses"), multiset("never_free").alias("nevers"))
    cases = written(cases.join(sets, "program_id", "left"), "cases")  # ten parts of the report read it
    line = lambda rows, part, text, key=F.lit(""): rows.select("program_id", F.lit(part).alias("part"), key.alias("key"), text.alias("line"))
    some, all_three = F.col("u") | F.col("d") | F.col("n"), F.col("u") & F.col("d") & F.col("n")
    grouped = findings.join(cases, "program_id")
    freed = F.coalesce(F.concat(F.lit("Free detected at source line: "), F.col("free_span")), F.concat(F.lit("Free detected (no source span available) for allocation "), F.col("alloc_key")))
    parts = [
        line(cases, 0, F.lit(RULE)),
        line(cases, 1, F.when(some, FOUND).otherwise(NOTHING)),
        line(cases.where("u"), 2, F.when(all_three, F.concat(F.lit(USE_HEADING + " "), F.col("uses"))).otherwise(USE_HEADING)),
        line(grouped.where("u AND use_span IS NOT NULL"), 3, F.concat(F.lit("Use detected at source line: "), F.col("use_span")), F.col("alloc_key")),
        line(cases.where("u AND (d OR n) AND NOT (d AND n)"), 4, F.col("uses")),
        line(cases.where("d"), 5, F.lit(DOUBLE_HEADING)),
        line(grouped.where("double_free"), 6, freed, F.col("alloc_key")),
        line(cases.where("n"), 7, F.when(F.col("u") | F.col("d"), NEVER_HEADING).otherwise(F.concat(F.lit(NEVER_HEADING + " "), F.col("nevers")))),
        line(cases.where("n AND (u OR d)"), 8, F.col("nevers")),
        line(cases, 9, F.lit(RULE)),
        line(warnings, 10, F.concat(F.lit("Warning: "), F.col("var"), F.lit(" is freed in C: "), F.col("info")), F.format_string("%09d", "n")),
    ]
    united = parts[0]
    for p in parts[1:]:
        united = united.union(p)
    order = Window.partitionBy("program_id").orderBy("part", "key", "line")
    return united.select("program_id", F.row_number().over(order).alias("line_no"), "line")


def node_texts(nodes: DataFrame) -> Column:
    """The label of a node in a drawing."""
    statements = F.array_join(F.transform("mir.statements", lambda s: F.concat(s["kind"], F.lit(": "), s["details"], F.lit("\n"))), "")
    rust = F.concat(F.lit("MIR bb"), F.col("mir.block_id").cast("string"), F.lit("\n"), F.coalesce(statements, F.lit("")), F.coalesce(F.concat(F.lit("Terminator: "), F.col("mir.terminator.kind"), F.lit(" "), F.col("mir.terminator.details"), F.lit("\n")), F.lit("")))
    c = F.concat(F.lit("LLVM node "), F.col("llvm.node_id").cast("string"), F.lit(": "), F.col("llvm.info"))
    or_none = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    d = F.col("dummy")
    dummy = F.concat(F.col("node_type"), F.lit(": "), d["dummy_node_name"], F.lit(" (id: "), d["id"], F.lit(")\nmir_var: "), or_none(d["mir_var"]), F.lit("\nllvm_var: "), or_none(d["llvm_var"]), F.lit("\nis_internal: "), or_none(d["is_internal"]))
    return F.when(F.col("node_type") == "Mir", rust).when(F.col("node_type") == "Llvm", c).otherwise(dummy)


def quoted_id(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def html_label(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<BR/>")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def legend_lines() -> list[str]:
    rows = [f'        <TR><TD BGCOLOR="{c}">&nbsp;&nbsp;&nbsp;</TD><TD>{text}</TD></TR>' for c, text in LEGEND]
    table = '      <TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0" CELLPADDING="4">'
    return ["    legend [shape=box, margin=0, label=<", table, '        <TR><TD COLSPAN="2"><B>Info:</B></TD></TR>', *rows, "      </TABLE>", "    >];"]


def dot_edges(edges: DataFrame) -> DataFrame:
    """(program_id, pos, line) of the edges in a drawing."""
    text = F.replace(F.replace(F.coalesce("label", F.lit("")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    edge = F.concat(F.lit('    "'), quoted_id(F.col("source")), F.lit('" -> "'), quoted_id(F.col("destination")), F.lit('" [label="'), text, F.lit('"];'))
    return edges.select("program_id", "pos", edge.alias("line"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, line_no, line): the drawing of each program's graph in the DOT language."""
    label = node_texts(nodes)
    colour = classify.node_colour(label, F.col("node_type"), F.coalesce("llvm.node_source_loc", F.lit("")))
    node = F.concat(F.lit('    "'), quoted_id(F.col("node_id")), F.lit('" [label=<'), html_label(label), F.lit('>, style="filled", fillcolor="'), colour, F.lit('"];'))
    programs = nodes.select("program_id").distinct()
    fixed = lambda part, lines: programs.select("program_id", F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, lines))).alias("at", "line"))
    united = fixed(0, ["digraph GlobalICFGNodesEdges {", "    node [shape=box];"])
    united = united.union(nodes.select("program_id", F.lit(1), F.col("seq"), node)).union(fixed(2, legend_lines())).union(dot_edges(edges).select("program_id", F.lit(3), "pos", "line")).union(fixed(4, ["}"]))
    return united.select("program_id", F.row_number().over(Window.partitionBy("program_id").orderBy("part", "at")).alias("line_no"), "line")


def write_lines(lines: DataFrame, folder: str) -> None:
    """Report or DOT lines as one text file a program."""
    ordered = lines.repartition("program_id").sortWithinPartitions("program_id", "line_no")
    ordered.select("program_id", "line").write.partitionBy("program_id").mode("overwrite").text(folder)


def matching_lines(lines: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    """The lines of a log or report that a regular expression matches."""
    return lines.where(F.col(column).rlike(pattern))
