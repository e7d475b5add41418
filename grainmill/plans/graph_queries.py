"""Readers, writers and graph rules as queries: documents are written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import fixpoint, graph
from grainmill.plans.case_queries import _MARKERS, _NODES, case_sql
from grainmill.plans.cases import case_graph
from grainmill.plans.lineage import job_folder
from grainmill.plans.queries import _BLOCKS_SQL, _block_nodes, _edges, query
from grainmill.sources import readers, schemas, sinks


def _folder(spark: SparkSession, label: str) -> str:
    return f"{job_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _program(column: str = "program_id") -> Column:
    """The program of a folder that a writer has named."""
    return F.regexp_replace(column, "^program_id=", "")


@query(case_sql("seq node_id node_type mir_var llvm_var", _NODES).replace("c_custkey", "n_nationkey").replace("customer", "nation"))
def graph_documents_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each nation: its graph document written as JSON, and its nodes read back."""
    folder = _folder(spark, "graphs")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("c_custkey"))
    sinks.write_graphs(*case_graph(nations), folder)
    nodes, _ = readers.read_graph(spark, f"{folder}/*/*.txt")
    return nodes.select(_program().alias("program_id"), "seq", "node_id", "node_type", "dummy.mir_var", "dummy.llvm_var")


_NATION_NODES = """SELECT n_regionkey::VARCHAR AS program_id, 'f' || n_nationkey % 3 AS function, n_nationkey::BIGINT AS node_id, n_name AS info FROM nation WHERE n_nationkey % 5 <> 4"""


def _c_documents(spark: SparkSession, sf_dir: str) -> str:
    """A C graph document for each region, its nations being the nodes; one in five belongs to no function."""
    key = F.col("n_nationkey")
    node = {
        "node_id": key, "info": F.col("n_name"), "node_kind_string": F.when(key % 4 == 0, "FunExitBlock").otherwise("IntraBlock"), "function_name": F.when(key % 5 != 4, F.concat(F.lit("f"), key % 3)),
        "basic_block_info": F.when(key % 8 == 0, F.concat(F.lit("block "), key)), "svf_statements": F.array().cast(f"array<{schemas.C_STATEMENT}>"), "outgoing_edges": F.array().cast(f"array<{schemas.C_EDGE}>"),
        "unknown": F.lit("left out"),
    }
    edge = F.struct(key.alias("source"), F.col("n_regionkey").alias("destination"), F.lit("intra").alias("edge_type"))
    both = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", key, F.struct(*(c.alias(n) for n, c in node.items())).alias("node"), F.array(edge, edge).alias("edges"))
    documents = both.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "node"))).alias("nodes"), F.flatten(F.collect_list("edges")).alias("edges"))
    folder = _folder(spark, "c-graphs")
    documents.select("n_regionkey", F.col("nodes.node").alias("nodes"), "edges").write.partitionBy("n_regionkey").json(folder)
    return folder


@query(_NATION_NODES)
def c_graphs_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all C graph documents of a folder, by function."""
    nodes, _ = readers.read_c_graphs(spark, f"{_c_documents(spark, sf_dir)}/*", suffix=".json")
    return nodes.select(F.regexp_replace("program_id", "^n_regionkey=", "").alias("program_id"), "function", F.col("node.node_id").cast("long").alias("node_id"), F.col("node.info").alias("info"))


@query("SELECT n_regionkey::VARCHAR AS program_id, n_nationkey::BIGINT AS source, n_regionkey::BIGINT AS destination, 'intra' AS edge_type FROM nation WHERE n_regionkey = 2")
def c_graph_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of one C graph document, region 2's, repeats once."""
    _, edges = readers.read_c_graph(spark, f"{_c_documents(spark, sf_dir)}/n_regionkey=2", program_id="2")
    return edges.select("program_id", F.col("source").cast("long").alias("source"), F.col("destination").cast("long").alias("destination"), "edge_type")


@query("""SELECT n_regionkey::VARCHAR AS program_id, 'f' || n_nationkey % 3 AS function, min_by(n_nationkey, n_nationkey)::BIGINT AS exit_id,
        coalesce(min_by({'x': CASE WHEN n_nationkey % 8 = 0 THEN 'block ' || n_nationkey END}, n_nationkey).x, 'llvm_param') AS exit_info
    FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 4 = 0 GROUP BY ALL""")
def exit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first exit block of each C function."""
    nodes, _ = readers.read_c_graphs(spark, f"{_c_documents(spark, sf_dir)}/*", suffix=".json")
    found = graph.exit_nodes(nodes)
    return found.select(F.regexp_replace("program_id", "^n_regionkey=", "").alias("program_id"), "function", F.col("exit_id").cast("long").alias("exit_id"), "exit_info")


@query("SELECT DISTINCT c_nationkey::VARCHAR AS program_id, lower(c_mktsegment) AS function FROM customer")
def ffi_names_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name documents, a program for each nation, written and read back."""
    folder = _folder(spark, "names")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sinks.write_ffi_names(customers.select(F.col("c_nationkey").cast("string").alias("program_id"), F.lower("c_mktsegment").alias("function")), folder)
    return readers.read_ffi_names(spark, f"{folder}/*").select(_program().alias("program_id"), "function")


@query("SELECT unnest(['customer', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS file")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as files of a folder, none of them read."""
    return readers.list_files(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", "([^/]+[.]parquet)", 1).alias("file")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'bin' ELSE 'lib' END AS crate_type FROM part WHERE p_partkey % 6 < 5""")
def build_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by kind: programs, five kinds of library together, and others left out."""
    kinds = (("bin", "test"), ("lib",), ("rlib", "cdylib"), ("dylib",), ("staticlib",), ("proc-macro",))
    kind = F.get(F.array(*(F.array(*map(F.lit, k)) for k in kinds)), (F.col("p_partkey") % 6).cast("int"))
    return readers.classify_targets(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", kind.alias("kind"))).select("p_partkey", "crate_type")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_partkey::VARCHAR || 'x.rlib' ELSE 'crate' || p_partkey END AS crate FROM part WHERE p_partkey % 3 <> 1")
def extern_crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crate names of library files; other files are left out."""
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("libcrate"), key, F.lit("-1a2b-3c.rlib"))).when(F.col("p_partkey") % 3 == 1, F.concat(key, F.lit(".rmeta"))).otherwise(F.concat(key, F.lit("x.rlib")))
    return readers.extern_flags(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name"))).select("p_partkey", "crate")


@query("SELECT user_id, min(event_id) AS arrival FROM events GROUP BY user_id")
def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results, users by their events, without repeats."""
    return readers.first_seen(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("arrival")), "user_id", "arrival")


@query("""SELECT doc_id, search FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' unsafe {' WHEN 1 THEN ' Box::into_raw(b)' WHEN 2 THEN ' Unsafe' ELSE '' END AS content, CASE doc_id % 3 WHEN 0 THEN 'main.rs' ELSE 'lib.rs' END AS file_name FROM documents),
    (VALUES ('unsafe_main'), ('into_raw')) s(search) WHERE CASE search WHEN 'unsafe_main' THEN file_name = 'main.rs' AND contains(content, 'unsafe') ELSE contains(content, 'Box::into_raw') END""")
def code_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two code searches over all documents as source files."""
    key = F.col("doc_id")
    added = F.when(key % 4 == 0, " unsafe {").when(key % 4 == 1, " Box::into_raw(b)").when(key % 4 == 2, " Unsafe").otherwise("")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("content"), F.when(key % 3 == 0, "main.rs").otherwise("lib.rs").alias("file_name"))
    one = lambda name: readers.code_search(files, name).select("doc_id", F.lit(name).alias("search"))
    return one("unsafe_main").union(one("into_raw"))


@query("SELECT event_id, event_type || ': ' || user_id AS line FROM events WHERE event_type = 'error' OR (event_type || ': ' || user_id) LIKE 'purchase: %7'")
def matching_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log that a pattern matches."""
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat("event_type", F.lit(": "), "user_id").alias("line"))
    return sinks.matching_lines(lines, "^error|^purchase: .*7$")


@query("""WITH calls AS (SELECT o_custkey, o_orderkey, 'rust::' || o_custkey || '::bb' || o_orderkey AS site, 'rust::' || o_custkey || '::' || CASE WHEN o_orderkey % 3 = 0 THEN 'end' ELSE 'bb' || o_orderkey + 1 END AS back,
        o_orderkey % 2 = 0 AS declared, o_orderkey % 3 = 0 AS final, o_orderkey % 5 = 0 AS unwinds FROM orders)
    SELECT known, site AS source, back AS destination, CASE WHEN known THEN 'FFI Call (stdlib)' ELSE 'FFI Call (no LLVM info)' END AS label FROM calls, (VALUES (TRUE), (FALSE)) k(known) WHERE declared
    UNION ALL SELECT known, site, back, 'Call return (fallback)' FROM calls, (VALUES (TRUE), (FALSE)) k(known) WHERE NOT declared AND NOT final
    UNION ALL SELECT known, site, 'rust::' || o_custkey || '::bb9', 'Call unwind' FROM calls, (VALUES (TRUE), (FALSE)) k(known) WHERE unwinds""")
def declared_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as functions whose orders call what is declared and has no C body, with C information and without, or nothing known."""
    key = F.col("o_orderkey")
    called, back = F.when(key % 2 == 0, "puts").otherwise("f"), F.when(key % 3 != 0, F.concat(F.lit("bb"), key + 1))
    unwind = F.when(key % 5 == 0, "cleanup(bb9)").otherwise("continue")
    fields = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], f"t {schemas.TERMINATOR}").schema["t"].dataType}
    fields |= {"kind": F.lit("Call"), "function_called": called, "return_target": back, "return_place": F.lit("_1"), "unwind_target": unwind}
    terminator = F.struct(*(c.alias(n) for n, c in fields.items()))
    blocks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("all").alias("program_id"), F.col("o_custkey").cast("string").alias("function"), key.alias("block_id"), terminator.alias("terminator"))
    declared = spark.createDataFrame([("all", "puts")], "program_id string, function string")
    parts = []
    for known, c_nodes in ((True, spark.createDataFrame([], schemas.C_NODES)), (False, None)):
        parts.append(graph.edge_rules(blocks, graph.call_sites(blocks, declared, c_nodes)).select(F.lit(known).alias("known"), "source", "destination", "label"))
    return parts[0].union(parts[1])


@query("""SELECT called, string_agg(site, ',' ORDER BY site) AS sites FROM (SELECT DISTINCT 'f' || l_suppkey AS called, 'rust::' || l_orderkey || '::bb' || l_linenumber AS site FROM lineitem) GROUP BY called""")
def site_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call sites of each C function, suppliers being these and order lines the calls."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    calls = lines.select(F.lit("all").alias("program_id"), F.lit("ffi").alias("call_kind"), F.concat(F.lit("f"), "l_suppkey").alias("called"), F.concat(F.lit("rust::"), "l_orderkey", F.lit("::bb"), "l_linenumber").alias("site"))
    return graph.call_registry(calls).select("called", F.array_join("sites", ",").alias("sites"))


@query(case_sql("node_id var marker", _MARKERS) + " WHERE node_id = 'rust::main::bb3'")
def block_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers at block 3 of main of every case program."""
    result = fixpoint.fixpoint(*case_graph(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")))
    return fixpoint.block_taint(result, "bb3").select("program_id", F.lit("rust::main::bb3").alias("node_id"), F.col("var").alias("var"), "marker")


_DRAWN = _BLOCKS_SQL + """,
    fixed AS (SELECT unnest(['digraph GlobalICFGNodesEdges {', '    node [shape=box];', '    legend [shape=box, margin=0, label=<', '      <TABLE BORDER="0" CELLBORDER="1" CELLSPACING="0" CELLPADDING="4">',
        '        <TR><TD COLSPAN="2"><B>Info:</B></TD></TR>', '        <TR><TD BGCOLOR="yellow">&nbsp;&nbsp;&nbsp;</TD><TD>MIR allocation</TD></TR>', '        <TR><TD BGCOLOR="red">&nbsp;&nbsp;&nbsp;</TD><TD>Ownership forgotten</TD></TR>',
        '        <TR><TD BGCOLOR="green">&nbsp;&nbsp;&nbsp;</TD><TD>Drop/free</TD></TR>', '        <TR><TD BGCOLOR="gray89">&nbsp;&nbsp;&nbsp;</TD><TD>MIR node</TD></TR>', '        <TR><TD BGCOLOR="turquoise">&nbsp;&nbsp;&nbsp;</TD><TD>LLVM node</TD></TR>',
        '        <TR><TD BGCOLOR="white">&nbsp;&nbsp;&nbsp;</TD><TD>Dummy node</TD></TR>', '      </TABLE>', '    >];', '}']) AS line)
    SELECT line FROM fixed UNION ALL
    SELECT '    "rust::' || l_orderkey || '::bb' || l_linenumber || '" [label=<MIR bb' || l_linenumber || '<BR/>Terminator: ' || CASE kind WHEN 0 THEN 'Goto' WHEN 1 THEN 'SwitchInt' WHEN 2 THEN 'Assert' WHEN 3 THEN 'Drop' ELSE 'Return' END
        || ' drop(_' || l_linenumber || ')<BR/>>, style="filled", fillcolor="green"];' FROM t
    UNION ALL SELECT '    "' || source || '" -> "' || destination || '" [label="' || label || '"];' FROM edges"""


@query(_DRAWN)
def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing of the order lines as blocks: header, nodes, legend and edges."""
    edges = _edges(spark, sf_dir).select("program_id", "source", "destination", "label", F.lit(0).alias("pos"))
    return sinks.dot_lines(_block_nodes(spark, sf_dir), edges).select("line")
