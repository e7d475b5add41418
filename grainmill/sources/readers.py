"""Readers of program graphs, C graphs, name sets and project listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill.sources import schemas


def _program(program_id: str | None) -> Column:
    """The given id, or the name of the folder that holds the file."""
    return F.lit(program_id) if program_id else F.element_at(F.split(F.input_file_name(), "/"), -2)


def read_graph(spark: SparkSession, path: str, program_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of global graph documents, one pretty-printed document a file.

    A node entry is a two-element array, id and payload, so documents are read
    as VARIANT and each payload is cast to the struct of its node type.  Unknown
    fields are ignored and missing ones are null.
    """
    text = spark.read.text(path, wholetext=True).select(_program(program_id).alias("program_id"), F.parse_json("value").alias("doc"))
    text.createOrReplaceTempView("__graphs")
    nodes = spark.sql(f"""
        SELECT program_id, CAST(n.pos AS INT) AS seq, variant_get(n.value, '$[0]', 'string') AS node_id,
               variant_get(n.value, '$[1].node_type', 'string') AS node_type,
               CASE WHEN variant_get(n.value, '$[1].node_type', 'string') = 'Mir' THEN from_json(to_json(variant_get(n.value, '$[1].node_data', 'variant')), '{schemas.BLOCK}') END AS mir,
               CASE WHEN variant_get(n.value, '$[1].node_type', 'string') = 'Llvm' THEN from_json(to_json(variant_get(n.value, '$[1].node_data', 'variant')), '{schemas.C_NODE}') END AS llvm,
               CASE WHEN variant_get(n.value, '$[1].node_type', 'string') LIKE 'Dummy%' THEN from_json(to_json(variant_get(n.value, '$[1].node_data', 'variant')), '{schemas.DUMMY}') END AS dummy
        FROM __graphs, LATERAL variant_explode(variant_get(doc, '$.ordered_nodes', 'variant')) AS n""")
    edges = spark.sql(f"""
        SELECT program_id, CAST(e.pos AS INT) AS pos, s.* FROM (
            SELECT program_id, e.pos, from_json(to_json(e.value), '{schemas.GRAPH_EDGE}') AS s, e.value
            FROM __graphs, LATERAL variant_explode(variant_get(doc, '$.icfg_edges', 'variant')) AS e) AS e""")
    return nodes, edges


def read_c_graph(spark: SparkSession, path: str, program_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes by function, distinct edges) of one C graph file; nodes without a function belong to none."""
    return _c_tables(spark.read.schema(schemas.C_GRAPH).json(path, multiLine=True).withColumn("program_id", _program(program_id)), ("source", "destination", "edge_type"))


def read_c_graphs(spark: SparkSession, folder: str, program_id: str | None = None, suffix: str = "_A_FINAL_ICFG.json") -> tuple[DataFrame, DataFrame]:
    """As read_c_graph for all graph files of a folder: functions of one name are appended, repeats included."""
    docs = spark.read.schema(schemas.C_GRAPH).option("pathGlobFilter", f"*{suffix}").json(folder, multiLine=True)
    return _c_tables(docs.withColumn("program_id", _program(program_id)), ("source", "destination", "edge_type"))


def _c_tables(docs: DataFrame, edge_key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    rows = docs.withColumn("file", F.input_file_name()).select("program_id", "file", F.posexplode("nodes").alias("i", "node")).where("node.function_name IS NOT NULL")
    order = Window.partitionBy("program_id").orderBy("file", "i")
    nodes = rows.withColumn("pos", F.row_number().over(order).cast("long")).select("program_id", F.col("node.function_name").alias("function"), "pos", "node")
    edges = docs.select("program_id", F.explode("edges").alias("e")).select("program_id", "e.*").dropDuplicates(["program_id", *edge_key])
    return nodes, edges


def read_ffi_names(spark: SparkSession, path: str, program_id: str | None = None) -> DataFrame:
    """(program_id, function) of ``{"ffi_functions": [...]}``; a document without the field is an error."""
    docs = spark.read.schema("ffi_functions ARRAY<STRING>").json(path, multiLine=True).withColumn("program_id", _program(program_id))
    missing = F.when(F.col("ffi_functions").isNull(), F.raise_error(F.lit("ffi_functions is missing"))).otherwise(F.col("ffi_functions"))
    return docs.select("program_id", F.explode(missing).alias("function")).distinct()


def list_files(spark: SparkSession, folder: str, pattern: str = "*.c") -> DataFrame:
    """Paths of all files below a folder whose name matches, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path")


def classify_targets(targets: DataFrame, kinds: str = "kind") -> DataFrame:
    """Build targets with ``crate_type``: bin, or lib for any kind of library; others are left out."""
    kind = F.col(kinds)
    found = F.when(F.array_contains(kind, "bin"), "bin").when(F.arrays_overlap(kind, F.array(*map(F.lit, ("lib", "rlib", "dylib", "cdylib", "staticlib")))), "lib")
    return targets.withColumn("crate_type", found).where("crate_type IS NOT NULL")


def extern_flags(names: DataFrame, column: str = "name") -> DataFrame:
    """Crate names of library files: ``lib`` stripped, the text before the first dash."""
    return names.where(F.col(column).endswith(".rlib")).withColumn("crate", F.regexp_extract(column, r"^(?:lib)?([^-]*)", 1))


def first_seen(results: DataFrame, key: str, arrival: str) -> DataFrame:
    """Search results without repeats, in order of first arrival."""
    first = results.groupBy(key).agg(F.min(arrival).alias(arrival))
    return first.orderBy(arrival)


#: The two predicates of the code search, over (file_name, content).
SEARCHES = {"unsafe_main": "file_name = 'main.rs' AND content LIKE '%unsafe%'", "into_raw": "content LIKE '%Box::into_raw%'"}


def code_search(files: DataFrame, search: str) -> DataFrame:
    return files.where(SEARCHES[search])
