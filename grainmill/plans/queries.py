"""The analysis operators as queries over the test tables, each with SQL that gives the same rows.

The tables hold no program graphs, so they are mapped: an event type is a lattice
value (signup ALLOC, click MB, view IMMB, purchase MV, error FREED), a user's day
is an allocation, an order is a function whose lines are its blocks, and a
customer is a program whose orders are the blocks of main.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import classify, lattice, names
from grainmill.operators import detect, fixpoint, graph, memory
from grainmill.operators.components import connected_components
from grainmill.plans.lineage import written
from grainmill.sources import schemas, sinks

# The lattice value of each event type.
VALUES = {"signup": "ALLOC", "click": "MB", "view": "IMMB", "purchase": "MV", "error": "FREED"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _mask() -> Column:
    out = F.lit(None).cast("int")
    for event, value in VALUES.items():
        out = F.when(F.col("event_type") == event, F.lit(lattice.MASKS[value])).otherwise(out)
    return out


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, mask): the least upper bound of a user's events of a day."""
    events = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), _mask().alias("mask"))
    return events.groupBy("user_id", "day").agg(lattice.lub(F.col("mask")).alias("mask"))


# The SQL spells masks and classes out, so that a wrong one here does not pass by being wrong there too.
_MASK_SQL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'purchase' THEN 9 WHEN 'error' THEN 16 END"
_NORMAL = lambda x: f"CASE WHEN {x} IN (0, 1, 3, 5, 9, 16, 31) THEN {x} ELSE 31 END"
_DECODE = lambda x: f"CASE {x} WHEN 0 THEN 'BOTTOM' WHEN 1 THEN 'ALLOC' WHEN 3 THEN 'MB' WHEN 5 THEN 'IMMB' WHEN 9 THEN 'MV' WHEN 16 THEN 'FREED' ELSE 'TOP' END"
_DAYS_SQL = f"days AS (SELECT user_id, CAST(ts AS DATE) AS day, {_NORMAL(f'bit_or({_MASK_SQL})')} AS mask FROM events GROUP BY ALL)"


@query(f"WITH {_DAYS_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, {_DECODE('mask')} AS value FROM days")
def lattice_lub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), lattice.decode(F.col("mask")).alias("value"))


@query(f"""WITH {_DAYS_SQL} SELECT a.user_id, CAST(a.day AS VARCHAR) AS day,
    CASE WHEN a.mask = b.mask THEN '=' WHEN b.mask = 31 OR (a.mask | b.mask) = b.mask THEN '<' WHEN a.mask = 31 OR (a.mask | b.mask) = a.mask THEN '>' END AS relation
    FROM days a JOIN days b ON a.user_id = b.user_id AND b.day = a.day + 1""")
def lattice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    after = days.select("user_id", F.date_sub("day", 1).alias("day"), F.col("mask").alias("next"))
    return days.join(after, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), lattice.compare(F.col("mask"), F.col("next")).alias("relation"))


_HOURS_SQL = f"""hours AS (SELECT user_id, day(ts) % 2 AS odd, hour(ts) AS h, list_sort(list_distinct(list(event_type))) AS alloc, {_NORMAL(f'bit_or({_MASK_SQL})')} AS mask FROM events GROUP BY ALL),
    memories AS (SELECT odd, user_id, alloc, {_NORMAL('bit_or(mask)')} AS mask FROM hours GROUP BY ALL),
    vars AS (SELECT odd, user_id, var, min({{'alloc': alloc, 'mask': mask}}) AS m FROM (SELECT *, unnest(alloc) AS var FROM memories) GROUP BY ALL)"""


def _memories(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A user's memory over the odd days and over the even ones: alias sets are the event types of an hour of the day."""
    events = _read(spark, sf_dir, "events").withColumn("odd", F.dayofmonth("ts") % 2)
    hours = events.groupBy("user_id", "odd", F.hour("ts").alias("h")).agg(F.array_sort(F.collect_set("event_type")).alias("alloc"), lattice.lub(_mask()).alias("mask"))
    each = hours.groupBy("odd", "user_id", "alloc").agg(lattice.lub(F.col("mask")).alias("mask"))
    return [each.where(F.col("odd") == k).drop("odd") for k in (1, 0)]


@query(f"""WITH {_HOURS_SQL}, both_sides AS (
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.var, b.var) AS var, coalesce(a.m.mask, 0) | coalesce(b.m.mask, 0) AS mask,
           list_sort(list_distinct(list_concat(coalesce(a.m.alloc, []), coalesce(b.m.alloc, [])))) AS alloc
    FROM (SELECT * FROM vars WHERE odd = 1) a FULL JOIN (SELECT * FROM vars WHERE odd = 0) b ON a.user_id = b.user_id AND a.var = b.var)
    SELECT user_id, array_to_string(alloc, ',') AS alloc, {_DECODE('max_by(mask, var)')} AS value FROM both_sides GROUP BY user_id, both_sides.alloc""")
def memory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = memory.union_memories(*_memories(spark, sf_dir), ["user_id"])
    return joined.select("user_id", F.array_join("alloc", ",").alias("alloc"), lattice.decode(F.col("mask")).alias("value"))


@query(f"""WITH {_HOURS_SQL}, pairs AS (
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.m.mask, 0) AS x, coalesce(b.m.mask, 0) AS y
    FROM (SELECT * FROM vars WHERE odd = 1) a FULL JOIN (SELECT * FROM vars WHERE odd = 0) b ON a.user_id = b.user_id AND a.var = b.var)
    SELECT user_id, CASE WHEN bool_and(x = y) THEN 'Equal' WHEN bool_and(y = 31 OR (x | y) = y) THEN 'Less' END AS relation FROM pairs GROUP BY user_id""")
def memory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.compare_memories(*_memories(spark, sf_dir), ["user_id"]).withColumnRenamed("order", "relation")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    roots(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways
        UNION (SELECT e.a, min(v.root) FROM roots v JOIN both_ways e ON e.b = v.node JOIN recurring.roots u ON u.node = e.a GROUP BY e.a, u.root HAVING min(v.root) < u.root))
    SELECT root, '{' || string_agg(node, ', ' ORDER BY node) || '}' AS group_key FROM roots GROUP BY root""")
def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of parts and suppliers over every order line."""
    return _groups_of(_read(spark, sf_dir, "lineitem"))


def _groups_of(lines: DataFrame) -> DataFrame:
    edges = lines.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    members = connected_components(edges, "a", "b").select(F.lit("all").alias("program_id"), F.col("component").alias("root"), F.col("node").alias("name"))
    return detect.alias_groups(members).select("root", "group_key")


def _variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tracked variables of their order."""
    lines = _read(spark, sf_dir, "lineitem")
    span = F.concat(F.lit("src/main.rs:"), F.col("l_partkey"), F.lit(":1: 1:1 (#0)"))
    when = lambda c, v: F.when(F.expr(c), v)
    return lines.select(
        F.lit("all").alias("program_id"), F.format_string("%d/%d/%d", "l_orderkey", "l_linenumber", "l_partkey").alias("name"), F.col("l_orderkey").cast("string").alias("group_key"),
        (F.col("l_linenumber") % 2).cast("long").alias("llvm_free"), (F.col("l_quantity").cast("long") % 2).alias("drop_free"), (F.col("l_returnflag") == "R").alias("used"),
        when("l_linestatus = 'O'", span).alias("use_span"), when("l_quantity % 2 = 1", span).alias("free_span"), when("l_quantity % 2 = 1", F.lit("Drop")).alias("free_kind"),
    )


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_sets = spark.createDataFrame([], "program_id string, var string, alloc array<string>")
    return detect.classify_groups(detect.group_report(_variables(spark, sf_dir), no_sets))


_REPORT_SQL = """WITH vars AS (
        SELECT l_orderkey::VARCHAR AS alloc_key, printf('%d/%d/%d', l_orderkey, l_linenumber, l_partkey) AS name, l_linenumber % 2 AS llvm, l_quantity::BIGINT % 2 AS dropped,
               l_returnflag = 'R' AS used, 'src/main.rs:' || l_partkey || ':1: 1:1 (#0)' AS span, l_linestatus = 'O' AS has_use, l_quantity % 2 = 1 AS has_free FROM lineitem
    ), report AS (
        SELECT alloc_key, sum(CASE WHEN llvm > 0 AND dropped > 0 THEN greatest(llvm, dropped) ELSE llvm + dropped END)::BIGINT AS frees, bool_or(used) AS used,
               min_by(span, name) FILTER (WHERE has_use) AS use_span, min_by(span, name) FILTER (WHERE has_free) AS free_span FROM vars GROUP BY alloc_key)"""


@query(_REPORT_SQL + " SELECT alloc_key, frees, used, use_span, free_span FROM report")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("alloc_key", "frees", "used", "use_span", "free_span")


@query(_REPORT_SQL + " SELECT alloc_key, frees FROM report WHERE frees >= 2")
def double_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).where("double_free").select("alloc_key", "frees")


@query(_REPORT_SQL + " SELECT alloc_key, used FROM report WHERE frees = 0")
def never_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).where("never_free").select("alloc_key", "used")


@query(_REPORT_SQL + """ SELECT alloc_key, use_span, free_span FROM report WHERE used AND frees > 0 AND free_span IS NOT NULL
    AND CAST(split_part(use_span, ':', -4) AS BIGINT) > CAST(split_part(free_span, ':', -4) AS BIGINT)""")
def use_after_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).where("use_after_free").select("alloc_key", "use_span", "free_span")


_CALLS = ("std::boxed::Box::<%>::new", "std::boxed::Box::<%>::into_raw", "std::boxed::Box::<%>::from_raw", "std::mem::drop::<%>", "std::boxed::Box::<Wrap<%>>::new", "std::mem::forget::<std::boxed::Box<%>>", "std::ffi::CStr::from_ptr::<'_>(%)")
_TEXT_SQL = "CASE p_partkey % 7 " + " ".join("WHEN {} THEN '{}'".format(i, c.replace("'", "''")) for i, c in enumerate(_CALLS)) + " END"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _CALLS)), (F.col("p_partkey") % len(_CALLS)).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.replace(text, F.lit("%"), F.col("p_brand")).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'alloc' WHEN 1 THEN 'moved' WHEN 2 THEN 'reowned' WHEN 3 THEN 'drop' WHEN 4 THEN 'other' WHEN 5 THEN 'moved' ELSE 'rename' END AS class FROM part")
def first_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("p_partkey", classify.call_class(F.col("text"), F.col("text")).alias("class"))


@query(r"""SELECT p_partkey, CASE WHEN contains(text, '::new') AND NOT contains(text, 'Wrap') THEN 'yellow' WHEN contains(text, 'drop') THEN 'green'
    WHEN contains(text, 'into_raw') OR contains(text, 'std::mem::forget') THEN 'red' ELSE 'gray89' END AS colour
    FROM (SELECT p_partkey, replace(""" + _TEXT_SQL.replace("'std::boxed::Box::<%>::new'", "'std::boxed::Box::<i32>::new'") + """, '%', p_brand) AS text FROM part)""")
def node_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % len(_CALLS) == 0, "std::boxed::Box::<i32>::new").otherwise(F.col("text"))
    return _calls(spark, sf_dir).select("p_partkey", classify.node_colour(text, F.lit("Mir"), F.lit("")).alias("colour"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS line FROM lineitem")
def span_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.concat(F.lit("/src/f.rs:"), "l_suppkey", F.lit(":26: 39:45 (#0)"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.span_line(span).alias("line"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '_' || o_custkey WHEN 1 THEN '' ELSE '_' || o_orderkey END AS moved,
    CASE o_orderkey % 3 WHEN 1 THEN '_' || o_custkey ELSE '' END AS copied FROM orders""")
def moved_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, customer, order = F.col("o_orderkey") % 3, F.concat(F.lit("_"), "o_custkey"), F.concat(F.lit("_"), "o_orderkey")
    text = F.when(kind == 0, F.concat(F.lit("f(move "), customer, F.lit(")) -> bb1"))).when(kind == 1, F.concat(F.lit("copy "), customer, F.lit(" as *const i8"))).otherwise(F.concat(F.lit("(move "), order, F.lit(" move _1)")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", names.moved(text).alias("moved"), names.copied(text).alias("copied"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("program_id"), F.col("c_custkey").cast("string").alias("function"))


@query("SELECT c_nationkey::VARCHAR AS program_id, c_custkey::VARCHAR AS function FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ffi_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("function"))
    declared = _functions(spark, sf_dir).join(urgent.distinct(), "function", "left_semi").select("program_id", "function")
    return graph.ffi_only(_functions(spark, sf_dir), declared)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions: each line is a block, with a terminator by its part number."""
    kind = F.col("l_partkey") % 5
    block = lambda c: F.concat(F.lit("bb"), (F.col(c) % 9).cast("string"))
    unwind = F.when(F.col("l_suppkey") % 3 == 0, "continue").when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("cleanup("), block("l_suppkey"), F.lit(")"))).otherwise("terminate")
    fields = {
        "kind": F.get(F.array(*map(F.lit, ("Goto", "SwitchInt", "Assert", "Drop", "Return"))), kind.cast("int")), "target": block("l_suppkey"), "return_target": block("l_suppkey"), "unwind_target": unwind,
        "targets": F.array(F.concat(F.lit("(0, "), block("l_suppkey"), F.lit(")")), F.concat(F.lit("(1, "), block("l_partkey"), F.lit(")"))),
        "otherwise": F.when(F.col("l_linenumber") % 2 == 0, block("l_linenumber")), "details": F.concat(F.lit("drop(_"), "l_linenumber", F.lit(")")), "dropped_value": F.concat(F.lit("_"), "l_linenumber"),
    }
    terminator = F.from_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), schemas.TERMINATOR)
    first = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return first.select(F.lit("all").alias("program_id"), F.col("l_orderkey").cast("string").alias("function"), F.col("l_linenumber").alias("block_id"), F.lit(None).cast(f"array<{schemas.STATEMENT}>").alias("statements"), terminator.alias("terminator"))


_BLOCKS_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
    t AS (SELECT *, p % 5 AS kind, 'rust::' || l_orderkey || '::bb' AS f, 'rust::' || l_orderkey || '::bb' || l_linenumber AS source, s % 9 AS st, CASE s % 3 WHEN 1 THEN 'bb' || s % 9 WHEN 2 THEN 'terminate' END AS u, 'rust::' || l_orderkey || '::' AS r FROM b),
    edges AS (
        SELECT source, f || st AS destination, 'Goto' AS label FROM t WHERE kind = 0
        UNION ALL SELECT source, f || st, 'SwitchInt target' FROM t WHERE kind = 1
        UNION ALL SELECT source, f || p % 9, 'SwitchInt target' FROM t WHERE kind = 1
        UNION ALL SELECT source, f || l_linenumber % 9, 'SwitchInt otherwise' FROM t WHERE kind = 1 AND l_linenumber % 2 = 0
        UNION ALL SELECT source, f || st, 'Assert success' FROM t WHERE kind = 2
        UNION ALL SELECT source, r || u, 'Assert unwind' FROM t WHERE kind = 2 AND u IS NOT NULL
        UNION ALL SELECT source, f || st, 'Drop return' FROM t WHERE kind = 3
        UNION ALL SELECT source, r || u, 'Drop unwind' FROM t WHERE kind = 3 AND u IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    none = spark.createDataFrame([], "program_id string, function string")
    return graph.edge_rules(blocks, graph.call_sites(blocks, none, None))


def _block_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("program_id", F.col("block_id").alias("seq"), names.mir_node(F.col("function"), F.col("block_id")).alias("node_id"), F.lit("Mir").alias("node_type"), F.struct("block_id", "statements", "terminator").alias("mir"), F.lit(None).cast(schemas.C_NODE).alias("llvm"), F.lit(None).cast(schemas.DUMMY).alias("dummy"))


@query(_BLOCKS_SQL + " SELECT source, destination, label FROM edges")
def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("source", "destination", "label")


@query(_BLOCKS_SQL + """ SELECT e.source, e.destination, e.label, 'Mir bb' || a.l_linenumber AS source_label, 'Mir bb' || b.l_linenumber AS destination_label
    FROM edges e LEFT JOIN t a ON a.source = e.source LEFT JOIN t b ON b.source = e.destination""")
def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).select("program_id", "source", "destination", "label")
    return graph.labelled(edges, graph.node_labels(_block_nodes(spark, sf_dir))).select("source", "destination", "label", "source_label", "destination_label")


@query(_BLOCKS_SQL + " SELECT t.source AS node_id, '_' || l_linenumber AS variable FROM t WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.destination = t.source AND contains(e.label, 'unwind'))")
def skip_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _block_nodes(spark, sf_dir).where("mir.terminator.kind = 'Drop'"), _edges(spark, sf_dir)
    unwound = edges.where(F.col("label").contains("unwind")).select(F.col("destination").alias("node_id"))
    kept = nodes.join(unwound, "node_id", "left_anti")
    return kept.select("node_id", classify.dropped_variable(F.col("mir.terminator.details")).alias("variable"))


@query(_BLOCKS_SQL + """, ordered AS (SELECT source AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber <> 3, l_linenumber) AS scan FROM t) SELECT node_id, scan FROM ordered""")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a program here, and its third line comes first."""
    nodes = _block_nodes(spark, sf_dir).select(F.split_part("node_id", F.lit("::"), F.lit(2)).alias("program_id"), "seq", F.col("node_id").alias("full"), F.split_part("node_id", F.lit("::"), F.lit(3)).alias("node_id"))
    return detect.scan_order(nodes, "bb3").select(F.col("full").alias("node_id"), "scan")


@query(r"""WITH sites AS (SELECT DISTINCT 'f' || l_suppkey AS called, 'rust::' || l_orderkey || '::bb' || l_linenumber AS site FROM lineitem),
    c_edges AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation),
    there AS (SELECT 'llvm::' || called || '::node' || n_nationkey || '::' || site AS id FROM sites, nation WHERE n_nationkey % 3 <> 0)
    SELECT DISTINCT 'llvm::' || called || '::node' || a || '::' || site AS source, 'llvm::' || called || '::node' || b || '::' || site AS destination FROM sites, c_edges
    WHERE 'llvm::' || called || '::node' || a || '::' || site IN (SELECT id FROM there) AND 'llvm::' || called || '::node' || b || '::' || site IN (SELECT id FROM there)""")
def callsite_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a small C graph, nations and their regions, with every order line as a call site."""
    return _clones_of(spark, sf_dir, _read(spark, sf_dir, "lineitem"))


def _clones_of(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    program, called = F.lit("all").alias("program_id"), F.concat(F.lit("f"), "l_suppkey").alias("called")
    sites = lines.select("l_orderkey", "l_linenumber", "l_suppkey").distinct().select(program, called, names.mir_node(F.col("l_orderkey").cast("string"), F.col("l_linenumber")).alias("site"))
    nation = _read(spark, sf_dir, "nation")
    c_edges = nation.select(program, F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("destination"))
    bodies = lines.select(program, called).distinct().join(nation.where("n_nationkey % 3 <> 0").select(program, F.col("n_nationkey").alias("number")), "program_id")
    return graph.c_edges_of_sites(c_edges, bodies, sites).select("source", "destination")


@query("""WITH fns AS (SELECT 'f' || (o_orderkey % 1000) || '::{closure#' || (o_orderkey % 7) || '}' AS closure, 'f' || (o_orderkey % 1000) AS owner FROM orders)
    SELECT owner AS function, min(closure) AS closure FROM fns GROUP BY owner""")
def closure_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("o_orderkey") % 1000)
    blocks = _read(spark, sf_dir, "orders").select(F.lit("all").alias("program_id"), F.concat(name, F.lit("::{closure#"), F.col("o_orderkey") % 7, F.lit("}")).alias("function"), F.lit(0).alias("block_id"), F.struct(F.lit("Return").alias("kind")).alias("terminator"))
    return graph.closures(blocks).select("function", "closure")


@query("""WITH RECURSIVE e AS (SELECT conv_id || '/' || turn AS source, conv_id || '/' || (turn + 1) AS destination FROM conversations),
    reach(node) AS (SELECT DISTINCT conv_id || '/' || turn FROM conversations WHERE turn = 1 UNION SELECT e.destination FROM reach r JOIN e ON r.node = e.source) SELECT node FROM reach""")
def chain_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    at = lambda t: F.concat_ws("/", "conv_id", t)
    edges = turns.select(at(F.col("turn")).alias("source"), at(F.col("turn") + 1).alias("destination")).distinct()
    return graph.reachable(written(edges, "turns"), turns.where("turn = 1").select(at(F.col("turn")).alias("node")))


@query("""WITH last_of AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
    found AS (SELECT l.o_custkey, max(o.o_orderkey) AS node FROM last_of l JOIN orders o ON o.o_custkey = l.o_custkey AND starts_with(o.o_orderkey::VARCHAR, l.last::VARCHAR) WHERE o.o_orderstatus <> 'O' OR o.o_orderkey = l.last GROUP BY l.o_custkey)
    SELECT o_custkey::VARCHAR AS program_id, node::VARCHAR AS node_id FROM found""")
def last_node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are nodes; those of status F are dummies for the visit, and open ones other than the last visited have an edge out."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("program_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("node_id"), "o_orderstatus")
    result = orders.where("o_orderstatus <> 'F'").select("program_id", F.lit("visit").alias("kind"), "node_id", F.col("seq").alias("n"))
    last = fixpoint.last_visited(result).withColumnRenamed("node_id", "last")
    edges = orders.where("o_orderstatus = 'O'").join(last, "program_id").where("node_id <> last").select("program_id", F.col("node_id").alias("source"))
    return detect.last_node(orders, edges, result).select("program_id", "node_id")


@query(f"WITH {_HOURS_SQL} SELECT DISTINCT user_id, unnest(alloc) AS var, CASE mask WHEN 9 THEN 'assign' ELSE 'free' END AS marker FROM memories WHERE mask IN (9, 16)")
def taint_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of the memories of the odd days and of the even ones."""
    odd, even = _memories(spark, sf_dir)
    return fixpoint.taint_markers(odd.unionByName(even))


@query(_REPORT_SQL + """, flags AS (SELECT used AND frees > 0 AND free_span IS NOT NULL AND coalesce(CAST(split_part(use_span, ':', -4) AS BIGINT) > CAST(split_part(free_span, ':', -4) AS BIGINT), FALSE) AS u, frees >= 2 AS d, frees = 0 AS n, alloc_key FROM report)
    SELECT alloc_key, CASE WHEN NOT (u OR d OR n) THEN 'clean' ELSE concat_ws('+', CASE WHEN u THEN 'use' END, CASE WHEN d THEN 'double' END, CASE WHEN n THEN 'never' END) END AS finding FROM flags""")
def report_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("alloc_key", sinks.report_case(F.col("use_after_free"), F.col("double_free"), F.col("never_free")).alias("finding"))


@query(_BLOCKS_SQL + """ SELECT '    "' || source || '" -> "' || destination || '" [label="' || label || '"];' AS line FROM edges""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).select("program_id", "source", "destination", "label", F.lit(0).alias("pos"))
    return sinks.dot_edges(edges).select("line")


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as programs: each order is a block of main that allocates, gives up, takes back or drops by its number."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    each = listed.select(F.col("o_custkey").cast("string").alias("program_id"), F.size("keys").alias("n"), F.posexplode("keys").alias("i", "key"))
    var = lambda x: F.concat(F.lit("_"), (x % 4 + 1).cast("string"))
    step, here, before = F.col("key") % 4, var(F.col("key")), var(F.col("key") + 1)
    called = F.get(F.array(*map(F.lit, ("std::boxed::Box::<i32>::new", "std::boxed::Box::<i32>::into_raw", "std::boxed::Box::<i32>::from_raw"))), step.cast("int"))
    after, span = F.concat(F.lit("bb"), (F.col("i") + 1).cast("string")), F.concat(F.lit("main.rs:"), "i", F.lit(":1: 1:2 (#0)"))
    fields = {
        "kind": F.when(F.col("i") == F.col("n") - 1, "Return").when(step == 3, "Drop").otherwise("Call"), "function_called": called, "return_place": here, "return_target": after, "unwind_target": F.lit("continue"), "source_info": span,
        "details": F.when(step == 3, F.concat(F.lit("drop("), before, F.lit(")"))).otherwise(F.concat(called, F.lit("(move "), before, F.lit(")"))), "dropped_value": before,
        "arguments": F.array(F.struct(F.concat(F.lit("Local("), before, F.lit(")")).alias("arg"))),
    }
    terminator = F.from_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), schemas.TERMINATOR)
    return each.select("program_id", F.lit("main").alias("function"), F.col("i").alias("block_id"), F.lit(None).cast(f"array<{schemas.STATEMENT}>").alias("statements"), terminator.alias("terminator"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = spark.createDataFrame([], "program_id string, function string")
    return graph.build_graph(written(_programs(spark, sf_dir), "blocks"), none)


@query()
def fixpoint_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the fold depends on its order."""
    state = fixpoint.fixpoint(*_graph(spark, sf_dir)).where("kind = 'state'")
    return state.select("program_id", "node_id", F.array_join("alloc", ",").alias("alloc"), lattice.decode(F.col("mask")).alias("value"))


@query()
def detect_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the fold depends on its order."""
    nodes, edges = _graph(spark, sf_dir)
    findings, _ = detect.detect(nodes, edges, written(fixpoint.fixpoint(nodes, edges), "fixpoint"))
    return findings
