"""The naming grammar and the text classes as queries over order lines and parts, whose numbers make the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import classify, lattice, names
from grainmill.operators import detect, memory
from grainmill.plans.queries import query


def _texts(number: Column, pick: Column, shapes: tuple[str | None, ...]) -> Column:
    """The shape that ``pick`` chooses, with the number in place of each %."""
    return F.replace(F.get(F.array(*map(F.lit, shapes)), (pick % len(shapes)).cast("int")), F.lit("%"), number.cast("string"))


def _texts_sql(number: str, pick: str, shapes: tuple[str | None, ...]) -> str:
    arms = " ".join("WHEN {} THEN {}".format(i, "NULL" if x is None else "'" + x.replace("'", "''") + "'") for i, x in enumerate(shapes))
    return f"replace(CASE {pick} % {len(shapes)} {arms} END, '%', {number}::VARCHAR)"


_LOCALS = ("Local(_%) [mutable]", "_%", "Local(_%)", "Local _0", ' "Local(_%) [mutable]" ', "Local(_%) [mutable] -> Field(0) -> Deref", "__%", "Local %  ", None)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN starts_with(x, 'Local(') THEN split_part(x, ' ', 1) ELSE 'Local(' || x || ')' END AS full_name,
        'Local(' || CASE WHEN starts_with(x, 'Local ') THEN trim(substr(x, 7)) ELSE ltrim(x, '_') END || ')' AS return_name,
        trim(x, '" ' || chr(9) || chr(10)) AS bare, split_part(x, ' ', 1) AS local, contains(x, ' [mutable]') AS is_mutable,
        CASE WHEN contains(x, ' -> ') THEN substr(x, strpos(x, ' -> ') + 4) END AS projection
    FROM (SELECT *, {_texts_sql('l_partkey', 'l_suppkey', _LOCALS)} AS x FROM lineitem)""")
def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = _texts(F.col("l_partkey"), F.col("l_suppkey"), _LOCALS)
    parts = names.place_parts(x)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", names.full_local(x).alias("full_name"), names.return_local(x).alias("return_name"), names.trimmed(x).alias("bare"),
                        parts["local"].alias("local"), parts["is_mutable"].alias("is_mutable"), parts["projection"].alias("projection"))


_ARGUMENTS = ('{"arg": "Local(_%)", "is_mutable": false}', "Local(_%) [mutable]", "_%", "f(_%) and g(_1)", "none (", '"arg":"_%"', None)


@query(f"""SELECT o_orderkey, CASE WHEN contains(x, '(') AND strpos(substr(x, strpos(x, '(') + 1), ')') > 0 THEN split_part(substr(x, strpos(x, '(') + 1), ')', 1) ELSE x END AS name,
        CASE WHEN contains(x, '"arg":') THEN split_part(substr(x, strpos(x, '"arg":') + 6), '"', 2) END AS value
    FROM (SELECT o_orderkey, {_texts_sql('o_custkey', 'o_orderkey', _ARGUMENTS)} AS x FROM orders)""")
def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _texts(F.col("o_custkey"), F.col("o_orderkey"), _ARGUMENTS)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", names.argument_name(x).alias("name"), names.argument_value(x).alias("value"))


_UNWINDS = ("continue", "unreachable", "terminate", "cleanup")


@query("""SELECT o_orderkey, text, CASE WHEN starts_with(text, 'cleanup(') THEN substr(text, 9, length(text) - 9) ELSE text END AS target, text NOT IN ('continue', 'unreachable') AS makes_edge
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'continue' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'terminate' ELSE 'cleanup(bb' || o_custkey || ')' END AS text FROM orders)""")
def unwind_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _UNWINDS)), (F.col("o_orderkey") % 4).cast("int"))
    text = names.unwind_text(kind, F.concat(F.lit("bb"), F.col("o_custkey").cast("string")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", "text", names.clean_target(F.col("text")).alias("target"), names.unwinds(F.col("text")).alias("makes_edge"))


_SPANS = ("/src/f.rs:%:26: 39:45 (#0)", "x:%", "C:\\f.rs:%:1: 7:2 (#0)", "a:b:c:d", "", ":%:1: 1:1", "f.rs:%x:1: 1:1", None)


@query(f"SELECT o_orderkey, CASE WHEN len(string_split(x, ':')) >= 4 THEN TRY_CAST(split_part(x, ':', -4) AS BIGINT) END AS line FROM (SELECT o_orderkey, {_texts_sql('o_custkey', 'o_orderkey', _SPANS)} AS x FROM orders)")
def odd_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of spans of all shapes, malformed ones too."""
    x = _texts(F.col("o_custkey"), F.col("o_orderkey"), _SPANS)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", names.span_line(x).alias("line"))


_MOVES = ("f(move _%)) -> bb1", "move  _%", "(move _% move _2) move _3", "copy _% as *const i8", "g(h(move _%))) copy (_4))", "remove _%", "none", None)


@query(f"""SELECT o_orderkey,
        CASE WHEN x IS NOT NULL THEN CASE WHEN contains(x, 'move ') THEN rtrim(string_split(ltrim(split_part(x, 'move ', 2)), ' ')[1], ')') ELSE '' END END AS moved,
        CASE WHEN x IS NOT NULL THEN CASE WHEN contains(x, 'copy ') THEN rtrim(string_split(ltrim(split_part(x, 'copy ', 2)), ' ')[1], ')') ELSE '' END END AS copied
    FROM (SELECT o_orderkey, {_texts_sql('o_custkey', 'o_orderkey', _MOVES)} AS x FROM orders)""")
def odd_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved and copied operands of nested and malformed texts."""
    x = _texts(F.col("o_custkey"), F.col("o_orderkey"), _MOVES)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", names.moved(x).alias("moved"), names.copied(x).alias("copied"))


_C_EDGES, _C_NODES = ("IntraCF", "CallCF", "RetCF", "Elsewhere"), ("IntraBlock", "FunEntryBlock", "FunExitBlock", "FunCallBlock", "FunRetBlock", "ValNode", "GlobalBlock")
_C_STATEMENTS = ("StoreStmt", "LoadStmt,AssignStmt", "AssignStmt", "CallPE,AssignStmt", "BranchStmt", "GepStmt", "CmpStmt", "PhiStmt", "BinaryOPStmt", "UnaryOPStmt", "AddrStmt,AssignStmt")


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'intra' WHEN 1 THEN 'call' WHEN 2 THEN 'ret' ELSE 'unknown' END AS edge,
        CASE p_partkey % 7 WHEN 0 THEN 'IntraBlock' WHEN 1 THEN 'FunEntryBlock' WHEN 2 THEN 'FunExitBlock' WHEN 3 THEN 'FunCallBlock' WHEN 4 THEN 'FunRetBlock' WHEN 5 THEN 'ValNode' ELSE 'UnknownKind' END AS node,
        CASE p_partkey % 11 WHEN 0 THEN 'StoreStmt' WHEN 1 THEN 'LoadStmt' WHEN 2 THEN 'AssignStmt' WHEN 3 THEN 'AssignStmt' WHEN 4 THEN 'BranchStmt' WHEN 5 THEN 'UnknownStmt' WHEN 6 THEN 'CmpStmt'
             WHEN 7 THEN 'PhiStmt' WHEN 8 THEN 'BinaryOPStmt' WHEN 9 THEN 'UnaryOPStmt' ELSE 'AddrStmt' END AS statement,
        p_partkey % 7 = 3 AND p_partkey % 2 = 0 AS frees FROM part""")
def c_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of C edges, nodes and statements, and which calls free."""
    key = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    info = F.when(key % 2 == 0, "call void @free(ptr %2)").otherwise("call void @freed(ptr %2)")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", names.edge_kind(pick(_C_EDGES)).alias("edge"), names.node_kind(pick(_C_NODES)).alias("node"), names.statement_type(F.split(pick(_C_STATEMENTS), ",")).alias("statement"),
        classify.is_c_free(info, pick(_C_NODES)).alias("frees"),
    )


_USES = ("Assign((_1, &(*_%)))", "Assign((_1, copy (*_%)))", "Assign((_1, copy _% as usize))", "Assign((_1, copy (*_% as usize", "Assign((_1, copy _%))", "drop(_%) -> bb2", "drop( _% )", "&(*_1) copy (*_%)", "drop(")


@query(f"""SELECT o_orderkey,
        CASE o_orderkey % 9 WHEN 0 THEN 'deref' WHEN 1 THEN 'copy_deref' WHEN 2 THEN 'cast' WHEN 7 THEN 'deref' END AS pattern,
        CASE o_orderkey % 9 WHEN 0 THEN '_' || o_custkey WHEN 1 THEN '_' || o_custkey WHEN 2 THEN '_' || o_custkey WHEN 7 THEN '_1' END AS variable,
        CASE WHEN regexp_matches(x, 'drop\\([^)]*\\)') THEN trim(regexp_extract(x, 'drop\\(([^)]*)\\)', 1)) END AS dropped
    FROM (SELECT o_orderkey, o_custkey, {_texts_sql('o_custkey', 'o_orderkey', _USES)} AS x FROM orders)""")
def use_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first use pattern of a statement's text, and the operand of its drop."""
    x = _texts(F.col("o_custkey"), F.col("o_orderkey"), _USES)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", classify.use_pattern(x).alias("use"), classify.dropped_variable(x).alias("dropped"))
    return orders.select("o_orderkey", "use.pattern", "use.variable", "dropped")


_RVALUES = ("&_%", "move _%", "copy _% as *mut i32 (PtrToPtr)", "copy _% as *const i8 (PtrToPtr)", "Box::new(_%)", "vec::new()", "copy (&(*_%))", "const %", "[move _%, move _2]", "copy _% as usize", None)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 5 THEN CASE l_suppkey % 11
        WHEN 0 THEN CASE WHEN placed THEN 'link' END WHEN 1 THEN CASE WHEN placed THEN 'move' END WHEN 2 THEN CASE WHEN placed THEN 'alias' END WHEN 3 THEN CASE WHEN placed THEN 'alias' END
        WHEN 7 THEN CASE WHEN placed THEN 'set' END WHEN 8 THEN CASE WHEN placed THEN 'set' END WHEN 9 THEN CASE WHEN placed THEN 'set' END END END AS class
    FROM (SELECT *, l_linenumber <> 4 AS placed FROM lineitem)""")
def statement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assignments do: line 4 of an order has no place and line 5 is no assignment."""
    lines, number = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_linenumber")
    kind, place = F.when(number == 5, "StorageLive").otherwise("Assign"), F.when(number != 4, "Local(_1)")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", classify.statement_class(kind, _texts(F.col("l_partkey"), F.col("l_suppkey"), _RVALUES), place).alias("class"))


_CALLED = ("std::boxed::Box::<T%>::into_raw", "std::boxed::Box::<i32>::new", "std::boxed::Box::<T%>::new", "std::boxed::Box::<T%>::from_raw", "std::ffi::CStr::from_raw", "std::ffi::CString::from_raw", "std::mem::drop::<T%>",
           "std::mem::forget::<std::ffi::CString>", "NOT_HANDLED into_raw", "vec::new", "std::ffi::CString::new::<T%>", "f%")


@query("""SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'take' WHEN 3 THEN 'take' WHEN 5 THEN 'take' WHEN 6 THEN 'assign' WHEN 7 THEN 'take' WHEN 8 THEN 'NOT_HANDLED' ELSE '' END AS mark FROM orders""")
def call_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a call does to the markers of its return place and operand."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", classify.call_mark(_texts(F.col("o_custkey"), F.col("o_orderkey"), _CALLED)).alias("mark"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ffi' WHEN o_orderkey % 3 = 0 THEN 'closure' WHEN o_orderkey % 2 = 0 THEN 'internal' ELSE 'external' END AS kind FROM orders""")
def call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    called = F.when(key % 3 == 0, F.concat(F.lit("f::{closure#"), key, F.lit("}"))).otherwise(F.concat(F.lit("f"), key))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", classify.call_target(called, key % 5 == 0, key % 2 == 0).alias("kind"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 3 WHEN 'view' THEN 0 WHEN 'purchase' THEN 9 WHEN 'error' THEN 16 END AS mask, event_type = 'view' AS is_bottom FROM events""")
def lattice_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by name and whether they are the least one."""
    name, event = F.lit(None).cast("string"), F.col("event_type")
    for of, value in (("signup", "ALLOC"), ("click", "MB"), ("view", "BOTTOM"), ("purchase", "MV"), ("error", "FREED")):
        name = F.when(event == of, value).otherwise(name)
    mask = lattice.encode(name)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", mask.alias("mask"), lattice.is_default(mask).alias("is_bottom"))


@query("""WITH cells AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(event_type))) AS alloc FROM events GROUP BY user_id, CAST(ts AS DATE), hour(ts) % 3),
    held AS (SELECT user_id, day, var, min(alloc) AS alloc FROM (SELECT *, unnest(alloc) AS var FROM cells) GROUP BY ALL)
    SELECT user_id::VARCHAR AS program_id, var, array_to_string(min_by(alloc, day), ',') AS alloc FROM held GROUP BY user_id, var""")
def first_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days are nodes, with an alias set for every third hour: each event type's set on the first day that has it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    cells = events.groupBy(F.col("user_id").cast("string").alias("program_id"), "day", (F.hour("ts") % 3).alias("part")).agg(F.array_sort(F.collect_set("event_type")).alias("alloc"))
    state = cells.select("program_id", F.col("day").cast("string").alias("node_id"), F.datediff("day", F.lit("2000-01-01")).alias("seq"), "alloc", F.lit(1).alias("mask"))
    return memory.first_allocation(state, "seq").select("program_id", "var", F.array_join("alloc", ",").alias("alloc"))


@query("""WITH members AS (SELECT DISTINCT l_orderkey, '_' || l_linenumber AS name, l_linenumber % 2 AS root FROM lineitem),
    groups AS (SELECT l_orderkey, root, '{' || string_agg(name, ', ' ORDER BY name) || '}' AS group_key FROM members GROUP BY l_orderkey, root)
    SELECT m.l_orderkey::VARCHAR AS program_id, m.name AS member, g.group_key FROM members m JOIN groups g USING (l_orderkey, root)""")
def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each line of an order, odd and even lines being one each, looked up in the key texts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    members = lines.select(F.col("l_orderkey").cast("string").alias("program_id"), F.concat(F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_linenumber") % 2).cast("string").alias("root")).distinct()
    return detect.group_members(detect.alias_groups(members)).select("program_id", "member", "group_key")
