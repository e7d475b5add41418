"""Spark schemas of the input documents and of the tables that the analysis works on."""

from __future__ import annotations

_ID = "DECIMAL(20,0)"  # C-side ids are unsigned 64-bit numbers

STATEMENT = "STRUCT<source_info:STRUCT<span:STRING,scope:STRING>,kind:STRING,details:STRING,place:STRING,is_mutable:BOOLEAN,rvalue:STRING>"

TERMINATOR = (
    "STRUCT<kind:STRING,details:STRING,source_info:STRING,target:STRING,targets:ARRAY<STRING>,discr:STRING,otherwise:STRING,"
    "return_target:STRING,unwind_target:STRING,dropped_value:STRING,is_mutable:BOOLEAN,function_called:STRING,"
    "arguments:ARRAY<STRUCT<arg:STRING,is_mutable:BOOLEAN>>,return_place:STRING,cond:STRING,expected:BOOLEAN,msg:STRING,"
    "template:ARRAY<STRING>,operands:ARRAY<STRING>,options:STRING,line_spans:ARRAY<STRING>>"
)

BLOCK = f"STRUCT<block_id:INT,statements:ARRAY<{STATEMENT}>,terminator:{TERMINATOR}>"

DUMMY = "STRUCT<dummy_node_name:STRING,incoming_edge:STRING,outgoing_edge:STRING,id:STRING,mir_var:STRING,llvm_var:STRING,is_internal:BOOLEAN>"

C_STATEMENT = (
    f"STRUCT<stmt_id:{_ID},stmt_type:STRING,stmt_info:STRING,edge_id:{_ID},pta_edge:BOOLEAN,lhs_var_id:{_ID},rhs_var_id:{_ID},"
    f"res_var_id:{_ID},operand_var_ids:ARRAY<{_ID}>,call_inst:STRING,is_conditional:BOOLEAN,condition_var_id:{_ID},"
    f"successors:ARRAY<STRUCT<successor_id:{_ID},condition_value:BIGINT>>>"
)

C_EDGE = f"STRUCT<source:{_ID},destination:{_ID},edge_type:STRING>"

C_NODE = (
    f"STRUCT<node_id:{_ID},node_type:BOOLEAN,info:STRING,node_kind_string:STRING,node_kind:INT,node_source_loc:STRING,"
    f"function_name:STRING,basic_block:{_ID},basic_block_name:STRING,basic_block_info:STRING,svf_statements:ARRAY<{C_STATEMENT}>,"
    f"incoming_edges:ARRAY<{C_EDGE}>,outgoing_edges:ARRAY<{C_EDGE}>>"
)

C_GRAPH = f"nodes ARRAY<{C_NODE}>, edges ARRAY<{C_EDGE}>"

GRAPH_EDGE = "STRUCT<source:STRING,destination:STRING,label:STRING,source_label:STRING,destination_label:STRING>"

#: Nodes of the global graph, in list order.
NODES = f"program_id STRING, seq INT, node_id STRING, node_type STRING, mir {BLOCK}, llvm {C_NODE}, dummy {DUMMY}"

EDGES = "program_id STRING, pos INT, source STRING, destination STRING, label STRING, source_label STRING, destination_label STRING"

#: One block of one function.
BLOCKS = f"program_id STRING, function STRING, block_id INT, statements ARRAY<{STATEMENT}>, terminator {TERMINATOR}"

#: One C graph node in the order of its file.
C_NODES = f"program_id STRING, function STRING, pos BIGINT, node {C_NODE}"

C_EDGES = f"program_id STRING, source {_ID}, destination {_ID}, edge_type STRING"
