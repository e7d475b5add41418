"""Naming grammar of the program graphs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_local(name: Column) -> Column:
    """``Local(_1) [mutable]`` and ``_1`` as ``Local(_1)``: cut at the first space, or wrapped."""
    return F.when(name.startswith("Local("), F.substring_index(name, " ", 1)).otherwise(F.concat(F.lit("Local("), name, F.lit(")")))


def return_local(name: Column) -> Column:
    """``Local _0`` as ``Local(_0)``; of other names the leading underscores go, so ``_5`` is ``Local(5)``."""
    bare = F.when(name.startswith("Local "), F.trim(F.substr(name, F.lit(7)))).otherwise(F.regexp_replace(name, "^_+", ""))
    return F.concat(F.lit("Local("), bare, F.lit(")"))


def trimmed(name: Column) -> Column:
    """Without quotes and white space at both ends; ``[mutable]`` stays."""
    return F.regexp_replace(name, r'^["\s]+|["\s]+$', "")


def _after(word: str, text: Column) -> Column:
    """The first token after the first ``word``, less closing parentheses at its end; empty if there is none."""
    token = F.regexp_extract(text, rf"(?s)^.*?{word} [ \t\n\r]*([^ \t\n\r]*)", 1)
    return F.regexp_replace(token, r"\)+$", "")


def moved(text: Column) -> Column:
    """The operand after the first ``move``, up to the second one."""
    return _after("move", F.concat(F.substring_index(text, "move ", 2)))


def copied(text: Column) -> Column:
    """The operand after the first ``copy``, up to the second one."""
    return _after("copy", F.substring_index(text, "copy ", 2))


def argument_name(text: Column) -> Column:
    """The text in the first parentheses, or all of it."""
    found = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    return F.when(text.rlike(r"\(([^)]*)\)"), found).otherwise(text)


def argument_value(text: Column) -> Column:
    """The quoted value after ``"arg":``; null without one."""
    return F.nullif(F.regexp_extract(text, r'"arg":[^"]*"([^"]*)"', 1), F.lit(""))


def span_line(span: Column) -> Column:
    """The line number of a ``path:line:column: line:column (#n)`` span, null where it has none."""
    parts = F.split(span, ":")
    return F.when(F.size(parts) >= 4, F.split_part(span, F.lit(":"), F.lit(-4)).try_cast("bigint"))


def clean_target(target: Column) -> Column:
    """``cleanup(bb4)`` as ``bb4``; other targets as they are."""
    return F.regexp_replace(target, r"^cleanup\((.*)\)$", "$1")


def unwind_text(kind: Column, block: Column) -> Column:
    """An unwind action as text: continue, unreachable, terminate or cleanup(block)."""
    return F.when(kind == "cleanup", F.concat(F.lit("cleanup("), block, F.lit(")"))).otherwise(kind)


def unwinds(target: Column) -> Column:
    """Whether an unwind target makes an edge."""
    return ~clean_target(target).isin("unreachable", "continue")


def place_parts(place: Column) -> Column:
    """(local, is_mutable, projection) of a place text ``Local(_1) [mutable] -> field``."""
    rest = F.regexp_extract(place, r"(?s) -> (.*)$", 1)
    return F.struct(F.substring_index(place, " ", 1).alias("local"), place.contains(" [mutable]").alias("is_mutable"), F.nullif(rest, F.lit("")).alias("projection"))


def hash_id(*parts: Column) -> Column:
    """A 64-bit id in hexadecimal; its role matters, not its value."""
    return F.lower(F.hex(F.xxhash64(*parts)))


def mir_node(function: Column, block: Column) -> Column:
    """``rust::main::bb3`` of a function and a block number."""
    return F.concat(F.lit("rust::"), function, F.lit("::bb"), block.cast("string"))


def c_node(function: Column, node: Column, site: Column) -> Column:
    """The copy of a C node for one call site."""
    return F.concat(F.lit("llvm::"), function, F.lit("::node"), node.cast("string"), F.lit("::"), site)


def dummy_node(kind: str, function: Column, place: Column, site: Column, internal: bool) -> Column:
    return F.concat(F.lit(f"{kind}::rust::"), function, F.lit("::"), place, F.lit("::"), site, F.lit("_internal" if internal else ""))


def edge_kind(enumerator: Column) -> Column:
    """Short names of the C edge kinds."""
    return F.when(enumerator == "IntraCF", "intra").when(enumerator == "CallCF", "call").when(enumerator == "RetCF", "ret").otherwise("unknown")


# Node kinds and statement types of the C graphs.
NODE_KINDS = ("IntraBlock", "FunEntryBlock", "FunExitBlock", "FunCallBlock", "FunRetBlock", "ValNode")
STATEMENT_TYPES = ("StoreStmt", "CmpStmt", "PhiStmt", "BinaryOPStmt", "UnaryOPStmt", "LoadStmt", "AddrStmt", "AssignStmt", "CallPE", "BranchStmt")


def node_kind(enumerator: Column) -> Column:
    """The kind of a C node, UnknownKind for any other."""
    return F.when(enumerator.isin(*NODE_KINDS), enumerator).otherwise("UnknownKind")


def statement_type(classes: Column) -> Column:
    """The first of the known types that the array of a statement's classes holds, else UnknownStmt."""
    found = F.lit("UnknownStmt")
    for name in reversed(STATEMENT_TYPES):
        found = F.when(F.array_contains(classes, name), name).otherwise(found)
    return found
