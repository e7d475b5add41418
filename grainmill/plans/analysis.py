"""The whole analysis: graph tables to fixpoint, findings, warnings and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from grainmill.operators.detect import detect
from grainmill.operators.fixpoint import ENTRY, fixpoint
from grainmill.operators.graph import build_graph
from grainmill.plans.lineage import written
from grainmill.sources import readers, sinks


@dataclass(frozen=True)
class Analysis:
    """Tables of an analysed set of programs."""

    nodes: DataFrame
    edges: DataFrame
    state: DataFrame
    findings: DataFrame
    warnings: DataFrame
    report: DataFrame


def analyze(nodes: DataFrame, edges: DataFrame, entry: str = ENTRY, match_scope: str = "details", most_visits: int | None = None) -> Analysis:
    """Analyses every program of the graph tables.

    ``entry`` is the node the fixpoint starts from; ``match_scope`` is explained
    at ``call_class``; a program that needs more than ``most_visits`` visits
    (unset: far more than it has nodes) is an error.
    """
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    state = written(fixpoint(nodes, edges, entry, match_scope, most_visits), "fixpoint")
    findings, warnings = detect(nodes, edges, state)
    return Analysis(nodes, edges, state, findings, warnings, sinks.report_lines(findings, warnings, nodes))


def analyze_graph_files(spark: SparkSession, path: str, entry: str = ENTRY) -> Analysis:
    """Analyses the global graph documents at a path."""
    return analyze(*readers.read_graph(spark, path), entry=entry)


def analyze_program_tables(blocks: DataFrame, ffi: DataFrame, c_nodes: DataFrame | None = None, c_edges: DataFrame | None = None, entry: str = ENTRY) -> Analysis:
    """Builds the graphs from block and C tables and analyses them."""
    return analyze(*build_graph(blocks, ffi, c_nodes, c_edges), entry=entry)
