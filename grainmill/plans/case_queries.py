"""What comes of the case programs, as queries over all customers; the SQL holds the worked-out rows of each case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import lattice
from grainmill.operators.detect import detect
from grainmill.operators.fixpoint import fixpoint
from grainmill.plans.cases import case_graph
from grainmill.plans.lineage import written
from grainmill.plans.queries import query
from grainmill.sources import sinks

_STATES = r"""
    (0, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (0, 'rust::main::bb1', 'Local(_1)', 'ALLOC'), (0, 'rust::main::bb2', 'Local(_9)', 'MV'), (0, 'rust::main::bb3', 'Local(_9)', 'MV'), (0, 'rust::main::bb4', 'Local(_1)', 'FREED'),
    (0, 'rust::main::bb5', 'Local(_1)', 'FREED'), (0, 'rust::main::terminate', 'Local(_1)', 'FREED'), (1, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (1, 'rust::main::bb1', 'Local(_1)', 'ALLOC'),
    (1, 'rust::main::bb2', 'Local(_9)', 'MV'), (1, 'rust::main::bb3', 'Local(_9)', 'MV'), (1, 'rust::main::bb4', 'Local(_1)', 'FREED'), (1, 'rust::main::bb5', 'Local(_1)', 'FREED'), (2, 'rust::main::bb0', 'Local(_1)', 'ALLOC'),
    (2, 'rust::main::bb1', 'Local(_2)', 'MV'), (2, 'rust::main::bb2', 'Local(_2),Local(_3)', 'MV'), (2, 'rust::main::bb3', 'Local(_2),Local(_3),Local(_4)', 'MV'), (2, 'rust::main::bb4', 'Local(_2),Local(_3),Local(_4)', 'FREED'),
    (2, 'rust::main::bb5', 'Local(_2),Local(_3),Local(_4)', 'FREED'), (2, 'rust::main::bb6', 'Local(_2),Local(_3),Local(_4)', 'FREED'), (2, 'rust::main::terminate', 'Local(_2),Local(_3),Local(_4)', 'FREED'),
    (3, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (3, 'rust::main::bb1', 'Local(_2)', 'MV'), (3, 'rust::main::bb2', 'Local(_2),Local(_3)', 'MV'), (3, 'rust::main::bb3', 'Local(_2),Local(_3)', 'FREED'),
    (3, 'rust::main::bb4', 'Local(_2),Local(_3)', 'FREED'), (3, 'rust::main::terminate', 'Local(_2),Local(_3)', 'FREED'), (4, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (4, 'rust::main::bb1', 'Local(_2)', 'MV'),
    (4, 'rust::main::bb2', 'Local(_2),Local(_3)', 'MV'), (4, 'rust::main::bb3', 'Local(_2),Local(_3)', 'FREED'), (4, 'rust::main::bb4', 'Local(_2),Local(_3)', 'FREED'), (4, 'rust::main::terminate', 'Local(_2),Local(_3)', 'FREED'),
    (5, 'dummyCall::rust::main::bb1::rust::main::bb1_internal', 'Local(_1)', 'ALLOC'), (5, 'dummyRet::rust::main::1::rust::main::bb1_internal', 'Local(_1)', 'ALLOC'), (5, 'rust::main::bb0', 'Local(_1)', 'ALLOC'),
    (5, 'rust::main::bb1', 'Local(_1)', 'ALLOC'), (5, 'rust::main::bb2', 'Local(_1)', 'ALLOC'), (7, 'dummyCall::rust::main::bb2::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'dummyCall::rust::main::bb3::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'dummyRet::rust::main::bb3::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'dummyRet::rust::main::bb4::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'llvm::give::node1::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'llvm::give::node1::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'llvm::give::node2::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'llvm::give::node2::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'llvm::give::node3::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'llvm::give::node3::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'llvm::give::node4::rust::main::bb2', '10@rust::main::bb2,Local(_2)', 'MV'),
    (7, 'llvm::give::node4::rust::main::bb3', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'), (7, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (7, 'rust::main::bb1', 'Local(_2)', 'MV'),
    (7, 'rust::main::bb2', 'Local(_2)', 'MV'), (7, 'rust::main::bb3', '10@rust::main::bb2,Local(_2)', 'MV'), (7, 'rust::main::bb4', '10@rust::main::bb2,10@rust::main::bb3,Local(_2)', 'MV'),
    (8, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (8, 'rust::main::bb1', 'Local(_1),Local(_2),Local(_3)', 'ALLOC'), (8, 'rust::main::bb2', 'Local(_1),Local(_2),Local(_4)', 'ALLOC'),
    (8, 'rust::main::bb3', 'Local(_1),Local(_2),Local(_4)', 'ALLOC'), (9, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (9, 'rust::main::bb1', 'Local(_2)', 'MV'), (9, 'rust::main::bb2', 'Local(_2)', 'MV'),
    (9, 'rust::main::bb2', 'Local(_3)', 'ALLOC'), (9, 'rust::main::bb3', 'Local(_2),Local(_4)', 'FREED'), (9, 'rust::main::bb3', 'Local(_3)', 'FREED'), (9, 'rust::main::bb4', 'Local(_2),Local(_4)', 'FREED'),
    (9, 'rust::main::bb4', 'Local(_3)', 'FREED'), (10, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (10, 'rust::main::bb1', 'Local(_2)', 'MV'), (10, 'rust::main::bb2', 'Local(_3)', 'MV'),
    (10, 'rust::main::bb3', 'Local(_3),Local(_4)', 'MV'), (10, 'rust::main::bb4', 'Local(_3),Local(_4)', 'FREED'), (10, 'rust::main::bb5', 'Local(_3),Local(_4)', 'FREED'),
    (10, 'rust::main::terminate', 'Local(_3),Local(_4)', 'FREED'), (11, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (11, 'rust::main::bb1', 'Local(_3)', 'MV'), (11, 'rust::main::bb2', 'Local(_3)', 'MV'),
    (11, 'rust::main::bb2', 'Local(_4)', 'FREED'), (11, 'rust::main::bb3', 'Local(_3)', 'MV'), (11, 'rust::main::bb3', 'Local(_4)', 'FREED'), (11, 'rust::main::terminate', 'Local(_3)', 'MV'),
    (11, 'rust::main::terminate', 'Local(_4)', 'FREED'), (12, 'rust::main::bb0', 'Local(_1)', 'ALLOC'), (12, 'rust::main::bb1', 'Local(_1)', 'ALLOC'), (12, 'rust::main::bb2', 'Local(_1)', 'FREED'),
    (12, 'rust::main::bb3', 'Local(_1)', 'ALLOC'), (12, 'rust::main::bb4', 'Local(_1)', 'TOP'), (12, 'rust::main::bb5', 'Local(_3)', 'MV'), (12, 'rust::main::bb6', 'Local(_3)', 'MV')"""

_VISITS = r"""
    (0, 0, 'rust::main::bb0'), (0, 1, 'rust::main::bb1'), (0, 2, 'rust::main::bb2'), (0, 3, 'rust::main::bb3'), (0, 4, 'rust::main::bb4'), (0, 5, 'rust::main::bb5'), (0, 6, 'rust::main::terminate'), (1, 0, 'rust::main::bb0'),
    (1, 1, 'rust::main::bb1'), (1, 2, 'rust::main::bb2'), (1, 3, 'rust::main::bb3'), (1, 4, 'rust::main::bb4'), (1, 5, 'rust::main::bb5'), (2, 0, 'rust::main::bb0'), (2, 1, 'rust::main::bb1'), (2, 2, 'rust::main::bb2'),
    (2, 3, 'rust::main::bb3'), (2, 4, 'rust::main::bb4'), (2, 5, 'rust::main::bb5'), (2, 6, 'rust::main::bb6'), (2, 7, 'rust::main::terminate'), (3, 0, 'rust::main::bb0'), (3, 1, 'rust::main::bb1'), (3, 2, 'rust::main::bb2'),
    (3, 3, 'rust::main::bb3'), (3, 4, 'rust::main::bb4'), (3, 5, 'rust::main::terminate'), (4, 0, 'rust::main::bb0'), (4, 1, 'rust::main::bb1'), (4, 2, 'rust::main::bb2'), (4, 3, 'rust::main::bb3'), (4, 4, 'rust::main::bb4'),
    (4, 5, 'rust::main::terminate'), (5, 0, 'rust::main::bb0'), (5, 1, 'rust::main::bb1'), (5, 2, 'dummyCall::rust::main::bb1::rust::main::bb1_internal'), (5, 3, 'dummyRet::rust::main::1::rust::main::bb1_internal'),
    (5, 4, 'rust::helper::bb0'), (5, 5, 'rust::helper::bb1'), (5, 6, 'dummyRet::rust::main::1::rust::main::bb1_internal'), (5, 7, 'rust::main::bb2'), (6, 0, 'rust::main::bb0'),
    (6, 1, 'dummyCall::rust::main::bb0::rust::main::bb0_internal'), (6, 2, 'rust::main::{closure#0}::bb0'), (6, 3, 'rust::main::{closure#0}::bb1'), (6, 4, 'rust::main::{closure#0}::bb2'),
    (6, 5, 'dummyRet::rust::main::_2::rust::main::bb0_internal'), (6, 6, 'rust::main::bb1'), (7, 0, 'rust::main::bb0'), (7, 1, 'rust::main::bb1'), (7, 2, 'rust::main::bb2'), (7, 3, 'dummyCall::rust::main::bb2::rust::main::bb2'),
    (7, 4, 'llvm::give::node1::rust::main::bb2'), (7, 5, 'llvm::give::node2::rust::main::bb2'), (7, 6, 'llvm::give::node3::rust::main::bb2'), (7, 7, 'llvm::give::node4::rust::main::bb2'),
    (7, 8, 'dummyRet::rust::main::bb3::rust::main::bb2'), (7, 9, 'rust::main::bb3'), (7, 10, 'dummyCall::rust::main::bb3::rust::main::bb3'), (7, 11, 'llvm::give::node1::rust::main::bb3'),
    (7, 12, 'llvm::give::node2::rust::main::bb3'), (7, 13, 'llvm::give::node3::rust::main::bb3'), (7, 14, 'llvm::give::node4::rust::main::bb3'), (7, 15, 'dummyRet::rust::main::bb4::rust::main::bb3'), (7, 16, 'rust::main::bb4'),
    (8, 0, 'rust::main::bb0'), (8, 1, 'rust::main::bb1'), (8, 2, 'rust::main::bb2'), (8, 3, 'rust::main::bb3'), (9, 0, 'rust::main::bb0'), (9, 1, 'rust::main::bb1'), (9, 2, 'rust::main::bb2'), (9, 3, 'rust::main::bb3'),
    (9, 4, 'rust::main::bb4'), (10, 0, 'rust::main::bb0'), (10, 1, 'rust::main::bb1'), (10, 2, 'rust::main::bb2'), (10, 3, 'rust::main::bb3'), (10, 4, 'rust::main::bb4'), (10, 5, 'rust::main::bb5'),
    (10, 6, 'rust::main::terminate'), (11, 0, 'rust::main::bb0'), (11, 1, 'rust::main::bb1'), (11, 2, 'rust::main::bb2'), (11, 3, 'rust::main::bb3'), (11, 4, 'rust::main::terminate'), (12, 0, 'rust::main::bb0'),
    (12, 1, 'rust::main::bb1'), (12, 2, 'rust::main::bb2'), (12, 3, 'rust::main::bb3'), (12, 4, 'rust::main::bb4'), (12, 5, 'rust::main::bb5'), (12, 6, 'rust::main::bb6')"""

_MARKERS = r"""
    (0, 'rust::main::bb2', 'Local(_9)', 'assign'), (0, 'rust::main::bb3', 'Local(_9)', 'assign'), (0, 'rust::main::bb4', 'Local(_1)', 'free'), (0, 'rust::main::bb5', 'Local(_1)', 'free'),
    (0, 'rust::main::terminate', 'Local(_1)', 'free'), (1, 'rust::main::bb2', 'Local(_9)', 'assign'), (1, 'rust::main::bb3', 'Local(_9)', 'assign'), (1, 'rust::main::bb4', 'Local(_1)', 'free'),
    (1, 'rust::main::bb5', 'Local(_1)', 'free'), (2, 'rust::main::bb1', 'Local(_2)', 'assign'), (2, 'rust::main::bb2', 'Local(_2)', 'assign'), (2, 'rust::main::bb2', 'Local(_3)', 'assign'),
    (2, 'rust::main::bb3', 'Local(_2)', 'assign'), (2, 'rust::main::bb3', 'Local(_3)', 'assign'), (2, 'rust::main::bb3', 'Local(_4)', 'assign'), (2, 'rust::main::bb4', 'Local(_2)', 'free'),
    (2, 'rust::main::bb4', 'Local(_3)', 'free'), (2, 'rust::main::bb4', 'Local(_4)', 'free'), (2, 'rust::main::bb5', 'Local(_2)', 'free'), (2, 'rust::main::bb5', 'Local(_3)', 'free'), (2, 'rust::main::bb5', 'Local(_4)', 'free'),
    (2, 'rust::main::bb6', 'Local(_2)', 'free'), (2, 'rust::main::bb6', 'Local(_3)', 'free'), (2, 'rust::main::bb6', 'Local(_4)', 'free'), (2, 'rust::main::terminate', 'Local(_2)', 'free'),
    (2, 'rust::main::terminate', 'Local(_3)', 'free'), (2, 'rust::main::terminate', 'Local(_4)', 'free'), (3, 'rust::main::bb1', 'Local(_2)', 'assign'), (3, 'rust::main::bb2', 'Local(_2)', 'assign'),
    (3, 'rust::main::bb2', 'Local(_3)', 'assign'), (3, 'rust::main::bb3', 'Local(_2)', 'free'), (3, 'rust::main::bb3', 'Local(_3)', 'free'), (3, 'rust::main::bb4', 'Local(_2)', 'free'), (3, 'rust::main::bb4', 'Local(_3)', 'free'),
    (3, 'rust::main::terminate', 'Local(_2)', 'free'), (3, 'rust::main::terminate', 'Local(_3)', 'free'), (4, 'rust::main::bb1', 'Local(_2)', 'assign'), (4, 'rust::main::bb2', 'Local(_2)', 'assign'),
    (4, 'rust::main::bb2', 'Local(_3)', 'assign'), (4, 'rust::main::bb3', 'Local(_2)', 'free'), (4, 'rust::main::bb3', 'Local(_3)', 'free'), (4, 'rust::main::bb4', 'Local(_2)', 'free'), (4, 'rust::main::bb4', 'Local(_3)', 'free'),
    (4, 'rust::main::terminate', 'Local(_2)', 'free'), (4, 'rust::main::terminate', 'Local(_3)', 'free'), (7, 'dummyCall::rust::main::bb2::rust::main::bb2', '10@rust::main::bb2', 'assign'),
    (7, 'dummyCall::rust::main::bb2::rust::main::bb2', 'Local(_2)', 'assign'), (7, 'dummyCall::rust::main::bb3::rust::main::bb3', '10@rust::main::bb2', 'assign'),
    (7, 'dummyCall::rust::main::bb3::rust::main::bb3', '10@rust::main::bb3', 'assign'), (7, 'dummyCall::rust::main::bb3::rust::main::bb3', 'Local(_2)', 'assign'),
    (7, 'dummyRet::rust::main::bb3::rust::main::bb2', '10@rust::main::bb2', 'assign'), (7, 'dummyRet::rust::main::bb3::rust::main::bb2', 'Local(_2)', 'assign'),
    (7, 'dummyRet::rust::main::bb4::rust::main::bb3', '10@rust::main::bb2', 'assign'), (7, 'dummyRet::rust::main::bb4::rust::main::bb3', '10@rust::main::bb3', 'assign'),
    (7, 'dummyRet::rust::main::bb4::rust::main::bb3', 'Local(_2)', 'assign'), (7, 'llvm::give::node1::rust::main::bb2', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node1::rust::main::bb2', 'Local(_2)', 'assign'),
    (7, 'llvm::give::node1::rust::main::bb3', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node1::rust::main::bb3', '10@rust::main::bb3', 'assign'), (7, 'llvm::give::node1::rust::main::bb3', 'Local(_2)', 'assign'),
    (7, 'llvm::give::node2::rust::main::bb2', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node2::rust::main::bb2', 'Local(_2)', 'assign'), (7, 'llvm::give::node2::rust::main::bb3', '10@rust::main::bb2', 'assign'),
    (7, 'llvm::give::node2::rust::main::bb3', '10@rust::main::bb3', 'assign'), (7, 'llvm::give::node2::rust::main::bb3', 'Local(_2)', 'assign'), (7, 'llvm::give::node3::rust::main::bb2', '10@rust::main::bb2', 'assign'),
    (7, 'llvm::give::node3::rust::main::bb2', 'Local(_2)', 'assign'), (7, 'llvm::give::node3::rust::main::bb3', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node3::rust::main::bb3', '10@rust::main::bb3', 'assign'),
    (7, 'llvm::give::node3::rust::main::bb3', 'Local(_2)', 'assign'), (7, 'llvm::give::node4::rust::main::bb2', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node4::rust::main::bb2', 'Local(_2)', 'assign'),
    (7, 'llvm::give::node4::rust::main::bb3', '10@rust::main::bb2', 'assign'), (7, 'llvm::give::node4::rust::main::bb3', '10@rust::main::bb3', 'assign'), (7, 'llvm::give::node4::rust::main::bb3', 'Local(_2)', 'assign'),
    (7, 'rust::main::bb1', 'Local(_2)', 'assign'), (7, 'rust::main::bb2', 'Local(_2)', 'assign'), (7, 'rust::main::bb3', '10@rust::main::bb2', 'assign'), (7, 'rust::main::bb3', 'Local(_2)', 'assign'),
    (7, 'rust::main::bb4', '10@rust::main::bb2', 'assign'), (7, 'rust::main::bb4', '10@rust::main::bb3', 'assign'), (7, 'rust::main::bb4', 'Local(_2)', 'assign'), (9, 'rust::main::bb1', 'Local(_2)', 'assign'),
    (9, 'rust::main::bb2', 'Local(_2)', 'assign'), (9, 'rust::main::bb3', 'Local(_2)', 'free'), (9, 'rust::main::bb3', 'Local(_3)', 'free'), (9, 'rust::main::bb3', 'Local(_4)', 'free'), (9, 'rust::main::bb4', 'Local(_2)', 'free'),
    (9, 'rust::main::bb4', 'Local(_3)', 'free'), (9, 'rust::main::bb4', 'Local(_4)', 'free'), (10, 'rust::main::bb1', 'Local(_2)', 'assign'), (10, 'rust::main::bb2', 'Local(_3)', 'assign'),
    (10, 'rust::main::bb3', 'Local(_3)', 'assign'), (10, 'rust::main::bb3', 'Local(_4)', 'assign'), (10, 'rust::main::bb4', 'Local(_3)', 'free'), (10, 'rust::main::bb4', 'Local(_4)', 'free'),
    (10, 'rust::main::bb5', 'Local(_3)', 'free'), (10, 'rust::main::bb5', 'Local(_4)', 'free'), (10, 'rust::main::terminate', 'Local(_3)', 'free'), (10, 'rust::main::terminate', 'Local(_4)', 'free'),
    (11, 'rust::main::bb1', 'Local(_3)', 'assign'), (11, 'rust::main::bb2', 'Local(_3)', 'assign'), (11, 'rust::main::bb2', 'Local(_4)', 'free'), (11, 'rust::main::bb3', 'Local(_3)', 'assign'),
    (11, 'rust::main::bb3', 'Local(_4)', 'free'), (11, 'rust::main::terminate', 'Local(_3)', 'assign'), (11, 'rust::main::terminate', 'Local(_4)', 'free'), (12, 'rust::main::bb2', 'Local(_1)', 'free'),
    (12, 'rust::main::bb5', 'Local(_3)', 'assign'), (12, 'rust::main::bb6', 'Local(_3)', 'assign')"""

_FINDINGS = r"""
    (0, '{Local(_9)}', 0, false, NULL, NULL, NULL, false, true, false), (2, '{Local(_2), Local(_3), Local(_4), _3, _4}', 2, false, NULL, 'src/main.rs:12:1: 12:2 (#0)', 'Drop', true, false, false),
    (3, '{Local(_2), Local(_3), _3}', 1, true, 'src/main.rs:12:5: 12:9 (#0)', 'src/main.rs:10:1: 10:2 (#0)', 'Drop', false, false, true),
    (4, '{Local(_2), Local(_3), _3}', 1, false, NULL, 'src/main.rs:10:1: 10:2 (#0)', 'Drop', false, false, false),
    (7, '{10@rust::main::bb2, 10@rust::main::bb3, Local(_2)}', 2, false, NULL, 'CallICFGNode: call void @free(ptr noundef %2) ', 'LLVM', true, false, false), (9, '{Local(_2)}', 0, false, NULL, NULL, NULL, false, true, false),
    (9, '{Local(_3)}', 1, false, NULL, 'src/main.rs:9:5: 9:9 (#0)', 'Drop', false, false, false), (10, '{Local(_2)}', 0, false, NULL, NULL, NULL, false, true, false),
    (10, '{Local(_3), Local(_4), _4}', 1, false, NULL, 'src/main.rs:7:1: 7:2 (#0)', 'Drop', false, false, false), (11, '{Local(_3)}', 0, true, 'src/main.rs:3:5: 3:9 (#0)', NULL, NULL, false, true, false),
    (11, '{Local(_4), Local(__3)}', 1, true, 'src/main.rs:8:5: 8:9 (#0)', 'src/main.rs:5:1: 5:2 (#0)', 'Drop', false, false, true), (12, '{Local(_3)}', 0, false, NULL, NULL, NULL, false, true, false)"""

_WARNINGS = r"""
    (7, 0, '10@rust::main::bb2', 'CallICFGNode: call void @free(ptr noundef %2) '), (7, 1, '10@rust::main::bb3', 'CallICFGNode: call void @free(ptr noundef %2) ')"""

_REPORT = r"""
    (0, 1, repeat('⬦', 38)), (0, 2, '🤖💬 Potential memory issues detected 🚀:'), (0, 3, '☢ Never Free Issues ☢: {"{Local(_9)}": 1}'), (0, 4, repeat('⬦', 38)),
    (1, 1, repeat('⬦', 38)), (1, 2, '🤖💬 NO Issues detected: ✅'), (1, 3, repeat('⬦', 38)), (2, 1, repeat('⬦', 38)),
    (2, 2, '🤖💬 Potential memory issues detected 🚀:'), (2, 3, '☢ Double Free Issues ☢:'), (2, 4, 'Free detected at source line: src/main.rs:12:1: 12:2 (#0)'), (2, 5, repeat('⬦', 38)),
    (3, 1, repeat('⬦', 38)), (3, 2, '🤖💬 Potential memory issues detected 🚀:'), (3, 3, '☢ Use-After-Free Issues / Undefined behaviour ☢:'), (3, 4, 'Use detected at source line: src/main.rs:12:5: 12:9 (#0)'),
    (3, 5, repeat('⬦', 38)), (4, 1, repeat('⬦', 38)), (4, 2, '🤖💬 NO Issues detected: ✅'), (4, 3, repeat('⬦', 38)),
    (5, 1, repeat('⬦', 38)), (5, 2, '🤖💬 NO Issues detected: ✅'), (5, 3, repeat('⬦', 38)), (6, 1, repeat('⬦', 38)), (6, 2, '🤖💬 NO Issues detected: ✅'),
    (6, 3, repeat('⬦', 38)), (7, 1, repeat('⬦', 38)), (7, 2, '🤖💬 Potential memory issues detected 🚀:'), (7, 3, '☢ Double Free Issues ☢:'),
    (7, 4, 'Free detected at source line: CallICFGNode: call void @free(ptr noundef %2) '), (7, 5, repeat('⬦', 38)),
    (7, 6, 'Warning: 10@rust::main::bb2 is freed in C: CallICFGNode: call void @free(ptr noundef %2) '), (7, 7, 'Warning: 10@rust::main::bb3 is freed in C: CallICFGNode: call void @free(ptr noundef %2) '),
    (8, 1, repeat('⬦', 38)), (8, 2, '🤖💬 NO Issues detected: ✅'), (8, 3, repeat('⬦', 38)), (9, 1, repeat('⬦', 38)),
    (9, 2, '🤖💬 Potential memory issues detected 🚀:'), (9, 3, '☢ Never Free Issues ☢: {"{Local(_2)}": 1}'), (9, 4, repeat('⬦', 38)), (10, 1, repeat('⬦', 38)),
    (10, 2, '🤖💬 Potential memory issues detected 🚀:'), (10, 3, '☢ Never Free Issues ☢: {"{Local(_2)}": 1}'), (10, 4, repeat('⬦', 38)), (11, 1, repeat('⬦', 38)),
    (11, 2, '🤖💬 Potential memory issues detected 🚀:'), (11, 3, '☢ Use-After-Free Issues / Undefined behaviour ☢:'), (11, 4, 'Use detected at source line: src/main.rs:3:5: 3:9 (#0)'),
    (11, 5, 'Use detected at source line: src/main.rs:8:5: 8:9 (#0)'), (11, 6, '{"{Local(_4), Local(__3)}": 1}'), (11, 7, '☢ Never Free Issues ☢:'), (11, 8, '{"{Local(_3)}": 1}'), (11, 9, repeat('⬦', 38)),
    (12, 1, repeat('⬦', 38)), (12, 2, '🤖💬 Potential memory issues detected 🚀:'), (12, 3, '☢ Never Free Issues ☢: {"{Local(_3)}": 1}'), (12, 4, repeat('⬦', 38))"""

_EDGES = r"""
    (0, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (0, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (0, 2, 'rust::main::bb1', 'rust::main::bb4', 'Call unwind'),
    (0, 3, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'), (0, 4, 'rust::main::bb4', 'rust::main::bb5', 'Drop return'), (0, 5, 'rust::main::bb4', 'rust::main::terminate', 'Drop unwind'),
    (1, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (1, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (1, 2, 'rust::main::bb1', 'rust::main::bb4', 'Call unwind'),
    (1, 3, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'), (1, 4, 'rust::main::bb4', 'rust::main::bb5', 'Drop return'), (2, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'),
    (2, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (2, 2, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'), (2, 3, 'rust::main::bb3', 'rust::main::bb4', 'Call return (fallback)'),
    (2, 4, 'rust::main::bb4', 'rust::main::bb5', 'Drop return'), (2, 5, 'rust::main::bb5', 'rust::main::bb6', 'Drop return'), (2, 6, 'rust::main::bb5', 'rust::main::terminate', 'Drop unwind'),
    (3, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (3, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (3, 2, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'),
    (3, 3, 'rust::main::bb3', 'rust::main::bb4', 'Drop return'), (3, 4, 'rust::main::bb3', 'rust::main::terminate', 'Drop unwind'), (4, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'),
    (4, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (4, 2, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'), (4, 3, 'rust::main::bb3', 'rust::main::bb4', 'Drop return'),
    (4, 4, 'rust::main::bb3', 'rust::main::terminate', 'Drop unwind'), (5, 0, 'rust::helper::bb0', 'rust::helper::bb1', 'Goto'), (5, 1, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'),
    (5, 2, 'rust::main::bb1', 'dummyCall::rust::main::bb1::rust::main::bb1_internal', 'Internal Call (dummy inserted)'),
    (5, 3, 'dummyCall::rust::main::bb1::rust::main::bb1_internal', 'dummyRet::rust::main::1::rust::main::bb1_internal', 'dummyCall->dummyRet'),
    (5, 4, 'dummyRet::rust::main::1::rust::main::bb1_internal', 'rust::main::bb2', 'dummyRet->Internal Return'), (6, 0, 'rust::main::bb0', 'dummyCall::rust::main::bb0::rust::main::bb0_internal', 'Closure Call (dummy inserted)'),
    (6, 1, 'dummyCall::rust::main::bb0::rust::main::bb0_internal', 'rust::main::{closure#0}::bb0', 'dummyCall->ClosureEntry'), (6, 2, 'rust::main::{closure#0}::bb0', 'rust::main::{closure#0}::bb1', 'Call return (fallback)'),
    (6, 3, 'rust::main::{closure#0}::bb2', 'dummyRet::rust::main::_2::rust::main::bb0_internal', 'ClosureExit->dummyRet'), (6, 4, 'dummyRet::rust::main::_2::rust::main::bb0_internal', 'rust::main::bb1', 'dummyRet->Closure Return'),
    (6, 5, 'rust::main::{closure#0}::bb0', 'rust::main::{closure#0}::bb1', 'Goto'), (6, 6, 'rust::main::{closure#0}::bb1', 'rust::main::{closure#0}::bb2', 'Goto'),
    (7, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (7, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'),
    (7, 2, 'rust::main::bb2', 'dummyCall::rust::main::bb2::rust::main::bb2', 'FFI Call'), (7, 3, 'dummyCall::rust::main::bb2::rust::main::bb2', 'llvm::give::node1::rust::main::bb2', 'dummyCall->LLVM Entry'),
    (7, 4, 'llvm::give::node4::rust::main::bb2', 'dummyRet::rust::main::bb3::rust::main::bb2', 'LLVM Exit->dummyRet'), (7, 5, 'dummyRet::rust::main::bb3::rust::main::bb2', 'rust::main::bb3', 'dummyRet->MIR Return'),
    (7, 6, 'rust::main::bb3', 'dummyCall::rust::main::bb3::rust::main::bb3', 'FFI Call'), (7, 7, 'dummyCall::rust::main::bb3::rust::main::bb3', 'llvm::give::node1::rust::main::bb3', 'dummyCall->LLVM Entry'),
    (7, 8, 'llvm::give::node4::rust::main::bb3', 'dummyRet::rust::main::bb4::rust::main::bb3', 'LLVM Exit->dummyRet'), (7, 9, 'dummyRet::rust::main::bb4::rust::main::bb3', 'rust::main::bb4', 'dummyRet->MIR Return'),
    (7, 10, 'llvm::give::node1::rust::main::bb2', 'llvm::give::node2::rust::main::bb2', 'LLVM'), (7, 11, 'llvm::give::node1::rust::main::bb3', 'llvm::give::node2::rust::main::bb3', 'LLVM'),
    (7, 12, 'llvm::give::node2::rust::main::bb2', 'llvm::give::node3::rust::main::bb2', 'LLVM'), (7, 13, 'llvm::give::node2::rust::main::bb3', 'llvm::give::node3::rust::main::bb3', 'LLVM'),
    (7, 14, 'llvm::give::node3::rust::main::bb2', 'llvm::give::node4::rust::main::bb2', 'LLVM'), (7, 15, 'llvm::give::node3::rust::main::bb3', 'llvm::give::node4::rust::main::bb3', 'LLVM'),
    (8, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (8, 1, 'rust::main::bb1', 'rust::main::bb2', 'Goto'), (8, 2, 'rust::main::bb2', 'rust::main::bb3', 'Goto'),
    (9, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (9, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'), (9, 2, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'),
    (9, 3, 'rust::main::bb3', 'rust::main::bb4', 'Call return (fallback)'), (10, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (10, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'),
    (10, 2, 'rust::main::bb2', 'rust::main::bb3', 'Call return (fallback)'), (10, 3, 'rust::main::bb3', 'rust::main::bb4', 'Call return (fallback)'), (10, 4, 'rust::main::bb4', 'rust::main::bb5', 'Drop return'),
    (10, 5, 'rust::main::bb4', 'rust::main::terminate', 'Drop unwind'), (11, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'), (11, 1, 'rust::main::bb1', 'rust::main::bb2', 'Call return (fallback)'),
    (11, 2, 'rust::main::bb2', 'rust::main::bb3', 'Drop return'), (11, 3, 'rust::main::bb2', 'rust::main::terminate', 'Drop unwind'), (12, 0, 'rust::main::bb0', 'rust::main::bb1', 'Call return (fallback)'),
    (12, 1, 'rust::main::bb1', 'rust::main::bb2', 'SwitchInt target'), (12, 2, 'rust::main::bb1', 'rust::main::bb3', 'SwitchInt otherwise'), (12, 3, 'rust::main::bb2', 'rust::main::bb4', 'Drop return'),
    (12, 4, 'rust::main::bb3', 'rust::main::bb4', 'Goto'), (12, 5, 'rust::main::bb4', 'rust::main::bb5', 'Goto'), (12, 6, 'rust::main::bb5', 'rust::main::bb6', 'Call return (fallback)')"""

_NODES = r"""
    (0, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (0, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (0, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (0, 3, 'rust::main::bb3', 'Mir', NULL, NULL),
    (0, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (0, 5, 'rust::main::bb5', 'Mir', NULL, NULL), (1, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (1, 1, 'rust::main::bb1', 'Mir', NULL, NULL),
    (1, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (1, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (1, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (1, 5, 'rust::main::bb5', 'Mir', NULL, NULL),
    (2, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (2, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (2, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (2, 3, 'rust::main::bb3', 'Mir', NULL, NULL),
    (2, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (2, 5, 'rust::main::bb5', 'Mir', NULL, NULL), (2, 6, 'rust::main::bb6', 'Mir', NULL, NULL), (3, 0, 'rust::main::bb0', 'Mir', NULL, NULL),
    (3, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (3, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (3, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (3, 4, 'rust::main::bb4', 'Mir', NULL, NULL),
    (4, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (4, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (4, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (4, 3, 'rust::main::bb3', 'Mir', NULL, NULL),
    (4, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (5, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (5, 1, 'rust::main::bb1', 'Mir', NULL, NULL),
    (5, 2, 'dummyCall::rust::main::bb1::rust::main::bb1_internal', 'DummyCall', 'Local(_1)', NULL), (5, 3, 'dummyRet::rust::main::1::rust::main::bb1_internal', 'DummyRet', '_2', 'Local _0'),
    (5, 4, 'rust::main::bb2', 'Mir', NULL, NULL), (5, 5, 'rust::helper::bb0', 'Mir', NULL, NULL), (5, 6, 'rust::helper::bb1', 'Mir', NULL, NULL), (6, 0, 'rust::main::bb0', 'Mir', NULL, NULL),
    (6, 1, 'dummyCall::rust::main::bb0::rust::main::bb0_internal', 'DummyCall', 'Local(_1)', '_2'), (6, 2, 'dummyRet::rust::main::_2::rust::main::bb0_internal', 'DummyRet', NULL, NULL), (6, 3, 'rust::main::bb1', 'Mir', NULL, NULL),
    (6, 4, 'rust::main::{closure#0}::bb0', 'Mir', NULL, NULL), (6, 5, 'rust::main::{closure#0}::bb1', 'Mir', NULL, NULL), (6, 6, 'rust::main::{closure#0}::bb2', 'Mir', NULL, NULL), (7, 0, 'rust::main::bb0', 'Mir', NULL, NULL),
    (7, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (7, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (7, 3, 'dummyCall::rust::main::bb2::rust::main::bb2', 'DummyCall', 'Local(_2)', '10@rust::main::bb2'),
    (7, 4, 'llvm::give::node1::rust::main::bb2', 'Llvm', NULL, NULL), (7, 5, 'llvm::give::node2::rust::main::bb2', 'Llvm', NULL, NULL), (7, 6, 'llvm::give::node3::rust::main::bb2', 'Llvm', NULL, NULL),
    (7, 7, 'llvm::give::node4::rust::main::bb2', 'Llvm', NULL, NULL), (7, 8, 'dummyRet::rust::main::bb3::rust::main::bb2', 'DummyRet', NULL, 'entry'), (7, 9, 'rust::main::bb3', 'Mir', NULL, NULL),
    (7, 10, 'dummyCall::rust::main::bb3::rust::main::bb3', 'DummyCall', 'Local(_2)', '10@rust::main::bb3'), (7, 11, 'llvm::give::node1::rust::main::bb3', 'Llvm', NULL, NULL),
    (7, 12, 'llvm::give::node2::rust::main::bb3', 'Llvm', NULL, NULL), (7, 13, 'llvm::give::node3::rust::main::bb3', 'Llvm', NULL, NULL), (7, 14, 'llvm::give::node4::rust::main::bb3', 'Llvm', NULL, NULL),
    (7, 15, 'dummyRet::rust::main::bb4::rust::main::bb3', 'DummyRet', NULL, 'entry'), (7, 16, 'rust::main::bb4', 'Mir', NULL, NULL), (8, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (8, 1, 'rust::main::bb1', 'Mir', NULL, NULL),
    (8, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (8, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (9, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (9, 1, 'rust::main::bb1', 'Mir', NULL, NULL),
    (9, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (9, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (9, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (10, 0, 'rust::main::bb0', 'Mir', NULL, NULL),
    (10, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (10, 2, 'rust::main::bb2', 'Mir', NULL, NULL), (10, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (10, 4, 'rust::main::bb4', 'Mir', NULL, NULL),
    (10, 5, 'rust::main::bb5', 'Mir', NULL, NULL), (11, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (11, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (11, 2, 'rust::main::bb2', 'Mir', NULL, NULL),
    (11, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (12, 0, 'rust::main::bb0', 'Mir', NULL, NULL), (12, 1, 'rust::main::bb1', 'Mir', NULL, NULL), (12, 2, 'rust::main::bb2', 'Mir', NULL, NULL),
    (12, 3, 'rust::main::bb3', 'Mir', NULL, NULL), (12, 4, 'rust::main::bb4', 'Mir', NULL, NULL), (12, 5, 'rust::main::bb5', 'Mir', NULL, NULL), (12, 6, 'rust::main::bb6', 'Mir', NULL, NULL)"""


def case_sql(columns: str, rows: str) -> str:
    """The rows of each case for each of its customers."""
    listed = ", ".join(f"t.{c}" for c in columns.split())
    return f"SELECT c_custkey::VARCHAR AS program_id, {listed} FROM customer JOIN (VALUES{rows}) t(k, {columns.replace(' ', ', ')}) ON c_custkey % 13 = t.k"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return case_graph(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))


def _result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint(*_graph(spark, sf_dir))


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir)
    return (*detect(nodes, edges, written(fixpoint(nodes, edges), "fixpoint")), nodes)


@query(case_sql("pos source destination label", _EDGES))
def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all rules, in list order: calls into C with and without a body, closures, calls inside the program, unwinds, copies of C edges."""
    return _graph(spark, sf_dir)[1].select("program_id", "pos", "source", "destination", "label")


@query(case_sql("seq node_id node_type mir_var llvm_var", _NODES))
def case_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node list with its dummies and the copies of C nodes for each call site."""
    return _graph(spark, sf_dir)[0].select("program_id", "seq", "node_id", "node_type", "dummy.mir_var", "dummy.llvm_var")


@query(case_sql("node_id alloc value", _STATES))
def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixpoint's memories."""
    state = _result(spark, sf_dir).where("kind = 'state'")
    return state.select("program_id", "node_id", F.array_join("alloc", ",").alias("alloc"), lattice.decode(F.col("mask")).alias("value"))


@query(case_sql("n node_id", _VISITS))
def case_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the worklist visits nodes."""
    return _result(spark, sf_dir).where("kind = 'visit'").select("program_id", "n", "node_id")


@query(case_sql("node_id var marker", _MARKERS))
def case_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker sets of all nodes."""
    return _result(spark, sf_dir).where("kind = 'taint'").select("program_id", "node_id", F.col("var").alias("var"), "marker")


@query(case_sql("alloc_key frees used use_span free_span free_kind double_free never_free use_after_free", _FINDINGS))
def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every program."""
    return _detected(spark, sf_dir)[0]


@query(case_sql("n var info", _WARNINGS))
def case_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frees on the C side."""
    return _detected(spark, sf_dir)[1]


@query(case_sql("line_no line", _REPORT))
def case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of every program, line by line."""
    return sinks.report_lines(*_detected(spark, sf_dir))
