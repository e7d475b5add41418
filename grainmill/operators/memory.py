"""Abstract memories: alias sets with lattice values, as rows and as a small Python object."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainmill.functions import lattice
from grainmill.functions.lattice import MASKS, join_masks

Names = tuple[str, ...]


def variables(memory: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, var, alloc, mask): the value of each variable, from the first alias set, in set order, that holds it."""
    each = memory.select(*keys, "alloc", "mask", F.explode("alloc").alias("var"))
    return each.groupBy(*keys, "var").agg(F.min(F.struct("alloc", "mask")).alias("m")).select(*keys, "var", "m.*")


def union_memories(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alloc, mask): the pointwise least upper bound of two tables of memories.

    A variable's alias set is the union of its two sets, one step and not
    transitive; BOTTOM is left out; where variables agree on the set and not on
    the value, the last of them counts.
    """
    a, b = (variables(m, keys).withColumnsRenamed({"alloc": f"alloc{i}", "mask": f"mask{i}"}) for i, m in enumerate((left, right)))
    zero = F.lit(0)
    both = a.join(b, [*keys, "var"], "full_outer").withColumn("mask", lattice.join(F.coalesce("mask0", zero), F.coalesce("mask1", zero)))
    empty = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce("alloc0", empty), F.coalesce("alloc1", empty)))
    return both.where("mask <> 0").withColumn("alloc", merged).groupBy(*keys, "alloc").agg(F.max_by("mask", "var").alias("mask"))


def compare_memories(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, order): Equal, Less or null, a variable that one side lacks being BOTTOM there; never Greater."""
    a, b = (variables(m, keys).select(*keys, "var", F.col("mask").alias(f"mask{i}")) for i, m in enumerate((left, right)))
    pair = a.join(b, [*keys, "var"], "full_outer").select(*keys, F.coalesce("mask0", F.lit(0)).alias("a"), F.coalesce("mask1", F.lit(0)).alias("b"))
    found = pair.groupBy(*keys).agg(F.bool_and(F.col("a") == F.col("b")).alias("same"), F.bool_and(lattice.leq(F.col("a"), F.col("b"))).alias("below"))
    return found.select(*keys, F.when(F.col("same"), "Equal").when(F.col("below"), "Less").alias("order"))


def first_allocation(state: DataFrame, order: str) -> DataFrame:
    """(program_id, var, alloc): a variable's alias set at the first node, by ``order``, that holds it."""
    each = variables(state, ["program_id", "node_id", order])
    first = Window.partitionBy("program_id", "var").orderBy(order, "node_id")
    return each.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("program_id", "var", "alloc")


class Memory:
    """One memory in a fold over a program; alias sets are sorted tuples, and set order is tuple order.

    ``cells`` changes through the methods only, which keep an index from
    variables to the sets that hold them, made when it is first asked for.
    """

    __slots__ = ("cells", "_sets")

    def __init__(self, cells: dict[Names, int] | None = None):
        self.cells = dict(cells or {})
        self._sets: dict[str, set[Names]] | None = None

    def copy(self) -> "Memory":
        return Memory(self.cells)

    def holder(self, var: str) -> Names | None:
        """The first alias set that holds a variable."""
        if self._sets is None:
            self._sets = {}
            for names in self.cells:
                for v in names:
                    self._sets.setdefault(v, set()).add(names)
        return min(self._sets.get(var, ()), default=None)

    def _remove(self, names: Names) -> None:
        del self.cells[names]
        for v in names if self._sets is not None else ():
            self._sets[v].discard(names)

    def value(self, var: str) -> int:
        names = self.holder(var)
        return MASKS["BOTTOM"] if names is None else self.cells[names]

    def put(self, names: Iterable[str], mask: int) -> None:
        names = tuple(sorted(set(names)))
        self.cells[names] = mask
        for v in names if self._sets is not None else ():
            self._sets.setdefault(v, set()).add(names)

    def set_all(self, mask: int) -> None:
        """Every alias set gets one value."""
        self.cells = dict.fromkeys(self.cells, mask)

    def replace(self, names: Names, by: Iterable[str], mask: int) -> None:
        """The alias set ``names`` gives way to ``by``, if that is not empty."""
        self._remove(names)
        if by := {*by}:
            self.put(by, mask)

    def forget(self, var: str) -> None:
        """The whole alias set of a variable goes."""
        if (names := self.holder(var)) is not None:
            self._remove(names)

    def assign(self, var: str, mask: int) -> None:
        """Gives a variable a value.

        BOTTOM takes it out of its set, which then is BOTTOM.  Any other value
        is that of its whole set; a variable without a set joins the first one
        of that value, or gets its own.  Dotted prefixes join with it.
        """
        names = self.holder(var)
        if mask == MASKS["BOTTOM"]:
            if names is not None:
                self.replace(names, {*names} - {var}, mask)
            return
        parts = var.split(".")
        joining = {var, *(".".join(parts[: i + 1]) for i in range(len(parts)))} - {""}
        if names is None:
            names = min((n for n, m in self.cells.items() if m == mask), default=None)
        if names is None:
            self.put(joining, mask)
        else:
            self.replace(names, {*names} | joining, mask)

    def propagate(self, source: str, target: str) -> None:
        """The target joins the source's set; if the source is BOTTOM, it leaves its own."""
        mask, of_target = self.value(source), self.holder(target)
        if mask == MASKS["BOTTOM"]:
            if of_target is not None:
                self.replace(of_target, {*of_target} - {target}, self.cells[of_target])
            return
        of_source = self.holder(source)
        self._remove(of_source)
        if of_target is not None and of_target != of_source:
            self._remove(of_target)
        self.put({*of_source, *(of_target or (target,))}, mask)

    def union(self, other: "Memory") -> "Memory":
        """The least upper bound, variable by variable in name order."""
        out = Memory()
        for var in sorted({v for m in (self, other) for names in m.cells for v in names}):
            mask = join_masks(self.value(var), other.value(var))
            if mask != MASKS["BOTTOM"]:
                out.put((*(self.holder(var) or ()), *(other.holder(var) or ())), mask)
        return out
