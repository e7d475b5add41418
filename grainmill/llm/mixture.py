"""Mixing overlapping sources to target weights by min-cost flow and seeded selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grainmill.llm.flow import capped_targets, route
from grainmill.llm.text import written

WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 2  # of the hexadecimal order key, read a level
_LEVELS = 2


@dataclass(frozen=True)
class MixRules:
    """Sources in code point order, null last, weigh ``weights`` in turn, again and again.

    They share ``share`` times the words of all rows, none more than ``repeats``
    times its own.  ``most_patterns`` bounds what the driver gathers and
    broadcasts: the distinct sets of sources that documents lie in.
    """

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    seed: int = 42
    most_patterns: int = 100_000


@dataclass(frozen=True)
class Mixture:
    """``measured``: id, sources, size and order key of each row; ``patterns``: the cut of each set of sources;
    ``sources``: (source, source_size, target)."""

    measured: DataFrame
    patterns: DataFrame
    sources: DataFrame


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hexadecimal, and the same in every run; rows with equal ids and texts tie."""
    own = F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *own))


def _one(part: Column) -> Column:
    """Null and empty lists of sources count as the null source."""
    return F.when(part.isNull() | (F.size(part) == 0), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(part)))


def plan_mixture(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", rules: MixRules = MixRules()) -> Mixture:
    """Measures the rows, routes words to source targets and finds where each pattern's selection ends.

    ``sources`` is an array column; the rows with the same set of sources are a
    pattern.  Only sums over patterns and 256 ranges of the order key are
    gathered: a hot source costs partial sums and one row of the plan.
    """
    spark, id_, text_ = docs.sparkSession, F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    measured = written(docs.select(id_.alias("doc_id"), _one(sources).alias("sources"), size_in_words(text_).alias("size"), order_key(id_, text_, rules.seed).alias("key")), "measured")
    sums = measured.groupBy("sources").agg(F.sum("size").alias("size")).limit(rules.most_patterns + 1).collect()
    if len(sums) > rules.most_patterns:
        raise ValueError(f"more than {rules.most_patterns} sets of sources; raise most_patterns")
    patterns = sorted(((tuple(r["sources"]), int(r["size"])) for r in sums), key=lambda p: [_rank(s) for s in p[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=_rank)
    sizes = {s: sum(size for p, size in patterns if s in p) for s in names}
    weights = {s: rules.weights[i % len(rules.weights)] for i, s in enumerate(names)}
    targets = capped_targets(sizes, weights, rules.share * sum(size for _, size in patterns), rules.repeats)
    flows = route(patterns, {s: int(targets[s] + 0.5) for s in names}, rules.repeats)
    plan = []
    for (p, size), flow in zip(patterns, flows):
        whole, rest = divmod(sum(flow.values()), size) if size else (0, 0)
        plan.append(([*p], whole, rest))
    at = T.StructType([T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    cuts = _cuts(measured, spark.createDataFrame(plan, at))
    about = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    return Mixture(measured, cuts, spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in names], about))


def _rank(source: str | None) -> tuple[bool, str]:
    return (source is None, source or "")


def _cuts(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """(sources, whole, cut_key, cut_each): after ``whole`` full passes, rows with a smaller key are taken once more,
    and the rows with the cut key ``cut_each`` words."""
    plan = plan.withColumn("pattern", F.to_json("sources"))
    open_ = plan.where("rest > 0").select("pattern", "rest", F.lit("").alias("prefix"))
    rows = measured.select(F.to_json("sources").alias("pattern"), "key", "size").where("size > 0")
    ahead = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def step(open_: DataFrame, part: Column) -> DataFrame:
        inside = rows.join(F.broadcast(open_), "pattern").where(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("pattern", "rest", part.alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        return written(sums.where("before < rest AND rest <= before + size"), "cut")

    for level in range(1, _LEVELS + 1):
        open_ = step(open_, F.substring("key", 1, _DIGITS * level)).select("pattern", (F.col("rest") - F.col("before")).alias("rest"), F.col("part").alias("prefix"))
    last = step(open_, F.col("key")).select("pattern", F.col("part").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("n")).alias("cut_each"))
    return plan.join(last, "pattern", "left").select("sources", "whole", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_each", F.lit(0)).alias("cut_each"))


def with_taken(rows: DataFrame, mixture: Mixture, sources: str = "sources", size: str = "size", key: str = "key") -> DataFrame:
    """Rows with ``taken`` (words, repeats counted) and ``copies`` (whole documents, the cut one rounded)."""
    size_, key_ = F.col(size), F.col(key)
    cut = F.broadcast(mixture.patterns.select(F.to_json("sources").alias("__pattern"), "whole", "cut_key", "cut_each"))
    once_more = F.when(key_ < F.col("cut_key"), size_).when(key_ == F.col("cut_key"), F.least(size_, F.col("cut_each"))).otherwise(F.lit(0))
    found = rows.withColumn("__pattern", F.to_json(F.col(sources))).join(cut, "__pattern").withColumn("__more", once_more)
    copies = F.col("whole") + F.when((F.col("__more") > 0) & (2 * F.col("__more") >= size_), 1).otherwise(0)
    return found.withColumn("taken", F.col("whole") * size_ + F.col("__more")).withColumn("copies", copies).drop("__pattern", "__more", "whole", "cut_key", "cut_each")


def mix_amounts(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", rules: MixRules = MixRules()) -> tuple[DataFrame, DataFrame]:
    """((doc_id, sources, size, taken, copies) of each row, (source, source_size, target) of each source).

    Words taken per source meet its target to the word where capacity allows;
    the row at the cut gives a part of its words.  The order of rows is the md5
    of seed, id and text, so reruns agree; rows alike in id and text share a cut
    equally.  A null text has no words; a row without words is in every full
    pass and otherwise left out; null or empty ``sources`` are the null source.
    An empty table gives two empty tables.
    """
    mixture = plan_mixture(docs, sources, doc_id, text, rules)
    return with_taken(mixture.measured, mixture).drop("key"), mixture.sources


def mix_documents(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", rules: MixRules = MixRules()) -> DataFrame:
    """The rows of the mix: each row as often as it is taken, the one at the cut if at least half of it is; columns of the input."""
    mixture = plan_mixture(docs, sources, doc_id, text, rules)
    id_, text_ = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("__row"), _one(sources).alias("sources"), size_in_words(text_).alias("size"), order_key(id_, text_, rules.seed).alias("key"))
    taken = with_taken(rows, mixture).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
