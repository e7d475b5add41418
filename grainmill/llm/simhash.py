"""SimHash fingerprints of word shingles, their near-duplicate components and survivors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.hamming import block_masks, equal_blocks, link
from grainmill.llm.text import written
from grainmill.operators.components import connected_components

SEED = 42
#: Shingles whose bits are laid out at a time.
_SHINGLES = 1 << 18


@dataclass(frozen=True)
class SimHashRules:
    """``bucket_load``: mean size of join buckets that sets how many blocks must agree.

    ``split_size``: a bucket of more fingerprints is dealt to several tasks, each
    of which joins two of its shares; one of so many more that shares would cost
    more rows than blocks is dealt by blocks of its other bits first.
    """

    shingle_words: int = 4
    budget: int = 4
    bucket_load: int = 256
    split_size: int = 8192


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle, repeats included; the whole sequence if it is shorter, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())]


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is set if it is set in over half of a document's hashes; zero for none."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        first = ends[i] - counts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + _SHINGLES, side="right")))
        full = np.flatnonzero(counts[i:j]) + i
        if len(full):
            ones = np.zeros((len(full), 64), np.int64)
            for a in range(first, ends[j - 1], _SHINGLES):  # a longer document takes several rounds
                b = min(a + _SHINGLES, ends[j - 1])
                bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                begin = ends[full] - counts[full]
                inside = (begin < b) & (ends[full] > a)
                ones[inside] += np.add.reduceat(bits, np.maximum(begin[inside], a) - a, axis=0, dtype=np.int64)
            out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
        i = j
    return out


def simhash(text: Column, width: int = 4) -> Column:
    """The 64-bit fingerprint of a text column, as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return fingerprints_of([shingle_hashes(t.as_py(), width) for t in texts])

    return fingerprint(text)


def fingerprints_of(hashes: list[list[int]]) -> pa.Array:
    """The fingerprint of each list of shingle hashes, as signed longs."""
    flat = np.concatenate([np.array(h, np.uint64) for h in hashes] or [np.empty(0, np.uint64)])
    return pa.array(_fingerprints(flat, np.array([*map(len, hashes)], np.int64)).view(np.int64))


def fingerprint_components(fingerprints: DataFrame, column: str, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """(fingerprint, root) for each distinct fingerprint with a link, root naming its component.

    Fingerprints within the budget agree on one block of bits at least (or on
    several of more blocks, in large tables), so each is dealt to one bucket per
    choice of blocks.  A bucket's task walks its trie and returns a spanning
    forest, fewer rows than it read, and never the pairs.
    """
    distinct = written(fingerprints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct(), "fingerprints")
    masks = [*block_masks(rules.budget, equal_blocks(distinct.count(), rules.budget, rules.bucket_load))]
    keyed = distinct.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(_signed(m)) for m in masks))).alias("choice", "value"))
    keyed = keyed.select("f", "choice", F.struct("choice", "value").alias("bucket"))
    sizes = written(keyed.groupBy("bucket").count().where(F.col("count") > rules.split_size), "buckets")
    if sizes.isEmpty():
        dealt = keyed.select("f", F.xxhash64("bucket").alias("bucket"))
    else:
        dealt = _in_shares(_by_other_blocks(keyed, masks, sizes, rules), rules)
    budget = rules.budget

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, [batch.column("f").to_numpy(), batch.column("bucket").to_numpy()]], axis=1)
            if held.shape[1] > _BUCKET_ROWS:
                whole = int(np.searchsorted(held[1], held[1][-1]))
                yield forest(held[:, :whole])
                held = held[:, whole:]
        yield forest(held)

    def forest(rows: np.ndarray) -> pa.RecordBatch:
        a, b = link(rows[1], np.ascontiguousarray(rows[0]).view(np.uint64), budget)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # Two buckets with one hash only share a task's trie; links are tested by distance all the same.
    links = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(joined, "a bigint, b bigint")
    return connected_components(written(links, "links"), "a", "b").select(F.col("node").alias("f"), F.col("component").alias("root"))


#: Fingerprints of whole buckets that a task walks at a time.
_BUCKET_ROWS = 1 << 16


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _by_other_blocks(keyed: DataFrame, masks: list[int], sizes: DataFrame, rules: SimHashRules) -> DataFrame:
    """(f, bucket): the very large buckets dealt by blocks of the bits that their choice leaves, others as they are.

    Fingerprints of a bucket agree on its bits, so those within the budget agree
    on a block of the others too: a bucket costs its rows once for each block,
    whatever its size.
    """
    most = rules.split_size * (rules.budget + 1)
    huge = sizes.where(F.col("count") > most)
    largest = huge.agg(F.max("count")).first()[0]
    if not largest:
        return keyed.select("f", "bucket")
    others = [((1 << 64) - 1) ^ m for m in masks]
    equal = equal_blocks(largest, rules.budget, rules.split_size, min(o.bit_count() for o in others))
    inner = F.array(*(F.array(*map(_signed, block_masks(rules.budget, equal, o))) for o in others))
    marked = keyed.join(huge.select("bucket", F.lit(True).alias("huge")), "bucket", "left")
    values = F.transform(F.get(inner, F.col("choice")), lambda m: m.bitwiseAND(F.col("f")))
    parts = F.when(F.col("huge"), F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))).otherwise(F.array(F.lit(None).cast("struct<i:int,v:bigint>")))
    return marked.select("f", "bucket", F.explode(parts).alias("part")).select("f", F.struct("bucket", "part").alias("bucket"))


def _in_shares(rows: DataFrame, rules: SimHashRules) -> DataFrame:
    """(f, bucket): buckets beyond ``split_size`` in shares, with a task for every two of these."""
    large = written(rows.groupBy("bucket").count().where(F.col("count") > rules.split_size), "buckets")
    shares = F.coalesce(F.ceil(F.col("count") / rules.split_size).cast("int"), F.lit(1))
    sized = rows.join(large, "bucket", "left").withColumn("shares", shares).withColumn("s", F.pmod(F.xxhash64("f"), F.col("shares")).cast("int"))
    dealt = sized.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return dealt.select("f", F.xxhash64("bucket", F.least("s", "t"), F.greatest("s", "t")).alias("bucket"))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SimHashRules = SimHashRules()) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row; fingerprint is a signed long.

    component_id is the smallest id that links reach, the row's own included.
    Equal fingerprints are one node from the start, so a group of copies costs
    one fingerprint.  Texts without words (null, empty, white space) have the
    fingerprint zero and link like any other.  A null id is never the smallest:
    a component of null ids only has a null component_id.  Repeated rows return
    as often as they come; other columns do not matter.
    """
    marked = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), simhash(F.col(f"`{text}`"), rules.shingle_words).alias("fingerprint")), "simhash")
    roots = _rooted(marked, rules)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = roots.join(least, "root").select("fingerprint", "component_id")
    return marked.join(table, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(marked: DataFrame, rules: SimHashRules) -> DataFrame:
    """(fingerprint, least, root) for each distinct fingerprint, least being its smallest id."""
    each = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    links = fingerprint_components(each, "fingerprint", rules).withColumnRenamed("f", "fingerprint")
    return written(each.join(links, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "roots")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SimHashRules = SimHashRules()) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component, the row with the smallest id stays.

    Of rows that share this id and its fingerprint one stays, whichever; ids
    that are null come last.  Columns are those of the input.  Fingerprints are
    computed once, and survivors are found among ids and fingerprints; the rows
    are read again for one join by the hash of id and text.
    """
    slim = keyed_rows(docs, doc_id, text)
    marked = written(slim.select("key", "doc_id", simhash(F.col("text"), rules.shingle_words).alias("fingerprint")), "simhash")
    roots = _rooted(marked, rules)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint", "key")
    chosen = marked.join(roots.select("fingerprint", "root"), "fingerprint").groupBy("root").agg(F.min(order).alias("c")).select("c.key")
    return keep_keys(docs, marked, chosen, doc_id, text)


def keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id, text), key naming the id and text of a row."""
    return docs.select(_row_key(doc_id, text).alias("key"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def _row_key(doc_id: str, text: str) -> Column:
    tagged = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n"))
    return F.md5(F.concat(tagged(doc_id), F.lit("\x00"), tagged(text)))


def keep_keys(docs: DataFrame, marked: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each chosen key of ``marked``, a table of the keys of all rows.

    Rows are kept out by the keys that go, mostly the fewer; only keys that
    several rows have need these rows side by side.
    """
    name = "__row_key"
    counts = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(chosen.withColumn("chosen", F.lit(True)), "key", "left")
    odd = written(counts.where("chosen IS NULL OR n > 1").select(F.col("key").alias(name), F.coalesce("chosen", F.lit(False)).alias("again")), "leaving")
    rows = docs.withColumn(name, _row_key(doc_id, text))
    once = rows.join(odd.hint("merge"), name, "left_anti")  # the same plan at every size
    again = rows.join(odd.where("again"), name, "left_semi").dropDuplicates([name])
    return once.unionByName(again).drop(name)
