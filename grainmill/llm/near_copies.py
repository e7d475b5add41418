"""Near copies from a similarity of word shingles on: fingerprints bring candidates together, the exact similarity links them.

Texts whose five-word shingles have a similarity of 0.8 differ in about ten of
64 fingerprint bits, and within ten bits of a fingerprint lie more strangers
than copies.  The trie join of fingerprints therefore finds the close copies
only, and bands of least hashes of the same shingles find the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.hamming import Forest
from grainmill.llm.simhash import SEED, SimHashRules, fingerprint_components, fingerprints_of, keep_keys, keyed_rows, shingle_hashes
from grainmill.llm.text import mix, written
from grainmill.operators.components import connected_components

#: Shingles whose minima are taken at a time.
_STEP = 512


@dataclass(frozen=True)
class NearCopyRules:
    """Two texts are linked from ``percent`` on: common shingles against all shingles of both, repeats not counted.

    Candidates are texts whose fingerprints ``simhash`` links, and texts that
    share a band.  ``bands`` of ``rows`` minima each miss a pair of similarity s with a chance of
    ``(1 - s ** rows) ** bands``: 1.5e-5 at 0.8.  A candidate group of more than
    ``split_size`` texts is dealt to several tasks, each of which joins two of its
    shares.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    split_size: int = 1024
    simhash: SimHashRules = SimHashRules(shingle_words=5)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def band_keys(shingles: np.ndarray, rules: NearCopyRules) -> np.ndarray:
    """One key for each band, none without shingles; a key holds the number of its band."""
    if not len(shingles):
        return np.empty(0, np.int64)
    n = rules.bands * rules.rows
    factors = (np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), _STEP):
            np.minimum(least, (factors[:, None] * shingles[None, i : i + _STEP]).min(axis=1), out=least)
        key = np.arange(rules.bands, dtype=np.uint64)
        for column in least.reshape(rules.bands, rules.rows).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the first one of its component; links are pairs with the similarity, and a pair within one component is not looked at."""
    n, forest = len(sets), Forest(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(words), bool)
    for i in range(n - 1):
        least, most = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        others = np.flatnonzero((forest.parent[i + 1 :] != forest.parent[i]) & (100 * least >= percent * most)) + i + 1
        if not len(others):
            continue
        mine = codes[starts[i] : ends[i]]
        own[mine] = True
        if 8 * len(others) < n:
            common = np.array([np.count_nonzero(own[codes[starts[j] : ends[j]]]) for j in others])
        else:
            common = np.add.reduceat(own[codes], starts, dtype=np.int64)[others]
        own[mine] = False
        near = others[100 * common >= percent * (sizes[others] + sizes[i] - common)]
        if len(near):
            forest.unite(np.full(len(near), i), near)
    return forest.parent


def _marked(slim: DataFrame, rules: NearCopyRules) -> DataFrame:
    """(key, doc_id, digest, fingerprint, bands) of rows (key, doc_id, text), from one pass over the shingles; texts with equal sets have equal digests."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t.as_py(), rules.shingle_words) for t in b.column("text")]
            sets = [np.unique(np.array(h, np.uint64)) for h in hashes]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            bands = pa.array([band_keys(x, rules) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), digests, fingerprints_of(hashes), bands], ["key", "doc_id", "digest", "fingerprint", "bands"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(marks, f"key string, doc_id {kind}, digest binary, fingerprint bigint, bands array<bigint>")


def _candidate_groups(classes: DataFrame, rules: NearCopyRules) -> DataFrame:
    """(node, component): classes that chains of linked fingerprints or equal band keys bring together."""
    roots = fingerprint_components(classes, "fingerprint", rules.simhash)
    near = classes.select("id", F.col("fingerprint").alias("f")).join(roots, "f", "left").select("id", F.xxhash64(F.lit("root"), F.coalesce("root", "f")).alias("group"))
    keyed = near.union(classes.select("id", F.explode("bands").alias("group")))
    least = keyed.groupBy("group").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "least")
    pairs = keyed.join(least.hint("merge"), "group").where("id <> least").select("id", "least").distinct()
    return connected_components(written(pairs, "pairs"), "id", "least")


def _links(texts: DataFrame, rules: NearCopyRules) -> DataFrame:
    """(a, b): a spanning forest of the links within each group, from rows (id, component, text)."""
    sizes = texts.groupBy("component").count().where(F.col("count") > rules.split_size).withColumn("shares", F.ceil(F.col("count") / rules.split_size).cast("int")).drop("count")
    sized = texts.join(sizes, "component", "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    dealt = sized.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("id", "text", F.xxhash64("component", F.least("s", "t"), F.greatest("s", "t")).alias("bucket"))
    width, percent = rules.shingle_words, rules.percent

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, group = None, {}

        def pairs() -> pa.RecordBatch:
            ids = np.array(list(group), np.int64)
            root = linked(list(group.values()), percent) if group else np.empty(0, np.int64)
            child = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], ["a", "b"])

        for b in batches:
            for i, t, k in zip(b.column("id").to_pylist(), b.column("text"), b.column("bucket").to_pylist()):
                if k != bucket:
                    yield pairs()
                    bucket, group = k, {}
                group[i] = shingle_set(t.as_py(), width)
        yield pairs()

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(joined, "a bigint, b bigint")


def keep_one_near_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearCopyRules = NearCopyRules()) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component of links, the row with the smallest id stays.

    Texts of fewer words than a shingle are one shingle; texts without words
    (null, empty, white space) are copies of each other.  Ids that are null come
    last.  Repeated rows are copies too.  Columns are those of the input.
    """
    slim = keyed_rows(docs, doc_id, text)
    marked = written(_marked(slim, rules), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    values = [F.first(c).alias(c) for c in ("fingerprint", "bands")]  # repeats of shingles may tell texts of one set apart
    classes = written(marked.groupBy("digest").agg(first, *values).select(F.monotonically_increasing_id().alias("id"), "first", "fingerprint", "bands"), "classes")
    groups = _candidate_groups(classes, rules).withColumnRenamed("node", "id")
    wanted = classes.join(groups, "id").select("id", "component", F.col("first.key").alias("key"))
    texts = written(slim.select("key", "text").join(wanted.hint("merge"), "key").select("id", "component", "text"), "candidates")
    roots = connected_components(written(_links(texts, rules), "links"), "a", "b").withColumnRenamed("node", "id")
    rooted = classes.select("id", "first").join(roots, "id", "left").groupBy(F.coalesce("component", "id").alias("root")).agg(F.min("first").alias("first"))
    return keep_keys(docs, marked, rooted.select("first.key"), doc_id, text)
