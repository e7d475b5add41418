"""Removal of lines that many documents share, by probing perfect-hash shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.perfect_hash import CountTable
from grainmill.llm.text import SPACE, written

_COUNTS = "high bigint, low bigint, n bigint"


@dataclass(frozen=True)
class LineRules:
    """A key of at least ``least_chars`` code points in at least ``least_docs`` documents loses its lines.

    ``shard_keys`` is about how many keys a shard of the index holds, and
    ``round_bytes`` how many bytes of shards are broadcast at a time; a larger
    index takes more rounds, so that no broadcast grows with the data.
    """

    least_docs: int = 10
    least_chars: int = 1
    shard_keys: int = 200_000
    round_bytes: int = 64 << 20


def line_keys(text: str | None, least_chars: int) -> list[bytes]:
    """The key of each line, empty for a line that always stays."""
    keys = [line.strip(SPACE).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]
    if least_chars > 1:
        keys = [k if len(k.decode("utf-8", "surrogatepass")) >= least_chars else b"" for k in keys]
    return keys


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column(0))


def line_counts(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """(high, low, n): the hash of every line key and the number of rows that hold it.

    Each batch sums its own keys before anything is shuffled, so a line of every
    document crosses the network once a batch.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for t in _texts(batch) for k in {*line_keys(t, rules.least_chars)} - {b""}]
            high, low = _hashes(keys)
            both = np.empty(len(high), [("h", np.uint64), ("l", np.uint64)])
            both["h"], both["l"] = high, low
            unique, n = np.unique(both, return_counts=True)
            columns = [np.ascontiguousarray(unique["h"]).view(np.int64), np.ascontiguousarray(unique["l"]).view(np.int64), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["high", "low", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(counted, _COUNTS).groupBy("high", "low").agg(F.sum("n").alias("n"))


def _shards(counts: DataFrame, rules: LineRules) -> tuple[DataFrame, int]:
    """The packed index in shards, and the number of shards that keys are dealt to."""
    frequent = written(counts.where(F.col("n") >= rules.least_docs), "lines")
    shards = max(1, -(-frequent.count() // rules.shard_keys))

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        table = CountTable(keys["high"].to_numpy().view(np.uint64), keys["low"].to_numpy().view(np.uint64), keys["n"].to_numpy())
        return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "packed": [table.pack()]})

    dealt = frequent.withColumn("shard", F.pmod("low", F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(build, "shard bigint, packed binary")
    return written(packed, "shards"), shards


def _rounds(shards: DataFrame, most: int) -> list[list[int]]:
    rounds, size = [[]], 0
    for row in shards.select("shard", F.length("packed").alias("bytes")).orderBy("shard").collect():
        if rounds[-1] and size + row["bytes"] > most:
            rounds.append([])
            size = 0
        rounds[-1].append(row["shard"])
        size += row["bytes"]
    return rounds


def _line_hashes(texts: pa.Array, rules: LineRules) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes (high, low) of the keys of all lines, 0 and 0 for a line that always stays, and the lines of each text."""
    keys = [line_keys(t.as_py(), rules.least_chars) for t in texts]
    high, low = _hashes([k for doc in keys for k in doc])
    stays = ~np.fromiter((bool(k) for doc in keys for k in doc), bool, len(high))
    high[stays], low[stays] = 0, 0
    return high, low, [*map(len, keys)]


def _is_common(high: np.ndarray, low: np.ndarray, tables: dict[int, CountTable], n_shards: int, rules: LineRules) -> np.ndarray:
    """Flags of the lines whose key these tables hold with a count at or above the limit."""
    counts, shard = np.zeros(len(high), np.uint32), low.view(np.int64) % n_shards
    for k, table in tables.items():
        here = shard == k
        counts[here] = table.get(high[here], low[here])
    return (counts >= rules.least_docs) & ((high | low) != 0)


def _without(texts: pa.Array, flags: list[np.ndarray]) -> pa.Array:
    """The struct of each text less its flagged lines."""
    n_lines, n_dropped, left = [], [], []
    for t, drop in zip(texts, flags):
        whole = t.as_py() or ""
        n_lines.append(len(drop))
        n_dropped.append(int(drop.sum()))
        left.append("\n".join([line for line, d in zip(whole.split("\n"), drop.tolist()) if not d]) if drop.any() else whole)
    return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.string())], ["n_lines", "n_dropped", "text"])


_KEPT = "struct<n_lines:bigint,n_dropped:bigint,text:string>"


def _keep(shared, n_shards: int, rules: LineRules):
    """A function of a text that probes the broadcast shards and drops the common lines."""

    @F.arrow_udf(_KEPT)
    def kept(texts: pa.Array) -> pa.Array:
        high, low, sizes = _line_hashes(texts, rules)
        return _without(texts, np.split(_is_common(high, low, _unpacked(shared), n_shards, rules), np.cumsum(sizes)[:-1]) if sizes else [])

    return kept


def _marked(docs: DataFrame, column: Column, shards: DataFrame, rounds: list[list[int]], n_shards: int, rules: LineRules) -> DataFrame:
    """(a, b, marks): for each distinct text with a common line, named by two hashes, bit masks of its lines.

    Line hashes are written once, and each round broadcasts some of the shards,
    reads the hashes and writes masks only.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, sizes = _line_hashes(batch.column("t"), rules)
            parts = np.split(np.stack([high, low], axis=1), np.cumsum(sizes)[:-1]) if sizes else []
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([p.tobytes() for p in parts], pa.binary())], ["a", "b", "keys"])

    keys = written(docs.select(*_text_key(column), column.alias("t")).mapInArrow(hashed, "a bigint, b bigint, keys binary"), "line-keys")
    found = []
    for ids in rounds:
        shared = _shared(shards, ids)

        def probed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [np.frombuffer(k.as_py(), np.uint64).reshape(-1, 2) for k in batch.column("keys")]
                both = np.concatenate(parts or [np.empty((0, 2), np.uint64)])
                flags = _is_common(np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), _unpacked(shared), n_shards, rules)
                masks = [np.packbits(f).tobytes() if f.any() else None for f in np.split(flags, np.cumsum([*map(len, parts)])[:-1])] if parts else []
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(masks, pa.binary())], ["a", "b", "mask"])

        masks = keys.mapInArrow(probed, "a bigint, b bigint, mask binary").where("mask IS NOT NULL")
        found.append(written(masks.groupBy("a", "b").agg(F.first("mask").alias("mask")), "line-masks"))
    return reduce(DataFrame.union, found).groupBy("a", "b").agg(F.collect_list("mask").alias("marks"))


def _text_key(text: Column) -> tuple[Column, Column]:
    own = F.coalesce(text, F.lit(""))
    return F.xxhash64(own).alias("a"), F.xxhash64(F.lit(11), own).alias("b")


def _unmarked():
    """A function of a text and its masks (null: none) that drops the marked lines."""

    @F.arrow_udf(_KEPT)
    def kept(texts: pa.Array, marks: pa.Array) -> pa.Array:
        flags = []
        for t, masks in zip(texts, marks):
            n = (t.as_py() or "").count("\n") + 1
            flags.append(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks.as_py()]), count=n).astype(bool) if masks.is_valid else np.zeros(n, bool))
        return _without(texts, flags)

    return kept


def drop_common_lines(docs: DataFrame, text: str = "text", out: str = "lines", rules: LineRules = LineRules()) -> DataFrame:
    """Every row with a struct column ``out``: n_lines, n_dropped and the text without common lines.

    A line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased; a line without a key stays.  Keys of enough rows (repeated rows
    count each) are indexed by sharded minimal perfect hashes with fingerprints
    and counts, and documents probe these arrays: lines are neither joined nor
    shuffled again.  An index of more than ``round_bytes`` is broadcast in
    rounds, which write masks of lines and no text; one join by text hash brings
    these to the rows.  Keys below the limit can change nothing and are not
    indexed; the 64-bit fingerprint beside the 128-bit position hash tells them
    apart.

    A null or empty text is one empty line and gives an empty text.  An empty
    table stays empty.  A column named as ``out`` is replaced, others pass.
    """
    shards, n_shards = _shards(line_counts(docs, text, rules), rules)
    column, rounds = F.col(f"`{text}`"), _rounds(shards, rules.round_bytes)
    if len(rounds) == 1:
        return docs.withColumn(out, _keep(_shared(shards, rounds[0]), n_shards, rules)(column))
    marks = _marked(docs, column, shards, rounds, n_shards, rules).select(F.struct("a", "b").alias("__marked_text"), F.col("marks").alias("__line_marks"))
    joined = docs.withColumn("__marked_text", F.struct(*_text_key(column))).join(marks, "__marked_text", "left")
    return joined.withColumn(out, _unmarked()(column, F.col("__line_marks"))).drop("__marked_text", "__line_marks")


def _shared(shards: DataFrame, ids: list[int]):
    """A broadcast of some shards, ``round_bytes`` at most unless one alone is larger."""
    rows = shards.where(F.col("shard").isin(ids)).collect()
    return shards.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["packed"]) for r in rows})


_unpacked_last: tuple[object, dict[int, CountTable]] = (None, {})


def _unpacked(shared) -> dict[int, CountTable]:
    """The tables of a broadcast, unpacked once a Python worker; the last one only is held."""
    global _unpacked_last
    if _unpacked_last[0] is not shared.value:
        _unpacked_last = (shared.value, {k: CountTable.unpack(v) for k, v in shared.value.items()})
    return _unpacked_last[1]
