"""Removal of byte strings that occur twice or more in the corpus, by bucketed suffix sorting."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.suffix_sort import equal_suffixes
from grainmill.llm.text import CHUNK_BYTES, SpanHasher, bucketed, written

_xxh3 = xxhash.xxh3_64_intdigest

_POSITION_BITS = np.uint64(31)
_OUT_ROWS = 10_000
#: A place packs a run's first byte, the anchor's distance from it and the number of strings, the last two in so many bits.
_PLACE_BITS = 12
_PLACE_MASK = (1 << _PLACE_BITS) - 1


@dataclass(frozen=True)
class RepeatRules:
    """Each byte inside a ``width``-byte string that also starts elsewhere is repeated.

    Strings are bucketed by their minimizer, the ``anchor``-byte substring with
    the least hash.  A bucket of more than ``bucket_runs`` different runs of
    strings is dealt by the bytes around the minimizer, ``dealt_strings`` strings
    together, and a group of these of over ``group_bytes`` is sorted in parts.
    The limits are absolute, so no task grows with the corpus.
    """

    width: int = 200
    anchor: int = 32
    bucket_runs: int = 1000
    dealt_strings: int = 12
    group_bytes: int = 1 << 20

    def __post_init__(self):
        if not 0 < self.anchor <= self.width < 1 << _PLACE_BITS:
            raise ValueError(f"0 < anchor <= width < {1 << _PLACE_BITS} does not hold")


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, from running minima within blocks of the width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, rules: RepeatRules) -> tuple[np.ndarray, ...]:
    """Runs of consecutive strings of one text with one minimizer: (first start, distance to the minimizer, strings, bucket, content hash).

    Equal strings have the same minimizer at the same place, so they meet in a
    bucket; ties go to the leftmost.
    """
    width, k = rules.width, rules.anchor
    n = len(data) - width + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    hashed = SpanHasher(data)
    at = np.arange(len(data) - k + 1)
    grams = hashed(at, at + k)
    place = (grams >> _POSITION_BITS << _POSITION_BITS) | at.astype(np.uint64)
    anchor = (_window_minima(place, width - k + 1) & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    whole = np.arange(n) + width <= offsets[text + 1]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh & whole)
    turn = np.append(np.flatnonzero(fresh | ~whole), n)
    count = turn[np.searchsorted(turn, first, side="right")] - first
    ends, whole_run = (first + count + width - 1).tolist(), memoryview(data)
    content = np.array([_xxh3(whole_run[i:j]) for i, j in zip(first.tolist(), ends)], np.uint64)
    return first, anchor[first] - first, count, grams[anchor[first]], content


_RUN = np.dtype([("place", "<i8"), ("bucket", "<u8"), ("content", "<u8")])


def _unplaced(place):
    """(first, anchor distance, count)."""
    return place >> 2 * _PLACE_BITS, place >> _PLACE_BITS & _PLACE_MASK, place & _PLACE_MASK


def _runs(packed: pa.Scalar | None) -> np.ndarray:
    return np.frombuffer(packed.as_py(), _RUN) if packed is not None and packed.is_valid else np.empty(0, _RUN)


def _distinct_texts(docs: DataFrame, text: Column, rules: RepeatRules) -> DataFrame:
    """Each distinct text of at least ``width`` bytes once: (a, b, n, packed, runs), bucketed by the text hash (a, b).

    A task drops its own repeats before the shuffle, so a text that a third of
    the rows hold leaves each task once.
    """
    width = rules.width

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            rows = []
            for key, t in zip(keys, batch.column("t")):
                if key in seen:
                    seen[key] += 1
                else:
                    seen[key] = 0
                    rows.append((*key, 1, pack(t.as_py().encode("utf-8", "surrogatepass"))))
            yield _batch(rows, _TEXT)
        yield _batch([(*key, n, None) for key, n in seen.items() if n], _TEXT)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list | None = None
        rows: list[list] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts = [unpack(r[3]) for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            first, ahead, count, bucket, content = anchored_runs(np.frombuffer(b"".join(texts), np.uint8), offsets, rules)
            owner = np.searchsorted(offsets, first, side="right") - 1
            runs = np.empty(len(first), _RUN)
            runs["place"], runs["bucket"], runs["content"] = (first - offsets[owner]) << 2 * _PLACE_BITS | ahead << _PLACE_BITS | count, bucket, content
            ends = np.searchsorted(owner, np.arange(len(rows) + 1))
            return _batch([(*r, runs[i:j].tobytes()) for r, i, j in zip(rows, ends, ends[1:])], _STORED)

        for batch in batches:
            for a, b, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[:2] == [a, b]:
                    held[2] += n
                    held[3] = held[3] or packed
                    continue
                if held:
                    rows.append(held)
                    size += len(held[3])
                held = [a, b, n, packed]
                if size > CHUNK_BYTES // 2:
                    yield flush()
                    rows, size = [], 0
        if held:
            rows.append(held)
        if rows:
            yield flush()

    spark = docs.sparkSession
    whole = docs.select(text.alias("t")).where(F.octet_length("t") >= width).select("t", *text_key(F.col("t")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.mapInArrow(first_of_each, _ddl(_TEXT)).repartition(parts, "a", "b").sortWithinPartitions("a", "b")
    return bucketed(dealt.mapInArrow(merged, _ddl(_STORED)), parts, ["a", "b"], "texts")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")


_TEXT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_STORED = pa.schema([*_TEXT, ("runs", pa.binary())])
_DDL = {pa.bool_(): "boolean", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array([*c], f.type) for c, f in zip(columns, schema)], schema=schema)


def _columns(names: str, *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(v.dtype, copy=not v.flags.c_contiguous).view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)) for v in values], names.split())


def _flat_runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a batch of texts with the (a, b, n) of their text."""
    each = [_runs(x) for x in batch.column("runs")]
    sizes = [len(x) for x in each]
    a, b, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("a", "b", "n"))
    return np.concatenate(each or [_runs(None)]), a, b, n


#: What becomes of a run: settled by counting, sorted with its bucket, or dealt by the bytes around its minimizer.
_COUNTED, _SORTED, _DEALT = range(3)
_CONTENT = "bucket bigint, content bigint, n bigint, a bigint, b bigint, place bigint"


def _contents(store: DataFrame, most: int) -> DataFrame:
    """(bucket, content, n, a, b, place, state) of different runs; runs alone in their bucket that occur once are left out.

    ``n`` over 1 means that a run occurs again as a whole, and (a, b, place) is
    one of its occurrences.  Batches count their own equal runs before the
    shuffle, which deals ranges of (bucket, content) between sampled splitters,
    so that a bucket with a great share of all runs goes to many tasks.  A task
    sees its buckets whole but for the first and the last one: these, and those
    of more than ``most`` runs, are dealt again.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, a, b, n = _flat_runs(batch)
            order = np.lexsort((runs["content"], runs["bucket"]))
            runs, a, b, n = runs[order], a[order], b[order], n[order]
            heads = _heads(runs["bucket"], runs["content"])
            total = np.minimum(np.add.reduceat(n, heads), 2) if len(heads) else n
            yield _columns("bucket content n a b place", *(runs[c][heads] for c in ("bucket", "content")), total, a[heads], b[heads], runs["place"][heads])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            heads = _heads(*rows[:2])  # equal runs of several batches are one
            n = np.add.reduceat(rows[2], heads) if len(heads) else rows[2]
            rows = rows[:, heads]
            rows[2] = np.minimum(n, 2)
            # The last bucket may go on; one that is too large already needs no more than that many rows to be known.
            last = int(np.searchsorted(rows[0], rows[0][-1])) if rows.shape[1] else 0
            if last:
                yield verdict(rows[:, :last], first, False)
                first = False
            held = rows[:, last:]
            if held.shape[1] > most + 1:
                yield verdict(held[:, :-1], True, True)  # dealt whatever follows
                held, first = held[:, -1:], True
        if held is not None and held.shape[1]:
            yield verdict(held, first, True)

    def verdict(rows: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        heads = _heads(rows[0])
        size = np.diff(np.append(heads, rows.shape[1]))
        state = np.where(size > most, _DEALT, np.where(size > 1, _SORTED, _COUNTED))
        if first:
            state[0] = _DEALT
        if last:
            state[-1] = _DEALT
        state = np.repeat(state, size)
        keep = (state > _COUNTED) | (rows[2] > 1)
        return _columns("bucket content n a b place state", *rows[:, keep], state[keep])

    rows = store.select("a", "b", "n", "runs").mapInArrow(counted, _CONTENT)
    dealt = rows.repartitionByRange("bucket", "content").sortWithinPartitions("bucket", "content")
    return dealt.mapInArrow(judged, _CONTENT + ", state bigint")


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _slices(contents: DataFrame, store: DataFrame, rules: RepeatRules) -> DataFrame:
    """Rows of _PIECE cut out of the stored texts: a run as one piece, or dealt by the bytes around its minimizer."""
    wanted = contents.groupBy("a", "b").agg(F.collect_list(F.struct("bucket", "content", "n", "place", "state")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, dealt = [], {}
            for packed, list_ in zip(batch.column("packed"), batch.column("wanted")):
                data = unpack(packed.as_py())
                for w in list_.as_py():
                    first, ahead, count = _unplaced(w["place"])
                    run = data[first : first + count + rules.width - 1]
                    if w["state"] == _DEALT:
                        for group, at, far, piece in _pieces(w["bucket"], ahead, count, run, rules):
                            dealt.setdefault((group, _xxh3(piece, seed=far)), []).append((w, at, far, piece))
                    else:
                        # A run that occurs again is sorted for the others' sake only.
                        rows.append((w["bucket"], w["content"], w["n"], ahead, run, *((w["bucket"], w["content"]) if w["n"] < 2 else (None, None)), 0, False))
            for (group, piece), found in dealt.items():
                w, at, far, text = found[0]
                if len(found) == 1 and w["n"] < 2:
                    rows.append((_signed(group), _signed(piece), 1, far, text, w["bucket"], w["content"], at, True))
                    continue
                rows.append((_signed(group), _signed(piece), 2, far, text, None, None, 0, True))
                for w, at, far, text in found:  # settled here
                    if w["n"] < 2:
                        rows.append((None, len(text), 2, far, None, w["bucket"], w["content"], at, True))
            yield _batch(rows, _PIECE)

    return store.select("a", "b", "packed").join(wanted, ["a", "b"]).select("packed", "wanted").mapInArrow(cut, _ddl(_PIECE))


#: ``ahead``: the minimizer's distance from the first string of the piece; (run_bucket, run_content, at): where the
#: piece begins in which run, null for a piece that is there to be compared with only.  Without a bucket the piece is
#: known to be repeated, and the content is its size.
_PIECE = pa.schema([(c, pa.int64()) for c in ("bucket", "content", "n", "ahead")] + [("bytes", pa.binary())] + [(c, pa.int64()) for c in ("run_bucket", "run_content", "at")] + [("dealt", pa.bool_())])
_FOUND = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("spans", pa.binary()), ("group", pa.int64()), ("string", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(bucket: int, ahead: int, count: int, run: bytes, rules: RepeatRules) -> Iterator[tuple[int, int, int, bytes]]:
    """(group, first string, distance, bytes) of the parts of a run, ``dealt_strings`` distances from the minimizer each.

    The strings of a part have the bytes from the least such distance before the
    minimizer to the end of the farthest one in common with every equal string,
    so these bytes name the group: equal strings meet, and the strings of a group
    differ in a few bytes at their ends only.
    """
    far, near = ahead, ahead - count + 1
    for part in range(near // rules.dealt_strings, far // rules.dealt_strings + 1):
        low, high = part * rules.dealt_strings, (part + 1) * rules.dealt_strings - 1
        most, least = min(high, far), max(low, near)
        after = max(rules.width - rules.anchor - high, 0)
        named = run[ahead - low : ahead + rules.anchor + after]
        at = ahead - most
        yield _xxh3(b"%d %d " % (bucket, part) + named), at, most, run[at : at + most - least + rules.width]


def _flag_spans(flags: np.ndarray, width: int, at: int = 0) -> bytes:
    """Flags of string starts as packed (first byte, byte after the last) pairs of covered bytes."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return (np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + width - 1], axis=1) + at).astype("<i4").tobytes()


#: Spreads buckets so that distances can be added; a clash of two groups only sorts them together.
_GROUP_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _strings(rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings a row, and the row and the start of each string in the joined bytes of the rows."""
    sizes = np.array([len(r[4]) for r in rows])
    counts = sizes - width + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return counts, owner, np.repeat(np.cumsum(sizes) - sizes, counts) + within


def _settled(pieces: DataFrame, rules: RepeatRules) -> DataFrame:
    """Rows of _FOUND: the repeated spans of each run, from sorting all strings of a bucket or group together.

    Buckets, which have ``bucket_runs`` at most, go to a task each.  Of the
    groups that larger ones were dealt to, ranges of (bucket, content) between
    sampled splitters go to tasks, so a great group goes to many.  Of a group
    that a task may not see whole, the first and the last one, and of a group of
    over ``group_bytes``, parts are sorted, and the strings that no other of the
    part equals are given back as (group, string, n, at), with one of each set of
    equal ones.
    """
    width = rules.width

    def found(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[tuple] = []  # whole groups
        mine: list[tuple] = []  # the last group
        out: list[tuple] = []
        size, here, last, open_ = 0, 0, None, not whole  # ``open_``: the last group may go on in another task or part
        for (group, piece), copies in groupby(rows, key=itemgetter(0, 1)):
            if last is not None and group != last:
                if open_:
                    yield settle(mine, True)
                else:
                    held += mine
                    size += here
                    if size > CHUNK_BYTES:
                        yield settle(held, False)
                        held, size = [], 0
                mine, here, open_ = [], 0, False
            last, row = group, next(copies)
            for other in copies:  # equal pieces repeat each other as a whole, and one of them stands for all
                out += ((r[5], r[6], struct.pack("<2i", r[7], r[7] + len(r[4])), None, None, None, None) for r in (row, other) if r[5] is not None)
                row = (group, piece, 2, row[3], row[4], None, None, 0, row[8])
                if len(out) > _OUT_ROWS:
                    yield _batch(out, _FOUND)
                    out = []
            mine.append(row)
            here += len(row[4])
            if here > rules.group_bytes and not whole:
                yield settle(mine, True)
                mine, here, open_ = [], 0, True
        yield settle(mine, not whole)
        yield settle(held, False)
        yield _batch(out, _FOUND)

    def settle(rows: list[tuple], part: bool) -> pa.RecordBatch:
        if not rows:
            return _batch([], _FOUND)
        counts, owner, starts = _strings(rows, width)
        ends = np.cumsum(counts)
        within = starts - starts[ends - counts][owner]
        # Equal strings hold their minimizer at the same distance, so only such strings are sorted together.
        bucket, ahead = (np.array([r[i] for r in rows], np.int64)[owner] for i in (0, 3))
        groups = (bucket.view(np.uint64) * _GROUP_MULTIPLIER) + (ahead - within).astype(np.uint64)
        data = b"".join(r[4] for r in rows)
        flags = equal_suffixes(np.frombuffer(data, np.uint8), starts, groups, width)
        out = [(r[5], r[6], _flag_spans(flags[e - c : e], width, r[7]), None, None, None, None) for r, c, e in zip(rows, counts, ends) if r[5] is not None and flags[e - c : e].any()]
        if part:
            view, known = memoryview(data), set()
            for i, (k, flag) in enumerate(zip(owner.tolist(), flags.tolist())):
                r = rows[k]
                string = _signed(_xxh3(view[starts[i] : starts[i] + width], seed=int(ahead[i] - within[i])))
                if flag or r[5] is None:
                    if string not in known:
                        known.add(string)
                        out.append((None, None, None, r[0], string, 2, None))
                else:
                    out.append((r[5], r[6], None, r[0], string, r[2], int(r[7] + within[i])))
        return _batch(out, _FOUND)

    buckets, groups = pieces.where("NOT dealt"), pieces.where("dealt AND bucket IS NOT NULL")
    by_bucket = buckets.repartition("bucket").sortWithinPartitions("bucket", "content").mapInArrow(lambda rows: found(rows, True), _ddl(_FOUND))
    by_range = groups.repartitionByRange("bucket", "content").sortWithinPartitions("bucket", "content").mapInArrow(lambda rows: found(rows, False), _ddl(_FOUND))
    return by_bucket.union(by_range)


def _equal_strings(apart: DataFrame, width: int) -> DataFrame:
    """The repeated spans of runs from strings that were given back one by one: those that are equal across parts."""
    again = apart.groupBy("group", "string").agg(F.sum("n").alias("times")).where("times > 1").select("group", "string")
    places = apart.where("bucket IS NOT NULL").join(again, ["group", "string"]).groupBy("bucket", "content").agg(F.collect_list("at").alias("places"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, content, places in zip(*(c.to_pylist() for c in batch.columns)):
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                rows.append((bucket, content, _flag_spans(flags, width)))
            yield _batch(rows, _SPANS)

    return places.mapInArrow(spans, _ddl(_SPANS))


_SPANS = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("spans", pa.binary())])


def repeated_spans(docs: DataFrame, text: str = "text", rules: RepeatRules = RepeatRules()) -> DataFrame:
    """(a, b, n_removed, n_spans, spans, kept_sha256) for each distinct text with a repeated byte.

    (a, b) is ``text_key``; ``spans`` are the maximal repeated byte ranges, from
    and to (exclusive), and the digest is of the bytes outside them.  A string
    counts as repeated if it starts at two places, in one text or in two rows.

    Whole copies are found first and kept once.  The strings of the remaining
    texts are cut into runs with one minimizer; runs that recur as a whole are
    settled by counting hashes; runs that share a minimizer but differ are
    fetched and all their strings sorted, bucket by bucket, large buckets in
    groups that no equal strings cross.
    """
    width = rules.width
    store = _distinct_texts(docs, F.col(f"`{text}`"), rules)
    contents = written(_contents(store, rules.bucket_runs), "contents")
    pieces = written(_slices(contents.where(F.col("state") > _COUNTED), store, rules), "pieces")
    found = written(_settled(pieces, rules), "repeats")
    apart = written(_equal_strings(found.where("string IS NOT NULL"), width), "strings")
    partly = found.where("string IS NULL").select("bucket", "content", "spans").union(apart)
    wholly = contents.where("n > 1").select("bucket", "content", F.lit(None).cast("binary").alias("spans"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, a, b, _ = _flat_runs(batch)
            yield _columns("bucket content a b place", runs["bucket"], runs["content"], a, b, runs["place"])

    placed = store.where("n = 1").select("a", "b", "n", "runs").mapInArrow(places, "bucket bigint, content bigint, a bigint, b bigint, place bigint")
    first, _, count = (F.expr(f"cast({x} as int)") for x in (f"shiftright(place, {2 * _PLACE_BITS})", "0", f"place & {_PLACE_MASK}"))
    known = pieces.where("bucket IS NULL").select(F.col("run_bucket").alias("bucket"), F.col("run_content").alias("content"), F.lit(None).cast("binary").alias("spans"), F.col("at").alias("at"), F.col("content").alias("size"))
    none = F.lit(None).cast("bigint")
    repeated = wholly.union(partly).select("*", none.alias("at"), none.alias("size")).union(known)
    marks = placed.join(repeated, ["bucket", "content"])
    from_ = (first + F.coalesce("at", F.lit(0))).cast("int")
    marks = marks.select("a", "b", from_.alias("from"), F.coalesce((from_ + F.col("size")).cast("int"), first + count + width - 1).alias("to"), "spans")
    gathered = marks.groupBy("a", "b").agg(F.collect_list(F.struct("from", "to", "spans")).alias("marks"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for a, b, n, packed, marks in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(unpack(packed), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if n > 1:
                    edge[[0, -1]] += (1, -1)
                for m in marks or ():
                    for i, j in [(0, m["to"] - m["from"])] if m["spans"] is None else np.frombuffer(m["spans"], "<i4").reshape(-1, 2).tolist():
                        edge[m["from"] + i] += 1
                        edge[m["from"] + j] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).astype("<i4")
                rows.append((a, b, int(gone.sum()), len(ends) // 2, ends.tobytes(), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield _batch(rows, _REMOVED)

    texts = store.select("a", "b", "n", "packed").join(gathered, ["a", "b"], "left").where("n > 1 OR marks IS NOT NULL")
    return texts.select("a", "b", "n", "packed", "marks").mapInArrow(removed, _ddl(_REMOVED))


_REMOVED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.binary()), ("kept_sha256", pa.string())])


def mark_repeats(docs: DataFrame, text: str = "text", rules: RepeatRules = RepeatRules(), spans: bool = True) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, kept_sha256 and, if ``spans``, the packed ``spans``, instead of its text.

    ``spans`` holds little-endian 32-bit (from, to) pairs, null where nothing is
    repeated; ``cut`` applies them.  A null text counts as empty; texts shorter
    than a string keep all; rows with equal texts get equal results, and two of
    them repeat each other from end to end.  An empty table stays empty.  Other
    columns pass; those named as a result are replaced.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = text_key(own)
    passed = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {text.lower(), *results}]
    rows = docs.select(F.struct(*passed).alias("__row") if passed else F.lit(None).alias("__row"), a.alias("__a"), b.alias("__b"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("__own"))
    found = repeated_spans(docs, text, rules)
    found = found if spans else found.drop("spans")
    joined = rows.join(found, (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = [F.col("n_bytes"), zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "__own").alias("kept_sha256")]
    return joined.select(*(["__row.*"] if passed else []), *out, *(["spans"] if spans else []))


def cut(text: Column, spans: Column) -> Column:
    """The bytes of a text outside its spans; they may end inside a character, so they are binary."""

    @F.arrow_udf("binary")
    def kept(texts: pa.Array, packed: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts, packed):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            for i, j in reversed(np.frombuffer(p.as_py(), "<i4").reshape(-1, 2).tolist() if p.is_valid else []):
                data = data[:i] + data[j:]
            out.append(data)
        return pa.array(out, pa.binary())

    return kept(text, spans)
