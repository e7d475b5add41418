"""Byte-level BPE: merges by a priority queue over a doubly linked list of symbols."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Distinct pieces whose ids a Python worker remembers; as many more, the last before these, are held until this fills again.
REMEMBERED_PIECES = 150_000

_PLACE_BITS = 32
_PLACES = (1 << _PLACE_BITS) - 1

#: Stands for a character that counts as neither letter nor number.
_OTHER = "§"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in for each byte in the vocabulary file: itself, or the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def newer_letters() -> dict[int, str]:
    """Letters and numbers of this Unicode version that the tokenizer library, with an older one, takes for other characters."""
    import unicodedata

    from tokenizers import pre_tokenizers

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    # After a mark a letter begins a piece of its own and any other character does not.
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    begins = {start for _, (start, _) in split("".join(f"!{c} " for c in doubtful))}
    return {ord(c): _OTHER for i, c in enumerate(doubtful) if 3 * i + 1 not in begins}


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Memory(dict):
    """The ids of recent pieces.  A full memory becomes the older half, which gives way to the next."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self._merge = merge
        self._older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self._older.get(piece)
        if found is None:
            found = _packed(self._merge(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED_PIECES:
                self._older = dict(self)
                self.clear()
            self[piece] = found
        return found


def _checked(spec: dict) -> dict:
    """The vocabulary file, an error if it asks for what the encoder does not do."""
    parts = [spec["pre_tokenizer"], *(spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    split = next((p for p in parts if p and p["type"] == "ByteLevel"), {})
    model = spec["model"]
    asked = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": spec.get("normalizer") is not None,
        "a pre-tokenizer other than the byte-level one": not split or len([p for p in parts if p]) != 1 or not split.get("use_regex", True),
        "add_prefix_space": bool(split.get("add_prefix_space")),
        "dropout": bool(model.get("dropout")),
        "ignore_merges": bool(model.get("ignore_merges")),
        "a prefix or suffix of pieces": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "flags of added tokens": any(t.get(f) for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip")),
    }
    if found := [name for name, is_so in asked.items() if is_so]:
        raise ValueError(f"the vocabulary file has {', '.join(found)}")
    return spec


class Encoder:
    """Ids of whole texts, as the vocabulary file's own library gives them."""

    def __init__(self, vocabulary: str, newer: dict[int, str] | None = None):
        """``vocabulary``: the JSON text of a byte-level BPE tokenizer without normaliser; ``newer``: see newer_letters()."""
        spec = _checked(json.loads(vocabulary))
        to_byte, model = byte_symbols(), spec["model"]
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for symbol, i in model["vocab"].items():
            self.bytes_of[i] = bytes(to_byte[c] for c in symbol)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self._added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.byte_id = [0] * 256
        for symbol, b in to_byte.items():
            self.byte_id[b] = model["vocab"][symbol]
        self.rank_of: dict[int, int] = {}
        self.merged_id: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank_of.setdefault(model["vocab"][left] << 32 | model["vocab"][right], rank)
            self.merged_id.append(model["vocab"][left + right])
        self._newer = newer_letters() if newer is None else newer
        self._newer_set = frozenset(map(chr, self._newer))
        self._maybe_newer = regex.compile(f"[{chr(min(self._newer, default=0x10FFFF))}-\U0010ffff]")
        self._ids = _Memory(self.merge)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that are encoded one by one; joined they give the text."""
        if not text.isascii() and self._maybe_newer.search(text) and not self._newer_set.isdisjoint(text):
            same_lengths = text.translate(self._newer)
            return [text[m.start() : m.end()] for m in PIECES.finditer(same_lengths)]
        return PIECES.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest rank merges first, the leftmost of equals.

        A queue entry is a rank and a position; it is stale, and skipped, once
        the pair at the position no longer has that rank.
        """
        ids = [*map(self.byte_id.__getitem__, piece)]
        last = len(ids) - 1
        rank_of, merged_id = self.rank_of.get, self.merged_id
        queue = [r << _PLACE_BITS | i for i in range(last) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        before, after = [*range(-1, last)], [*range(1, last + 2)]
        after[last] = -1
        while queue:
            entry = heappop(queue)
            i, rank = entry & _PLACES, entry >> _PLACE_BITS
            j = after[i]
            if j < 0 or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i] = merged = merged_id[rank]
            ids[j] = -1
            after[i], after[j] = after[j], -1
            k = after[i]
            if k >= 0:
                before[k] = i
                if (r := rank_of(merged << 32 | ids[k])) is not None:
                    heappush(queue, r << _PLACE_BITS | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 32 | merged)) is not None:
                heappush(queue, r << _PLACE_BITS | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        parts = self._added.split(text) if self._added and any(a in text for a in self.added) else [text]
        found = [_packed([self.added[p]]) if p in self.added else b"".join(map(self._ids.__getitem__, self.pieces(p))) for p in parts]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: tuple[object, Encoder | None] = (None, None)


def encoder(shared) -> Encoder:
    """The encoder of a broadcast vocabulary, built once a Python worker."""
    global _loaded
    if _loaded[0] is not shared.value:
        _loaded = (shared.value, Encoder(*shared.value))
    return _loaded[1]


def share_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast: one or two MB, whatever the corpus."""
    return spark.sparkContext.broadcast((Path(path).read_text(encoding="utf-8"), newer_letters()))


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encoded(text: Column, shared) -> Column:
    """The ids of a text column (null: no ids)."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        one = encoder(shared)
        return _id_lists([one.encode(t.as_py() or "") for t in texts])

    return ids(text)


def round_trip(text: Column, shared) -> Column:
    """A struct of the ids of a text column and the text that they decode to; chained functions would encode twice."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        one = encoder(shared)
        found = [one.encode(t.as_py() or "") for t in texts]
        back = pa.array([one.decode(ids.tolist()) for ids in found], pa.string())
        return pa.StructArray.from_arrays([_id_lists(found), back], ["ids", "decoded"])

    return both(text)


def decoded(ids: Column, shared) -> Column:
    """The text of an id column (null: empty); bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        one = encoder(shared)
        return pa.array([one.decode(x.values.to_pylist() if x.is_valid else []) for x in lists], pa.string())

    return texts(ids)


def with_bpe(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded_text: str | None = "decoded") -> DataFrame:
    """Every row with its token ids and, unless ``decoded_text`` is None, the text that they decode to.

    ``path`` names a byte-level BPE file in the JSON form of public tokenizers;
    it is read once on the driver.  Texts are split by the byte-level pattern
    and strings of added tokens; each piece is merged by a heap of merge ranks
    over a doubly linked symbol list, where entries whose symbols have merged
    since are skipped.  Ids of recent pieces are remembered, up to a fixed
    number, per Python worker, so that memory is bounded.

    A null text counts as empty and gives an empty list and an empty text.
    Rows are independent; an empty table stays empty; columns named as the
    results are replaced.
    """
    shared = share_vocabulary(docs.sparkSession, path)
    if decoded_text is None:
        return docs.withColumn(ids, encoded(F.col(f"`{text}`"), shared))
    both = docs.withColumn("__bpe", round_trip(F.col(f"`{text}`"), shared))
    return both.withColumns({ids: F.col("__bpe.ids"), decoded_text: F.col("__bpe.decoded")}).drop("__bpe")
