"""Media columns: storing payloads as samples, signature sniffing, validation and carving."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SAMPLE_RATE = 8000
WAV_HEADER = 44

# Magic bytes and their offset in the file, by media type.
MAGIC = {
    "audio/wav": (b"RIFF", 0),
    "image/webp": (b"RIFF", 0),
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/gif": (b"GIF8", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/bmp": (b"BM", 0),
    "audio/flac": (b"fLaC", 0),
    "audio/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "video/mp4": (b"ftyp", 4),
}

RESULT = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,media_type:string,feature:string>"


def pack_wav(payload: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; an odd payload gets the pad byte that chunks need."""
    pad = len(payload) & 1
    riff = struct.pack("<4sI4s", b"RIFF", WAV_HEADER - 8 + len(payload) + pad, b"WAVE")
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return b"".join((riff, form, struct.pack("<4sI", b"data", len(payload)), payload, b"\0" * pad))


def unpack_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


_STRIDE = 64


class Blob:
    """Bytes under test, with what the validators have learnt about them so far.

    Candidates of one format that lead into the same blocks share the rest of
    the walk, and trailers are searched for once, so that sniffing takes time in
    proportion to the data even where magic bytes are dense.
    """

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)
        self._places: dict[bytes, list[int]] = {}
        self._ends: dict[str, dict[int, int]] = {}
        self._failed: dict[str, bytearray] = {}
        self._strides: dict[int, int] = {}

    def places(self, word: bytes) -> list[int]:
        """Where a word begins, ascending."""
        if word not in self._places:
            self._places[word] = [m.start() for m in re.finditer(re.escape(word), self.data)]
        return self._places[word]

    def next(self, word: bytes, at: int) -> int:
        """The first place of a word from ``at`` on, -1 for none."""
        all_, i = self.places(word), bisect_left(self.places(word), at)
        return all_[i] if i < len(all_) else -1

    def last(self, word: bytes, before: int) -> int:
        """The last place of a word before ``before``, -1 for none."""
        i = bisect_left(self.places(word), before)
        return self.places(word)[i - 1] if i else -1

    def chunks(self, at: int, end: int) -> int:
        """Where the RIFF chunks from ``at`` on leave ``end`` behind or meet it.

        Files with other ends share their chunks, so strides of chunks are remembered.
        """
        while at + 8 <= end:
            ahead = self._strides.get(at, end + 1)
            if ahead <= end:
                at = ahead
                continue
            first = at
            for _ in range(_STRIDE):
                if at + 8 > end:
                    return at
                at += 8 + (size := struct.unpack_from("<I", self.data, at + 4)[0]) + (size & 1)
            self._strides[first] = at
        return at

    def walk(self, name: str, at: int, step: Callable[[bytes, int], int]) -> int:
        """Where a chain of blocks ends, 0 if it is broken.

        ``step`` gives the place of the next block, 0 for a broken one, or the
        negative of the end of the file.
        """
        if name not in self._failed:
            self._ends[name], self._failed[name] = {}, bytearray(self.n)
        ends, failed = self._ends[name], self._failed[name]
        path, end = array("q"), 0
        while 0 <= at < self.n:
            if known := ends.get(at, 0):
                end = known
                break
            if failed[at]:
                break
            failed[at] = 1  # until the end is found
            path.append(at)
            at = step(self.data, at)
            if at <= 0:
                end = -at
                break
        if end:
            ends.update(dict.fromkeys(path, end))
        return end


# Each validator takes (blob, start) and gives the length of a well-formed file that starts there, or 0.


def _riff(form: bytes) -> Callable[[Blob, int], int]:
    def valid(blob: Blob, start: int) -> int:
        data = blob.data
        if data[start + 8 : start + 12] != form or start + 12 > blob.n:
            return 0
        end = start + 8 + struct.unpack_from("<I", data, start + 4)[0]
        return end - start if start + 12 < end <= blob.n and blob.chunks(start + 12, end) == end else 0

    return valid


def _png(blob: Blob, start: int) -> int:
    def step(data: bytes, at: int) -> int:
        if at + 12 > len(data):
            return 0
        size, name = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data) or not name.isalpha():
            return 0
        return -end if name == b"IEND" else end

    def checked(data: bytes, at: int) -> int:
        after = abs(step(data, at))
        if not after or zlib.crc32(memoryview(data)[at + 4 : after - 4]) != struct.unpack_from(">I", data, after - 4)[0]:
            return 0
        return step(data, at)

    # Lengths first: checksums are read only of files that are whole.
    at = start + 8
    if blob.data[at : at + 8] != b"\0\0\0\x0dIHDR" or not blob.walk("png lengths", at, step):
        return 0
    return max(blob.walk("png", at, checked) - start, 0)


def _gif(blob: Blob, start: int) -> int:
    data = blob.data
    if data[start + 4 : start + 6] not in (b"7a", b"9a") or start + 13 > blob.n:
        return 0

    def sub_blocks(at: int) -> int:
        return blob.walk("gif blocks", at, lambda data, at: at + 1 + data[at] if data[at] else -(at + 1))

    def step(data: bytes, at: int) -> int:
        kind = data[at]
        if kind == 0x3B:
            return -(at + 1)
        if kind == 0x21:
            return sub_blocks(at + 2)
        if kind == 0x2C and at + 10 <= len(data):
            local = data[at + 9]
            return sub_blocks(at + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        return 0

    flags = data[start + 10]
    return max(blob.walk("gif", start + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), step) - start, 0)


def _jpeg(blob: Blob, start: int) -> int:
    def entropy(data: bytes, at: int) -> int:
        """One step in coded data: to the next marker, which ends the file or is a segment."""
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return 0
        kind = data[at + 1]
        return -(at + 2) if kind == 0xD9 else at + 2 if not kind or 0xD0 <= kind <= 0xD7 else -at

    def step(data: bytes, at: int) -> int:
        if at + 4 > len(data) or data[at] != 0xFF:
            return 0
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if size < 2:
            return 0
        if kind != 0xDA:
            return at + 2 + size
        end = blob.walk("jpeg data", at + 2 + size, entropy)
        return -end if end >= at + 4 + size and data[end - 2 : end] == b"\xff\xd9" else end

    return max(blob.walk("jpeg", start + 2, step) - start, 0)


def _bmp(blob: Blob, start: int) -> int:
    if start + 26 > blob.n:
        return 0
    size, zero, pixels, head = struct.unpack_from("<IIII", blob.data, start + 2)
    return size if zero == 0 and 26 <= pixels <= size and start + size <= blob.n and head in (12, 40, 108, 124) else 0


def _flac(blob: Blob, start: int) -> int:
    """Metadata blocks must be whole; frames run to the end of the data."""

    def step(data: bytes, at: int) -> int:
        if at + 4 > len(data):
            return 0
        after = at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        return (-len(data) if after <= len(data) else 0) if data[at] & 0x80 else after

    head = blob.data[start + 4 : start + 8]
    return max(blob.walk("flac", start + 4, step) - start, 0) if head[1:] == b"\0\0\x22" and not head[0] & 0x7F else 0


def _ogg(blob: Blob, start: int) -> int:
    def step(data: bytes, at: int) -> int:
        if at + 27 > len(data) or data[at : at + 5] != b"OggS\0":
            return 0
        n = data[at + 26]
        if at + 27 + n > len(data):
            return 0
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        return 0 if end > len(data) else -end if data[at + 5] & 4 else end

    return max(blob.walk("ogg", start, step) - start, 0)


def _pdf(blob: Blob, start: int) -> int:
    data = blob.data
    if data[start + 5 : start + 6] not in (b"1", b"2") or data[start + 6 : start + 7] != b".":
        return 0
    end = blob.next(b"%%EOF", start)
    mark = blob.last(b"startxref", end)
    if mark < start or blob.next(b"%%EOF", mark) != end:
        return 0

    def number(data: bytes, at: int) -> int:
        return -(end + 5) if data[at + 9 : end].strip().isdigit() else 0

    return max(blob.walk("pdf", mark, number) - start, 0)


def _zip(blob: Blob, start: int) -> int:
    data, end = blob.data, blob.next(b"PK\x05\x06", start)
    if end < 0 or end + 22 > blob.n:
        return 0
    size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
    central = end - size
    ok = central - offset == start and data[central : central + 4] in (b"PK\x01\x02", b"PK\x05\x06")
    return end + 22 + comment - start if ok and end + 22 + comment <= blob.n else 0


def _gzip(blob: Blob, start: int) -> int:
    data = blob.data
    flags, at = data[start + 3] if start + 10 <= blob.n else 0xFF, start + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for text in (8, 16):  # name and comment end with a zero byte
        if flags & text:
            at = blob.next(b"\0", at) + 1
            if not at:
                return 0
    body = at + 2 if flags & 2 else at
    return max(blob.walk("gzip", body, _inflated) - start, 0)


def _inflated(data: bytes, at: int) -> int:
    """The negative end of a deflated body with its checksum and size, 0 if it is not whole."""
    unpack, crc, size, view, i = zlib.decompressobj(-15), 0, 0, memoryview(data), at
    try:
        while i < len(data) and not unpack.eof:
            part = unpack.decompress(view[i : i + 65536], 1 << 20)
            i += 65536
            while True:
                crc, size = zlib.crc32(part, crc), size + len(part)
                if not unpack.unconsumed_tail:
                    break
                part = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0
    if not unpack.eof:
        return 0
    end = min(i, len(data)) - len(unpack.unused_data) + 8
    return -end if end <= len(data) and struct.unpack_from("<II", data, end - 8) == (crc, size & 0xFFFFFFFF) else 0


def _mp4(blob: Blob, start: int) -> int:
    def step(data: bytes, at: int) -> int:
        """To the next box; the boxes end at the first place that is none."""
        size, kind = struct.unpack_from(">I4s", data, at) if at + 8 <= len(data) else (0, b"")
        after = at + size
        whole = size >= 8 and after <= len(data) and kind.isalnum()
        return (after if after < len(data) else -after) if whole else -at

    def bodies(data: bytes, at: int) -> int:
        after = step(data, at)
        return -1 if after > 0 and data[at + 4 : at + 8] in (b"moov", b"mdat") else after if after > 0 else -1 if -after > at and data[at + 4 : at + 8] in (b"moov", b"mdat") else 0

    return max(blob.walk("mp4", start, step) - start, 0) if blob.walk("mp4 bodies", start, bodies) else 0


VALIDATORS: dict[str, Callable[[Blob, int], int]] = {
    "audio/wav": _riff(b"WAVE"),
    "image/webp": _riff(b"WEBP"),
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "audio/flac": _flac,
    "audio/ogg": _ogg,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
    "video/mp4": _mp4,
}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    kinds: dict[bytes, list[tuple[str, int]]] = {}
    for kind, (magic, offset) in MAGIC.items():
        kinds.setdefault(magic, []).append((kind, offset))
    for magic, of in kinds.items():
        made.add_word(magic.decode("latin-1"), (len(magic), of))
    made.make_automaton()
    return made


_SIGNATURES = _automaton()


@dataclass(frozen=True)
class Found:
    media_type: str
    start: int
    length: int


def sniff(data: bytes) -> list[Found]:
    """Every validated media file in the data, by start; one that lies inside another is listed too.

    One pass of an Aho-Corasick automaton over all magic bytes finds the
    candidates, and a candidate counts only if its format's structure and
    lengths hold.
    """
    found, blob = {}, Blob(data)
    for end, (size, kinds) in _SIGNATURES.iter(data.decode("latin-1")):
        for kind, offset in kinds:
            start = end + 1 - size - offset
            if start >= 0 and (length := VALIDATORS[kind](blob, start)):
                found[start, kind] = Found(kind, start, length)
    return [found[k] for k in sorted(found)]


def corrected_type(declared: str | None, found: list[Found]) -> str | None:
    """The validated type of a file that starts at byte 0, else what was declared."""
    return next((f.media_type for f in found if f.start == 0), declared)


def carve(data: bytes, found: list[Found]) -> list[bytes]:
    """The embedded files: all that were found but the one at byte 0."""
    return [data[f.start : f.start + f.length] for f in found if f.start]


def describe(found: list[Found], declared: str | None) -> str:
    inner = ",".join(f"{f.media_type}@{f.start}+{f.length}" for f in found if f.start)
    return f"declared={declared};type={corrected_type(declared, found)};embedded={inner or 'none'}"


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of a text in UTF-8, and it with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def with_stored_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Every row with the WAV file of its text's payload in the binary column ``media``.

    The payload is the text in UTF-8 (null: empty) with zero bytes up to a
    positive multiple of 64, one byte to an 8-bit sample, so nothing is lost.
    Spark's strings end at 2 GiB, below the 4 GiB that the format can say.
    A column named as ``media`` is replaced.
    """

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([pack_wav(padded(t.as_py())[1]) for t in texts], pa.binary())

    return docs.withColumn(media, stored(F.col(f"`{text}`")))


def media_features(media: Column, declared: Column) -> Column:
    """A struct of the corrected type, the carved files and a feature text of a binary column (null: null)."""

    @F.arrow_udf("struct<media_type:string,carved:array<binary>,feature:string>")
    def features(blobs: pa.Array, kinds: pa.Array) -> pa.Array:
        types, carved, features = [], [], []
        for blob, kind in zip(blobs, kinds):
            data, said = blob.as_py(), kind.as_py()
            found = sniff(data or b"")
            types.append(corrected_type(said, found))
            carved.append(carve(data or b"", found))
            features.append(describe(found, said) if data is not None else None)
        return pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(carved, pa.list_(pa.binary())), pa.array(features, pa.string())], ["media_type", "carved", "feature"])

    return features(media, declared)


def payload_features(text: Column, declared: str = "application/octet-stream") -> Column:
    """The digest struct of a text column: stored as WAV, sniffed, and read back from the stored bytes."""

    @F.arrow_udf(RESULT)
    def features(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            n, payload = padded(t.as_py())
            media = pack_wav(payload)
            found = sniff(media)
            kind = corrected_type(declared, found)
            if kind != "audio/wav":
                raise ValueError(f"stored bytes read back as {kind}")
            back = unpack_wav(media)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), kind, describe(found, declared)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(types)
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media_type", "feature"]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types)], names)

    return features(text)


def with_media_digest(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Every row with the struct ``out`` of ``payload_features``.

    One pass, no shuffle, one document in memory at a time besides its batch.
    A null text counts as empty and is stored as 64 zero samples.  Equal texts
    give equal values.  A column named as ``out`` is replaced; others pass.
    """
    return docs.withColumn(out, payload_features(F.col(f"`{text}`")))
