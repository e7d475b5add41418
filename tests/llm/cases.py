"""Small tables with the hard cases, and plain definitions of what the operators give."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = prose(70)
    out: list[str | None] = [None, "", " \n\t", "one", "a b c d", "\n\n", "é ß 中文 🙂 <|endoftext|> don't 's", "x" * 5000, "tie tie tie tie tie tie tie tie tie tie tie tie"]
    out += [prose(rng.randint(5, 120)) for _ in range(30)]
    out += [f"{prose(40)} {passage} {prose(30)}" for _ in range(5)]
    base = prose(150).split()
    for i in range(6):  # near copies
        changed = list(base)
        changed[i * 20] = "changed"
        out.append(" ".join(changed))
    whole = prose(90)
    out += [whole] * 4 + [whole + "!"]
    out += [f"{prose(8)}\n  Common LINE here \n{prose(8)}\nrare {i}" for i in range(12)]
    out += [prose(4000)]
    return out


def thue_morse(n: int, letters: str = "ab") -> str:
    """The first n letters of the Thue-Morse word; with the letters swapped, sums over powers of two cannot tell it apart."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def rows() -> list[tuple]:
    found = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"src{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts())]
    return [*found, (None, "a row without an id", None, None, None), (None, None, None, None, None), found[40], found[40]]


def documents(spark, more: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3, "text")
    if more:  # columns that might clash with working names
        from pyspark.sql import functions as F

        for name in ("size", "key", "sources", "a", "b", "n", "t", "bucket", "fingerprint", "score", "taken", "rules", "lines", "media", "ids", "TEXT_", "from", "shard"):
            df = df.withColumn(name, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repetition(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, later = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), later, len(inside)


def covered_chars(text: str | None, n: int) -> int:
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if windows[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside)


def passes_rules(text: str | None) -> bool:
    """The base rule and the limits on characters in repeated windows of 5, 7 and 10 words and in repeated lines."""
    words, chars, _, _, repeat = repetition(text)
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubled += sum(map(len, WORD.findall(line))) * (line in seen)
            seen.add(line)
    covered = all(covered_chars(text, n) <= share * chars for n, share in ((5, 0.30), (7, 0.25), (10, 0.20)))
    return words >= 10 and 100 * repeat <= 20 * words and doubled <= 0.30 * chars and covered


def similar(all_texts: list[str | None], width: int = 5, percent: int = 80) -> list[int]:
    """The first text of each text's component; links are shingle sets with the similarity."""

    def shingles(text):
        words = [w.lower() for w in WORD.findall(text or "")]
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}

    root, sets = [*range(len(all_texts))], [*map(shingles, all_texts)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def lines_dropped(all_texts: list[str | None], least: int) -> list[tuple[int, int, str]]:
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower()
    counts = Counter(k for t in all_texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in all_texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or counts[key(x)] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def fingerprint(text: str | None, width: int = 4) -> int:
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int | None], marks: list[int], budget: int = 4) -> list[int | None]:
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def repeated_bytes(all_texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in all_texts]
    starts = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if starts[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone) if not g))))
    return out
