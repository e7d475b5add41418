import itertools
import json
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainmill.llm import bpe, flow, hamming, line_dedup, media, mixture, perfect_hash, quality_rules, repeated_bytes, sections, simhash, suffix_sort
from grainmill.plans import lineage
from tests.llm import cases as C

BPE = public_tokenizers.path("byte_bpe_50k.json")


def by_row(frame, *columns):
    """Rows as a sorted list of (id, text, columns...), for comparison as a multiset."""
    return sorted((tuple(r) for r in frame.select("doc_id", "text", *columns).collect()), key=repr)


def expected(function):
    return sorted(((r[0], r[1], *function(r[1])) for r in C.rows()), key=repr)


# Quality rules


def test_quality_rules_match_brute_force(spark):
    got = by_row(quality_rules.with_repetition_rules(C.documents(spark)), *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    assert got == expected(C.repetition)


def test_quality_rules_coverage_and_verdicts(spark):
    rules = quality_rules.RepetitionRules(coverage=((3, 0.5), (6, 0.1)))
    rows = quality_rules.with_repetition_rules(C.documents(spark), rules=rules).select("text", "rules.*").collect()
    for r in rows:
        words, chars, _, _, repeat = C.repetition(r.text)
        assert list(r.dup_chars) == [C.covered_chars(r.text, 3), C.covered_chars(r.text, 6)]
        assert r.base_failed == (words < 10 or 100 * repeat > 20 * words)
        within = r.dup_chars[0] <= 0.5 * chars and r.dup_chars[1] <= 0.1 * chars and r.dup_line_chars <= 0.3 * chars
        assert r.kept == (not r.base_failed and within)


# Line dedup


@pytest.mark.parametrize("rules", [line_dedup.LineRules(), line_dedup.LineRules(least_docs=2), line_dedup.LineRules(least_docs=2, shard_keys=3, round_bytes=1)])
def test_line_dedup_matches_brute_force(spark, rules):
    got = by_row(line_dedup.drop_common_lines(C.documents(spark), rules=rules), "lines.n_lines", "lines.n_dropped", F.col("lines.text").alias("left"))
    given = C.rows()
    want = sorted(((r[0], r[1], *x) for r, x in zip(given, C.lines_dropped([r[1] for r in given], rules.least_docs))), key=repr)
    assert got == want


def test_rounds_write_no_texts(spark, monkeypatch):
    rules = line_dedup.LineRules(least_docs=2, shard_keys=1, round_bytes=1)
    texts = ["\n".join([f"own {i}", *(f"shared {j}" for j in range(i, i + 30)), ""]) for i in range(8)]
    docs, tables = spark.createDataFrame(enumerate([*texts, None, texts[0]]), "doc_id long, text string"), []
    monkeypatch.setattr(line_dedup, "written", lambda df, label: tables.append((label, df.schema)) or lineage.written(df, label))
    got = by_row(line_dedup.drop_common_lines(docs, rules=rules), "lines.n_lines", "lines.n_dropped", F.col("lines.text").alias("left"))
    given = [r.text for r in docs.orderBy("doc_id").collect()]
    assert got == sorted(((i, t, *x) for (i, t), x in zip(enumerate(given), C.lines_dropped(given, 2))), key=repr)
    assert len(tables) > 20
    assert not [label for label, schema in tables if "string" in schema.simpleString()]


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 63, 20000, dtype=np.uint64), rng.integers(0, 50, 20000).astype(np.uint64)
    table = perfect_hash.CountTable.unpack(perfect_hash.CountTable(high, low, np.arange(20000)).pack())
    assert sorted(table.index(high, low)) == [*range(20000)]
    assert (table.get(high, low) == np.arange(20000)).all()
    assert not table.get(high + np.uint64(1), low).any()
    assert not perfect_hash.CountTable(high[:0], low[:0], np.arange(0)).get(high[:9], low[:9]).any()


# SimHash


def test_simhash_groups_match_brute_force(spark):
    given = C.rows()
    marks = [C.fingerprint(r[1]) for r in given]
    want = sorted(((r[0], m, c) for r, m, c in zip(given, marks, C.components([r[0] for r in given], marks))), key=repr)
    for rules in (simhash.SimHashRules(), simhash.SimHashRules(split_size=2, bucket_load=1)):
        rows = simhash.near_duplicate_groups(C.documents(spark), rules=rules).collect()
        assert sorted(((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in rows), key=repr) == want


def test_simhash_keeps_one_of_each_group(spark):
    given = C.rows()
    groups = C.components([r[0] for r in given], [C.fingerprint(r[1]) for r in given])
    kept = simhash.keep_one_per_group(C.documents(spark, more=True))
    assert kept.columns == C.documents(spark, more=True).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({g for g in groups if g is not None})
    assert ids.count(None) == 1  # the row without an id that has no near copy


@pytest.mark.parametrize("split_size", [3, 40, 500])
def test_large_buckets_lose_no_link(spark, split_size):
    rng = random.Random(split_size)
    base = rng.getrandbits(64)
    marks = {base ^ sum(1 << b for b in rng.sample(range(20, 44), rng.randint(0, 12))) for _ in range(400)}  # one bucket for every choice outside these bits
    marks = [m - (1 << 64) if m >> 63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in marks], "f0 long")
    rules = simhash.SimHashRules(split_size=split_size)
    roots = {r.f: r.root for r in simhash.fingerprint_components(frame, "f0", rules).collect()}
    want = C.components(marks, marks)
    groups = lambda keys: sorted(sorted(m for m, k in zip(marks, keys) if k == g) for g in set(keys))
    assert groups([roots.get(m, m) for m in marks]) == groups(want)


def test_a_large_bucket_costs_few_rows(spark):
    rules = simhash.SimHashRules()
    frame = spark.range(200_000).select(((F.xxhash64("id").bitwiseAND(F.lit((1 << 51) - 1))) * 4096).alias("f")).select("f", F.lit(0).alias("choice"), F.struct(F.lit(0).alias("choice"), F.lit(0).cast("long").alias("value")).alias("bucket"))
    sizes = frame.groupBy("bucket").count()
    dealt = simhash._in_shares(simhash._by_other_blocks(frame, [4095], sizes, rules), rules)
    assert dealt.count() <= 5 * 200_000
    assert dealt.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2 * rules.split_size


@pytest.mark.parametrize("budget", [0, 1, 4])
def test_trie_join_finds_every_component(budget):
    rng = np.random.default_rng(budget)
    f = rng.integers(0, 1 << 63, 60, dtype=np.uint64)[rng.integers(0, 60, 900)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * (rng.random(900) < 0.7).astype(np.uint64)
    group = rng.integers(0, 3, 900)
    a, b = hamming.link(group, f, budget)
    for g in range(3):
        own = np.unique(f[group == g])
        want = hamming.Forest(len(own))
        i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= budget, 1))
        want.unite(i, j)
        got = hamming.Forest(len(own))
        mine = np.isin(a, own) & np.isin(b, own)
        got.unite(np.searchsorted(own, a[mine]), np.searchsorted(own, b[mine]))
        assert (got.parent >= 0).all() and all(got.parent[k] == got.parent[want.parent[k]] for k in range(len(own)))


def test_block_masks_meet_for_every_pair_within_the_budget():
    rng = random.Random(3)
    for equal in (1, 2, 3):
        masks = [*hamming.block_masks(4, equal)]
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not bits & m for m in masks)


# Mixing


def test_min_cost_flow_is_cheapest():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b", "c"), 4)]
    flows = flow.route(patterns, {"a": 18, "b": 12, "c": 5}, 2)
    used = [sum(f.values()) for f in flows]
    assert sum(used) == 35 and all(u <= 2 * w for u, (_, w) in zip(used, patterns))
    assert sum(f.get("a", 0) for f in flows) == 18 and sum(f.get("c", 0) for f in flows) == 5
    # 24 words once and 11 again is the cheapest way to give 35.
    assert [u - w for u, (_, w) in zip(used, patterns) if u < w] == []
    assert flow.route([((None,), 0)], {None: 0}, 2) == [{None: 0}]


@pytest.mark.parametrize("seed", range(40))
def test_min_cost_flow_matches_exhaustive_search(seed):
    rng = random.Random(seed)
    names = "abc"[: rng.randint(1, 3)]
    patterns = [(tuple(rng.sample(names, rng.randint(1, len(names)))), rng.randint(0, 3)) for _ in range(rng.randint(1, 4))]
    quotas = {s: rng.randint(0, 5) for s in names}
    cost = lambda used, words: sum(2 * (i // words) + 1 for i in range(used))

    def ways(i, need):
        """(given, cost) of every way to give the words of the patterns from i on."""
        if i == len(patterns):
            yield 0, 0
            return
        sources, words = patterns[i]
        for given in itertools.product(*(range(min(need[s], 2 * words) + 1) for s in sources)):
            if sum(given) <= 2 * words:
                for more, price in ways(i + 1, need | {s: need[s] - g for s, g in zip(sources, given)}):
                    yield sum(given) + more, cost(sum(given), words) + price if words else price

    best = min((-given, price) for given, price in ways(0, quotas))
    flows = flow.route(patterns, quotas, 2)
    used = [sum(f.values()) for f in flows]
    assert all(v >= 0 for f in flows for v in f.values()) and all(sum(f.get(s, 0) for f in flows) <= quotas[s] for s in names)
    assert (-sum(used), sum(cost(u, w) for u, (_, w) in zip(used, patterns) if w)) == best


def test_ten_thousand_patterns_are_routed_in_seconds():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(60)]
    patterns = [(tuple(rng.sample(names, rng.randint(1, 4))), rng.randint(1, 10_000)) for _ in range(10_000)]
    size = sum(w for _, w in patterns)
    quotas = {s: int(1.5 * size * (1 + i % 3) / 120) for i, s in enumerate(names)}
    began = time.process_time()
    flows = flow.route(patterns, quotas, 2)
    assert time.process_time() - began < 10
    assert sum(sum(f.values()) for f in flows) == sum(quotas.values())


def test_targets_are_capped_and_shared_again():
    got = flow.capped_targets({"a": 10, "b": 100, "c": 50}, {"a": 3, "b": 1, "c": 2}, 240, 2)
    assert got["a"] == 20 and abs(sum(got.values()) - 240) < 1e-9 and got["c"] == 100 and got["b"] == 120
    assert flow.capped_targets({}, {}, 0, 2) == {}


def test_mix_meets_targets_and_repeats_itself(spark):
    docs = C.documents(spark, more=True)
    amounts, sources = mixture.mix_amounts(docs, F.array("source"))
    rows = amounts.collect()
    targets = {r.source: (r.source_size, r.target) for r in sources.collect()}
    assert len(rows) == len(C.rows())
    for source, (size, target) in targets.items():
        own = [r for r in rows if r.sources == [source]]
        assert sum(r["size"] for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= 3
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixture.mix_amounts(docs.repartition(5), F.array("source"))[0]
    assert sorted(map(repr, rows)) == sorted(map(repr, again.collect()))


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b", "a"], [], None][i % 5]) for i in range(50)], "doc_id long, text string, sources array<string>")
    amounts, sources = mixture.mix_amounts(docs, F.col("sources"), rules=mixture.MixRules(weights=(1, 1, 1), share=1.0))
    assert {r.source: r.source_size for r in sources.collect()} == {"a": 300, "b": 200, None: 200}
    assert abs(amounts.agg(F.sum("taken")).first()[0] - 500) <= 2  # each target is rounded to a word
    rows = mixture.mix_documents(docs, F.col("sources"), rules=mixture.MixRules(weights=(1, 1, 1), share=1.0))
    assert rows.columns == docs.columns and abs(rows.count() - 50) <= 3


# BPE


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(BPE)
    want = expected(lambda t: (library.encode(t or "", add_special_tokens=False).ids, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)))
    assert by_row(bpe.with_bpe(C.documents(spark), BPE), "ids", "decoded") == want


def test_bpe_matches_the_library_on_odd_texts(monkeypatch):
    library, mine = Tokenizer.from_file(BPE), bpe.Encoder(open(BPE, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 50)
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|endoftext", " ", "\n", "'s", "'", "don't", "1", "éa", "中", "🙂", "՘", "\U0003134b", "\U0003fc3d", "\x85", "\xa0", "​", "\x1c", "A", "tion", "!!", "  ", "\t", "\r\n", "é", "͸", "aaaaaaaa", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


# Token counts


@pytest.mark.parametrize("rule", sections.RULES)
def test_section_counts(spark, rule):
    library = Tokenizer.from_file(BPE)
    rows = sections.count_section_tokens(C.documents(spark, more=True), BPE, rules=sections.SectionRules(boundary=rule, separator="e")).where("doc_id IS NOT NULL").select("doc_id", "text", "section.*").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.section)):
        found.setdefault(r.doc_id, []).append(r)
    for own in found.values():
        text = own[0].text or ""
        data = text.encode()
        assert own[0]["from"] == 0 and max(r["to"] for r in own) == len(data)
        copies = sum(r.section == 0 for r in own)
        own = own[::copies]
        encoding, want, at = library.encode(text, add_special_tokens=False), [0.0] * len(own), 0
        sizes = [len(bpe_bytes(i)) for i in encoding.ids]
        for size in sizes:
            shares = [max(0, min(at + size, r["to"]) - max(at, r["from"])) for r in own]
            hit = [k for k, s in enumerate(shares) if s]
            if rule == "split":
                for k in hit:
                    want[k] += shares[k] / size
            else:
                want[{"start": hit[0], "end": hit[-1], "majority": max(hit, key=lambda k: shares[k])}[rule]] += 1
            at += size
        assert np.allclose([r.n_tokens for r in own], want)


_ENCODER = None


def bpe_bytes(i):
    global _ENCODER
    _ENCODER = _ENCODER or bpe.Encoder(open(BPE, encoding="utf-8").read())
    return _ENCODER.bytes_of[i]


# Repeated bytes


@pytest.mark.parametrize("rules", [repeated_bytes.RepeatRules(width=40, anchor=12), repeated_bytes.RepeatRules(width=40, anchor=12, bucket_runs=1), repeated_bytes.RepeatRules(width=40, anchor=12, bucket_runs=1, group_bytes=60), repeated_bytes.RepeatRules(), repeated_bytes.RepeatRules(width=9, anchor=9)])
def test_repeated_bytes_match_brute_force(spark, rules):
    given = C.rows()
    want = sorted(((r[0], *x) for r, x in zip(given, C.repeated_bytes([r[1] for r in given], rules.width))), key=repr)
    marked = repeated_bytes.mark_repeats(C.documents(spark, more=True), rules=rules)
    got = sorted((tuple(r) for r in marked.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == want
    assert {"size", "bucket", "a", "b", "n"} <= {*marked.columns}


@pytest.mark.parametrize("rules", [repeated_bytes.RepeatRules(), repeated_bytes.RepeatRules(bucket_runs=3), repeated_bytes.RepeatRules(bucket_runs=3, group_bytes=500)])
def test_one_passage_between_many_texts_and_swapped_letters(spark, rules):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, texts = prose(90), []
    for i in range(60):  # one bucket holds a run of each text at both ends of the passage
        texts.append(f"{prose(rng.randint(0, 40))} {passage[rng.randint(0, 3) :]} {prose(rng.randint(0, 40))}")
    texts += [C.thue_morse(1024), C.thue_morse(1024, "ba"), "a" * 700, "ab" * 300, texts[0], texts[1] + "!", passage, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4, "doc_id")
    got = sorted(tuple(r) for r in repeated_bytes.mark_repeats(docs, rules=rules).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(i, *x) for i, x in enumerate(C.repeated_bytes(texts, rules.width))]


@given(st.lists(st.text("ab", max_size=60), max_size=6), st.integers(5, 14))
def test_equal_strings_of_dealt_runs_meet(texts, width):
    """Every two equal strings get the same group and distance, and each string of a run is in one piece."""
    rules = repeated_bytes.RepeatRules(width=width, anchor=3, dealt_strings=3)
    groups = {}
    for t in texts:
        data = t.encode()
        for first, ahead, count, bucket, _ in zip(*(x.tolist() for x in repeated_bytes.anchored_runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), rules))):
            run, seen = data[first : first + count + width - 1], []
            for group, at, far, piece in repeated_bytes._pieces(bucket, ahead, count, run, rules):
                for i in range(len(piece) - width + 1):
                    assert piece[i : i + width] == run[at + i : at + i + width]
                    seen.append(at + i)
                    groups.setdefault(piece[i : i + width], set()).add((group, far - i))
            assert sorted(seen) == [*range(count)]
    assert all(len(g) == 1 for g in groups.values())


def test_cut_removes_the_spans(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, None)], "doc_id long, text string")
    spans = F.when(F.col("doc_id") == 1, F.lit(bytearray(struct.pack("<4i", 0, 2, 4, 5))))
    assert [bytes(r[0]) for r in docs.orderBy("doc_id").select(repeated_bytes.cut(F.col("text"), spans)).collect()] == [b"cdf", b""]


@pytest.mark.parametrize("width", [3, 8, 20, 64])
def test_suffix_sort_matches_brute_force(width):
    from collections import Counter

    rng = np.random.default_rng(width)
    for symbols in (2, 30):
        part = rng.integers(0, symbols, 400, dtype=np.uint8)
        data = np.concatenate([part, part[50:250], part[60:260], np.full(200, 1, np.uint8)])
        starts = rng.permutation(len(data) - width + 1)
        groups = rng.integers(0, 2, len(starts)).astype(np.uint64)
        counts = Counter((int(g), data[s : s + width].tobytes()) for s, g in zip(starts, groups))
        want = [counts[int(g), data[s : s + width].tobytes()] > 1 for s, g in zip(starts, groups)]
        assert suffix_sort.equal_suffixes(data, starts, groups, width).tolist() == want


# Media


def test_media_round_trip_and_digest(spark):
    def want(text):
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.pack_wav(payload)
        assert media.unpack_wav(stored) == payload and len(stored) == 44 + len(payload)
        return len(raw), len(payload), C.sha(payload), zlib.crc32(payload[-64:]), len(stored), C.sha(stored), "audio/wav"

    got = by_row(media.with_media_digest(C.documents(spark)), *(f"media.{c}" for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media_type")))
    assert got == expected(want)


@pytest.mark.parametrize("n", [0, 1, 64, 65])
def test_stored_payload_reads_back_elsewhere(n):
    import io
    import wave

    payload = random.Random(n).randbytes(n)
    with wave.open(io.BytesIO(media.pack_wav(payload))) as stored:
        assert (stored.getnchannels(), stored.getsampwidth(), stored.getframerate(), stored.getnframes()) == (1, 1, media.SAMPLE_RATE, n)
        assert stored.readframes(n) == payload


@pytest.mark.parametrize("unit", [
    *(b"\0" * at + magic + more for magic, at in media.MAGIC.values() for more in (b"", b"1.4 ", b"\0")),
    b"GIF89a\1\0\1\0\0\0\0\x21\xf9\x04abcd", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + b"x" * 17, b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab",
    b"RIFF" + struct.pack("<I", 200_000) + b"WAVEdata\1\0\0\0xx", b"%PDF-1.startxref", b"PK\3\4PK\5\6", b"\x1f\x8b\x08\x08",
])
def test_dense_magic_takes_time_in_proportion(unit):
    took = []
    for size in (200_000, 800_000):
        began = time.process_time()
        media.sniff((unit * (size // len(unit) + 1))[:size])
        took.append(time.process_time() - began)
    assert took[1] < max(8 * took[0], 1.0)


def png(width=1):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b";"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"


def test_sniffing_finds_valid_files_only():
    import gzip
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    files = {"image/png": png(), "image/gif": GIF, "application/pdf": PDF, "application/zip": packed.getvalue(), "application/gzip": gzip.compress(b"hello " * 50), "image/bmp": bmp, "audio/wav": media.pack_wav(b"abc"),
             "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab123\xff\x00\xff\xd9", "audio/ogg": b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc", "video/mp4": struct.pack(">I4sI4s", 12, b"ftyp", 0, struct.pack(">I", 8)) [:12] + struct.pack(">I4s", 8, b"mdat")}
    for kind, data in files.items():
        found = media.sniff(b"junk RIFF BM GIF8 " + data + b" tail %PDF-1.")
        assert [(f.media_type, f.start, f.length) for f in found if f.media_type == kind] == [(kind, 18, len(data))], kind
        assert media.corrected_type("text/plain", media.sniff(data)) == kind
        assert not [f for f in media.sniff(data[:-1]) if f.start == 0 and f.length == len(data)]
    assert not media.sniff(b"GIF89a BM RIFF \xff\xd8\xff PK\x03\x04 %PDF-1.4 OggS fLaC ftyp")
    damaged = bytearray(png())
    damaged[20] ^= 1
    assert not media.sniff(bytes(damaged))


def test_carving(spark):
    outer = media.pack_wav(b"xx" + png(2) + b"yy" + GIF)
    rows = spark.createDataFrame([(outer, "image/png"), (None, "x"), (b"plain", "text/plain")], "blob binary, declared string")
    got = rows.select(media.media_features(F.col("blob"), F.col("declared")).alias("f")).select("f.*").collect()
    assert got[0].media_type == "audio/wav" and [bytes(c) for c in got[0].carved] == [png(2), GIF]
    assert got[1].feature is None and got[2].media_type == "text/plain" and got[2].carved == []


# Empty tables


def test_empty_tables(spark):
    docs = C.empty(spark)
    assert quality_rules.with_repetition_rules(docs).count() == 0
    assert line_dedup.drop_common_lines(docs).count() == 0
    assert simhash.near_duplicate_groups(docs).count() == 0 and simhash.keep_one_per_group(docs).count() == 0
    assert [x.count() for x in mixture.mix_amounts(docs, F.array("source"))] == [0, 0] and mixture.mix_documents(docs, F.array("source")).count() == 0
    assert bpe.with_bpe(docs, BPE).count() == 0 and sections.count_section_tokens(docs, BPE).count() == 0
    assert repeated_bytes.mark_repeats(docs).count() == 0 and media.with_media_digest(docs).count() == 0


def test_clashing_columns_pass(spark):
    docs = C.documents(spark, more=True)
    n = docs.count()
    for made in (quality_rules.with_repetition_rules(docs), line_dedup.drop_common_lines(docs), bpe.with_bpe(docs, BPE), media.with_media_digest(docs)):
        assert made.where("size = 'own' AND `from` = 'own'").count() == n
    assert mixture.mix_documents(docs, F.array("source")).columns == docs.columns


def test_other_vocabulary_files_are_refused():
    spec = json.loads(open(BPE, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="vocabulary file"):
            bpe.Encoder(json.dumps(spec | change), {})
