import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import kneser_ney, quality_classifier, toxicity
from grainmill.llm.statistics import NAMES, document_statistics
from grainmill.llm.text import chunks
from tests.llm import cases as C
from tests.llm.cases import WORD, thue_morse

import pyarrow as pa


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    syllables = ["ba", "ko", "ri", "tun", "mel", "sa", "vi", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(30, 120))]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(["blarg", "snork"]))
        text = " ".join(f"{w.upper()}!!" if junk else w for w in words)
        docs.append((i, text, "x", "y", None))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(None, None, None, None, None), (9000, "", None, None, None), (9001, None, None, None, None), docs[3], docs[3]]
    labels += [(None, 1, 1), (9000, None, None), (3, 0, 0), (12345, 1, 1), (7, 5, 5)]
    return spark.createDataFrame(docs, C.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_rows(labelled):
    rows = quality_classifier.score_quality(*labelled).collect()
    assert len(rows) == 505 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
    right = [(r.score >= 0.3) == (r.doc_id % 5 != 0) for r in rows if r.held_out and r.doc_id < 500]
    assert sum(right) == len(right) > 50
    assert len({r.score for r in rows if r.doc_id == 3}) == 1


def test_toxicity_separates_held_out_rows(labelled):
    rows = toxicity.score_toxicity(*labelled).collect()
    assert len(rows) == 505 and all(0 <= r.score <= 1 for r in rows)
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 1) for r in rows if r.held_out and r.doc_id < 500]
    assert sum(right) == len(right) > 50


def test_scores_do_not_read_labels_of_the_held_out_fold(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{(r.doc_id, round(r.score, 9)) for r in quality_classifier.score_quality(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("score", [quality_classifier.score_quality, toxicity.score_toxicity])
def test_without_labels_or_rows(spark, labelled, score):
    docs, labels = labelled
    alone = score(docs, labels.limit(0)).collect()
    assert len(alone) == 505 and all(0 <= r.score <= 1 for r in alone)
    one_class = score(docs, labels.where("quality = 1 AND toxic = 0")).collect()
    assert all(0 <= r.score <= 1 for r in one_class)
    assert score(C.empty(spark), labels).count() == 0


def test_discriminant_matches_its_definition():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (400, 3)), 1: rng.normal(1, 2, (600, 3))}
    moments = {k: quality_classifier.Moments(len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}
    rules = quality_classifier.QdaRules(shrinkage=0.2, ridge=0.0, floor=0.0)
    model = quality_classifier.Qda.fit(moments, rules)
    spread = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = 0.4 * spread[0] + 0.6 * spread[1]
    density = []
    for k, prior in ((0, 0.4), (1, 0.6)):
        c = 0.8 * spread[k] + 0.2 * pooled
        d = x[1] - x[k].mean(axis=0)
        density.append(np.log(prior) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.log_odds(x[1]), density[1] - density[0])


def test_statistics_are_finite_for_any_text():
    texts = C.texts()
    rows = np.concatenate([document_statistics(c) for c in chunks(pa.array(texts, pa.string()), 2000)])
    assert rows.shape == (len(texts), len(NAMES)) and np.isfinite(rows).all()
    alone = np.concatenate([document_statistics(c) for t in texts for c in chunks(pa.array([t], pa.string()))])
    assert np.allclose(rows, alone)


def plain_models(texts, discount):
    """The class models by dictionaries: (vocabulary, a function (class, word before, word) -> probability)."""
    triples = [set(), set()]
    for text, y in texts:
        words = ["<s>", "<s>", *re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())]
        triples[y] |= {*zip(words, words[1:], words[2:])}
    pairs = [Counter((u, w) for _, u, w in t) for t in triples]
    words = [Counter(w for _, w in p) for p in pairs]
    both = words[0] + words[1]
    taken = lambda counts: sum(min(n, discount) for n in counts)

    def shared(w):
        return max(both[w] - discount, 0) / both.total() + taken(both.values()) / both.total() / (len(both) + 1)

    def alone(c, w):
        return max(words[c][w] - discount, 0) / words[c].total() + taken(words[c].values()) / words[c].total() * shared(w)

    def after(c, u, w):
        follow = {x: n for (v, x), n in pairs[c].items() if v == u}
        if not follow:
            return alone(c, w)
        total = sum(follow.values())
        return max(follow.get(w, 0) - discount, 0) / total + taken(follow.values()) / total * alone(c, w)

    return sorted(both), after


@pytest.mark.parametrize("discount", [0.75, 2.0, 4.0])
def test_probabilities_match_a_dictionary_and_sum_to_one(spark, discount):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["Idiot", "été"]
    weights = [2.0 ** -(i / 2) for i in range(14)]
    texts = [(" ".join(rng.choices(words, [*weights[:12], 0.3 * y, 0.1], k=rng.randint(1, 60))), y) for y in (0, 0, 1) for _ in range(15)]
    texts += [texts[0], (None, 0), ("", 1)]
    frame = spark.createDataFrame([(y, False, t) for t, y in texts], "y int, late boolean, text string")
    pairs = toxicity._triples(frame).groupBy("y", "u", "w").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("n_early"))
    rules = toxicity.ToxicityRules(model=kneser_ney.KneserNeyRules(discount=discount))
    model = kneser_ney.KneserNey(toxicity._counts(pairs, rules, early=False), rules.model)
    vocabulary, plain = plain_models(texts, discount)

    def hashes(names):
        (chunk,) = chunks(pa.array([" ".join(names)]))
        return kneser_ney.folded_words(chunk)[1]

    asked = [*vocabulary, "stranger"]
    keys = hashes(asked)
    for u, first in [("<s>", kneser_ney.START), *zip(vocabulary, keys), ("stranger", keys[-1])]:
        got = model.probabilities(np.full(len(keys), first, np.uint64), keys)
        assert np.allclose(got, [[plain(c, u, w) for c in (0, 1)] for w in asked], atol=1e-12)
        assert np.allclose(got.sum(axis=0), 1)


def test_evidence_is_the_length_normalised_difference(spark):
    rules = toxicity.ToxicityRules()
    texts = [("good day to all of you", 0)] * 3 + [(f"you {a} fool {b} fool", 1) for a in "abcdefgh" for b in "ijklmnop"]
    frame = spark.createDataFrame([(y, False, t) for t, y in texts], "y int, late boolean, text string")
    pairs = toxicity._triples(frame).groupBy("y", "u", "w").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("n_early"))
    model = kneser_ney.KneserNey(toxicity._counts(pairs, rules, early=False), rules.model)
    _, plain = plain_models(texts, rules.model.discount)
    asked = ["", "fool", "good fool day", "a fool of you fool to all fool"]
    (chunk,) = chunks(pa.array(asked))
    for text, (mean, top) in zip(asked, kneser_ney.evidence(chunk, model, 3)):
        words = ["<s>", *text.split()]
        ratios = [np.log(plain(1, u, w) / plain(0, u, w)) for u, w in zip(words, words[1:])]
        assert np.isclose(mean, np.mean(ratios or [0])) and np.isclose(top, sum(sorted(ratios)[-3:]) / 3)


def test_clashing_columns_do_not_matter(spark, labelled):
    docs, labels = labelled
    more = docs
    for name in ("y", "late", "u", "w", "n", "n_early", "score", "held_out", "statistics", "TEXT_", "quality", "toxic"):
        more = more.withColumn(name, F.lit("own"))
    for score in (quality_classifier.score_quality, toxicity.score_toxicity):
        got, want = ({(r.doc_id, round(r.score, 9)) for r in score(d, labels).collect()} for d in (more, docs))
        assert got == want


def plain_statistics(text):
    words, share = WORD.findall(text), lambda found, n: math.sqrt(found / max(n, 1))
    n, chars = len(words), sum(map(len, words))
    mean = chars / max(n, 1)
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / max(n, 1) - mean**2, 0))
    count = lambda alphabet: sum(c in alphabet for w in words for c in w)
    holding = lambda alphabet: sum(any(c in alphabet for c in w) for w in words) / max(n, 1)
    upper, lower, digits, stops = string.ascii_uppercase, string.ascii_lowercase, string.digits, ".,;:?'\"()-"
    symbols = "#*$%&<>@^~=+_{}[]\\/"
    plain = {*upper, *lower, *digits, *stops, *symbols, "|", "!"}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    fours, repeats = set(), 0
    for i in range(n - 3):
        repeats += (window := tuple(words[i : i + 4])) in fours
        fours.add(window)
    capital = sum(len(w) > 1 and any(c in upper for c in w) and not any(c in lower for c in w) for w in words)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(count(upper), chars), share(count(digits), chars), share(count(stops), chars),
        math.sqrt(holding(symbols)), math.sqrt(holding("|")), math.sqrt(holding("!")), share(capital, n), math.log1p(n / max(len(lines), 1)),
        share(len(lines) - len(set(lines)), len(lines)), share(repeats, n), share(sum(a == b for a, b in zip(words, words[1:])), n), len(set(words)) / max(n, 1),
        share(sum(c not in plain and ord(c) < 128 for w in words for c in w), chars),
    ]


def test_statistics_match_their_definitions():
    texts = [*filter(None, C.texts()), "A|b! a|B <x>\nAB AB a b c d a b c d\nAB AB a b c d a b c d\n\n12 {3} `q`\x01", "é É! 中文中文", thue_morse(1024) + "\n" + thue_morse(1024, "ba")]
    got = np.concatenate([document_statistics(c) for c in chunks(pa.array(texts), 3000)])
    for text, row in zip(texts, got):
        assert np.allclose(row, plain_statistics(text)), (text[:50], dict(zip(NAMES, row - plain_statistics(text))))
