"""The near-copy stage against the similarity of all pairs."""

import random

import corpus_pipeline
from grainmill.llm import near_copies
from tests.llm import cases as C


def kept(rows):
    groups = C.similar([t for _, t in rows])
    return sorted(min(d for (d, _), of in zip(rows, groups) if of == g) for g in set(groups))


def changed_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for n in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(1, 6)):
            copy[at] = word()
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], C.SCHEMA).repartition(3)


def test_changed_copies_from_the_similarity_on(spark):
    rows = changed_copies()
    made = near_copies.keep_one_near_copy(frame(spark, rows))
    assert sorted(r.doc_id for r in made.collect()) == kept(rows)
    assert 60 < len(kept(rows)) < 110  # pairs on either side of the limit


def test_pipeline_stage_leaves_no_near_copies(spark):
    rows = changed_copies()
    made = corpus_pipeline.simhash_dedup(spark, frame(spark, rows), "nowhere")
    assert sorted(r.doc_id for r in made.collect()) == kept(rows)


def test_group_dealt_in_shares(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(0, 200, 5)]
    made = near_copies.keep_one_near_copy(frame(spark, rows), rules=near_copies.NearCopyRules(split_size=8))
    assert [r.doc_id for r in made.collect()] == kept(rows) == [0]
