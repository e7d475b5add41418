"""The pipeline and the registered queries against plain definitions, each stage on its own input."""

from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from grainmill.llm import flow, queries
from tests.llm import cases as C


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    C.documents(spark).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(folder))
        made.write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return str(folder), out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(made.columns == given.columns for given, made in stages[1][:-1])


def test_quality_stage(stages):
    given, made = stages[1][0]
    assert Counter(rows(made)) == Counter(r for r in rows(given) if C.passes_rules(r[1]))


def test_line_stage(stages):
    given, made = stages[1][1]
    before = rows(given)
    assert Counter(rows(made)) == Counter((r[0], x[2]) for r, x in zip(before, C.lines_dropped([t for _, t in before], 10)))
    assert made.where("n_chars <> length(text)").count() == 0


def test_simhash_stage(stages):
    given, made = stages[1][2]
    before = rows(given)
    groups = C.similar([t for _, t in before])
    ids = {}
    for (d, _), g in zip(before, groups):
        ids.setdefault(g, []).append(d)
    want = [min((d for d in of if d is not None), default=None) for of in ids.values()]
    assert sorted(rows(made.select("doc_id", F.lit("").alias("text"))), key=repr) == sorted([(d, "") for d in want], key=repr)
    assert len(want) < len(before)


def test_mix_stage(stages):
    given, made = stages[1][3]
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    before, after = size(given), size(made)
    names = sorted(before, key=lambda s: (s is None, s or ""))
    targets = flow.capped_targets({s: before[s] for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(before.values()), 2)
    longest = max(len(C.WORD.findall(t or "")) for _, t in rows(given))  # the document at the cut comes whole or not at all
    assert all(abs(after.get(s, 0) - targets[s]) <= longest / 2 + 1 for s in names)
    assert max(Counter(rows(made)).values()) <= 2 * max(Counter(rows(given)).values())


def test_bpe_stage(stages):
    given, made = stages[1][4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, tuple(library.encode(t, add_special_tokens=False).ids), C.sha(t.encode())) for d, t in rows(given))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in made.collect()) == want


def test_run_is_the_stages(spark, stages):
    folder, out = stages
    assert Counter(map(repr, corpus_pipeline.run(spark, folder).collect())) == Counter(map(repr, out[-1][1].collect()))


def test_registered_queries_return_a_row_for_each_document(spark, stages):
    folder, n = stages[0], len(C.rows())
    spark.createDataFrame([(3, 1, 0), (6, 0, 1), (9, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert sorted(queries.QUERIES) == sorted(f"op{i}_{x}" for i, x in enumerate(("media", "quality_classifier", "repeated_bytes", "source_mix", "line_dedup", "token_counts", "toxicity", "simhash", "bpe", "quality_rules"), 1))
    for name, query in queries.QUERIES.items():
        made = query(spark, folder)
        assert "doc_id" in made.columns
        assert made.count() == n or name == "op6_token_counts", name


def test_stages_on_empty_tables_and_odd_columns(spark):
    odd = C.documents(spark, more=True).withColumn("a.b", F.lit("own"))
    for docs, least in ((C.empty(spark), 0), (odd, 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, "nowhere")
            assert made.columns == docs.columns and made.count() >= least
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "nowhere").count() == docs.count()
