"""The pipeline's stages against brute force, odd rows, and the registry."""

from __future__ import annotations

import random

import pytest
from llm_data import prose
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_lines

import __spark_entry__
import corpus_pipeline
from seqpack.llm import bpe, toxicity

DATA = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_the_registry_has_one_query_for_each_operator_and_the_pipeline():
    names = [*__spark_entry__.queries()]
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_toxic_documents_go(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    score = {r.doc_id: r.score for r in toxicity.op3_toxicity(spark, DATA).collect()}
    kept = STAGES["toxicity"](spark, docs, DATA)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and ids == {i for i, s in score.items() if s < corpus_pipeline.TOXIC}
    assert sum(i in ids for i, t in labels.items() if not t) > 0.97 * sum(not t for t in labels.values())


def test_lines_are_those_of_a_loop(spark, docs):
    got = {r.doc_id: (r.text, r.n_chars) for r in STAGES["line_dedup"](spark, docs, DATA).collect()}
    expected = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    same = {r.doc_id: r.text for r in docs.collect()}
    assert got == {d: (t, len(t)) for (d, _), t in expected.items() if t == same[d] or t.strip()}


def test_one_of_each_class_stays(spark):
    r = random.Random(1)
    base = [prose(r, 80) for _ in range(5)]
    rows = [(i, b if i % 3 else b.replace(" ", "  ", 1)) for i, b in enumerate(b for b in base for _ in range(6))] + [(100 + i, prose(r, 50)) for i in range(10)]
    rows += [(5, base[0]), (5, base[0]), (None, base[1]), (200, ""), (201, None), (201, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = STAGES["near_dedup"](spark, df, DATA)
    assert got.columns == df.columns
    wordy = [(i, t) for i, t in rows if t and i is not None]
    keep = {i for i, (*_, kept) in brute_components(dict(wordy).items()).items() if kept}
    assert sorted(x.doc_id for x in got.where("text is not null and text <> ''").collect()) == sorted(keep)
    assert got.where("text is null or text = ''").count() == 3


def test_documents_with_items_go(spark, docs):
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {r.doc_id for r in STAGES["decontamination"](spark, docs, DATA).select("doc_id").collect()}
    leaks = {r.doc_id for r in docs.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    assert leaks and got == {r.doc_id for r in docs.collect()} - leaks


def test_what_is_encoded_decodes(spark, docs):
    got = STAGES["bpe"](spark, docs.limit(50), DATA).collect()
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ids = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, name):
    out = STAGES[name](spark, odd_docs, DATA)
    if name != "bpe":
        assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    assert 0 < out.count() <= odd_docs.count()
    assert STAGES[name](spark, no_docs, DATA).count() == 0


def test_all_stages_in_a_row(spark, docs):
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, DATA)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(r.doc_id for r in step.select("doc_id").collect())
    assert whole.where(F.col("n_tokens") != F.size("ids")).count() == 0


def test_copies_alike_by_80_to_85_hundredths_go(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(8))
    base = [[word() for _ in range(104)] for _ in range(20)]
    # 100 shingles each; n changed words at the end change n of them: 90 of 110 (82), 88 of 112 (79)
    rows = [(10 * i + k, " ".join(w[: 104 - n] + [word() for _ in range(n)])) for i, w in enumerate(base) for k, n in enumerate((0, 10, 12 if i % 2 else 0))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = {x.doc_id for x in STAGES["near_dedup"](spark, df, DATA).collect()}
    assert got == {10 * i for i in range(20)} | {10 * i + 2 for i in range(1, 20, 2)}
