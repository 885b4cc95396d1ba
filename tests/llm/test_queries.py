"""The registered queries over the smallest tables, and the pipeline."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent)]

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from ledgerloom.llm.queries import QUERIES, SOURCE_WEIGHTS  # noqa: E402
from ledgerloom.llm.tables import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def test_vectors(spark):
    data = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    assert rows(QUERIES["op1_embeddings"](spark, SF)) == brute.vectors(data)


def test_substrings(spark, docs):
    want = sorted(((*w[:4], brute.sha(w[4])) for w in brute.repeats(docs, 200)), key=repr)
    assert rows(QUERIES["op2_substrings"](spark, SF)) == want


def test_near_duplicates(spark, docs):
    assert rows(QUERIES["op4_minhash"](spark, SF)) == brute.near(docs, 85)


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = sorted((
        (i, n, hit, len(found), brute.sha(",".join(found).encode()), hit > 0)
        for i, n, hit, found in brute.covered(docs, items, 10)
    ), key=repr)
    assert rows(QUERIES["op5_decontaminate"](spark, SF).drop("n_near")) == want


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_secrets"](spark, SF).collect()}
    for i, text in docs:
        base = brute.base_secrets(text)
        assert got[i].base_sha256 == brute.sha(base.encode())
        assert got[i].n_assign == base.count("assign:")


def test_shards(spark, docs):
    got = QUERIES["op10_shard"](spark, SF).collect()
    sizes = {i: (len((t or "").encode()) + 16, brute.crc(t or "")) for i, t in docs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == sizes


@pytest.mark.parametrize("name", ["op3_pack", "op6_mix_sources", "op7_quality", "op8_licenses"])
def test_whole_tables(spark, docs, name):
    df = QUERIES[name](spark, SF)
    ids = {i for r in df.collect() for i in (r.doc_ids if name == "op3_pack" else [r.doc_id])}
    assert ids == {i for i, _ in docs}


def test_one_row_of_each_near_group_stays(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcde"]
    near = [t + " more" for t in texts]
    data = [
        (1, texts[0], "x"), (1, texts[0], "y"), (2, near[0], "x"),  # a feed read twice
        (3, texts[1], "x"), (3, near[1], "x"),  # two near texts under one id
        (None, texts[2], "x"), (None, near[2], "x"), (None, texts[2], "x"),  # no id at all
        (None, texts[3], "x"), (5, near[3], "x"), (3, texts[4], "x"),
        (6, "", "x"), (None, None, "x"), (None, None, "x"),  # without words
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    df = df.withColumn("more", F.create_map("source", "doc_id"))
    left = corpus_pipeline.keep_distinct(spark, df, SF)
    assert left.columns == df.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    group = [next((t for t in texts if r[1] and r[1].startswith(t)), r[1]) for r in got]
    assert sorted(map(str, group)) == sorted([*texts, "", "None", "None"])
    assert {(i, g) for (i, _), g in zip(got, group, strict=True)} == {
        (1, texts[0]), (3, texts[1]), (None, texts[2]), (5, texts[3]), (3, texts[4]), (6, ""), (None, None),
    }


def test_pipeline(spark, docs):
    kept = table(spark, SF, "documents")
    columns, at = kept.columns, [kept.count()]
    for name, function in corpus_pipeline.STAGES[:4]:
        kept = function(spark, kept, SF)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        at.append(kept.count())
        if name == "MinHash near-dedup":
            left = [(r.doc_id, r.text) for r in kept.collect()]
            assert all(k for *_, k in brute.near(left, 80))
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            left = [(r.doc_id, r.text) for r in kept.collect()]
            assert not any(hit for _, _, hit, _ in brute.covered(left, items, 10))
    assert at[0] > at[1] > at[2] > at[3] > 0
    ids = {r.doc_id for r in kept.collect()}
    packed = corpus_pipeline.pack_tokens(spark, kept, SF)
    assert {i for r in packed.collect() for i in r.doc_ids} == ids
    assert SOURCE_WEIGHTS == (5, 2, 1)
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage_of", [corpus_pipeline.keep_distinct, corpus_pipeline.pack_tokens])
def test_batches_of_texts_are_bounded_by_bytes(spark, stage_of):
    def nbytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes])})

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat(id || ' ', 3000)").alias("text"))
    df = df.union(spark.createDataFrame([(900, "long " * (1 << 20))], df.schema)).coalesce(1)
    df = df.withColumn("source", F.lit("x"))
    assert stage_of(spark, df, SF).count() > 0
    sizes = sorted(r.n for r in df.mapInArrow(nbytes, "n long").collect())
    # The long text is a batch of its own or the last of one; no other passes the bound by much.
    assert sizes[-1] > 5 << 20 and sizes[-2] < 3 << 20 and len(sizes) > 3
