"""The pipeline against brute force over each stage's own input, and the registered queries."""

import re

import pytest

import corpus_pipeline
from dyadspark.llm import queries
from dyadspark.llm.queries import word_vocabulary
from dyadspark.session import stored
from tests.llm.fixtures import DOC_SCHEMA, documents, near, prose
from tests.llm.test_dedup import plain, shingle_set
from tests.oracle import ROOT, compare, duck


def source(k):
    rows = [(k, prose(9000 + k, 40 + 3 * k)) for k in range(60)]
    rows += [(100 + k, " ".join(w + "###" for w in prose(k, 40).split())) for k in range(8)]
    rows += [(120 + k, rows[k][1].replace(" ", " \n")) for k in range(5)]
    rows += [(130 + k, near(rows[50][1], k, 1)) for k in range(4)]
    rows += [(140, f"{prose(1, 20)} {prose(2, 30)} {prose(3, 20)}"), (150, None), (151, ""), (None, prose(4, 50)), (3, rows[3][1])]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = source(0)
    folder = f"{tmp_path}/sf"
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, prose(2, 30)), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.schema.simpleString() == spark.createDataFrame([], DOC_SCHEMA).schema.simpleString()
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    prose_, distinct, different, unleaked = kept
    texts = {k: t for k, t in rows}
    assert {k for k, _ in prose_} >= {k for k, t in rows if k is None or k < 60 or 120 <= k <= 140}
    assert not {k for k, _ in prose_} & set(range(100, 108))
    assert sorted(plain(t) for _, t in distinct) == sorted({plain(t) for _, t in prose_})
    longest = {}
    for k, t in prose_:
        longest[plain(t)] = max(longest.get(plain(t), 0), len(t or ""))
    assert all(len(t or "") == longest[plain(t)] for _, t in distinct)
    left = {k: shingle_set(t) for k, t in distinct if k is not None}
    gone = set(left) - {k for k, _ in different}
    assert gone == {a for a in left for b in left if b < a and left[a] and 9 * len(left[a] & left[b]) >= 4 * (len(left[a]) + len(left[b]))}
    assert {k for k, _ in different} - {k for k, _ in unleaked} == {140}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == len(unleaked)
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(word_vocabulary())
    for r in last:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_empty_corpus(spark, tmp_path):
    folder = f"{tmp_path}/sf"
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_names_of_the_queries():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_against_sql(spark, key):
    folder = f"{ROOT}/sf0.001"
    assert compare(spark, duck(folder), key, queries.QUERIES[key], queries.ORACLES[key], folder).startswith("ok")
