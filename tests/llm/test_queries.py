"""The registered queries of the llm subpackage against their SQL texts on the smallest tables, and the pipeline's stages."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from seqlytics.llm.queries import QUERIES, winnowed

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query(spark, name):
    query, sql = QUERIES[name]
    good, note = compare(spark, connect(FOLDER), FOLDER, name, query, sql)
    assert good, note


def test_winnowed_short_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))) for n in range(22, 130)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = winnowed(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.near_edited > r.near_next for r in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[: len(docs.columns)] == docs.columns and {"shard", "shard_bytes"} <= set(out.columns)
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) < docs.count()
    most = {}
    for r in rows:
        most[r.doc_id] = most.get(r.doc_id, 0) + 1
    assert max(most.values()) <= 2
