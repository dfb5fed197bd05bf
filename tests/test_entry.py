"""The registered queries against their SQL texts on the smallest tables."""

import sys

import pytest

import __spark_entry__ as entry
from check import compare, connect
from seqlytics.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
# the spread paths of these run in the other tests; the fits take long and have no SQL text
SLOW = {"policy_iteration", "predict_plan", "predict_sequence", "compare_models", "compare_regressors", "score_candidates_fitted"}
SLOW |= {"length_regression", "predict_length", "outcome_classifier", "action_classifier_cv"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pitch_sequencing_entropy" in df.columns


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.queries())


def test_names_without_the_corpus_parts(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("seqlytics.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "seqlytics.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(all_queries())
    assert set(entry.oracle_sql()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query(spark, con, name):
    good, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, note
