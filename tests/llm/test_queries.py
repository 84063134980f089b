"""The numbered queries run over whole tables; those with SQL have its values."""

import pytest

from quillstone.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_there_is_one_query_for_each_number():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_the_pipeline_runs_and_its_decisions_take_effect(spark):
    import corpus_pipeline
    from quillstone.llm.staging import read, stage

    docs = read(spark, oracle.SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, oracle.SF), name)
        assert docs.columns == columns and docs.count() > 0
        if name == "near_duplicates":
            assert docs.count() < n and docs.select("doc_id").distinct().count() == docs.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, oracle.SF)
    assert tokens.count() == docs.count()


def test_each_stage_takes_awkward_rows_and_keeps_their_columns(spark):
    import corpus_pipeline
    from tests.llm.fixtures import clashing, documents, empty, rows

    odd, plain = clashing(spark), documents(spark)
    extra = [c for c in odd.columns if c not in plain.columns]
    outcomes = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, odd, oracle.SF)
        assert kept.schema == odd.schema, name
        found = kept.toArrow().to_pylist()
        assert all(str(r[c]) == "7" for r in found for c in extra), name
        mine = sorted(repr({c: r[c] for c in plain.columns}) for r in found)
        assert mine == sorted(repr(r) for r in function(spark, plain, oracle.SF).toArrow().to_pylist()), name
        assert function(spark, empty(spark), oracle.SF).count() == 0, name
        outcomes[name] = found
    texts = {r["text"] for r in outcomes["language_id"]}
    assert not texts & {None, "", "*** 123 !!!"} and rows()[0][1] in texts
    near = outcomes["near_duplicates"]
    assert len({r["text"] for r in near}) == len(near) and sum(r["doc_id"] == 0 for r in near) == 1
    assert len(outcomes["decontamination"]) == len(rows())  # nothing of these is in the benchmark
    assert corpus_pipeline.STAGES[-1][1](spark, odd, oracle.SF).count() == len(rows())
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), oracle.SF).count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The language model reaches Python workers that can't import this package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from quillstone.llm import queries
print(queries.op2_language_id(spark, {oracle.SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "200", done.stderr[-2000:]
