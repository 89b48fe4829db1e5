"""The pipeline's stages keep their contract; the entry works with and without them."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from userprism.llm import jaccard, quality, substrings
from userprism.operators.scale import stage

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SF_DIR = SF_DIR if os.path.isdir(SF_DIR) else "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages_act_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, made = docs.columns, []
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF_DIR))
        made.append((name, docs))
    (_, good), (_, single), (_, cut), (_, packed) = made
    for _, table in made[:3]:
        assert table.columns == columns
    # Quality: the rows whose score by the same model reaches one half.
    whole = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = quality.held_out_scores(whole, labels).filter("predicted = 1").select("doc_id")
    assert sorted(good.select("doc_id").collect()) == sorted(scores.collect())
    # Near duplicates: one row of each component; passages: words cut as told, none dropped else.
    kept = jaccard.link(good, 80, 5).select("component_id").distinct()
    assert sorted(single.select("doc_id").collect()) == sorted(kept.collect())
    told = {r.doc_id: r for r in substrings.digests(single).collect()}
    texts = {r.doc_id: r for r in cut.collect()}
    assert set(texts) == set(told)
    for i, r in texts.items():
        assert len(r.text.split()) == told[i].n_words - told[i].n_removed and r.n_chars == len(r.text)
    assert packed.select("doc_id").distinct().count() == len(texts)
    sums = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sums) <= 4096
    assert corpus_pipeline.run(spark, SF_DIR).count() == packed.count()


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_the_rest_works_without_this_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/userprism", tmp_path / "userprism", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
        cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)},
    )
    assert told.stdout.split()[-1] == "False", told.stderr
