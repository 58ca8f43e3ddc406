import hashlib
import subprocess
import sys

import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from pipeops.llm import bpe, quality_fm

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from test_decontaminate import plain as plain_passages  # noqa: E402
from test_simhash import plain_components, plain_fingerprint  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_against_brute_force(spark, stages):
    given = {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, a, b in stages}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, after = given["quality"]
    scores = {r.doc_id: r.predicted for r in quality_fm.classify(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).collect()}
    assert set(after) == {i for i in before if scores[i] == 1} and 0 < len(after) < len(before)
    before, after = given["exact_dedup"]
    last = {r.text: i for i, r in sorted(before.items())}
    assert set(after) == set(last.values())
    before, after = given["near_dedup"]
    prints = [(i, plain_fingerprint(r.text)) for i, r in before.items()]
    label = plain_components(prints, 4)
    assert set(after) == {label[p] for _, p in prints}
    before, after = given["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    short = [(i, r.text) for i, r in before.items() if len(r.text) < 3000]
    leaks = {i for i, _ in plain_passages(short, items)}
    assert {i for i, _ in short} & set(after) == {i for i, _ in short} - leaks
    before, after = given["tokens"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    for i, r in before.items():
        ids = library.encode_ordinary(r.text)
        assert after[i].n_tokens == len(ids) and after[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert set(before) == set(after)


def test_stages_keep_the_columns_of_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema


def test_run_is_the_stages(spark, stages):
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages[-1][2])


def test_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, FOLDER)
            assert after.schema == docs.schema and after.count() <= docs.count()
    near = corpus_pipeline.near_dedup(spark, edge_docs, FOLDER)
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(["1", "2", "5", "8", "9", "None"])


def test_entry_without_this_subpackage(tmp_path):
    """The entry module imports and lists the other queries where the folders are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and '_' in n[2:5] for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
