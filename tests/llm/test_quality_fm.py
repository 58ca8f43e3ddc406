import zlib

import numpy as np
import pytest

from pipeops.llm import quality_fm as q


@pytest.fixture(scope="module")
def classified(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in q.classify(docs, labels).collect()}


def test_held_out_accuracy(classified):
    docs, labels, rows = classified
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.95
    good = [p for p, y in held if y == 1]
    assert np.mean(good) >= 0.98


def test_only_text_and_length_count(spark, classified):
    docs, labels, rows = classified
    from pyspark.sql import functions as F

    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz"), "quality": F.lit(0)})
    again = {r.doc_id: r.score for r in q.classify(other, labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in rows.items())


def test_labels_of_the_held_out_fold_are_not_learned(spark, classified):
    docs, labels, rows = classified
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in q.classify(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in rows.items())


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = q.Machine([np.empty(0)] * len(q.STATISTICS), 0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, 4)) / 3)
    at, x = rng.choice(q.SIZE, 30, replace=False), rng.random(30) / 5
    total = machine.constant + machine.linear[at] @ x
    total += sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(30) for j in range(i))
    assert machine.score(at, x) == pytest.approx(1 / (1 + np.exp(-total)))


def test_sample_is_bounded_and_order_does_not_count(spark, classified):
    docs, labels, _ = classified
    a = q.learn(docs, labels, train_rows=40, epochs=2)
    b = q.learn(docs.orderBy("text").repartition(5), labels.union(labels).repartition(3), train_rows=40, epochs=2)
    assert np.allclose(a.linear, b.linear) and np.allclose(a.factors, b.factors)


def test_edge_rows(spark, edge_docs, no_docs, classified):
    _, labels, _ = classified
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 7), (None, 1), (77, 1), (2, 0)], "doc_id long, quality int")
    for given in (odd, odd.limit(0)):
        got = q.classify(edge_docs, given).collect()
        assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in q.classify(edge_docs, odd.limit(0)).collect()} == {0.5}
    assert q.classify(no_docs, odd).count() == 0
    assert q.classify(edge_docs.drop("n_chars"), odd).count() == edge_docs.count()
    machine = q.learn(edge_docs, odd)
    assert sorted(map(str, q.accepted(edge_docs, machine, 0.0).collect())) == sorted(map(str, edge_docs.collect()))
    assert q.accepted(edge_docs, machine, 1.1).count() == 0
