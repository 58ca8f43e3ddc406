import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pipeops.llm import chunk_dedup


def plain(rows):
    """(doc_id, keep, size, kept, digest) by comparing texts."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(chunk):
    """A digest under which most chunks collide."""
    return F.encode((F.length(chunk) % 3).cast("string"), "UTF-8")


@pytest.mark.parametrize("digest", [chunk_dedup.sha256, weak])
def test_documents_match_brute_force(spark, sf_dir, digest):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, chunk_dedup.duplicates(docs, digest=digest).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("digest", [chunk_dedup.sha256, weak])
def test_edge_rows(spark, edge_docs, no_docs, digest):
    got = sorted(map(tuple, chunk_dedup.duplicates(edge_docs, digest=digest).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert chunk_dedup.duplicates(no_docs, digest=digest).count() == 0


def test_group_without_ids_is_kept(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b")], "doc_id long, text string")
    assert all(r.kept for r in chunk_dedup.duplicates(docs).collect())


def test_chunks_are_the_text_and_shared_passages_give_equal_chunks(spark):
    rnd = random.Random(4)
    passage = "".join(" ".join("".join(rnd.choices("aeioudlmnrst", k=rnd.randint(2, 8))) for _ in range(rnd.randint(4, 12))) + ". " for _ in range(400))
    texts = [passage, "A different opening that is rather short. " + passage, "x" * 30_000, "", "a.\n" * 9000, "é😀." * 700]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in frame.select(chunk_dedup.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == texts
    assert all(len(c) <= chunk_dedup.MAX_CHUNK for cs in got for c in cs)
    assert len(got[0]) > 10
    assert len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])


def test_text_without_ascii_ends_is_cut_by_its_content(spark):
    rnd = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x9FA0)]
    plain_run = "".join(rnd.choices(han, k=48_000))
    with_stops = "".join("".join(rnd.choices(han, k=20)) + "。" for _ in range(2000))
    hindi = "".join("".join(rnd.choices("कखगघचछजटडतदनपबमयरलवश", k=rnd.randint(8, 60))) + "। " for _ in range(1000))
    for text in (plain_run, with_stops, hindi):
        frame = spark.createDataFrame([(text,), ("x" + text,)], "text string")
        one, two = (r[0] for r in frame.select(chunk_dedup.chunks(F.col("text"))).collect())
        assert len(one) > 40 and len(set(one) & set(two)) > 0.9 * len(one)
