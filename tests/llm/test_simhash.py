import random

import numpy as np
import pytest
import xxhash

from pipeops.llm import simhash
from pipeops.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits):
    """Smallest id reachable, by comparing all pairs."""
    label = {p: min(i for i, q in prints if q == p and i is not None) for p in {p for _, p in prints} if any(q == p and i is not None for i, q in prints)}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= bits and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    label = plain_components(rows, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", label[p]) for i, p in rows}


@pytest.mark.parametrize("bits,block", [(4, 4096), (4, 3), (2, 4096), (7, 2)])
def test_links_keep_components_of_dense_groups(spark, bits, block):
    rnd = random.Random(bits * 10 + block)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(40):
            x = c
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    rows = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for _, p in rows], "fp long")
    found = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(frame, bits, block).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in found)
    label = {p: i for i, p in rows}
    for _ in rows:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == plain_components(rows, bits)


def test_edge_rows(spark, edge_docs, no_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge_docs).collect()]
    assert len(got) == edge_docs.count()
    by = {i: (f, c) for i, f, c in got}
    assert by[2] == by[3] == by[4] == ("0" * 16, 2)
    assert by[5][1] == by[6][1] == 5
    assert by[7][1] == by[1][1] == by[None][1] == 1
    assert sum(i == 7 for i, _, _ in got) == 2
    assert simhash.near_duplicates(no_docs).count() == 0


def test_words_are_cut_at_ascii_blanks_only():
    assert simhash.fingerprint("A b c\x0bd\x0ce") == plain_fingerprint("a b c d e")
    assert simhash.fingerprint("É x") != simhash.fingerprint("é x")


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 400)]
    frame = spark.createDataFrame([*path, *path[:3], *star, (5, 5), (None, 5), (900, 899)], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(300, 400)}, 899: 899, 900: 899}
    assert components(frame.limit(0)).count() == 0


def test_no_group_holds_a_long_list_whole(spark):
    postings = spark.range(1000).selectExpr("CAST(0 AS SMALLINT) AS choice", "CASE WHEN id < 900 THEN 7 ELSE id END AS bytes", "id AS fp")
    rows = simhash.dealt_lists(postings, 100).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.bytes, r.pair), []).append(r)
    assert len(groups) == 100 + 45 and max(map(len, groups.values())) < 300
    met = {frozenset((a.fp, b.fp)) for g in groups.values() for a in g for b in g if a.upper != b.upper or not any(r.upper for r in g)}
    assert {m for m in met if len(m) == 2} == {frozenset((a, b)) for a in range(900) for b in range(a)}
