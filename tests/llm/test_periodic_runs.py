import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeops.llm import periodic_runs as p


def brute(words):
    """Every run by comparing every pair of words, period by period."""
    n, out, ends = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            # a stretch with a smaller period has been met with that period
            if i - start >= q and (start, i + q) not in ends:
                ends.add((start, i + q))
                out.append((start, i + q - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(rng, n):
    """Powers of powers with single words changed or put between."""
    out = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
    while len(out) < n:
        out = out * rng.randint(1, 9)
        if rng.random() < 0.7:
            out.insert(rng.randrange(len(out)), rng.randrange(3))
        if rng.random() < 0.3:
            out = out + out[: rng.randrange(len(out))]
    return out[:n]


def test_all_short_words_over_two_letters():
    listed = [list(w) for n in range(13) for w in itertools.product((0, 1), repeat=n)]
    assert p.runs_of([np.array(w, np.int64) for w in listed]) == [brute(w) for w in listed]


@pytest.mark.parametrize("seed", range(6))
def test_random_and_nested_words(seed):
    rng = random.Random(seed)
    listed = [[rng.randrange(rng.choice((1, 2, 3, 20))) for _ in range(rng.randrange(160))] for _ in range(150)]
    listed += [nested(rng, rng.randrange(1, 400)) for _ in range(150)]
    assert p.runs_of([np.array(w, np.int64) for w in listed]) == [brute(w) for w in listed]


@pytest.mark.parametrize("unit", [[0, 1], [0, 1, 2], [0, 0, 1], [0, 1, 0, 2, 0]])
def test_breaks_between_periodic_regions(unit):
    """Regions with the same words out of step make many runs that no synchronising place proposes."""
    listed = []
    for k, j, cut in itertools.product((9, 20, 41), (9, 20, 40), range(len(unit))):
        listed.append(unit * k + unit[:cut] + unit * j)
        listed.append([7, 8] + unit * k + unit[:cut] + unit * j + [9] + unit * k + unit[:cut] + unit * j)
    assert p.runs_of([np.array(w, np.int64) for w in listed]) == [brute(w) for w in listed]


def test_fibonacci_and_one_word():
    listed = [fibonacci(700), [5] * 500, [5] * 200 + [6] + [5] * 200, list(range(300)), []]
    assert p.runs_of([np.array(w, np.int64) for w in listed]) == [brute(w) for w in listed]


def test_synchronising_places_are_consistent_and_dense():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 4, 4000)
    words[2500:3100] = words[500:1100]
    scale, hashes = 1, p._mixed(words.astype(np.uint64))
    for _ in range(4):
        places = set(p.synchronising(hashes, scale, np.zeros(len(hashes), bool)).tolist())
        inner = range(500, 1100 - 2 * scale)
        assert {i for i in inner if i in places} == {i - 2000 for i in (j + 2000 for j in inner) if i in places}
        assert all(any(i + k in places for k in range(scale)) for i in range(4000 - 3 * scale))
        hashes = p._mixed(hashes[:-scale] * np.uint64(0xD6E8FEB86659FD93) + hashes[scale:])
        scale *= 2


def expected(doc_id, text):
    words = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = [r for r in brute([number[w] for w in words]) if r[1] >= max(12, 2 * r[2])]
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    shape = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    digests = ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))
    return (doc_id, len(runs), *shape, *(hashlib.sha256(d).hexdigest() for d in digests))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 12000")
    want = sorted(expected(r.doc_id, r.text) for r in docs.collect())
    assert sum(row[1] > 0 for row in want) > 10
    assert sorted(tuple(r) for r in p.find(docs, plant=True).collect()) == want


def test_edge_rows(spark, edge_docs, no_docs, monkeypatch):
    docs = edge_docs.where("doc_id IS NULL OR doc_id NOT IN (5, 6)").withColumns({"start": F.lit(1), "length": F.lit("x"), "checksum": F.lit(0)})
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in p.find(docs, plant=True).collect()), key=str) == want
    monkeypatch.setattr(p, "GROUP_WORDS", 3)
    assert sorted((tuple(r) for r in p.find(docs, plant=True).collect()), key=str) == want
    long = p.find(edge_docs.where("doc_id = 5")).first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 90_000, 3, 30_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"Word one two.").hexdigest()
    assert p.find(no_docs, plant=True).count() == 0
