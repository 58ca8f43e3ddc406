import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from pipeops.llm import pii_votes as p
from pipeops.llm import spans

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    needed = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # else these patterns take quadratic time
    kinds = [(i, kind) for i, kind in enumerate(p.KINDS) if needed[kind] in (text or "")]
    found = [(m.start(), i, m.end()) for i, kind in kinds for m in re.finditer(BASE[kind], text or "") if passes(kind, m.group())]
    return [f"{p.KINDS[i]}:{a}:{b}" for a, i, b in sorted(found)]


def check(rows, texts):
    """Base spans as by brute force; others beside them, in order."""
    for row in rows:
        base = plain(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b.startswith(k) for b in base) for k in p.KINDS]
        every = row.spans.split(",") if row.spans else []
        assert set(base) <= set(every)
        places = [(int(s.split(":")[1]), p.KINDS.index(s.split(":")[0])) for s in every]
        assert places == sorted(places)
        held = [tuple(map(int, b.split(":")[1:])) for b in base]
        for added in set(every) - set(base):
            a, b = map(int, added.split(":")[1:])
            assert not any(x < b and a < y for x, y in held)


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(p.digest(p.personal_data(docs)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_patterns_match_on_odd_strings(spark):
    alphabet = ["a", "1", "22", ".", "@", "-", "+", " ", "(", "4111 1111 1111 1111", "é", "_", "\n", "255"]
    texts = ["".join(t) for t in itertools.product(alphabet[:9], repeat=4)][::3]
    texts += ["".join(t) for t in itertools.permutations(alphabet, 4)][::17]
    texts += ["a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.00255", "+1 2+3 4567890123", "4111-1111-1111-1111 2", "..@a.b a@b@c.d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for kind in p.KINDS:
        column = spans.matches(F.col("text"), *(p.PATTERNS[kind][0], F.col("text").rlike(p.PATTERNS[kind][1])))
        for row in docs.select("text", F.transform(column, lambda m: m["value"]).alias("got")).collect():
            assert (row.got or []) == [m.group() for m in re.finditer(BASE[kind], row.text)], (kind, row.text)


def test_edge_rows(spark, edge_docs, no_docs):
    long = "9" * 2_000 + " " + "a" * 2_000 + " x@y.zz +" + "1 " * 3_000
    more = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(20, long), (21, "é😀 mail: joe@x.org; joe (at) x (dot) org")], "doc_id long, text string"))
    run = spark.createDataFrame([(22, "9" * 100_000 + " " + "a" * 100_000 + " x@y.zz")], "doc_id long, text string")  # linear time, no deep stack
    assert [r.spans for r in p.digest(p.personal_data(run)).collect()] == ["email:200002:200008"]
    rows = p.digest(p.personal_data(more)).collect()
    assert len(rows) == more.count()
    check(rows, {r.doc_id: r.text for r in more.collect()})
    assert next(r.spans for r in rows if r.doc_id == 21).startswith("email:9:18")
    assert p.digest(p.personal_data(no_docs)).count() == 0
    assert p.digest(p.personal_data(edge_docs)).count() == edge_docs.count()
    none = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in p.digest(p.personal_data(none)).collect()] == ["", ""]


def test_numbers_that_fail_the_check_are_refused(spark):
    """Planted among real cards: numbers of the same shape that fail Luhn's sum, alone, as invoices, and beside the word card."""
    numbers = [f"{a}{b}" for a, b in itertools.product(("4929 9636 8986 15", "5500 0000 1234 56"), range(10, 60))]
    right, wrong = ([n for n in numbers if luhn(re.sub(" ", "", n)) == ok] for ok in (True, False))
    texts = [f"my card {n} thanks" for n in right] * 9 + [f"number {n} there" for n in right] * 9
    texts += [f"number {n} there" for n in wrong] + [f"see invoice {n}" for n in wrong] + ["it is 1234 5678 9012 3456", "it is 300.400.1.2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in p.digest(p.personal_data(docs)).collect()}
    good = 18 * len(right)
    assert len(right) >= 8 and all("card" in got[i] for i in range(good))
    assert sum(bool(got[i]) for i in range(good, len(texts))) <= 0.02 * len(texts)


def test_data_written_otherwise_is_added(spark):
    texts = [f"mail joe{i}@site{i}.com or call +1 (509) 555-{1000 + i}" for i in range(60)]
    texts += [f"write to ann{i} (at) home{i} (dot) org" for i in range(30)] + [f"phone {200 + i} 555 {1000 + i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in p.digest(p.personal_data(docs)).collect()}
    assert all("email" in got[i] for i in range(60, 90)) and all("phone" in got[i] for i in range(90, 120))


def test_em_finds_the_reliable_labelers():
    import random

    rnd = random.Random(3)
    rows = {}
    for _ in range(3000):
        truth = rnd.random() < 0.4
        votes = tuple(int(truth if rnd.random() < right else not truth) if rnd.random() < 0.9 else None for right in (0.95, 0.9, 0.85, 0.6))
        rows.setdefault(votes, [0, 0])[truth] += 1
    posterior = p.reliabilities([("card", v, sum(n)) for v, n in rows.items()], 4)
    right = sum(n[posterior["card", v] >= 0.5] for v, n in rows.items())
    assert right / 3000 > 0.93
    assert posterior["card", (1, 1, 1, 0)] > posterior["card", (0, 1, 1, 1)] > 0.5
