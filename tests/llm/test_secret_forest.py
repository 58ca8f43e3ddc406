import random
import re

import pytest
from pyspark.sql import functions as F

from pipeops.llm import secret_forest as s


def plain_candidates(text):
    text = text or ""
    found = {(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_+/=-]+", text) if re.search("[0-9]", m.group()) and len(m.group()) >= s.LEAST}
    names = r"(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)"
    found |= {m.span(1) for m in re.finditer(names + r"[ \t]{0,3}[=:][ \t]{0,3}[\"']([^\"'\s]{6,})(?=[\"'])", text, re.I)}
    return found


def test_candidates_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, found = s.candidates(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add((r.start, r.end))
    assert got == {r.doc_id: c for r in docs.collect() if (c := plain_candidates(r.text))}


def test_planted_secrets_are_kept_and_numbers_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.start, r.end) for r in s.secrets(docs).collect()}
    rows = docs.collect()
    planted = {(r.doc_id, *m.span(1)) for r in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text, re.I)}
    numbers = {(r.doc_id, *m.span()) for r in rows for m in re.finditer(r"(?<![\w.+/=-])[0-9]{16}(?![\w+/=-])", r.text)}
    assert planted and planted <= got
    assert not numbers & got


def held_out(seed, n=300):
    """Labelled findings: keys in code against digests, numbers, identifiers of words and test values."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["reader", "buffer", "stream", "value", "parser", "window", "token", "index"])
    key = lambda k: "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    rows = []
    for _ in range(n):
        rows.append((key(rnd.randint(20, 44)) + "7", f"{rnd.choice(['api_key', 'secret', 'auth token', 'password'])} = \"", '"', "src/app.py", 1))
        rows.append(rnd.choice([
            ("".join(rnd.choices("0123456789abcdef", k=40)), "commit ", " on main", "log.txt", 0),
            ("".join(rnd.choices("0123456789", k=20)), "order ", ".", "mail.txt", 0),
            ("_".join(word() for _ in range(4)) + "_2", "call ", "(", "src/app.py", 0),
            (f"test_{word()}_key_{rnd.randint(1000, 9999)}", 'key = "', '"', "tests/fixtures/a.py", 0),
        ]))
    return rows


def test_forest_on_held_out_findings(spark):
    schema = "value string, before string, after string, path string, label int"
    train, test = (spark.createDataFrame(held_out(i), schema) for i in (1, 2))
    words = spark.createDataFrame([(w, 9) for w in ("reader", "buffer", "stream", "value", "parser", "window", "token", "index", "test", "key")], "word string, docs long")
    usual = s.transitions(words)
    model = s.forest(s.described(train.withColumns({"row": F.monotonically_increasing_id(), "start": F.lit(0)}), words, usual).withColumn("label", F.col("label").cast("double")))
    from pyspark.ml.functions import array_to_vector

    rows = s.described(test.withColumns({"row": F.monotonically_increasing_id(), "start": F.lit(0)}), words, usual)
    scored = model.transform(rows.withColumn("features", array_to_vector(F.array(*s.FEATURES))))
    right = scored.where("prediction = label").count() / scored.count()
    assert right >= 0.95


def test_features(spark):
    words = spark.createDataFrame([("hello", 9), ("world", 9)], "word string, docs long")
    row = spark.createDataFrame([("helloWORLD-12ab", 'the token = "', '" x', "a/tests/b.py", 1, 0)], "value string, before string, after string, path string, row long, start long")
    got = s.described(row, words, {"he": -1.0}).first()
    assert got.coverage == 0 and got.named == got.quoted == got.assigned == got.path_test == 1 and got.hex == 0 and got.path_depth == 2
    got = s.described(row.withColumn("value", F.lit("hello-world-12")), words, s.transitions(words)).first()
    assert got.coverage == pytest.approx(10 / 14)


def test_edge_rows(spark, edge_docs, no_docs):
    more = edge_docs.select("doc_id", "text", "source").union(spark.createDataFrame([(30, "9" * 60_000, None), (31, "a" * 60_000 + "1", "x"), (32, "😀 password: 'hunter-two'", "x"), (32, "😀 password: 'hunter-two'", "x")], "doc_id long, text string, source string"))
    got = s.findings(more).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(30, 0, 60_000), (31, 0, 60_001), (32, 13, 23)}
    assert sum(r.doc_id == 32 for r in got) == 2
    assert s.findings(no_docs).count() == s.findings(edge_docs).count() == 0
    assert s.findings(more, path_col=None).count() == len(got)
    given = spark.createDataFrame([(None, None, None, None, 1), ("abc", "", "", "", None)], "value string, before string, after string, path string, label int")
    assert {r.probability for r in s.findings(more, labelled=given.limit(0)).collect()} == {0.5}
    assert {r.probability for r in s.findings(more, labelled=given).collect()} == {1.0}


def test_a_copied_key_is_no_word(spark):
    key = "aBcdEfgh1JKlmnoPq2RstuvWxyz3Abcdefg"
    copy = f'the usual words of a page: api_key = "{key}" and password: "zyxwvu!abcdef"'
    near = [f"page {i} has usual words, {copy}" for i in range(9)]
    docs = spark.createDataFrame([(t,) for t in [copy] * 50 + ["only copies"] * 50 + near], "text string")
    got = {r.word: r.docs for r in s.words(docs, "text").collect()}
    assert got["usual"] == got["words"] == 10 and "copies" not in got
    assert not set(got) & {"abcdefgh", "jklmnopq", "rstuvwxyz", "abcdefg", "zyxwvu", "abcdef"}
    assert s.words(docs, "text", 1, 0.5).where("word = 'copies'").count() == 0


def test_coverage_does_not_grow_with_copies(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)) + "7" for _ in range(20)]
    rows = [(i, f'secret = "{k}"', "a") for i, k in enumerate(keys) for _ in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, found = s.candidates(docs)
    described = s.described(found, s.words(docs, "text"), {})
    got = described.withColumn("label", s.label()).collect()
    assert {r.coverage for r in got} == {0.0} and 0.0 not in {r.label for r in got}


@pytest.mark.parametrize(
    "given,want",
    [
        ("api_key=9f8e7d6c5b4a39281706", {"9f8e7d6c5b4a39281706"}),
        ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", {"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"}),
        ("OAUTH2_TOKEN_2=abcdefgh1234567890", {"abcdefgh1234567890"}),
        ("commit=0123456789abcdef0123", {"0123456789abcdef0123"}),
        ("QUJDREVGR0hJSktMTU5PUA==", {"QUJDREVGR0hJSktMTU5PUA=="}),
        ("password: hunter2xyz, then", {"hunter2xyz"}),
        ("pwd: S3cr3t! it is.", {"S3cr3t!"}),
        ("token: abcdefghijklmnopqrstuvwxyzabcdef.", {"abcdefghijklmnopqrstuvwxyzabcdef"}),
        ("pwd = 'abc'", {"abc"}),
        ('{"password": "p w", "n": 1}', {"p w"}),
        ("password: str = 'x1'", {"x1"}),
        ('c["secret"] = "it\'s"', {"it's"}),
        ("?token=abc&user=bob", {"abc"}),
        ("token => t0", {"t0"}),
        ("the author: John; a token is", set()),
        ("token: ... pwd=''", set()),
        ('auth = "cut0ff', {"cut0ff"}),
        ("token==", set()),
    ],
)
def test_forms_of_candidates(spark, given, want):
    docs = spark.createDataFrame([(1, "😀 " + given, "s")], "doc_id long, text string, source string")
    rows = s.candidates(docs)[1].collect()
    assert {r.value for r in rows} == want
    for r in rows:
        assert ("😀 " + given)[r.start : r.end] == r.value and ("😀 " + given)[: r.start].endswith(r.before)


def test_assigned_names_are_features(spark):
    rows = [(1, "api_key=9f8e7d6c5b4a39281706", "s"), (2, "commit=0123456789abcdef0123", "s"), (3, "OAUTH2_TOKEN_2=abcdefgh1234567890", "s")]
    found = s.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"))[1]
    words = spark.createDataFrame([], "word string, docs long")
    got = {r.id: r for r in s.described(found, words, {}).withColumn("label", s.label()).collect()}
    assert got[1].named == got[1].assigned == got[1].label == got[3].named == got[3].assigned == 1
    assert got[2].harmless == 1 and got[2].label == 0
