import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeops.llm import language_nb as nb


def words_of(text):
    signs = [c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()]
    return "".join(signs).split()


def plain_grams(text):
    """The n-grams within blank-padded words, one by one."""
    for word in words_of(text):
        padded = f" {word} "
        for n in range(1, nb.ORDERS + 1):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != " ":
                    yield padded[i : i + n]


def plain_bucket(gram):
    """The bucket of one n-gram: its only n-gram of that order, found in a text of its own."""
    mixed = 0
    for n, c in enumerate(gram, 1):
        mixed = (mixed * 0x01000193 + ord(c)) & 0xFFFFFFFF if n > 1 else ord(c)
    mixed = ((mixed ^ (0x9E3779B9 * len(gram) & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
    return (((mixed ^ (mixed >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF) >> 16


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute(rows):
    """Multinomial naive Bayes over the same buckets, n-gram by n-gram."""
    counts, texts = defaultdict(Counter), Counter()
    for doc_id, text, lang in rows:
        if lang is not None and doc_id is not None and not held(doc_id) and any(unicodedata.category(c)[0] == "L" for c in text or ""):
            texts[lang] += 1
            counts[lang].update(map(plain_bucket, plain_grams(text)))
    out = []
    for doc_id, text, _ in rows:
        if not texts or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append((doc_id, "und", 0.0))
            continue
        joint = {}
        for lang in texts:
            total = sum(counts[lang].values()) + 0.5 * nb.BUCKETS
            joint[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][b] + 0.5) / total) for b in map(plain_bucket, plain_grams(text)))
        best = max(sorted(joint), key=joint.get)
        out.append((doc_id, best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "12 +-", "en"), (-3, "É áb 東京 naïve\r\n", None), (None, "la la", "es"), (-4, "zu der", None)], "doc_id long, text string, lang string")
    rows = docs.union(odd)
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in nb.identify(rows).collect())
    assert got == sorted((str(i), lang, round(p, 6)) for i, lang, p in brute([tuple(r) for r in rows.collect()]))


def test_held_out_accuracy(docs):
    rows = {r.doc_id: r for r in nb.identify(docs).collect()}
    known = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(known) and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in rows.items())
    tested = [r.lang_pred == known[i] for i, r in rows.items() if r.held_out]
    assert len(tested) > 200 and np.mean(tested) >= 0.99


def test_only_text_of_other_folds_counts(docs):
    wrong = docs.withColumns({"source": F.lit("zz"), "lang": F.when(nb.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))})
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in nb.identify(d).collect()} for d in (docs, wrong.repartition(7)))
    assert one == two


def test_slices_change_nothing(monkeypatch):
    text = "Ünïcode  words, many\tof them\n" * 40
    whole = nb.grams([text.lower()])
    monkeypatch.setattr(nb, "SLICE", 50)
    (cuts, owners), *more = list(nb.groups([text]))
    assert more and all(len(s) <= 50 for group in [(cuts, owners), *more] for s in group[0])
    parts = [nb.grams(s) for s, _ in [(cuts, owners), *more]]
    for n in range(nb.ORDERS):
        together = np.concatenate([found[n][1] for _, found in parts])
        assert (np.bincount(together, minlength=nb.BUCKETS) == np.bincount(whole[1][n][1], minlength=nb.BUCKETS)).all()


def test_edge_rows(spark, edge_docs, no_docs):
    got = nb.identify(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert nb.identify(no_docs).count() == 0
    silent = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in nb.identify(silent).collect()} == {("und", 0.0)}


def test_equal_scores_go_to_the_first_language(spark):
    rows = spark.createDataFrame([(i, "abc", lang) for i in range(40) for lang in ("b", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in nb.identify(rows).collect()} == {"a"}


def test_too_many_languages_are_an_error(docs):
    with pytest.raises(ValueError, match="matrix_bytes"):
        nb.learn(docs, matrix_bytes=1000)
