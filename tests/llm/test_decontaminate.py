import math
import random

import pytest

from pipeops.llm import decontaminate as d


def plain_distance(pattern, words):
    """Least edits from the pattern to any run of the words, by the whole table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(docs, items, rate=d.ERROR_RATE):
    out = {}
    for doc, text in docs:
        words = d.words_of(text)
        for item, asked in items:
            pattern = d.words_of(asked)
            if len(pattern) >= d.MIN_WORDS and words:
                least = plain_distance(pattern, words)
                if least <= math.floor(rate * len(pattern)):
                    out[doc, item] = least
    return out


def test_myers_distances_match_the_table():
    rnd = random.Random(1)
    for _ in range(400):
        pattern = [rnd.choice("abc") for _ in range(rnd.randint(1, 70))]
        words = [rnd.choice("abc") for _ in range(rnd.randint(1, 40))]
        assert min([len(pattern), *d.distances(pattern, words)]) == plain_distance(pattern, words)


def test_pieces_are_the_item():
    words = list("abcdefghijk")
    for errors in range(4):
        cut = d.pieces(words, errors)
        assert len(cut) == errors + 1 and sum((p for _, p in cut), []) == words
        assert all(words[at : at + len(p)] == p for at, p in cut)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_edited_passages_match_brute_force(spark, block_words):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(3, 30)))) for i in range(25)]
    docs = []
    for i in range(120):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 80))
        if i % 2:
            passage = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(passage))
                passage[at : at + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 1))
                passage = passage or ["x"]
            cut = rnd.randint(0, len(words))
            words[cut:cut] = passage
        docs.append((i, ", ".join(words).title()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(frame, asked, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == plain(docs, items)
    texts = dict(docs)
    for r in got:
        assert plain_distance(d.words_of(dict(items)[r.item_id]), d.words_of(texts[r.doc_id][r.start : r.end])) == r.distance


def test_documents_match_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.distance for r in d.contaminated(docs, items).collect()}
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 1500]
    want = plain(short, [(r.item_id, r.text) for r in items.collect()])
    assert want and {k: v for k, v in got.items() if k[0] in {i for i, _ in short}} == want


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "Alpha, beta; GAMMA delta epsilon"), (2, None), (3, ""), (4, "word"), (None, "one two word one two"), (1, "Alpha, beta; GAMMA delta epsilon")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in d.contaminated(edge_docs, items).collect())
    assert got == sorted([("1", "1"), ("7", "1"), ("7", "1"), ("None", "1")] * 2 + [("5", "None"), ("6", "None")])
    assert d.contaminated(no_docs, items).count() == d.contaminated(edge_docs, items.limit(0)).count() == 0
    same_name = d.contaminated(edge_docs, items.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")
    assert same_name.columns[:2] == ["doc_id", "item_id"] and same_name.count() == len(got)


def test_scripts_without_blanks_and_short_items(spark):
    chinese, thai = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少", "สวัสดีครับวันนี้อากาศดีมากเลยนะครับ"
    items = [(1, chinese), (2, thai), (3, "Incomprehensibilities notwithstanding"), (4, "to be"), (5, "画蛇添足了吗")]
    docs = [
        (10, "前" + chinese.replace("处", "x", 1) + "后 and 画蛇添足了么"),
        (11, f"a {thai} b"),
        (12, "Some incomprehensibilities, notwithstanding to be."),
        (13, "incomprehensibility notwithstanding; 看，画蛇添足了吗。"),
    ]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == {(10, 1, 1), (11, 2, 0), (12, 3, 0), (12, 4, 0), (13, 5, 0)}
    assert next(docs[3][1][r.start : r.end] for r in found if r.doc_id == 13) == items[4][1]


def test_short_items_are_searched_exactly_unless_left_out(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "x"), (3, "?!"), (4, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A, b; c x"), (2, "ab xx"), (3, "one two three four"), (4, "one two three for"), (5, "?!")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.item_words, r.distance) for r in d.contaminated(docs, items).collect()}
    assert found == {(1, 1, 2, 0), (1, 2, 1, 0), (3, 4, 4, 0)}
    assert [(r.doc_id, r.item_id) for r in d.contaminated(docs, items, min_chars=12).collect()] == [(3, 4)]
