import hashlib

import pytest
import public_tokenizers
import tiktoken

from pipeops.llm import bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_documents_match_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r)[1:4] for r in bpe.round_trip(docs).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs.collect()}


def test_edge_rows(spark, edge_docs, no_docs, library):
    got = sorted((str(r[0]), *r[1:4]) for r in bpe.round_trip(edge_docs).collect())
    assert got == sorted((str(r.doc_id), *expected(library, r.text)) for r in edge_docs.collect())
    assert bpe.round_trip(no_docs).count() == 0


def test_slices_leave_ids_unchanged(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 20)
    own = bpe.codec(bpe.VOCABULARY, None)
    for text in ("a  b   c\n\n d's e'll 12 34!! ??  " * 9, "no-blank" * 30, " \n lead " * 12, "é ß 😀 " * 20):
        assert "".join(bpe.slices(text)) == text
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_repeated_characters_merge_as_in_the_library(library):
    own = bpe.codec(bpe.VOCABULARY, None)
    for unit in ("a", "-", "=", " ", "\n", "0", "th", "é", "中", "\x00", "😀", "!'s"):
        for n in range(1, 40):
            assert own.encode(unit * n).tolist() == library.encode_ordinary(unit * n)


def test_offsets_and_split_characters(spark):
    docs = spark.createDataFrame([(1, "a 😀 中é")], "doc_id long, text string")
    row = bpe.encode(docs, offsets=True).first()
    text, own = "a 😀 中é", bpe.codec(bpe.VOCABULARY, None)
    at = 0
    split = 0
    for i, start, end in zip(row.ids, row.starts, row.ends, strict=True):
        raw = own.bytes_of[i]
        assert raw in text[start:end].encode()
        split += len(text.encode()[:at].decode("utf-8", "ignore").encode()) != at
        at += len(raw)
    assert (row.starts[0], row.ends[-1]) == (0, len(text))
    assert row.n_split == split > 0


def test_memory_bound_keeps_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Codec(bpe.VOCABULARY, None)
    for text in ("one two three four five six seven", "seven six eight nine ten", "one two"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    assert len(own.known) <= 5 + 7


def test_decode_of_null_unknown_and_broken_ids(spark):
    own = bpe.codec(bpe.VOCABULARY, None)
    part = own.encode("😀").tolist()[:1]
    frame = spark.createDataFrame([(1, None), (2, []), (3, [10_000_000]), (4, part)], "doc_id long, ids array<int>")
    got = {r.doc_id: (r.decoded, r.decoded_text) for r in bpe.decode(frame, as_text=True).collect()}
    assert got[1] == got[3] == (None, None)
    assert got[2] == (b"", "")
    assert got[4][1] == "�"


def test_counts_equal_encoding(spark, edge_docs, no_docs, monkeypatch):
    names = (bpe.VOCABULARY, "byte_bpe_50k.tiktoken")
    want = [{(r.doc_id, r.n_tokens) for r in bpe.encode(edge_docs, v).collect()} for v in names]
    got = bpe.count(edge_docs.select("doc_id", "text", "fp"), names)
    assert got.columns == ["doc_id", "fp", "n_tokens"]
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all({(r.doc_id, r.n_tokens[j]) for r in rows} == want[j] for j in (0, 1))
    assert bpe.count(no_docs, names).count() == 0
