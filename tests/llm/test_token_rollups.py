import random
from collections import Counter

from pyspark.sql import functions as F

from pipeops.llm.token_rollups import Rollup, changes_between
from pipeops.session import scratch

CHANGES = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_source string, old_lang string, old_tokenizer_version string, old_n_tokens long"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def plain(rows):
    out = Counter()
    tokens = Counter()
    for op, s, la, v, n, os, ol, ov, on in rows:
        if op in ("insert", "revise"):
            out[s, la, v] += 1
            tokens[s, la, v] += n or 0
        if op in ("delete", "revise"):
            key = (s, la, v, n) if op == "delete" else (os, ol, ov, on)
            out[key[:3]] -= 1
            tokens[key[:3]] -= key[3] or 0
    return {k: (out[k], tokens[k]) for k in out if out[k] or tokens[k]}


def random_rows(seed, n=200):
    rnd = random.Random(seed)
    one = lambda: (rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice(["v1", "v2"]), rnd.choice([0, 5, 9, None]))
    return [(rnd.choice(["insert", "insert", "delete", "revise", None, "other"]), *one(), *one()) for _ in range(n)]


def test_batches_commit_once_and_totals_match_brute_force(spark):
    rollup = Rollup(spark, scratch(spark, "rollup"))
    assert totals(rollup) == {}
    rows = []
    for i in range(4):
        batch = random_rows(i)
        rows += batch
        frame = spark.createDataFrame(batch, CHANGES)
        assert rollup.apply(f"b{i}", frame)
        assert not rollup.apply(f"b{i}", frame)
        assert totals(rollup) == plain(rows)
        if i % 2:
            rollup.compact()
            assert totals(rollup) == plain(rows)
            assert not rollup.apply("b0", frame)
    again = Rollup(spark, rollup.folder)
    assert totals(again) == plain(rows) and {r.batch for r in again.batches().collect()} == {"b0", "b1", "b2", "b3"}


def test_a_batch_that_broke_off_counts_for_nothing(spark, monkeypatch):
    rollup = Rollup(spark, scratch(spark, "rollup"))
    frame = spark.createDataFrame(random_rows(9), CHANGES)
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        rollup.apply("x", frame)
    except RuntimeError:
        pass
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    assert totals(rollup) == {}
    assert rollup.apply("x", frame) and totals(rollup) == plain(random_rows(9))


def test_empty_batches_and_extra_columns(spark):
    rollup = Rollup(spark, scratch(spark, "rollup"))
    frame = spark.createDataFrame(random_rows(2, 5), CHANGES)
    assert rollup.apply("none", frame.limit(0)) and totals(rollup) == {}
    assert rollup.apply("more", frame.withColumns({"docs": F.lit(5), "tokens": F.lit(5), "batch": F.lit("q")}))
    assert totals(rollup) == plain(random_rows(2, 5))
    short = frame.select("op", "source", "lang", "tokenizer_version", "n_tokens").where("op = 'insert'")
    assert rollup.apply("short", short)


def test_ledgers_to_changes(spark):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    old = spark.createDataFrame([(1, "a", "en", "v1", 3), (2, "a", "en", "v1", 4), (3, "b", None, "v1", 5)], schema)
    new = spark.createDataFrame([(1, "a", "en", "v1", 3), (2, "a", "en", "v2", 6), (4, "b", "fr", "v2", 7)], schema)
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rollup.apply("old", old.withColumn("op", F.lit("insert")))
    rollup.apply("new", changes_between(old, new))
    assert totals(rollup) == {("a", "en", "v1"): (1, 3), ("a", "en", "v2"): (1, 6), ("b", "fr", "v2"): (1, 7)}


def test_names_of_any_kind_count_once(spark):
    rollup = Rollup(spark, scratch(spark, "rollup"))
    frame = spark.createDataFrame(random_rows(4, 30), CHANGES)
    for name in ("day\n1", "day", "1", "a'b", ""):
        assert rollup.apply(name, frame) and not rollup.apply(name, frame)
        before = totals(rollup)
        rollup.compact()
        assert totals(rollup) == before and not rollup.apply(name, frame)
    assert totals(rollup) == plain(random_rows(4, 30) * 5)
    rollup.compact()
    assert len(rollup._live()) == 1 and totals(rollup) == plain(random_rows(4, 30) * 5)


def test_query_equals_sql_over_token_counts(spark, sf_dir):
    """Counts by the tiktoken library, the rollup by one grouping in SQL."""
    import duckdb
    import pandas as pd
    import public_tokenizers
    import tiktoken

    from pipeops.llm.bpe import read_ranks
    from pipeops.llm.queries import QUERIES, TOKENIZERS

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    old, new = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(v), special_tokens={}) for v in TOKENIZERS)
    counts = pd.DataFrame([(r.doc_id, r.source, r.lang, len(old.encode_ordinary(r.text or "")), len(new.encode_ordinary(r.text or ""))) for r in docs], columns=["doc_id", "source", "lang", "a", "b"])
    con = duckdb.connect()
    con.register("counts", counts)
    want = con.execute(f"""
        WITH judged AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM '{sf_dir}/labels.parquet' GROUP BY doc_id)
        SELECT source, lang, CASE WHEN quality = 1 THEN '{TOKENIZERS[1]}' ELSE '{TOKENIZERS[0]}' END AS v, count(*), sum(CASE WHEN quality = 1 THEN b ELSE a END)
        FROM counts LEFT JOIN judged USING (doc_id) WHERE coalesce(toxic, 0) <> 1 GROUP BY 1, 2, 3""").fetchall()
    got = [tuple(r) for r in QUERIES["op10_token_rollup"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((s, la, v, n, int(t)) for s, la, v, n, t in want)
