import base64
import hashlib
import zlib

import pytest

from pipeops.llm import arc_warc as w
from pipeops.session import scratch

PAGES = "page_id long, url string, html string"


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = first.get(html or "")
        kind, refers = ("response", None) if i == same else ("revisit", same)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers))
    return sorted(out, key=repr)


def archived(pages, **options):
    return sorted((tuple(r)[:5] for r in w.archived(pages, **options).collect()), key=repr)


def test_pages_match_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    copies = pages.withColumn("page_id", pages.page_id + 1000).repartition(5)
    both = copies.union(pages)
    assert archived(both) == plain([(r.page_id, r.url, r.html) for r in both.collect()])


def test_edge_rows(spark):
    rows = [(10, "http://a b/c\nd", None), (9, None, ""), (3, "u", "x\r\n\r\ny\n"), (100, "u", "x\r\n\r\ny\n"), (None, "v", "x\r\n\r\ny\n"), (5, "v", "é" * 100_000), (6, "v", "HTTP/1.1 404\r\n\r\n")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "page_id AS payload_bytes", "url AS archive", "url AS record_type")
    assert archived(pages) == plain(rows)
    assert archived(pages.limit(0)) == []
    assert {r[3] for r in archived(pages, least_bytes=10**9)} == {"response"}


def test_repeated_rows_have_one_response(spark):
    got = archived(spark.createDataFrame([(1, "u", "same")] * 3, PAGES).repartition(2))
    assert sorted((r[3], r[4]) for r in got) == [("response", None), ("revisit", 1), ("revisit", 1)]


def write(folder, name, members):
    files, root = w.filesystem(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}", compression=None) as out:
        for member in members:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(packer.compress(member) + packer.flush())


def test_headers_of_both_versions(spark):
    folder = scratch(spark, "arcs")
    body = b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\nhello"
    one = [w.version_block("a.arc.gz", 1, "19961231235959"), f"http://x/a b.html 1.2.3.4 19970102030405 text/html {len(body)}\n".encode() + body + b"\n", b"\ndns:x 1.2.3.4 199701020304 text/dns 3\nabc\n"]
    two = [w.version_block("b.arc.gz", 2, "19990101000000"), f"http://y/ 0.0.0.0 19990102 text/html 200 - - 99 b.arc.gz {len(body)}\n".encode() + body + b"\n"]
    for name, members in (("a.arc.gz", one), ("b.arc.gz", two)):
        write(folder, name, members)
    archives = spark.createDataFrame([("a.arc.gz",), ("b.arc.gz",)], "archive string")
    index = {r.url: r for r in w.index_arc(archives, folder).collect()}
    assert set(index) == {"http://x/a b.html", "dns:x", "http://y/"}
    assert [index[u].date for u in ("http://x/a b.html", "dns:x", "http://y/")] == ["1997-01-02T03:04:05Z", "1997-01-02T03:04:00Z", "1999-01-02T00:00:00Z"]
    assert [index[u].payload_bytes for u in ("http://x/a b.html", "dns:x", "http://y/")] == [5, 3, 5]
    warcs = scratch(spark, "warcs")
    done = w.convert(w.index_arc(archives, folder), folder, warcs).collect()
    assert sorted(map(tuple, done)) == [("a.warc.gz", 3), ("b.warc.gz", 2)]
    records = [w.parse_warc(m) for name, _ in map(tuple, done) for _, m in w.members(warcs, name)]
    kinds = sorted(v["WARC-Type"] for v, _ in records)
    assert kinds == ["resource", "response", "revisit", "warcinfo", "warcinfo"]
    by_url = {v.get("WARC-Target-URI"): (v, block) for v, block in records}
    assert by_url["http://x/a b.html"][1] == body and by_url["http://x/a b.html"][0]["WARC-IP-Address"] == "1.2.3.4"
    assert by_url["dns:x"] [0]["Content-Type"] == "text/dns"
    assert len({v["WARC-Record-ID"] for v, _ in records}) == 5


def test_broken_archives_are_refused(spark):
    folder = scratch(spark, "arcs")
    write(folder, "short.arc.gz", [w.version_block("short.arc.gz", 1, "19961231235959"), b"http://x/ 1.2.3.4 19970102030405 text/html 99\nabc\n"])
    with pytest.raises(ValueError, match="shorter than its declared"):
        list(w.arc_records(folder, "short.arc.gz"))
    files, root = w.filesystem(folder)
    with files.open_input_stream(f"{root}/short.arc.gz", compression=None) as whole:
        data = whole.read()
    with files.open_output_stream(f"{root}/cut.arc.gz", compression=None) as out:
        out.write(data[:-9])
    with pytest.raises(ValueError, match="cut off"):
        list(w.members(folder, "cut.arc.gz"))


def test_names_and_bytes_do_not_change_between_runs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3, "page_id").sortWithinPartitions("page_id")
    runs = []
    for _ in range(2):
        folder = scratch(spark, "arcs")
        files, root = w.filesystem(folder)
        names = sorted(r.archive for r in w.write_arc(pages, folder, archive_bytes=40_000).collect())
        assert len(names) > 3
        runs.append({n: files.open_input_stream(f"{root}/{n}", compression=None).read() for n in names})
    assert runs[0] == runs[1]
