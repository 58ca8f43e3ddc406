"""Legacy ARC archives to WARC: header lines by version, declared lengths, synthesised records.

An ARC file opens with a version block whose last line names the fields of every header
line; version 1 has five, version 2 ten. Both are read by that line: the URL takes what is
left of the other fields, since old crawlers wrote blanks into it. A record is as long as its
header says. For each one a WARC record is made: its identifier from the archive's name and
the record's place (the same at every run), the date from the 14 digits, the type ``warcinfo``
for the version block, ``response`` or ``revisit`` for HTTP answers and ``resource`` for
others, and SHA-1 digests of payload and block.

Archives lie in a folder all executors share and are read as streams of one record at a time,
each record a gzip member of its own. A task writes its files under a passing name and then
renames them, and names depend on the partition only, so a repeated task leaves the same files.
What is shuffled are index rows (archive, place, digest, a page's id); payloads never are.

Defined results: a null payload counts as empty; a null URL becomes ``unknown:``, and blanks
and line ends in a URL are written as %20; a null page id comes back as null and is the last
in the order of ids; of repeated rows the one first in the archive is the response; an empty
table gives no archives and no rows; a very long payload is one record, held whole by the task
that writes or reads it; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeops.session import scratch

from .tables import stored

#: Bytes of records after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Header fields of the two versions; fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
FIRST_DATE = "20080101000000"
#: Names the identifiers that are made from places in archives.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
READ = 1 << 20


# ---- files


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Archive:
    """Writes records as gzip members; the file gets its name when it is complete."""

    def __init__(self, folder: str, name: str, level: int = 4) -> None:
        self.files, root = filesystem(folder)
        self.files.create_dir(root, recursive=True)
        self.name, self.path, self.passing = name, f"{root}/{name}", f"{root}/_{uuid.uuid4().hex}"
        self.stream, self.level, self.raw, self.records = self.files.open_output_stream(self.passing, compression=None), level, 0, 0

    def add(self, record: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.stream.write(packer.compress(record) + packer.flush())
        self.raw += len(record)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.stream.close()
        self.files.move(self.passing, self.path)
        return self.name, self.records


def members(folder: str, name: str) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of an archive, one in memory at a time."""
    files, root = filesystem(folder)
    with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
        place, rest = 0, b""
        while rest or (rest := stream.read(READ)):
            unpacker, parts, taken = zlib.decompressobj(31), [], 0
            while not unpacker.eof:
                if not rest and not (rest := stream.read(READ)):
                    raise ValueError(f"{name}: the record at byte {place} is cut off")
                taken += len(rest)
                parts.append(unpacker.decompress(rest))
                rest = unpacker.unused_data
            yield place, b"".join(parts)
            place += taken - len(rest)


# ---- ARC


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Offset": "0"}
    return header_line(values, version, len(body)) + body + b"\n"


def header_line(values: dict[str, str], version: int, length: int) -> bytes:
    values = {**values, "Archive-length": str(length)}
    return (" ".join(values.get(field, "-") for field in FIELDS[version].split()) + "\n").encode()


def parse_header(line: bytes, fields: list[str]) -> dict[str, str]:
    """The values of a header line by the names of its version; the URL may hold blanks."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    if len(values) != len(fields):
        raise ValueError(f"an ARC header of {len(fields)} fields expected, found {line[:200]!r}")
    return dict(zip(fields, values, strict=True))


def arc_records(folder: str, name: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header values and content of each record; the version block is the first."""
    fields: list[str] | None = None
    for place, member in members(folder, name):
        line, _, rest = member.lstrip(b"\r\n").partition(b"\n")
        if fields is None:  # the block itself has a header of version 1 or 2, told by its field count
            count = len(line.split(b" "))
            version = 2 if count >= len(FIELDS[2].split()) else 1
            header = parse_header(line, FIELDS[version].split())
            content = rest[: int(header["Archive-length"])]
            fields = content.decode("utf-8", "replace").split("\n")[1].split()
        else:
            header = parse_header(line, fields)
            length = int(header["Archive-length"])
            content = rest[:length]
            if len(content) < length:
                raise ValueError(f"{name}: the record at byte {place} is shorter than its declared {length} bytes")
        yield place, header, content


def http_payload(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header values (names in lower case), the header with its empty line, and the payload of an HTTP answer."""
    if not content.startswith(b"HTTP/"):
        return {}, b"", content
    cut = re.search(rb"\r?\n\r?\n", content)
    head, payload = (content[: cut.end()], content[cut.end() :]) if cut else (content, b"")
    lines = head.decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}, head, payload


def write_arc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each row as an ARC record; ``archive, records`` of the files. Even partitions write version 1, odd ones 2."""
    source = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))

    def run(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        version, done, archive = 1 + part % 2, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    name = f"part-{part:05d}-{len(done):05d}.arc.gz"
                    archive = Archive(folder, name)
                    archive.add(version_block(name, version, FIRST_DATE))
                payload = row["payload"]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                if row["id"] is not None:
                    head += f"X-Page-Id: {row['id']}\r\n"
                content = head.encode() + b"\r\n" + payload
                url = re.sub(r"\s", "%20", row["url"] or "unknown:")
                values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": FIRST_DATE, "Content-type": "text/html", "Result-code": "200", "Offset": str(archive.raw), "Filename": archive.name}
                archive.add(header_line(values, version, len(content)) + content + b"\n")
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return source.mapInArrow(run, "archive string, records long")


def index_arc(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the ARC files but version blocks: ``archive, place, url, date, record_id, page_id, digest, payload_bytes``."""
    schema = "archive string, place long, url string, date string, record_id string, page_id string, digest string, payload_bytes long"

    def rows(name):
        for place, header, content in arc_records(folder, name):
            if not header["URL"].startswith("filedesc:"):
                about, _, payload = http_payload(content)
                yield name, place, header["URL"], warc_date(header["Archive-date"]), record_id(name, place), about.get("x-page-id"), sha1(payload), len(payload)

    return _dealt(archives).mapInArrow(_by_file(rows, schema), schema)


#: Tasks that archives are dealt to at most; beyond that a task works through several, one after the other.
MOST_TASKS = 20_000


def _dealt(archives: DataFrame) -> DataFrame:
    """A task per archive. The number is given, as a table of names looks too small to be worth several tasks."""
    names = archives.select("archive")
    return names.repartition(max(1, min(MOST_TASKS, names.count())))


def _by_file(rows, schema: str):
    """A function for mapInArrow that turns each row (an archive's name) into rows."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = [{"long": pa.int64(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]

        def batch(made):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

        for read in batches:
            made = []
            for name in read.column(0).to_pylist():
                for row in rows(name):
                    made.append(row)
                    if len(made) == 10_000:
                        yield batch(made)
                        made = []
            if made:
                yield batch(made)

    return run


# ---- WARC


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}:{place}')}>"


def warc_date(digits: str) -> str:
    """The 14 digits of ARC as ISO 8601; shorter ones (old files have 12 or 8) are filled up."""
    digits = (re.sub(r"\D", "", digits) + "00000101000000"[len(re.sub(r"\D", "", digits)) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(values: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**values, "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def converted(name: str, place: int, header: dict[str, str], content: bytes, first: dict[str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``first`` has identifier, URL and date of the record it repeats."""
    values = {"WARC-Record-ID": record_id(name, place), "WARC-Date": warc_date(header["Archive-date"])}
    if header["URL"].startswith("filedesc:"):
        return warc_record({"WARC-Type": "warcinfo", **values, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, content)
    values["WARC-Target-URI"] = header["URL"]
    if header["IP-address"] not in ("-", "0.0.0.0"):
        values["WARC-IP-Address"] = header["IP-address"]
    _, head, payload = http_payload(content)
    values["WARC-Payload-Digest"] = f"sha1:{sha1(payload)}"
    kind = "application/http; msgtype=response" if head else header["Content-type"]
    if first is None:
        return warc_record({"WARC-Type": "response" if head else "resource", **values, "Content-Type": kind}, content)
    values |= {"WARC-Refers-To": first["record_id"], "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": first["date"], "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
    return warc_record({"WARC-Type": "revisit", **values, "Content-Type": kind}, head)


def repeats(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``archive, place`` of each record, and what it repeats: ``record_id, url, date`` of the equal payload of the smallest page, else null.

    Ids that are whole numbers are ordered by value. Payloads under ``least_bytes`` bytes repeat nothing.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), F.try_to_number("page_id", F.lit("S" + "9" * 37)).alias("number"), "page_id", "archive", "place")
    large = index.where(F.col("payload_bytes") >= least_bytes)
    firsts = large.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("by"), "record_id", "url", "date")).alias("first")).where("n > 1")
    firsts = stored(firsts.select("digest", "payload_bytes", "first.*").drop("by").withColumnsRenamed({"record_id": "first_id", "url": "first_url", "date": "first_date"}), "first-records")
    joined = index.join(firsts, ["digest", "payload_bytes"], "left")
    other = F.col("first_id") != F.col("record_id")
    return joined.select("archive", "place", *(F.when(other, F.col(c)).alias(c) for c in ("first_id", "first_url", "first_date")))


def convert(index: DataFrame, arc_folder: str, warc_folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Writes a WARC file for each ARC file that the index holds; ``archive, records`` of the WARC files."""
    # twice as many tasks as archives, since their names are hashed
    tasks = max(1, min(MOST_TASKS, 2 * index.select("archive").distinct().count()))
    decided = repeats(index, least_bytes).repartition(tasks, "archive").sortWithinPartitions("archive", "place")

    def run(batches):
        import pyarrow as pa

        def close(source, written):
            for place, header, content in source:  # what the index does not hold: nothing but version blocks
                written.add(converted(name, place, header, content, None))
            return written.close()

        name, source, written, done = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if written:
                        done.append(close(source, written))
                    name = row["archive"]
                    source, written = arc_records(arc_folder, name), Archive(warc_folder, re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz")
                for place, header, content in source:
                    wanted = place == row["place"]
                    first = {"record_id": row["first_id"], "url": row["first_url"], "date": row["first_date"]} if wanted and row["first_id"] else None
                    written.add(converted(name, place, header, content, first))
                    if wanted:
                        break
        if written:
            done.append(close(source, written))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return decided.mapInArrow(run, "archive string, records long")


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header values and block of a record, by its declared length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {record[:80]!r}")
    values = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(values["Content-Length"])]
    if f"sha1:{sha1(block)}" != values["WARC-Block-Digest"]:
        raise ValueError(f"{values['WARC-Record-ID']}: the block does not have its digest")
    return values, block


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """A row per page record of the WARC files: ``record_id, page_id, url, record_type, payload_bytes, payload_digest, first_id``.

    A response's digest is taken from the payload read and held against its header; a
    revisit has the digest of its header and the length its HTTP header declares.
    """
    schema = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, first_id string"

    def rows(name):
        for _, record in members(folder, name):
            values, block = parse_warc(record)
            if values["WARC-Type"] == "warcinfo":
                continue
            about, _, payload = http_payload(block)
            digest = values["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = values["WARC-Type"] == "revisit"
            if not revisit and sha1(payload) != digest:
                raise ValueError(f"{values['WARC-Record-ID']}: the payload does not have its digest")
            size = int(about["content-length"]) if revisit else len(payload)
            yield values["WARC-Record-ID"], about.get("x-page-id"), values["WARC-Target-URI"], values["WARC-Type"], size, digest, values.get("WARC-Refers-To")

    return _dealt(archives).mapInArrow(_by_file(rows, schema), schema)


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``id_col, payload_bytes, payload_digest, record_type, refers_to, url``: each page, written as ARC, converted, read from WARC."""
    spark: SparkSession = pages.sparkSession
    kind = pages.schema[id_col].dataType
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    index = stored(index_arc(stored(write_arc(pages, arc, id_col=id_col, url_col=url_col, payload_col=payload_col), "arc-files"), arc), "arc-index")
    records = stored(read_warc(stored(convert(index, arc, warc, least_bytes=least_bytes), "warc-files"), warc), "warc-records")
    firsts = stored(records.where("record_type = 'revisit'").select("first_id").distinct().join(records.select(F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page")), "first_id"), "first-pages")
    joined = records.join(firsts, "first_id", "left")
    return joined.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("first_page").cast(kind).alias("refers_to"), F.col("url").alias("target_uri")
    )
