"""Legacy web archives (ARC versions 1 and 2) converted to WARC, with digests, revisit records and reading back.

An ARC file is a version block, whose last line before its end names the URL-record fields, and records of one header line
and as many bytes as the line declares. Version 1 lines have 5 fields (URL, IP, date, type, length); version 2 lines have
10 (result code, checksum, location, offset and file name added). The converter parses them by the declared lengths and
synthesises WARC fields: WARC-Record-ID (a name-based UUID of the archive, the place in it, URL, date, page and digest, so that each record has its own and a retried task names it alike), WARC-Date (from the 14 digits),
WARC-Type, Content-Type and a SHA-256 WARC-Payload-Digest of what follows the HTTP head.

Archives travel as (path, content) rows, as the binaryFile source gives them, so a task holds one file of bounded size.
WARC files are written with pyarrow's file systems, so the target may be local, S3, GCS or HDFS; a retried task replaces its file.

Defined results: null html is an empty payload; null urls become 'about:blank'; white space in a URL is percent-encoded; a null
page id has no header and is read back as null; payloads below MIN_REVISIT bytes are always responses; rows that repeat a
page id and payload are all responses, as none has a smaller page id; a declared length beyond the
file's end and a header line that the version does not fit are errors in parse_arc, and rows of malformed(); the records before them count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm._frames import scratch, splittable

MIN_REVISIT = 100
ARC_BYTES = 4 << 20
WARC_BYTES = 16 << 20
_DATE = "20240101000000"
#: The field lines of the two versions.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 InternetArchive\n{ARC_FIELDS[version]}\n\n".encode()
    lead = f"filedesc://{name} 0.0.0.0 {_DATE} text/plain"
    lead += " 200 - - 0 " + name if version == 2 else ""
    return f"{lead} {len(body)}\n".encode() + body


def arc_record(url: str, version: int, name: str, offset: int, block: bytes) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {_DATE} text/html{more} {len(block)}\n".encode() + block + b"\n"


#: URL, IP, date, what the versions differ in, length; a URL and a content type may hold blanks.
_LINE = re.compile(r"(.*?) (\S+) (\d{14}) (.*) (\d+)", re.DOTALL)


def _header(line: str, version: int | None) -> tuple[str, str, str, str, int] | None:
    """(url, ip, date, type, length) of a header line, null if it isn't one of the version."""
    m = _LINE.fullmatch(line)
    if not m or version is None:
        return None
    mime = m[4]
    if version == 2:
        parts = mime.rsplit(" ", 5)
        if len(parts) < 6 or not parts[4].isdigit():
            return None
        mime = parts[0]
    elif re.search(r" \d{3} \S+ \S+ \d+ \S+$", mime):  # fields of the other version
        return None
    return m[1], m[2], m[3], mime, int(m[5])


def parse_arc(content: bytes, bad: list | None = None):
    """Yields (url, ip, date, type, offset, block) for each record; plain or gzipped content.

    A malformed record is an error, or with `bad` an (offset, line, reason) there: the next one follows if a length is declared, else the file ends.
    """

    def wrong(reason: str) -> None:
        if bad is None:
            raise ValueError(f"record at {at}: {reason}")
        bad.append((at, line[:1000], reason))

    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    version, at = None, 0
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", "replace")
        declared = line.rsplit(" ", 1)[-1]
        if not (declared.isascii() and declared.isdigit()):
            return wrong("no length is declared")
        size = int(declared)
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            return wrong(f"{size} bytes are declared, {len(block)} are left")
        if line.startswith("filedesc://"):
            version = int(block[:1]) if block[:1].isdigit() else None
            if version not in ARC_FIELDS:
                wrong("unknown archive version")
        elif (fields := _header(line, version)) is None:
            wrong(f"not a header line of version {version}")
        else:
            yield *fields[:4], at, block
        at = end + 1 + size


def to_arc(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (path, content) rows: ARC files of bounded size, odd partitions in version 1, even ones in 2."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, count, out = (2, 1)[part % 2], 0, None
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if out is None:
                    name = f"part-{part:06d}-{count:05d}.arc"
                    out = io.BytesIO()
                    out.write(arc_version_block(name, version))
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{'' if page is None else f'X-Page-Id: {page}{chr(13)}{chr(10)}'}Content-Length: {len(payload)}\r\n\r\n"
                safe = "".join(f"%{ord(c):02X}" if c.isspace() and ord(c) < 128 else c for c in "".join(c if not c.isspace() or ord(c) < 128 else "%20" for c in (url or ""))) or "about:blank"
                out.write(arc_record(safe, version, name, out.tell(), head.encode() + payload))
                if out.tell() >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], ["path", "content"])
                    out, count = None, count + 1
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], ["path", "content"])

    return pages.select("page_id", "url", "html").mapInArrow(write, "path string, content binary")


_RECORD = "page_id long, record_id string, target string, date string, ip string, mime string, head binary, payload binary, digest string, reason string"


_NUMBER = re.compile(rb"\s*([+-]?[0-9]{1,19})\s*")


def _page_id(head: bytes) -> int | None:
    """The number in the X-Page-Id field; null where a foreign record has none, or something else there."""
    found = (_NUMBER.fullmatch(x[10:]) for x in head.split(b"\r\n") if x[:10].lower() == b"x-page-id:")
    return next((int(m[1]) for m in found if m and -(2**63) <= int(m[1]) < 2**63), None)


def parsed(archives: DataFrame) -> DataFrame:
    """ARC files (path, content) -> a row per record with the synthesised WARC fields; of one that can't be read only
    target (its header line), record_id (path and offset) and reason are set."""

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, bad = [], []
                for url, ip, date, mime, offset, block in parse_arc(content.as_py(), bad):
                    head, sep, payload = block.partition(b"\r\n\r\n") if block[:5] == b"HTTP/" else (b"", b"", block)
                    page = _page_id(head)
                    digest = hashlib.sha256(payload).hexdigest()
                    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
                    rows.append((page, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path} {offset} {url} {date} {page} {digest}')}", url, when, ip, mime, head + sep, payload, digest, None))
                    if len(rows) == 256:
                        yield _records(rows)
                        rows = []
                rows += [(None, f"{path} {offset}", line, *[None] * 6, reason) for offset, line, reason in bad]
                if rows:
                    yield _records(rows)

    return archives.select("path", "content").mapInArrow(parse, _RECORD)


def malformed(archives: DataFrame) -> DataFrame:
    """(path, offset, line, reason) of the records of ARC files that convert() leaves out."""
    bad = parsed(archives).where("reason is not null")
    return bad.select(F.regexp_extract("record_id", "^(.*) ([0-9]+)$", 1).alias("path"), F.regexp_extract("record_id", "([0-9]+)$", 1).cast("long").alias("offset"), F.col("target").alias("line"), "reason")


def convert(archives: DataFrame) -> DataFrame:
    """The well-formed records of ARC files; malformed() has the others, and write_warc counts them where it is given parsed() as a whole."""
    return parsed(archives).where("reason is null").drop("reason")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] + [pa.string()] * 5 + [pa.binary()] * 2 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["page_id", "record_id", "target", "date", "ip", "mime", "head", "payload", "digest", "reason"])


def mark_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Adds refers_to and refers_id: the page and record of the first response with the same payload, null for responses."""
    narrow = records.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "record_id", "digest")
    first = narrow.groupBy("digest").agg(F.min(F.struct("page_id", "record_id")).alias("f"), F.max("page_id").alias("most")).where("f.page_id < most").select("digest", "f")
    later = narrow.join(splittable(first, "digest"), "digest").where("page_id > f.page_id").select("page_id", "digest", F.col("f.page_id").alias("refers_to"), F.col("f.record_id").alias("refers_id")).distinct()
    return records.join(later, ["page_id", "digest"], "left")


def _warc_record(r: dict) -> bytes:
    revisit = r["refers_to"] is not None
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['target']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha256:{r['digest']}", f"X-Payload-Length: {len(r['payload'])}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['refers_id']}>", f"X-Refers-To-Page: {r['refers_to']}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> tuple[int, int]:
    """Writes gzipped WARC files, each record a member of its own, under `folder` (any pyarrow file system URI).

    Returns the number of files, and of rows with a reason (malformed records), which are counted in the same pass and not written.
    """

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        count, buffer, names, lost = 0, io.BytesIO(), [], 0

        def flush():
            nonlocal count, buffer
            name = f"{base}/part-{task.partitionId():06d}-{count:05d}.warc.gz"
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(buffer.getbuffer())
            system.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            names.append(name)
            count, buffer = count + 1, io.BytesIO()

        for batch in batches:
            bad = batch.schema.get_field_index("reason")
            for i in range(batch.num_rows):
                if bad >= 0 and batch.column(bad)[i].is_valid:
                    lost += 1
                    continue
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                buffer.write(packer.compress(_warc_record({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)})) + packer.flush())
                if buffer.tell() >= WARC_BYTES:
                    flush()
        if buffer.tell():
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([len(names)]), pa.array([lost])], ["files", "malformed"])

    # sorted, so that a retried task cuts its files at the same records and replaces them
    made = records.sortWithinPartitions("record_id").mapInArrow(write, "files long, malformed long").agg(F.sum("files"), F.sum("malformed")).first()
    return made[0] or 0, made[1] or 0


def parse_warc(content: bytes):
    """Yields (header fields, block) for each record of a gzipped WARC file, a member at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:  # fed in small pieces, as what follows the member is copied
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("truncated archive")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target, record_id, date."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = _page_id(head)
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                    digest = fields["WARC-Payload-Digest"].split(":", 1)[1] if revisit else hashlib.sha256(payload).hexdigest()
                    rows.append((page, size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"].strip("<>"), fields["WARC-Date"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "record_id", "date"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, record_id string, date string")


_EMPTY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, record_id string, date string"


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages -> ARC -> WARC files in `folder` (by default a new one in the shared folder) -> the records read back."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    files, lost = write_warc(mark_revisits(parsed(to_arc(pages))), folder)
    if lost:
        raise ValueError(f"{lost} records could not be read back from their archives")
    if not files:
        return spark.createDataFrame([], _EMPTY)
    return read_warc(spark, folder)
